"""Compare two files in one call: rows, header and trailer lines, rejects, report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from twinledger.operators.lines import compare_lines
from twinledger.operators.reconcile import ReconResult, reconcile
from twinledger.plans.report import report_tables
from twinledger.plans.session import scratch_dir
from twinledger.sources.read import LoadedTable, read_table
from twinledger.spec import CompareRules, TableSpec


@dataclass(frozen=True)
class FileComparison:
    """The lazy result of comparing two described inputs."""

    source: LoadedTable
    target: LoadedTable
    result: ReconResult

    @property
    def header_comparison(self) -> DataFrame | None:
        """Line-by-line comparison of the headers; None when neither side has any."""
        if not (self.source.header_text or self.target.header_text):
            return None
        return compare_lines(self.source.headers, self.target.headers)

    @property
    def trailer_comparison(self) -> DataFrame | None:
        """Line-by-line comparison of the trailers; None when no side describes any."""
        if not (self.source.spec.trailer_patterns or self.target.spec.trailer_patterns):
            return None
        return compare_lines(self.source.trailers, self.target.trailers)

    @property
    def source_rejects(self) -> DataFrame:
        return self.source.rejects

    @property
    def target_rejects(self) -> DataFrame:
        return self.target.rejects

    def report(self, sample_rows: int | None = None, cap: int | None = None) -> dict[str, DataFrame]:
        """The report tables; with ``sample_rows``, also that many matching rows.

        The differences are stored below the shared scratch folder first, so that the inputs are compared
        once for all tables, and once more for summary and sample each.
        """
        detail = self.result.detail
        spark, path = detail.sparkSession, scratch_dir(detail.sparkSession)
        detail.write.parquet(path)
        return report_tables(
            spark.read.schema(detail.schema).parquet(path),
            self.result.summary,
            self.result.keys,
            sample=None if sample_rows is None else self.result.sample(sample_rows),
            cap=cap,
            header_comparison=self.header_comparison,
            trailer_comparison=self.trailer_comparison,
            source_rejects=self.source_rejects,
            target_rejects=self.target_rejects,
        )


def compare_files(
    spark: SparkSession,
    source: TableSpec,
    target: TableSpec,
    keys: str | list[str],
    rules: CompareRules | None = None,
    unique_keys: bool | None = None,
) -> FileComparison:
    """Read both sides as described, each with its own settings, and compare them.

    Whether keys repeat is looked up only in Parquet: in text that would cost a whole parse.
    """
    left, right = read_table(spark, source), read_table(spark, target)
    if unique_keys is None and not (source.is_parquet and target.is_parquet):
        unique_keys = False
    return FileComparison(left, right, reconcile(spark, left.rows, right.rows, keys, rules, unique_keys))
