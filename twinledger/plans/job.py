"""A complete run: read both sides, reconcile, store everything, record the run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions import fmt
from twinledger.functions.chardiff import CHAR_DIFF_TYPE
from twinledger.functions.compare import MATCH
from twinledger.functions.names import key_names, ref
from twinledger.operators.lines import compare_lines
from twinledger.operators.reconcile import (
    FOUND_IN_BOTH,
    MISSING_IN_SOURCE,
    MISSING_IN_TARGET,
    derive_statistics,
    reconcile,
    sample_of_equal_tables,
)
from twinledger.operators.results import rows_of_key
from twinledger.plans.history import HISTORY_SCHEMA, append_run
from twinledger.plans.report import report_tables
from twinledger.plans.session import delete_path, in_parallel, scratch_dir
from twinledger.sources.read import REJECT_SCHEMA
from twinledger.sources.stage import stage_table
from twinledger.spec import JobConfig

META_SCHEMA = """
    run_id string, primary_keys array<string>, columns array<string>, source_only array<string>,
    target_only array<string>, exceptions_schema string, tables array<string>,
    summary struct<source_count: bigint, target_count: bigint, source_keys: bigint, target_keys: bigint,
        found_in_both: bigint, missing_in_source: bigint, missing_in_target: bigint,
        mismatched_rows: bigint, mismatched_rows_exact: bigint, source_duplicate_rows: bigint,
        target_duplicate_rows: bigint, matching_rows: bigint, match_percentage: double,
        row_count_diff: bigint>,
    column_stats array<struct<column_name: string, compared: bigint, matching: bigint,
        mismatched: bigint, match_percentage: double>>
"""
LINE_SCHEMA = (
    "line_number bigint, source string, target string, status string, first_diff_pos int, diff_count int, "
    f"char_diffs {CHAR_DIFF_TYPE}, source_len int, target_len int"
)


@dataclass(frozen=True)
class StoredRun:
    """A run's stored tables, read back lazily."""

    run_id: str
    path: str
    keys: list[str]
    detail: DataFrame
    summary: DataFrame
    column_stats: DataFrame
    header_comparison: DataFrame
    trailer_comparison: DataFrame
    source_rejects: DataFrame
    target_rejects: DataFrame
    sample: DataFrame | None

    def report(self, cap: int | None = None, sample_cap: int | None = None) -> dict[str, DataFrame]:
        """The report tables; caps bound how many rows the detail tables and the sample list."""
        return report_tables(
            self.detail,
            self.summary,
            self.keys,
            sample=self.sample,
            header_comparison=self.header_comparison,
            trailer_comparison=self.trailer_comparison,
            source_rejects=self.source_rejects,
            target_rejects=self.target_rejects,
            cap=cap,
            sample_cap=sample_cap,
        )

    def find(self, key: Mapping[str, object], status: str | None = None) -> DataFrame:
        """Detail of one key, or of all that share the given part of it; see ``rows_of_key``."""
        return rows_of_key(self.detail, key, status)


def exception_counts(exceptions: DataFrame, columns: list[str]) -> DataFrame:
    """One row: what the stored exceptions say about the whole comparison."""
    status = F.col("validation_status")
    return exceptions.agg(
        F.count_if(status == MISSING_IN_SOURCE).alias("missing_in_source"),
        F.count_if(status == MISSING_IN_TARGET).alias("missing_in_target"),
        F.count_if("mismatch").alias("mismatched_rows"),
        F.count_if("mismatch_exact").alias("mismatched_rows_exact"),
        F.coalesce(F.sum(F.greatest(F.col("source_rows") - 1, F.lit(0))), F.lit(0)).alias("source_surplus"),
        F.coalesce(F.sum(F.greatest(F.col("target_rows") - 1, F.lit(0))), F.lit(0)).alias("target_surplus"),
        *[
            F.count_if((status == FOUND_IN_BOTH) & (ref(f"{c}_status") != MATCH)).alias(f"_x{i}")
            for i, c in enumerate(columns)
        ],
    )


def summary_from_exceptions(
    spark: SparkSession, source_count: int, target_count: int, counts: Row
) -> DataFrame:
    """The run summary from the two row counts and the exceptions alone."""
    source_keys = source_count - counts["source_surplus"]
    target_keys = target_count - counts["target_surplus"]
    known = {
        "source_count": source_count,
        "target_count": target_count,
        "source_keys": source_keys,
        "target_keys": target_keys,
        "found_in_both": source_keys - counts["missing_in_target"],
        **{
            name: counts[name]
            for name in ("missing_in_source", "missing_in_target", "mismatched_rows", "mismatched_rows_exact")
        },
    }
    schema = ", ".join(f"{name} bigint" for name in known)
    return derive_statistics(spark.createDataFrame([tuple(known.values())], schema))


def _column_stats(columns: list[str], compared: int, counts: Row) -> list[tuple]:
    """Per column: name, keys in both, matching, mismatched, match percentage."""
    rows = []
    for i, name in enumerate(columns):
        differing = counts[f"_x{i}"]
        matching = compared - differing
        rows.append((name, compared, matching, differing, matching / compared * 100 if compared else 0.0))
    return rows


def run_recon_job(spark: SparkSession, config: JobConfig) -> StoredRun:
    """Run one comparison, store its tables below ``<output>/runs/<run id>``, record it, reopen it.

    A run that fails is recorded with its error before the error is passed on. The staged copies of text
    inputs are removed in either case.
    """
    began, started = time.time(), datetime.now(timezone.utc)
    naming = fmt.run_id(F.lit(config.job_name), F.lit(config.source.filename), F.lit(started))
    # The tail keeps runs apart that begin within the same second.
    run_id = f"{spark.range(1).select(naming).head()[0]}_{uuid4().hex[:8]}"
    path = f"{config.output.rstrip('/')}/runs/{run_id}"
    staging = scratch_dir(spark)
    try:
        known = _run(spark, config, run_id, path, staging)
    except Exception as error:
        failure = {"status": "error", "message": str(error).split("\n")[0]}
        _record(spark, config, run_id, path, failure, started, began)
        raise
    finally:
        delete_path(spark, staging)
    _record(spark, config, run_id, path, known, started, began)
    return load_run(spark, config.output, run_id)


def _run(spark: SparkSession, config: JobConfig, run_id: str, path: str, staging: str) -> dict:
    """Compare and store; returns what the history records about the outcome.

    Text is parsed once, into the shared scratch folder. The compared data is shuffled once: that
    pass writes only the exceptions, and the summary and column statistics follow from them and the
    two row counts. All that later steps read is committed to storage, so a lost executor costs at
    most the tasks it was running.
    """
    source, target = in_parallel(
        spark,
        lambda: stage_table(spark, config.source, f"{staging}/source"),
        lambda: stage_table(spark, config.target, f"{staging}/target"),
    )
    result = reconcile(spark, source.rows, target.rows, list(config.primary_keys), config.rules)
    _store_exceptions(result.exceptions, result.keys, f"{path}/exceptions")
    stored = spark.read.schema(result.exceptions.schema).parquet(f"{path}/exceptions")
    counts, source_counts, target_counts = in_parallel(
        spark, exception_counts(stored, result.columns).head, source.counts.head, target.counts.head
    )
    stats = summary_from_exceptions(spark, source_counts["row_count"], target_counts["row_count"], counts).head()

    tables = {}
    if stats["mismatched_rows"] + stats["missing_in_source"] + stats["missing_in_target"] == 0:
        tables["sample"] = sample_of_equal_tables(
            spark, source.rows, target.rows, result.keys, config.rules, config.sample_rows
        )
    if source.header_text or target.header_text:
        tables["header_comparison"] = compare_lines(source.headers, target.headers)
    if config.source.trailer_patterns or config.target.trailer_patterns:
        tables["trailer_comparison"] = compare_lines(source.trailers, target.trailers)
    if source_counts["reject_count"]:
        tables["source_rejects"] = source.rejects
    if target_counts["reject_count"]:
        tables["target_rejects"] = target.rejects

    def write(name: str, df: DataFrame) -> Callable:
        return lambda: df.write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/{name}")

    if tables:
        in_parallel(spark, *[write(name, df) for name, df in tables.items()])
    meta = (
        run_id,
        result.keys,
        result.columns,
        result.source_only,
        result.target_only,
        result.exceptions.schema.json(),
        sorted(tables),
        tuple(stats),
        _column_stats(result.columns, stats["found_in_both"], counts),
    )
    spark.createDataFrame([meta], META_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return {
        **stats.asDict(),
        "status": "completed",
        "primary_keys": result.keys,
        "source_rejects": source_counts["reject_count"],
        "target_rejects": target_counts["reject_count"],
    }


def _store_exceptions(exceptions: DataFrame, keys: list[str], path: str) -> None:
    """Write the exceptions so that a key or a status is found without reading them all.

    Rebalancing moves only the exceptions, and turns many nearly empty files into a few full ones. Each file is
    sorted by status and key, so that page statistics are narrow, and has Bloom filters of its key columns, sized
    to what it holds, so that most files are left out altogether.
    """
    blooms = {f"parquet.bloom.filter.enabled#{k}": "true" for k in keys}
    ordered = exceptions.hint("rebalance").sortWithinPartitions(
        "is_difference", "validation_status", *[ref(k) for k in keys]
    )
    ordered.write.mode("overwrite").option("compression", "snappy").options(
        **blooms, **{"parquet.bloom.filter.adaptive.enabled": "true"}
    ).partitionBy("is_difference").parquet(path)


def _record(
    spark: SparkSession,
    config: JobConfig,
    run_id: str,
    path: str,
    outcome: dict,
    started: datetime,
    began: float,
) -> None:
    finished = time.time()
    elapsed = spark.range(1).select(fmt.format_duration(F.lit(began), F.lit(finished))).head()[0]
    known = {
        "run_id": run_id,
        "job_name": config.job_name,
        "source_path": config.source.path,
        "target_path": config.target.path,
        "primary_keys": key_names(config.primary_keys),
        "output": path,
        "message": f"Completed in {elapsed}",
        "started_at": started,
        "finished_at": datetime.fromtimestamp(finished, timezone.utc),
        "run_date": started.date(),
        **outcome,
    }
    names = spark.createDataFrame([], HISTORY_SCHEMA).columns
    append_run(spark.createDataFrame([tuple(known.get(name) for name in names)], HISTORY_SCHEMA), config.output)


def load_run(spark: SparkSession, output: str, run_id: str) -> StoredRun:
    """Reopen a stored run by its id."""
    path = f"{output.rstrip('/')}/runs/{run_id}"
    stored_meta = spark.read.schema(META_SCHEMA).json(f"{path}/meta")
    meta = stored_meta.head()
    keys = list(meta["primary_keys"])
    exceptions = spark.read.schema(T.StructType.fromJson(json.loads(meta["exceptions_schema"])))

    def stored(name: str, schema: str) -> DataFrame:
        if name in meta["tables"]:
            return spark.read.schema(schema).parquet(f"{path}/{name}")
        return spark.createDataFrame([], schema)

    triplets = [f"{c}_{part}" for c in meta["columns"] for part in ("status", "source", "target")]
    return StoredRun(
        run_id=run_id,
        path=path,
        keys=keys,
        detail=exceptions.parquet(f"{path}/exceptions")
        .filter("is_difference")
        .select("validation_status", *[ref(name) for name in [*keys, *triplets]]),
        summary=stored_meta.select("summary.*"),
        column_stats=stored_meta.select(F.inline("column_stats")),
        header_comparison=stored("header_comparison", LINE_SCHEMA),
        trailer_comparison=stored("trailer_comparison", LINE_SCHEMA),
        source_rejects=stored("source_rejects", REJECT_SCHEMA),
        target_rejects=stored("target_rejects", REJECT_SCHEMA),
        sample=spark.read.parquet(f"{path}/sample") if "sample" in meta["tables"] else None,
    )
