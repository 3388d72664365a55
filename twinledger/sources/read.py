"""One entry point for all inputs: rows, rejects, header lines and trailer lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions.names import distinct_names, with_clean_names
from twinledger.sources import delimited
from twinledger.sources.fixed_width import read_fixed_width
from twinledger.sources.lines import (
    LINE,
    LINE_HEADS,
    body_lines,
    data_lines,
    header_frame,
    header_lines,
    is_trailer,
    raw_lines,
    trailer_frame,
)
from twinledger.spec import TableSpec

REJECT_SCHEMA = "file string, line_number bigint, error_type string, csv_line string"


@dataclass(frozen=True)
class LoadedTable:
    """A table ready to compare. All frames are lazy except the few header lines."""

    spec: TableSpec
    rows: DataFrame
    rejects: DataFrame
    headers: DataFrame
    trailers: DataFrame
    parsed: DataFrame | None = None
    counts_of: DataFrame | None = None
    header_text: tuple[str, ...] = ()

    def first_rejects(self, n: int) -> DataFrame:
        """The first ``n`` rejected lines in file order."""
        return self.rejects.orderBy("file", "line_number").limit(n)

    @property
    def counts(self) -> DataFrame:
        """One row: good rows and rejected lines, from a single scan."""
        if self.counts_of is not None:
            return self.counts_of
        if self.parsed is not None:
            bad = F.col(delimited.REJECT).isNotNull()
            return self.parsed.agg(F.count_if(~bad).alias("row_count"), F.count_if(bad).alias("reject_count"))
        return self.rows.agg(F.count(F.lit(1)).alias("row_count"), F.lit(0).cast("bigint").alias("reject_count"))


def read_table(spark: SparkSession, spec: TableSpec) -> LoadedTable:
    """Read one side of a comparison as its spec describes it."""
    no_lines = spark.createDataFrame([], LINE_HEADS)
    no_rejects = spark.createDataFrame([], REJECT_SCHEMA)
    if spec.is_parquet:
        return LoadedTable(spec, with_clean_names(spark.read.parquet(spec.path)), no_rejects, no_lines, no_lines)

    headers = header_lines(spark, spec)
    edges = (header_frame(spark, headers), trailer_frame(spark, spec))
    if spec.is_fixed_width:
        rows = read_fixed_width(spark, spec, headers)
        return LoadedTable(spec, rows, no_rejects, *edges, header_text=tuple(headers))

    names = delimited_names(spark, spec, headers)
    if not names:
        empty = spark.createDataFrame([], "column0 string")
        return LoadedTable(spec, empty, no_rejects, *edges)
    raw = None
    if spec.multi_line and spec.opens_natively:
        parsed = delimited.parse_multi_line(spark, names, spec)
    else:
        raw = raw_lines(spark, spec)
        lines = record_lines(raw, spec, len(names))
        parsed = delimited.parse_lines(lines.filter(~is_trailer(F.col(LINE), spec.trailer_patterns)), names, spec)
    return LoadedTable(
        spec,
        delimited.good_rows(parsed, names),
        delimited.rejected_rows(raw, parsed),
        *edges,
        parsed=parsed,
        header_text=tuple(headers),
    )


def record_lines(raw: DataFrame, spec: TableSpec, count: int) -> DataFrame:
    """The lines after the header, those of one record joined. Looks for open quotes, with one action."""

    def joined(lines: DataFrame) -> DataFrame:
        return delimited.join_records(lines, count, spec)

    return body_lines(raw, spec, joined if delimited.may_span_lines(raw, spec) else None)


def delimited_names(spark: SparkSession, spec: TableSpec, headers: list[str]) -> list[str]:
    """Given names, else the last header line, else ``columnN`` after the first record's fields."""
    if spec.column_names:
        return distinct_names(spec.column_names)
    if headers:
        return delimited.header_names(spark, spec, headers[-1])
    first = data_lines(spark, spec).select(LINE).head()
    return delimited.auto_names(len(delimited.fields_of(spark, spec, first[0]))) if first else []
