"""Line-by-line comparison of header and trailer lines, down to single characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.functions.chardiff import CHAR_DIFF_TYPE, char_diff
from twinledger.operators.reconcile import MISSING_IN_SOURCE, MISSING_IN_TARGET


# Lines per chunk are at most two to this power, also in a file that cannot be split.
CHUNK_BITS = 20


def number_lines(
    lines: DataFrame, split: tuple[str, ...] = ("__file", "__block"), position: str = "__pos"
) -> DataFrame:
    """Number lines 1..n in file order without gathering them in one task.

    ``split`` names the piece of a file that one task reads, file first, and ``position`` grows within
    it by one per line read. Lines are ranked within chunks of bounded size; the totals of the earlier
    chunks of the file, and of the files before, are added to that. Running totals go over the chunks of
    each file and over the files, never over all chunks together.
    """
    chunk, file = (*split, "__chunk"), split[0]
    lines = lines.withColumn("__chunk", F.shiftright(F.col(position), CHUNK_BITS))
    totals = lines.groupBy(*chunk).agg(F.count(F.lit(1)).alias("__n"))
    earlier = (Window.unboundedPreceding, -1)
    in_file = F.sum("__n").over(Window.partitionBy(file).orderBy(*chunk[1:]).rowsBetween(*earlier))
    files = totals.groupBy(file).agg(F.sum("__n").alias("__n"))
    before_file = F.sum("__n").over(Window.orderBy(file).rowsBetween(*earlier))
    starts = files.select(file, F.coalesce(before_file, F.lit(0)).alias("__start"))
    offsets = (
        totals.select(*chunk, F.coalesce(in_file, F.lit(0)).alias("__in_file"))
        .join(starts, file)
        .select(*chunk, (F.col("__start") + F.col("__in_file")).alias("__offset"))
    )
    rank = F.row_number().over(Window.partitionBy(*chunk).orderBy(position))
    return (
        lines.withColumn("__rank", rank)
        .join(offsets, list(chunk))
        .withColumn("line_number", F.col("__offset") + F.col("__rank"))
        .drop("__rank", "__offset", "__chunk")
    )


def compare_lines(source_lines: DataFrame, target_lines: DataFrame) -> DataFrame:
    """Zip two tables of (line_number, line) by number and describe every pair.

    Columns: line_number, source, target (empty when missing), status, first_diff_pos, diff_count,
    char_diffs, source_len, target_len. Only differing pairs get a character difference.
    """
    s = source_lines.select(F.col("line_number").alias("_sn"), F.col("line").alias("_s"))
    t = target_lines.select(F.col("line_number").alias("_tn"), F.col("line").alias("_t"))
    paired = s.join(t, F.col("_sn") == F.col("_tn"), "full_outer")
    status = (
        F.when(F.col("_s").eqNullSafe(F.col("_t")), F.lit("MATCH"))
        .when(F.col("_s").isNull(), F.lit(MISSING_IN_SOURCE))
        .when(F.col("_t").isNull(), F.lit(MISSING_IN_TARGET))
        .otherwise(F.lit("MISMATCH"))
    )
    nothing = F.array().cast(CHAR_DIFF_TYPE)
    described = paired.select(
        F.coalesce("_sn", "_tn").cast("bigint").alias("line_number"),
        F.coalesce("_s", F.lit("")).alias("source"),
        F.coalesce("_t", F.lit("")).alias("target"),
        status.alias("status"),
        F.when(status == "MISMATCH", char_diff(F.col("_s"), F.col("_t")))
        .otherwise(nothing)
        .cast(CHAR_DIFF_TYPE)
        .alias("char_diffs"),
    )
    return described.select(
        "line_number",
        "source",
        "target",
        "status",
        F.get("char_diffs", F.lit(0)).getField("pos").alias("first_diff_pos"),
        F.size("char_diffs").alias("diff_count"),
        "char_diffs",
        F.length("source").alias("source_len"),
        F.length("target").alias("target_len"),
    )


def line_match_counts(comparison: DataFrame) -> DataFrame:
    """How many line pairs were compared, and how many match."""
    return comparison.agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("status") == "MATCH").alias("matching")
    )
