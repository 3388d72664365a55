"""Questions about keys alone. Only key columns are read, and one shuffle answers both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.functions.names import key_names, ref, with_clean_names
from twinledger.operators.align import N_SOURCE, N_TARGET, align, has_repeats


def key_counts(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """Rows per key; null key parts form a key of their own."""
    names = key_names(keys)
    return with_clean_names(df).groupBy(*[ref(k) for k in names]).agg(F.count(F.lit(1)).alias("row_count"))


def key_profile(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """One row: rows, distinct keys, keys that repeat, surplus rows, and the most copies of a key."""
    rows = F.col("row_count")
    return key_counts(df, keys).agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(rows > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(rows - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.max(rows), F.lit(0)).alias("max_copies"),
    )


def duplicate_keys(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows."""
    return key_counts(df, keys).filter(F.col("row_count") > 1)


def dedup_rows(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """One row per key: the smallest by all other columns in order, nulls first.

    The same survivor as row number 1 over (partition by key order by the rest), but as an
    aggregate that shrinks each key before the shuffle, so a hot key needs no sort in one task. The keys
    alone are looked at first: if none repeats, the rows are returned as they are.
    """
    df = with_clean_names(df)
    names = key_names(keys)
    rest = [c for c in df.columns if c not in names]
    if not rest:
        return df.distinct()
    if not has_repeats(names, df):
        return df
    record = F.struct(*[ref(c) for c in rest])
    kept = df.groupBy(*[ref(k) for k in names]).agg(F.min(record).alias("_kept"))
    return kept.select(
        *[(ref(c) if c in names else F.col("_kept").getField(c)).alias(c) for c in df.columns]
    )


def _one_sided(source: DataFrame, target: DataFrame, keys: str | list[str], absent: str) -> DataFrame:
    aligned = align(source, target, keys, keys_only=True)
    return aligned.frame.filter(F.col(absent) == 0).select(*[ref(k) for k in aligned.keys])


def missing_in_source(source: DataFrame, target: DataFrame, keys: str | list[str]) -> DataFrame:
    """Distinct target keys that the source lacks (EXCEPT, nulls equal)."""
    return _one_sided(source, target, keys, N_SOURCE)


def missing_in_target(source: DataFrame, target: DataFrame, keys: str | list[str]) -> DataFrame:
    """Distinct source keys that the target lacks (EXCEPT, nulls equal)."""
    return _one_sided(source, target, keys, N_TARGET)
