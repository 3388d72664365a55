"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.plans.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(spark: SparkSession, df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, written below the shared checkpoint folder and read again.

    This cuts the lineage, so that a lost executor costs no more than the tasks that it held, and
    it fixes values such as row numbers once and for all.
    """
    path = scratch_dir(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def numbered(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, written with its rows.

    Numbers made anew would differ: they follow the file splits, which follow the cores that are
    registered when a query is planned. So all that uses them must read this one table.
    """
    return written(spark, df.withColumn(name, F.monotonically_increasing_id()), "zstd")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df by name, whatever characters the names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]
