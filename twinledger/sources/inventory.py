"""What lies at given paths: sizes, times, compression, and totals over stored results."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions import fmt

FOUND = "path string, modificationTime timestamp, length bigint"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``; contents are not read. Nothing there gives no rows."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException:
        return spark.createDataFrame([], FOUND)
    return files.select("path", "modificationTime", "length")


def file_inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per requested path: where it is, whether it exists, its size, time and compression."""

    def described(path: str) -> DataFrame:
        found = list_files(spark, path).agg(
            F.sum("length").alias("size_bytes"),
            F.max("modificationTime").alias("updated"),
            (F.count(F.lit(1)) > 0).alias("exists"),
        )
        return found.select(F.lit(path).alias("original_path"), "size_bytes", "updated", "exists")

    found = reduce(DataFrame.unionByName, [described(p) for p in paths])
    path = F.col("original_path")
    return found.select(
        path,
        fmt.base_name(path).alias("filename"),
        fmt.storage_scheme(path).alias("scheme"),
        fmt.bucket_of(path).alias("bucket"),
        fmt.blob_of(path).alias("blob_path"),
        fmt.compression_type(path).alias("compression"),
        "exists",
        "size_bytes",
        fmt.format_bytes(F.col("size_bytes")).alias("size_human"),
        "updated",
    )


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files, total bytes, and the oldest and newest modification below ``path``."""
    return list_files(spark, path).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
        F.min("modificationTime").alias("oldest_mtime"),
        F.max("modificationTime").alias("newest_mtime"),
    )
