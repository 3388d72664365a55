"""Exact dedup by content-defined chunk recipes, with built-in functions only.

A text is cut where its own content says so (after a sentence or line end, 512 to 8,192 characters
apart), so equal passages give equal chunks. A text's recipe is the ordered list of its chunks'
identifiers, some four thousandths of its size; texts are equal when their recipes are. Only recipes
are compared: whole documents do not move.

Identifiers are 64-bit hashes that have been *verified*. All distinct chunks are brought together once
(repeats are dropped before the shuffle), and hashes that stand for more than one chunk are found. Each
chunk of such a hash gets a number within it, which then belongs to the recipes that hold it. So recipes
are equal exactly when the normalised texts are, whatever the hash does.

Normalised: A-Z in lower case, nothing else. Null counts as empty; empty texts are equal to each other.
The row with the largest doc_id stays; a null doc_id is smaller than all others. Of rows that repeat
doc_id and text, one stays in ``drop_copies``; in the report they come as often as they are there. Other
columns are carried along by ``drop_copies`` and are not read by the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm.common import ascii_lower, columns_of, numbered, written

#: 512 to 8,192 characters up to a sentence or line end; what is left, or has none, in 8,192.
CHUNK = r"(?s).{512,8192}?(?<=[\n.!?])|.{1,8192}"


def _chunked(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of more, doc_id, _text (normalised) and its _chunks."""
    return docs.select(*more, "doc_id", ascii_lower(F.col("text")).alias("_text")).withColumn(
        "_chunks", F.regexp_extract_all("_text", F.lit(CHUNK), F.lit(0))
    )


def _shared_hashes(chunked: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    """id: the hashes that stand for more than one chunk."""
    distinct = chunked.select(F.explode("_chunks").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)))
    return (
        distinct.select(hash_of(F.col("chunk")).alias("id"))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("chunks"))
        .filter("chunks > 1")
        .select("id")
    )


def recipes(
    spark: SparkSession, rows: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """_row, doc_id, text_sha256, recipe of rows numbered as _llm_row: equal recipes, and only they, are equal texts.

    A recipe is the number of chunks, their identifiers in order, and then place and number of each
    chunk that shares its hash with another.
    """
    chunked = _chunked(rows, F.col("_llm_row").alias("_row"))
    plain = written(
        spark,
        chunked.select(
            "_row",
            "doc_id",
            F.sha2("_text", 256).alias("text_sha256"),
            F.concat(
                F.array(F.size("_chunks").cast("long")), F.transform("_chunks", lambda c: hash_of(c).cast("long"))
            ).alias("recipe"),
        ),
    )
    shared = written(spark, _shared_hashes(chunked, hash_of))
    if shared.isEmpty():
        return plain
    # Some hash stands for several chunks: number these, and add the numbers to the recipes.
    places = chunked.select("_row", F.posexplode("_chunks").alias("place", "chunk")).withColumn(
        "id", hash_of(F.col("chunk"))
    )
    places = places.join(shared, "id", "left_semi")
    variants = written(
        spark, places.groupBy("id").agg(F.array_sort(F.collect_set("chunk")).alias("variants"))
    )
    number = F.array_position("variants", F.col("chunk"))
    numbers = (
        places.join(variants, "id")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.array(F.col("place").cast("long"), number))).alias("numbers"))
        .select("_row", F.flatten("numbers").alias("numbers"))
    )
    whole = F.concat("recipe", F.coalesce("numbers", F.array().cast("array<bigint>")))
    return plain.join(numbers, "_row", "left").withColumn("recipe", whole).drop("numbers")


def copies(
    spark: SparkSession, docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """_row, doc_id, keep_id, keep_row, group_size, text_sha256, for every row.

    Groups are counted before they move and come back through a join of slim rows that Spark can
    split, so a group of any size is no burden to one task.
    """
    return _copies(spark, numbered(spark, docs.select("doc_id", "text"), "_llm_row"), hash_of)


def _copies(spark: SparkSession, numbered_docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    rows = recipes(spark, numbered_docs, hash_of)
    groups = written(
        spark,
        rows.groupBy("recipe").agg(
            F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("_row", "doc_id"), F.max("_row")).alias("keep_row"),
            F.count(F.lit(1)).alias("group_size"),
        ),
    )
    return rows.join(groups, "recipe").drop("recipe")


def copy_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return copies(spark, docs).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, one row of each group of equal texts, all columns as they were."""
    rows = numbered(spark, docs, "_llm_row")
    dropped = _copies(spark, rows).filter(F.col("_row") != F.col("keep_row")).select(F.col("_row").alias("_llm_row"))
    return rows.join(dropped, "_llm_row", "left_anti").select(*columns_of(docs))
