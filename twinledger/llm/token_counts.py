"""Token counts: an exact histogram of encoded lengths answers every question about context limits.

Documents are encoded once and only their lengths are kept: one row per length, with the number of
documents that have it. Suffix sums over that histogram then give, for every limit, how many documents
and tokens lie above it and how many tokens remain when longer documents are cut there. The histogram
is pre-aggregated before it moves, so copies and hot sources cost nothing, and its size depends on the
longest document alone.

Null and empty texts have length 0. Repeated rows count each time; an empty table gives no rows. No
other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.llm import tokens
from twinledger.llm.common import written

#: Lengths summed by one task when suffix sums are formed.
LENGTHS_PER_GROUP = 4096


def encoded_length(text, tokenizer: str | None = None):
    """Column: number of tokens of each whole text."""
    path = tokenizer or tokens.default_path()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(tokens.encode(path, text)) for text in batch], dtype="int64")

    return count(text)


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """n_tokens, documents: how many documents have each length."""
    return docs.select(encoded_length(F.col("text"), tokenizer).alias("n_tokens")).groupBy("n_tokens").agg(
        F.count(F.lit(1)).alias("documents")
    )


def context_report(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``context_table`` of docs. The histogram is stored first, since two steps read it and texts are encoded once."""
    return context_table(written(spark, length_histogram(docs, tokenizer)))


def context_table(histogram: DataFrame) -> DataFrame:
    """For every length as a context limit: what fits, what does not, and what truncation leaves.

    n_tokens, documents, documents_up_to, tokens_up_to (both at most n_tokens long), documents_over,
    tokens_over (both longer), truncated_tokens (all documents, each cut after n_tokens), share_up_to
    (of documents: the quantile of n_tokens).

    Sums run within groups of neighbouring lengths and then over the groups' totals, so no task holds
    the whole histogram.
    """
    by_group = histogram.withColumn("part", F.floor(F.col("n_tokens") / LENGTHS_PER_GROUP))
    totals = by_group.groupBy("part").agg(
        F.sum("documents").alias("part_documents"),
        F.sum(F.col("documents") * F.col("n_tokens")).alias("part_tokens"),
    )
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = totals.select(
        "part",
        F.coalesce(F.sum("part_documents").over(after), F.lit(0)).alias("later_documents"),
        F.coalesce(F.sum("part_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("part_documents").over(everything).alias("all_documents"),
        F.sum("part_tokens").over(everything).alias("all_tokens"),
    )
    above = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("n_tokens")
    return (
        by_group.join(later, "part")
        .withColumn(
            "documents_over", F.col("later_documents") + F.coalesce(F.sum("documents").over(above), F.lit(0))
        )
        .withColumn(
            "tokens_over",
            F.col("later_tokens") + F.coalesce(F.sum(F.col("documents") * n).over(above), F.lit(0)),
        )
        .select(
            "n_tokens",
            "documents",
            (F.col("all_documents") - F.col("documents_over")).alias("documents_up_to"),
            (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_up_to"),
            "documents_over",
            "tokens_over",
            (F.col("all_tokens") - F.col("tokens_over") + n * F.col("documents_over")).alias("truncated_tokens"),
            ((F.col("all_documents") - F.col("documents_over")) / F.col("all_documents")).alias("share_up_to"),
        )
    )
