"""Importance resampling: draw the documents that look most like a target collection.

Every run of words is a feature, hashed to a bucket by CRC-32. A bucket's gain is the logarithm of how much
more often the target's features fall into it than those of the documents; a document's weight is the mean gain of
its features. Gumbel noise, seeded by the document's id, turns the highest scores into a sample without replacement
in which a document's chance follows its weight.

Checksums are made many at a time. The distinct features of a batch are grouped by length; those of one length are
a two-dimensional array of bytes, whose checksums advance together column by column through the table of
the CRC. The buckets are then scattered back to where the features stand. Texts are read and hashed once:
each document's buckets are stored as packed numbers, from which counts and weights follow.

Counts are summed in each task before they move. What reaches the driver is one count per bucket. Ranks
come from a histogram of scores, which are whole numbers of bounded range, and from windows over the documents of
one score; so no task sorts them all, and only drawn documents move.

Null texts have no words, and score their noise alone. Null ids count as empty ones. Repeated rows are documents of their
own; with the same id they get the same noise, and they are ranked in any order, as they are alike.
An empty table gives no rows; without target features all gains follow from the smoothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.llm.common import columns_of, numbered, written

BUCKETS = 10_000
#: Fixed value: the polynomial of the CRC that zip and PNG use, lowest bit first.
CRC_POLYNOMIAL = 0xEDB88320
#: Whole scores stay within this: gains within 1000 ln(2^63) each way, noise within 1000 ln(2^33).
SCORE_RANGE = 2**17
SCORES_PER_GROUP = 1024

#: Bytes that part words become spaces and A-Z lower case; bytes of other scripts stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def crc32_of(values: list[bytes]) -> np.ndarray:
    """CRC-32 of each value: one matrix of bytes for each length, all its rows advanced column by column."""
    table = _crc_table()
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    found = np.zeros(len(values), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for start, end in zip(edges[:-1], edges[1:]):
        rows = order[start:end]
        width = int(lengths[rows[0]])
        matrix = np.frombuffer(b"".join([values[i] for i in rows]), dtype=np.uint8).reshape(len(rows), width)
        crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
        for column in range(width):
            crc = table[(crc ^ matrix[:, column]) & 0xFF] ^ (crc >> 8)
        found[rows] = ~crc
    return found


def _features(words: list[bytes], shortest: int, longest: int) -> list[bytes]:
    found = []
    for n in range(shortest, longest + 1):
        found += words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return found


def _buckets(texts: list[bytes | None], shortest: int, longest: int, buckets: int):
    """Per text its number of words and the bucket of each feature, with one checksum per distinct feature."""
    words = [words_of(text) if text else [] for text in texts]
    features = [_features(w, shortest, longest) for w in words]
    sizes = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [x for f in features for x in f]
    place, distinct = pd.factorize(flat)
    bucket = (crc32_of(list(distinct)) % buckets).astype("<u4")
    ends = np.cumsum(sizes)
    return [len(w) for w in words], np.split(bucket[place], ends[:-1]) if len(texts) else []


def bucket_table(docs: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The columns of docs but text, with n_words, and features: the bucket of each as four bytes."""
    kept = [c for c in docs.columns if c != "text"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            counts, found = _buckets(texts, shortest, longest, buckets)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(counts, pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "features"])

    schema = docs.select(*[c for c, n in zip(columns_of(docs), docs.columns) if n != "text"])
    schema = schema.select(*columns_of(schema), F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("features")).schema
    columns = [c for c, n in zip(columns_of(docs), docs.columns) if n != "text"]
    return docs.select(*columns, F.col("text")).mapInArrow(packed, schema)


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket. Each task sends one row per bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for features in batch.column(0).to_pylist():
                sums += np.bincount(np.frombuffer(features, "<u4"), minlength=buckets)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["bucket", "n"])

    rows = table.select("features").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.collect():
        counts[bucket] = n
    return counts


def gains_of(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bucket, 1000 times the logarithm of the smoothed target share over the documents' share."""
    all_target, all_source, buckets = float(target.sum()), float(source.sum()), len(source)
    share = (target + 1.0) * (all_source + buckets) / ((source + 1.0) * (all_target + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def _weights(features: Column, gains: np.ndarray) -> Column:
    """Column: floored mean gain of each document's features."""

    @F.pandas_udf("long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = (np.frombuffer(f, "<u4") for f in batch)
            yield pd.Series([int(gains[f].sum()) // len(f) if len(f) else 0 for f in found], dtype="int64")

    return weigh(features)


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate, rounded down, from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform)))


def scored(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    *,
    id_column: str = "doc_id",
    seed: int = 2024,
    shortest: int = 1,
    longest: int = 1,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The columns of docs but text, with n_words, n_features, weight and score; written once.

    Both tables need a text column. Columns of docs with these names are replaced.
    """
    made = ("n_words", "features", "n_features", "weight", "score")
    docs = docs.select(*[c for c, n in zip(columns_of(docs), docs.columns) if n not in made])
    table = written(spark, bucket_table(docs, shortest, longest, buckets), "zstd")
    gains = gains_of(
        bucket_counts(bucket_table(target.select("text"), shortest, longest, buckets), buckets), bucket_counts(table, buckets)
    )
    weighed = table.withColumn("n_features", (F.octet_length("features") / 4).cast("long"))
    weighed = weighed.withColumn("weight", _weights(F.col("features"), gains)).drop("features")
    return written(spark, weighed.withColumn("score", F.col("weight") + noise(F.col(id_column), seed)))


def ranked(table: DataFrame, drawn: Column, *, id_column: str = "doc_id", min_words: int = 20) -> DataFrame:
    """``table`` with rank: 1, 2, 3... for the highest scores, null for all else.

    ``drawn`` gives how many of the documents of at least ``min_words`` words are drawn, as a
    function of their number, the column ``candidates``.
    """
    names = table.columns
    fit = F.col("n_words") >= min_words
    histogram = table.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("_here"))
    histogram = histogram.withColumn("_part", F.floor(F.col("score") / SCORES_PER_GROUP))
    parts = histogram.groupBy("_part").agg(F.sum("_here").alias("_n"))
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"),
        F.sum("_n").over(everything).alias("candidates"),
    )
    higher = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = histogram.join(parts, "_part").select(
        F.col("score").alias("_score"),
        (F.col("_above") + F.coalesce(F.sum("_here").over(higher), F.lit(0))).alias("_before"),
        drawn.alias("_drawn"),
    )
    # At most one row for each whole score in SCORE_RANGE each way, so the join may broadcast it.
    before = F.broadcast(before.filter(F.col("_before") < F.col("_drawn")))
    joined = table.join(before, fit & (F.col("score") == F.col("_score")), "left")
    alike = Window.partitionBy("score").orderBy(F.col(f"`{id_column}`").asc_nulls_last(), "n_features", "weight")
    chosen = joined.filter(F.col("_before").isNotNull()).withColumn("rank", F.col("_before") + F.row_number().over(alike))
    chosen = chosen.withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")))
    others = joined.filter(F.col("_before").isNull()).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("`" + n.replace("`", "``") + "`") for n in names if n != "rank"]
    return chosen.select(*columns, "rank").unionByName(others.select(*columns, "rank"))


def resample(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    drawn: Column,
    *,
    id_column: str = "doc_id",
    min_words: int = 20,
    **options,
) -> DataFrame:
    """The drawn rows of docs, whole and with all their columns."""
    rows = numbered(spark, docs, "_row")
    number = F.col("_row")
    slim = rows.select(number, F.col(f"`{id_column}`").alias("_id"), "text")
    table = scored(spark, slim, target, id_column="_id", **options)
    kept = ranked(table, drawn, id_column="_id", min_words=min_words).filter(F.col("rank").isNotNull()).select("_row")
    return rows.join(kept, "_row", "left_semi").select(*columns_of(docs))


def resample_report(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``percent`` of the candidates are drawn."""
    table = scored(spark, docs.select("doc_id", "text"), target)
    share = F.floor(F.lit(percent) * F.col("candidates") / F.lit(100)).cast("long")
    return ranked(table, share).select("doc_id", "n_features", "weight", "score", "rank")
