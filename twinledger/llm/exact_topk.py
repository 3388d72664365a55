"""Exact top-k inner products by reading sorted lists: aggregation without random access.

Candidates are dealt into shards and queries into blocks; each block meets each shard in one task. A shard keeps
one list per dimension, sorted by value. For a query, lists are read from the end that helps its sign,
deeper and deeper. What has been read of a candidate gives bounds of its score: for dimensions not yet
reached, at most the value at which reading stands, at least the smallest value of the list. Reading
stops when nothing unseen can reach the k-th best lower bound; candidates whose upper bound still
reaches it have their scores resolved, which is the first time that whole vectors are read. The best k of each shard then meet, and the best of these are the
answer, with nothing left out.

Components are floor(1024 * x), x as double, and scores are integers. A vector that is null, or
holds a null, NaN or infinite component, takes no part. Components beyond 2 ** 62 count as that, and scores
beyond 64 bits as the largest (smallest) such number. Vectors of different lengths are filled up with zeros, so a vector without components scores 0 with
all. Ties go to the smaller vec_id; a null vec_id is no query, and is as a candidate larger than
all others. Repeated rows are candidates each; a query id in several rows is a query once for each distinct
vector. A row is never its own candidate: candidates with the query's vec_id are left out. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.llm.common import written

SCALE, K, QUERY_STEP = 1024, 10, 100
#: Rows of a shard of candidates and of a block of queries: what one task holds at a time.
SHARD_ROWS, BLOCK_ROWS = 16_384, 512
#: Shares of the lists after which bounds are compared, and of the candidates that may be left by then.
DEPTHS, FEW = (1 / 32, 1 / 8, 1 / 4, 1 / 2, 1.0), 1 / 16
LARGEST = 2.0**62


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vector: array<long>, of the rows that take part."""

    def component(x: Column) -> Column:
        product = F.lit(float(scale)) * x.cast("double")
        return F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), product)))

    infinite = F.lit(float("inf"))
    usable = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite)
    )
    rows = embeddings.filter(F.col("embedding").isNotNull() & F.coalesce(usable, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", component).alias("vector"))


class SortedLists:
    """One shard of candidates, as a list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # per dimension, smallest first
        self.values = np.take_along_axis(vectors.T, self.order, axis=1).astype(np.float64)
        self.sizes = np.abs(vectors.astype(np.float64)).max(axis=0, initial=0.0)

    def best(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best candidates, ties to the smaller id, own_id left out."""
        n, dims = self.vectors.shape
        used = np.flatnonzero(query)
        if n <= 4 * k or not len(used):
            return self._resolved(query, np.arange(n), own_id, k)
        q = query[used].astype(np.float64)
        rising = q < 0  # read from the small end
        least = np.where(rising, self.values[used, -1], self.values[used, 0]) * q
        seen_sum, seen_least = np.zeros(n), np.zeros(n)
        read, alive = 0, None
        bound = -np.inf
        slack = 1e-12 * float(np.abs(q) @ self.sizes[used])  # of bounds, which are floating point
        for depth in DEPTHS:
            stop = max(read + 1, int(n * depth))
            parts = self._parts(used, rising, read, stop)
            who = np.concatenate([self.order[d, p] for d, p in zip(used, parts)])
            gain = np.concatenate([self.values[d, p] * w for d, p, w in zip(used, parts, q)])
            each = stop - read
            seen_sum += np.bincount(who, gain, n)
            seen_least += np.bincount(who, np.repeat(least, each), n)
            read = stop
            at = np.where(rising, stop - 1, n - stop)
            frontier = self.values[used, at] * q
            # A candidate's dimensions not reached hold at most the frontier, at least the list's least.
            everyone = np.concatenate([self.order[d, p] for d, p in zip(used, self._parts(used, rising, 0, stop))])
            upper = frontier.sum() + seen_sum - np.bincount(everyone, np.repeat(frontier, stop), n)
            lower = least.sum() + seen_sum - seen_least
            known = lower[self.ids != own_id]
            if len(known) >= k:
                bound = max(bound, float(np.partition(known, -k)[-k]))
            alive = np.flatnonzero(upper >= bound - slack)
            if frontier.sum() < bound - slack and len(alive) <= n * FEW:
                break
        return self._resolved(query, alive, own_id, k)

    def _parts(self, used, rising, begin: int, end: int) -> list[slice]:
        n = len(self.ids)
        return [slice(begin, end) if up else slice(n - end, n - begin) for up in rising]

    def _scores(self, query: np.ndarray, who: np.ndarray) -> np.ndarray:
        if float(np.abs(query.astype(np.float64)) @ self.sizes) < 2.0**62:
            return self.vectors[who] @ query
        whole = self.vectors[who].astype(object) @ query.astype(object)
        return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)

    def _resolved(self, query: np.ndarray, who: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        who = who[self.ids[who] != own_id]
        scores = self._scores(query, who)
        best = np.lexsort((self.ids[who], ~scores))[:k]
        return [(int(scores[i]), int(self.ids[who[i]])) for i in best]


#: Stands for a null id, behind all others.
_NO_ID = int(np.iinfo(np.int64).max)


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(
    spark: SparkSession, embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query."""
    vectors = written(spark, integer_vectors(embeddings).fillna(_NO_ID, "vec_id"))
    is_query = (F.col("vec_id") % query_step == 0) & (F.col("vec_id") != _NO_ID)
    total = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).head()
    shards = max(1, -(-total["n"] // SHARD_ROWS))
    blocks = max(1, -(-total["q"] // BLOCK_ROWS))
    spread = F.xxhash64("vec_id", "vector")
    each_block, each_shard = (F.sequence(F.lit(0), F.lit(n - 1)) for n in (blocks, shards))
    candidates = vectors.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(each_block)
    )
    queries = (
        vectors.filter(is_query)
        .distinct()
        .withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(each_shard))
    )

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and len(held):
            dims = max(held["vector"].map(len).max(), asked["vector"].map(len).max())
            lists = SortedLists(held["vec_id"].to_numpy(), _matrix(held["vector"], dims))
            wanted = _matrix(asked["vector"], dims)
            for own, vector, query in zip(asked["vec_id"].tolist(), asked["vector"], wanted):
                rows += [(own, vector, vec_id, score) for score, vec_id in lists.best(query, own, k)]
        return pd.DataFrame(rows, columns=["query_id", "vector", "vec_id", "score"], dtype=object)

    local = (
        queries.groupBy("block", "shard")
        .cogroup(candidates.groupBy("block", "shard"))
        .applyInPandas(meet, "query_id long, vector array<long>, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.nullif("vec_id", F.lit(_NO_ID)).alias("vec_id"), "score")
    )
