"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of each source are cut into equal-token blocks, and the blocks of the whole mix are seats:
each next block goes to the source with the highest quotient target / (2 * seats + 1). The same rule
then deals a source's quota to its shards by their sizes. Within a shard a quota of q blocks over n takes
each block q // n times, and q % n of them, spread evenly from a seeded start, once more. Documents lie in
a shard in seeded hash order, so the words that a document gives follow from its place alone, in one step
and without listing blocks.

Blocks have BLOCK_WORDS words whatever the sources. For a source of under MIN_BLOCKS blocks, whole blocks
would miss the target by too much: it is one shard, gets its target in words, and what is left after whole
copies is one run of words from a seeded start on, round the end: blocks in a row, the last one shorter.

Shards hold some 250,000 words, more only in sources of over four billion, so a source of any size is dealt out to many tasks; only sums by
source and by shard (at most ``MAX_SHARDS`` for each source) reach the driver, which needs the list of
sources anyway, since weights belong to them.

Size: number of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have 0 and are never taken. Sources
are taken in code point order, null last, with the weights repeating. Targets share 100% of all words by
weight, but stop at ``max_repeats`` times their source's size, the excess being shared again. Rows that
repeat doc_id and text are separate documents. An empty table gives no rows. Reruns over the same rows
agree, however the table is split. Other columns are carried along by ``mix`` (n_chars is set to the new
text's length) and are not read by the rest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.llm.common import WORD, columns_of, numbered, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Words in a block, and the blocks below which a source gives a run of words instead.
BLOCK_WORDS, MIN_BLOCKS = 512, 256
SHARD_WORDS, MAX_SHARDS = 250_000, 16_384
#: The plan of so many shards is broadcast: 80 bytes each.
BROADCAST_SHARDS = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: float) -> list[float]:
    """Words for each source: shares of all words by weight, none above max_repeats times its size."""
    limits, out, open_ = [max_repeats * n for n in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        if not weight:
            break
        shares = {i: rest * weights[i] / weight for i in open_}
        above = [i for i in open_ if shares[i] > limits[i]]
        for i in above or open_:
            out[i] = limits[i] if above else shares[i]
        open_ = open_.difference(above) if above else set()
        rest -= sum(limits[i] for i in above)
    return out


def apportion(shares: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Sainte-Laguë: each next seat goes to the highest shares[i] / (2 * seats[i] + 1).

    Ties go to the first. limits: seats that each can hold; the rest goes to the others. All seats but
    some are dealt at once, by a common divisor that cannot give anyone too many.
    """
    total, limits = float(sum(shares)), list(limits or [seats] * len(shares))
    held = [0] * len(shares)
    if total <= 0:
        return held
    sure = seats - len(shares)
    if sure > 0:
        divisor = total / sure
        held = [min(limits[i], max(0, math.ceil(x / divisor - 0.5) - 1)) for i, x in enumerate(shares)]
    left = seats - sum(held)
    queue = [(-x / (2 * held[i] + 1), i) for i, x in enumerate(shares) if x > 0 and held[i] < limits[i]]
    heapq.heapify(queue)
    while left > 0 and queue:
        _, i = heapq.heappop(queue)
        held[i] += 1
        left -= 1
        if held[i] < limits[i]:
            heapq.heappush(queue, (-shares[i] / (2 * held[i] + 1), i))
    return held


def _plan_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= BROADCAST_SHARDS else frame


def plan(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = 3,
    seed: int = 0,
    row: Column | None = None,
) -> DataFrame:
    """How much of each row is taken. row: the number of each row, if docs has one.

    _row, doc_id, size, source_size, target, taken, and the place of the document's words in its shard:
    start, block, blocks, base, more, phase, run (see ``_once_more``).
    """
    sized = written(
        spark,
        docs.select(
            (F.monotonically_increasing_id() if row is None else row).alias("_row"),
            "doc_id",
            "source",
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"),
        ),
    )
    sums = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    sources = sorted((s for s in sums if s is not None)) + [s for s in sums if s is None]
    sizes = [sums[s] for s in sources]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], max_repeats)
    small = [n < MIN_BLOCKS * BLOCK_WORDS for n in sizes]
    shared = [0.0 if is_small else aim for aim, is_small in zip(aims, small)]
    quotas = apportion(shared, round(sum(shared) / BLOCK_WORDS))
    by_source = _plan_table(
        spark,
        [
            (source, i, n, float(aim), 1 if small[i] else max(1, min(MAX_SHARDS, math.ceil(n / SHARD_WORDS))))
            for i, (source, n, aim) in enumerate(zip(sources, sizes, aims))
        ],
        "_source string, place int, source_size long, target double, shards int",
    )
    dealt = (
        sized.join(by_source, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.col("shards")).cast("int"))
        .drop("_source", "shards")
    )
    shard_sums = dealt.groupBy("place", "shard").agg(F.sum("size").alias("n")).orderBy("place", "shard").collect()
    by_place: dict[int, list] = {}
    for r in shard_sums:
        by_place.setdefault(r["place"], []).append((r["shard"], r["n"]))
    rows = []
    for place, shards in by_place.items():
        if small[place]:
            ((shard, n),) = shards
            rows.append((place, shard, 1, *_run(round(aims[place]), n, seed * 7919 + place * 104_729), True))
            continue
        counts = [max(1, (n + BLOCK_WORDS // 2) // BLOCK_WORDS) for _, n in shards]
        held = apportion([n for _, n in shards], quotas[place], [max_repeats * c for c in counts])
        for (shard, _), count, quota in zip(shards, counts, held):
            phase = (seed * 7919 + place * 104_729 + shard * 1_299_709) % count
            rows.append((place, shard, BLOCK_WORDS, count, quota // count, quota % count, phase, False))
    by_shard = _plan_table(
        spark,
        rows,
        "place int, shard int, block long, blocks long, base long, more long, phase long, run boolean",
    )
    order = Window.partitionBy("place", "shard").orderBy("key", "doc_id", "size", "_row")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("start", end - F.col("size")).join(by_shard, ["place", "shard"])
    return (
        placed.withColumn("extra", _once_more(F.col("start") + F.col("size")) - _once_more(F.col("start")))
        .withColumn("taken", F.col("base") * F.col("size") + F.col("extra"))
        .drop("key", "source", "place", "shard")
    )


def _run(quota: int, n: int, start: int) -> tuple[int, int, int, int]:
    """blocks, base, more and phase of a source that gives a run: its blocks are its words."""
    return (n, quota // n, quota % n, start * BLOCK_WORDS % n) if n else (1, 0, 0, 0)


def _once_more(words):
    """Of a shard's first ``words`` words, how many are taken once more.

    In a run these are ``more`` words from place ``phase`` on, round the shard's end. Else block j is taken when (j * more + phase) // blocks steps up from j to j + 1. The last block
    also holds what is left of the shard, less than half a block more, or is as much shorter.
    """
    def steps(j):
        return F.floor((j * F.col("more") + F.col("phase")) / F.col("blocks"))

    j = F.least(F.floor(words / F.col("block")), F.col("blocks") - 1)
    in_blocks = steps(j) * F.col("block") + (words - j * F.col("block")) * (steps(j + 1) - steps(j))
    end = F.col("phase") + F.col("more")
    none = F.lit(0).cast("long")
    in_run = F.greatest(none, F.least(words, end) - F.col("phase")) + F.greatest(
        none, F.least(words, end - F.col("blocks"))
    )
    return F.when(F.col("run"), in_run).otherwise(in_blocks)


def taken_once_more(
    start: int, size: int, block: int, blocks: int, more: int, phase: int, run: bool
) -> list[tuple[int, int]]:
    """Which words of a document (from, to) are taken once more, as few runs as there are."""
    found = []
    if run:
        whole = [(0, phase + more - blocks), (phase, min(blocks, phase + more))]
    else:
        first, last = (min(at // block, blocks - 1) for at in (start, start + size - 1))
        steps = [(j * more + phase) // blocks for j in range(first, last + 2)]
        whole = [
            (j * block, (j + 1) * block if j < blocks - 1 else start + size)
            for j, here, there in zip(range(first, last + 1), steps, steps[1:])
            if there > here
        ]
    for a, z in whole:
        a, z = max(a, start) - start, min(z, start + size) - start
        if a < z and found and found[-1][1] == a:
            found[-1] = (found[-1][0], z)
        elif a < z:
            found.append((a, z))
    return found


_PLACE = ("start", "size", "block", "blocks", "more", "phase", "run")


def _extra_text(text: Column, place: Column) -> Column:
    """The words of a text that are taken once more, each run of words as it stands."""
    import re

    word = re.compile(WORD)

    @F.pandas_udf("string")
    def cut(text: pd.Series, place: pd.DataFrame) -> pd.Series:
        out = []
        for t, *where in zip(text, *(place[name] for name in _PLACE)):
            if t is None:
                out.append(None)
                continue
            words = [m.span() for m in word.finditer(t)]
            out.append("\n".join(t[words[a][0] : words[z - 1][1]] for a, z in taken_once_more(*where)))
        return pd.Series(out, dtype=object)

    return cut(text, place)


def mix_report(
    spark: SparkSession, docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = 3, seed: int = 0
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    return plan(spark, docs, weights, max_repeats, seed).select("doc_id", "size", "source_size", "target", "taken")


def mix(
    spark: SparkSession, docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = 3, seed: int = 0
) -> DataFrame:
    """The mixed documents, with the columns of docs.

    A document comes whole as often as all its blocks are taken, and once more with the text of those
    blocks that are taken once more.
    """
    stored = numbered(spark, docs, "_llm_row")
    places = plan(spark, stored, weights, max_repeats, seed, F.col("_llm_row")).filter("taken > 0").select(
        F.col("_row").alias("_llm_row"),
        F.struct(*_PLACE, "base", "extra").alias("_llm_mix"),
    )
    rows = stored.join(places, "_llm_row")
    m = F.col("_llm_mix")
    part = m["extra"].between(1, m["size"] - 1)
    cut = _extra_text(F.when(part, F.col("text")), F.struct(*(m[name].alias(name) for name in _PLACE)))
    last = F.when(part, cut).when(m["extra"] > 0, F.col("text"))
    texts = F.concat(F.array_repeat("text", m["base"].cast("int")), F.when(last.isNull(), F.array().cast("array<string>")).otherwise(F.array(last)))
    rows = rows.withColumn("_llm_text", F.explode(texts))
    changed = {"text": F.col("_llm_text"), "n_chars": F.char_length("_llm_text").cast("long")}
    return rows.select(
        *(changed[name].alias(name) if name in changed else column for name, column in zip(docs.columns, columns_of(docs)))
    )
