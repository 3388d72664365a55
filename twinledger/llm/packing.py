"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``capacity`` tokens. How many pieces have each length is all
that best-fit needs: lengths are placed in falling order, each into the fullest sequences that still have
room, and sequences that look alike are handled together as one range of numbers. The histogram has at
most ``capacity`` entries and the plan at most some 45 ranges for each of them, whatever the size of the
corpus. Pieces then take the planned slots by their rank within their length. Ranks are counted while
pieces are made and raised by the counts of the partitions before, so no length is gathered in one task.

A document is its ids and then one end id; a null or empty text is the end id alone. Only documents longer
than the capacity are cut; their first piece takes the remainder. Repeated rows are packed each time; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.llm import tokens
from twinledger.llm.common import written

CAPACITY, END_ID = 1024, 2


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n tokens; the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(at, at + capacity) for at in range(first, n, capacity)]


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, place, and ids if asked for.

    place: number of pieces of the same length before this one in its partition, part. Write the result
    before use: part and place hold for one run.
    """
    path = tokenizer or tokens.default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
    if not with_ids:
        names.pop()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*tokens.encode(path, text), end_id], "<u4")
                for piece, (start, end) in enumerate(cuts(len(ids), capacity)):
                    crc, n = zlib.crc32(ids[start:end].tobytes()), end - start
                    row = (doc_id, piece, start, n, crc, part, seen[n], ids[start:end])
                    rows.append(row[: len(names)])
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=names, dtype=object)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, place long"
    # Ids of documents may be null, which numbers in pandas cannot be.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(cut, schema.replace(f"doc_id {id_type}", "doc_id string") + ", ids array<long>" * with_ids)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for every length: (length, rank_from, rank_to, sequence, per_sequence, offset).

    Pieces of that length with rank_from <= rank < rank_to lie per_sequence each in the sequences from
    that number on, side by side from offset. Best fit with falling lengths: a piece goes to the sequence
    with the least room that can hold it, and opens a new one if none can.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
    plan, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]

        def fill(first: int, count: int, room: int) -> int:
            """Fill up to count like sequences; returns how many were used."""
            nonlocal rank, left
            per = room // length
            whole = min(count, left // per)
            parts = [(first, whole, per)] if whole else []
            used = whole
            if left - whole * per and whole < count:
                parts.append((first + whole, 1, min(per, left - whole * per)))
                used += 1
            for at, n, each in parts:
                plan.append((length, rank, rank + n * each, at, each, capacity - room))
                rank += n * each
                left -= n * each
                open_[room - each * length].append((at, n))
            return used

        for room in [r for r in sorted(open_) if r >= length]:
            groups = open_.pop(room)
            while groups and left:
                first, count = groups.pop()
                used = fill(first, count, room)
                if used < count:
                    groups.append((first + used, count - used))
            open_[room] = groups + open_.get(room, [])
            if not left:
                break
        if left:
            count = -(-left // (capacity // length))
            fill(sequences, count, capacity)
            sequences += count
    return plan


def pack(
    spark: SparkSession,
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids)."""
    made = written(spark, pieces(docs, capacity, end_id, tokenizer, with_ids))
    counts = written(spark, made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        best_fit(histogram, capacity),
        "length long, rank_from long, rank_to long, sequence long, each long, at long",
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    raised = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = made.join(raised, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    # The plan is bounded by the capacity, not by the corpus.
    placed = ranked.join(
        F.broadcast(slots),
        (ranked["length"] == slots["length"])
        & (ranked["rank"] >= slots["rank_from"])
        & (ranked["rank"] < slots["rank_to"]),
    ).drop(slots["length"])
    within = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(within / F.col("each"))).alias("sequence_id"),
        (F.col("at") + (within % F.col("each")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
