"""Phrases whose words stand together more often than their parts would meet by chance, by language.

Texts are cut into pieces at punctuation and line ends, and pieces into words. Every run of up to ``longest`` words within
a piece is a phrase. Two passes find all that occur ``threshold`` times or more:

* The first keeps Misra-Gries summaries of phrase hashes, one for each slot of the hash space. A slot's capacity exceeds
  its mass (all phrase occurrences that hash into it, counted beforehand) divided by the threshold. Summaries merge by adding counters
  and then taking the first counter beyond the capacity off all of them, so together they take less than the threshold
  off any count, and every frequent phrase keeps a counter. Two phrases of one hash only make a counter larger.
* The second counts exactly, and only phrases whose hashes survived; a bitmap of fixed size tells most
  others apart before anything moves. All occurrences of a phrase that passes are counted, so the counts are exact, and
  those below the threshold go.

Counts are formed in each task before they move, so a phrase of which there are very many sends one row from a
task. No table of phrases reaches the driver; it gets the bitmap and one mass for each slot.

Null texts are empty, null languages are ``und``. Repeated rows count each time. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.llm import sketch
from twinledger.llm.common import ascii_lower, written

THRESHOLD = 10
LONGEST = 3
#: Occurrences that a slot should hold at most on average; a power of two.
SLOT_MASS = 2**20
FEWEST_SLOTS, MOST_SLOTS = 2**8, 2**20
#: Distinct phrases that a task gathers before it passes them on, and rows it merges at a time.
TASK_PHRASES = 2**19

ROWS_PER_BATCH = 2**16
#: Bytes of text that a task cuts into words at a time; a longer text is cut alone.
BATCH_BYTES = 2**19

#: Ends of pieces become full stops, A-Z lower case, tabs spaces; all else stays.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_CUT = bytes(b + 32 if 65 <= b <= 90 else 46 if b in _PIECE_ENDS else 32 if b == 9 else b for b in range(256))
#: The upper 48 bits of a hash are kept, which saves a quarter of what moves.
_HASH_BITS = np.uint64(0xFFFFFFFFFFFF0000)
_SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes with every bit spread over all others (wrapping on purpose)."""
    x = (x ^ (x >> np.uint64(30))) * _SPREAD[1]
    x = (x ^ (x >> np.uint64(27))) * _SPREAD[2]
    return x ^ (x >> np.uint64(31))


class Phrases:
    """The words of a batch, in order, with the phrases that begin at each of them."""

    def __init__(self, batch: pa.RecordBatch):
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        cut = [(t or b"").translate(_CUT).replace(b".", b" . ").split() for t in texts]
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)) + 1
        flat = np.empty(int(sizes.sum()), dtype=object)
        flat[:] = [word for words in cut for word in (*words, b".")]
        codes, self.words = pd.factorize(flat)
        langs = np.array(["und" if x is None else x for x in batch.column(1).to_pylist()], dtype=object)
        lang, self.langs = pd.factorize(langs)
        self.codes, self.lang = codes.astype(np.int64), np.repeat(lang.astype(np.int64), sizes)
        end = np.flatnonzero(self.words == b".")
        self.is_word = self.codes != (end[0] if len(end) else -1)
        self._word_hash = np.array([xxhash.xxh64_intdigest(w) for w in self.words], dtype=np.uint64)
        self._lang_hash = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs], dtype=np.uint64)

    def starts(self, n: int) -> np.ndarray:
        """Where a phrase of n words begins."""
        last = len(self.codes) - n + 1
        whole = np.ones(max(last, 0), dtype=bool)
        for k in range(n if last > 0 else 0):
            whole &= self.is_word[k : k + last]
        return np.flatnonzero(whole)

    def hashes(self, starts: np.ndarray, n: int) -> np.ndarray:
        found = self._lang_hash[self.lang[starts]] + np.uint64(n)
        for k in range(n):
            found = _mixed(found * _SPREAD[0] + self._word_hash[self.codes[starts + k]])
        return found & _HASH_BITS

    def identities(self, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the starts show a phrase first, and how often each phrase begins at one of them: exact."""
        key = self.lang[starts]
        for k in range(n):
            _, key = np.unique(key * len(self.words) + self.codes[starts + k], return_inverse=True)
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return starts[first], counts


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Phrases]:
    """Whole texts, a few megabytes at a time."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, side="right")))
            yield Phrases(batch.slice(start, end - start))
            start = end
        # What a batch took goes back to the system, since the executor's memory is shared with the JVM.
        pa.default_memory_pool().release_unused()


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order with the sum of their counts."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], starts) if len(starts) else counts
    return hashes[starts], sums


def slot_masses(docs: DataFrame, slots: int, longest: int = LONGEST) -> tuple[np.ndarray, DataFrame]:
    """How many phrase occurrences hash into each slot, and a table lang, n of words by language."""
    shift = np.uint64(64 - (slots.bit_length() - 1))

    def count(batches):
        masses, words = np.zeros(slots, dtype=np.int64), {}
        for phrases in _batches(batches):
            for n in range(1, longest + 1):
                slot = (phrases.hashes(phrases.starts(n), n) >> shift).astype(np.int64)
                masses += np.bincount(slot, minlength=slots)
            for code, total in enumerate(np.bincount(phrases.lang[phrases.is_word], minlength=len(phrases.langs))):
                words[phrases.langs[code]] = words.get(phrases.langs[code], 0) + int(total)
        full = np.flatnonzero(masses)
        names = [None] * len(full) + list(words)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*full.tolist(), *[-1] * len(words)], pa.int64()),
                pa.array(names, pa.string()),
                pa.array([*masses[full].tolist(), *words.values()], pa.int64()),
            ],
            names=["slot", "lang", "n"],
        )

    found = docs.mapInArrow(count, "slot long, lang string, n long").groupBy("slot", "lang").agg(F.sum("n").alias("n"))
    found = written(docs.sparkSession, found)
    masses = np.zeros(slots, dtype=np.int64)
    for row in found.filter(F.col("slot") >= 0).select("slot", "n").collect():
        masses[row["slot"]] = row["n"]
    return masses, found.filter(F.col("slot") < 0).select("lang", "n")


def merged(summary, other, capacity: int):
    """Two Misra-Gries summaries (hashes in order, counters, what was taken off) as one within the capacity."""
    hashes, counters = _summed(np.concatenate((summary[0], other[0])), np.concatenate((summary[1], other[1])))
    taken = summary[2] + other[2]
    if len(counters) > capacity:
        off = int(np.partition(counters, len(counters) - capacity - 1)[len(counters) - capacity - 1])
        kept = counters > off
        hashes, counters, taken = hashes[kept], counters[kept] - off, taken + off
    return hashes, counters, taken


PACKED = "slot long, once binary, often binary, counts binary"


def _packed(hashes: np.ndarray) -> bytes:
    """Six bytes for each hash; the other two are zero."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(data: pa.BinaryScalar) -> np.ndarray:
    packed = np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(-1, 6)
    found = np.zeros((len(packed), 8), dtype=np.uint8)
    found[:, 2:] = packed
    return found.reshape(-1).view("<u8")


def _packed_rows(hashes: np.ndarray, counts: np.ndarray, shift: np.uint64) -> pa.RecordBatch:
    """Sorted hashes as one row for each slot; those counted once need no count."""
    slot = (hashes >> shift).astype(np.int64)
    edges = np.flatnonzero(np.diff(slot, prepend=-1, append=-1))
    columns: list[list] = [[], [], [], []]
    for start, end in zip(edges[:-1], edges[1:]):
        h, n = hashes[start:end], counts[start:end]
        more = n > 1
        for column, value in zip(columns, (int(slot[start]), _packed(h[~more]), _packed(h[more]), n[more].astype("<i8").tobytes())):
            column.append(value)
    arrays = [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]]
    return pa.RecordBatch.from_arrays(arrays, names=["slot", "once", "often", "counts"])


def frequent_hashes(
    docs: DataFrame, masses: np.ndarray, threshold: int = THRESHOLD, longest: int = LONGEST
) -> DataFrame:
    """hash: those of all phrases that occur ``threshold`` times or more, and some others."""
    slots = len(masses)
    shift = np.uint64(64 - (slots.bit_length() - 1))
    capacities = masses // threshold + 1
    nothing = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def counted(batches):
        waiting, size = [nothing], 0
        for phrases in _batches(batches):
            found = np.concatenate([phrases.hashes(phrases.starts(n), n) for n in range(1, longest + 1)])
            waiting.append(_summed(found, np.ones(len(found), dtype=np.int64)))
            size += len(waiting[-1][0])
            if size > TASK_PHRASES:
                held = _summed(*(np.concatenate([x[i] for x in waiting]) for i in (0, 1)))
                waiting, size = [held], len(held[0])
                if size > TASK_PHRASES // 2:
                    yield _packed_rows(*held, shift)
                    waiting, size = [nothing], 0
        yield _packed_rows(*_summed(*(np.concatenate([x[i] for x in waiting]) for i in (0, 1))), shift)

    def summarised(batches):
        summaries: dict[int, tuple] = {}
        waiting: dict[int, list] = {}
        size = 0

        def absorb():
            for slot, parts in waiting.items():
                hashes, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                summaries[slot] = merged(summaries.get(slot, (*nothing, 0)), (hashes, counts, 0), int(capacities[slot]))
            waiting.clear()

        for batch in batches:
            for slot, once, often, counts in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in (1, 2, 3)]):
                single, several = _unpacked(once), _unpacked(often)
                hashes = np.concatenate((single, several))
                n = np.concatenate((np.ones(len(single), dtype=np.int64), np.frombuffer(counts.as_buffer(), "<i8")))
                waiting.setdefault(slot, []).append((hashes, n))
                size += len(hashes)
                if size > TASK_PHRASES:
                    absorb()
                    size = 0
        absorb()
        for hashes, counters, taken in summaries.values():
            found = hashes[counters + taken >= threshold].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["hash"])

    return docs.mapInArrow(counted, PACKED).repartition("slot").mapInArrow(summarised, "hash long")


def exact_counts(
    docs: DataFrame, bitmap: np.ndarray, threshold: int = THRESHOLD, longest: int = LONGEST
) -> DataFrame:
    """lang, words (a number), phrase, a: every phrase of ``threshold`` occurrences or more."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def counted(batches):
        held: dict[tuple, int] = {}

        def rows():
            keys = list(held)
            columns = [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([k[2] for k in keys], pa.binary()).cast(pa.string()),
                pa.array(list(held.values()), pa.int64()),
            ]
            return pa.Table.from_arrays(columns, names=["lang", "words", "phrase", "a"]).to_batches(ROWS_PER_BATCH)

        for phrases in _batches(batches):
            for n in range(1, longest + 1):
                starts = phrases.starts(n)
                starts = starts[sketch.may_hold(shared.value, phrases.hashes(starts, n))]
                first, counts = phrases.identities(starts, n)
                shown = [phrases.words[phrases.codes[first + k]] for k in range(n)]
                texts = shown[0] if n == 1 else [b" ".join(x) for x in zip(*shown)]
                for lang, text, total in zip(phrases.lang[first].tolist(), texts, counts.tolist()):
                    key = phrases.langs[lang], n, text
                    held[key] = held.get(key, 0) + total
            if len(held) > TASK_PHRASES // 4:
                yield from rows()
                held.clear()
        yield from rows()

    found = docs.mapInArrow(counted, "lang string, words long, phrase string, a long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= threshold)


def _slots(docs: DataFrame, longest: int) -> int:
    """Slots for the largest mass that texts of this many bytes can have: a word and a space take two."""
    size = docs.agg(F.sum(F.octet_length("text") + 1)).head()[0] or 0
    wanted = max(1, size * longest // 2 // SLOT_MASS)
    return min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (wanted - 1).bit_length()))


def frequent_phrases(
    spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, words, phrase, a) of all frequent phrases of one word and more, and (lang, n) of all words."""
    texts = docs.select("text", "lang")
    masses, totals = slot_masses(texts, _slots(texts, longest), longest)
    # Written between, so that a task never holds a Python worker for the summaries and another for the bitmap.
    hashes = written(spark, frequent_hashes(texts, masses, threshold, longest))
    bitmap = sketch.bitmap_of(hashes)
    return written(spark, exact_counts(texts, bitmap, threshold, longest)), totals


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact for counts below 10^16."""
    whole = "decimal(16,0)"
    top = (a.cast(whole) * a.cast(whole) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, left.cast(whole) * right.cast(whole))


def collocations(
    spark: SparkSession,
    docs: DataFrame,
    *,
    threshold: int = THRESHOLD,
    longest: int = LONGEST,
    covered_percent: int = 50,
    best: int = 2000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases of two words and more.

    A phrase's score is that of its worst cut into two parts. Phrases go that lie within a longer
    one with at least ``covered_percent`` of their occurrences: if any does, one of a single word more does too.
    """
    phrases, totals = frequent_phrases(spark, docs, threshold, longest)
    candidates = phrases.filter(F.col("words") >= 2).withColumn("_w", F.split("phrase", " "))
    part = lambda start, length: F.array_join(F.slice("_w", start, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1))).select(
        "lang",
        "phrase",
        "words",
        "a",
        "k",
        part(F.lit(1), F.col("k")).alias("_left"),
        part(F.col("k") + 1, F.col("words").cast("int") - F.col("k")).alias("_right"),
    )
    sides = [
        phrases.select(F.col("lang"), F.col("phrase").alias(side), F.col("a").alias(count))
        for side, count in (("_left", "l"), ("_right", "r"))
    ]
    scored = cuts.join(sides[0], ["lang", "_left"]).join(sides[1], ["lang", "_right"])
    worst = scored.groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("_cut")
    )
    longer = candidates.filter(F.col("words") >= 3)
    length = F.col("words").cast("int") - 1
    inner = longer.select(
        "lang", F.explode(F.array(part(F.lit(1), length), part(F.lit(2), length))).alias("phrase"), F.col("a").alias("_longer")
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    covered = F.coalesce(100 * F.col("_longer") >= covered_percent * F.col("a"), F.lit(False))
    kept = worst.join(inner, ["lang", "phrase"], "left").filter(~covered).select("lang", "phrase", "a", "_cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    # One row for each language: what follows the rank is small, and languages are as many as the groups ranked.
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
