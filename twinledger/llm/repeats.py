"""Long repeats across and within documents, found by sorting aligned strings column by column.

A byte goes if a string of ``length`` bytes that covers it starts somewhere else too. Equal strings share their
*anchor*: of all runs of ANCHOR bytes in them the one of least hash, the first of several. So each document is cut into
overlapping strings, one for each stretch of window starts with the same anchor. Only windows that may have an
equal take part: those in which the longer anchors of all strings of half the length occur more than once. Their strings are dealt by anchor and laid over one another at it.

There the collection is sorted one column at a time: each round inserts one symbol per string, moves the strings into
the order of the symbols read so far, last one first, and updates the common length of neighbours: one more
where the symbols agree, the least of the lengths between two that become neighbours. This is the Burrows-Wheeler
transform of aligned strings; its columns are read once, in sequence, and only the order and the common lengths are
kept between rounds. A window is repeated where its common length with a neighbour reaches ``length``. (The plain transform
of unaligned documents must be read whole once per symbol of the longest; see the README.)

Strings that are equal all over become one with a count before they are dealt, so groups of copies cost one string
from a task. An anchor with more than HOT_STRINGS strings, such as a common passage in many surroundings, is not
gathered: its windows are counted by their 128-bit digests, which any number of tasks can do. No text, anchor or string
reaches the driver; it gets a bitmap of fixed size.

Null texts are empty. Repeated rows are documents of their own. Texts shorter than ``length`` stay whole. What is kept may be
cut within a character, so it is binary. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm import sketch
from twinledger.llm.common import columns_of, numbered, written

LENGTH, ANCHOR = 400, 64
INNER_PERCENT = 32
#: Bytes that are searched for anchors at a time, as a power of two; longer texts are searched in parts.
BUFFER_BITS = 20
#: Bytes of distinct strings that a task holds back to send each but once, and that are sorted at a time.
HELD_BYTES, SORTED_BYTES = 2**24, 2**23
#: Strings of one anchor that one task may sort.
HOT_STRINGS = 20_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ENDED = 256


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64, for every place of a buffer."""
    size = (1 << BUFFER_BITS) + 1
    inverse = np.uint64(pow(int(_ODD), -1, 2**64))
    ones = np.ones(size, dtype=np.uint64)
    ones[1:] = _ODD
    up = np.cumprod(ones)
    ones[1:] = inverse
    return up, np.cumprod(ones)


def _run_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` bytes; it depends on the bytes alone."""
    up, down = _powers()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    found = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
    found = (found ^ (found >> np.uint64(30))) * _SPREAD[0]
    found = (found ^ (found >> np.uint64(27))) * _SPREAD[1]
    return found ^ (found >> np.uint64(31))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys, by running minima within blocks of that many."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors_of(hashes: np.ndarray, length: int, run: int) -> np.ndarray:
    """Where the anchor of each ``length`` bytes begins, from the hashes of all runs of ``run`` bytes."""
    place = np.uint64((1 << BUFFER_BITS) - 1)
    keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    return (_least(keys, length - run + 1) & place).astype(np.int64)


def _stretches(values: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of neighbouring chosen ones with one value."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (chosen[1:] != chosen[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(values)) - 1
    return first[chosen[first]], last[chosen[first]]


def _whole(ends: np.ndarray, count: int, length: int) -> np.ndarray:
    """Which of the first ``count`` places begin ``length`` bytes of one text."""
    starts = np.arange(count)
    return starts + length <= ends[np.searchsorted(ends, starts, side="right")]


def _inner(length: int) -> tuple[int, int]:
    """Of the shorter strings that must be repeated wherever ``length`` bytes are: their length, their anchors' length.

    Neighbouring anchors overlap, so one changed byte makes an anchor differ.
    """
    return length // 2, length * INNER_PERCENT // 100


def _buffers(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[bytes, np.ndarray, list]]:
    """Texts of (row, text) batches put together: the bytes, where each part ends, its row and its place in the text.

    A text longer than a buffer comes in parts that share length - 1 bytes, so each window is in one part.
    """
    size = 1 << BUFFER_BITS
    step, parts, held = size - length + 1, [], 0

    def joined():
        ends = np.cumsum([len(data) for _, _, data in parts])
        return b"".join([data for _, _, data in parts]), ends, [(row, place) for row, place, _ in parts]

    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            data = text.as_py() or b""
            for place in range(0, max(len(data) - length + 1, 0), step):
                part = data[place : place + size]
                if held + len(part) > size:
                    yield joined()
                    parts, held = [], 0
                parts.append((row, place, part))
                held += len(part)
    if parts:
        yield joined()


def repeated_anchors(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor: hashes of those anchors of the inner strings that occur more than once in (row, text)."""
    inner, run = _inner(length)

    def count(batches):
        held, size = [], 0

        def sums():
            anchors, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n)], names=["anchor", "n"])

        for data, ends, _ in _buffers(batches, length):
            hashes = _run_hashes(np.frombuffer(data, dtype=np.uint8), run)
            anchor = anchors_of(hashes, inner, run)
            first, _ = _stretches(anchor, _whole(ends, len(anchor), inner))
            held.append(hashes[anchor[first]])
            size += len(first)
            if size > 1 << BUFFER_BITS:
                yield sums()
                held, size = [], 0
        yield sums()

    found = rows.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") > 1).select("anchor")


STRINGS = "row long, start long, digest binary, anchor long, left int, string binary, n long"


def anchored_strings(rows: DataFrame, bitmap: np.ndarray, length: int = LENGTH) -> DataFrame:
    """Two kinds of rows: where a string stands (row, start, digest), and its text (digest, anchor, left, string, n).

    ``left`` bytes stand before the anchor. A task sends a text once with its count n, unless it holds too many.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    names = [field.split()[0] for field in STRINGS.split(", ")]
    inner, run = _inner(length)

    def cut(batches):
        held: dict[bytes, list] = {}
        size = 0

        def texts():
            digests, values = list(held), list(held.values())
            n = len(values)
            arrays = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(digests, pa.binary())]
            for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.int64())):
                arrays.append(pa.array([v[k] for v in values], kind))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for data, ends, parts in _buffers(batches, length):
            symbols = np.frombuffer(data, dtype=np.uint8)
            hashes = _run_hashes(symbols, run)
            inside = sketch.may_hold(shared.value, hashes)[anchors_of(hashes, inner, run)]
            hashes = _run_hashes(symbols, ANCHOR)
            anchor = anchors_of(hashes, length, ANCHOR)
            # A window passes if all inner strings do.
            within, sums = len(inside) - len(anchor) + 1, np.append(0, np.cumsum(inside))
            passing = sums[within:] - sums[: len(anchor)] == within
            first, last = _stretches(anchor, passing & _whole(ends, len(anchor), length))
            place = anchor[first]
            anchors = hashes[place].view(np.int64).tolist()
            part = np.searchsorted(ends, first, side="right")
            begins = np.append(0, ends[:-1])[part]
            digests = []
            for a, b, p, h in zip(first.tolist(), last.tolist(), place.tolist(), anchors):
                string = data[a : b + length]
                digest = hashlib.blake2b(string, digest_size=16, salt=(p - a).to_bytes(4, "little")).digest()
                digests.append(digest)
                entry = held.get(digest)
                if entry:
                    entry[3] += 1
                else:
                    held[digest] = [h, p - a, string, 1]
                    size += len(string)
            n = len(digests)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([parts[i][0] for i in part.tolist()], pa.int64()),
                    pa.array((first - begins + np.array([x[1] for x in parts], dtype=np.int64)[part])),
                    pa.array(digests, pa.binary()),
                    *[pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.int64())],
                ],
                names=names,
            )
            if size > HELD_BYTES:
                yield texts()
                held, size = {}, 0
        yield texts()

    return rows.mapInArrow(cut, STRINGS)


def aligned_repeats(groups: np.ndarray, lefts: np.ndarray, strings: list[bytes], length: int):
    """Which windows of distinct strings occur in another string of the group: (string, window start) arrays.

    ``groups`` numbers the strings' groups from 0 and is in order. One round per column: see the module's text.
    """
    m = len(strings)
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=m)
    from_column = int(lefts.max()) - lefts
    to_column = from_column + sizes
    width = int(to_column.max())
    # One column after another, so that each round reads one stretch of memory.
    columns = np.full((width + 1, m), _ENDED, dtype=np.uint16)
    flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
    of = np.repeat(np.arange(m), sizes)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns[from_column[of] + within, of] = flat
    entering = np.argsort(from_column, kind="stable")
    edges = np.searchsorted(from_column[entering], np.arange(width + 1))
    order, common = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    for column in range(width):
        if edges[column] < edges[column + 1]:
            # Strings that begin here have read nothing, so they come first in their groups.
            new = np.sort(entering[edges[column] : edges[column + 1]])
            order = np.concatenate((new, order))
            common = np.concatenate((np.zeros(len(new), dtype=np.int64), common))
            place = np.argsort(groups[order], kind="stable")
            order, common = order[place], common[place]
        key = groups[order] * 512 + columns[column][order]
        if (key[1:] < key[:-1]).any():
            place = np.argsort(key, kind="stable")
            key, order = key[place], order[place]
            gone = np.flatnonzero(place[1:] != place[:-1] + 1) + 1
            moved = common[place]
            gone = gone[key[gone] == key[gone - 1]]
            if len(gone):
                # Between two that become neighbours the least common length counts.
                pairs = np.stack((place[gone - 1] + 1, place[gone] + 1), axis=1).ravel()
                moved[gone] = np.minimum.reduceat(np.append(common, 0), pairs)[::2]
            common = moved
        same = np.zeros(len(key), dtype=bool)
        same[1:] = key[1:] == key[:-1]
        common = np.where(same, common + 1, 0)
        alive = key % 512 != _ENDED
        if not alive.all():
            order, common = order[alive], common[alive]
        if column >= length - 1:
            hit = np.flatnonzero(common >= length)
            if len(hit):
                both = np.unique(np.concatenate((order[hit], order[hit - 1])))
                found.append(both)
                starts.append(column - length + 1 - from_column[both])
    nothing = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found or nothing), np.concatenate(starts or nothing)


def _runs(string: np.ndarray, start: np.ndarray):
    """Sorted (string, start) pairs as runs of neighbouring starts: string, first, last."""
    order = np.lexsort((start, string))
    string, start = string[order], start[order]
    new = np.ones(len(string), dtype=bool)
    new[1:] = (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1 if len(first) else first
    return string[first], start[first], start[last]


RUNS = "digest binary, first int, last int"


def _run_batch(digests, first, last) -> pa.RecordBatch:
    arrays = [pa.array(digests, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=["digest", "first", "last"])


def sorted_repeats(strings: DataFrame, length: int = LENGTH) -> DataFrame:
    """digest, first, last: runs of repeated window starts in (digest, anchor, left, string, n), by sorting."""

    def solve(rows: list) -> Iterator[pa.RecordBatch]:
        merged: dict[bytes, list] = {}
        for digest, anchor, left, string, n in rows:
            entry = merged.setdefault(digest, [anchor, left, string, 0])
            entry[3] += n
        digests, values = list(merged), list(merged.values())
        _, groups = np.unique(np.array([v[0] for v in values], dtype=np.int64), return_inverse=True)
        order = np.argsort(groups, kind="stable")
        digests, values, groups = [digests[i] for i in order], [values[i] for i in order], groups[order]
        copied = [i for i, v in enumerate(values) if v[3] > 1]
        yield _run_batch([digests[i] for i in copied], [0] * len(copied), [len(values[i][2]) - length for i in copied])
        # A string alone in its group has no other to share a window with.
        shared = np.bincount(groups)[groups] > 1
        if shared.any():
            chosen = np.flatnonzero(shared)
            lefts = np.array([values[i][1] for i in chosen], dtype=np.int64)
            found = aligned_repeats(groups[chosen], lefts, [values[i][2] for i in chosen], length)
            string, first, last = _runs(*found)
            yield _run_batch([digests[chosen[i]] for i in string], first, last)

    def sort(batches):
        held, size, current = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if size > SORTED_BYTES and row[1] != current:
                    yield from solve(held)
                    held, size = [], 0
                current = row[1]
                held.append(row)
                size += len(row[3])
        if held:
            yield from solve(held)

    return strings.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, RUNS)


def counted_repeats(strings: DataFrame, length: int = LENGTH) -> DataFrame:
    """As ``sorted_repeats``, by counting the digests of all windows, whatever the size of a group."""

    def windows(batches):
        for batch in batches:
            for digest, string, n in zip(*[batch.column(i).to_pylist() for i in (0, 3, 4)]):
                count = len(string) - length + 1
                seen = [hashlib.blake2b(string[i : i + length], digest_size=16).digest() for i in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seen, pa.binary()),
                        pa.array([digest] * count, pa.binary()),
                        pa.array(range(count), pa.int32()),
                        pa.array([n] * count, pa.int64()),
                    ],
                    names=["window", "digest", "first", "n"],
                )

    found = strings.mapInArrow(windows, "window binary, digest binary, first int, n long")
    often = found.groupBy("window").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("window")
    marked = found.join(often, "window", "left_semi").select("digest", "first").distinct()
    return marked.select("digest", "first", F.col("first").alias("last"))


def repeated_spans(spark: SparkSession, rows: DataFrame, length: int = LENGTH, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """row, start, end: stretches of bytes of (row, text) to remove; they may overlap."""
    bitmap = sketch.bitmap_of(repeated_anchors(rows, length))
    table = written(spark, anchored_strings(rows, bitmap, length), "zstd")
    strings = table.filter(F.col("string").isNotNull()).select("digest", "anchor", "left", "string", "n")
    sizes = strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("_strings"))
    hot = written(spark, sizes.filter(F.col("_strings") > hot_strings).select("anchor"))
    by_sorting = sorted_repeats(strings.join(hot, "anchor", "left_anti").select(*strings.columns), length)
    by_counting = counted_repeats(strings.join(hot, "anchor", "left_semi").select(*strings.columns), length)
    runs = by_sorting.unionByName(by_counting)
    runs = written(spark, runs.groupBy("digest").agg(F.collect_set(F.struct("first", "last")).alias("runs")))
    places = table.filter(F.col("row").isNotNull()).select("row", "start", "digest")
    found = places.join(runs, "digest").select("row", "start", F.explode("runs").alias("run"))
    return found.select(
        "row",
        (F.col("start") + F.col("run.first")).alias("start"),
        (F.col("start") + F.col("run.last") + length).alias("end"),
    )


def _removal(schema: str):
    @F.pandas_udf(schema)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            found = []
            for text, marked in zip(texts, spans):
                data = (text or "").encode()
                runs: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in (marked if marked is not None else ())):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in runs]], [*[s for s, _ in runs], len(data)]))
                found.append((len(data), len(data) - len(kept), len(runs), kept))
            yield pd.DataFrame(found, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def without_repeats(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, hot_strings: int = HOT_STRINGS
) -> DataFrame:
    """The rows of docs with n_bytes, n_removed, n_spans and kept, the remaining bytes.

    Columns of docs with these names are replaced.
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    columns = [c for c, n in zip(columns_of(docs), docs.columns) if n not in made]
    rows = numbered(spark, docs.select(*columns), "_row_of_repeats")
    spans = repeated_spans(spark, rows.select(F.col("_row_of_repeats").alias("row"), "text"), length, hot_strings)
    by_row = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    joined = rows.join(by_row, F.col("_row_of_repeats") == F.col("row"), "left")
    cut = _removal("n_bytes long, n_removed long, n_spans long, kept binary")
    return joined.select(*columns, F.inline(F.array(cut(F.col("text"), F.col("_spans")))))


def repeat_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = without_repeats(spark, docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
