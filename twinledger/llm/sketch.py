"""A bitmap of fixed size that tells which hashes cannot be in a set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, as a power of two: 8 MB. More bits let fewer others pass where a set is large.
BITMAP_BITS = 26


def places_of(hashes: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def bitmap_of(hashes: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The bitmap, as uint64 words, of a table of one column of 64-bit hashes.

    At most 2^bits / 64 words are sent to the driver, however many hashes there are.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = places_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            word = (place >> np.uint64(6)).astype(np.int64)
            order = np.argsort(word, kind="stable")
            starts = np.flatnonzero(np.diff(word[order], prepend=-1))
            value = np.left_shift(np.uint64(1), place & np.uint64(63))[order]
            merged = np.bitwise_or.reduceat(value, starts) if len(starts) else value
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[order][starts]), pa.array(merged.view(np.int64))], names=["word", "value"]
            )

    parts = hashes.mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    found = parts.toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
    bitmap[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return bitmap


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that are not in the set."""
    bits = int(len(bitmap)).bit_length() + 5
    place = places_of(hashes, bits)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
