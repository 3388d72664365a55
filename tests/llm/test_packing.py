import random
import zlib

import numpy as np
import pytest
from helpers import CLASHING, ODD, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from twinledger.llm import packing, tokens

PUBLISHED = Tokenizer.from_file(tokens.default_path())
PUBLISHED.encode_special_tokens = True


def brute_pieces(rows, capacity=1024):
    out = []
    for i, text in rows:
        ids = PUBLISHED.encode(text or "", add_special_tokens=False).ids + [2]
        at, first = 0, len(ids) % capacity or capacity
        piece = 0
        while at < len(ids):
            part = ids[at : at + (first if not piece else capacity)]
            out.append((i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            at += len(part)
            piece += 1
    return sorted(out, key=repr)


def check_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def best_fit_one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_plan_is_best_fit_with_falling_lengths(capacity, data):
    histogram = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 30), max_size=12))
    used, placed = {}, {n: [] for n in histogram}
    for length, a, z, sequence, each, offset in packing.best_fit(histogram, capacity):
        for rank in range(a, z):
            placed[length].append(rank)
            s, o = sequence + (rank - a) // each, offset + (rank - a) % each * length
            used.setdefault(s, []).append((o, length))
    assert placed == {n: list(range(c)) for n, c in histogram.items()}
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
    rooms = sorted(capacity - sum(n for _, n in parts) for parts in used.values())
    assert rooms == best_fit_one_by_one([n for n, c in histogram.items() for _ in range(c)], capacity)


def corpus():
    rng = random.Random(8)
    rows = [(i, "word " * rng.choice([0, 1, 3, 100, 400, 1023, 1024, 3000])) for i in range(200)]
    return rows + [(1_000 + i, "same text of one length") for i in range(500)] + ODD


def test_against_brute_force(spark):
    rows = corpus()
    found = packing.pack(spark, docs(spark, rows, CLASHING).repartition(7)).collect()
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr)
    assert got == brute_pieces(rows)
    sequences = check_packed(found, 1024)
    assert sequences == len(best_fit_one_by_one([r["length"] for r in found], 1024))


def test_ids_make_up_the_documents(spark):
    rows = [(1, "some text " * 700), (2, "short"), (3, "")]
    found = packing.pack(spark, docs(spark, rows), with_ids=True).orderBy("doc_id", "piece").collect()
    for i, text in rows:
        ids = [x for r in found if r["doc_id"] == i for x in r["ids"]]
        assert ids == PUBLISHED.encode(text, add_special_tokens=False).ids + [2]


def test_no_rows(spark):
    assert packing.pack(spark, docs(spark, [])).count() == 0


@pytest.mark.parametrize(("n", "expected"), [(1, [(0, 1)]), (4, [(0, 4)]), (9, [(0, 1), (1, 5), (5, 9)]), (8, [(0, 4), (4, 8)])])
def test_cuts(n, expected):
    assert packing.cuts(n, 4) == expected
