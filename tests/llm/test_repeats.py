"""Removal of long repeats against a count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import CLASHING, ODD, docs, prose, tuples
from hypothesis import given, settings
from hypothesis import strategies as st

from twinledger.llm import repeats as rep

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length=400):
    texts = [(text or "").encode() for _, text, *_ in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    found = []
    for (doc_id, *_), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[1:] < gone[:-1]).sum())
        found.append((doc_id, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def corpus():
    rng = random.Random(11)
    passage = " ".join(prose(900, 90))
    rows = [(i, " ".join(prose(i, rng.randrange(10, 250)))) for i in range(40)]
    rows += [(50 + i, " ".join([*prose(50 + i, 40 * i), passage[: 395 + i], *prose(80 + i, 60)])) for i in range(9)]
    rows += [(70 + i, rows[3][1]) for i in range(3)]
    edited = list(rows[30][1] * 3)
    for at in range(0, len(edited), 450):
        edited[at] = "#"
    rows += [(80, "".join(edited)), (81, "ab" * 700), (82, "é漢" * 300), (83, "x" * 399), (84, "x" * 400), (85, "-" * 1000)]
    return rows + [(90, passage + passage), (91, rows[30][1])]


def found(spark, rows, length=400, **options):
    frame = rep.without_repeats(spark, docs(spark, rows).repartition(4), length, **options)
    return sorted(
        ((*r[:-1], hashlib.sha256(bytes(r[-1])).hexdigest()) for r in frame.select(*COLUMNS[:-1], "kept").collect()), key=repr
    )


@pytest.mark.parametrize("hot_strings", [20_000, 1, 0])
def test_against_brute_force(spark, hot_strings):
    rows = corpus()
    assert found(spark, rows, hot_strings=hot_strings) == brute(rows)


def test_odd_rows(spark):
    rows = ODD[:8] + ODD[9:] + [(6, "word " * 2000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])


def test_empty_table(spark):
    assert rep.repeat_report(spark, docs(spark, [])).count() == 0


def test_texts_longer_than_a_buffer(spark):
    """A text is searched in parts; a repeat across the border of two is found."""
    size = 1 << rep.BUFFER_BITS
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh", k=size + 5000))
    passage = long[size - 700 : size + 300]
    rows = [(1, long), (2, "q" * 300 + passage + "r" * 300), (3, long[:200])]
    got = {r[0]: r[1:4] for r in found(spark, rows)}
    assert got == {1: (size + 5000, 1000, 1), 2: (1600, 1000, 1), 3: (200, 0, 0)}


def test_report_and_clashing_columns(spark):
    rows = corpus()
    assert tuples(rep.repeat_report(spark, docs(spark, rows)), *COLUMNS) == brute(rows)
    table = docs(spark, rows, CLASHING)
    assert rep.without_repeats(spark, table).columns == [*table.columns, "n_bytes", "n_removed", "n_spans", "kept"]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6), st.binary(min_size=8, max_size=14)), min_size=1, max_size=14),
    st.integers(2, 6),
)
def test_sorting_by_columns(strings, length):
    """Aligned windows of distinct strings, one alphabet of two symbols so that many agree."""
    strings = sorted({(g, left, bytes(b & 1 for b in s)) for g, left, s in strings})
    groups = np.unique([g for g, _, _ in strings], return_inverse=True)[1]
    lefts = np.array([left for _, left, _ in strings])
    string, start = rep.aligned_repeats(groups, lefts, [s for _, _, s in strings], length)
    seen = Counter((g, i - left, s[i : i + length]) for g, left, s in strings for i in range(len(s) - length + 1))
    expected = {
        (k, i)
        for k, (g, left, s) in enumerate(strings)
        for i in range(len(s) - length + 1)
        if seen[g, i - left, s[i : i + length]] > 1
    }
    assert set(zip(string.tolist(), start.tolist())) == expected
    assert len(string) == len(expected)
