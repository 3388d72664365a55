"""Collocations against a plain count of all phrases, and the summaries against what they guarantee."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import CLASHING, ODD, docs, prose, tuples
from hypothesis import given
from hypothesis import strategies as st

from twinledger.llm import collocations as col
from twinledger.llm import sketch

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, threshold=10, longest=3, covered=50, best=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    found = []
    for lang, f in counts.items():
        kept = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < threshold:
                continue
            longer = [q for q in f if len(q) > len(phrase) and f[q] >= threshold and 100 * f[q] >= covered * a]
            if any(q[i : i + len(phrase)] == phrase for q in longer for i in range(len(q) - len(phrase) + 1)):
                continue
            score, k = min((1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase)))
            kept.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:best], start=1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(found, key=repr)


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(500):
        words = [f"W{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " "]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text + " New York City Hall. naïve Zoë 漢字"))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").repartition(5)


@pytest.mark.parametrize("options", [{}, {"threshold": 3, "longest": 4, "covered_percent": 80, "best": 50}])
def test_against_brute_force(spark, options):
    rows = corpus()
    names = {"covered_percent": "covered"}
    expected = brute(rows, **{names.get(k, k): v for k, v in options.items()})
    found = col.collocations(spark, table(spark, rows), **options)
    assert found.columns == list(COLUMNS) and expected
    assert [t for _, t in found.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    assert tuples(found, *COLUMNS) == expected


def test_masses_count_every_phrase(spark):
    rows = corpus()
    texts = table(spark, rows).select("text", "lang")
    masses, _ = col.slot_masses(texts, 64)
    found = {r[0] for r in col.frequent_hashes(texts, masses).collect()}
    assert int(masses.sum()) == sum(
        max(0, len(p.split()) - n) for _, t in rows for p in re.split("[.,;:!?\n-\r]", t.replace(" ", "x")) for n in range(3)
    )
    all_hashes = {r[0] for r in col.frequent_hashes(texts, masses, threshold=1).collect()}
    assert found < all_hashes


def test_tasks_of_the_bitmap_hold_no_summaries(spark, monkeypatch):
    """Two Python steps in one task take the memory of two workers."""
    plans, bitmap_of = [], sketch.bitmap_of

    def seen(hashes):
        plans.append(hashes._jdf.queryExecution().toString())
        return bitmap_of(hashes)

    monkeypatch.setattr(sketch, "bitmap_of", seen)
    col.frequent_phrases(spark, table(spark, corpus()).select("text", "lang"))
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_odd_rows(spark):
    rows = ODD + [(20 + i, "und so weiter\x00 ok") for i in range(12)]
    found = col.collocations(spark, docs(spark, rows, CLASHING))
    assert tuples(found, *COLUMNS) == brute([("en", r[1]) for r in rows])


def test_empty_table(spark):
    assert col.collocations(spark, docs(spark, [])).count() == 0


def test_large_counts_are_exact(spark):
    frame = spark.createDataFrame([(9_999_999_999_999_999, 9_999_999_999_999_999, 10**15 + 7)], "a long, l long, r long")
    a, left, right = frame.columns
    score = frame.select(col._score(frame[a], frame[left], frame[right])).head()[0]
    assert score == 10**6 * 9_999_999_999_999_999**2 // (9_999_999_999_999_999 * (10**15 + 7))


@given(st.lists(st.lists(st.integers(0, 30), max_size=40), max_size=8), st.integers(1, 6))
def test_summaries_keep_what_is_frequent(parts, threshold):
    """However they are merged, summaries take less than the threshold off any count."""
    mass = sum(map(len, parts))
    summary = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0
    for part in parts:
        hashes, counts = np.unique(np.array(part, dtype=np.uint64), return_counts=True)
        summary = col.merged(summary, (hashes, counts, 0), mass // threshold + 1)
    held = dict(zip(summary[0].tolist(), summary[1].tolist()))
    assert summary[2] < threshold and len(held) <= mass // threshold + 1
    for value, total in Counter(x for p in parts for x in p).items():
        assert total - summary[2] <= held.get(value, 0) <= total


def test_bitmap(spark):
    rng = np.random.default_rng(3)
    held = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in held.view(np.int64)], "hash long").repartition(4)
    bitmap = sketch.bitmap_of(frame, 20)
    others = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    assert sketch.may_hold(bitmap, held).all() and sketch.may_hold(bitmap, others).mean() < 0.02
