"""Importance resampling against one checksum and one logarithm at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from helpers import CLASHING, ODD, docs, prose, tuples
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinledger.llm import resampling as res

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(lower)


def brute(rows, target, percent=10):
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s = Counter(bucket(w) for _, text, *_ in rows for w in words(text))
    t = Counter(bucket(w) for text in target for w in words(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    found = []
    for i, text, *_ in rows:
        w = words(text)
        weight = sum(gain[bucket(x)] for x in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in found if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    rank = {id(r): k for k, r in enumerate(drawn, start=1)}
    return sorted([(*r, rank.get(id(r))) for r in found], key=repr)


def corpus():
    rows = [(i, " ".join(prose(i, 5 + i % 60, 50 + i))) for i in range(400)]
    rows += [(1000 + i, "Café-TEST, naïve 漢字 x1 " * 9) for i in range(150)]
    return rows + [(r[0], r[1]) for r in rows[:3]]


def target(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


TARGET = [" ".join(prose(7, 300, 60)), None, "", "café test café"]


@given(st.lists(st.binary(max_size=40), max_size=60))
def test_checksums_are_those_of_zlib(values):
    assert res.crc32_of(values).tolist() == [zlib.crc32(v) for v in values]


def test_against_brute_force(spark):
    rows = corpus() + [r for r in ODD if r[0] is not None]
    found = res.resample_report(spark, docs(spark, rows), target(spark, TARGET))
    assert found.columns == list(COLUMNS) and {t for _, t in found.dtypes} == {"bigint"}
    assert tuples(found, *COLUMNS) == brute(rows, TARGET)


def test_odd_rows(spark):
    rows = ODD + [(None, "a " * 30), (None, "a " * 30)]
    found = res.resample_report(spark, docs(spark, rows), target(spark, []), percent=100)
    assert tuples(found, *COLUMNS) == brute(rows, [], 100)


def test_equal_scores_go_to_smaller_ids(spark):
    table = spark.createDataFrame(
        [(9, 30, 1, 0, 5), (3, 30, 1, 0, 5), (None, 30, 1, 0, 5), (4, 30, 1, 0, 6), (5, 19, 1, 0, 99)],
        "doc_id long, n_words long, n_features long, weight long, score long",
    )
    found = res.ranked(table, F.lit(3).cast("long"))
    assert {r["doc_id"]: r["rank"] for r in found.collect()} == {4: 1, 3: 2, 9: 3, None: None, 5: None}


def test_longer_runs(spark):
    rows = [(1, "a b c a b")]
    table = res.bucket_table(docs(spark, rows).select("doc_id", "text"), 1, 2)
    row = table.head()
    expected = [zlib.crc32(w) % 10_000 for w in (b"a", b"b", b"c", b"a", b"b", b"a b", b"b c", b"c a", b"a b")]
    assert row["n_words"] == 5 and np.frombuffer(row["features"], "<u4").tolist() == expected


def test_empty_tables(spark):
    assert res.resample_report(spark, docs(spark, []), target(spark, TARGET)).count() == 0
    assert res.resample_report(spark, docs(spark, [(1, "x " * 40)]), target(spark, [])).count() == 1


def test_drawn_rows_come_back_whole(spark):
    rows = corpus()
    table = docs(spark, rows, CLASHING)
    share = F.floor(F.col("candidates") / 10).cast("long")
    drawn = res.resample(spark, table, target(spark, TARGET), share)
    best = {r[0] for r in brute(rows, TARGET) if r[4]}
    assert drawn.columns == table.columns
    assert {r["doc_id"] for r in drawn.collect()} == best
    texts = {r["doc_id"]: r["text"] for r in drawn.collect()}
    assert texts == {i: t for i, t in rows if i in best}
