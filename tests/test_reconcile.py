"""Reconciliation against a plain Python reading, and the laws that must hold."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinledger import CompareRules, reconcile
from twinledger.operators import keys as key_ops
from twinledger.operators.reconcile import top_per_status
from twinledger.operators.results import data_columns, mismatches_only, search_rows

SCHEMA = "k1 string, k2 int, a string, b double, c timestamp_ntz"


def sort_key(row):
    return tuple((v is not None, v) for v in row)


def brute_force(source, target, columns=3):
    """Status per key, with the smallest row (nulls first) of each side as its representative."""

    def side(rows):
        kept = {}
        for row in rows:
            key, rest = row[:2], row[2:]
            kept[key] = min(kept.get(key, rest), rest, key=sort_key)
        return kept

    s, t = side(source), side(target)
    out = {}
    for key in s.keys() | t.keys():
        if key not in s:
            out[key] = "Missing in Source"
        elif key not in t:
            out[key] = "Missing in Target"
        else:
            out[key] = "same" if s[key][:columns] == t[key][:columns] else "differs"
    return out


def random_rows(rng, n):
    from datetime import datetime

    return [
        (
            rng.choice(["x", "y", None, ""]),
            rng.choice([None, *range(6)]),
            rng.choice(["p", "q", None]),
            rng.choice([1.0, 2.5, None]),
            rng.choice([datetime(2024, 1, 1), None]),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(6))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    source, target = random_rows(rng, rng.choice([0, 5, 60])), random_rows(rng, rng.choice([0, 5, 60]))
    rules = CompareRules(treat_null_as_empty=False)
    s, t = spark.createDataFrame(source, SCHEMA), spark.createDataFrame(target, SCHEMA)
    result = reconcile(spark, s, t, ["k1", "k2"], rules)
    expected = brute_force(source, target)
    counts = Counter(expected.values())
    row = result.summary.head()
    assert (row["source_count"], row["target_count"]) == (len(source), len(target))
    assert (row["missing_in_source"], row["missing_in_target"]) == (
        counts["Missing in Source"],
        counts["Missing in Target"],
    )
    assert (row["mismatched_rows"], row["matching_rows"]) == (counts["differs"], counts["same"])
    found = {(r["k1"], r["k2"]): r["validation_status"] for r in result.detail.collect()}
    assert found == {
        k: "Found in Both" if v == "differs" else v for k, v in expected.items() if v != "same"
    }
    assert row["source_keys"] == row["matching_rows"] + row["mismatched_rows"] + row["missing_in_target"]
    assert row["target_keys"] == row["matching_rows"] + row["mismatched_rows"] + row["missing_in_source"]
    swapped = reconcile(spark, t, s, ["k1", "k2"], rules).summary.head()
    assert (swapped["missing_in_source"], swapped["missing_in_target"]) == (
        row["missing_in_target"],
        row["missing_in_source"],
    )
    assert swapped["mismatched_rows"] == row["mismatched_rows"]
    assert reconcile(spark, s, s, ["k1", "k2"], rules).detail.isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_unique_keys_path_agrees(spark, seed):
    rng = random.Random(seed)
    source = list({r[:2]: r for r in random_rows(rng, 40)}.values())
    target = list({r[:2]: r for r in random_rows(rng, 40)}.values())
    s, t = spark.createDataFrame(source, SCHEMA), spark.createDataFrame(target, SCHEMA)
    grouped = reconcile(spark, s, t, ["k1", "k2"])
    joined = reconcile(spark, s, t, ["k1", "k2"], unique_keys=True)
    assert grouped.summary.head() == joined.summary.head()
    assert sorted(map(str, grouped.detail.collect())) == sorted(map(str, joined.detail.collect()))


def test_summary_detail_and_columns_agree(spark):
    rng = random.Random(7)
    s = spark.createDataFrame(random_rows(rng, 80), SCHEMA)
    t = spark.createDataFrame(random_rows(rng, 80), SCHEMA)
    result = reconcile(spark, s, t, ["k1", "k2"]).persist()
    row = result.summary.head()
    detail = result.detail.collect()
    both = [r for r in detail if r["validation_status"] == "Found in Both"]
    assert len(both) == row["mismatched_rows"]
    assert result.diff_keys.count() == len(detail)
    for stat in result.column_stats.collect():
        differing = sum(r[f"{stat['column_name']}_status"] != "MATCH" for r in both)
        assert (stat["compared"], stat["mismatched"]) == (row["found_in_both"], differing)
    cells = result.detail_long.filter("validation_status = 'Found in Both'").count()
    assert cells == sum(r[f"{c}_status"] != "MATCH" for r in both for c in ("a", "b", "c"))
    spread = {r["validation_status"]: r["row_count"] for r in result.status_counts.collect()}
    assert spread["Found in Both"] == row["found_in_both"]
    assert search_rows(result.detail, "MISSING IN").count() == row["missing_in_source"] + row["missing_in_target"]
    assert mismatches_only(result.detail).count() == row["mismatched_rows"]
    result.unpersist()


def test_planted_differences_are_recovered(spark):
    source = spark.range(10_000).select(
        F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.concat(F.lit("n"), "id").alias("n")
    )
    target = (
        source.filter("k % 100 <> 7")
        .withColumn("v", F.when(F.col("k") % 250 == 3, F.col("v") + 1).otherwise(F.col("v")))
        .unionByName(source.filter("k < 13").withColumn("k", F.col("k") + 1_000_000))
    )
    row = reconcile(spark, source, target, ["k"]).summary.head()
    assert (row["missing_in_target"], row["missing_in_source"], row["mismatched_rows"]) == (100, 13, 40)


def test_no_compared_columns(spark):
    s = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    t = spark.createDataFrame([(2,), (3,), (None,)], "k int")
    result = reconcile(spark, s, t, ["K"])
    row = result.summary.head()
    assert (row["source_count"], row["source_duplicate_rows"], row["matching_rows"]) == (4, 1, 2)
    assert result.detail.columns == ["validation_status", "k"]
    assert sorted(map(tuple, result.detail.collect())) == [("Missing in Source", 3), ("Missing in Target", 1)]
    assert result.column_stats.count() == 0
    assert result.sample().count() == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, v string")
    row = reconcile(spark, empty, empty, ["k"]).summary.head()
    assert (row["source_count"], row["match_percentage"], row["row_count_diff"]) == (0, 0.0, 0)


def test_missing_key_column_is_named(spark):
    s = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="not in source: nope"):
        reconcile(spark, s, s, ["nope"])


def test_clashing_result_names_are_refused(spark):
    s = spark.createDataFrame([(1, "a")], "a_status int, a string")
    with pytest.raises(ValueError, match="a_status"):
        reconcile(spark, s, s, ["a_status"]).detail
    assert reconcile(spark, s, s, ["a_status"]).summary.head()["matching_rows"] == 1
    with pytest.raises(ValueError, match="mismatch"):
        reconcile(spark, s.toDF("mismatch", "v"), s.toDF("mismatch", "v"), ["mismatch"])


def test_awkward_names(spark):
    s = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "`Key.One` int, `Job_Status` string, `a``b` string")
    t = spark.createDataFrame([(1, "a", "x"), (2, "c", "y")], "`Key.One` int, `Job_Status` string, `a``b` string")
    result = reconcile(spark, s, t, ["key.one"])
    assert data_columns(result.detail, ["key.one"]) == ["job_status", "a`b"]
    rows = result.detail.collect()
    assert [r["job_status_status"] for r in rows] == ["MISMATCH: b || c"]
    assert result.sample().count() == 1
    assert [r["matching"] for r in result.column_stats.orderBy("column_name").collect()] == [2, 1]


def test_nested_and_other_types(spark):
    from datetime import date
    from decimal import Decimal

    s = spark.createDataFrame(
        [(1, [1, 2], {"a": 1}, bytearray(b"x"), True, Decimal("1.50"), date(2024, 1, 2), 5)],
        "k int, l array<int>, m map<string,int>, b binary, f boolean, d decimal(5,2), t date, n bigint",
    )
    t = spark.createDataFrame(
        [(1, [1, 3], {"a": 2}, bytearray(b"y"), False, Decimal("1.500"), "2024-01-02", 5.004)],
        "k bigint, l array<int>, m map<string,int>, b binary, f boolean, d decimal(6,3), t string, n double",
    )
    row = reconcile(spark, s, t, ["k"], CompareRules(float_epsilon=0.01)).detail.head()
    assert row["l_status"] == "MISMATCH: [1,2] || [1,3]"
    assert row["m_status"] == 'MISMATCH: {"a":1} || {"a":2}'
    assert row["b_status"] == "MISMATCH: 78 || 79"
    assert row["f_status"] == "MISMATCH: true || false"
    assert (row["d_status"], row["t_status"], row["n_status"]) == ("MATCH", "MATCH", "MATCH")


def test_large_integers_are_not_rounded(spark):
    s = spark.createDataFrame([(1, 2**62, -(2**63))], "k int, v bigint, w bigint")
    t = spark.createDataFrame([(1, 2**62 + 1, 2**63 - 1)], "k int, v bigint, w bigint")
    row = reconcile(spark, s, t, ["k"], CompareRules(float_epsilon=0.5)).detail.head()
    assert row["v_status"] != "MATCH" and row["w_status"] != "MATCH"
    near = reconcile(spark, s, t, ["k"], CompareRules(float_epsilon=1.0)).detail.head()
    assert near["v_status"] == "MATCH" and near["w_status"] != "MATCH"


def test_caps_per_status_and_overall(spark):
    s = spark.range(3000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    t = spark.range(1000, 5000).select(F.col("id").alias("k"), F.lit("b").alias("v"))
    result = reconcile(spark, s, t, ["k"])
    capped = result.detail_report(cap=500, per_status=500)
    assert [r["k"] for r in capped.collect()] == list(range(1000, 1500))
    wide = Counter(r["validation_status"] for r in result.detail_report(per_status=500).collect())
    assert wide == {"Found in Both": 500, "Missing in Source": 500, "Missing in Target": 500}
    assert result.detail_report().count() == 5000
    large = top_per_status(result.detail, ["k"], 1500)
    assert Counter(r["validation_status"] for r in large.collect()) == {
        "Found in Both": 1500,
        "Missing in Source": 1500,
        "Missing in Target": 1000,
    }


def test_key_operators(spark):
    s = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (None, "d"), (None, "d")], "k int, v string")
    t = spark.createDataFrame([(2, "c"), (3, "e"), (3, "f")], "k int, v string")
    assert tuple(key_ops.key_profile(s, "k").head()) == (6, 3, 2, 3, 3)
    assert sorted(map(str, map(tuple, key_ops.duplicate_keys(s, "k").collect()))) == ["(1, 3)", "(None, 2)"]
    assert sorted(map(str, map(tuple, key_ops.dedup_rows(s, "k").collect()))) == ["(1, None)", "(2, 'c')", "(None, 'd')"]
    assert sorted(str(r["k"]) for r in key_ops.missing_in_target(s, t, "k").collect()) == ["1", "None"]
    assert [r["k"] for r in key_ops.missing_in_source(s, t, "k").collect()] == [3]
    assert key_ops.dedup_rows(s.select("k"), "k").count() == 3
