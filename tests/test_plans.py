"""The physical plans that must hold at scale, and behaviour under a hot key."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from twinledger import CompareRules, reconcile
from twinledger.catalog import pairs
from twinledger.operators import keys as key_ops

SF = "/root/testdata/sf0.01"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_shuffles_each_side_once(spark):
    result = reconcile(spark, *pairs.orders_pair(spark, SF), ["o_orderkey"], pairs.ORDERS_RULES, unique_keys=False)
    plan = plan_of(result.summary)
    hashed = re.findall(r"Exchange hashpartitioning", plan)
    assert len(hashed) == 1
    assert "Join" not in plan and "Window" not in plan and "Python" not in plan
    assert plan.count("partial_min") >= 2


def test_unique_keys_plan_is_one_join(spark):
    result = reconcile(spark, *pairs.orders_pair(spark, SF), ["o_orderkey"], unique_keys=True)
    plan = plan_of(result.summary)
    assert len(re.findall("Join", plan)) == 1 and "FullOuter" in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_keys_that_do_not_repeat_need_no_sort_before_the_shuffle(spark):
    result = reconcile(spark, *pairs.orders_pair(spark, SF), ["o_orderkey"], pairs.ORDERS_RULES)
    plan = plan_of(result.summary)
    assert "FullOuter" in plan and "partial_min" not in plan
    for part in plan.split("Exchange hashpartitioning")[1:]:
        assert "Sort " not in part.split("Scan parquet")[0]


def test_a_broken_promise_of_unique_keys_is_refused(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="keys repeat"):
        reconcile(spark, table, table, ["k"], unique_keys=True)
    row = reconcile(spark, table, table, ["k"]).summary.head()
    assert (row["source_keys"], row["source_duplicate_rows"]) == (2, 1)


def test_the_session_is_left_as_it_is(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    reconcile(spark, *pairs.orders_pair(spark, SF), ["o_orderkey"]).summary.head()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


def test_keys_only_reads_only_keys(spark):
    source, target = pairs.lineitem_pair(spark, SF)
    plan = plan_of(key_ops.missing_in_target(source, target, pairs.LINEITEM_KEYS))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert "l_extendedprice" not in " ".join(schemas)
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_filters_on_the_inputs_reach_the_scan(spark):
    source, target = pairs.orders_pair(spark, SF)
    cut = [df.filter(F.col("o_orderdate") >= "1996-01-01") for df in (source, target)]
    plan = plan_of(reconcile(spark, *cut, ["o_orderkey"]).detail)
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_capped_detail_limits_before_its_shuffle(spark):
    result = reconcile(spark, *pairs.orders_pair(spark, SF), ["o_orderkey"], pairs.ORDERS_RULES)
    plan = plan_of(result.detail_report(cap=500, per_status=500))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "TakeOrderedAndProject" in plan


def test_dedup_has_no_window(spark):
    lineitem = pairs.load(spark, SF, "lineitem")
    plan = plan_of(key_ops.dedup_rows(lineitem, pairs.LINEITEM_KEYS))
    assert "Window" not in plan and "partial_min" in plan


@pytest.mark.parametrize("rows", [200_000])
def test_a_hot_key_is_reduced_before_the_shuffle(spark, rows):
    """A third of all rows share one key; another third have a null key."""
    source = spark.range(0, rows, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 1000).alias("v"),
        F.lit("some text").alias("w"),
    )
    target = source.withColumn("v", F.when(F.col("k") == -1, F.col("v") + 1).otherwise(F.col("v")))
    result = reconcile(spark, source, target, ["k"], CompareRules(treat_null_as_empty=False))
    row = result.summary.head()
    distinct = rows - (rows + 2) // 3 - (rows + 1) // 3 + 2
    assert (row["source_count"], row["source_keys"]) == (rows, distinct)
    assert (row["mismatched_rows"], row["matching_rows"]) == (1, distinct - 1)
    written = (
        result.summary._jdf.queryExecution().executedPlan().toString()
    )
    assert "partial_min" in written


def test_bucketed_tables_are_compared_without_a_shuffle(spark):
    source, target = pairs.orders_pair(spark, SF)
    for name, df in (("bucketed_source", source), ("bucketed_target", target)):
        df.write.mode("overwrite").bucketBy(8, "o_orderkey").sortBy("o_orderkey").saveAsTable(name)
    result = reconcile(
        spark, spark.table("bucketed_source"), spark.table("bucketed_target"), ["o_orderkey"], pairs.ORDERS_RULES, unique_keys=False
    )
    assert "Exchange" not in plan_of(result.detail)
    assert result.summary.head()["mismatched_rows"] == 981
