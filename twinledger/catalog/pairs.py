"""Pairs of tables to reconcile, derived from the given ones in Spark and in SQL.

Each source is a whole table. Each target is the same table with planted differences spread over
all of it: rows left out, rows added, and values changed for one key in so many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.catalog.sql import Col
from twinledger.spec import CompareRules

MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def every(n: int, rest: int, key: str) -> Column:
    """True for one key in ``n``: where a difference is planted."""
    return F.col(key) % n == rest


# -- orders: a unique key, typed columns -------------------------------------------------------

ORDERS_KEYS = ["o_orderkey"]
ORDERS_RULES = CompareRules(
    float_epsilon=0.011,
    trim_strings=True,
    normalize_dates=True,
    upper_columns=("o_orderstatus",),
    numeric_scale=2,
)
ORDERS_EXACT = CompareRules(treat_null_as_empty=False, numeric_scale=2)


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = load(spark, sf_dir, "orders")
    key, price, priority = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    changed = source.filter(~every(97, 0, "o_orderkey")).select(
        "o_orderkey",
        "o_custkey",
        F.when(every(31, 3, "o_orderkey"), F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(every(50, 1, "o_orderkey"), price + 0.01)
        .when(every(50, 2, "o_orderkey"), price + 5)
        .otherwise(price)
        .alias("o_totalprice"),
        F.when(every(43, 6, "o_orderkey"), F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
        .otherwise(F.col("o_orderdate"))
        .alias("o_orderdate"),
        F.when(every(41, 5, "o_orderkey"), F.lit(None).cast("string"))
        .when(every(29, 4, "o_orderkey"), F.concat(F.lit("  "), priority, F.lit(" ")))
        .otherwise(priority)
        .alias("o_orderpriority"),
    )
    added = source.filter(every(89, 0, "o_orderkey")).withColumn("o_orderkey", key + 10_000_000)
    return source, changed.unionByName(added)


ORDERS_SQL = """
src AS (SELECT * FROM orders),
tgt AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 31 = 3 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 50 = 1 THEN o_totalprice + CAST(0.01 AS DOUBLE)
              WHEN o_orderkey % 50 = 2 THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 43 = 6 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate,
         CASE WHEN o_orderkey % 41 = 5 THEN NULL
              WHEN o_orderkey % 29 = 4 THEN '  ' || o_orderpriority || ' ' ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 89 = 0)
"""

ORDERS_COLUMNS_EXACT = [
    Col("o_custkey"),
    Col("o_orderstatus"),
    Col("o_totalprice", text=MONEY),
    Col("o_orderdate"),
    Col("o_orderpriority"),
]
ORDERS_COLUMNS_RULES = [
    Col("o_custkey", also="abs({s} - {t}) <= 0.011"),
    Col("o_orderstatus", norm="coalesce(upper(trim({})), '')"),
    Col("o_totalprice", also="abs({s} - {t}) <= CAST(0.011 AS DOUBLE)", text=MONEY),
    Col("o_orderdate"),
    Col("o_orderpriority", norm="coalesce(trim({}), '')"),
]


# -- orders as text, the form that files have --------------------------------------------------


def orders_text(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
        "o_orderpriority",
    )


def orders_text_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source, target = orders_pair(spark, sf_dir)
    return orders_text(source), orders_text(target)


_AS_TEXT = f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, {MONEY.format('o_totalprice')} AS o_totalprice,
       CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority"""

ORDERS_TEXT_SQL = (
    ORDERS_SQL.replace("src AS", "src0 AS").replace("tgt AS", "tgt0 AS").rstrip()
    + f",\nsrc AS ({_AS_TEXT} FROM src0),\ntgt AS ({_AS_TEXT} FROM tgt0)"
)


# -- lineitem: a key with many duplicates ------------------------------------------------------

LINEITEM_KEYS = ["l_orderkey", "l_linenumber"]
LINEITEM_RULES = CompareRules(numeric_scale=2)


def lineitem_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = load(spark, sf_dir, "lineitem")
    changed = source.filter(~every(101, 7, "l_partkey")).withColumn(
        "l_tax", F.when(every(37, 5, "l_suppkey"), F.lit(0.5)).otherwise(F.col("l_tax"))
    )
    return source, changed


LINEITEM_SQL = """
src AS (SELECT * FROM lineitem),
tgt AS (
  SELECT * REPLACE (CASE WHEN l_suppkey % 37 = 5 THEN CAST(0.5 AS DOUBLE) ELSE l_tax END AS l_tax)
  FROM lineitem WHERE l_partkey % 101 <> 7)
"""
LINEITEM_COLUMNS = [
    Col("l_partkey"),
    Col("l_suppkey"),
    Col("l_quantity", text=MONEY),
    Col("l_extendedprice", text=MONEY),
    Col("l_discount", text=MONEY),
    Col("l_tax", text=MONEY),
    Col("l_returnflag"),
    Col("l_linestatus"),
    Col("l_shipdate"),
]


# -- conversations: a unique composite key -----------------------------------------------------

CONVERSATION_KEYS = ["conv_id", "turn"]


def conversations_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = load(spark, sf_dir, "conversations")
    target = source.filter(~(every(11, 3, "conv_id") & (F.col("turn") == 0))).select(
        "conv_id",
        "turn",
        F.when(every(7, 2, "conv_id"), F.upper("role")).otherwise(F.col("role")).alias("role"),
        F.when(every(5, 1, "conv_id"), F.replace("text", F.lit("e"), F.lit("3"))).otherwise(F.col("text")).alias("text"),
    )
    return source, target


CONVERSATIONS_SQL = """
src AS (SELECT * FROM conversations),
tgt AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 7 = 2 THEN upper(role) ELSE role END AS role,
         CASE WHEN conv_id % 5 = 1 THEN replace(text, 'e', '3') ELSE text END AS text
  FROM conversations WHERE NOT (conv_id % 11 = 3 AND turn = 0))
"""
CONVERSATION_COLUMNS = [Col("role", norm="coalesce({}, '')"), Col("text", norm="coalesce({}, '')")]


# -- events: values within and beyond a tolerance ----------------------------------------------

EVENT_KEYS = ["event_id"]
EVENT_RULES = CompareRules(float_epsilon=0.05, numeric_scale=4)


def events_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = load(spark, sf_dir, "events")
    value = F.col("value")
    target = source.filter(~every(83, 1, "event_id")).withColumn(
        "value",
        F.when(every(10, 1, "event_id"), value + 0.04).when(every(10, 2, "event_id"), value + 0.06).otherwise(value),
    )
    return source, target


EVENTS_SQL = """
src AS (SELECT * FROM events),
tgt AS (
  SELECT * REPLACE (CASE WHEN event_id % 10 = 1 THEN value + CAST(0.04 AS DOUBLE)
                         WHEN event_id % 10 = 2 THEN value + CAST(0.06 AS DOUBLE) ELSE value END AS value)
  FROM events WHERE event_id % 83 <> 1)
"""
EVENT_COLUMNS = [
    Col("ts"),
    Col("user_id", also="abs({s} - {t}) <= 0.05"),
    Col("event_type", norm="coalesce({}, '')"),
    Col("value", also="abs({s} - {t}) <= CAST(0.05 AS DOUBLE)", text="CAST(CAST({} AS DECIMAL(18,4)) AS VARCHAR)"),
    Col("props", norm="coalesce({}, '')"),
]
