"""Queries over whole reconciliations: summaries, details, keys, duplicates, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.catalog import pairs, sql
from twinledger.catalog.pairs import (
    CONVERSATION_COLUMNS,
    CONVERSATION_KEYS,
    CONVERSATIONS_SQL,
    EVENT_COLUMNS,
    EVENT_KEYS,
    EVENTS_SQL,
    LINEITEM_COLUMNS,
    LINEITEM_KEYS,
    LINEITEM_SQL,
    ORDERS_COLUMNS_EXACT,
    ORDERS_COLUMNS_RULES,
    ORDERS_KEYS,
    ORDERS_SQL,
    load,
)
from twinledger.operators import keys as key_ops
from twinledger.operators.reconcile import ReconResult, reconcile
from twinledger.operators.results import mismatches_only, search_rows
from twinledger.plans.report import in_report_order, mismatch_table, one_side_table, source_target_table, summary_metrics
from twinledger.spec import CompareRules

DRIFT = ("source_only_columns", "target_only_columns")


def orders_exact(spark: SparkSession, sf: str, **options) -> ReconResult:
    return reconcile(spark, *pairs.orders_pair(spark, sf), ORDERS_KEYS, pairs.ORDERS_EXACT, **options)


def orders_rules(spark: SparkSession, sf: str, **options) -> ReconResult:
    return reconcile(spark, *pairs.orders_pair(spark, sf), ORDERS_KEYS, pairs.ORDERS_RULES, **options)


def lineitem(spark: SparkSession, sf: str) -> ReconResult:
    return reconcile(spark, *pairs.lineitem_pair(spark, sf), LINEITEM_KEYS, pairs.LINEITEM_RULES)


def conversations(spark: SparkSession, sf: str) -> ReconResult:
    return reconcile(spark, *pairs.conversations_pair(spark, sf), CONVERSATION_KEYS)


def events(spark: SparkSession, sf: str) -> ReconResult:
    return reconcile(spark, *pairs.events_pair(spark, sf), EVENT_KEYS, pairs.EVENT_RULES)


def summary_of(result: ReconResult) -> DataFrame:
    return result.summary.drop(*DRIFT)


EXACT_J = sql.joined(ORDERS_KEYS, ORDERS_COLUMNS_EXACT)
RULES_J = sql.joined(ORDERS_KEYS, ORDERS_COLUMNS_RULES)
EXACT = sql.with_(ORDERS_SQL, EXACT_J)
RULES = sql.with_(ORDERS_SQL, RULES_J)
DIFFERING = "(mismatch OR validation_status <> 'Found in Both')"


def recon_keys_only(spark: SparkSession, sf: str) -> DataFrame:
    source, target = pairs.orders_pair(spark, sf)
    return reconcile(spark, source.select(*ORDERS_KEYS), target.select(*ORDERS_KEYS), ORDERS_KEYS).detail


def missing_in_source(spark: SparkSession, sf: str) -> DataFrame:
    return key_ops.missing_in_source(*pairs.orders_pair(spark, sf), ORDERS_KEYS)


def missing_in_target(spark: SparkSession, sf: str) -> DataFrame:
    return key_ops.missing_in_target(*pairs.orders_pair(spark, sf), ORDERS_KEYS)


def missing_composite(spark: SparkSession, sf: str) -> DataFrame:
    return key_ops.missing_in_target(*pairs.lineitem_pair(spark, sf), LINEITEM_KEYS)


def diff_key_count(spark: SparkSession, sf: str) -> DataFrame:
    return orders_rules(spark, sf).diff_keys.agg(F.count(F.lit(1)).alias("diff_keys"))


def key_profile(spark: SparkSession, sf: str) -> DataFrame:
    return key_ops.key_profile(load(spark, sf, "lineitem"), LINEITEM_KEYS)


def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return key_ops.duplicate_keys(load(spark, sf, "lineitem"), LINEITEM_KEYS)


def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    return key_ops.dedup_rows(load(spark, sf, "lineitem"), LINEITEM_KEYS)


# Null key parts: every second key has no customer, and customers make a heavily repeated key.
def null_key_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    def keyed(df: DataFrame) -> DataFrame:
        customer = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey"))
        return df.select(customer.alias("customer"), "o_orderdate", "o_orderstatus", "o_totalprice")

    source, target = pairs.orders_pair(spark, sf)
    return keyed(source), keyed(target)


NULL_KEYS_SQL = (
    ORDERS_SQL.replace("src AS", "src0 AS").replace("tgt AS", "tgt0 AS").rstrip()
    + """,
src AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS customer, o_orderdate, o_orderstatus, o_totalprice FROM src0),
tgt AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS customer, o_orderdate, o_orderstatus, o_totalprice FROM tgt0)"""
)
NULL_KEYS = ["customer", "o_orderdate"]
NULL_KEY_COLUMNS = [c for c in ORDERS_COLUMNS_EXACT if c.name in ("o_orderstatus", "o_totalprice")]
NULL_KEYS_J = sql.joined(NULL_KEYS, NULL_KEY_COLUMNS)


def null_keys(spark: SparkSession, sf: str) -> ReconResult:
    return reconcile(spark, *null_key_pair(spark, sf), NULL_KEYS, pairs.ORDERS_EXACT)


# A key that nearly all rows share: the order status, with a few values for the whole table.
def hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    source, target = pairs.orders_pair(spark, sf)
    return summary_of(reconcile(spark, source, target, ["o_orderstatus"], pairs.ORDERS_EXACT))


HOT_COLUMNS = [
    sql.Col("o_orderkey"),
    *[c for c in ORDERS_COLUMNS_EXACT if c.name != "o_orderstatus"],
]


def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    source, target = pairs.orders_pair(spark, sf)
    target = target.drop("o_orderpriority").withColumn("Load Batch", F.lit("b1"))
    result = reconcile(spark, source, target, ORDERS_KEYS, pairs.ORDERS_EXACT)
    return result.summary.select(
        "source_count",
        "target_count",
        "mismatched_rows",
        F.array_join("source_only_columns", ",").alias("source_only"),
        F.array_join("target_only_columns", ",").alias("target_only"),
    )


DRIFT_COLUMNS = [c for c in ORDERS_COLUMNS_EXACT if c.name != "o_orderpriority"]


# Different types on the two sides: numbers against their text form.
def mixed_types(spark: SparkSession, sf: str) -> DataFrame:
    source, target = pairs.orders_pair(spark, sf)
    target = target.withColumn("o_custkey", F.col("o_custkey").cast("int")).withColumn(
        "o_totalprice", F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    )
    rules = CompareRules(float_epsilon=0.011, numeric_scale=2)
    return summary_of(reconcile(spark, source, target, ORDERS_KEYS, rules))


MIXED_SQL = (
    ORDERS_SQL.replace("src AS", "src0 AS").replace("tgt AS", "tgt0 AS").rstrip()
    + f""",
src AS (SELECT * REPLACE ({pairs.MONEY.format('o_totalprice')} AS o_totalprice) FROM src0),
tgt AS (SELECT * REPLACE ({pairs.MONEY.format('o_totalprice')} AS o_totalprice) FROM tgt0)"""
)
MIXED_COLUMNS = [
    sql.Col("o_custkey", also="abs({s} - {t}) <= 0.011"),
    sql.Col("o_orderstatus", norm="coalesce({}, '')"),
    sql.Col("o_totalprice", norm="coalesce({}, '')", also=sql.text_within(0.011)),
    sql.Col("o_orderdate"),
    sql.Col("o_orderpriority", norm="coalesce({}, '')"),
]


def summary_table(spark: SparkSession, sf: str) -> DataFrame:
    result = orders_rules(spark, sf)
    return summary_metrics(result.summary, result.keys, result.columns)


_METRICS = f"""
SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS position,
       unnest(['Total Source Rows', 'Total Target Rows', 'Matching Rows', 'Mismatch Rows', 'Missing in Source',
               'Missing in Target', 'Match Percentage', 'Primary Keys', 'Columns Compared', 'Column Names']) AS metric,
       unnest([CAST(source_count AS VARCHAR), CAST(target_count AS VARCHAR), CAST(matching_rows AS VARCHAR),
               CAST(mismatched_rows AS VARCHAR), CAST(missing_in_source AS VARCHAR), CAST(missing_in_target AS VARCHAR),
               printf('%.2f', match_percentage) || '%', 'o_orderkey', '5',
               'o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority']) AS value
FROM ({sql.SUMMARY})
"""


def _ordered_sql(select: str, where: str = DIFFERING, cap: int | None = None) -> str:
    return f"""SELECT {select} FROM (
  SELECT *, row_number() OVER (ORDER BY {sql.RANK}, {', '.join(ORDERS_KEYS)}) AS _pos FROM j WHERE {where})
WHERE {'true' if cap is None else f'_pos <= {cap}'}"""


def report_capped(spark: SparkSession, sf: str) -> DataFrame:
    """A listing cut to its first rows in report order."""
    detail = orders_rules(spark, sf).detail
    return one_side_table(in_report_order(detail, ORDERS_KEYS, cap=100), ORDERS_KEYS, "target")


# Keys and values beyond what floating point tells apart: whole numbers against wide decimals.
WIDE = 2**53


def wide_keys(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    key, customer = F.col("o_orderkey") + F.lit(WIDE), F.col("o_custkey") + F.lit(WIDE)
    source = orders.select(key.alias("k"), customer.alias("c"))
    changed = F.when(pairs.every(10, 3, "o_orderkey"), customer + 1).otherwise(customer)
    target = orders.filter(~pairs.every(97, 0, "o_orderkey")).select(
        key.cast("decimal(38,0)").alias("k"), changed.cast("decimal(38,0)").alias("c")
    )
    return summary_of(reconcile(spark, source, target, ["k"]))


WIDE_SQL = f"""
src AS (SELECT CAST(o_orderkey + {WIDE} AS HUGEINT) AS k, CAST(o_custkey + {WIDE} AS HUGEINT) AS c FROM orders),
tgt AS (
  SELECT CAST(o_orderkey + {WIDE} AS HUGEINT) AS k,
         CAST(o_custkey + {WIDE} + CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS HUGEINT) AS c
  FROM orders WHERE o_orderkey % 97 <> 0)
"""


def decimal_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    """Decimals of 23 digits that differ by less than the tolerance, and by more."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    large = (price + F.lit("100000000000000000000").cast("decimal(30,2)")).cast("decimal(30,2)")
    step = F.when(pairs.every(10, 1, "o_orderkey"), F.lit("0.01")).when(pairs.every(10, 2, "o_orderkey"), F.lit("1"))
    moved = (large + F.coalesce(step, F.lit("0")).cast("decimal(10,2)")).cast("decimal(30,2)")
    orders = load(spark, sf, "orders")
    source, target = (orders.select("o_orderkey", p.alias("price")) for p in (large, moved))
    return summary_of(reconcile(spark, source, target, ORDERS_KEYS, CompareRules(float_epsilon=0.011)))


DECIMAL_SQL = """
src AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST('100000000000000000000' AS DECIMAL(30,2)) AS DECIMAL(30,2)) AS price FROM orders),
tgt AS (
  SELECT o_orderkey, CAST(price + CASE o_orderkey % 10 WHEN 1 THEN CAST('0.01' AS DECIMAL(10,2))
    WHEN 2 THEN CAST('1' AS DECIMAL(10,2)) ELSE CAST('0' AS DECIMAL(10,2)) END AS DECIMAL(30,2)) AS price FROM src)
"""


def date_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """A date on one side, a timestamp on the other; some of those are not at midnight."""
    day = F.col("o_orderdate").cast("date")
    source = load(spark, sf, "orders").select("o_orderkey", day.alias("placed"))
    at = day.cast("timestamp_ntz")
    later = F.when(pairs.every(10, 4, "o_orderkey"), at + F.expr("INTERVAL 1 HOUR")).otherwise(at)
    target = load(spark, sf, "orders").select("o_orderkey", later.alias("placed"))
    return summary_of(reconcile(spark, source, target, ORDERS_KEYS))


DATE_SQL = """
src AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS placed FROM orders),
tgt AS (
  SELECT o_orderkey, placed + CASE WHEN o_orderkey % 10 = 4 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS placed FROM src)
"""


def report_source_target(spark: SparkSession, sf: str) -> DataFrame:
    return source_target_table(in_report_order(orders_rules(spark, sf).detail, ORDERS_KEYS), ORDERS_KEYS)


def report_source_data(spark: SparkSession, sf: str) -> DataFrame:
    return one_side_table(in_report_order(orders_rules(spark, sf).detail, ORDERS_KEYS), ORDERS_KEYS, "source")


def report_target_data(spark: SparkSession, sf: str) -> DataFrame:
    return one_side_table(in_report_order(orders_rules(spark, sf).detail, ORDERS_KEYS), ORDERS_KEYS, "target")


def report_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    detail = mismatches_only(orders_rules(spark, sf).detail)
    return mismatch_table(in_report_order(detail, ORDERS_KEYS), ORDERS_KEYS)


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    return search_rows(orders_rules(spark, sf).detail, "urgent", status="Found in Both")


_NAMES = [c.name for c in ORDERS_COLUMNS_RULES]
_CELLS = sql.triplets(ORDERS_COLUMNS_RULES)

_LONG = " UNION ALL ".join(
    f"SELECT validation_status, o_orderkey, '{n}' AS column_name, {n}_status AS cell_status, "
    f"{n}_source AS source_value, {n}_target AS target_value FROM j WHERE {DIFFERING} AND {n}_status <> 'MATCH'"
    for n in _NAMES
)


def _column_stats_sql(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS column_name, count(*) AS compared, count(*) FILTER ({n}_m) AS matching,
       count(*) FILTER (NOT {n}_m) AS mismatched,
       CASE WHEN count(*) > 0 THEN count(*) FILTER ({n}_m) / count(*) * 100 ELSE 0.0 END AS match_percentage
FROM j WHERE validation_status = 'Found in Both'"""
        for n in names
    )


_PER_STATUS = f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY validation_status ORDER BY o_orderkey) AS _k FROM j WHERE {DIFFERING})
WHERE _k <= 500"""

_SEARCH = " || ' ' || ".join(
    [f"coalesce({n}, '')" for n in ["validation_status", "CAST(o_orderkey AS VARCHAR)"]]
    + [f"coalesce({n}_{p}, '')" for n in _NAMES for p in ("status", "source", "target")]
)

_SAMPLE_COLUMNS = ", ".join(f"{n}_source, {n}_target, 'MATCH' AS {n}_status" for n in _NAMES)

QUERIES = {
    "recon_summary": (lambda s, d: summary_of(orders_exact(s, d)), EXACT + sql.SUMMARY),
    "recon_summary_rules": (lambda s, d: summary_of(orders_rules(s, d)), RULES + sql.SUMMARY),
    "recon_unique_keys": (lambda s, d: summary_of(orders_rules(s, d, unique_keys=True)), RULES + sql.SUMMARY),
    "recon_detail": (lambda s, d: orders_rules(s, d).detail, RULES + sql.detail(ORDERS_KEYS, ORDERS_COLUMNS_RULES)),
    "recon_detail_exact": (
        lambda s, d: orders_rules(s, d).detail_exact,
        RULES
        + sql.detail(ORDERS_KEYS, ORDERS_COLUMNS_RULES, "mismatch_exact OR validation_status <> 'Found in Both'"),
    ),
    "recon_detail_long": (lambda s, d: orders_rules(s, d).detail_long, RULES + _LONG),
    "recon_detail_capped": (
        lambda s, d: orders_rules(s, d).detail_report(cap=500, per_status=500),
        RULES
        + f"""SELECT validation_status, o_orderkey, {_CELLS} FROM (
  SELECT *, row_number() OVER (ORDER BY {sql.RANK}, o_orderkey) AS _pos FROM ({_PER_STATUS}))
WHERE _pos <= 500""",
    ),
    "recon_detail_per_status": (
        lambda s, d: orders_rules(s, d).detail_report(cap=None, per_status=500),
        RULES + f"SELECT validation_status, o_orderkey, {_CELLS} FROM ({_PER_STATUS})",
    ),
    "recon_keys_only": (
        recon_keys_only,
        sql.with_(ORDERS_SQL, sql.joined(ORDERS_KEYS, [])) + sql.detail(ORDERS_KEYS, []),
    ),
    "missing_in_source": (
        missing_in_source,
        sql.with_(ORDERS_SQL) + "SELECT o_orderkey FROM tgt EXCEPT SELECT o_orderkey FROM src",
    ),
    "missing_in_target": (
        missing_in_target,
        sql.with_(ORDERS_SQL) + "SELECT o_orderkey FROM src EXCEPT SELECT o_orderkey FROM tgt",
    ),
    "missing_composite": (
        missing_composite,
        sql.with_(LINEITEM_SQL)
        + "SELECT l_orderkey, l_linenumber FROM src EXCEPT SELECT l_orderkey, l_linenumber FROM tgt",
    ),
    "diff_keys": (
        lambda s, d: orders_rules(s, d).diff_keys,
        RULES
        + """SELECT validation_status, o_orderkey FROM j WHERE mismatch
UNION ALL SELECT 'Missing in Source', o_orderkey FROM (SELECT o_orderkey FROM tgt EXCEPT SELECT o_orderkey FROM src)
UNION ALL SELECT 'Missing in Target', o_orderkey FROM (SELECT o_orderkey FROM src EXCEPT SELECT o_orderkey FROM tgt)""",
    ),
    "diff_key_count": (diff_key_count, RULES + f"SELECT count(*) AS diff_keys FROM j WHERE {DIFFERING}"),
    "recon_composite": (
        lambda s, d: summary_of(conversations(s, d)),
        sql.with_(CONVERSATIONS_SQL, sql.joined(CONVERSATION_KEYS, CONVERSATION_COLUMNS)) + sql.SUMMARY,
    ),
    "recon_composite_detail": (
        lambda s, d: conversations(s, d).detail,
        sql.with_(CONVERSATIONS_SQL, sql.joined(CONVERSATION_KEYS, CONVERSATION_COLUMNS))
        + sql.detail(CONVERSATION_KEYS, CONVERSATION_COLUMNS),
    ),
    "recon_null_keys": (
        lambda s, d: summary_of(null_keys(s, d)),
        sql.with_(NULL_KEYS_SQL, NULL_KEYS_J) + sql.SUMMARY,
    ),
    "recon_null_keys_detail": (
        lambda s, d: null_keys(s, d).detail,
        sql.with_(NULL_KEYS_SQL, NULL_KEYS_J) + sql.detail(NULL_KEYS, NULL_KEY_COLUMNS),
    ),
    "recon_hot_keys": (
        hot_keys,
        sql.with_(ORDERS_SQL, sql.joined(["o_orderstatus"], HOT_COLUMNS)) + sql.SUMMARY,
    ),
    "recon_schema_drift": (
        schema_drift,
        sql.with_(ORDERS_SQL, sql.joined(ORDERS_KEYS, DRIFT_COLUMNS))
        + f"SELECT source_count, target_count, mismatched_rows, 'o_orderpriority' AS source_only, "
        f"'load_batch' AS target_only FROM ({sql.SUMMARY})",
    ),
    "recon_mixed_types": (
        mixed_types,
        sql.with_(MIXED_SQL, sql.joined(ORDERS_KEYS, MIXED_COLUMNS)) + sql.SUMMARY,
    ),
    "events_recon": (
        lambda s, d: summary_of(events(s, d)),
        sql.with_(EVENTS_SQL, sql.joined(EVENT_KEYS, EVENT_COLUMNS)) + sql.SUMMARY,
    ),
    "events_recon_detail": (
        lambda s, d: events(s, d).detail,
        sql.with_(EVENTS_SQL, sql.joined(EVENT_KEYS, EVENT_COLUMNS)) + sql.detail(EVENT_KEYS, EVENT_COLUMNS),
    ),
    "key_profile": (
        key_profile,
        """SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicate_keys,
       CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, max(n) AS max_copies
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    ),
    "duplicate_keys": (
        duplicate_keys,
        """SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    ),
    "dedup_rows": (
        dedup_rows,
        """SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
             l_shipdate) AS _rn FROM lineitem) WHERE _rn = 1""",
    ),
    "recon_duplicates": (
        lambda s, d: summary_of(lineitem(s, d)),
        sql.with_(LINEITEM_SQL, sql.joined(LINEITEM_KEYS, LINEITEM_COLUMNS)) + sql.SUMMARY,
    ),
    "recon_duplicates_detail": (
        lambda s, d: lineitem(s, d).detail,
        sql.with_(LINEITEM_SQL, sql.joined(LINEITEM_KEYS, LINEITEM_COLUMNS))
        + sql.detail(LINEITEM_KEYS, LINEITEM_COLUMNS),
    ),
    "recon_duplicate_keys": (
        lambda s, d: lineitem(s, d).duplicate_keys,
        sql.with_(LINEITEM_SQL, sql.joined(LINEITEM_KEYS, []))
        + "SELECT l_orderkey, l_linenumber, n_s AS source_rows, n_t AS target_rows FROM j WHERE n_s > 1 OR n_t > 1",
    ),
    "column_stats": (lambda s, d: orders_rules(s, d).column_stats, RULES + _column_stats_sql(_NAMES)),
    "status_distribution": (
        lambda s, d: orders_rules(s, d).status_counts,
        RULES
        + """SELECT validation_status, count(*) AS row_count, count(*) FILTER (mismatch) AS mismatched_rows
FROM j GROUP BY validation_status""",
    ),
    "sample_matches": (
        lambda s, d: orders_rules(s, d).sample(500),
        RULES
        + f"""SELECT o_orderkey, {_SAMPLE_COLUMNS} FROM j
WHERE validation_status = 'Found in Both' AND NOT mismatch ORDER BY o_orderkey LIMIT 500""",
    ),
    "summary_metrics": (summary_table, RULES + _METRICS),
    "report_source_target": (
        report_source_target,
        RULES
        + _ordered_sql(
            "o_orderkey, " + ", ".join([f"{n}_source" for n in _NAMES] + [f"{n}_target" for n in _NAMES])
        ),
    ),
    "report_source_data": (
        report_source_data,
        RULES + _ordered_sql("o_orderkey, " + ", ".join(f"{n}_source AS {n}" for n in _NAMES)),
    ),
    "report_target_data": (
        report_target_data,
        RULES + _ordered_sql("o_orderkey, " + ", ".join(f"{n}_target AS {n}" for n in _NAMES)),
    ),
    "report_mismatches": (
        report_mismatches,
        RULES
        + _ordered_sql(
            "o_orderkey, validation_status, "
            + ", ".join(f"{n}_{p}" for n in _NAMES for p in ("source", "target", "status")),
            "mismatch",
        ),
    ),
    "report_capped": (
        report_capped,
        RULES + _ordered_sql("o_orderkey, " + ", ".join(f"{n}_target AS {n}" for n in _NAMES), cap=100),
    ),
    "recon_wide_keys": (wide_keys, sql.with_(WIDE_SQL, sql.joined(["k"], [sql.Col("c")])) + sql.SUMMARY),
    "recon_decimal_epsilon": (
        decimal_epsilon,
        sql.with_(
            DECIMAL_SQL, sql.joined(ORDERS_KEYS, [sql.Col("price", also="abs({s} - {t}) <= CAST('0.011' AS DECIMAL(10,3))")])
        )
        + sql.SUMMARY,
    ),
    "recon_date_timestamp": (
        date_timestamp,
        sql.with_(DATE_SQL, sql.joined(ORDERS_KEYS, [sql.Col("placed")])) + sql.SUMMARY,
    ),
    "search_results": (
        search_results,
        RULES
        + f"""SELECT validation_status, o_orderkey, {_CELLS} FROM j
WHERE mismatch AND contains(lower({_SEARCH}), 'urgent')""",
    ),
}
