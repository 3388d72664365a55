"""Queries for single comparison rules and scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.catalog import pairs, sql
from twinledger.catalog.pairs import load
from twinledger.functions import chardiff, compare, fmt, normalize
from twinledger.operators.file_names import compare_name_components
from twinledger.operators.lines import compare_lines, line_match_counts
from twinledger.operators.reconcile import reconcile
from twinledger.plans.history import REPORT_TTL_SECONDS, latest, within_age
from twinledger.spec import CompareRules

# -- trimming: all four kinds on differently padded part names ---------------------------------

TRIM_RULES = CompareRules(
    ltrim_columns=("left_name",),
    rtrim_columns=("Right Name",),
    trim_columns=("both_name", "left_name"),
    trim_strings=True,
    treat_null_as_empty=False,
)


def trim_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = load(spark, sf, "part")
    name, key = F.col("p_name"), F.col("p_partkey")
    padded = (
        F.when(key % 4 == 0, F.concat(F.lit("  "), name))
        .when(key % 4 == 1, F.concat(name, F.lit(" \u00a0")))
        .when(key % 4 == 2, F.concat(F.lit("\u2003"), name, F.lit("  ")))
        .otherwise(F.concat(F.lit("\t"), name))
    )
    columns = ["left_name", "right_name", "both_name", "any_name"]
    source = part.select("p_partkey", *[name.alias(c) for c in columns])
    target = part.select("p_partkey", *[padded.alias(c) for c in columns])
    return source, target


def trim_rules(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile(spark, *trim_pair(spark, sf), ["p_partkey"], TRIM_RULES).detail


_PADDED = """CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name WHEN 1 THEN p_name || ' ' || chr(160)
  WHEN 2 THEN chr(8195) || p_name || '  ' ELSE chr(9) || p_name END"""
_TRIM_NAMES = {"left_name": "ltrim({})", "right_name": "rtrim({})", "both_name": "trim({})", "any_name": "trim({})"}
_TRIM_COLUMNS = [sql.Col(n, norm=f) for n, f in _TRIM_NAMES.items()]
TRIM_SQL = (
    sql.with_(
        "src AS (SELECT p_partkey, " + ", ".join(f"p_name AS {n}" for n in _TRIM_NAMES) + " FROM part)",
        "tgt AS (SELECT p_partkey, " + ", ".join(f"{_PADDED} AS {n}" for n in _TRIM_NAMES) + " FROM part)",
        sql.joined(["p_partkey"], _TRIM_COLUMNS),
    )
    + sql.detail(["p_partkey"], _TRIM_COLUMNS)
)


# -- case and accents: whole texts -------------------------------------------------------------


def case_rules(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id",
        normalize.upper(text).alias("upper_text"),
        normalize.lower(text).alias("lower_text"),
        normalize.lower(normalize.upper(text)).alias("both_text"),
    )


def case_recon(spark: SparkSession, sf: str) -> DataFrame:
    """Upper and lower rules as part of a comparison: role case differs for some turns."""
    source, target = pairs.conversations_pair(spark, sf)
    rules = CompareRules(upper_columns=("Role",), lower_columns=("role", "text"))
    return reconcile(spark, source, target, pairs.CONVERSATION_KEYS, rules).detail


_CASE_COLUMNS = [
    sql.Col("role", norm="coalesce(lower(upper({})), '')"),
    sql.Col("text", norm="coalesce(lower({}), '')"),
]


def accent_rule(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(
        "doc_id", normalize.strip_accents(F.col("text")).alias("plain_text")
    )


def accent_jamo(spark: SparkSession, sf: str) -> DataFrame:
    """Syllables written as letters, among other text: composed as the accents go."""
    n = F.col("doc_id")
    letters = [normalize.LEADS + n % 20, normalize.VOWELS - 1 + n % 23, normalize.TAILS - 1 + n % 30]
    jamo = F.concat(*[F.decode(F.unhex(F.hex(code.cast("bigint"))), "UTF-16BE") for code in letters])
    text = F.concat(F.lit("caf\u00e9 "), jamo, jamo, F.lit("\uac00\u11a8\u1100 "), F.substring("text", 1, 40), jamo)
    return load(spark, sf, "documents").select("doc_id", normalize.strip_accents(text).alias("plain_text"))


ACCENT_JAMO_SQL = """WITH j AS (SELECT doc_id, text,
  chr(CAST(4352 + doc_id % 20 AS INTEGER)) || chr(CAST(4448 + doc_id % 23 AS INTEGER)) || chr(CAST(4518 + doc_id % 30 AS INTEGER)) AS jamo
  FROM documents)
SELECT doc_id, strip_accents('caf' || chr(233) || ' ' || jamo || jamo || chr(44032) || chr(4520) || chr(4352) || ' '
  || substr(text, 1, 40) || jamo) AS plain_text FROM j"""


def float_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers and decimals against doubles: neighbours beyond 2^53 differ, equal values match."""
    orders = load(spark, sf, "orders")
    key = F.col("o_orderkey")
    large = F.lit(2**53).cast("bigint") + key
    source = orders.select("o_orderkey", large.alias("whole"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    target = orders.select("o_orderkey", large.cast("double").alias("whole"), F.col("o_totalprice").cast("double").alias("price"))
    return reconcile(spark, source, target, ["o_orderkey"]).column_stats.select(
        "column_name", "compared", "matching", "mismatched"
    )


FLOAT_EXACT_SQL = """WITH c AS (SELECT o_orderkey % 2 = 0 AS whole,
  CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR::DOUBLE = o_totalprice::DOUBLE AS price FROM orders)
SELECT 'whole' AS column_name, count(*) AS compared, count(*) FILTER (whole) AS matching,
  count(*) FILTER (NOT whole) AS mismatched FROM c
UNION ALL SELECT 'price', count(*), count(*) FILTER (price), count(*) FILTER (NOT price) FROM c"""


def accent_recon(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against a copy whose e-acute lost its accent: equal under the rule."""
    source = load(spark, sf, "documents").select("doc_id", "text", "lang")
    target = source.withColumn("text", F.translate("text", "éÉ", "eE"))
    rules = CompareRules(strip_accents_columns=("text",))
    exact = reconcile(spark, source, target, ["doc_id"]).summary
    ruled = reconcile(spark, source, target, ["doc_id"], rules).summary
    return exact.select(F.lit("exact").alias("rule"), "matching_rows", "mismatched_rows").unionByName(
        ruled.select(F.lit("accents").alias("rule"), "matching_rows", "mismatched_rows")
    )


_ACCENT_PAIR = """src AS (SELECT doc_id, text, lang FROM documents),
tgt AS (SELECT doc_id, replace(replace(text, 'é', 'e'), 'É', 'E') AS text, lang FROM documents)"""


def _accent_sql(name: str, norm: str) -> str:
    columns = [sql.Col("text", norm=norm), sql.Col("lang")]
    return (
        f"SELECT '{name}' AS rule, matching_rows, mismatched_rows FROM ("
        + sql.with_(_ACCENT_PAIR, sql.joined(["doc_id"], columns))
        + sql.SUMMARY
        + ")"
    )


# -- null as empty -----------------------------------------------------------------------------


def null_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = pairs.orders_text(load(spark, sf, "orders"))
    number = F.col("o_orderkey").cast("bigint")
    priority = F.col("o_orderpriority")
    source = orders.select(
        "o_orderkey", F.when(number % 6 < 2, F.lit(None)).when(number % 6 == 2, F.lit("")).otherwise(priority).alias("note")
    )
    target = orders.select(
        "o_orderkey",
        F.when(number % 6 == 0, F.lit("")).when(number % 6 == 1, F.lit("NULL")).when(number % 6 == 2, F.lit(None)).otherwise(priority).alias("note"),
    )
    return source, target


_NULL_PAIR = """src AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderkey % 6 < 2 THEN NULL WHEN o_orderkey % 6 = 2 THEN '' ELSE o_orderpriority END AS note FROM orders),
tgt AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'NULL' WHEN 2 THEN NULL ELSE o_orderpriority END AS note FROM orders)"""


def null_as_empty(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile(spark, *null_pair(spark, sf), ["o_orderkey"]).detail


def null_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rules = CompareRules(treat_null_as_empty=False)
    return reconcile(spark, *null_pair(spark, sf), ["o_orderkey"], rules).detail


def _null_sql(norm: str) -> str:
    columns = [sql.Col("note", norm=norm)]
    return sql.with_(_NULL_PAIR, sql.joined(["o_orderkey"], columns)) + sql.detail(["o_orderkey"], columns)


# -- tolerance and timestamps on text ----------------------------------------------------------


def float_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    """Prices in several spellings of numbers, some of them no numbers at all."""
    orders = load(spark, sf, "orders")
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    near = (F.col("o_totalprice").cast("decimal(18,2)") + F.lit("0.01").cast("decimal(18,2)")).cast("string")
    source = orders.select("o_orderkey", price.alias("amount"))
    target = orders.select(
        "o_orderkey",
        F.when(key % 7 == 0, F.concat(F.lit(" "), price, F.lit("0 ")))
        .when(key % 7 == 1, near)
        .when(key % 7 == 2, F.concat(price, F.lit("d")))
        .when(key % 7 == 3, F.concat(F.lit("+"), price, F.lit("e0")))
        .when(key % 7 == 4, F.lit("nan"))
        .when(key % 7 == 5, F.lit(None).cast("string"))
        .otherwise(price)
        .alias("amount"),
    )
    return reconcile(spark, source, target, ["o_orderkey"], CompareRules(float_epsilon=0.005)).detail


_EPSILON_COLUMNS = [sql.Col("amount", norm="coalesce({}, '')", also=sql.text_within(0.005))]
_EPSILON_PAIR = f"""src AS (SELECT o_orderkey, {pairs.MONEY.format('o_totalprice')} AS amount FROM orders),
tgt AS (SELECT o_orderkey, CASE o_orderkey % 7
  WHEN 0 THEN ' ' || {pairs.MONEY.format('o_totalprice')} || '0 '
  WHEN 1 THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 0.01 AS DECIMAL(18,2)) AS VARCHAR)
  WHEN 2 THEN {pairs.MONEY.format('o_totalprice')} || 'd'
  WHEN 3 THEN '+' || {pairs.MONEY.format('o_totalprice')} || 'e0'
  WHEN 4 THEN 'nan' WHEN 5 THEN NULL ELSE {pairs.MONEY.format('o_totalprice')} END AS amount FROM orders)"""


def timestamp_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates in several spellings, some of them no full dates."""
    orders = load(spark, sf, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    stamp = day.cast("string")
    date = F.substring(stamp, 1, 10)
    source = orders.select("o_orderkey", stamp.alias("ordered"))
    target = orders.select(
        "o_orderkey",
        F.when(key % 8 == 0, date)
        .when(key % 8 == 1, F.concat(date, F.lit("T00:00")))
        .when(key % 8 == 2, F.replace(date, F.lit("-"), F.lit("/")))
        .when(key % 8 == 3, F.substring(stamp, 1, 7))
        .when(key % 8 == 4, F.concat(date, F.lit(" 00:00:00.000")))
        .when(key % 8 == 5, F.concat(date, F.lit(" 00:00:01")))
        .when(key % 8 == 6, F.replace(date, F.lit("-"), F.lit("")))
        .otherwise(stamp)
        .alias("ordered"),
    )
    return reconcile(spark, source, target, ["o_orderkey"], CompareRules(normalize_dates=True)).detail


_STAMP = "CAST(o_orderdate AS VARCHAR)"
_TIME_PAIR = f"""src AS (SELECT o_orderkey, {_STAMP} AS ordered FROM orders),
tgt AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN {_STAMP}[1:10] WHEN 1 THEN {_STAMP}[1:10] || 'T00:00'
  WHEN 2 THEN replace({_STAMP}[1:10], '-', '/') WHEN 3 THEN {_STAMP}[1:7]
  WHEN 4 THEN {_STAMP}[1:10] || ' 00:00:00.000' WHEN 5 THEN {_STAMP}[1:10] || ' 00:00:01'
  WHEN 6 THEN replace({_STAMP}[1:10], '-', '') ELSE {_STAMP} END AS ordered FROM orders)"""
_TIME_COLUMNS = [
    sql.Col(
        "ordered",
        norm="coalesce({}, '')",
        also=sql.same_time()
        .replace("{s}", "regexp_replace({s}, '^(....)/(..)/(..)', '\\1-\\2-\\3')")
        .replace("{t}", "regexp_replace({t}, '^(....)/(..)/(..)', '\\1-\\2-\\3')"),
    )
]


def text_pair_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All rules at once on orders in text form, as files deliver them."""
    rules = CompareRules(
        float_epsilon=0.011, trim_strings=True, normalize_dates=True, upper_columns=("o_orderstatus",)
    )
    return reconcile(spark, *pairs.orders_text_pair(spark, sf), ["o_orderkey"], rules).detail


def _text_rule(name: str, norm: str) -> sql.Col:
    return sql.Col(name, norm=norm, also=f"({sql.text_within(0.011)}) OR coalesce({sql.same_time()}, false)")


TEXT_COLUMNS = [
    _text_rule("o_custkey", "coalesce(trim({}), '')"),
    _text_rule("o_orderstatus", "coalesce(upper(trim({})), '')"),
    _text_rule("o_totalprice", "coalesce(trim({}), '')"),
    _text_rule("o_orderdate", "coalesce(trim({}), '')"),
    _text_rule("o_orderpriority", "coalesce(trim({}), '')"),
]


def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The number and timestamp readings of every word-like value in the parts table."""
    part = load(spark, sf, "part")
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return part.select(
        "p_partkey",
        compare.number_from_text(F.col("p_brand")).alias("brand_number"),
        compare.number_from_text(price).alias("price_number"),
        compare.number_from_text(F.concat(F.lit(" ."), size)).alias("fraction"),
        compare.number_from_text(F.concat(size, F.lit("_000"))).alias("thousands"),
        compare.timestamp_from_text(F.concat(F.lit("2024-1-"), size)).alias("day"),
    )


# -- character and line differences ------------------------------------------------------------


def char_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Every differing character of whole conversation texts against a changed copy."""
    source, target = pairs.conversations_pair(spark, sf)
    both = source.select("conv_id", "turn", F.col("text").alias("s")).join(
        target.select("conv_id", "turn", F.concat(F.col("text"), F.lit("!")).alias("t")), ["conv_id", "turn"]
    )
    diffs = both.select("conv_id", "turn", F.inline(chardiff.char_diff(F.col("s"), F.col("t"))))
    return diffs


_CHAR_DIFF_SQL = (
    sql.with_(pairs.CONVERSATIONS_SQL)
    + """, chars AS (
  SELECT conv_id, turn, string_split(s.text, '') AS s, string_split(t.text || '!', '') AS t
  FROM src s JOIN tgt t USING (conv_id, turn)),
placed AS (
  SELECT conv_id, turn, s, t, unnest(range(greatest(len(s), len(t)))) AS pos FROM chars)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, s[pos + 1] AS src, t[pos + 1] AS tgt, false AS match
FROM placed WHERE s[pos + 1] IS DISTINCT FROM t[pos + 1]"""
)


def _order_lines(df: DataFrame, changed: bool) -> DataFrame:
    fields = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    text = pairs.orders_text(df)
    number = F.col("o_orderkey").cast("bigint")
    kept = text.filter(~((number % 53 == 1) & (number > 0))) if changed else text
    return kept.select((number + 1).alias("line_number"), fields.alias("line"))


def _line_pair(spark: SparkSession, sf: str) -> DataFrame:
    source, target = pairs.orders_pair(spark, sf)
    return compare_lines(_order_lines(source, False), _order_lines(target, True))


def line_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered lines of orders against those of the changed copy, with their first difference."""
    return _line_pair(spark, sf).drop("char_diffs")


def line_match(spark: SparkSession, sf: str) -> DataFrame:
    return line_match_counts(_line_pair(spark, sf))


def _line_sql(table: str) -> str:
    line = (
        "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)), o_orderpriority)"
    )
    return f"SELECT o_orderkey + 1 AS n, {line} AS line FROM {table}"


_LINES_CTE = (
    sql.with_(pairs.ORDERS_SQL)
    + f""", s AS ({_line_sql('src')}), t AS ({_line_sql('tgt')} WHERE NOT (o_orderkey % 53 = 1)),
p AS (
  SELECT coalesce(s.n, t.n) AS n, s.line AS sl, t.line AS tl, string_split(s.line, '') AS sc, string_split(t.line, '') AS tc
  FROM s FULL OUTER JOIN t ON s.n = t.n),
d AS (
  SELECT *, CASE WHEN sl IS NOT DISTINCT FROM tl THEN 'MATCH' WHEN sl IS NULL THEN 'Missing in Source'
                 WHEN tl IS NULL THEN 'Missing in Target' ELSE 'MISMATCH' END AS status
  FROM p),
f AS (
  SELECT *, CASE WHEN status = 'MISMATCH'
    THEN list_filter(range(greatest(len(sc), len(tc))), lambda i: sc[i + 1] IS DISTINCT FROM tc[i + 1])
    ELSE [] END AS diffs FROM d)
"""
)


# -- formatting --------------------------------------------------------------------------------


def format_bytes(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("n_chars")
    return load(spark, sf, "documents").select(
        "doc_id",
        fmt.format_bytes(size).alias("si"),
        fmt.format_bytes(size, binary=True).alias("iec"),
        fmt.format_bytes(-size * 1_000_000_007).alias("large"),
        fmt.format_bytes(size * size, decimals=1, binary=True).alias("squared"),
    )


def _bytes_sql(value: str, base: int, decimals: int, units: tuple[str, ...]) -> str:
    ladder = " ".join(
        f"WHEN abs({value}) >= {float(base) ** p} THEN printf('%.{decimals}f', abs({value}) / {float(base) ** p}::DOUBLE) || ' {units[p - 1]}'"
        for p in range(len(units), 0, -1)
    )
    return (
        f"CASE WHEN {value} < 0 THEN '-' ELSE '' END || "
        f"CASE WHEN abs({value}) < {base} THEN CAST(abs({value}) AS BIGINT) || ' B' {ladder} END"
    )


FORMAT_BYTES_SQL = f"""SELECT doc_id, {_bytes_sql('n_chars', 1000, 2, fmt.SI_UNITS)} AS si,
  {_bytes_sql('n_chars', 1024, 2, fmt.IEC_UNITS)} AS iec,
  {_bytes_sql('(-n_chars * 1000000007)', 1000, 2, fmt.SI_UNITS)} AS large,
  {_bytes_sql('(n_chars * n_chars)', 1024, 1, fmt.IEC_UNITS)} AS squared
FROM documents"""


def format_duration(spark: SparkSession, sf: str) -> DataFrame:
    """Time from the start of the year to each event, and the event's own value as seconds."""
    seconds = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 1_000_000
    zero = F.lit(0.0)
    return load(spark, sf, "events").select(
        "event_id",
        fmt.format_duration(zero, seconds).alias("since_new_year"),
        fmt.format_duration(zero, F.col("value")).alias("value_as_time"),
        fmt.format_duration(F.col("value"), F.col("value") * 100).alias("scaled"),
    )


def _duration_sql(seconds: str) -> str:
    t = f"CAST(round_even({seconds}, 0) AS BIGINT)"
    d, h, m, s = f"{t} // 86400", f"({t} % 86400) // 3600", f"({t} % 3600) // 60", f"{t} % 60"
    return f"""CASE WHEN {t} >= 86400 THEN ({d}) || ' days ' ELSE '' END
  || CASE WHEN {t} >= 3600 THEN ({h}) || ' hours ' ELSE '' END
  || CASE WHEN {t} >= 60 THEN ({m}) || ' min ' ELSE '' END || ({s}) || ' sec'"""


FORMAT_DURATION_SQL = f"""SELECT event_id,
  {_duration_sql("date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000")} AS since_new_year,
  {_duration_sql('value')} AS value_as_time,
  {_duration_sql('(value * 100 - value)')} AS scaled
FROM events"""


def render_timezones(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates and event times in UTC, India, US eastern and the session's zone."""
    orders = load(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    events = load(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    at = F.col("at")
    return orders.unionByName(events).select(
        "kind", "id", fmt.render_utc(at).alias("utc"), fmt.render_ist(at).alias("ist"), fmt.render_et(at).alias("et")
    )


TIMEZONES_SQL = """SELECT kind, id, strftime(moment, '%Y-%m-%d %H:%M:%S') || ' UTC' AS utc,
  strftime(moment AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%d %H:%M:%S') || ' IST' AS ist,
  strftime(et, '%Y-%m-%d %H:%M:%S') || CASE WHEN date_diff('hour', et, moment) = 4 THEN ' EDT' ELSE ' EST' END AS et
FROM (
  SELECT *, moment AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS et FROM (
    SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS moment FROM orders
    UNION ALL SELECT 'event', event_id, ts FROM events))"""


def run_id(spark: SparkSession, sf: str) -> DataFrame:
    """A run id for every page, as if its URL were the compared file."""
    pages = load(spark, sf, "pages")
    start = F.lit("2023-11-14 22:13:20").cast("timestamp_ntz")
    at = F.timestamp_add("SECOND", F.col("page_id") * 86_399, start)
    return pages.select("page_id", fmt.run_id(F.lit("Nightly check #1"), F.col("url"), at).alias("run_id"))


RUN_ID_SQL = r"""SELECT page_id, 'Nightly_check__1_' ||
  regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '^(.+)\.[^.]*$', '\1'), '[^\p{L}\p{N}_-]', '_', 'g')
  || '_' || strftime(TIMESTAMP '2023-11-14 22:13:20' + page_id * INTERVAL 86399 SECOND, '%Y%m%d_%H%M%S') AS run_id
FROM pages"""


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Scheme, bucket, base name and compression for paths made of every page URL."""
    pages = load(spark, sf, "pages")
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".csv.gz", ".GZIP", ".bz2", ".zip", ".Z", ".csv", "")]),
        (F.col("page_id") % 7 + 1).cast("int"),
    )
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace("url", "^https?", "gs"), suffix)).otherwise(
        F.concat(F.col("url"), suffix)
    )
    at = pages.select("page_id", path.alias("path"))
    p = F.col("path")
    return at.select(
        "page_id",
        fmt.storage_scheme(p).alias("scheme"),
        fmt.bucket_of(p).alias("bucket"),
        fmt.blob_of(p).alias("blob"),
        fmt.base_name(p).alias("filename"),
        fmt.file_stem(p).alias("stem"),
        fmt.compression_type(p).alias("compression"),
    )


PATH_PARTS_SQL = r"""SELECT page_id, lower(regexp_extract(path, '^([A-Za-z]+):', 1)) AS scheme,
  nullif(regexp_extract(path, '^gs://([^/]*)', 1), '') AS bucket,
  nullif(regexp_extract(path, '^gs://[^/]*/+(.*)$', 1), '') AS blob,
  regexp_replace(path, '^.*/', '') AS filename,
  regexp_replace(regexp_replace(path, '^.*/', ''), '^(.+)\.[^.]*$', '\1') AS stem,
  CASE WHEN lower(path) LIKE '%.gz' OR lower(path) LIKE '%.gzip' THEN 'gzip' WHEN lower(path) LIKE '%.z' THEN 'compress'
       WHEN lower(path) LIKE '%.bz2' THEN 'bzip2' WHEN lower(path) LIKE '%.zip' THEN 'zip' END AS compression
FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?', 'gs') ELSE url END
    || ['.csv.gz', '.GZIP', '.bz2', '.zip', '.Z', '.csv', ''][page_id % 7 + 1] AS path FROM pages)"""


def name_components(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's URL against a renamed copy, component by component."""
    pages = load(spark, sf, "pages").select(
        "page_id",
        F.col("url").alias("source_name"),
        F.concat(F.replace("url", F.lit("example"), F.lit("sample_site")), F.when(F.col("page_id") % 2 == 0, F.lit(".csv")).otherwise(F.lit(""))).alias("target_name"),
    )
    return compare_name_components(pages)


NAME_COMPONENTS_SQL = """WITH n AS (
  SELECT page_id, string_split_regex(url, '[_.-]') AS s,
         string_split_regex(replace(url, 'example', 'sample_site') || CASE WHEN page_id % 2 = 0 THEN '.csv' ELSE '' END, '[_.-]') AS t
  FROM pages),
p AS (SELECT page_id, s, t, unnest(range(greatest(len(s), len(t)))) AS i FROM n)
SELECT page_id, CAST(i AS INTEGER) AS position, s[i + 1] AS source_part, t[i + 1] AS target_part,
  CASE WHEN s[i + 1] = t[i + 1] THEN 'MATCH' WHEN s[i + 1] IS NULL THEN 'Missing in Source'
       WHEN t[i + 1] IS NULL THEN 'Missing in Target' ELSE 'MISMATCH' END AS status
FROM p"""


# -- latest and expired ------------------------------------------------------------------------


def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The ten latest events, as the run list shows the ten latest runs."""
    return latest(load(spark, sf, "events"), "ts", "event_id").select("event_id", "ts", "event_type")


def expire_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events not older than the report age at a fixed time."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return load(spark, sf, "events").filter(within_age(F.col("ts"), now, REPORT_TTL_SECONDS)).select("event_id", "ts")


QUERIES = {
    "trim_rules": (trim_rules, TRIM_SQL),
    "case_rules": (
        case_rules,
        "SELECT doc_id, upper(text) AS upper_text, lower(text) AS lower_text, lower(upper(text)) AS both_text FROM documents",
    ),
    "case_recon": (
        case_recon,
        sql.with_(pairs.CONVERSATIONS_SQL, sql.joined(pairs.CONVERSATION_KEYS, _CASE_COLUMNS))
        + sql.detail(pairs.CONVERSATION_KEYS, _CASE_COLUMNS),
    ),
    "accent_rule": (accent_rule, "SELECT doc_id, strip_accents(text) AS plain_text FROM documents"),
    "accent_jamo": (accent_jamo, ACCENT_JAMO_SQL),
    "recon_float_exact": (float_exact, FLOAT_EXACT_SQL),
    "accent_recon": (
        accent_recon,
        _accent_sql("exact", "coalesce({}, '')")
        + " UNION ALL "
        + _accent_sql("accents", "coalesce(strip_accents({}), '')"),
    ),
    "null_as_empty": (null_as_empty, _null_sql("coalesce({}, '')")),
    "null_distinct": (null_distinct, _null_sql("{}")),
    "float_epsilon": (
        float_epsilon,
        sql.with_(_EPSILON_PAIR, sql.joined(["o_orderkey"], _EPSILON_COLUMNS))
        + sql.detail(["o_orderkey"], _EPSILON_COLUMNS),
    ),
    "timestamp_rule": (
        timestamp_rule,
        sql.with_(_TIME_PAIR, sql.joined(["o_orderkey"], _TIME_COLUMNS)) + sql.detail(["o_orderkey"], _TIME_COLUMNS),
    ),
    "text_pair_rules": (
        text_pair_rules,
        sql.with_(pairs.ORDERS_TEXT_SQL, sql.joined(["o_orderkey"], TEXT_COLUMNS))
        + sql.detail(["o_orderkey"], TEXT_COLUMNS),
    ),
    "parse_numbers": (
        parse_numbers,
        """SELECT p_partkey, TRY_CAST(p_brand AS DOUBLE) AS brand_number,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price_number,
  TRY_CAST('.' || p_size AS DOUBLE) AS fraction, p_size * 1000::DOUBLE AS thousands,
  TRY_CAST('2024-1-' || p_size AS TIMESTAMP) AS day FROM part""",
    ),
    "char_diff": (char_diff, _CHAR_DIFF_SQL),
    "line_compare": (
        line_compare,
        _LINES_CTE
        + """SELECT CAST(n AS INTEGER) AS line_number, coalesce(sl, '') AS source, coalesce(tl, '') AS target, status,
  CAST(diffs[1] AS INTEGER) AS first_diff_pos, CAST(len(diffs) AS INTEGER) AS diff_count,
  CAST(length(coalesce(sl, '')) AS INTEGER) AS source_len, CAST(length(coalesce(tl, '')) AS INTEGER) AS target_len
FROM f""",
    ),
    "line_match": (
        line_match,
        _LINES_CTE + "SELECT count(*) AS compared, count(*) FILTER (status = 'MATCH') AS matching FROM f",
    ),
    "format_bytes": (format_bytes, FORMAT_BYTES_SQL),
    "format_duration": (format_duration, FORMAT_DURATION_SQL),
    "render_timezones": (render_timezones, TIMEZONES_SQL),
    "run_id": (run_id, RUN_ID_SQL),
    "path_parts": (path_parts, PATH_PARTS_SQL),
    "name_components": (name_components, NAME_COMPONENTS_SQL),
    "recent_runs": (
        recent_runs,
        "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10",
    ),
    "expire_runs": (
        expire_runs,
        "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 604800 SECOND",
    ),
}
