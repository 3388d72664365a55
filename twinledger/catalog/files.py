"""Queries that go through files: the given tables are written as text, then read and compared."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.catalog import pairs, sql
from twinledger.catalog.pairs import load
from twinledger.catalog.recon import RULES, summary_of
from twinledger.catalog.rules import TEXT_COLUMNS
from twinledger.operators.lines import compare_lines, number_lines
from twinledger.operators.reconcile import FOUND_IN_BOTH, reconcile
from twinledger.plans.compare import compare_files
from twinledger.plans.history import append_run, drop_results, purge_runs, read_history, recent_runs
from twinledger.plans.job import StoredRun, run_recon_job
from twinledger.plans.session import scratch_dir
from twinledger.sources.fixed_width import convert_fixed_width, parse_widths, slice_lines
from twinledger.sources.inventory import file_inventory, storage_stats
from twinledger.sources.lines import BLOCK, FILE, LINE, POSITION, is_trailer, raw_lines
from twinledger.sources.read import LoadedTable, read_table
from twinledger.sources.stage import stage_table
from twinledger.spec import CompareRules, JobConfig, TableSpec

TEXT_RULES = CompareRules(
    float_epsilon=0.011, trim_strings=True, normalize_dates=True, upper_columns=("o_orderstatus",)
)


def write_csv(df: DataFrame, path: str, **options) -> str:
    """Delimited files with doubled quotes and untouched blanks, as other tools write them."""
    settings = {
        "header": True,
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "emptyValue": "",
        **options,
    }
    df.write.options(**settings).csv(path)
    return path


def orders_files(spark: SparkSession, sf: str) -> tuple[LoadedTable, LoadedTable]:
    """The orders pair as gzip CSV on one side and bzip2 pipe-separated files on the other."""
    root = scratch_dir(spark)
    source, target = pairs.orders_text_pair(spark, sf)
    return (
        read_table(spark, TableSpec(write_csv(source, f"{root}/s", compression="gzip"), header_rows=1)),
        read_table(
            spark,
            TableSpec(
                write_csv(target, f"{root}/t", compression="bzip2", sep="|"),
                file_type="psv",
                delimiter="|",
                header_rows=1,
            ),
        ),
    )


def csv_recon(spark: SparkSession, sf: str) -> DataFrame:
    source, target = orders_files(spark, sf)
    return summary_of(reconcile(spark, source.rows, target.rows, ["o_orderkey"], TEXT_RULES))


def csv_recon_detail(spark: SparkSession, sf: str) -> DataFrame:
    source, target = orders_files(spark, sf)
    return reconcile(spark, source.rows, target.rows, ["o_orderkey"], TEXT_RULES).detail


TEXT_J = sql.joined(["o_orderkey"], TEXT_COLUMNS)
TEXT = sql.with_(pairs.ORDERS_TEXT_SQL, TEXT_J)


def csv_headerless(spark: SparkSession, sf: str) -> DataFrame:
    """Files without a header: columns are numbered."""
    path = write_csv(load(spark, sf, "customer"), f"{scratch_dir(spark)}/c", header=False)
    return read_table(spark, TableSpec(path)).rows


def csv_named(spark: SparkSession, sf: str) -> DataFrame:
    """Files without a header and with a two-character delimiter: columns get the given names."""
    path = write_csv(load(spark, sf, "customer"), f"{scratch_dir(spark)}/c", header=False, sep="~|")
    names = ("Cust Key", "Name", "Nation Key", "Balance", "Segment")
    return read_table(spark, TableSpec(path, delimiter="~|", column_names=names)).rows


def csv_multi_line(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, whose texts span lines and hold quotes."""
    path = write_csv(load(spark, sf, "documents"), f"{scratch_dir(spark)}/d")
    return read_table(spark, TableSpec(path, header_rows=1, multi_line=True)).rows


def csv_embedded_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same with default settings: files stay split, and lines of one record are joined."""
    path = write_csv(load(spark, sf, "documents"), f"{scratch_dir(spark)}/d")
    return read_table(spark, TableSpec(path, header_rows=1)).rows


def csv_utf16(spark: SparkSession, sf: str) -> DataFrame:
    """Documents on one line each, in UTF-16."""
    docs = load(spark, sf, "documents").select("doc_id", F.translate("text", "\n", " ").alias("text"), "lang")
    path = write_csv(docs, f"{scratch_dir(spark)}/u", encoding="UTF-16LE")
    return read_table(spark, TableSpec(path, header_rows=1, encoding="utf-16-le")).rows


def _with_heads(lines: DataFrame, path: str, heads: list[str]) -> str:
    """Text files that each begin with the given lines."""

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": heads})
        yield from batches

    lines.mapInPandas(headed, "value string").write.text(path)
    return path


def header_rows_3(spark: SparkSession, sf: str) -> DataFrame:
    """Many files with three header lines each, the first of them empty."""
    customers = load(spark, sf, "customer").repartition(5, "c_custkey")
    lines = customers.select(F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    path = _with_heads(lines, f"{scratch_dir(spark)}/h", ["", "made by hand", "Cust Key,Name,Segment"])
    return read_table(spark, TableSpec(path, header_rows=3)).rows


ZIP_ROWS = 5_000


def _zipped(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive with the lines of a group dealt to two members, each with a header."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in (("a.csv", rows["value"][::2]), ("more/b.csv", rows["value"][1::2])):
            archive.writestr(name, "\n".join(["Cust Key,Name,Segment", *part]) + "\n")
    return pd.DataFrame({"data": [data.getvalue()]})


def zip_members(spark: SparkSession, sf: str) -> DataFrame:
    """Archives of two members each; fields with line ends and quotes among them."""
    customers = load(spark, sf, "customer")
    name = F.when(pairs.every(7, 1, "c_custkey"), F.concat(F.lit('"'), F.col("c_name"), F.lit('\n""second"" line"')))
    lines = customers.select(
        F.floor(F.col("c_custkey") / ZIP_ROWS).alias("part"),
        F.concat_ws(",", "c_custkey", F.coalesce(name, F.col("c_name")), "c_mktsegment").alias("value"),
    )
    archives = lines.groupBy("part").applyInPandas(_zipped, "data binary")
    path = f"{scratch_dir(spark)}/z"
    archives.select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    return read_table(spark, TableSpec(path, compression="zip", header_rows=1)).rows


# -- rejects: some lines too long, some never closing a quote, some too short ------------------


def _ragged(df: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return df.select(
        F.when(key % 23 == 1, F.concat(line, F.lit(",extra,")))
        .when(key % 23 == 2, F.concat_ws(",", "o_orderkey", F.lit('"open'), "o_orderstatus", "o_orderpriority"))
        .when(key % 23 == 3, F.concat_ws(",", "o_orderkey", "o_custkey"))
        .when(key % 23 == 4, F.concat_ws(",", "o_orderkey", F.lit('"a ""b"", c"'), "o_orderstatus", F.lit('5" pipe')))
        .otherwise(line)
        .alias("value")
    )


def _ragged_table(spark: SparkSession, sf: str) -> LoadedTable:
    path = f"{scratch_dir(spark)}/r"
    _ragged(load(spark, sf, "orders")).write.text(path)
    return read_table(spark, TableSpec(path, column_names=("o_orderkey", "customer", "status", "priority")))


def csv_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _ragged_table(spark, sf).rejects.select("error_type", "csv_line")


def csv_reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _ragged_table(spark, sf).counts


def csv_padded(spark: SparkSession, sf: str) -> DataFrame:
    return _ragged_table(spark, sf).rows


def job_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run over one file with many rejected lines: all are stored, with their line numbers."""
    root = scratch_dir(spark)
    _ragged(load(spark, sf, "orders").orderBy("o_orderkey")).coalesce(1).write.text(f"{root}/r")
    side = TableSpec(f"{root}/r", column_names=("o_orderkey", "customer", "status", "priority"))
    run = run_recon_job(spark, JobConfig("ragged", side, side, ("o_orderkey",), f"{root}/out"))
    return run.source_rejects.select("line_number", "error_type", "csv_line")


def job_rejects_resplit(spark: SparkSession, sf: str) -> DataFrame:
    """The same over a folder, with small splits while it is staged and others when the rejects are read."""
    root, name = scratch_dir(spark), "spark.sql.files.maxPartitionBytes"
    _ragged(load(spark, sf, "orders").orderBy("o_orderkey")).coalesce(1).write.text(f"{root}/r")
    spec = TableSpec(f"{root}/r", column_names=("o_orderkey", "customer", "status", "priority"))
    usual = spark.conf.get(name)
    spark.conf.set(name, "60000")
    try:
        staged = stage_table(spark, spec, f"{root}/staged")
    finally:
        spark.conf.set(name, usual)
    return staged.rejects.select("line_number", "error_type", "csv_line")


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame({"doc_id": ["\ufeffdoc_id"], "text": ["text"]})
    yield from batches


def csv_utf16_bom(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in UTF-16 files with byte order marks, some little-endian and some big-endian."""
    docs = load(spark, sf, "documents").select(
        F.col("doc_id").cast("string"), F.translate("text", "\n", " ").alias("text"), (F.col("doc_id") % 2).alias("rest")
    )
    root = scratch_dir(spark)
    for rest, codec in enumerate(("UTF-16LE", "UTF-16BE")):
        rows = docs.filter(F.col("rest") == rest).select("doc_id", "text").mapInPandas(_marked, "doc_id string, text string")
        write_csv(rows, f"{root}/{codec}", header=False, encoding=codec)
    return read_table(spark, TableSpec(f"{root}/UTF-16*", header_rows=1, encoding="utf-16")).rows


CSV_UTF16_BOM_SQL = """SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  nullif(translate(text, chr(10), ' '), '') AS text FROM documents"""


def csv_long_records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with a bound that some exceed: each of these is one reject, and no line of it a row."""
    path = write_csv(load(spark, sf, "documents").select("doc_id", "text"), f"{scratch_dir(spark)}/d")
    table = read_table(spark, TableSpec(path, header_rows=1, max_record_bytes=LONG_RECORD))
    rows = table.rows.select("doc_id", F.lit("row").alias("outcome"))
    rejects = table.rejects.select(F.split("csv_line", ",")[0].alias("doc_id"), F.col("error_type").alias("outcome"))
    return rows.unionByName(rejects)


# Small, so that the given texts exceed it.
LONG_RECORD = 4_000

CSV_LONG_RECORDS_SQL = f"""WITH d AS (
  SELECT doc_id, CASE WHEN text LIKE '%"%' OR text LIKE '%,%' OR text LIKE '%' || chr(10) || '%'
    THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN field LIKE '%' || chr(10) || '%'
    AND octet_length(encode(CAST(doc_id AS VARCHAR) || ',' || field)) + 1 > {LONG_RECORD}
  THEN 'LINE SIZE OVER MAXIMUM' ELSE 'row' END AS outcome FROM d"""


# -- trailers and line order -------------------------------------------------------------------


def _with_trailers(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").orderBy("o_orderkey")
    key = F.col("o_orderkey")
    line = F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return orders.select(
        F.when(key % 19 == 0, F.concat(F.lit("TRAILER|"), line))
        .when(key % 19 == 1, F.concat(F.lit('"100%_EOF|'), line, F.lit('"')))
        .otherwise(line)
        .alias("value")
    )


TRAILERS = ("TRAILER", "100%_")


def _trailer_table(spark: SparkSession, sf: str) -> LoadedTable:
    path = f"{scratch_dir(spark)}/t"
    _with_trailers(spark, sf).write.text(path)
    names = ("o_orderkey", "status", "priority")
    return read_table(spark, TableSpec(path, delimiter="|", trailer_patterns=TRAILERS, column_names=names))


def trailer_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _trailer_table(spark, sf).rows


def trailer_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _trailer_table(spark, sf).trailers


def trailer_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The trailer rule on lines that were never written to a file."""
    lines = _with_trailers(spark, sf)
    return lines.select("value", is_trailer(F.col("value"), TRAILERS).alias("is_trailer"))


def trailer_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Trailers of a file against those of a changed copy, line by line."""
    root = scratch_dir(spark)
    lines = _with_trailers(spark, sf)
    changed = F.when(F.col("value").contains("|O|"), F.replace("value", F.lit("|O|"), F.lit("|o|"))).otherwise(F.col("value"))
    lines.write.text(f"{root}/s")
    lines.select(changed.alias("value")).write.text(f"{root}/t")
    names = ("o_orderkey", "status", "priority")
    sides = [TableSpec(f"{root}/{x}", delimiter="|", trailer_patterns=TRAILERS, column_names=names) for x in "st"]
    found = compare_files(spark, *sides, keys="o_orderkey").trailer_comparison
    return found.select("line_number", "source", "target", "status", "first_diff_pos", "diff_count")


def header_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of two sets of files with different delimiters, with how many rows each side has."""
    source, target = orders_files(spark, sf)
    lines = compare_lines(source.headers, target.headers).select("line_number", "source", "target", "status", "diff_count")
    counts = source.counts.select(F.col("row_count").alias("source_rows")).crossJoin(
        target.counts.select(F.col("row_count").alias("target_rows"))
    )
    return lines.crossJoin(counts)  # one header line, one row of counts


_TRAILERS_CTE = """WITH l AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority,
         CASE o_orderkey % 19 WHEN 0 THEN 'TRAILER|' || concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)
           WHEN 1 THEN '"100%_EOF|' || concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority) || '"'
           ELSE concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority) END AS line
  FROM orders)
"""


def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of many files, numbered in file order by many tasks."""
    path = f"{scratch_dir(spark)}/n"
    events = load(spark, sf, "events").orderBy("event_id")
    events.select(F.concat_ws(";", "event_id", "user_id", "event_type")).write.text(path)
    lines = raw_lines(spark, TableSpec(path)).select(LINE, FILE, BLOCK, POSITION)
    return number_lines(lines).select("line_number", F.col(LINE).alias("line"))


# -- fixed width -------------------------------------------------------------------------------

PART_WIDTHS = "12,16, 10,9,5,12"
PART_NAMES = ["P_PartKey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _packed(df: DataFrame) -> DataFrame:
    widths = [b - a for a, b in parse_widths(PART_WIDTHS)]

    def field(name: str, width: int) -> Column:
        value = F.col(name)
        if name == "p_retailprice":
            value = value.cast("decimal(18,2)")
        text = value.cast("string")
        return F.lpad(text, width, " ") if name in ("p_size", "p_retailprice") else F.rpad(text, width, " ")

    names = ["p_partkey", *PART_NAMES[1:]]
    return df.select(F.concat(*[field(n, w) for n, w in zip(names, widths)]).alias("value"))


def fwf_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Parts packed into fixed-width lines and cut apart again."""
    return slice_lines(_packed(load(spark, sf, "part")), parse_widths(PART_WIDTHS), PART_NAMES)


def fwf_header_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names cut from each file's header line at the columns' positions."""
    specs = parse_widths(PART_WIDTHS)
    head = "".join(name[: b - a].ljust(b - a) for name, (a, b) in zip(["Part Key", "P Name", "brand", "type", "", "retail"], specs))
    path = _with_heads(_packed(load(spark, sf, "part")).repartition(3), f"{scratch_dir(spark)}/f", [head])
    return read_table(spark, TableSpec(path, file_type="fwf", col_specs=specs, header_rows=1)).rows


def fwf_convert(spark: SparkSession, sf: str) -> DataFrame:
    """The same through text files, with trailers, converted to Parquet."""
    root = scratch_dir(spark)
    lines = _packed(load(spark, sf, "part"))
    number = F.trim(F.substring("value", 1, 12)).cast("int")
    trailer = lines.select(F.concat(F.lit("EOF "), F.col("value")).alias("value")).filter(
        F.col("value").contains("red")
    )
    lines.filter(number.isNotNull()).unionByName(trailer).write.text(f"{root}/lines")
    spec = TableSpec(
        f"{root}/lines",
        file_type="fwf",
        col_specs=parse_widths(PART_WIDTHS),
        column_names=tuple(PART_NAMES),
        trailer_patterns=("EOF",),
    )
    return spark.read.parquet(convert_fixed_width(spark, spec, f"{root}/parquet"))


_PART_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
  CAST(p_size AS VARCHAR) AS p_size, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS p_retailprice FROM part"""


# -- complete runs -----------------------------------------------------------------------------


def mounted(spark: SparkSession, path: str) -> str:
    """The same folder under another Hadoop scheme: a mount table of its own, since file systems are kept by name."""
    conf = spark._jsc.hadoopConfiguration()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    system.mkdirs(where)
    table = f"ledger{uuid4().hex}"
    conf.set(f"fs.viewfs.mounttable.{table}.link./data", system.makeQualified(where).toString())
    return f"viewfs://{table}/data"


def _job(
    spark: SparkSession, sf: str, rules: CompareRules = pairs.ORDERS_RULES, root: str | None = None
) -> StoredRun:
    root = root or scratch_dir(spark)
    source, target = pairs.orders_pair(spark, sf)
    source.write.parquet(f"{root}/s")
    target.write.parquet(f"{root}/t")
    return run_recon_job(
        spark,
        JobConfig(
            job_name="orders nightly",
            source=TableSpec(f"{root}/s", file_type="parquet"),
            target=TableSpec(f"{root}/t", file_type="parquet"),
            primary_keys=("O_OrderKey",),
            output=f"{root}/out",
            rules=rules,
        ),
    )


def job_other_scheme(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run that reads and stores through a scheme other than the scratch folder's."""
    return _job(spark, sf, root=mounted(spark, scratch_dir(spark))).detail


def job_find_key(spark: SparkSession, sf: str) -> DataFrame:
    """The stored detail of the largest key that differs on both sides."""
    run = _job(spark, sf)
    both = run.detail.filter(F.col("validation_status") == FOUND_IN_BOTH)
    return run.find({"O_OrderKey": both.agg(F.max("o_orderkey")).head()[0]}, status=FOUND_IN_BOTH)


def job_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A run over equal sides stores a sample of matching rows."""
    path = f"{sf.rstrip('/')}/customer.parquet"
    side = TableSpec(path, file_type="parquet")
    run = run_recon_job(spark, JobConfig("equal", side, side, ("c_custkey",), f"{scratch_dir(spark)}/out"))
    return run.sample


def _two_runs(spark: SparkSession, sf: str) -> str:
    """The output of a run over customers and of one over suppliers."""
    output = f"{scratch_dir(spark)}/out"
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        side = TableSpec(f"{sf.rstrip('/')}/{name}.parquet", file_type="parquet")
        run_recon_job(spark, JobConfig(name, side, side, (key,), output))
    return output


def history_recent(spark: SparkSession, sf: str) -> DataFrame:
    output = _two_runs(spark, sf)
    drop_results(spark, read_history(spark, output).filter("job_name = 'supplier'").head()["output"])
    listed = recent_runs(spark, output).select("run_id", "job_name", "status", "match_percentage", "has_results")
    counts = read_history(spark, output).select("run_id", "source_count")
    return listed.join(counts, "run_id").drop("run_id")


def history_purged(spark: SparkSession, sf: str) -> DataFrame:
    """What is left after runs older than a day are removed, one of two being moved back by two days."""
    output = _two_runs(spark, sf)
    history = read_history(spark, output)
    age = F.when(F.col("job_name") == "customer", F.expr("INTERVAL 2 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    moved = history.withColumn("finished_at", F.col("finished_at") - age)
    older = f"{output}_older"
    append_run(moved, older)
    purge_runs(spark, older, F.current_timestamp(), 24 * 60 * 60)
    return read_history(spark, older).select("job_name", "source_count")


def storage_of_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/p"
    load(spark, sf, "orders").repartition(7).write.parquet(path)
    stats = storage_stats(spark, path)
    return stats.select("files", (F.col("total_bytes") > 0).alias("has_bytes"), (F.col("oldest_mtime") <= F.col("newest_mtime")).alias("ordered"))


def inventory_of_files(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark)
    write_csv(load(spark, sf, "orders"), f"{root}/orders.csv.gz", compression="gzip")
    found = file_inventory(spark, [f"{root}/orders.csv.gz", f"{root}/absent.csv"])
    return found.select("filename", "compression", "exists", (F.coalesce("size_bytes", F.lit(0)) > 0).alias("has_bytes"))


def job_history(spark: SparkSession, sf: str) -> DataFrame:
    run = _job(spark, sf)
    history = read_history(spark, run.path.split("/runs/")[0])
    return history.select(
        F.array_join("primary_keys", ",").alias("primary_keys"),
        "status",
        "source_count",
        "target_count",
        "matching_rows",
        "mismatched_rows",
        "missing_in_source",
        "missing_in_target",
        "match_percentage",
        "row_count_diff",
    )


def job_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """A run over a key with many duplicates: the stored exceptions give the same summary."""
    root = scratch_dir(spark)
    source, target = pairs.lineitem_pair(spark, sf)
    source.write.parquet(f"{root}/s")
    target.write.parquet(f"{root}/t")
    config = JobConfig(
        job_name="lineitem",
        source=TableSpec(f"{root}/s", file_type="parquet"),
        target=TableSpec(f"{root}/t", file_type="parquet"),
        primary_keys=tuple(pairs.LINEITEM_KEYS),
        output=f"{root}/out",
        rules=pairs.LINEITEM_RULES,
    )
    return run_recon_job(spark, config).summary


_NAMES = [c.name for c in pairs.ORDERS_COLUMNS_RULES]

QUERIES = {
    "csv_recon": (csv_recon, TEXT + sql.SUMMARY),
    "csv_recon_detail": (csv_recon_detail, TEXT + sql.detail(["o_orderkey"], TEXT_COLUMNS)),
    "csv_headerless": (
        csv_headerless,
        """SELECT CAST(c_custkey AS VARCHAR) AS column0, c_name AS column1, CAST(c_nationkey AS VARCHAR) AS column2,
  CAST(c_acctbal AS VARCHAR) AS column3, c_mktsegment AS column4 FROM customer""",
    ),
    "csv_named": (
        csv_named,
        """SELECT CAST(c_custkey AS VARCHAR) AS cust_key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation_key,
  CAST(c_acctbal AS VARCHAR) AS balance, c_mktsegment AS segment FROM customer""",
    ),
    "csv_multi_line": (
        csv_multi_line,
        """SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang, source,
  CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    ),
    "csv_embedded_lines": (
        csv_embedded_lines,
        """SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang, source,
  CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    ),
    "csv_utf16": (
        csv_utf16,
        """SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(replace(text, chr(10), ' '), '') AS text, lang FROM documents""",
    ),
    "header_rows_3": (
        header_rows_3,
        "SELECT CAST(c_custkey AS VARCHAR) AS cust_key, c_name AS name, c_mktsegment AS segment FROM customer",
    ),
    "zip_members": (
        zip_members,
        """SELECT CAST(c_custkey AS VARCHAR) AS cust_key, c_mktsegment AS segment,
  CASE WHEN c_custkey % 7 = 1 THEN c_name || chr(10) || '"second" line' ELSE c_name END AS name FROM customer""",
    ),
    "job_rejects": (
        job_rejects,
        """WITH l AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS line_number FROM orders)
SELECT line_number, 'TOO MANY COLUMNS' AS error_type,
  concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) || ',extra,' AS csv_line
FROM l WHERE o_orderkey % 23 = 1
UNION ALL SELECT line_number, 'UNQUOTED VALUE', concat_ws(',', o_orderkey, '"open', o_orderstatus, o_orderpriority)
FROM l WHERE o_orderkey % 23 = 2""",
    ),
    "job_rejects_resplit": (
        job_rejects_resplit,
        """WITH l AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS line_number FROM orders)
SELECT line_number, 'TOO MANY COLUMNS' AS error_type,
  concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) || ',extra,' AS csv_line
FROM l WHERE o_orderkey % 23 = 1
UNION ALL SELECT line_number, 'UNQUOTED VALUE', concat_ws(',', o_orderkey, '"open', o_orderstatus, o_orderpriority)
FROM l WHERE o_orderkey % 23 = 2""",
    ),
    "csv_utf16_bom": (csv_utf16_bom, CSV_UTF16_BOM_SQL),
    "csv_long_records": (csv_long_records, CSV_LONG_RECORDS_SQL),
    "trailer_compare": (
        trailer_compare,
        _TRAILERS_CTE
        + """SELECT row_number() OVER (ORDER BY o_orderkey) AS line_number, line AS source, replace(line, '|O|', '|o|') AS target,
  CASE WHEN contains(line, '|O|') THEN 'MISMATCH' ELSE 'MATCH' END AS status,
  CASE WHEN contains(line, '|O|') THEN CAST(strpos(line, '|O|') AS INTEGER) END AS first_diff_pos,
  CASE WHEN contains(line, '|O|') THEN 1 ELSE 0 END AS diff_count
FROM l WHERE o_orderkey % 19 < 2""",
    ),
    "header_compare": (
        header_compare,
        sql.with_(pairs.ORDERS_SQL)
        + """SELECT CAST(1 AS BIGINT) AS line_number,
  'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS source,
  'o_orderkey|o_custkey|o_orderstatus|o_totalprice|o_orderdate|o_orderpriority' AS target, 'MISMATCH' AS status,
  5 AS diff_count, (SELECT count(*) FROM src) AS source_rows, (SELECT count(*) FROM tgt) AS target_rows""",
    ),
    "fwf_header_names": (
        fwf_header_names,
        f"""SELECT p_partkey AS part_key, p_name, p_brand AS brand, p_type AS type, p_size AS column4,
  p_retailprice AS retail FROM ({_PART_SQL})""",
    ),
    "job_sample": (
        job_sample,
        """SELECT c_custkey, c_name AS c_name_source, c_name AS c_name_target, 'MATCH' AS c_name_status,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey_source, CAST(c_nationkey AS VARCHAR) AS c_nationkey_target,
  'MATCH' AS c_nationkey_status, CAST(c_acctbal AS VARCHAR) AS c_acctbal_source,
  CAST(c_acctbal AS VARCHAR) AS c_acctbal_target, 'MATCH' AS c_acctbal_status,
  c_mktsegment AS c_mktsegment_source, c_mktsegment AS c_mktsegment_target, 'MATCH' AS c_mktsegment_status
FROM customer ORDER BY c_custkey LIMIT 500""",
    ),
    "history_recent": (
        history_recent,
        """SELECT 'customer' AS job_name, 'completed' AS status, CAST(100 AS DOUBLE) AS match_percentage,
  true AS has_results, count(*) AS source_count FROM customer
UNION ALL SELECT 'supplier', 'completed', 100, false, count(*) FROM supplier""",
    ),
    "history_purged": (history_purged, "SELECT 'supplier' AS job_name, count(*) AS source_count FROM supplier"),
    "storage_stats": (
        storage_of_files, "SELECT CAST(7 AS BIGINT) AS files, count(*) > 0 AS has_bytes, true AS ordered FROM orders",
    ),
    "file_inventory": (
        inventory_of_files,
        """SELECT 'orders.csv.gz' AS filename, 'gzip' AS compression, true AS "exists", count(*) > 0 AS has_bytes FROM orders
UNION ALL SELECT 'absent.csv', NULL, false, false""",
    ),
    "csv_rejects": (
        csv_rejects,
        """SELECT 'TOO MANY COLUMNS' AS error_type,
  concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) || ',extra,' AS csv_line
FROM orders WHERE o_orderkey % 23 = 1
UNION ALL SELECT 'UNQUOTED VALUE', concat_ws(',', o_orderkey, '"open', o_orderstatus, o_orderpriority)
FROM orders WHERE o_orderkey % 23 = 2""",
    ),
    "csv_reject_counts": (
        csv_reject_counts,
        """SELECT count(*) FILTER (o_orderkey % 23 NOT IN (1, 2)) AS row_count,
  count(*) FILTER (o_orderkey % 23 IN (1, 2)) AS reject_count FROM orders""",
    ),
    "csv_padded": (
        csv_padded,
        """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderkey % 23 = 4 THEN 'a "b", c' ELSE CAST(o_custkey AS VARCHAR) END AS customer,
  CASE WHEN o_orderkey % 23 <> 3 THEN o_orderstatus END AS status,
  CASE o_orderkey % 23 WHEN 3 THEN NULL WHEN 4 THEN '5" pipe' ELSE o_orderpriority END AS priority
FROM orders WHERE o_orderkey % 23 NOT IN (1, 2)""",
    ),
    "trailer_filter": (
        trailer_filter,
        """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus AS status, o_orderpriority AS priority
FROM orders WHERE o_orderkey % 19 > 1""",
    ),
    "trailer_lines": (
        trailer_lines,
        _TRAILERS_CTE
        + """SELECT row_number() OVER (ORDER BY o_orderkey) AS line_number, line
FROM l WHERE o_orderkey % 19 < 2""",
    ),
    "trailer_flags": (
        trailer_flags,
        _TRAILERS_CTE
        + """SELECT line AS value, starts_with(line, 'TRAILER') OR starts_with(line, '"TRAILER')
  OR starts_with(line, '100%_') OR starts_with(line, '"100%_') AS is_trailer FROM l""",
    ),
    "line_numbers": (
        line_numbers,
        """SELECT row_number() OVER (ORDER BY event_id) AS line_number,
  concat_ws(';', event_id, user_id, event_type) AS line FROM events""",
    ),
    "fwf_slice": (fwf_slice, _PART_SQL),
    "fwf_convert": (fwf_convert, _PART_SQL),
    "job_summary": (lambda s, d: _job(s, d).summary, RULES + sql.SUMMARY),
    "job_detail": (
        lambda s, d: _job(s, d).detail,
        RULES + sql.detail(["o_orderkey"], pairs.ORDERS_COLUMNS_RULES),
    ),
    "job_other_scheme": (job_other_scheme, RULES + sql.detail(["o_orderkey"], pairs.ORDERS_COLUMNS_RULES)),
    "job_find_key": (
        job_find_key,
        RULES
        + f"""SELECT * FROM ({sql.detail(["o_orderkey"], pairs.ORDERS_COLUMNS_RULES)}) WHERE validation_status = 'Found in Both'
QUALIFY o_orderkey = max(o_orderkey) OVER ()""",
    ),
    "job_column_stats": (
        lambda s, d: _job(s, d).column_stats,
        RULES
        + " UNION ALL ".join(
            f"""SELECT '{n}' AS column_name, count(*) AS compared, count(*) FILTER ({n}_m) AS matching,
  count(*) FILTER (NOT {n}_m) AS mismatched, count(*) FILTER ({n}_m) / count(*) * 100 AS match_percentage
FROM j WHERE validation_status = 'Found in Both'"""
            for n in _NAMES
        ),
    ),
    "job_history": (
        job_history,
        RULES
        + f"""SELECT 'o_orderkey' AS primary_keys, 'completed' AS status, source_count, target_count, matching_rows,
  mismatched_rows, missing_in_source, missing_in_target, match_percentage, row_count_diff FROM ({sql.SUMMARY})""",
    ),
    "job_duplicates": (
        job_duplicates,
        sql.with_(pairs.LINEITEM_SQL, sql.joined(pairs.LINEITEM_KEYS, pairs.LINEITEM_COLUMNS)) + sql.SUMMARY,
    ),
}
