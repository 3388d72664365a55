"""The table of past runs: append, look up, list the latest, expire by age, and compact.

The history is a log. A run is appended as a file of its own and never rewritten; runs that expired are named in a
second log of removed runs. Compaction writes the runs that are left as a snapshot, with the names of all files that it
stands for, and puts it in place by one rename: readers see either the files or the snapshot. What is appended
meanwhile is not among those files, so nothing is lost, whoever writes at the same time.
"""

from __future__ import annotations

import time
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions import fmt
from twinledger.plans.session import delete_path, scratch_dir
from twinledger.sources.inventory import list_files

# How many runs are listed, and how long results and reports are kept.
RECENT_RUNS = 10
RESULT_TTL_SECONDS = 12 * 60 * 60
REPORT_TTL_SECONDS = 7 * 24 * 60 * 60

HISTORY_SCHEMA = """
    run_id string, job_name string, source_path string, target_path string,
    primary_keys array<string>, output string, status string, message string,
    started_at timestamp, finished_at timestamp,
    source_count bigint, target_count bigint, matching_rows bigint, mismatched_rows bigint,
    missing_in_source bigint, missing_in_target bigint, match_percentage double,
    row_count_diff bigint, mismatched_rows_exact bigint, source_duplicate_rows bigint,
    target_duplicate_rows bigint, source_rejects bigint, target_rejects bigint, run_date date
"""


def history_path(output: str) -> str:
    return f"{output.rstrip('/')}/history"


def _removed_path(output: str) -> str:
    return f"{output.rstrip('/')}/history_removed"


def _snapshots_path(output: str) -> str:
    return f"{output.rstrip('/')}/history_snapshots"


def append_run(run: DataFrame, output: str) -> None:
    """Add one run; each run date is a partition, so old dates are skipped when reading."""
    run.write.mode("append").partitionBy("run_date").parquet(history_path(output))


def _read_or_none(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _snapshot(spark: SparkSession, output: str) -> str | None:
    """The newest snapshot's folder. Their names grow with time, and unfinished ones have others."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_snapshots_path(output)}/at_*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return max((str(status.getPath()) for status in found or ()), default=None)


def _log_name(path: Column) -> Column:
    """A log file's place below the history's folder."""
    return F.regexp_extract(path, "(run_date=[^/]*/[^/]*)$", 1)


def _with_snapshot(spark: SparkSession, log: DataFrame | None, snapshot: str | None) -> DataFrame:
    """All runs of a snapshot and of the log files that it does not stand for, removed ones included."""
    runs = spark.createDataFrame([], HISTORY_SCHEMA) if log is None else log
    if snapshot is None:
        return runs
    if log is not None:
        replaced = spark.read.schema("name string").parquet(f"{snapshot}/replaced")
        named = log.withColumn("_name", _log_name(F.col("_metadata.file_path")))
        runs = named.join(replaced, F.col("_name") == F.col("name"), "left_anti").drop("_name")
    return spark.read.schema(HISTORY_SCHEMA).parquet(f"{snapshot}/runs").unionByName(runs)


def _live(spark: SparkSession, output: str, runs: DataFrame) -> DataFrame:
    """Those of the runs that were not removed."""
    removed = _read_or_none(spark, "run_id string", _removed_path(output))
    return runs if removed is None else runs.join(removed, "run_id", "left_anti").select(*runs.columns)


def read_history(spark: SparkSession, output: str) -> DataFrame:
    """All recorded runs that were not removed; none where nothing has been recorded yet."""
    snapshot = _snapshot(spark, output)
    log = _read_or_none(spark, HISTORY_SCHEMA, history_path(output))
    return _live(spark, output, _with_snapshot(spark, log, snapshot))


def compact_history(spark: SparkSession, output: str) -> int:
    """Put the runs that are left into one snapshot and remove the files it stands for; returns how many.

    A compaction that fails before its rename leaves the history as it was. One at a time: of two that end
    together, the later snapshot holds all that both read.
    """
    log, before = _read_or_none(spark, HISTORY_SCHEMA, history_path(output)), _snapshot(spark, output)
    if log is None:
        return 0
    # The files are listed once, when the table is opened; all that follows reads these and no later ones.
    files = [(name.rsplit("/", 2)[-2] + "/" + name.rsplit("/", 1)[-1],) for name in log.inputFiles()]
    root = _snapshots_path(output)
    unfinished = f"{root}/new_{uuid4().hex}"
    replaced = spark.createDataFrame(files, "name string")
    kept = _live(spark, output, _with_snapshot(spark, log, before))
    kept.coalesce(1).write.parquet(f"{unfinished}/runs")
    replaced.coalesce(1).write.parquet(f"{unfinished}/replaced")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.rename(path(unfinished), path(f"{root}/at_{time.time_ns():020d}")):
        raise RuntimeError(f"could not put the snapshot in place below {root}")
    for (name,) in files:
        delete_path(spark, f"{history_path(output)}/{name}")
    if before is not None:
        delete_path(spark, before)
    return len(files)


def run_metadata(history: DataFrame, run_id: str) -> DataFrame:
    """What is needed to reopen a run: its keys and where its results are."""
    return history.filter(F.col("run_id") == run_id).select("run_id", "primary_keys", "output")


def latest(df: DataFrame, at: str, tie: str, limit: int = RECENT_RUNS) -> DataFrame:
    """The newest rows; ties are broken by the larger ``tie``."""
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(limit)


def within_age(at: Column, now: Column, ttl_seconds: int) -> Column:
    """True while a time is not older than the given age."""
    return at >= now - F.make_interval(secs=F.lit(ttl_seconds))


def recent_runs(spark: SparkSession, output: str, limit: int = RECENT_RUNS) -> DataFrame:
    """The latest runs with the size of their stored results and whether there are any.

    Results are there when the run's metadata is, without which they cannot be reopened. Only the
    folders of the listed runs are looked into, however many runs are stored.
    """
    newest = latest(read_history(spark, output), "finished_at", "run_id", limit)
    run_ids = [row["run_id"] for row in newest.select("run_id").collect()]
    files = list_files(spark, f"{output.rstrip('/')}/runs/{{{','.join(run_ids)}}}")
    sizes = files.groupBy(F.regexp_extract("path", r"/runs/([^/]+)/", 1).alias("run_id")).agg(
        F.coalesce(F.sum(F.when(F.col("path").endswith(".parquet"), F.col("length"))), F.lit(0)).alias("size_bytes"),
        F.bool_or(F.col("path").rlike(r"/runs/[^/]+/meta/part-")).alias("has_meta"),
    )
    joined = newest.join(sizes, "run_id", "left")
    size = F.coalesce("size_bytes", F.lit(0))
    return joined.select(
        "run_id",
        "job_name",
        "finished_at",
        "status",
        "match_percentage",
        size.alias("size_bytes"),
        fmt.format_bytes(size).alias("size_human"),
        F.coalesce("has_meta", F.lit(False)).alias("has_results"),
    ).orderBy(F.col("finished_at").desc(), F.col("run_id").desc())


def purge_runs(spark: SparkSession, output: str, now: Column, ttl_seconds: int) -> int:
    """Remove runs that finished longer ago than the age, with their results; returns how many.

    Results go first, so a run that is still listed never lacks more than its results. Then the runs are named as
    removed, in one append; no file of the history is rewritten, so runs recorded at the same time stay.
    """
    history = read_history(spark, output)
    fresh = F.coalesce(within_age(F.col("finished_at"), now, ttl_seconds), F.lit(True))
    staged = scratch_dir(spark)
    history.filter(~fresh).select("run_id").distinct().coalesce(1).write.parquet(staged)
    expired = spark.read.schema("run_id string").parquet(staged)
    n = 0
    for row in expired.toLocalIterator():
        drop_results(spark, f"{output.rstrip('/')}/runs/{row['run_id']}")
        n += 1
    if n:
        expired.write.mode("append").parquet(_removed_path(output))
    delete_path(spark, staged)
    return n


def drop_results(spark: SparkSession, run_path: str) -> None:
    """Remove the stored tables of a run."""
    delete_path(spark, run_path)
