"""Complete runs: stored tables, reports, history, expiry."""

from __future__ import annotations

import dataclasses
import datetime

import pytest
from pyspark.sql import functions as F

from twinledger import CompareRules, JobConfig, TableSpec, compare_files, read_table, reconcile
from twinledger.catalog.files import mounted
from twinledger.operators.reconcile import sample_of_equal_tables
from twinledger.plans import history, job
from twinledger.plans.job import load_run, run_recon_job
from twinledger.plans.report import report_tables, write_report
from twinledger.plans.session import shuffle_settings

SOURCE = "Id,Name,Amount\n1,Ann,1.00\n2,Bob,2.00\n2,Bob,2.00\n3,Cy,3.00\n4,Di,4.00\n5,x,y,z\nEOF,3\n"
TARGET = "Id|Name|Amount\n1|Ann|1.00\n2| Bob |2.00\n3|Cy|3.50\n6|Flo|6.00\nEOF|4\n"


@pytest.fixture
def config(tmp_path):
    (tmp_path / "s.csv").write_text(SOURCE)
    (tmp_path / "t.psv").write_text(TARGET)
    return JobConfig(
        job_name="nightly run",
        source=TableSpec(str(tmp_path / "s.csv"), header_rows=1, trailer_patterns=("EOF",)),
        target=TableSpec(str(tmp_path / "t.psv"), delimiter="|", header_rows=1, trailer_patterns=("EOF",)),
        primary_keys=("ID",),
        output=str(tmp_path / "out"),
        rules=CompareRules(trim_strings=True),
    )


def test_run_stores_everything(spark, config):
    run = run_recon_job(spark, config)
    summary = run.summary.head()
    assert summary.asDict() == {
        "source_count": 5,
        "target_count": 4,
        "source_keys": 4,
        "target_keys": 4,
        "found_in_both": 3,
        "missing_in_source": 1,
        "missing_in_target": 1,
        "mismatched_rows": 1,
        "mismatched_rows_exact": 1,
        "source_duplicate_rows": 1,
        "target_duplicate_rows": 0,
        "matching_rows": 2,
        "match_percentage": 50.0,
        "row_count_diff": 1,
    }
    assert {r["id"]: r["validation_status"] for r in run.detail.collect()} == {
        "3": "Found in Both",
        "4": "Missing in Target",
        "6": "Missing in Source",
    }
    stats = {r["column_name"]: (r["compared"], r["matching"], r["mismatched"]) for r in run.column_stats.collect()}
    assert stats == {"name": (3, 3, 0), "amount": (3, 2, 1)}
    assert [r["status"] for r in run.header_comparison.collect()] == ["MISMATCH"]
    assert [(r["source"], r["target"]) for r in run.trailer_comparison.collect()] == [("EOF,3", "EOF|4")]
    assert [r["csv_line"] for r in run.source_rejects.collect()] == ["5,x,y,z"]
    assert run.target_rejects.isEmpty() and run.sample is None
    again = load_run(spark, config.output, run.run_id)
    assert again.keys == ["id"] and again.detail.count() == 3


def _scanned(df) -> int:
    """Rows that the scan behind df handed on, once its result has been fetched."""
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_keys_are_found_without_reading_all_detail(spark, tmp_path):
    n = 200_000
    for name, value in (("s", 0), ("t", 1)):
        frame = spark.range(n).select(
            (F.col("id") * 2).alias("Id"), F.concat(F.lit("k"), F.col("id") % 7).alias("part"), (F.col("id") + value).alias("v")
        )
        frame.unionByName(spark.createDataFrame([(None, "k0", value)], "Id long, part string, v long")).write.parquet(str(tmp_path / name))
    sides = [TableSpec(str(tmp_path / name), file_type="parquet") for name in "st"]
    run = run_recon_job(spark, JobConfig("wide", *sides, ("id", "part"), str(tmp_path / "out")))
    assert run.detail.count() == n + 1

    found = run.find({"ID": "100002"}, status="Found in Both")
    assert [(r["id"], r["part"], r["v_target"]) for r in found.collect()] == [(100_002, "k0", "50002")]
    assert 1 <= _scanned(found) <= n / 4
    assert run.find({"id": 100_002, "part": "k1"}).isEmpty()
    between = run.find({"id": 100_003})
    assert between.collect() == [] and _scanned(between) == 0
    assert [r["v_target"] for r in run.find({"id": None}).collect()] == ["1"]
    assert run.find({"id": 100_002}, status="Missing in Source").isEmpty()


def test_a_run_over_text_through_another_scheme(spark, config, tmp_path):
    root = mounted(spark, str(tmp_path))
    sides = {
        side: dataclasses.replace(spec, path=spec.path.replace(str(tmp_path), root))
        for side, spec in (("source", config.source), ("target", config.target))
    }
    run = run_recon_job(spark, dataclasses.replace(config, output=f"{root}/out", **sides))
    plain = run_recon_job(spark, config)
    assert run.path.startswith("viewfs://")
    assert run.summary.collect() == plain.summary.collect()
    assert sorted(run.detail.collect()) == sorted(plain.detail.collect())
    assert [r["csv_line"] for r in run.source_rejects.collect()] == ["5,x,y,z"]
    assert load_run(spark, f"{root}/out", run.run_id).header_comparison.count() == 1


def test_stored_summary_equals_the_lazy_one(spark, config):
    run = run_recon_job(spark, config)
    source, target = read_table(spark, config.source), read_table(spark, config.target)
    lazy = reconcile(spark, source.rows, target.rows, ["id"], config.rules)
    names = run.summary.columns
    assert run.summary.head() == lazy.summary.select(*names).head()
    by_name = "column_name"
    assert run.column_stats.orderBy(by_name).collect() == lazy.column_stats.orderBy(by_name).collect()


def test_report_has_a_table_for_everything_that_has_rows(spark, config, tmp_path):
    run = run_recon_job(spark, config)
    tables = run.report()
    assert sorted(tables) == [
        "header_comparison",
        "mismatch_details",
        "rejected_records",
        "source_data",
        "source_target_comparison",
        "summary",
        "target_data",
        "trailer_comparison",
    ]
    assert tables["source_data"].columns == ["id", "name", "amount"]
    assert [r["amount"] for r in tables["target_data"].collect()] == ["3.50", "6.00", None]
    metrics = {r["metric"]: r["value"] for r in tables["summary"].collect()}
    assert metrics["Match Percentage"] == "50.00%"
    assert metrics["Mismatch Rows"] == "1"
    assert metrics["Column Names"] == "name, amount"
    paths = write_report(tables, str(tmp_path / "report"), "csv")
    assert spark.read.option("header", True).csv(paths["mismatch_details"]).head()["amount_status"] == (
        "MISMATCH: 3.00 || 3.50"
    )


def test_equal_sides_store_a_sample(spark, config):
    same = JobConfig(
        "same", config.source, config.source, ("id",), config.output, rules=config.rules, sample_rows=2
    )
    run = run_recon_job(spark, same)
    assert run.detail.isEmpty()
    assert [r["id"] for r in run.sample.collect()] == ["1", "2"]
    tables = run.report()
    assert "source_data" not in tables and tables["sample_matching_data"].count() == 2
    assert run.summary.head()["match_percentage"] == 100.0


def test_report_without_differences_or_extras(spark):
    s = spark.createDataFrame([(1, "a")], "k int, v string")
    result = reconcile(spark, s, s, ["k"])
    assert list(report_tables(result.detail, result.summary, result.keys)) == ["summary"]


def test_history(spark, config):
    first = run_recon_job(spark, config)
    table = history.read_history(spark, config.output)
    row = table.head()
    assert (row["run_id"], row["status"], row["primary_keys"]) == (first.run_id, "completed", ["id"])
    assert (row["source_rejects"], row["target_rejects"], row["matching_rows"]) == (1, 0, 2)
    assert row["message"].startswith("Completed in ")
    assert first.run_id.startswith("nightly_run_s_")
    meta = history.run_metadata(table, first.run_id).head()
    assert (meta["primary_keys"], meta["output"]) == (["id"], first.path)
    recent = history.recent_runs(spark, config.output).head()
    assert recent["has_results"] and recent["size_bytes"] > 0 and recent["size_human"].endswith("KB")


def test_expiry(spark, tmp_path):
    out = str(tmp_path)
    names = spark.createDataFrame([], history.HISTORY_SCHEMA).columns

    def run(i, day):
        values = {"run_id": f"r{i}", "finished_at": day, "run_date": day}
        cells = [F.lit(values.get(n)).cast(t).alias(n) for n, t in spark.createDataFrame([], history.HISTORY_SCHEMA).dtypes]
        return spark.range(1).select(*cells)

    for i, day in enumerate(["2025-01-01", "2025-01-09", "2025-01-10"]):
        history.append_run(run(i, day), out)
    assert len(names) == len(history.read_history(spark, out).columns)
    now = F.lit("2025-01-12 00:00:00").cast("timestamp")
    spark.range(3).write.parquet(f"{out}/runs/r0/exceptions")
    assert history.purge_runs(spark, out, now, history.REPORT_TTL_SECONDS) == 1
    assert not (tmp_path / "runs" / "r0").exists()
    assert sorted(r["run_id"] for r in history.read_history(spark, out).collect()) == ["r1", "r2"]
    recent = history.recent_runs(spark, out, limit=1).collect()
    assert [(r["run_id"], r["has_results"]) for r in recent] == [("r2", False)]
    history.append_run(run(3, "2025-01-10"), out)
    assert history.purge_runs(spark, out, F.lit("2025-01-17 12:00:00").cast("timestamp"), 8 * 24 * 3600) == 1
    assert sorted(r["run_id"] for r in history.read_history(spark, out).collect()) == ["r2", "r3"]


def test_a_day_that_keeps_some_runs_is_rewritten(spark, tmp_path):
    out, schema = str(tmp_path), history.HISTORY_SCHEMA
    names = spark.createDataFrame([], schema).columns
    day = datetime.date(2025, 1, 1)
    rows = [{"run_id": f"r{h}", "finished_at": datetime.datetime(2025, 1, 1, h), "run_date": day} for h in (1, 2, 20)]
    history.append_run(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema), out)
    assert history.purge_runs(spark, out, F.lit("2025-01-01 22:00:00").cast("timestamp"), 4 * 3600) == 2
    assert [r["run_id"] for r in history.read_history(spark, out).collect()] == ["r20"]


def _append(spark, out, *hours):
    schema, day = history.HISTORY_SCHEMA, datetime.date(2025, 1, 1)
    names = spark.createDataFrame([], schema).columns
    for h in hours:
        row = {"run_id": f"r{h}", "finished_at": datetime.datetime(2025, 1, 1, h), "run_date": day}
        history.append_run(spark.createDataFrame([tuple(row.get(n) for n in names)], schema), out)


def _ids(spark, out):
    return sorted(r["run_id"] for r in history.read_history(spark, out).collect())


def test_a_run_recorded_during_a_purge_survives(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    _append(spark, out, 1, 2, 20)
    dropped = history.drop_results

    def record_another(spark, path):
        if path.endswith("/r1"):
            _append(spark, out, 21)
        dropped(spark, path)

    monkeypatch.setattr(history, "drop_results", record_another)
    assert history.purge_runs(spark, out, F.lit("2025-01-01 22:00:00").cast("timestamp"), 4 * 3600) == 2
    assert _ids(spark, out) == ["r20", "r21"]


def test_compaction(spark, tmp_path, monkeypatch):
    """Many appended files become one; runs appended meanwhile stay, and a failed compaction changes nothing."""
    out, now = str(tmp_path), F.lit("2025-01-01 22:00:00").cast("timestamp")
    assert history.compact_history(spark, out) == 0
    _append(spark, out, 1, 2, 3, 19)
    assert history.purge_runs(spark, out, now, 20 * 3600) == 1
    with monkeypatch.context() as patch:
        patch.setattr(history.time, "time_ns", lambda: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            history.compact_history(spark, out)
    assert _ids(spark, out) == ["r19", "r2", "r3"]
    deleted = history.delete_path

    def record_another(spark, path):
        if not _ids(spark, out).count("r20"):
            _append(spark, out, 20)
        deleted(spark, path)

    monkeypatch.setattr(history, "delete_path", record_another)
    assert history.compact_history(spark, out) == 4
    monkeypatch.undo()
    assert _ids(spark, out) == ["r19", "r2", "r20", "r3"]
    files = lambda: [p for p in (tmp_path / "history").rglob("*.parquet")]
    assert len(files()) == 1
    assert history.compact_history(spark, out) == 1 and not files()
    _append(spark, out, 21)
    assert history.purge_runs(spark, out, now, 2 * 3600 + 1) == 3
    assert _ids(spark, out) == ["r20", "r21"]


def test_a_new_output_has_no_runs(spark, tmp_path):
    assert history.recent_runs(spark, str(tmp_path / "new")).collect() == []


def test_runs_within_a_second_stay_apart_and_leave_no_staging(spark, config, tmp_path, monkeypatch):
    staging = tmp_path / "staging"
    monkeypatch.setattr(job, "scratch_dir", lambda _: str(staging))
    runs = [run_recon_job(spark, config) for _ in range(2)]
    assert runs[0].run_id != runs[1].run_id
    assert not staging.exists()


def test_drop_results(spark, tmp_path):
    path = str(tmp_path / "detail")
    spark.range(5).write.parquet(path)
    history.drop_results(spark, path)
    history.drop_results(spark, path)
    assert not (tmp_path / "detail").exists()


def test_shuffle_settings_grow_with_the_input():
    small, large = shuffle_settings(10**6, 8), shuffle_settings(10**14, 8)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert int(large["spark.sql.shuffle.partitions"]) > 700_000


def test_failed_run_is_recorded(spark, config):
    wrong = JobConfig("bad", config.source, config.target, ("nope",), config.output)
    with pytest.raises(ValueError, match="nope"):
        run_recon_job(spark, wrong)
    row = history.read_history(spark, config.output).head()
    assert (row["status"], row["primary_keys"], row["matching_rows"]) == ("error", ["nope"], None)
    assert "nope" in row["message"]


def test_compare_files(spark, config):
    comparison = compare_files(spark, config.source, config.target, ["ID"], config.rules)
    assert comparison.result.summary.head()["mismatched_rows"] == 1
    assert comparison.header_comparison.head()["status"] == "MISMATCH"
    assert comparison.trailer_comparison.count() == 1
    assert (comparison.source_rejects.count(), comparison.target_rejects.count()) == (1, 0)
    assert "rejected_records" in comparison.report() and "sample_matching_data" in comparison.report(5)
    plain = TableSpec(config.source.path, column_names=("id", "n", "a"))
    bare = compare_files(spark, plain, plain, ["id"])
    assert bare.header_comparison is None and bare.trailer_comparison is None


def test_sample_of_equal_tables(spark):
    rows = [(i % 40 if i % 40 else None, f"v{i % 40}", float(i % 40)) for i in range(100)]
    table = spark.createDataFrame(rows, "`Row Key` int, name string, amount double")
    plain = reconcile(spark, table, table, ["row key"]).sample(7).collect()
    assert sample_of_equal_tables(spark, table, table, ["row key"], n=7).collect() == plain
    assert len(plain) == 7
