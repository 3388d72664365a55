"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (8).
Every query runs in full into Spark's no-op sink; the figure is the better of two runs, after one
small warm-up. Text inputs of the file comparisons are written before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from twinledger import JobConfig, TableSpec, read_table, reconcile  # noqa: E402
from twinledger.catalog import all_queries, files, pairs  # noqa: E402
from twinledger.plans.job import run_recon_job  # noqa: E402
from twinledger.plans.session import COMPILED_METHOD_LIMIT, scratch_dir  # noqa: E402

HEADLINES = [
    "recon_summary",
    "recon_summary_rules",
    "recon_unique_keys",
    "recon_detail",
    "recon_detail_capped",
    "recon_detail_long",
    "recon_keys_only",
    "missing_in_target",
    "column_stats",
    "recon_composite",
    "recon_null_keys",
    "recon_hot_keys",
    "recon_duplicates",
    "recon_duplicates_detail",
    "events_recon",
    "text_pair_rules",
    "key_profile",
    "dedup_rows",
    "accent_recon",
    "char_diff",
    "line_compare",
    "format_bytes",
    "render_timezones",
    "search_results",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("twinledger-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.codegen.hugeMethodLimit", str(COMPILED_METHOD_LIMIT))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: query for name, (query, _) in all_queries().items()}
    timed, rows = {}, {}

    def measure(name, action) -> None:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            action()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        timed[name] = round(best, 3)

    run(queries["recon_summary"](spark, sf_dir))
    for name in HEADLINES:
        measure(name, lambda: run(queries[name](spark, sf_dir)))

    # Two text files into a summary, and a whole run with all stored tables, as published for
    # 100K and 1M rows.
    root = scratch_dir(spark)
    source, target = pairs.orders_text_pair(spark, sf_dir)
    specs = [
        TableSpec(files.write_csv(source, f"{root}/orders_s"), header_rows=1),
        TableSpec(files.write_csv(target, f"{root}/orders_t"), header_rows=1),
    ]

    def file_comparison() -> None:
        left, right = (read_table(spark, spec) for spec in specs)
        # False: a look at the keys would parse the text once more.
        run(reconcile(spark, left.rows, right.rows, ["o_orderkey"], files.TEXT_RULES, unique_keys=False).summary)

    def whole_run() -> None:
        run_recon_job(
            spark,
            JobConfig("bench", *specs, ("o_orderkey",), scratch_dir(spark), rules=files.TEXT_RULES),
        )

    # Two copies of lineitem under different keys: over a million rows at sf0.1, as published.
    def stacked(df):
        return df.unionByName(df.withColumn("l_orderkey", F.col("l_orderkey") + 1_000_000_000))

    twice = [stacked(df) for df in pairs.lineitem_pair(spark, sf_dir)]
    measure(
        "recon_lineitem_twice",
        lambda: run(reconcile(spark, *twice, pairs.LINEITEM_KEYS, pairs.LINEITEM_RULES).summary),
    )
    measure("csv_files_summary", file_comparison)
    measure("csv_files_whole_run", whole_run)

    counts = {"orders": source.count(), "lineitem": pairs.load(spark, sf_dir, "lineitem").count()}
    rows["csv_files_summary"] = round(counts["orders"] / timed["csv_files_summary"])
    rows["csv_files_whole_run"] = round(counts["orders"] / timed["csv_files_whole_run"])
    rows["recon_summary_rules"] = round(counts["orders"] / timed["recon_summary_rules"])
    rows["recon_duplicates"] = round(counts["lineitem"] / timed["recon_duplicates"])
    rows["recon_lineitem_twice"] = round(2 * counts["lineitem"] / timed["recon_lineitem_twice"])
    print(
        json.dumps(
            {
                "metric": "total time of the headline reconciliation queries",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "rows": counts,
                "source_rows_per_sec": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
