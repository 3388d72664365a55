"""The published result tables of a run, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.functions.names import ref
from twinledger.operators.reconcile import status_rank
from twinledger.operators.results import data_columns, mismatches_only
from twinledger.plans.session import in_parallel

# Summary column -> label, in report order.
SUMMARY_LABELS = {
    "source_count": "Total Source Rows",
    "target_count": "Total Target Rows",
    "matching_rows": "Matching Rows",
    "mismatched_rows": "Mismatch Rows",
    "missing_in_source": "Missing in Source",
    "missing_in_target": "Missing in Target",
    "match_percentage": "Match Percentage",
}


def summary_metrics(summary: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The one-row summary as (position, metric, value), followed by what was compared."""
    entries = []
    for name, label in SUMMARY_LABELS.items():
        if name not in summary.columns:
            continue
        value = ref(name)
        if name.endswith("_percentage"):
            text = F.concat(F.call_function("format_number", value, F.lit("0.00")), F.lit("%"))
        else:
            text = value.cast("string")
        entries.append((F.lit(label), text))
    entries += [
        (F.lit("Primary Keys"), F.lit(", ".join(keys))),
        (F.lit("Columns Compared"), F.lit(str(len(columns)))),
        (F.lit("Column Names"), F.lit(", ".join(columns))),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), metric.alias("metric"), value.alias("value"))
            for i, (metric, value) in enumerate(entries, start=1)
        ]
    )
    return summary.select(F.inline(rows))


def in_report_order(detail: DataFrame, keys: list[str], cap: int | None = None) -> DataFrame:
    """Detail rows by status, then key; a cap turns the sort into a bounded top-n."""
    ordered = detail.orderBy(status_rank(), *[ref(k) for k in keys])
    return ordered if cap is None else ordered.limit(cap)


def source_target_table(detail: DataFrame, keys: list[str]) -> DataFrame:
    columns = data_columns(detail, keys)
    return detail.select(
        *[ref(k) for k in keys],
        *[ref(f"{c}_source") for c in columns],
        *[ref(f"{c}_target") for c in columns],
    )


def one_side_table(detail: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Keys and the values of one side (``source`` or ``target``) under their plain names."""
    columns = data_columns(detail, keys)
    return detail.select(*[ref(k) for k in keys], *[ref(f"{c}_{side}").alias(c) for c in columns])


def mismatch_table(detail: DataFrame, keys: list[str]) -> DataFrame:
    columns = data_columns(detail, keys)
    triplets = [ref(f"{c}_{part}") for c in columns for part in ("source", "target", "status")]
    return mismatches_only(detail).select(*[ref(k) for k in keys], "validation_status", *triplets)


def line_table(comparison: DataFrame) -> DataFrame:
    return comparison.select(F.col("line_number").alias("line"), "status", "source", "target").orderBy("line")


def reject_table(source: DataFrame | None, target: DataFrame | None) -> DataFrame | None:
    """Rejected lines of both sides in one table, with the side named."""
    sides = [(name, df) for name, df in (("source", source), ("target", target)) if df is not None]
    tagged = [df.select(F.lit(name).alias("side"), "*") for name, df in sides]
    if not tagged:
        return None
    return tagged[0] if len(tagged) == 1 else tagged[0].unionByName(tagged[1])


def report_tables(
    detail: DataFrame,
    summary: DataFrame,
    keys: list[str],
    sample: DataFrame | None = None,
    header_comparison: DataFrame | None = None,
    trailer_comparison: DataFrame | None = None,
    source_rejects: DataFrame | None = None,
    target_rejects: DataFrame | None = None,
    cap: int | None = None,
    sample_cap: int | None = None,
) -> dict[str, DataFrame]:
    """All tables of a report that have rows, by name; whole, unless caps are given.

    Hand in a detail table that is stored (as a run does), since each table is read on its own.
    Deciding which tables have rows takes one small job for each optional input.
    """
    described = sample if sample is not None and not sample.isEmpty() else detail
    tables = {"summary": summary_metrics(summary, keys, data_columns(described, keys))}
    if not detail.isEmpty():
        listed = in_report_order(detail, keys, cap)
        tables["source_target_comparison"] = source_target_table(listed, keys)
        tables["source_data"] = one_side_table(listed, keys, "source")
        tables["target_data"] = one_side_table(listed, keys, "target")
        if not mismatches_only(detail).isEmpty():
            tables["mismatch_details"] = mismatch_table(in_report_order(mismatches_only(detail), keys, cap), keys)
    for name, comparison in (
        ("header_comparison", header_comparison),
        ("trailer_comparison", trailer_comparison),
    ):
        if comparison is not None and not comparison.isEmpty():
            tables[name] = line_table(comparison)
    if sample is not None and not sample.isEmpty():
        ordered = sample.orderBy(*[ref(k) for k in keys])
        tables["sample_matching_data"] = ordered if sample_cap is None else ordered.limit(sample_cap)
    rejects = reject_table(source_rejects, target_rejects)
    if rejects is not None and not rejects.isEmpty():
        tables["rejected_records"] = rejects
    return tables


def write_report(tables: dict[str, DataFrame], output: str, fmt: str = "parquet") -> dict[str, str]:
    """One directory per table below ``output``; returns where each one is."""
    paths = {name: f"{output.rstrip('/')}/{name}" for name in tables}

    def write(name: str) -> Callable:
        writer = tables[name].write.mode("overwrite").format(fmt)
        writer = writer.option("header", True) if fmt == "csv" else writer
        return lambda: writer.save(paths[name])

    if tables:
        in_parallel(next(iter(tables.values())).sparkSession, *[write(name) for name in tables])
    return paths
