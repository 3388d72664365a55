"""Reconcile two tables: classify every key and every cell, summarise, and list the differences."""

from __future__ import annotations

from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from twinledger.functions.compare import DIFFERENT, EXACT, MATCH, Cell, compare_cell
from twinledger.functions.names import key_names, ref, with_clean_names
from twinledger.operators.align import N_SOURCE, N_TARGET, SOURCE, TARGET, Aligned, align
from twinledger.spec import CompareRules

# Row statuses, in report order.
FOUND_IN_BOTH = "Found in Both"
MISSING_IN_SOURCE = "Missing in Source"
MISSING_IN_TARGET = "Missing in Target"
STATUS_ORDER = (FOUND_IN_BOTH, MISSING_IN_SOURCE, MISSING_IN_TARGET)

# Name of the array with one agreement level per compared column.
LEVELS = "__levels"

# Fixed value: matching rows shown unless asked otherwise.
SAMPLE_ROWS = 500

# Parts that the rows of one status are ranked in before they are ranked together.
RANK_PARTS = 64


def status_rank(status: Column | str = "validation_status") -> Column:
    """Position of a row status in reports: both, missing in source, missing in target."""
    column = F.col(status) if isinstance(status, str) else status
    rank = F.lit(len(STATUS_ORDER) + 1)
    for position, name in enumerate(STATUS_ORDER, start=1):
        rank = F.when(column == name, F.lit(position)).otherwise(rank)
    return rank


def match_percentage(matching: Column, total: Column) -> Column:
    return F.when(total > 0, matching / total * 100).otherwise(F.lit(0.0))


class ReconResult:
    """Lazy results of one reconciliation; nothing runs until a table is used.

    ``rows`` holds one row per key with its status and flags. Call ``persist`` when several of the
    tables below are wanted and the compared data fits the cluster's storage; otherwise each table
    is its own pass.
    """

    def __init__(self, aligned: Aligned, rules: CompareRules) -> None:
        self.keys = aligned.keys
        self.columns = list(aligned.columns)
        self.types = aligned.columns
        self.source_only = aligned.source_only
        self.target_only = aligned.target_only
        self.rules = rules
        self._aligned = aligned.frame

    # -- building blocks ---------------------------------------------------------------------

    def _cell(self, name: str) -> Cell:
        return compare_cell(
            name,
            self.types[name],
            F.col(SOURCE).getField(name),
            F.col(TARGET).getField(name),
            self.rules,
        )

    @cached_property
    def _cells(self) -> dict[str, Cell]:
        return {name: self._cell(name) for name in self.columns}

    @property
    def _key_refs(self) -> list[Column]:
        return [ref(k) for k in self.keys]

    @cached_property
    def rows(self) -> DataFrame:
        """Key, counts, records, ``validation_status``, ``mismatch_exact`` and ``mismatch``.

        ``mismatch_exact`` looks at normalized values only; ``mismatch`` also accepts values that
        agree within the numeric tolerance or as timestamps.
        """
        in_both = (F.col(N_SOURCE) > 0) & (F.col(N_TARGET) > 0)
        status = (
            F.when(F.col(N_SOURCE) == 0, F.lit(MISSING_IN_SOURCE))
            .when(F.col(N_TARGET) == 0, F.lit(MISSING_IN_TARGET))
            .otherwise(F.lit(FOUND_IN_BOTH))
        )
        levels = [cell.level for cell in self._cells.values()] or [F.lit(EXACT)]
        judged = self._aligned.select("*", status.alias("validation_status"), F.array(*levels).alias(LEVELS))
        worst = F.array_max(LEVELS)
        return judged.select(
            "*",
            (in_both & (worst > EXACT)).alias("mismatch_exact"),
            (in_both & (worst == DIFFERENT)).alias("mismatch"),
        )

    def _level(self, position: int) -> Column:
        return F.get(F.col(LEVELS), F.lit(position))

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> ReconResult:
        """Keep the aligned rows for the following tables; pair with ``unpersist``."""
        self._aligned = self._aligned.persist(level)
        self.__dict__.pop("rows", None)
        return self

    def unpersist(self) -> ReconResult:
        self._aligned.unpersist()
        return self

    # -- aggregates --------------------------------------------------------------------------

    @cached_property
    def summary(self) -> DataFrame:
        """One row of run statistics, in a single pass over the aligned rows."""
        status = F.col("validation_status")
        counted = self.rows.agg(
            F.coalesce(F.sum(N_SOURCE), F.lit(0)).alias("source_count"),
            F.coalesce(F.sum(N_TARGET), F.lit(0)).alias("target_count"),
            F.count_if(F.col(N_SOURCE) > 0).alias("source_keys"),
            F.count_if(F.col(N_TARGET) > 0).alias("target_keys"),
            F.count_if(status == FOUND_IN_BOTH).alias("found_in_both"),
            F.count_if(status == MISSING_IN_SOURCE).alias("missing_in_source"),
            F.count_if(status == MISSING_IN_TARGET).alias("missing_in_target"),
            F.count_if("mismatch").alias("mismatched_rows"),
            F.count_if("mismatch_exact").alias("mismatched_rows_exact"),
        )
        return derive_statistics(counted).select(
            "*",
            F.array(*[F.lit(c) for c in self.source_only]).cast("array<string>").alias("source_only_columns"),
            F.array(*[F.lit(c) for c in self.target_only]).cast("array<string>").alias("target_only_columns"),
        )

    @cached_property
    def column_stats(self) -> DataFrame:
        """Per compared column: keys in both, matching, mismatched, and the match percentage."""
        schema = "column_name string, compared bigint, matching bigint, mismatched bigint, match_percentage double"
        if not self.columns:
            return self._aligned.sparkSession.createDataFrame([], schema)
        in_both = F.col("validation_status") == FOUND_IN_BOTH
        counts = self.rows.agg(
            F.count_if(in_both).alias("_both"),
            *[
                F.count_if(in_both & (self._level(i) < DIFFERENT)).alias(f"_m{i}")
                for i in range(len(self.columns))
            ],
        )
        per_column = F.array(
            *[
                F.struct(F.lit(name).alias("column_name"), F.col(f"_m{i}").alias("matching"))
                for i, name in enumerate(self.columns)
            ]
        )
        return counts.select("_both", F.inline(per_column)).select(
            "column_name",
            F.col("_both").alias("compared"),
            "matching",
            (F.col("_both") - F.col("matching")).alias("mismatched"),
            match_percentage(F.col("matching"), F.col("_both")).alias("match_percentage"),
        )

    @cached_property
    def status_counts(self) -> DataFrame:
        """Keys per row status, with how many of them have differing values."""
        return self.rows.groupBy("validation_status").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if("mismatch").alias("mismatched_rows")
        )

    @cached_property
    def duplicate_keys(self) -> DataFrame:
        """Keys that repeat within a side, with their rows per side."""
        return self._aligned.filter((F.col(N_SOURCE) > 1) | (F.col(N_TARGET) > 1)).select(
            *self._key_refs, F.col(N_SOURCE).alias("source_rows"), F.col(N_TARGET).alias("target_rows")
        )

    # -- differences -------------------------------------------------------------------------

    def _differing(self, exact: bool = False) -> DataFrame:
        flag = "mismatch_exact" if exact else "mismatch"
        return self.rows.filter(F.col(flag) | (F.col("validation_status") != FOUND_IN_BOTH))

    def _triplets(self) -> list[Column]:
        clashes = {f"{c}_{part}" for c in self.columns for part in ("status", "source", "target")}.intersection(self.keys)
        if clashes:
            raise ValueError(f"key columns clash with result columns: {', '.join(sorted(clashes))}")
        out = []
        for i, (name, cell) in enumerate(self._cells.items()):
            out += [
                cell.status(self._level(i)).alias(f"{name}_status"),
                cell.source.alias(f"{name}_source"),
                cell.target.alias(f"{name}_target"),
            ]
        return out

    @cached_property
    def diff_keys(self) -> DataFrame:
        """Status and key of every difference."""
        return self._differing().select("validation_status", *self._key_refs)

    @cached_property
    def detail(self) -> DataFrame:
        """Every difference: status, key, then (status, source, target) per compared column."""
        return self._differing().select("validation_status", *self._key_refs, *self._triplets())

    @cached_property
    def detail_exact(self) -> DataFrame:
        """As ``detail``, but also rows that agree only within the tolerance."""
        return self._differing(exact=True).select("validation_status", *self._key_refs, *self._triplets())

    @cached_property
    def detail_long(self) -> DataFrame:
        """One row per differing cell; the form to use for wide tables."""
        cells = F.array(
            *[
                F.struct(
                    F.lit(name).alias("column_name"),
                    cell.status(self._level(i)).alias("cell_status"),
                    cell.source.alias("source_value"),
                    cell.target.alias("target_value"),
                )
                for i, (name, cell) in enumerate(self._cells.items())
            ]
        )
        return (
            self._differing()
            .select("validation_status", *self._key_refs, F.inline(cells))
            .filter(F.col("cell_status") != MATCH)
        )

    @cached_property
    def exceptions(self) -> DataFrame:
        """All that a run must keep: differences, tolerated differences and repeated keys.

        ``is_difference`` marks the rows of ``detail``. Together with the two row counts this
        table determines the summary and the column statistics, so one pass serves a whole run.
        """
        repeated = (F.col(N_SOURCE) > 1) | (F.col(N_TARGET) > 1)
        missing = F.col("validation_status") != FOUND_IN_BOTH
        return self.rows.filter(F.col("mismatch_exact") | missing | repeated).select(
            "validation_status",
            *self._key_refs,
            *self._triplets(),
            F.col(N_SOURCE).alias("source_rows"),
            F.col(N_TARGET).alias("target_rows"),
            "mismatch_exact",
            "mismatch",
            (F.col("mismatch") | missing).alias("is_difference"),
        )

    def detail_report(self, cap: int | None = None, per_status: int | None = None) -> DataFrame:
        """The differences in report order; if asked, at most ``per_status`` of each status, ``cap`` in all."""
        ordered = [status_rank(), *self._key_refs]
        capped = self.detail if per_status is None else top_per_status(self.detail, self.keys, per_status)
        return capped.orderBy(*ordered) if cap is None else capped.orderBy(*ordered).limit(cap)

    def sample(self, n: int = SAMPLE_ROWS) -> DataFrame:
        """The first ``n`` matching rows by key, both sides next to each other."""
        matching = self.rows.filter((F.col("validation_status") == FOUND_IN_BOTH) & ~F.col("mismatch"))
        columns = []
        for name, cell in self._cells.items():
            columns += [
                cell.source.alias(f"{name}_source"),
                cell.target.alias(f"{name}_target"),
                F.lit(MATCH).alias(f"{name}_status"),
            ]
        return matching.orderBy(*self._key_refs).limit(n).select(*self._key_refs, *columns)


def sample_of_equal_tables(
    spark: SparkSession,
    source: DataFrame,
    target: DataFrame,
    keys: str | list[str],
    rules: CompareRules | None = None,
    n: int = SAMPLE_ROWS,
) -> DataFrame:
    """What ``ReconResult.sample`` gives for tables known to match, without aligning all of them.

    The first ``n`` keys are found by reading keys alone; being at most ``n`` rows they are
    broadcast, and only the rows that have them are compared.
    """
    source, target = with_clean_names(source), with_clean_names(target)
    names = key_names(keys)
    first = source.select(*[ref(k) for k in names]).distinct().orderBy(*[ref(k) for k in names]).limit(n)
    wanted = F.broadcast(first.toDF(*[f"__k{i}" for i in range(len(names))]))
    same = reduce(and_, [ref(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)])
    left, right = (df.join(wanted, same, "left_semi") for df in (source, target))
    return reconcile(spark, left, right, names, rules).sample(n)


def derive_statistics(counted: DataFrame) -> DataFrame:
    """Add what follows from the raw counts. All derived numbers count distinct keys."""
    matching = F.col("found_in_both") - F.col("mismatched_rows")
    total = F.greatest("source_keys", "target_keys")
    return counted.select(
        "*",
        (F.col("source_count") - F.col("source_keys")).alias("source_duplicate_rows"),
        (F.col("target_count") - F.col("target_keys")).alias("target_duplicate_rows"),
        matching.alias("matching_rows"),
        match_percentage(matching, total).alias("match_percentage"),
        F.abs(F.col("source_count") - F.col("target_count")).alias("row_count_diff"),
    )


def top_per_status(detail: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by key of each status.

    Rows are ranked in parts of each status first, and the first ``n`` of each part then together, so one
    status never fills one task. Spark also cuts each ranking down before its shuffle, for moderate ``n``.
    """
    key_refs = [ref(k) for k in keys]
    status, part = F.col("validation_status"), F.pmod(F.xxhash64(*key_refs), F.lit(RANK_PARTS))
    for groups in ([status, F.col("__part")], [status]):
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*key_refs))
        detail = detail.withColumn("__part", part).withColumn("__rank", rank).filter(F.col("__rank") <= n)
    return detail.drop("__part", "__rank")


def reconcile(
    spark: SparkSession,
    source: DataFrame,
    target: DataFrame,
    keys: str | list[str],
    rules: CompareRules | None = None,
    unique_keys: bool | None = None,
) -> ReconResult:
    """Compare two tables on a composite key under the given rules.

    Unless ``unique_keys`` is False, the keys are looked at first (see ``align``); all else is lazy.
    """
    rules = rules or CompareRules()
    aligned = align(source, target, keys, unique_keys=unique_keys, numeric_scale=rules.numeric_scale)
    return ReconResult(aligned, rules)

