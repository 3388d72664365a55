"""Component-by-component comparison of two file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.functions.fmt import name_components
from twinledger.operators.reconcile import MISSING_IN_SOURCE, MISSING_IN_TARGET


def compare_name_components(
    names: DataFrame, source: str = "source_name", target: str = "target_name"
) -> DataFrame:
    """One row per component position: the two parts and whether they agree.

    Both names stand in the same row, so their parts are zipped in place; no join is needed.
    """
    kept = [c for c in names.columns if c not in (source, target)]
    pairs = F.arrays_zip(
        name_components(F.col(source)).alias("source_part"), name_components(F.col(target)).alias("target_part")
    )
    parts = names.select(*kept, F.posexplode(pairs).alias("position", "_pair"))
    s, t = F.col("_pair.source_part"), F.col("_pair.target_part")
    return parts.select(
        *kept,
        F.col("position").cast("int").alias("position"),
        s.alias("source_part"),
        t.alias("target_part"),
        F.when(s == t, F.lit("MATCH"))
        .when(s.isNull(), F.lit(MISSING_IN_SOURCE))
        .when(t.isNull(), F.lit(MISSING_IN_TARGET))
        .otherwise(F.lit("MISMATCH"))
        .alias("status"),
    )
