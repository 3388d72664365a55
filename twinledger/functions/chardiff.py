"""Positional character differences between two strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAR_DIFF_TYPE = "array<struct<pos:int,src:string,tgt:string,match:boolean>>"


def characters(text: Column) -> Column:
    """The characters of a string as an array; the empty string gives an empty array."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def char_diff(source: Column, target: Column) -> Column:
    """Every position (from 0) where the strings differ; past the end a side is null.

    Both strings are split once and zipped, so the work is linear in their length.
    """
    paired = F.zip_with(characters(source), characters(target), lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    located = F.transform(
        paired,
        lambda pair, pos: F.struct(
            pos.alias("pos"),
            pair["s"].alias("src"),
            pair["t"].alias("tgt"),
            F.lit(False).alias("match"),
        ),
    )
    return F.filter(located, lambda d: ~d["src"].eqNullSafe(d["tgt"]))
