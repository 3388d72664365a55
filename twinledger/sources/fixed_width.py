"""Fixed-width lines: widths, names from a header line, and slicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions.names import clean_name, distinct_names
from twinledger.functions.normalize import whitespace
from twinledger.sources.lines import LINE, data_lines, header_lines
from twinledger.spec import TableSpec


def parse_widths(widths: str | None) -> list[tuple[int, int]] | None:
    """``"10,5,8"`` to half-open positions; parts that are not numbers are skipped."""
    if not widths:
        return None
    specs, start = [], 0
    for part in widths.split(","):
        if part.strip().isdigit():
            width = int(part)
            specs.append((start, start + width))
            start += width
    return specs


def names_from_header(line: str, col_specs) -> list[str]:
    """Names cut from the header line with the column positions; a blank one becomes ``columnN``."""
    return [line[a:b].strip() or f"column{i}" for i, (a, b) in enumerate(col_specs)]


def column_names(spec: TableSpec, headers: list[str]) -> list[str]:
    """Given names first, then the last header line, then ``columnN``."""
    given = list(spec.column_names or ())
    if not given and headers:
        given = names_from_header(headers[-1], spec.col_specs)
    named = given[: len(spec.col_specs)]
    return distinct_names(named + [f"column{i}" for i in range(len(named), len(spec.col_specs))])


def slice_lines(lines: DataFrame, col_specs, names: list[str], line: str = LINE) -> DataFrame:
    """One column per (start, end), with surrounding whitespace removed."""
    return lines.select(*slices(col_specs, names, line))


def slices(col_specs, names: list[str], line: str = LINE) -> list[Column]:
    text, blanks = F.col(line), F.lit(whitespace())
    return [
        F.trim(F.substring(text, start + 1, end - start), blanks).alias(clean_name(name))
        for (start, end), name in zip(col_specs, names, strict=True)
    ]


def read_fixed_width(spark: SparkSession, spec: TableSpec, headers: list[str] | None = None) -> DataFrame:
    """Records of a fixed-width file; without positions, the whole line in ``raw_line``."""
    lines = data_lines(spark, spec)
    if not spec.col_specs:
        return lines.select(F.col(LINE).alias("raw_line"))
    headers = header_lines(spark, spec) if headers is None else headers
    return slice_lines(lines, spec.col_specs, column_names(spec, headers))


def convert_fixed_width(spark: SparkSession, spec: TableSpec, output: str) -> str:
    """Write a fixed-width file as Parquet and return where."""
    read_fixed_width(spark, spec).write.mode("overwrite").parquet(output)
    return output
