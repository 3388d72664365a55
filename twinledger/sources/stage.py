"""Parse a text file once into Parquet, and read everything about it from there.

A run needs a text input several times: its rows, their number, its rejects and its trailers. One
pass over the lines writes them all to one staged table, tagged by kind. Later reads are columnar:
counts touch only the tag, and rejects and trailers skip the row groups that hold none. Every physical line has a
row with its address, those of headers and empty lines too, so line numbers come from the staged table alone,
whatever becomes of the file, the settings or the executors after it was written. Lines are parsed
alone first; only if one leaves a quoted field open is the file read again, with such lines joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions.names import ref
from twinledger.sources import delimited, fixed_width
from twinledger.sources.lines import (
    BLOCK,
    FILE,
    LINE,
    LINE_HEADS,
    POSITION,
    body_lines,
    header_frame,
    header_lines,
    is_trailer,
    numbered,
    raw_lines,
)
from twinledger.sources.read import LoadedTable, delimited_names, read_table
from twinledger.spec import TableSpec

KIND = "__kind"
ROW, REJECTED, TRAILER, OTHER = "row", "reject", "trailer", "other"


def stage_table(spark: SparkSession, spec: TableSpec, path: str) -> LoadedTable:
    """As ``read_table``, from a staged copy at ``path``. Parquet inputs are read in place."""
    if spec.is_parquet:
        return read_table(spark, spec)
    headers = header_lines(spark, spec)
    raw = raw_lines(spark, spec)
    lines = body_lines(raw, spec, all_places=True)
    if spec.is_fixed_width:
        if spec.col_specs:
            names = fixed_width.column_names(spec, headers)
            fields = fixed_width.slices(spec.col_specs, names)
        else:
            names, fields = ["raw_line"], [F.col(LINE).alias("raw_line")]
        no_reason = F.lit(None).cast("string").alias(delimited.REJECT)
        parsed = lines.select(*fields, F.col(LINE).alias(delimited.RAW), FILE, BLOCK, POSITION, no_reason)
    else:
        names = delimited_names(spark, spec, headers)
        if not names:
            return read_table(spark, spec)
        if spec.multi_line and spec.opens_natively:
            parsed = delimited.parse_multi_line(spark, names, spec)
        else:
            parsed = delimited.parse_lines(lines, names, spec)
    stored = _stored(spark, spec, names, parsed, path)
    if not spec.is_fixed_width and not spec.multi_line:
        # Without a field that is open at a line's end, no record spans lines, and nothing is left to do.
        if not stored.filter(F.col(delimited.REJECT) == delimited.UNFINISHED).isEmpty():
            records = body_lines(raw, spec, lambda x: delimited.join_records(x, len(names), spec), all_places=True)
            parsed = delimited.parse_lines(records, names, spec)
            stored = _stored(spark, spec, names, parsed, f"{path}_records")
    return LoadedTable(
        spec,
        rows=stored.filter(F.col(KIND) == ROW).select(*[ref(n) for n in names]),
        rejects=delimited.rejected_rows(None if spec.multi_line and spec.opens_natively else stored, stored),
        headers=header_frame(spark, headers),
        header_text=tuple(headers),
        trailers=_trailers(spark, spec, headers, stored),
        counts_of=stored.agg(
            F.count_if(F.col(KIND) == ROW).alias("row_count"),
            F.count_if(F.col(KIND) == REJECTED).alias("reject_count"),
        ),
    )


def _stored(spark: SparkSession, spec: TableSpec, names: list[str], parsed: DataFrame, path: str) -> DataFrame:
    raw = F.col(delimited.RAW)
    # Spark's own reader of records gives the text of rejects alone.
    whole_records = spec.multi_line and spec.opens_natively and not spec.is_fixed_width
    kind = (
        F.when(raw.isNull() & F.lit(not whole_records), F.lit(OTHER))
        .when(is_trailer(raw, spec.trailer_patterns), F.lit(TRAILER))
        .when(F.col(delimited.REJECT).isNotNull(), F.lit(REJECTED))
        .otherwise(F.lit(ROW))
    )
    staged = parsed.select(
        *[ref(n) for n in names],
        F.when(kind.isin(REJECTED, TRAILER), raw).alias(delimited.RAW),
        FILE,
        BLOCK,
        POSITION,
        delimited.REJECT,
        kind.alias(KIND),
    )
    staged.write.mode("overwrite").parquet(path)
    return spark.read.schema(staged.schema).parquet(path)


def _trailers(spark, spec, headers, stored):
    """Trailer lines in file order; a header line that looks like a trailer counts as one too."""
    if not spec.trailer_patterns:
        return spark.createDataFrame([], LINE_HEADS)
    among_headers = [h for h in headers if h.startswith(tuple(q + p for p in spec.trailer_patterns for q in ("", '"')))]
    found = numbered(stored.filter(F.col(KIND) == TRAILER).select(F.col(delimited.RAW).alias(LINE), FILE, BLOCK, POSITION))
    if not among_headers:
        return found
    shifted = found.withColumn("line_number", F.col("line_number") + len(among_headers))
    return header_frame(spark, among_headers).unionByName(shifted)
