"""Delimited lines to columns of text, with rejected lines kept apart.

A line is rejected when it has more fields than there are columns, or when a quoted field never
ends. A line with fewer fields is padded with nulls. A quoted field may go on over line ends: such lines
are joined to one record, also across the splits of a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.functions.names import distinct_names, ref
from twinledger.operators.lines import CHUNK_BITS
from twinledger.sources.lines import BLOCK, FILE, LINE, OVERLONG, POSITION, with_line_numbers
from twinledger.spec import TableSpec

RAW, REJECT = "__raw", "__reject"

# Why a line was rejected.
TOO_MANY = "TOO MANY COLUMNS"
UNFINISHED = "UNQUOTED VALUE"
TOO_LONG = "LINE SIZE OVER MAXIMUM"

# Fields that Spark's CSV parser is always let to find in a line.
MOST_FIELDS = 1_000_000

# A field no file holds (Unicode noncharacters), put after a line to see where its fields end.
END_MARK = "\ufdd0\ufdd1"


def most_fields(count: int) -> int:
    """Most fields that Spark's CSV parser is let to find in a line of ``count`` columns.

    More would fail the whole query, so lines with more delimiters, which are too long for any such
    table, are rejected before they are parsed.
    """
    return max(MOST_FIELDS, 2 * count)


def csv_options(spec: TableSpec, count: int) -> dict[str, str]:
    return {
        "sep": spec.delimiter,
        "quote": spec.quote,
        "escape": spec.quote,
        "maxCharsPerColumn": "-1",
        "maxColumns": str(most_fields(count)),
    }


def _cannot_be_parsed(line: Column, count: int, spec: TableSpec) -> Column:
    """True for lines with more delimiters outside quotes than the parser can take."""
    mark = re.escape(spec.quote)
    outside = F.regexp_replace(line, f"{mark}[^{mark}]*{mark}", "")
    without = F.length(F.replace(outside, F.lit(spec.delimiter), F.lit("")))
    delimiters = (F.length(outside) - without) / len(spec.delimiter)
    return (F.octet_length(line) >= most_fields(count)) & (delimiters >= most_fields(count) - 2)


def fields_of(spark: SparkSession, spec: TableSpec, line: str) -> list[str | None]:
    """The fields of one line, by Spark's own CSV rules; an end mark shows how many there are."""
    if spec.quote not in line:
        return [value or None for value in line.split(spec.delimiter)]
    most = line.count(spec.delimiter) + 1
    parsed = _fields(F.lit(line + spec.delimiter + END_MARK), most + 1, spec)
    values = list(spark.range(1).select(parsed.alias("r")).head()["r"])
    return values[: values.index(END_MARK)] if END_MARK in values else values[:most]


def header_names(spark: SparkSession, spec: TableSpec, line: str) -> list[str]:
    """Column names from a header line; a blank name becomes ``columnN``."""
    values = fields_of(spark, spec, line)
    return distinct_names([(v or "").strip() or f"column{i}" for i, v in enumerate(values)])


def auto_names(count: int) -> list[str]:
    return [f"column{i}" for i in range(count)]


def _fields(line: Column, count: int, spec: TableSpec, corrupt: bool = False) -> Column:
    names = [f"c{i} string" for i in range(count)]
    options = csv_options(spec, count)
    if corrupt:
        names.append("_bad string")
        options["columnNameOfCorruptRecord"] = "_bad"
    return F.from_csv(line, ", ".join(names), options)


def parse_lines(lines: DataFrame, names: list[str], spec: TableSpec) -> DataFrame:
    """Columns ``names`` plus the raw line, its place, and why it is rejected (null for good lines).

    Spark flags lines whose field count is not that of the schema, in either direction. Only those,
    and lines with an odd number of quotes, are parsed once more with an end mark added: the mark
    comes out as a field of its own within the columns unless there are too many fields before it
    or an open quote swallows it.
    """
    line, count = F.col(LINE), len(names)
    # `inline` makes the parsed fields plain columns, so that no later filter parses a line again.
    hopeless, overlong = _cannot_be_parsed(line, count, spec), F.col(OVERLONG)
    fields = _fields(F.when(~hopeless & ~overlong, line), count, spec, corrupt=True)
    parsed = lines.select(LINE, FILE, BLOCK, POSITION, OVERLONG, F.inline(F.array(fields)))
    odd_quotes = _odd_quotes(line, spec)
    suspect = F.col("_bad").isNotNull() | odd_quotes
    reason = F.when(odd_quotes, F.lit(UNFINISHED)).otherwise(F.lit(TOO_MANY))
    reject = (
        F.when(overlong, F.lit(TOO_LONG))
        .when(hopeless, F.lit(TOO_MANY))
        .when(suspect, F.when(~_well_formed(line, count, spec), reason))
    )
    return parsed.select(*_named(names), line.alias(RAW), FILE, BLOCK, POSITION, reject.alias(REJECT))


def _odd_quotes(line: Column, spec: TableSpec) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(spec.quote), F.lit("")))) % 2 == 1


def _ends_amid(line: Column, spec: TableSpec) -> Column:
    """Whether a quoted field is followed by something other than a delimiter or the end."""
    quote, sep = re.escape(spec.quote), re.escape(spec.delimiter)
    plain = F.replace(line, F.lit(spec.quote * 2), F.lit(""))
    return plain.rlike(f"(?s)(?:^|{sep}){quote}[^{quote}]*{quote}(?!{sep}|\\z)")


def may_span_lines(lines: DataFrame, spec: TableSpec) -> bool:
    """Whether some line holds an odd number of quotes, without which no field goes on over its end."""
    return not lines.filter(_odd_quotes(F.col(LINE), spec)).isEmpty()


def join_records(lines: DataFrame, count: int, spec: TableSpec) -> DataFrame:
    """Physical lines to records: lines within one quoted field are joined by a line feed.

    Only lines with an odd number of quotes change whether a field is open. Those that leave a field open when
    they begin with none toggle; the others can only close one. What is open before a line follows from the
    toggles since the last line that closed for certain, counted within chunks of a file and then over its
    chunks. A record counts if it closes and parses to ``count`` fields or less; else each of its lines is judged
    alone, so one stray quote costs its own line and no more.

    A record of more than ``max_record_bytes`` is judged without being put together: each of its lines tells how many
    fields it ends and whether it is sound, given that a field is open before it, and these are added up.
    If it is a record, it comes as its first line, marked as overlong, and none of its lines becomes a row.

    Each physical line that is part of an earlier one's record keeps a row without text.
    """
    chunk = [FILE, BLOCK, "__chunk"]
    line, odd = F.col(LINE), _odd_quotes(F.col(LINE), spec)
    lines = lines.select(LINE, FILE, BLOCK, POSITION)
    marked = (
        lines.withColumn("__chunk", F.shiftright(F.col(POSITION), CHUNK_BITS))
        .withColumn("__odd", odd)
        .withColumn(
            "__opens",
            F.when(odd & ~_cannot_be_parsed(line, count, spec), ~_well_formed(line, count, spec)).otherwise(F.lit(False)),
        )
    )
    in_order = Window.partitionBy(*chunk).orderBy(POSITION)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    closes = F.col("__odd") & ~F.col("__opens")
    counted = marked.withColumn("__t", F.sum(F.col("__opens").cast("bigint")).over(so_far))
    counted = counted.withColumn("__closed_at", F.max(F.when(closes, F.col("__t"))).over(earlier))
    # Chunks in file order: open at the start of one if the toggles since the last closing one are odd.
    totals = counted.groupBy(*chunk).agg(
        F.max("__t").alias("__all"), F.max(F.when(closes, F.col("__t"))).alias("__last")
    )
    of_file = Window.partitionBy(FILE).orderBy(BLOCK, "__chunk")
    chunks_before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    tail = F.col("__all") - F.coalesce("__last", F.lit(0))
    totals = totals.withColumn("__sum", F.coalesce(F.sum(tail).over(chunks_before), F.lit(0)))
    base = F.max(F.when(F.col("__last").isNotNull(), F.col("__sum"))).over(chunks_before)
    enters = totals.select(*chunk, (F.col("__sum") - F.coalesce(base, F.lit(0))).alias("__enter"))
    toggles = F.col("__t") - F.col("__opens").cast("bigint")
    before = F.when(F.col("__closed_at").isNotNull(), toggles - F.col("__closed_at")).otherwise(
        toggles + F.col("__enter")
    )
    stated = counted.join(enters, chunk).withColumn("__inside", before % 2 == 1)
    starts = F.when(F.col("__opens") & ~F.col("__inside"), F.struct(BLOCK, POSITION))
    stated = stated.withColumn("__first", F.last(starts, ignorenulls=True).over(so_far))
    carried = stated.groupBy(*chunk).agg(F.max(starts).alias("__latest"))
    carried = carried.select(*chunk, F.last("__latest", ignorenulls=True).over(chunks_before).alias("__carried"))
    grouped = stated.join(carried, chunk).withColumn(
        "__record",
        F.when(F.col("__inside") | (F.col("__opens") & ~F.col("__inside")), F.coalesce("__first", "__carried")),
    )
    kept = [LINE, FILE, BLOCK, POSITION, OVERLONG]
    grouped = grouped.withColumn(OVERLONG, F.lit(False))
    alone = grouped.filter(F.col("__record").isNull()).select(*kept)
    spanning = grouped.filter(F.col("__record").isNotNull()).select(*kept, "__odd", "__record")
    sizes = spanning.groupBy(FILE, "__record").agg(
        (F.sum(F.octet_length(LINE)) + F.count(F.lit(1))).alias("__bytes"),
        F.count_if("__odd").alias("__quotes"),
        F.max(F.struct(BLOCK, POSITION)).alias("__end"),
    )
    closed, small = F.col("__quotes") > 1, F.col("__bytes") <= spec.max_record_bytes
    sized = spanning.join(sizes, [FILE, "__record"])
    gathered = (
        sized.filter(closed & small)
        .groupBy(FILE, "__record")
        .agg(F.array_sort(F.collect_list(F.struct(BLOCK, POSITION, LINE))).alias("__lines"))
        .withColumn("__text", F.array_join(F.transform("__lines", lambda x: x[LINE]), "\n"))
    )
    sound = _well_formed(F.col("__text"), count, spec) & ~_ends_amid(F.col("__text"), spec)
    start = F.col("__record")
    whole = F.struct(start[BLOCK].alias(BLOCK), start[POSITION].alias(POSITION), F.col("__text").alias(LINE))
    inner = F.transform(
        F.slice("__lines", F.lit(2), F.size("__lines")),
        lambda x: F.struct(x[BLOCK].alias(BLOCK), x[POSITION].alias(POSITION), F.lit(None).cast("string").alias(LINE)),
    )
    each = F.when(sound, F.concat(F.array(whole), inner)).otherwise(F.col("__lines"))
    records = gathered.select(FILE, F.inline(each)).withColumn(OVERLONG, F.lit(False)).select(*kept)
    large = _overlong(sized.filter(closed & ~small), count, spec).select(*kept)
    return alone.unionByName(records).unionByName(large).unionByName(sized.filter(~closed).select(*kept))


def _overlong(lines: DataFrame, count: int, spec: TableSpec) -> DataFrame:
    """The lines of records that are too long to be put together, each record judged as a whole."""
    line, quote = F.col(LINE), F.lit(spec.quote)
    place, start = F.struct(BLOCK, POSITION), F.col("__record")
    first, last = place == start, place == F.col("__end")
    # With the quotes that the lines before and after would supply, a line is a piece of a record of its own.
    piece = F.concat(F.when(first, F.lit("")).otherwise(quote), line, F.when(last, F.lit("")).otherwise(quote))
    mark = re.escape(spec.quote)
    outside = F.regexp_replace(piece, f"{mark}[^{mark}]*{mark}", "")
    ended = (F.length(outside) - F.length(F.replace(outside, F.lit(spec.delimiter), F.lit("")))) / len(spec.delimiter)
    judged = lines.withColumn("__sound", _well_formed(piece, count, spec) & ~_ends_amid(piece, spec))
    judged = judged.withColumn("__ended", ended)
    verdicts = judged.groupBy(FILE, "__record").agg(
        (F.min("__sound") & (F.sum("__ended") < count)).alias("__whole"),
    )
    found = lines.join(verdicts, [FILE, "__record"])
    text = F.when(first | ~F.col("__whole"), line)
    return found.withColumn(OVERLONG, F.col("__whole") & first).withColumn(LINE, text)


def parse_multi_line(spark: SparkSession, names: list[str], spec: TableSpec) -> DataFrame:
    """As ``parse_lines``, with Spark's own reader of records that span lines.

    Files are then not split, so this is opt-in. Trailers are recognised by the first column, and rejects
    have no line number.
    """
    if spec.header_rows > 1:
        raise ValueError("multi_line supports one header row")
    count = len(names)
    fields = ", ".join([*[f"c{i} string" for i in range(count)], "_bad string"])
    reader = spark.read.schema(fields).options(**csv_options(spec, len(names))).option("multiLine", True)
    reader = reader.option("header", spec.header_rows > 0).option("encoding", spec.encoding)
    records = reader.option("columnNameOfCorruptRecord", "_bad").csv(spec.path)
    first = F.coalesce("c0", F.lit(""))
    for pattern in spec.trailer_patterns:
        records = records.filter(~first.startswith(pattern))
    # Naming the first column here matters: Spark refuses to read the raw record alone.
    suspect = F.col("_bad").isNotNull() & (first != END_MARK)
    reason = F.when(_odd_quotes(F.col("_bad"), spec), F.lit(UNFINISHED)).otherwise(F.lit(TOO_MANY))
    reject = F.when(suspect, F.when(~_well_formed(F.col("_bad"), count, spec), reason))
    return records.select(
        *_named(names),
        F.col("_bad").alias(RAW),
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(POSITION),
        reject.alias(REJECT),
    )


def _named(names: list[str]) -> list[Column]:
    """The parsed fields under their names; an empty field is null, quoted or not."""
    return [F.nullif(F.col(f"c{i}"), F.lit("")).alias(name) for i, name in enumerate(names)]


def _well_formed(line: Column, count: int, spec: TableSpec) -> Column:
    """True when the end mark added to a line comes out as a field of its own, not too far right."""
    marked = _fields(F.concat(line, F.lit(spec.delimiter + END_MARK)), count + 1, spec)
    found = F.exists(
        F.array(marked),
        lambda r: F.array_contains(F.array(*[r.getField(f"c{i}") for i in range(count + 1)]), END_MARK),
    )
    return F.coalesce(found, F.lit(False))


def good_rows(parsed: DataFrame, names: list[str]) -> DataFrame:
    return parsed.filter(F.col(REJECT).isNull()).select(*[ref(n) for n in names])


def rejected_rows(lines: DataFrame | None, parsed: DataFrame) -> DataFrame:
    """Where each reject stands (file and line), why, and its text.

    ``lines`` has the address of every physical line, from which the numbers follow; without it there are none.
    """
    found = parsed.filter(F.col(REJECT).isNotNull()).select(FILE, BLOCK, POSITION, REJECT, RAW)
    if lines is None:
        numbered = found.withColumn("line_number", F.lit(None).cast("bigint"))
    else:
        numbered = with_line_numbers(lines, found)
    return numbered.select(
        F.col(FILE).alias("file"),
        "line_number",
        F.col(REJECT).alias("error_type"),
        F.col(RAW).alias("csv_line"),
    )
