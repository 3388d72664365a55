"""Files as tables of raw lines, with header and trailer lines told apart from data.

Every line keeps its address: its file, where its split begins, and its index within that split. Working on raw lines lets
trailers be recognised before parsing, and keeps the original text for rejects.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable
from functools import reduce
from operator import or_
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.operators.lines import number_lines
from twinledger.sources.archives import read_archive_lines
from twinledger.sources.heads import UNORDERED, read_heads, total_bytes
from twinledger.spec import TableSpec

LINE, FILE, BLOCK, POSITION = "value", "__file", "__block", "__pos"
# Whether a record is whole but too long to be put together; its line is then its first one.
OVERLONG = "__overlong"

# More splits than this for each core only add tasks, unless splits of fewer would pass the cost of opening a file.
SPLITS_PER_CORE = 32

# Encodings that Spark decodes by itself, by their Python codec name.
SPARK_CHARSETS = {"ascii": "US-ASCII", "iso8859-1": "ISO-8859-1"}
WIDE_CHARSETS = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32-le": "UTF-32LE", "utf-32-be": "UTF-32BE"}

LINE_HEADS = T.StructType([T.StructField("line_number", T.LongType()), T.StructField("line", T.StringType())])


def _decoded(value: Column, encoding: str) -> Column:
    """Text from bytes that the text reader passed through unchanged."""
    codec = codecs.lookup(encoding).name
    if codec == "utf-8":
        return value
    if codec == "utf-8-sig":
        return F.regexp_replace(value, "^\ufeff", "")
    raw = value.cast("binary")
    charset = SPARK_CHARSETS.get(codec) or (WIDE_CHARSETS[codec] if codec.startswith("utf-16") else None)
    if charset:
        return F.decode(raw, charset)

    @F.pandas_udf("string")
    def decode(batch):
        return batch.map(lambda data: None if data is None else bytes(data).decode(codec))

    return decode(raw)


def raw_lines(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """All physical lines: value, file, where the line's split begins, and its index within that split.

    The splits are fixed here: they do not follow the cores or settings of the moment when the lines are read, so
    however often that is, and whatever executors come and go, a line's address stays the same.
    """
    if not spec.opens_natively:
        return read_archive_lines(spark, spec)
    name = codecs.lookup(spec.encoding).name
    if name not in UNORDERED:
        return _text_lines(spark, spec.path, spec.path, name)
    by_encoding: dict[str, list[str]] = {}
    for head in read_heads(spark, spec, 0):
        by_encoding.setdefault(head.encoding, []).append(head.path)
    parts = [_text_lines(spark, paths, spec.path, found) for found, paths in sorted(by_encoding.items())]
    return reduce(DataFrame.unionByName, parts) if parts else _text_lines(spark, spec.path, spec.path, UNORDERED[name])


def _text_lines(spark: SparkSession, paths: str | list[str], whole: str, name: str) -> DataFrame:
    """The lines of text files in one encoding, with one split to a partition.

    A partition that holds several files would hide where each begins. The settings that keep them apart
    are given to a session of this reader's own.
    """
    reader = spark.newSession()
    split = _split_bytes(spark, whole)
    for setting, value in (("maxPartitionBytes", split), ("openCostInBytes", split), ("maxPartitionNum", 2**31 - 1)):
        reader.conf.set(f"spark.sql.files.{setting}", str(value))
    source = reader.read
    wide = WIDE_CHARSETS.get(name)
    if wide:
        source = source.option("encoding", wide).option("lineSep", "\n")
    lines = source.text(paths).select(
        F.col("value"),
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(POSITION),
    )
    view = f"lines_{uuid4().hex}"
    lines.createGlobalTempView(view)
    try:
        lines = spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{view}")
    finally:
        spark.catalog.dropGlobalTempView(view)
    value = _decoded(F.col("value"), name)
    if wide:
        value = F.rtrim(value, F.lit("\r"))
        first = (F.col(BLOCK) == 0) & (F.col(POSITION) == 0)
        value = F.when(first, F.regexp_replace(value, "^\ufeff", "")).otherwise(value)
    return lines.select(value.alias(LINE), FILE, BLOCK, POSITION)


def _split_bytes(spark: SparkSession, path: str) -> int:
    """Spark's own rule for the size of splits, worked out once, with a bound on their number.

    With a setting of few bytes, their number would follow the input, and each has a task and a file wherever
    lines are read and staged.
    """
    most, least = (
        int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.files.{name}")))
        for name in ("maxPartitionBytes", "openCostInBytes")
    )
    size, cores = total_bytes(spark, path), spark.sparkContext.defaultParallelism
    return max(min(most, max(least, size // cores)), min(least, size // (cores * SPLITS_PER_CORE)))


def is_trailer(line: Column, patterns: tuple[str, ...]) -> Column:
    """True for lines that begin with a pattern, or with a quote and the pattern."""
    starts = [line.startswith(lead + p) for p in patterns for lead in ("", '"')]
    return reduce(or_, starts) if starts else F.lit(False)


def header_lines(spark: SparkSession, spec: TableSpec) -> list[str]:
    """The first ``header_rows`` lines of the first file by name, from the first bytes of the files.

    The last of them names the columns. Files of one folder whose names differ are refused: read by
    position, they would swap columns.
    """
    n = spec.header_rows
    if not n:
        return []
    if spec.opens_natively:
        heads = [(head.path, list(head.lines)) for head in read_heads(spark, spec, n)]
    else:
        by_file = raw_lines(spark, spec).filter(F.col(POSITION) < n).groupBy(FILE).agg(
            F.transform(F.array_sort(F.collect_list(F.struct(POSITION, LINE))), lambda x: x[LINE]).alias("lines")
        )
        heads = [(row[FILE], row["lines"]) for row in by_file.orderBy(FILE).collect()]  # one row for each member
    if len(heads) == 1:
        lines = heads[0][1]
    else:
        whole = [(path, lines) for path, lines in heads if len(lines) == n]
        lines = whole[0][1] if whole else []
        for path, others in whole:
            if others[-1].removeprefix("\ufeff") != lines[-1].removeprefix("\ufeff"):
                raise ValueError(f"files with different headers: {whole[0][0]} and {path}")
    return [line.removeprefix("\ufeff") if i == 0 else line for i, line in enumerate(lines)]


def header_frame(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines, start=1)), LINE_HEADS)


def trailer_frame(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """All trailer lines with their number among the trailers, in file order."""
    if not spec.trailer_patterns:
        return spark.createDataFrame([], LINE_HEADS)
    found = raw_lines(spark, spec).filter(is_trailer(F.col(LINE), spec.trailer_patterns))
    return numbered(found.select(LINE, FILE, BLOCK, POSITION))


def numbered(lines: DataFrame) -> DataFrame:
    """(line_number, line) in file order."""
    return number_lines(lines).select(F.col("line_number").cast("bigint"), F.col(LINE).alias("line"))


def data_lines(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """The lines that hold records: no header, no trailer, not empty."""
    lines = body_lines(raw_lines(spark, spec), spec)
    return lines.filter(~is_trailer(F.col(LINE), spec.trailer_patterns)) if spec.trailer_patterns else lines


def body_lines(
    raw: DataFrame,
    spec: TableSpec,
    joined: Callable[[DataFrame], DataFrame] | None = None,
    all_places: bool = False,
) -> DataFrame:
    """All lines after the header that are not empty, trailers included.

    ``joined`` may turn physical lines into records before empty lines go. With ``all_places``, every physical line
    keeps a row: the others come without text, so that lines can be counted from what is stored.
    """
    in_header = (F.col(BLOCK) == 0) & (F.col(POSITION) < spec.header_rows)
    lines = raw.select(LINE, FILE, BLOCK, POSITION)
    if spec.header_rows:
        lines = lines.filter(~in_header)
    lines = joined(lines) if joined else lines.withColumn(OVERLONG, F.lit(False))
    places = [F.when(F.length(LINE) > 0, F.col(LINE)).alias(LINE), FILE, BLOCK, POSITION, OVERLONG]
    if not all_places:
        lines = lines.filter(F.length(LINE) > 0).select(*places)
    elif joined:
        gone = raw.filter(in_header).select(F.lit(None).cast("string").alias(LINE), FILE, BLOCK, POSITION, F.lit(False).alias(OVERLONG))
        lines = lines.select(*places).unionByName(gone) if spec.header_rows else lines.select(*places)
    else:
        text = F.when(~in_header, F.col(LINE)) if spec.header_rows else F.col(LINE)
        lines = raw.select(text.alias(LINE), FILE, BLOCK, POSITION, F.lit(False).alias(OVERLONG)).select(*places)
    if spec.codec in ("gzip", "zip"):
        # Such a file is one task however large it is; spread its lines before they are parsed.
        lines = lines.repartition(spec.fan_out or lines.sparkSession.sparkContext.defaultParallelism, POSITION)
    return lines


def with_line_numbers(lines: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (file, block and position of some lines) with ``line_number``, from 1 within the file.

    ``lines`` has the address of every physical line of the files: the very table that the places come
    from, or lines of the same splits. A number follows from the index within a split and the lines of the
    file's earlier splits.
    """
    totals = lines.groupBy(FILE, BLOCK).agg((F.max(POSITION) + 1).alias("__n"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(FILE, BLOCK, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col(POSITION) + 1
    return places.join(before, [FILE, BLOCK]).withColumn("line_number", number).drop("__before")
