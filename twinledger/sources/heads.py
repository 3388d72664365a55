"""The first lines of files, by reading no more than their first bytes.

Spark's readers would scan whole splits to find them. The files are those that Spark lists for a path, opened through
Hadoop as Spark does, so any scheme and codec works; many files are opened at the same time.
"""

from __future__ import annotations

import codecs
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from twinledger.spec import TableSpec

# Bytes read at a time until the wanted lines are complete.
CHUNK = 64 * 1024
FILES_AT_ONCE = 16

# Byte order marks, longest first, and the encodings that leave the order to them.
MARKS = (
    (codecs.BOM_UTF32_LE, "utf-32-le"),
    (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF16_LE, "utf-16-le"),
    (codecs.BOM_UTF16_BE, "utf-16-be"),
)
UNORDERED = {"utf-16": "utf-16-le", "utf-32": "utf-32-le"}


@dataclass(frozen=True)
class Head:
    """The first lines of a file, and the encoding that its byte order mark fixes."""

    path: str
    lines: tuple[str, ...]
    encoding: str


def ordered_encoding(start: bytes, encoding: str) -> str:
    """The encoding with its byte order: by the mark at the start, else little-endian, as Python writes it."""
    name = codecs.lookup(encoding).name
    if name not in UNORDERED:
        return name
    marked = [found for mark, found in MARKS if found.startswith(name) and start.startswith(mark)]
    return marked[0] if marked else UNORDERED[name]


def input_files(spark: SparkSession, spec: TableSpec) -> list[str]:
    """The files behind a path, by name. No job runs."""
    return sorted(spark.read.text(spec.path).inputFiles())


def _read_head(spark: SparkSession, path: str, count: int, encoding: str) -> Head:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    stream = where.getFileSystem(conf).open(where)
    if codec is not None:
        stream = codec.createInputStream(stream)
    try:
        data, ended = b"", False
        while True:
            more = bytes(stream.readNBytes(CHUNK))
            data, ended = data + more, len(more) < CHUNK
            name = ordered_encoding(data, encoding)
            text = data.decode(name, errors="replace").removeprefix("﻿")
            lines = re.split("\r\n|\n" if name.startswith(("utf-16", "utf-32")) else "\r\n|\r|\n", text)
            if ended or len(lines) > count + 1:
                break
    finally:
        stream.close()
    if lines[-1] == "":
        lines.pop()
    return Head(path, tuple(lines[:count]), name)


def read_heads(spark: SparkSession, spec: TableSpec, count: int) -> list[Head]:
    """The first ``count`` lines of every file, in the order of the files' names."""
    read = inheritable_thread_target(spark)(lambda path: _read_head(spark, path, count, spec.encoding))
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        return list(pool.map(read, input_files(spark, spec)))


def total_bytes(spark: SparkSession, path: str) -> int:
    """How large the files behind a path are, as stored."""
    conf = spark._jsc.hadoopConfiguration()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    return sum(system.getContentSummary(found.getPath()).getLength() for found in system.globStatus(where) or ())
