"""Lines of compressed files that Spark's text reader does not open by itself.

Zip archives, and gzip or bzip2 data under another suffix. Each member of a zip archive is a file of its
own, named ``<archive>!<member>``. The bytes come from Spark's ``binaryFile`` source, one file per task at a
time, and are decompressed as a stream. Spark refuses files of 2 GiB or more there, by name; unpack
those first.
"""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import zipfile
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.spec import TableSpec

ROWS_PER_BATCH = 20_000


def _open_members(path: str, content: bytes, codec: str) -> Iterator[tuple[str, IO[bytes]]]:
    """(name, stream) of everything that the file holds, in the order of the archive's directory."""
    data = io.BytesIO(content)
    if codec == "gzip":
        yield path, gzip.open(data)
    elif codec == "bzip2":
        yield path, bz2.open(data)
    else:
        archive = zipfile.ZipFile(data)
        members = [m for m in archive.infolist() if not m.is_dir()]
        if not members:
            raise ValueError(f"empty zip file: {path}")
        for member in members:
            yield f"{path}!{member.filename}", archive.open(member)


def read_archive_lines(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """All physical lines: value, file, block (always 0), and the index within the file."""
    codec, encoding = spec.codec, spec.encoding

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for name, stream in _open_members(path, content, codec):
                    with io.TextIOWrapper(stream, encoding=encoding) as text:
                        numbers = itertools.count()
                        while chunk := [line.rstrip("\n") for line in itertools.islice(text, ROWS_PER_BATCH)]:
                            yield pd.DataFrame(
                                {"value": chunk, "__file": name, "__pos": [next(numbers) for _ in chunk]}
                            )

    files = spark.read.format("binaryFile").load(spec.path).select("path", "content")
    lines = files.mapInPandas(lines_of, "value string, __file string, __pos bigint")
    return lines.select("value", "__file", F.lit(0).cast("bigint").alias("__block"), "__pos")
