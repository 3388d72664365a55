"""WARC: deduplicated archives by revisit resolution.

Only headers (row, page, digests, size) are shuffled by payload digest to decide which record is the
response; the payloads move once, to meet that decision. Archives are written by Spark as gzipped WARC/1.1 files
in the shared folder, so they may lie in any store that Spark writes to. Reading back cuts the
archives by the records' own lengths, takes size and digest from the payloads themselves, and joins
revisit records to the original responses.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is the
response (a null page_id is larger than all others); smaller payloads are always responses. Null payloads are
empty. Rows that repeat page_id and payload are separate records; one of them is the response and the
others revisit it, even though they share its page_id. Line breaks and other control characters in a URL
are percent-encoded; a null URL or page_id leaves its header out. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm.common import numbered, written
from twinledger.plans.session import scratch_dir

#: Bytes that a file of an archive should hold before it is compressed, so that a task reads one within its memory.
FILE_BYTES = 32_000_000
EPOCH = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_PARSED = (
    "record_id string, page_id long, url string, record_type string, refers_to_record string, "
    "header_digest string, payload_bytes long, payload_digest string"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits give four of base 32."""
    hex_digits = F.sha1(data)
    parts = [
        F.lpad(F.conv(F.substring(hex_digits, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)
    ]
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def headers(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """_row, page_id, _digest, _content, _bytes of every payload of pages numbered as _row."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return written(
        spark,
        rows.select(
            "_row",
            "page_id",
            base32_sha1(payload).alias("_digest"),
            F.sha2(payload, 256).alias("_content"),
            F.octet_length(payload).cast("long").alias("_bytes"),
        ),
    )


def decide(spark: SparkSession, heads: DataFrame, min_bytes: int) -> DataFrame:
    """_row, _digest, _first (the response's row) for every row of ``headers``."""
    first = written(
        spark,
        heads.filter(F.col("_bytes") >= min_bytes)
        .groupBy("_content")
        .agg(F.coalesce(F.min_by("_row", "page_id"), F.min("_row")).alias("_first")),
    )
    shared = heads.join(first, "_content", "left")
    return shared.select("_row", "_digest", F.coalesce("_first", "_row").alias("_first"))


def _record_id(row: Column) -> Column:
    digest = F.md5(F.concat(F.lit("record "), row.cast("string")))
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(
    spark: SparkSession, pages: DataFrame, path: str, min_bytes: int = 0, date: str = EPOCH
) -> None:
    """Write pages (page_id, url, html) as WARC files below path."""
    stored = numbered(spark, pages.select("page_id", "url", "html"), "_row")
    heads = headers(spark, stored)
    decisions = decide(spark, heads, min_bytes)
    html = F.coalesce("html", F.lit(""))
    rows = stored.select("_row", "page_id", "url", html.alias("html"))
    mean_bytes = heads.agg(F.avg("_bytes")).head()[0] or 0
    per_file = max(1, int(FILE_BYTES / (mean_bytes + 500)))
    url = F.col("url")
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    revisit = F.col("_first") != F.col("_row")
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("_row"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _header("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("_first")))),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    records = rows.join(decisions, "_row").select(record.alias("value"))
    records.write.option("lineSep", _END).option("maxRecordsPerFile", per_file).text(path, compression="gzip")


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of one file, cut by their own lengths."""
    at = 0
    while at < len(content):
        split = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:split].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {version[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        begin = split + 4
        end = begin + int(fields["Content-Length"])
        payload = content[begin:end]
        page, response = fields.get("X-Page-ID"), fields["WARC-Type"] == "response"
        yield {
            "record_id": fields["WARC-Record-ID"],
            "page_id": None if page is None else int(page),
            "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"],
            "refers_to_record": fields.get("WARC-Refers-To"),
            "header_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": len(payload) if response else None,
            "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else None,
        }
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, as stored; payload size and digest of responses are measured anew."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                names = [column.split()[0] for column in _PARSED.split(", ")]
                yield pd.DataFrame(list(parse_records(gzip.decompress(content))), columns=names, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parsed, _PARSED)


def resolve(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Every record with the payload's size and digest, those of revisits from their responses."""
    records = written(spark, records)
    originals = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"),
    )
    # Responses refer to nothing: in a join they would all go to one task.
    own = records.filter("refers_to_record is null").withColumns(
        {name: F.lit(None).cast(kind) for name, kind in originals.drop("refers_to_record").dtypes}
    )
    revisits = records.filter("refers_to_record is not null")
    joined = own.unionByName(revisits.join(originals, "refers_to_record", "left"))
    digest = F.coalesce("payload_digest", "_digest")
    sound = F.when(digest == F.col("header_digest"), digest).otherwise(
        F.raise_error(F.concat(F.lit("digest of record differs: "), F.col("record_id"))).cast("string")
    )
    return joined.select(
        "page_id",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        sound.alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def roundtrip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back and resolve the revisits."""
    path = scratch_dir(spark)
    write_archives(spark, pages, path, min_bytes)
    return resolve(spark, read_archives(spark, path))
