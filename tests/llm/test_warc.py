import base64
import gzip
import hashlib
import random

import pytest
from helpers import tuples

from twinledger.llm import warc

SCHEMA = "page_id long, url string, html string, payload_digest string, `_row` int"


def table(spark, rows, path):
    spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def brute(rows, min_bytes=0):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and i < first.get(data, 2**63):
            first[data] = i
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = len(data) >= min_bytes and first[data] != i
        out.append((i, len(data), digest, "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages():
    rng = random.Random(6)
    bodies = ["<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "é😀 漢", "y" * 300_000, "\r\n\r\n", "\n"]
    rows = [(i, f"http://h/{i}", rng.choice(bodies)) for i in range(120)]
    rows += [(200 + i, f"http://h/{i}", f"own {i}") for i in range(60)]
    return rows + [(300, None, "z"), (301, "http://h/\r\nWARC-Type: response\r\n x", "z"), (302, "http://h/é ü", "q")]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_roundtrip_against_brute_force(spark, tmp_path, min_bytes):
    found = warc.roundtrip(spark, table(spark, pages(), tmp_path / "p"), min_bytes)
    assert tuples(found, *COLUMNS) == brute(pages(), min_bytes)


def test_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    path = str(tmp_path / "archives")
    warc.write_archives(spark, table(spark, pages(), tmp_path / "p"), path)
    assert len(list((tmp_path / "archives").glob("*.gz"))) > 10
    assert tuples(warc.resolve(spark, warc.read_archives(spark, path)), *COLUMNS) == brute(pages())


def test_records_are_warc(spark, tmp_path):
    path = tmp_path / "archives"
    warc.write_archives(spark, table(spark, [(1, "http://h/a b", "body"), (2, None, "body")], tmp_path / "p").coalesce(1), str(path))
    content = b"".join(gzip.decompress(f.read_bytes()) for f in path.glob("*.gz"))
    assert content.count(b"WARC/1.1\r\n") == 2
    assert b"WARC-Target-URI: http://h/a%20b\r\n" in content
    assert content.count(b"body") == 1 and b"WARC-Profile: " + warc.REVISIT_PROFILE.encode() in content
    with pytest.raises((ValueError, KeyError)):
        list(warc.parse_records(b"HTTP/1.1 200\r\n\r\n"))


def test_repeated_rows_null_ids_and_no_rows(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (None, "u", "b"), (2, "u", "b"), (None, "u", "alone")]
    found = tuples(warc.roundtrip(spark, table(spark, rows, tmp_path / "p")), "page_id", "record_type", "refers_to")
    assert found == sorted(
        [(1, "response", None), (1, "revisit", 1), (2, "response", None), (None, "revisit", 2), (None, "revisit", 2),
         (None, "response", None)],
        key=repr,
    )
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.roundtrip(spark, empty).count() == 0


def test_base32(spark):
    rows = spark.createDataFrame([(bytes([i]) * i,) for i in range(50)], "data binary")
    for r in rows.select("data", warc.base32_sha1(rows["data"]).alias("found")).collect():
        assert r["found"] == base64.b32encode(hashlib.sha1(bytes(r["data"])).digest()).decode()
