"""Scalar functions, each against a plain Python or DuckDB reading of the same rule."""

from __future__ import annotations

import random
import sys
import unicodedata
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions import chardiff, compare, fmt, names, normalize
from twinledger.sources.fixed_width import parse_widths


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    ("source", "target", "expected"),
    [
        ("Hello World", "Hello World!", [(11, None, "!")]),
        ("ABC123", "ABC124", [(5, "3", "4")]),
        ("same", "same", []),
        ("", "ab", [(0, None, "a"), (1, None, "b")]),
        ("ab", "", [(0, "a", None), (1, "b", None)]),
        ("", "", []),
        ("né\U0001f600x", "ne\U0001f600y", [(1, "é", "e"), (3, "x", "y")]),
    ],
)
def test_char_diff(spark, source, target, expected):
    found = one(spark, chardiff.char_diff(F.lit(source), F.lit(target)))
    assert [(d["pos"], d["src"], d["tgt"]) for d in found] == expected
    assert all(d["match"] is False for d in found)


def python_bytes(value, decimals=2, binary=False):
    """Direct reading of the format: the largest unit not above the amount."""
    amount, base = abs(float(value)), 1024.0 if binary else 1000.0
    power = next((p for p in range(6, 0, -1) if amount >= base**p), 0)
    sign = "-" if value < 0 else ""
    if not power:
        return f"{sign}{int(amount)} B"
    unit = (fmt.IEC_UNITS if binary else fmt.SI_UNITS)[power - 1]
    return f"{sign}{amount / base**power:.{decimals}f} {unit}"


@pytest.mark.parametrize("binary", [False, True])
def test_format_bytes(spark, binary):
    values = [0, 1, 999, 1000, 1023, 1024, 1536, 1125, 2675, 1005, 1024000, -5000, 10**9, 5 * 10**18, 1024**5]
    values += [7 * k**5 for k in range(1, 300, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select(
        "v", fmt.format_bytes(F.col("v"), binary=binary).alias("text")
    )
    assert [r["text"] for r in rows.collect()] == [python_bytes(v, binary=binary) for v in values]
    assert one(spark, fmt.format_bytes(F.lit(1024000))) == "1.02 MB"
    assert one(spark, fmt.format_bytes(F.lit(1536), binary=True)) == "1.50 KiB"
    assert one(spark, fmt.format_bytes(F.lit(1999), decimals=0)) == "2 KB"


@pytest.mark.parametrize(
    ("seconds", "text"),
    [
        (0.4, "0 sec"),
        (0.5, "0 sec"),
        (1.5, "2 sec"),
        (222.0, "3 min 42 sec"),
        (3600.0, "1 hours 0 min 0 sec"),
        (90061.2, "1 days 1 hours 1 min 1 sec"),
    ],
)
def test_format_duration(spark, seconds, text):
    assert one(spark, fmt.format_duration(F.lit(10.0), F.lit(10.0 + seconds))) == text


def test_strip_accents_agrees_on_every_character(spark):
    codes = [c for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    ours = spark.createDataFrame([(c, f"x{chr(c)}") for c in codes], "code int, text string").select(
        "code", normalize.strip_accents(F.col("text")).alias("plain")
    )
    actual = {r["code"]: r["plain"] for r in ours.collect()}
    con = duckdb.connect()
    expected = dict(con.execute("SELECT c, strip_accents('x' || chr(c)) FROM unnest(?) AS t(c)", [codes]).fetchall())
    differing = {c for c in codes if actual[c] != expected[c]}
    # The two Unicode versions know slightly different sets of marks.
    assert len(differing) <= 60, sorted(differing)[:100]
    assert not {c for c in differing if c < 0x800}


def test_trim_removes_all_space_separators_only(spark):
    text = "   a\t b 　"
    assert one(spark, normalize.trim(F.lit(text))) == "a\t b"
    assert one(spark, normalize.trim(F.lit("\ta"))) == "\ta"
    assert one(spark, normalize.ltrim(F.lit(" a "))) == "a "
    assert one(spark, normalize.rtrim(F.lit(" a "))) == " a"


def test_whitespace_is_what_python_strips():
    assert set(normalize.whitespace()) == {chr(c) for c in range(0x10000) if chr(c).isspace()} - set("\x1c\x1d\x1e\x1f")
    assert sys.maxunicode > 0


@pytest.mark.parametrize(
    ("text", "number"),
    [
        (" 1.5 ", 1.5),
        ("1e5", 100000.0),
        ("1.", 1.0),
        (".5", 0.5),
        ("+1", 1.0),
        ("1_000", 1000.0),
        ("1d", None),
        ("1.0f", None),
        ("inf", None),
        ("nan", None),
        ("1,000", None),
        ("", None),
        ("0x1F", None),
        ("9" * 4000, float("inf")),
    ],
)
def test_number_from_text(spark, text, number):
    assert one(spark, compare.number_from_text(F.lit(text))) == number


@pytest.mark.parametrize(
    "text",
    [
        "2025-01-15",
        "2025/01/15",
        "2025 01 15",
        "2025-1-5",
        "2025-01-15T10:00",
        "2025-01-15 10:00:00.5",
        "2025-01-15 10:00:00+02",
        "2025-01-15 10:00:00Z",
        "2025-01-15 10",
        " 2025-01-15 ",
        "20250115",
        "15/01/2025",
        "2025-01",
        "2025",
        "2025/01-15",
        "2025-13-01",
        "2025-01-15abc",
    ],
)
def test_timestamp_from_text_agrees(spark, text):
    expected = duckdb.connect().execute("SELECT TRY_CAST(? AS TIMESTAMP)", [text]).fetchone()[0]
    assert one(spark, compare.timestamp_from_text(F.lit(text))) == expected


def test_parse_widths():
    assert parse_widths("10,5,8") == [(0, 10), (10, 15), (15, 23)]
    assert parse_widths(" 3, x, 4 ") == [(0, 3), (3, 7)]
    assert parse_widths("") is None
    assert parse_widths(None) is None


def test_names():
    assert names.clean_names(" A B ,c") == ["a_b", "c"]
    assert names.key_names(["ID", "id", "Line No"]) == ["id", "line_no"]
    with pytest.raises(ValueError, match="collide"):
        names.distinct_names(["A B", "a_b"])
    with pytest.raises(ValueError, match="key"):
        names.key_names([])


def test_compression_and_paths(spark):
    cases = {"a.gz": "gzip", "a.GZIP": "gzip", "a.Z": "compress", "a.z": "compress", "a.bz2": "bzip2", "a.zip": "zip"}
    for path, kind in {**cases, "a.csv": None, "a.txt": None}.items():
        assert one(spark, fmt.compression_type(F.lit(path))) == kind
    assert one(spark, fmt.storage_scheme(F.lit("gs://b/x/y.csv"))) == "gs"
    assert one(spark, fmt.storage_scheme(F.lit("/data/y.csv"))) == "file"
    assert one(spark, fmt.bucket_of(F.lit("gs://b/x/y.csv"))) == "b"
    assert one(spark, fmt.blob_of(F.lit("gs://b/x/y.csv"))) == "x/y.csv"


def test_render_local_uses_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        at = F.lit("2024-07-01 12:00:00").cast("timestamp_ntz")
        assert one(spark, fmt.render_local(at)) == "2024-07-01 14:00:00 CEST"
        assert one(spark, fmt.render_utc(at)) == "2024-07-01 12:00:00 UTC"
        assert one(spark, fmt.render_et(at)) == "2024-07-01 08:00:00 EDT"
        assert one(spark, fmt.render_ist(at)) == "2024-07-01 17:30:00 IST"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_run_id(spark):
    at = F.lit("2025-02-08 01:02:03").cast("timestamp")
    found = one(spark, fmt.run_id(F.lit("My job!"), F.lit("/in/extract.2025.csv"), at))
    assert found == "My_job__extract_2025_20250208_010203"


def test_syllables_are_composed(spark):
    rng = random.Random(4)
    alphabet = [*map(chr, range(0x1100, 0x1113)), *map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3)), "가", "각", "a", "é", "\u0301"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize.strip_accents(F.col("t")).alias("s"))
    for text, stripped in frame.collect():
        marks = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
        assert stripped == unicodedata.normalize("NFC", marks), text.encode("unicode_escape")


def test_floating_numbers_as_exact_ones(spark):
    """The text of a double is that of the exact number equal to it, if there is one."""
    values = [0.0, -0.0, 0.1, -2.5, 1e-10, 123456.1, 2.0**53, 2.0**53 + 2, -(2.0**60), 2.0**63, 2.0**80, 1e22, 3.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    texts = [r[0] for r in frame.select(normalize.floating_number_text(F.col("v"), T.DoubleType(), 2)).collect()]
    for value, text in zip(values, texts):
        expected = Decimal(int(value)) if abs(value) >= 2**53 else Decimal(repr(value))
        assert Decimal(text) == expected and "E" not in text and text != "-0"
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (1e-300,), (None,)], "v double")
    found = [r[0] for r in odd.select(normalize.floating_number_text(F.col("v"), T.DoubleType(), 2)).collect()]
    assert found == ["NaN", "Infinity", "1.0E300", "1.0E-300", None]
