"""Reading files: names, headers, trailers, rejects, encodings, compression, splits, fixed width."""

from __future__ import annotations

import bz2
import gzip
import zipfile
from datetime import datetime

import pytest

from twinledger import TableSpec, read_table
from twinledger.operators.lines import compare_lines
from twinledger.sources.fixed_width import convert_fixed_width, parse_widths
from twinledger.sources.inventory import file_inventory, storage_stats
from twinledger.sources.lines import SPLITS_PER_CORE, header_lines, raw_lines
from twinledger.sources.stage import stage_table


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(table):
    return sorted((tuple(r) for r in table.rows.collect()), key=str)


def test_headerless_names_are_not_padded(spark, tmp_path):
    path = write(tmp_path / "a.csv", ",".join(str(i) for i in range(12)) + "\n")
    table = read_table(spark, TableSpec(path))
    assert table.rows.columns == [f"column{i}" for i in range(12)]
    assert rows(table) == [tuple(str(i) for i in range(12))]


def test_header_names_are_normalized(spark, tmp_path):
    path = write(tmp_path / "a.csv", ' Customer ID ,"First, Name",,UPPER\n1,2,3,4\n')
    assert read_table(spark, TableSpec(path, header_rows=1)).rows.columns == [
        "customer_id",
        "first,_name",
        "column2",
        "upper",
    ]


def test_colliding_names_are_refused(spark, tmp_path):
    path = write(tmp_path / "a.csv", "A B,a_b\n1,2\n")
    with pytest.raises(ValueError, match="collide"):
        read_table(spark, TableSpec(path, header_rows=1))


@pytest.mark.parametrize("split_bytes", ["134217728", "64"])
@pytest.mark.parametrize("header_rows", [0, 1, 3])
def test_leading_lines_are_skipped_in_split_files(spark, tmp_path, header_rows, split_bytes):
    """The same rows whether a file is one task or many, also when data repeats the header."""
    heads = [f"h{i},x{i}" for i in range(header_rows)]
    data = [f"{i},v{i}" for i in range(200)] + heads
    path = write(tmp_path / "a.csv", "\n".join(heads + data) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        table = read_table(spark, TableSpec(path, header_rows=header_rows))
        assert rows(table) == sorted((tuple(line.split(",")) for line in data), key=str)
        assert [r["line"] for r in table.headers.orderBy("line_number").collect()] == heads
        if header_rows:
            assert table.rows.columns == heads[-1].split(",")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split_bytes", ["134217728", "64"])
@pytest.mark.parametrize("header_rows", [1, 2])
def test_every_file_of_a_folder_has_its_header_skipped(spark, tmp_path, header_rows, split_bytes):
    heads = [f"k{i},v{i}" for i in range(header_rows)]
    folder = tmp_path / "in"
    folder.mkdir()
    expected = []
    for f in range(5):
        data = [f"{f}-{i},v" for i in range(30 * f + 1)] + heads[:1]
        expected += data
        write(folder / f"part{f}.csv", "\n".join(heads + data))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        table = read_table(spark, TableSpec(str(folder), header_rows=header_rows))
        assert rows(table) == sorted((tuple(line.split(",")) for line in expected), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split_bytes", ["134217728", "100"])
def test_trailers_are_numbered_in_file_order(spark, tmp_path, split_bytes):
    lines = []
    for i in range(300):
        lines.append(f"TRAILER {i},x" if i % 7 == 0 else f'"EOF{i}",y' if i % 7 == 1 else f"{i},z")
    path = write(tmp_path / "a.csv", "\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        table = read_table(spark, TableSpec(path, trailer_patterns=("TRAILER", "EOF"), column_names=("a", "b")))
        found = [r["line"] for r in table.trailers.orderBy("line_number").collect()]
        assert found == [line for line in lines if "z" not in line]
        assert [r["line_number"] for r in table.trailers.orderBy("line_number").collect()] == list(
            range(1, len(found) + 1)
        )
        assert table.rows.count() == sum("z" in line for line in lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_trailer_patterns_are_plain_text(spark, tmp_path):
    """Percent, underscore and quotes have no special meaning, and null first fields stay."""
    path = write(tmp_path / "a.csv", "id,v\n,1\n100%,2\n1000,3\nO'Brien total,4\n")
    table = read_table(spark, TableSpec(path, header_rows=1, trailer_patterns=("100%", "O'Brien")))
    assert rows(table) == sorted([(None, "1"), ("1000", "3")], key=str)


def test_rejects(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        'a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,12,\n"open,x,y\n13,14,"open\n15,5" pipe,16\n"q ""x""",17,18\n\n19\n',
    )
    table = read_table(spark, TableSpec(path, header_rows=1))
    assert sorted(map(str, rows(table))) == sorted(
        map(
            str,
            [
                ("1", "2", "3"),
                ("4", "5", None),
                ("15", '5" pipe', "16"),
                ('q "x"', "17", "18"),
                ("19", None, None),
            ],
        )
    )
    rejected = [(r["error_type"], r["csv_line"]) for r in table.first_rejects(100).collect()]
    assert rejected == [
        ("TOO MANY COLUMNS", "6,7,8,9"),
        ("TOO MANY COLUMNS", "10,11,12,"),
        ("UNQUOTED VALUE", '"open,x,y'),
        ("UNQUOTED VALUE", '13,14,"open'),
    ]
    assert tuple(table.counts.head()) == (5, 4)
    assert [r["csv_line"] for r in table.first_rejects(1).collect()] == ["6,7,8,9"]


def test_multi_line_records(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,"x\ny, ""z"""\n2\n3,4,5\nEND,9\n')
    table = read_table(spark, TableSpec(path, header_rows=1, multi_line=True, trailer_patterns=("END",)))
    assert rows(table) == sorted([("1", 'x\ny, "z"'), ("2", None)], key=str)
    assert [r["csv_line"].strip() for r in table.rejects.collect()] == ["3,4,5"]
    assert tuple(table.counts.head()) == (2, 1)


def test_long_lines(spark, tmp_path):
    long = "x" * 3_000_000
    path = write(tmp_path / "a.csv", f"a,b\n1,{long}\n2,short,{long}\n")
    table = read_table(spark, TableSpec(path, header_rows=1))
    assert [len(r["b"]) for r in table.rows.collect()] == [3_000_000]
    assert table.rejects.count() == 1


def test_lines_with_very_many_fields_are_rejected_not_fatal(spark, tmp_path):
    commas = "," * 1_200_000
    path = write(tmp_path / "a.csv", f'a,b\n1,2\n{"x," * 30_000}\n{commas}\n3,"{commas}"\n')
    table = read_table(spark, TableSpec(path, header_rows=1))
    assert [(r["a"], len(r["b"])) for r in table.rows.orderBy("a").collect()] == [("1", 1), ("3", 1_200_000)]
    assert tuple(table.counts.head()) == (2, 2)
    assert {r["error_type"] for r in table.rejects.collect()} == {"TOO MANY COLUMNS"}


def test_random_fields_survive(spark, tmp_path):
    """Whatever a CSV writer quotes comes back; empty fields come back as null."""
    import csv
    import random

    rng = random.Random(3)
    alphabet = ['a', 'B', ' ', ',', '"', "'", "\\", "é", "|", "\t", "0", "-", "#", "\U0001f600"]
    data = [["".join(rng.choices(alphabet, k=rng.randrange(6))) for _ in range(4)] for _ in range(400)]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator="\n").writerows([["c1", "c2", "c3", "c4"], *data])
    table = read_table(spark, TableSpec(str(tmp_path / "a.csv"), header_rows=1))
    assert table.rejects.isEmpty()
    assert rows(table) == sorted((tuple(v or None for v in row) for row in data), key=str)


def test_random_ragged_lines(spark, tmp_path):
    """Too long is rejected, too short is padded, whatever the fields are."""
    import random

    rng = random.Random(4)
    data = [[rng.choice(["", "x", '"q,q"', '""', "5 in"]) for _ in range(rng.randrange(1, 7))] for _ in range(300)]
    lines = [",".join(fields) for fields in data]
    path = write(tmp_path / "a.csv", "\n".join(lines) + "\n")
    table = read_table(spark, TableSpec(path, column_names=("a", "b", "c")))
    plain = {"": None, "x": "x", '"q,q"': "q,q", '""': None, "5 in": "5 in"}
    kept = [tuple(([plain[f] for f in fields] + [None] * 3)[:3]) for fields, line in zip(data, lines) if line and len(fields) <= 3]
    assert rows(table) == sorted(kept, key=str)
    rejected = sorted(line for fields, line in zip(data, lines) if len(fields) > 3)
    assert sorted(r["csv_line"] for r in table.rejects.collect()) == rejected


STAGED = {
    "plain": ("a,b\n1,2\n3\n4,5,6\n", {"header_rows": 1}),
    "trailers": ("T0,h\na,b\n1,2\nT1,x\n3,4\n\"T2,y\"\n", {"header_rows": 2, "trailer_patterns": ("T",)}),
    "fixed": ("ab cd\n11 22\nEOF 1\n", {"file_type": "fwf", "col_specs": ((0, 3), (3, 5)), "header_rows": 1, "trailer_patterns": ("EOF",)}),
    "whole_lines": ("ab\ncd\n", {"file_type": "fwf"}),
    "multi_line": ('a,b\n1,"x\ny"\n2,3,4\n', {"header_rows": 1, "multi_line": True}),
    "empty": ("", {}),
}


@pytest.mark.parametrize("name", STAGED)
def test_staged_tables_equal_lazy_ones(spark, tmp_path, name):
    text, options = STAGED[name]
    spec = TableSpec(write(tmp_path / "a.txt", text), **options)
    lazy, staged = read_table(spark, spec), stage_table(spark, spec, str(tmp_path / "staged"))
    assert staged.rows.columns == lazy.rows.columns
    assert rows(staged) == rows(lazy)
    assert tuple(staged.counts.head()) == tuple(lazy.counts.head())
    for part in ("headers", "trailers"):
        order = "line_number"
        assert getattr(staged, part).orderBy(order).collect() == getattr(lazy, part).orderBy(order).collect()
    assert staged.first_rejects(100).collect() == lazy.first_rejects(100).collect()
    assert staged.header_text == lazy.header_text


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "cp1252", "utf-16-le", "utf-8-sig"])
def test_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "a.csv", "id,näme\n1,Zoé\n2,Müller\n", encoding)
    table = read_table(spark, TableSpec(path, header_rows=1, encoding=encoding))
    assert table.rows.columns == ["id", "näme"]
    assert rows(table) == [("1", "Zoé"), ("2", "Müller")]


def test_byte_order_mark_is_not_part_of_a_name(spark, tmp_path):
    path = write(tmp_path / "a.csv", "﻿id,v\n1,2\n")
    assert read_table(spark, TableSpec(path, header_rows=1)).rows.columns == ["id", "v"]


def test_windows_line_ends(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,v\r\n1,2\r\n3,4\r\n")
    table = read_table(spark, TableSpec(path, header_rows=1))
    assert table.rows.columns == ["id", "v"]
    assert rows(table) == [("1", "2"), ("3", "4")]


TEXT = "id|name\n1|Zoé\n2|b\nEOF|2\n"


@pytest.mark.parametrize(
    ("name", "compression"),
    [
        ("a.csv.gz", "auto"),
        ("a.csv.gzip", "auto"),
        ("a.csv.bz2", "auto"),
        ("a.csv.zip", "auto"),
        ("a.dat", "gzip"),
        ("a.dat", "bz2"),
        ("a.csv", None),
    ],
)
def test_compression(spark, tmp_path, name, compression):
    path = tmp_path / name
    spec = TableSpec(
        str(path), delimiter="|", header_rows=1, trailer_patterns=("EOF",), compression=compression, fan_out=3
    )
    data = TEXT.encode()
    if spec.codec == "gzip":
        path.write_bytes(gzip.compress(data))
    elif spec.codec == "bzip2":
        path.write_bytes(bz2.compress(data))
    elif spec.codec == "zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            first, *others = TEXT.splitlines(keepends=True)
            archive.writestr("first.csv", first + "".join(others[:1]))
            archive.writestr("folder/", "")
            archive.writestr("folder/second.csv", first + "".join(others[1:]))
    else:
        path.write_bytes(data)
    table = read_table(spark, spec)
    assert rows(table) == [("1", "Zoé"), ("2", "b")]
    assert [r["line"] for r in table.headers.collect()] == ["id|name"]
    assert [r["line"] for r in table.trailers.collect()] == ["EOF|2"]


def zipped(path, **members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return str(path)


def test_zip_with_records_over_lines(spark, tmp_path):
    path = zipped(tmp_path / "a.zip", a='id,v\n1,"x\n\ny ""z"""\n2,b\n', b='id,v\n3,"p\nq"\n4,5,6\n')
    for multi_line in (False, True):
        table = read_table(spark, TableSpec(path, header_rows=1, multi_line=multi_line))
        assert rows(table) == [("1", 'x\n\ny "z"'), ("2", "b"), ("3", "p\nq")]
        found = table.rejects.head()
        assert (found["file"].split("!")[1], found["line_number"], found["csv_line"]) == ("b", 4, "4,5,6")


def test_zip_members_with_other_names_are_refused(spark, tmp_path):
    path = zipped(tmp_path / "a.zip", a="id,v\n1,2\n", b="v,id\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_table(spark, TableSpec(path, header_rows=1))
    with pytest.raises(Exception, match="empty zip file"):
        read_table(spark, TableSpec(zipped(tmp_path / "b.zip"), column_names=("a",))).rows.collect()


def test_folder_with_other_headers_is_refused(spark, tmp_path):
    write(tmp_path / "d/a.csv", "id,v\n1,2\n")
    write(tmp_path / "d/b.csv", "v,id\n" + "3,4\n" * 100)
    with pytest.raises(ValueError, match="different headers"):
        read_table(spark, TableSpec(str(tmp_path / "d"), header_rows=1))


@pytest.mark.parametrize("files", [1, 2])
def test_a_blank_first_line_is_the_header_in_any_number_of_files(spark, tmp_path, files):
    for name in "ab"[:files]:
        write(tmp_path / f"d/{name}.csv", "\nid,v\n1,2\n")
    table = read_table(spark, TableSpec(str(tmp_path / "d"), header_rows=1, column_names=("a", "b")))
    assert rows(table) == sorted([("id", "v"), ("1", "2")] * files)


def test_headers_are_those_of_the_first_file_by_name(spark, tmp_path):
    write(tmp_path / "d/a.csv", "made on Monday\nid,v\n1,2\n")
    write(tmp_path / "d/b.csv", "made on Tuesday\nid,v\n" + "3,4\n" * 100)
    table = read_table(spark, TableSpec(str(tmp_path / "d"), header_rows=2))
    assert list(table.header_text) == ["made on Monday", "id,v"]
    assert table.rows.count() == 101


EMBEDDED = 'id,v,w\n1,"a\nb",x\n2,5" pipe,y\n3,"c\n\nd ""e""\nTRAILER",z\n4,"open,w\n5,f,g\n6,"h,\ni",j\n7,k,"l\n'


@pytest.mark.parametrize("split", [None, 8, 23])
def test_records_over_lines_by_default(spark, tmp_path, split):
    """A stray quote costs its own line; fields may hold line ends wherever files are split."""
    path = write(tmp_path / "a.csv", EMBEDDED)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    if split:
        spark.conf.set(name, str(split))
    try:
        spec = TableSpec(path, header_rows=1, trailer_patterns=("TRAILER",))
        for table in (read_table(spark, spec), stage_table(spark, spec, str(tmp_path / f"staged{split}"))):
            assert rows(table) == [
                ("1", "a\nb", "x"), ("2", '5" pipe', "y"), ("3", 'c\n\nd "e"\nTRAILER', "z"), ("5", "f", "g"),
                ("i\"", "j", None),
            ]
            found = [(r["line_number"], r["csv_line"]) for r in table.first_rejects(9).collect()]
            assert found == [(9, '4,"open,w'), (11, '6,"h,'), (13, '7,k,"l')]
    finally:
        spark.conf.set(name, before)


def test_a_record_beyond_the_bound_is_judged_line_by_line(spark, tmp_path):
    path = write(tmp_path / "a.csv", '1,"' + "x\n" * 50 + '"\n2,"a\nb"\n')
    table = read_table(spark, TableSpec(path, column_names=("a", "b"), max_record_bytes=60))
    assert ("2", "a\nb") in rows(table)
    assert table.first_rejects(1).head()["line_number"] == 1


def test_line_numbers_of_rejects_in_split_files(spark, tmp_path):
    path = write(tmp_path / "a.csv", "".join(f"{i},b{',c' * (i % 10 == 7)}\n" for i in range(1, 401)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    try:
        table = read_table(spark, TableSpec(path, column_names=("a", "b")))
        assert [r["line_number"] for r in table.first_rejects(500).collect()] == list(range(7, 401, 10))
    finally:
        spark.conf.set(name, before)


def test_line_numbers_beyond_32_bits(spark):
    lines = spark.createDataFrame([(3_000_000_000, "a")], "line_number long, line string")
    assert compare_lines(lines, lines).head()["line_number"] == 3_000_000_000


def test_spec_properties():
    spec = TableSpec("gs://bucket/in/extract.csv.gz")
    assert (spec.is_object_store, spec.is_compressed, spec.filename) == (True, True, "extract.csv.gz")
    assert spec.path == "gs://bucket/in/extract.csv.gz"
    plain = TableSpec("/data/in/file.csv")
    assert (plain.is_object_store, plain.is_compressed, plain.filename) == (False, False, "file.csv")
    with pytest.raises(ValueError, match="convert first"):
        TableSpec("/data/a.csv.Z")
    with pytest.raises(ValueError, match="unknown compression"):
        TableSpec("/data/a.csv", compression="rar")


FWF = "ID        NAME  AMOUNT  \n1001      Zoé      12.50\n1002      Ann       7.00\nTRAILER 2\n"


def test_fixed_width(spark, tmp_path):
    path = write(tmp_path / "a.txt", FWF)
    spec = TableSpec(
        path, file_type="fwf", col_specs=parse_widths("10,6,8"), header_rows=1, trailer_patterns=("TRAILER",)
    )
    table = read_table(spark, spec)
    assert table.rows.columns == ["id", "name", "amount"]
    assert rows(table) == [("1001", "Zoé", "12.50"), ("1002", "Ann", "7.00")]
    assert [r["line"] for r in table.trailers.collect()] == ["TRAILER 2"]
    out = convert_fixed_width(spark, spec, str(tmp_path / "out"))
    assert spark.read.parquet(out).count() == 2


def test_fixed_width_names(spark, tmp_path):
    path = write(tmp_path / "a.txt", "ab  cd\n\x0b x  y\t\n")
    given = TableSpec(path, file_type="fwf", col_specs=[(0, 3), (3, 6)], column_names=["First Col"])
    table = read_table(spark, given)
    assert table.rows.columns == ["first_col", "column1"]
    assert rows(table) == [("ab", "cd"), ("x", "y")]
    blank = read_table(spark, TableSpec(path, file_type="fwf", col_specs=[(0, 2), (2, 4), (4, 6)], header_rows=1))
    assert blank.rows.columns == ["ab", "column1", "cd"]
    whole = read_table(spark, TableSpec(path, file_type="fwf"))
    assert whole.rows.columns == ["raw_line"]


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(3).withColumnRenamed("id", "Row Id").write.parquet(path)
    table = read_table(spark, TableSpec(path, file_type="parquet"))
    assert table.rows.columns == ["row_id"]
    assert tuple(table.counts.head()) == (3, 0)


def test_empty_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", "")
    assert read_table(spark, TableSpec(path)).rows.count() == 0
    only_header = write(tmp_path / "b.csv", "a,b\n")
    table = read_table(spark, TableSpec(only_header, header_rows=1))
    assert (table.rows.columns, table.rows.count()) == (["a", "b"], 0)


def test_line_comparison(spark, tmp_path):
    left = spark.createDataFrame([(1, "a,b"), (2, "same"), (3, ""), (4, "only")], "line_number int, line string")
    right = spark.createDataFrame([(1, "a,c,"), (2, "same"), (3, "")], "line_number int, line string")
    got = {r["line_number"]: r for r in compare_lines(left, right).collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["MISMATCH", "MATCH", "MATCH", "Missing in Target"]
    assert (got[1]["first_diff_pos"], got[1]["diff_count"], got[1]["source_len"], got[1]["target_len"]) == (2, 2, 3, 4)
    assert [(d["pos"], d["src"], d["tgt"]) for d in got[1]["char_diffs"]] == [(2, "b", "c"), (3, None, ",")]
    assert (got[4]["target"], got[4]["first_diff_pos"], got[4]["diff_count"]) == ("", None, 0)


def test_inventory(spark, tmp_path):
    path = write(tmp_path / "a.csv.gz", "not really compressed")
    missing = str(tmp_path / "none.csv")
    got = {r["original_path"]: r for r in file_inventory(spark, [path, missing]).collect()}
    found = got[path]
    assert (found["filename"], found["exists"], found["size_bytes"], found["compression"], found["scheme"]) == (
        "a.csv.gz",
        True,
        21,
        "gzip",
        "file",
    )
    assert (found["bucket"], found["size_human"]) == (None, "21 B")
    assert isinstance(found["updated"], datetime)
    assert (got[missing]["exists"], got[missing]["size_bytes"]) == (False, None)


def test_storage_stats(spark, tmp_path):
    assert tuple(storage_stats(spark, str(tmp_path / "nothing")).head()) == (0, 0, None, None)
    write(tmp_path / "a.txt", "12345")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "b.txt", "123")
    stats = storage_stats(spark, str(tmp_path)).head()
    assert (stats["files"], stats["total_bytes"]) == (2, 8)
    assert stats["oldest_mtime"] <= stats["newest_mtime"]


def test_tiny_splits_are_bounded_in_number(spark, tmp_path):
    """A split setting of few bytes does not make tasks in proportion to the input; numbers stay right."""
    lines = [f"{i},b{',c' * (i % 100 == 7)}" for i in range(1, 40_001)]
    write(tmp_path / "a.csv", "\n".join(lines) + "\n")
    spec, name = TableSpec(str(tmp_path / "a.csv"), column_names=("k", "v")), "spark.sql.files.maxPartitionBytes"
    before, cores = spark.conf.get(name), spark.sparkContext.defaultParallelism
    try:
        spark.conf.set(name, "50")
        assert cores < raw_lines(spark, spec).rdd.getNumPartitions() <= SPLITS_PER_CORE * cores + cores
        staged = stage_table(spark, spec, str(tmp_path / "staged"))
    finally:
        spark.conf.set(name, before)
    assert sorted(r["line_number"] for r in staged.rejects.collect()) == list(range(7, 40_001, 100))


def test_rejects_survive_a_new_split_plan(spark, tmp_path):
    """Line numbers come from what was staged, whatever the split size is when they are asked for."""
    lines = [f"{i},b{',c' * (i % 10 == 7)}" if i % 13 else "" for i in range(1, 301)]
    folder = tmp_path / "in"
    for f in range(2):
        write(folder / f"{f}.csv", "k,v\n" + "\n".join(lines) + "\n")
    expected = [i + 1 for i in range(1, 301) if i % 10 == 7 and i % 13] * 2
    spec, name = TableSpec(str(folder), header_rows=1), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "300")
        staged, lazy = stage_table(spark, spec, str(tmp_path / "staged")), read_table(spark, spec)
        for size in ("77", "5000", before):
            spark.conf.set(name, size)
            for table in (staged, lazy):
                assert [r["line_number"] for r in table.first_rejects(500).collect()] == expected
        assert staged.counts.head()["reject_count"] == len(expected)
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("split", [None, 40])
def test_records_beyond_the_bound_give_no_rows(spark, tmp_path, split):
    """A whole record over the limit is one reject; lines between two stray quotes stay rows."""
    long = "\n".join(f'x{i} ""q"", y' for i in range(30))
    text = f'1,"{long}"\n2,"a\nb"\n3,"{long}",c,d\n4,"open\n' + "".join(f"{i},p\n" for i in range(50, 80)) + '81,"r\n'
    path, name = write(tmp_path / "a.csv", text), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    if split:
        spark.conf.set(name, str(split))
    try:
        spec = TableSpec(path, column_names=("a", "b"), max_record_bytes=100)
        for table in (read_table(spark, spec), stage_table(spark, spec, str(tmp_path / "staged"))):
            found = [(r["line_number"], r["error_type"]) for r in table.first_rejects(200).collect()]
            got = {r[0] for r in rows(table)}
            assert found[0] == (1, "LINE SIZE OVER MAXIMUM") and ("2", "a\nb") in rows(table)
            assert {str(i) for i in range(50, 80)} <= got and "1" not in got
            assert (63, "UNQUOTED VALUE") in found and (94, "UNQUOTED VALUE") in found
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("encoding", ["utf-16", "utf-32"])
@pytest.mark.parametrize("header_rows", [0, 1])
def test_byte_order_marks_of_mixed_files(spark, tmp_path, encoding, header_rows):
    head = "näme,v\n" * header_rows
    for order, mark in (("le", "\ufeff"), ("be", "\ufeff")):
        write(tmp_path / "in" / f"{order}.csv", f"{mark}{head}Zoé 漢,{order}\r\nb,2\n", f"{encoding}-{order}")
    write(tmp_path / "in" / "z.csv", f"{head}none,le\n", f"{encoding}-le")
    table = read_table(spark, TableSpec(str(tmp_path / "in"), header_rows=header_rows, encoding=encoding))
    assert rows(table) == sorted([("Zoé 漢", "le"), ("b", "2"), ("Zoé 漢", "be"), ("b", "2"), ("none", "le")], key=str)
    assert not header_rows or table.rows.columns == ["näme", "v"]


def test_a_folder_is_scanned_once_for_its_rows(spark, tmp_path):
    for f in range(3):
        write(tmp_path / "in" / f"{f}.csv", "k,v\n1,2\n")
    plan = read_table(spark, TableSpec(str(tmp_path / "in"), header_rows=1)).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2"])
def test_heads_of_long_first_lines(spark, tmp_path, suffix):
    names = ",".join(f"c{i}" for i in range(40_000))
    data = f"made by hand\r\n{names}\r\n1\r\n".encode()
    path = tmp_path / f"a.csv{suffix}"
    path.write_bytes({"": lambda d: d, ".gz": gzip.compress, ".bz2": bz2.compress}[suffix](data))
    assert header_lines(spark, TableSpec(str(path), header_rows=2)) == ["made by hand", names]
