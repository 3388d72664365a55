"""Small file pairs with exact expected statistics, worked out by hand."""

from __future__ import annotations

import bz2
from dataclasses import dataclass, field

import pytest

from twinledger import CompareRules, TableSpec, read_table, reconcile
from twinledger.operators.lines import compare_lines


@dataclass(frozen=True)
class Case:
    """Two files, how to read and compare them, and what must come out.

    expected: source rows, target rows, missing in source, missing in target, mismatched, matching, percent.
    """

    source: str
    target: str
    keys: tuple[str, ...]
    expected: tuple
    rules: CompareRules = CompareRules()
    options: dict = field(default_factory=dict)
    packed: bool = False


def table(head: str, *rows: str) -> str:
    return "\n".join([head, *rows]) + "\n"


# A harbour's berths: one ship left, two arrived, and one of three that stayed has new cargo.
HARBOUR = Case(
    table("Berth No;Ship;Cargo;Tonnes", "N1;Alcyone;salt;812", "N2;Berenice;timber;77.5", "N3;Corvus;;0", "S1;Draco;ore;4010"),
    table("Berth No;Ship;Cargo;Tonnes", "S1;Draco;ore;4010", "N3;Corvus;;0", "N2;Berenice;slate;77.5", "S2;Eridanus;rum;6",
          "S3;Fornax;tea;9"),
    ("berth no",),
    (4, 5, 2, 1, 1, 2, 40.0),
    options={"delimiter": ";"},
)
# Weather stations report per day and hour; hour 12 of station 9 was sent twice.
STATIONS = Case(
    table("station,day,hour,celsius", "9,2031-03-01,0,-4.5", "9,2031-03-01,12,2.0", "9,2031-03-01,12,2.0", "11,2031-03-01,0,1.25"),
    table("station,day,hour,celsius", "11,2031-03-01,0,1.25", "9,2031-03-01,0,-4.5", "9,2031-03-01,12,2.25"),
    ("station", "day", "hour"),
    (4, 3, 0, 0, 1, 2, 200 / 3),
)
# A choir's register, closed by a count; read with and without knowing that.
CHOIR = table("Voice,Singer,Joined", "alto,Ines,2019", "bass,Oskar,2022", "tenor,Wim,2017", "COUNT=3,checked")
# The same measurements, noted by two people.
SCALES = ("7,0.1000,3.30", "8,0.2000,-1", "9,5e2,0.07")
SCALES_AGAIN = ("7,0.1004,3.30", "8,0.1990,-1.0", "9,500,0.08")
# Names as typed on either side of a desk.
DESK = Case(
    table("slot,visitor,door", "1,  Kofi A ,EAST", "2,Réka,west", "3,,North"),
    table("slot,visitor,door", "1,Kofi A,east", "2,Reka,WEST", "3,NULL,north"),
    ("slot",),
    (3, 3, 0, 0, 1, 2, 200 / 3),
    CompareRules(trim_strings=True, lower_columns=("door",), strip_accents_columns=("visitor",)),
)
CASES = {
    "harbour": HARBOUR,
    "harbour packed": Case(HARBOUR.source, HARBOUR.target, HARBOUR.keys, HARBOUR.expected, options=HARBOUR.options, packed=True),
    "harbour with itself": Case(HARBOUR.source, HARBOUR.source, ("Berth No",), (4, 4, 0, 0, 0, 4, 100.0), options={"delimiter": ";"}),
    "stations": STATIONS,
    "choir": Case(CHOIR, CHOIR, ("singer",), (3, 3, 0, 0, 0, 3, 100.0), options={"trailer_patterns": ("COUNT=",)}),
    "choir with its count": Case(CHOIR, CHOIR, ("singer",), (4, 4, 0, 0, 0, 4, 100.0)),
    "scales exactly": Case(
        table("id,a,b", *SCALES), table("id,a,b", *SCALES_AGAIN), ("id",), (3, 3, 0, 0, 3, 0, 0.0)
    ),
    "scales within a thousandth": Case(
        table("id,a,b", *SCALES), table("id,a,b", *SCALES_AGAIN), ("id",), (3, 3, 0, 0, 1, 2, 200 / 3),
        CompareRules(float_epsilon=0.00101),
    ),
    "desk": DESK,
    "desk as typed": Case(DESK.source, DESK.target, ("slot",), (3, 3, 0, 0, 3, 0, 0.0)),
    "nothing in common": Case(
        table("n,sq", *(f"{n},{n * n}" for n in range(0, 60, 2))), table("n,sq", *(f"{n},{n * n}" for n in range(1, 80, 2))),
        ("n",), (30, 40, 40, 30, 0, 0, 0.0),
    ),
    "every value moved": Case(
        table("n,sq", *(f"{n},{n * n}" for n in range(250))), table("n,sq", *(f"{n},{n * n + 1}" for n in range(250))),
        ("n",), (250, 250, 0, 0, 250, 0, 0.0),
    ),
}


def load_pair(spark, tmp_path, case):
    sides = []
    for side, text in (("left", case.source), ("right", case.target)):
        path = tmp_path / (f"{side}.txt.bz2" if case.packed else f"{side}.txt")
        path.write_bytes(bz2.compress(text.encode()) if case.packed else text.encode())
        sides.append(read_table(spark, TableSpec(str(path), header_rows=1, **case.options)))
    return sides


@pytest.mark.parametrize("name", CASES)
def test_statistics(spark, tmp_path, name):
    case = CASES[name]
    source, target = load_pair(spark, tmp_path, case)
    row = reconcile(spark, source.rows, target.rows, list(case.keys), case.rules).summary.head()
    found = (
        row["source_count"],
        row["target_count"],
        row["missing_in_source"],
        row["missing_in_target"],
        row["mismatched_rows"],
        row["matching_rows"],
        row["match_percentage"],
    )
    assert found == pytest.approx(case.expected)
    if name == "scales within a thousandth":
        assert row["mismatched_rows_exact"] == 3
    if name == "stations":
        assert (row["source_duplicate_rows"], row["source_keys"]) == (1, 3)


def test_cells_of_the_harbour(spark, tmp_path):
    source, target = load_pair(spark, tmp_path, HARBOUR)
    detail = reconcile(spark, source.rows, target.rows, ["berth_no"]).detail_report().collect()
    assert [(r["validation_status"], r["berth_no"]) for r in detail] == [
        ("Found in Both", "N2"),
        ("Missing in Source", "S2"),
        ("Missing in Source", "S3"),
        ("Missing in Target", "N1"),
    ]
    changed, arrived, _, left = detail
    assert (changed["cargo_status"], changed["ship_status"]) == ("MISMATCH: timber || slate", "MATCH")
    assert arrived["ship_status"] == "MISMATCH: NULL || Eridanus"
    assert (left["tonnes_source"], left["tonnes_target"]) == ("812", None)


def test_first_and_last_lines_of_the_choir(spark, tmp_path):
    changed = CHOIR.replace("COUNT=3", "COUNT=4").replace("Voice", "voice")
    case = Case(CHOIR, changed, (), (), options={"trailer_patterns": ("COUNT=",)})
    source, target = load_pair(spark, tmp_path, case)
    heads = compare_lines(source.headers, target.headers).head()
    tails = compare_lines(source.trailers, target.trailers).head()
    assert (heads["status"], heads["first_diff_pos"], heads["diff_count"]) == ("MISMATCH", 0, 1)
    assert (tails["line_number"], tails["target"], tails["first_diff_pos"]) == (1, "COUNT=4,checked", 6)


def test_equal_tables_have_no_detail_but_a_sample(spark, tmp_path):
    source, target = load_pair(spark, tmp_path, CASES["harbour with itself"])
    result = reconcile(spark, source.rows, target.rows, ["berth_no"])
    assert result.detail.isEmpty()
    sample = result.sample(3).collect()
    assert [r["berth_no"] for r in sample] == ["N1", "N2", "N3"]
    assert sample[1]["tonnes_source"] == sample[1]["tonnes_target"] == "77.5"
    assert sample[1]["tonnes_status"] == "MATCH"


def test_wide_numbers_stay_apart(spark):
    """Whole numbers against wide decimals, beyond what floating point tells apart."""
    wide = 2**53
    left = spark.createDataFrame([(wide, wide), (wide + 1, 5)], "k long, v long")
    right = left.selectExpr("CAST(k AS DECIMAL(38,0)) k", f"CAST(CASE WHEN v = {wide} THEN v + 1 ELSE v END AS DECIMAL(38,10)) v")
    row = reconcile(spark, left, right, ["k"]).summary.head()
    assert (row["source_keys"], row["found_in_both"], row["mismatched_rows"]) == (2, 2, 1)
    scaled = left.selectExpr("CAST(k AS DECIMAL(38,0)) k", "CAST(v AS DECIMAL(38,20)) v")
    row = reconcile(spark, scaled, right.selectExpr("k", "CAST(v AS DECIMAL(38,0)) v"), ["k"]).summary.head()
    assert (row["found_in_both"], row["mismatched_rows"]) == (2, 1)
    with pytest.raises(ValueError, match="floating point"):
        reconcile(spark, left, left.selectExpr("CAST(k AS DOUBLE) k", "v"), ["k"])


def test_maps_are_equal_in_any_order(spark):
    left = spark.sql("SELECT 1 k, map('a', 1, 'b', 2) m, array(named_struct('x', map(1, 'p', 2, 'q'))) n")
    right = spark.sql("SELECT 1 k, map('b', 2, 'a', 1) m, array(named_struct('x', map(2, 'q', 1, 'p'))) n")
    assert reconcile(spark, left, right, ["k"]).summary.head()["mismatched_rows"] == 0
    other = spark.sql("SELECT 1 k, map('b', 1, 'a', 2) m, array(named_struct('x', map(2, 'q', 1, 'p'))) n")
    assert reconcile(spark, left, other, ["k"]).summary.head()["mismatched_rows"] == 1
