import hashlib
import random

from helpers import CLASHING, ODD, docs, prose, tuples
from pyspark.sql import functions as F

from twinledger.llm import exact_dedup


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(lower(text), []).append(i)
    out = []
    for i, text, *_ in rows:
        ids = groups[lower(text)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def many():
    rng, rows = random.Random(3), []
    for i in range(120):
        text = ". ".join(" ".join(prose(rng.randrange(40), 30)) for _ in range(rng.randrange(1, 40)))
        rows += [(3 * i, text), (3 * i + 1, text.upper() if i % 2 else text), (3 * i + 2, text[: len(text) // 2])]
    return rows + [(9_000 + i, "Same text. " * 900) for i in range(300)] + ODD + ODD


def report(spark, rows, schema=None):
    return tuples(exact_dedup.copy_report(spark, docs(spark, rows, *([schema] if schema else []))),
                  "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_against_brute_force(spark):
    assert report(spark, many()) == brute(many())


def test_clashing_columns_and_no_rows(spark):
    assert report(spark, ODD, CLASHING) == brute(ODD)
    assert report(spark, []) == []


def test_any_hash_gives_the_same_groups(spark):
    """Identifiers are verified: even a hash of three values tells all texts apart."""
    poor = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(3))
    rows = many()
    found = tuples(exact_dedup.copies(spark, docs(spark, rows), poor), "doc_id", "keep_id", "group_size")
    assert found == sorted(((a, b, c) for a, b, c, *_ in brute(rows)), key=repr)


def test_chunks_make_up_the_text(spark):
    frame = docs(spark, [(1, "x" * 30_000), (2, "Line.\n" * 5_000), (3, ""), (4, "😀" * 20_000)])
    for row in exact_dedup._chunked(frame).collect():
        assert "".join(row["_chunks"]) == row["_text"]


def test_shared_passages_give_shared_chunks(spark):
    passage = ". ".join(" ".join(prose(i, random.Random(i).randrange(3, 20))) for i in range(2_000))
    rows = exact_dedup._chunked(docs(spark, [(1, passage), (2, "Something else first. " + passage)])).collect()
    shared = set(rows[0]["_chunks"]) & set(rows[1]["_chunks"])
    assert len(shared) > 0.9 * len(rows[0]["_chunks"])


def test_dropping_keeps_one_row_and_all_columns(spark, tmp_path):
    rows = many()
    frame = docs(spark, rows, CLASHING, tmp_path / "d")
    kept = exact_dedup.drop_copies(spark, frame)
    assert kept.columns == frame.columns
    assert sorted(lower(r["text"]) for r in kept.collect()) == sorted({lower(t) for _, t in rows})
    wanted = {keep for _, keep, *_ in brute(rows)}
    assert {r["doc_id"] for r in kept.collect()} == wanted
    empty = docs(spark, [], path=tmp_path / "e")
    assert exact_dedup.drop_copies(spark, empty).count() == 0


def test_main_path_runs_no_python(spark):
    plan = exact_dedup.copy_report(spark, docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
