"""Row numbers must not follow the file splits, which change with the cores that are registered."""

import pytest
from helpers import docs, prose, tuples

from twinledger.llm import common, exact_dedup, minhash_dedup, mixing, warc


@pytest.fixture
def moving_splits(spark, monkeypatch):
    """All files go to one partition until a first table is written, and then one to each."""
    name, made = "spark.sql.files.minPartitionNum", []
    scratch_dir = common.scratch_dir

    def moving(session):
        session.conf.set(name, "1000" if made else "1")
        made.append(scratch_dir(session))
        return made[-1]

    monkeypatch.setattr(common, "scratch_dir", moving)
    yield
    spark.conf.unset(name)


def test_drop_copies(spark, tmp_path, moving_splits):
    rows = [(i, f"text {i % 70}") for i in range(100)]
    kept = exact_dedup.drop_copies(spark, docs(spark, rows, path=tmp_path / "d"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30, 100))


def test_near_copies(spark, tmp_path, moving_splits):
    rows, first, at = [], [], 0
    for i in range(60):
        words = prose(i, 120)
        first.append(at)
        for turn in range(1 + 2 * (i % 3 == 0)):
            rows.append((at, " ".join(words[: 118 + turn])))
            at += 1
    kept = minhash_dedup.drop_near_copies(spark, docs(spark, rows, path=tmp_path / "d"))
    assert sorted(r["doc_id"] for r in kept.collect()) == first


def test_mix_takes_from_the_planned_documents(spark, tmp_path, moving_splits):
    rows = [(i, " ".join(f"d{i}" for _ in range(1 + i % 37)), "ab"[i % 2]) for i in range(300)]
    frame = docs(spark, rows, path=tmp_path / "d")
    mixed = mixing.mix(spark, frame)
    spark.conf.set("spark.sql.files.minPartitionNum", "1000")
    found = {}
    for r in mixed.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + len(r["text"].split())
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(spark, frame).collect() if r["taken"]}
    assert found == taken


def test_archives(spark, tmp_path, moving_splits):
    rows = [(i, f"http://h/{i}", f"body {i % 40}") for i in range(100)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "p"))
    found = warc.roundtrip(spark, spark.read.parquet(str(tmp_path / "p")))
    assert tuples(found, "page_id", "refers_to") == sorted(((i, i % 40 if i >= 40 else None) for i in range(100)), key=repr)
