import random
import tracemalloc

import corpus_pipeline
from helpers import CLASHING, DOCS, ODD, docs, prose
from test_exact_dedup import lower
from test_minhash_dedup import brute as near_brute
from test_packing import brute_pieces, check_packed

from twinledger.llm import minhash_dedup, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng, rows, labels = random.Random(21), [], []
    for i in range(400):
        words = prose(i, rng.choice([8, 50, 300]), 3_000)
        toxic = i % 10 == 0
        words += ["idiot", "scumbag"] * toxic
        rows.append((i, " ".join(words), f"src{i % 4}"))
        labels.append((i, 1, int(toxic)))
        if i % 7 == 0:
            rows.append((1_000 + i, rows[-1][1].upper(), "src0"))
        if i % 9 == 0 and len(words) > 100:
            rows.append((2_000 + i, " ".join(words[:-2] + ["other"]), "src1"))
    return rows, labels


def stages(spark, tmp_path, rows, labels, schema=DOCS):
    sf_dir = tmp_path / "sf"
    spark.createDataFrame(labels, LABELS).write.parquet(str(sf_dir / "labels.parquet"))
    frame = docs(spark, rows, schema, sf_dir / "documents.parquet")
    out = {"documents": frame.collect()}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, frame, str(sf_dir))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.columns == frame.columns
        result.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        out[name] = frame.collect()
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    out = stages(spark, tmp_path, rows, labels)
    clean = {r["doc_id"] for r in out["documents"] if "idiot" not in lower(r["text"])}
    assert {r["doc_id"] for r in out["toxicity"]} == clean
    groups = {}
    for r in out["toxicity"]:
        groups.setdefault(lower(r["text"]), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in out["exact_dedup"]) == sorted(map(max, groups.values()))
    kept = [i for i, _, _, keep in near_brute([(r["doc_id"], r["text"]) for r in out["exact_dedup"]]) if keep]
    assert sorted(r["doc_id"] for r in out["minhash_dedup"]) == sorted(kept)
    whole = {r["doc_id"]: r["text"] for r in out["minhash_dedup"]}
    assert out["source_mixing"] and all(set(r["text"].split()) <= set(whole[r["doc_id"]].split()) for r in out["source_mixing"])
    packed = out["best_fit_packing"]
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed), key=repr)
    assert got == brute_pieces([(r["doc_id"], r["text"]) for r in out["source_mixing"]])
    check_packed(packed, 1024)


def test_run_gives_the_last_stage(spark, tmp_path):
    rows, labels = corpus()
    out = stages(spark, tmp_path, rows, labels)
    run = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    columns = ("doc_id", "piece", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in columns) for r in run) == sorted(
        tuple(r[c] for c in columns) for r in out["best_fit_packing"]
    )


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    out = stages(spark, tmp_path, [(*r, None) for r in ODD], [], CLASHING)
    assert len(out["toxicity"]) == len(ODD)
    assert len(out["exact_dedup"]) == len({lower(t) for _, t in ODD})
    assert out["best_fit_packing"]


def test_no_rows(spark, tmp_path):
    assert all(not rows for rows in stages(spark, tmp_path, [], []).values())


def test_what_a_worker_remembers_of_its_steps_is_small():
    """Workers outlive a step, so what all steps remember counts together: here over 300,000 words that each come once."""
    terms = (("zorble", True, 2.0), ("quatchig", False, 2.0))
    caches = (toxicity._hashes, toxicity._matcher, minhash_dedup._words)
    for cache in caches:
        cache.cache_clear()
    tracemalloc.start()
    for at in range(0, 300_000, 1000):
        text = " ".join(f"{'zo' if i % 2 else 'wa'}{i:x}" for i in range(at, at + 1000))
        toxicity._marks(text)
        toxicity.finds(terms, frozenset(), text)
        minhash_dedup.min_hashes(minhash_dedup.shingle_set(text), 128)
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    for cache in caches:
        cache.cache_clear()
    assert kept < 56e6, kept


def test_words_are_judged_alike_remembered_or_not(monkeypatch):
    terms = (("zorble", True, 2.0), ("quatchig", False, 2.0))
    text = "Zorbles quatchig quatchgi zorbel waxing zotter zorbly " * 3
    toxicity._matcher.cache_clear()
    found = toxicity.finds(terms, frozenset({"zorbel"}), text)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 0)
    monkeypatch.setattr(toxicity, "KEPT_RUNS", 1)
    toxicity._matcher.cache_clear()
    assert toxicity.finds(terms, frozenset({"zorbel"}), text) == found
    assert len(toxicity._matcher(terms, frozenset({"zorbel"}), ())) == 1
    toxicity._matcher.cache_clear()
    assert {number for number, *_ in found[1]} == {0, 1}
