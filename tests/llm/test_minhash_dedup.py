import random

import numpy as np
import pytest
from helpers import CLASHING, ODD, docs, prose, tuples

from twinledger.llm import minhash_dedup as near
from twinledger.llm.components import connected_components


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows):
    """Smallest id reachable over links of at least 0.75, for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i in ids), key=repr)


def corpus():
    rng, rows = random.Random(11), []
    for base in range(25):
        words = prose(base, rng.choice([3, 5, 8, 40, 200, 600]))
        for copy in range(rng.choice([1, 2, 6])):
            changed = list(words)
            for _ in range(int(len(words) * rng.choice([0, 0, 0.004, 0.01, 0.02]))):
                changed[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((1000 * base + copy, " ".join(changed)))
    passage = prose(99, 60)  # shared by many that are no near copies
    rows += [(50_000 + i, " ".join(passage + prose(200 + i, 50))) for i in range(60)]
    chain = prose(77, 300)  # each near the next, the ends far apart
    for i in range(8):
        rows.append((60_000 + i, " ".join(chain)))
        chain[i * 20 : i * 20 + 8] = [f"c{i}x{k}" for k in range(8)]
    return rows + [(70_000, None), (70_001, ""), (70_002, "one"), (70_003, "ONE"), (70_004, "one two three four five")]


def test_against_brute_force(spark):
    rows = corpus()
    found = tuples(near.near_copy_report(spark, docs(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert found == brute(rows)


def test_odd_rows_clashing_columns_and_no_rows(spark):
    found = tuples(near.near_copy_report(spark, docs(spark, ODD, CLASHING)), "doc_id", "n_shingles", "component_id", "kept")
    expected = [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True), (None, 1, 4, False),
        (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
    ]
    assert [r for r in found if r[0] is None or r[0] < 7] == sorted(expected, key=repr)
    assert near.near_copy_report(spark, docs(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    words, rows = prose(1, 120), []
    for i in range(800):
        changed = list(words)
        changed[i % 100] = f"n{i}"
        rows.append((i, " ".join(changed)))
    found = near.near_copy_report(spark, docs(spark, rows)).collect()
    assert {r["component_id"] for r in found} == {0}


def test_connected_near_copies_give_no_rows_in_their_buckets(spark):
    """However many nodes of a bucket are connected, only the others and a few of it are paired."""
    group = [(i, 0, [7, 8, 9]) for i in range(500)]
    others = [(1_000 + i, 1_000 + i, [7, 50 + i]) for i in range(3)] + [(2_000, 2_000, [9, 60])]
    nodes = spark.createDataFrame(group + others, "node long, root long, keys array<long>")
    found = near._outside(spark, nodes).collect()
    assert sorted((r["node"], r["key"], r["main"]) for r in found) == [
        (1_000, 7, 0), (1_001, 7, 0), (1_002, 7, 0), (2_000, 9, 0),
    ]
    assert all(1 <= len(r["us"]) <= near.PIVOTS for r in found)
    cut = {r["node"]: sorted(r["keys"]) for r in near._still_mixed(spark, nodes).collect()}
    assert cut == {i: [7, 9] for i in range(500)} | {1_000: [7], 1_001: [7], 1_002: [7], 2_000: [9]}


def test_open_nodes_go_by_their_keys_and_not_by_their_tables(spark):
    """After the first links no step makes more rows of a node than it has keys, however large its group is."""
    keys = list(range(100, 100 + near.KEYS)), list(range(200, 200 + near.KEYS))
    group = [(i, 0, *keys) for i in range(300)]
    others = [(1_000, 1_000, [100, 1], [200, 2]), (1_001, 1_001, [101, 3], [4]), (1_002, 1_002, [5], [201])]
    nodes = spark.createDataFrame(group + others, "node long, root long, firsts array<long>, seconds array<long>")
    cut = {r["node"]: (r["firsts"], r["seconds"]) for r in near._still_open(spark, nodes).collect()}
    assert cut == {i: ([100, 101], [200, 201]) for i in range(300)} | {1_000: ([100], [200])}
    met = near._outside(spark, near._by_first(near._still_open(spark, nodes))).collect()
    assert [(r["node"], r["key"], r["main"]) for r in met] == [(1_000, 100, 0)]


@pytest.mark.parametrize("second, wanted", [(20, [(1, 2)]), (99, [])])
def test_last_pairs_share_a_key_of_either_collection(spark, second, wanted):
    """Pairs that share several keys are made once, and only if they share a second key too."""
    rows = [(1, 1, 400, 400, 0, 0, [10, 11, 12], [20, 21]), (2, 2, 400, 400, 0, 0, [11, 12, 13], [second, 22])]
    columns = "node long, root long, n long, shared long, sketch_a long, sketch_b long, firsts array<long>, seconds array<long>"
    open_ = spark.createDataFrame(rows, columns)
    sets = spark.createDataFrame([(1, list(range(1, 401))), (2, list(range(1, 401)))], "node long, shingles array<long>")
    found = near._remaining_pairs(spark, open_, sets, near.F.col("root") != near.F.col("root_u"))
    assert [tuple(r) for r in found.collect()] == wanted


def test_dropping_keeps_one_row_of_each_component(spark, tmp_path):
    rows = corpus()
    frame = docs(spark, rows + rows[:40], CLASHING, tmp_path / "d")
    kept = near.drop_near_copies(spark, frame)
    assert kept.columns == frame.columns
    empty = {70_000, 70_001}
    wanted = sorted([i for i, _, _, k in brute(rows) if k] + [])
    assert sorted(r["doc_id"] for r in kept.collect()) == wanted and empty <= set(wanted)
    assert near.drop_near_copies(spark, docs(spark, [], path=tmp_path / "e")).count() == 0


def test_full_shuffle_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_NODES", 0)
    rows = corpus()
    found = tuples(near.near_copy_report(spark, docs(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert found == brute(rows)


def test_tables_share_min_hashes():
    keys = near.signature(" ".join(prose(1, 100)))
    assert len(keys[3]) == len(keys[4]) == near.KEYS
    assert near.min_hashes(near.shingle_set("a b c d e f"), 2 * near.KEYS * near.HASHES).shape == (128,)


def test_recall_at_the_threshold():
    """The share of pairs at similarity 0.75 that no table holds is near what the docstring says."""
    rng, missed, trials = np.random.default_rng(5), 0, 400
    for _ in range(trials):
        union = rng.integers(0, 2**63, 400, dtype=np.uint64)
        hashes = [near.min_hashes(s, 2 * near.KEYS * near.HASHES) for s in (union[:350], union[50:])]
        keys = [h.reshape(2, near.KEYS, near.HASHES) for h in hashes]
        same = (keys[0] == keys[1]).all(axis=2).any(axis=1)
        missed += not same.all()
    assert missed / trials < 0.02


@pytest.mark.parametrize("n", [2, 3, 40])
def test_components_of_a_path_and_a_hub(spark, n):
    path = [(i, i + 1) for i in range(n)]
    hub = [(1_000, 1_001 + i) for i in range(200)] + [(5, 5)]
    found = connected_components(spark, spark.createDataFrame(path + hub, "u long, v long"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(n + 1)} | {
        (1_000 + i, 1_000) for i in range(201)
    }
    assert connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0
