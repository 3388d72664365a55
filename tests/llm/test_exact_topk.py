import math

import numpy as np
import pytest

from twinledger.llm import exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, k=10, step=100):
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for q, v in {(i, tuple(v)) for i, v in whole if i is not None and i % step == 0}:
        scored = [
            (-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in whole if i != q
        ]
        out += [
            (q, rank, None if null else i, -score)
            for rank, (score, null, i) in enumerate(sorted(scored)[:k], 1)
        ]
    return sorted(out, key=repr)


def found(spark, rows, **options):
    frame = exact_topk.top_k(spark, table(spark, rows), **options)
    return sorted(map(tuple, frame.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def vectors(n, dims, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dims)) * spread)]


@pytest.mark.parametrize(("n", "dims"), [(700, 16), (701, 3), (300, 1), (5, 4)])
def test_against_brute_force(spark, n, dims):
    assert found(spark, vectors(n, dims)) == brute(vectors(n, dims))


def test_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 3)
    rows = vectors(900, 8, 2)
    assert found(spark, rows) == brute(rows)


def test_clustered_and_equal_vectors(spark):
    rows = vectors(300, 12, 3, 0.05)
    centre = np.array(vectors(1, 12, 9)[0][1])
    rows = [(i, [float(a + b) for a, b in zip(v, centre)]) for i, v in rows]
    rows += [(1_000 + i, rows[5][1]) for i in range(400)]
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = vectors(120, 4, 4)
    rows += [
        (200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]),
        (300, []), (301, [0.5]), (302, [0.1] * 9), (400, [0.0] * 4), (None, [2.0] * 4), (500, [1.0, 1.0, 1.0, 1.0]),
        (500, [1.0, 1.0, 1.0, 1.0]), (600, [-1.0, 2.0, 0.0, 0.0]), (600, [3.0, 2.0, 0.0, 0.0]),
    ]
    got, want = found(spark, rows), brute(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_large_components_stay_exact(spark):
    rows = [(100, [1e6, -1e6]), (1, [1e6, 1.0]), (2, [1e6, 2.0]), (3, [-1e6, 1e6])] + [(10 + i, [float(i), 0.0]) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_other_k_and_no_rows(spark):
    rows = vectors(150, 5, 6)
    assert found(spark, rows, k=3, query_step=50) == brute(rows, 3, 50)
    assert found(spark, []) == []


def test_reading_stops_early():
    """On clustered vectors, lists are not read to their end."""
    rng = np.random.default_rng(0)
    near, far = rng.normal(1.0, 0.01, (200, 16)), rng.normal(0, 0.1, (4_000, 16))
    matrix = np.floor(1024 * np.vstack([near, far])).astype(np.int64)
    lists, read = exact_topk.SortedLists(np.arange(len(matrix)), matrix), []
    parts = lists._parts
    lists._parts = lambda used, rising, begin, end: read.append(end) or parts(used, rising, begin, end)
    best = lists.best(matrix[0], 0, 10)
    assert max(read) < len(matrix) / 2
    scores = matrix @ matrix[0]
    order = [i for i in np.lexsort((np.arange(len(matrix)), -scores)) if i][:10]
    assert best == [(int(scores[i]), int(i)) for i in order]
