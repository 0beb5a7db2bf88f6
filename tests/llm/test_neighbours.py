import math

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm.neighbours import search


def brute(rows, queries, k):
    out = {}
    for q, v in rows:
        if q in queries:
            near = sorted((math.dist(v, w), i) for i, w in rows if i != q)[:k]
            out[q] = near
    return out


def run(spark, rows, k=10, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string").repartition(3)
    got = {}
    for r in search(df, F.col("vec_id") % 5 == 0, k, **kw).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_recall_and_order(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    vectors = (centers[rng.integers(0, 30, 3000)] + rng.normal(0, 0.4, (3000, 16))).astype(np.float32)
    vectors[100:400] = vectors[100]  # a hot vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = run(spark, [(*r, "x") for r in rows])
    want = brute(rows, set(range(0, 3000, 5)), 10)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, near in want.items():
        assert [r for r, *_ in got[q]] == list(range(1, 11))
        assert [(s, i) for _, i, s in got[q]] == sorted((s, i) for _, i, s in got[q])
        hits += len({i for _, i, _ in got[q]} & {i for _, i in near})
        total += 10
        for _, i, s in got[q]:
            assert abs(s - math.dist(rows[q][1], rows[i][1])) < 1e-9
    assert hits / total > 0.95
    assert [i for _, i, _ in got[200]] == list(range(100, 110))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (5, [1.0, 2.0], "a"), (5, [1.0, 2.0], "a"), (6, [2.0, 2.0], "a"), (10, None, "a"), (15, [0.0, 0.0], "a"), (20, [nan, 1.0], "a"), (25, [inf, 1.0], "a"), (30, [None, 1.0], "a"), (35, [1.0], "a"), (None, [1.0, 1.0], "a"), (40, [], "a")]
    got = run(spark, rows)
    # both rows with id 5 are queries and candidates; the vectors of one component and of two meet at (1, 0)
    two = [(1, 0, 0.0), (1, 0, 0.0), (2, 5, 0.0), (2, 5, 0.0), (3, 6, 1.0), (3, 6, 1.0), (4, 35, 2.0), (4, 35, 2.0)]
    assert got == {0: [(1, 5, 0.0), (2, 5, 0.0), (3, 6, 1.0), (4, 35, 2.0)], 5: two, 35: [(1, 0, 2.0), (2, 5, 2.0), (3, 5, 2.0), (4, 6, 5**0.5)]}
    assert run(spark, []) == {} and run(spark, [(0, [1.0], "a")]) == {}


def test_near_copies(spark):
    """A group of many near copies, whose codes can't rank them."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    vectors[:1500] = vectors[0] + rng.normal(0, 1e-4, (1500, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = run(spark, [(*r, "x") for r in rows])
    want = brute(rows, set(range(0, 1500, 50)), 10)
    assert all([i for _, i, _ in got[q]] == [i for _, i in near] for q, near in want.items())


def test_recall_with_many_lists(spark):
    """The registered settings where only a part of the lists is visited."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 12))
    vectors = (centers[rng.integers(0, 40, 40_000)] + rng.normal(0, 0.6, (40_000, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in search(df, F.col("vec_id") % 400 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 40_000, 400):
        d = ((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 100 and hits / 1000 > 0.93
