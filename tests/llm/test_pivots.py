import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import pivots
from strandloom.llm.queries import QUERIES

KIND = "vec_id long, embedding array<double>, label int, row long, home string"


def plain(rows, positives=5, negatives=10):
    """The same by loops over all pairs of rows."""
    kept = []
    for i, v, k in rows:
        if k is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(256 * c) for c in v], (k + 1) % 10 if i is not None and i % 7 == 0 else k))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, k) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, own) for b, (j, w, own) in enumerate(kept) if b != a]
        own = sorted((s for s in scored if s[2] == k), key=lambda s: (-s[0], last(s[1])))[:positives]
        for top, j, _ in own:
            fits = sorted((s for s in scored if s[2] != k and 30 * top <= 100 * s[0] <= 90 * top), key=lambda s: (-s[0], last(s[1])))[:negatives]
            out += [(i, j, n + 1, m, top, s) for n, (s, m, _) in enumerate(fits)]
    return sorted(map(str, out))


def run(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    return sorted(str((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)) for r in got)


def made(n, d, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    return [(int(i), [float(c) for c in centers[rng.integers(0, 12)] + rng.normal(0, 0.5, d)], int(rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("size", [4096, 37])
def test_against_all_pairs(spark, tmp_path, monkeypatch, size):
    """Also with many small cells and blocks of anchors; with copies, repeated rows and ids, a hot label and odd rows."""
    monkeypatch.setattr(pivots, "CELL_ROWS", size)
    monkeypatch.setattr(pivots, "ANCHOR_ROWS", 3 if size < 100 else 1024)
    rows = made(900, 6, size)
    rows = [(i, rows[50][1] if 200 <= i < 420 else v, 3 if 200 <= i < 500 else k) for i, v, k in rows]
    rows += [(300, rows[50][1], 3), (300, rows[50][1], 3), (300, rows[10][1], 4), (None, rows[50][1], 3), (None, rows[20][1], 5)]
    rows += [(400, None, 1), (500, [1.0] * 6, None), (600, [math.nan] * 6, 1), (700, [math.inf] * 6, 1), (800, [None] * 6, 1), (900, [0.0] * 6, 1), (1000, [], 2), (1100, [0.5, 0.5], 2)]
    assert run(spark, rows, tmp_path) == plain(rows)


def test_few_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.0], 1), (2, [0.8, 0.1], 2)]
    assert run(spark, rows, tmp_path) == plain(rows) != []


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]])
def test_nothing_to_return(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == []


def test_huge_components(spark, tmp_path):
    """Scores that doubles can't hold are exact, and end at a long's range."""
    rows = [(0, [1e7, 3.0], 0), (1, [1e7 + 0.125, 1.0], 1), (2, [5e6, 1.0], 2), (3, [5e6, 1.5], 2), (4, [9e6, 2.0], 3)]
    assert run(spark, rows, tmp_path) == plain(rows) != []
    far = [(0, [1e200], 0), (1, [1e200], 1), (2, [5e199], 2)]
    assert run(spark, far, tmp_path / "far") == []  # what ends at the range is no share of itself


def test_brackets_hold():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(500, 8)) * rng.choice([1, 256, 5000], (500, 1)))
    most = (x * x).sum(1).max()
    table = pivots.choose_pivots(x[:200], most)
    of_x = pivots.distances(pivots.augmented(x, most), table)
    for q in x[::25]:
        of_q = pivots.distances(np.append(q, 0.0)[None], table)[0]
        low, high = pivots.bracket(of_q, of_x, of_x, most + q @ q)
        score = x @ q
        assert (low <= score).all() and (score <= high).all() and (low > -most * 3).all()
        cell_low, cell_high = pivots.bracket(of_q, of_x.min(0)[None], of_x.max(0)[None], most + q @ q)
        assert cell_low[0] <= score.min() and score.max() <= cell_high[0]


def test_label_and_anchor_are_parameters(spark):
    rows = spark.createDataFrame([(i, [float(i % 5 + 1), 1.0], i % 3) for i in range(1, 30)], "vec_id int, embedding array<float>, label int")
    got = pivots.mine(rows, F.col("label"), F.col("vec_id") == 7, positives=2, negatives=3).collect()
    assert {r.anchor_id for r in got} == {7} and len({r.positive_id for r in got}) == 2 and all(r["rank"] <= 3 for r in got)
