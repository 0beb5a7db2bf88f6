import hashlib
import math

import numpy as np

from strandloom.llm import annulus
from strandloom.llm.queries import QUERIES

KIND = "vec_id long, embedding array<double>, label int, code string, hot string"


def plain(rows, parts=4, entries=256, rounds=4):
    """The same by lists and loops: (vec_id, code, error, label_error), digest."""
    kept = [(i, [max(-annulus.MOST, min(annulus.MOST, math.floor(1024 * c))) for c in v], k) for i, v, k in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts)
    cut = lambda v: [(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def assign(v):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book)) for x, book in zip(cut(v), books, strict=True)]

    for _ in range(rounds):
        found = [(v, assign(v)) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for v, at in found if at[p][1] == e]
                if own:
                    new = [sum(c) // len(own) for c in zip(*own, strict=True)]
                    books[p] = books[p][:e] + [new] + books[p][e + 1 :]
    coded = [(i, "".join(f"{e:02x}" for _, e in assign(v)), sum(d for d, _ in assign(v)), k) for i, v, k in kept]
    total = {}
    for *_, error, k in coded:
        total[k] = total.get(k, 0) + error
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((str(i), code, error, total[k]) for i, code, error, k in coded), digest


def run(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", "y") for r in rows], KIND).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got), {r.codebooks_sha256 for r in got}


def test_against_loops(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(c) for c in np.round(rng.normal(size=8) * rng.choice([0.01, 0.1, 1.0]), 3)], None if i % 9 == 0 else int(rng.integers(0, 3))) for i in rng.permutation(400)]
    rows += [(1000 + i, [0.5] * 8, 1) for i in range(60)]  # a group of copies
    rows += [(5, [0.25] * 8, 2), (5, [0.25] * 8, 2), (None, [1.0] * 8, 7)]  # repeated ids, no id
    rows += [(2000, None, 1), (2001, [math.nan] * 8, 1), (2002, [math.inf] + [0.0] * 7, 1), (2003, [None] + [0.0] * 7, 1)]
    got, digest = run(spark, rows, tmp_path)
    want, known = plain(rows)
    assert got == want and digest == {known}


def test_few_rows_unlike_lengths_and_large_values(spark, tmp_path):
    rows = [(3, [0.1, -0.1, 0.2], 1), (1, [], None), (2, [1e30, -1e30, 1.0, 2.0, 3.0], None), (4, [0.0] * 5, 1)]
    got, digest = run(spark, rows, tmp_path)
    want, known = plain(rows)
    assert got == want and digest == {known}


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == ([], set())


def test_the_annulus_holds_its_edges():
    """Entries at the very distance that the first ones gave, on both sides, and equal entries: the lowest index wins."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        book = rng.integers(-3, 4, (rng.integers(1, 60), 2))
        x = rng.integers(-4, 5, (50, 2))
        d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
        at, best = annulus.nearest_in_annulus(x.astype(np.int64), book.astype(np.int64))
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
    line = np.arange(-40, 41, dtype=np.int64)[:, None] * 10
    at, best = annulus.nearest_in_annulus(np.array([[5], [-5], [0]]), line)
    assert at.tolist() == [40, 39, 40] and best.tolist() == [25, 25, 0]


def test_annulus_prunes(monkeypatch):
    """Of entries with spread norms only a few are evaluated."""
    rng = np.random.default_rng(4)
    book = (rng.normal(size=(256, 16)) * np.linspace(1, 4000, 256)[:, None]).astype(np.int64)
    x = book[rng.integers(0, 256, 500)] + rng.integers(-3, 4, (500, 16))
    r = np.sqrt((x * x).sum(1).astype(float))
    at, best = annulus.nearest_in_annulus(x, book)
    norms = np.sort(np.sqrt((book * book).sum(1).astype(float)))
    inside = np.searchsorted(norms, r + np.sqrt(best), "right") - np.searchsorted(norms, r - np.sqrt(best), "left")
    assert inside.mean() < 5 and (((x - book[at]) ** 2).sum(1) == best).all()


def test_label_errors_of_rare_and_common_labels(spark, monkeypatch):
    monkeypatch.setattr(annulus, "HOT_LABELS", 3)
    rows = [(i, "00", 10 + i, None if i < 30 else 1 if i < 60 else i) for i in range(90)]
    got = annulus.with_label_error(spark.createDataFrame(rows, "vec_id long, code string, error long, label int")).collect()
    total = {}
    for *_, e, k in rows:
        total[k] = total.get(k, 0) + e
    assert len(got) == 90 and all(r.label_error == total[r.label] for r in got)
