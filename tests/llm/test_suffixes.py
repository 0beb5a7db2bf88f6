import hashlib
import random
from collections import Counter

import numpy as np

from strandloom.llm import suffixes
from strandloom.llm.suffixes import cut_text, drop_repeats, measure_repeats, repeated_starts, suffix_array


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 10, 60):
        for letters in (1, 2, 3, 26):
            for _ in range(60):
                text = [rng.randint(1, letters) for _ in range(n)] + [0]
                assert suffix_array(text) == sorted(range(n + 1), key=lambda i: text[i:])


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(100):
        text = [rng.randint(1, 3) for _ in range(rng.randint(0, 40))] + [0]
        for m in (1, 3, 6):
            c = Counter(tuple(text[i : i + m]) for i in range(len(text) - m + 1))
            want = [i + m <= len(text) and c[tuple(text[i : i + m])] > 1 for i in range(len(text))]
            assert repeated_starts(text, m).tolist() == want


def brute(rows, length):
    counts = Counter()
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    passage = [" ".join(word() for _ in range(n)) for n in (60, 45, 200, 50, 39)]
    rows = []
    for i in range(90):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(4)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            if rng.random() < 0.5:
                a = rng.randint(0, len(p) // 2)
                p = p[a : a + rng.randint(150, 400)]
            if rng.random() < 0.3:
                a = rng.randint(0, len(p) - 1)
                p = p[:a] + "#" + p[a + 1 :]
            parts.insert(rng.randint(0, len(parts)), p)
        rows.append((i, "|".join(parts)))
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (200, None), (201, ""), (202, "x" * 700), (203, "xy" * 150), (204, "ab" * 150 + "c"), (205, passage[0][:199]), (206, "q" * 199), (207, "0123456789" * 20)]
    return rows


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_against_brute_force(spark):
    for seed, most in ((1, 20_000), (2, 3), (3, 1)):
        rows = made(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((tuple(r) for r in measure_repeats(docs, most_blocks=most).collect()), key=key)
        assert got == sorted(brute(rows, 200), key=key)


def test_small_texts_of_symbols(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TEXT_SYMBOLS", 50)
    rows = made(4)
    got = sorted((tuple(r) for r in measure_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=key)
    assert got == sorted(brute(rows, 200), key=key)


def test_texts_stay_texts(spark):
    assert cut_text("aébc".encode(), [(1, 2)]) == "aébc" and cut_text("aébc".encode(), [(1, 3)]) == "abc" and cut_text("aé".encode(), [(2, 3)]) == "aé"
    shared = "é" * 120
    docs = spark.createDataFrame([(1, f"one {shared} two", 5), (2, f"three {shared}", 6), (3, None, 7)], "doc_id long, text string, n_removed int")
    got = {r.doc_id: r for r in drop_repeats(docs).collect()}
    assert got[1].text == "on two" and got[2].text == "thre"  # "e " before the passage repeats as well
    assert got[3].text is None and got[3].n_removed == 0 and got[2].n_removed == 242


def test_empty(spark):
    assert measure_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_minima_of_long_texts(monkeypatch):
    from strandloom.llm import winnow

    rng = np.random.default_rng(2)
    v = rng.integers(0, 5, 300).astype(np.uint64) << np.uint64(40)
    whole = {w: winnow.window_minima(v, w).tolist() for w in (1, 2, 7, 31)}
    for segment in (32, 40, 299, 300):
        monkeypatch.setattr(winnow, "SEGMENT", segment)
        assert all(winnow.window_minima(v, w).tolist() == x for w, x in whole.items())
    monkeypatch.undo()
    assert len(winnow.window_minima(np.arange((1 << 24) + 5, dtype=np.uint64) << np.uint64(24), 190)) == (1 << 24) + 5 - 189


def test_clashing_columns(spark):
    shared = "z" * 300
    names = "key string, at_key long, runs array<int>, n_removed int, doc_id long, text string"
    got = drop_repeats(spark.createDataFrame([("k", 1, [2], 3, i, f"{i}{shared}") for i in range(2)], names)).collect()
    assert sorted((r.key, r.at_key, r.runs, r.n_removed, r.doc_id, r.text) for r in got) == [("k", 1, [2], 300, 0, "0"), ("k", 1, [2], 300, 1, "1")]


def test_texts_made_to_collide(spark):
    """Bytes that no polynomial modulo a power of two tells apart."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits) + "-"), (2, "".join("ba"[b] for b in bits) + "+")]
    got = sorted((tuple(r) for r in measure_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=key)
    assert got == sorted(brute(rows, 200), key=key)


def test_registered_query(spark, tmp_path):
    from strandloom.llm.queries import QUERIES

    rows = made(5)
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_suffix_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, 200), key=key)
