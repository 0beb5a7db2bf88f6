import random

from strandloom.llm import minhash
from strandloom.llm.minhash import components, drop_near_duplicates, near_duplicates


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in groups[root(i)] if x is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return out


def made(seed, n, base):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, roots = [], [[rng.choice(words) for _ in range(rng.choice([2, 5, 40, 150]))] for _ in range(base)]
    for i in range(n):
        w = list(rng.choice(roots))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(words + [f"new{i}"])
        rows.append((i * 3 % n, rng.choice([" ", "\n", "\t"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_against_brute_force(spark):
    for seed, words, percent in ((1, 3, 85), (2, 5, 80)):
        rows = made(seed, 260, 8) + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "a b"), (None, "a b"), (None, "no id at all here"), (906, rows_long())]
        docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
        got = near_duplicates(docs, words, percent / 100).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(rows, words, percent), key=key)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        left = drop_near_duplicates(docs, words, percent / 100).collect()
        assert sorted([r.doc_id for r in left if r.doc_id is not None]) == sorted({r.component_id for r in got if r.component_id is not None})
        assert left[0].n == 1


def rows_long():
    return "x" * 200_000 + " é" * 30_000


def test_chain_of_links(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"z", b"y")], "a binary, b binary")
    got = {bytes(r["class"]): bytes(r["component"]) for r in components(links).collect()}
    assert got == {bytes([i]): b"\0" for i in range(41)} | {b"z": b"y", b"y": b"y"}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def by_matrix(sets, percent):
    """Smallest member of each set's component; links from the products of all rows."""
    import numpy as np

    at = {x: i for i, x in enumerate(sorted(frozenset().union(*sets)))}
    m = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[x] for x in s]] = 1
    both, size = m @ m.T, m.sum(1)
    near = 100 * both >= percent * (size[:, None] + size - both)
    label = np.arange(len(sets))
    while True:
        new = np.array([label[row].min() for row in near])
        new = new[new]
        if (new == label).all():
            return label.tolist()
        label = new


def family(seed, n, words, kinds, edits):
    """Near copies of one text whose edits, drawn from `kinds` at each place, are often the same."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            i = rng.randrange(len(w))
            kind = rng.randrange(kinds + 1)
            w[i : i + 1] = [f"n{i}x{kind}"] if kind else []
        out.append(" ".join(w))
    return out


def test_family_with_shared_edits(spark, monkeypatch):
    from strandloom.llm import minhash

    for seed, n, small, kinds, edits in ((1, 2000, 64, 3, (1, 2, 5, 7, 9)), (2, 250, 4, 0, (3, 4, 5))):
        monkeypatch.setattr(minhash, "SMALL_LIST", small)
        texts = family(seed, n, 110, kinds, edits)
        want = by_matrix([shingles(t, 3) for t in texts], 85)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 0.85).collect()}
        assert [got[i] for i in range(n)] == want and 1 < len(set(want)) < n


def test_words_made_to_collide(spark):
    """Words of two letters that no polynomial modulo a power of two tells apart."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = spark.createDataFrame([(1, f"{one} x y"), (2, f"{two} x y"), (3, f"{one} X y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 0.85).collect()} == {1: 1, 2: 2, 3: 1}


def test_registered_query(spark, tmp_path):
    from strandloom.llm.queries import QUERIES

    rows = made(7, 120, 5) + [(500, None), (501, "ONE two"), (502, "one\x0btwo")]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_minhash"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == sorted((i, n, c, i == c) for i, n, c in brute(rows, 3, 85))


def test_clashing_columns(spark):
    names = "kept_id long, kept_text long, text_key long, class string, doc_id long, text string"
    got = drop_near_duplicates(spark.createDataFrame([(7, 8, 9, "c", i, "a b c d e f g") for i in range(3)], names))
    assert got.columns == [n.split()[0] for n in names.split(", ")] and [tuple(r) for r in got.collect()] == [(7, 8, 9, "c", 0, "a b c d e f g")]


def test_texts_and_shingles_are_dealt_once_and_short(spark):
    rows = [(i // 2, i.to_bytes(16, "big"), 3, f"w{i} a b c d", 100 + i) for i in range(40)]
    bodies = spark.createDataFrame([(c, n, t) for _, c, n, t, _ in rows], "class binary, n long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # a class of 16 bytes went along with every shingle before, which only a sort can group
    found = minhash.shared_counts(bodies, 3)
    assert "SortAggregate" not in plan(found)
    # 'a b c' and 'b c d' are in all, 'w<i> a b' in one
    assert {(bytes(r["class"]), r.common) for r in found.collect()} == {(c, 2) for _, c, *_ in rows}
    keyed = spark.createDataFrame([(k, t) for _, _, _, t, k in rows for _ in range(3)], "text_key long, text string")
    wanted = spark.createDataFrame([(c, n, k) for _, c, n, _, k in rows[::2]], "class binary, n long, text_key long")
    one = minhash.one_text(keyed.hint("merge"), wanted)
    assert plan(one).count("Exchange") == 2  # texts went through a third one before
    assert sorted((bytes(r["class"]), r.n, r.text) for r in one.collect()) == sorted((c, n, t) for _, c, n, t, _ in rows[::2])


def test_texts_travel_packed_and_components_are_found_twice(spark, monkeypatch):
    tables, calls, plain, found = [], [], minhash.stored, minhash.components
    monkeypatch.setattr(minhash, "stored", lambda df: tables.append(df.schema) or plain(df))
    monkeypatch.setattr(minhash, "components", lambda links: calls.append(1) or found(links))
    texts = family(2, 250, 110, 0, (3, 4, 5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 0.85).collect()}
    assert [got[i] for i in range(250)] == by_matrix([shingles(t, 3) for t in texts], 85)
    # texts were dealt as strings, and lists known to be open were labelled anew before
    assert [t["text"].dataType.simpleString() for t in tables if "text" in t.names] == ["binary"] and len(calls) == 2


def test_classes_that_share_enough_postings(spark):
    rng = random.Random(4)
    sets = [(i.to_bytes(16, "big"), 9, i, [rng.randrange(-3, 3) if rng.random() < 0.4 else 10 * i + k for k in range(12)]) for i in range(60)]
    sets.append((b"z" * 16, 9, 99, [-(10**9) - k for k in range(12)]))
    df = spark.createDataFrame(sets, "class binary, n long, text_key long, signature array<int>")
    times = {}
    for *_, s in sets:
        for k, v in enumerate(s):
            times[k, v] = times.get((k, v), 0) + 1
    want = {t for _, _, t, s in sets if sum(times[k, v] > 1 for k, v in enumerate(s)) >= 5}
    assert {r.text_key for r in minhash.with_shared(df, 5).collect()} == want and 0 < len(want) < 60
