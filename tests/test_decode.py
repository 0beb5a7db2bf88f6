import itertools
import math
import random

import numpy as np

from strandloom import topology as t
from strandloom.operators.decode import confidence, decode, path_score, posteriors, viterbi
from strandloom.operators.emission import HALF, QUARTER, Model, matrix


def forced(*steps):
    """A model whose only edges are the given ones (from, to, probability)."""
    m = Model()
    for a, b, p in steps:
        m.trans[a, b] = math.log(p)
    return m


IG, SC1, SC2, SC3, IN1, ACC1 = 1, 2, 3, 4, 11, 14
NONE = {"donor": {}, "acceptor": {}, "start": {}}


def test_best_paths():
    m = forced((0, SC1, 1.0), (SC1, SC2, 1.0), (SC2, SC3, 1.0), (SC3, 20, 1.0))
    assert viterbi(m, [matrix(m, "ATG", **NONE)])[0].tolist() == [SC1, SC2, SC3]
    m = forced((0, IG, 1.0), (IG, IG, 0.9), (IG, 20, 0.1))
    assert viterbi(m, [matrix(m, "CGTA", **NONE)])[0].tolist() == [IG] * 4
    m = forced((0, IG, 0.1), (0, SC1, 0.9), (IG, IG, 0.5), (IG, 20, 0.5), (SC1, SC2, 1.0), (SC2, SC3, 1.0), (SC3, 20, 1.0))
    assert viterbi(m, [matrix(m, "ATG", **NONE)])[0].tolist() == [SC1, SC2, SC3]
    assert viterbi(m, []) == []


def test_intron_bounds():
    m = forced((0, IN1, 0.9), (0, IG, 0.1), (IN1, IN1, 0.5), (IN1, ACC1, 0.5), (ACC1, 20, 1.0), (IG, IG, 0.5), (IG, 20, 0.5))
    e = matrix(m, "CAG", **NONE)
    assert viterbi(m, [e], shortest=2, longest=10)[0].tolist() == [IN1, IN1, ACC1]
    assert viterbi(m, [e], shortest=3, longest=10)[0].tolist() == [IG] * 3


def test_gene_penalty():
    m = forced((0, IG, 1.0), (IG, IG, 0.5), (IG, SC1, 0.5), (IG, 20, 0.001), (SC1, SC2, 1.0), (SC2, SC3, 1.0), (SC3, 20, 1.0))
    e = matrix(m, "CATG", **NONE)
    assert viterbi(m, [e], 0.0)[0].tolist() == [IG, SC1, SC2, SC3]
    assert viterbi(m, [e], 50.0)[0].tolist() == [IG] * 4


def test_impossible_sequence():
    m = Model()
    e = matrix(m, "CCC", **NONE)
    path = viterbi(m, [e])[0]
    assert path.tolist() == [0, 0, 0]
    assert confidence(posteriors(m, [e])[0], path).tolist() == [0, 0, 0]


def test_forward_backward():
    m = forced((0, IG, 1.0), (IG, IG, 0.9), (IG, 20, 0.1))
    e = matrix(m, "CGT", **NONE)
    assert np.allclose(confidence(posteriors(m, [e])[0], np.array([IG] * 3)), 1.0, atol=1e-9)
    m = forced((0, IG, 0.25), (0, IN1, 0.75), (IG, 20, 1.0), (IN1, 20, 1.0))
    e = matrix(m, "C", **NONE)
    assert abs(confidence(posteriors(m, [e])[0], np.array([IN1]))[0] - 0.75) < 1e-12


def test_emissions():
    m = Model()
    m.exon[0][:], m.exon[1][:], m.exon[2][:] = math.log(0.7), math.log(0.2), math.log(0.1)
    e = matrix(m, "ATGGTCGTAC", **NONE)
    assert e[0, IG] == QUARTER and e[4, 5] == QUARTER and e[1, 8] == t.NEG_INF and e[2, SC3] == 0 and np.allclose(np.exp(e[5, 5:8]), [0.7, 0.2, 0.1])
    for codon, ok in (("TAA", 1), ("TAG", 1), ("TGA", 1), ("TGG", 0)):
        assert (matrix(m, codon, **NONE)[2, 19] == 0) == bool(ok)
    assert matrix(m, "TAA", **NONE)[1, 18] == HALF and matrix(m, "ACG", **NONE)[0, SC1] == t.NEG_INF
    try:
        matrix(m, "ATG", {}, {}, None)
        raise AssertionError("scores are missing")
    except ValueError:
        pass


def test_against_all_paths():
    rng = random.Random(4)
    states = list(range(1, 20))
    for _ in range(12):
        m = Model()
        for a, b in t.EDGES:
            m.trans[a, b] = math.log(rng.random())
        seq = [rng.choice(["ATG", "ATGA", "GTAG", "CAGT"]) for _ in range(3)]
        es = [matrix(m, s, **NONE) for s in seq]
        for e, path, post in zip(es, viterbi(m, es, 0.7), posteriors(m, es, 0.7), strict=True):
            scores = {}
            walk = [(s,) for s in states if m.trans[0, s] > t.NEG_INF]
            for _i in range(1, len(e)):
                walk = [w + (s,) for w in walk for s in states if m.trans[w[-1], s] > t.NEG_INF]
            for w in walk:
                v = m.trans[w[-1], 20] + path_score(m, e, np.array(w), 0.7)
                if v > t.NEG_INF:
                    scores[w] = v
            if not scores:
                continue
            assert scores[tuple(path.tolist())] >= max(scores.values()) - 1e-9
            total = np.logaddexp.reduce(list(scores.values()))
            for i, s in itertools.product(range(len(e)), states):
                own = [v for w, v in scores.items() if w[i] == s]
                want = np.logaddexp.reduce(own) - total if own else t.NEG_INF
                assert np.isclose(post[i, s], want, atol=1e-9) or (want == post[i, s])


def test_decode_rows(spark):
    m = forced((0, IG, 1.0), (IG, IG, 0.5), (IG, SC1, 0.5), (IG, 20, 0.01), (SC1, SC2, 1.0), (SC2, SC3, 1.0), (SC3, 20, 1.0))
    rows = spark.createDataFrame([(1, "CATG"), (2, ""), (3, "CC"), (4, None)], "k int, seq string").selectExpr("k", "seq", "cast(array() as array<struct<pos:int,score:double>>) donor", "cast(array() as array<struct<pos:int,score:double>>) acceptor", "cast(array() as array<struct<pos:int,score:double>>) start")
    got = {r.k: r for r in decode(rows, m).collect()}
    assert got[1].path == t.letters([IG, SC1, SC2, SC3]) and got[2].path == "" and got[3].path == "BB" and got[4].path == "" and len(got[1].confidence) == 4


def test_grid_search_takes_long_intervals(spark, monkeypatch):
    from strandloom.operators import evaluate
    from strandloom.plans import decode_queries as q

    rng = random.Random(4)
    rows = [(k, 0, "".join(rng.choice("ACGT") for _ in range(n))) for k, n in enumerate((2500, 30, 2100))]
    gold = ["".join(rng.choice([t.letter(1), t.letter(2), t.letter(8), t.letter(11)]) for _ in s) for *_, s in rows]
    data = spark.createDataFrame([(*r, g) for r, g in zip(rows, gold, strict=True)], "scaffold long, start long, seq string, states string")
    own = Model(trans=np.where(np.isin(np.arange(441).reshape(21, 21), [a * 21 + b for a, b in t.EDGES]), -1.0, t.NEG_INF))
    monkeypatch.setattr(q, "training", lambda *_: data)
    monkeypatch.setattr(q, "fitted", lambda *_: own)
    assert sorted(len(r.seq) for r in q.tuning_intervals(spark, "").collect()) == [30, 2100, 2500]
    monkeypatch.setattr(evaluate, "GROUP", 2)
    monkeypatch.setattr(evaluate, "splice_grid", lambda: [(1.0, 0.0, 1.0, 0.0), (0.5, -2.0, 0.5, 3.0), (1.5, 4.0, 1.5, 4.0)])
    got = {r.candidate: r.objective for r in q.agg_grid_search_splice(spark, "").collect()}
    packed = q.tuning_intervals(spark, "").collect()
    for i, (ds, db, s, b) in enumerate(evaluate.splice_grid()):
        m = Model(trans=own.trans, donor_scale=ds, donor_bias=db, acceptor_scale=s, acceptor_bias=b)
        pred = np.concatenate([viterbi(m, [matrix(m, r.seq, *({x.pos: x.score for x in r[k]} for k in ("donor", "acceptor", "start")))], q.PENALTY)[0] for r in packed]).astype(int)
        true = np.concatenate([np.frombuffer(r.gold.encode(), np.uint8).astype(int) - 65 for r in packed])
        f1 = []
        for codes, exact in ((t.INTRONIC, False), (t.DONOR, True), (t.ACCEPTOR, True)):
            p, g = np.isin(pred, list(codes)), np.isin(true, list(codes))
            f1.append(2 * (p & g & ((pred == true) | (not exact))).sum() / max(1, p.sum() + g.sum()))
        assert math.isclose(got[i], sum(f1) / 3, abs_tol=1e-12)
    assert len(got) == 3


def test_intron_cap_is_the_percentile(spark, monkeypatch):
    from strandloom.plans import decode_queries as q

    lengths = spark.createDataFrame([(6000,)] * 3, "length long")
    monkeypatch.setattr(q, "training", lambda *_: None)
    monkeypatch.setattr(q.model, "intron_lengths", lambda *_: lengths)
    seen = {}
    monkeypatch.setattr(q, "decoded", lambda *_, **kw: seen.update(kw) or spark.createDataFrame([(1, "B")], "scaffold long, path string"))
    q.dec_intron_length(spark, "")
    assert seen["longest"] == 6000 and len(seen["pmf"]) == 6001
    lengths = lengths.where("length < 0")
    monkeypatch.setattr(q.model, "intron_lengths", lambda *_: lengths)
    q.dec_intron_length(spark, "")
    assert seen["longest"] == 2**63 - 1 and seen["pmf"] is None


def random_model(seed, ties=False):
    rng = np.random.default_rng(seed)
    m = Model()
    for a, b in t.EDGES:
        m.trans[a, b] = -1.0 if ties else math.log(rng.uniform(0.05, 1))
    if not ties:
        m.intergenic, m.intron, m.exon = (np.log(rng.dirichlet(np.ones(4), x.shape[:-1])) for x in (m.intergenic, m.intron, m.exon))
    return m


def with_genes(rng, n):
    """Letters with genes among them, so that paths are not all intergenic."""
    out = ""
    while len(out) < n:
        out += "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 30))) + "ATG" + "".join(rng.choice(["GCT", "AAA", "GTAAGCCAG"]) for _ in range(rng.randrange(1, 9))) + "TAA"
    return out[:n]


def test_chunks_give_the_path_of_one_pass(spark, monkeypatch):
    from strandloom.operators import decode as d

    rng = random.Random(7)
    rows = [(k, with_genes(rng, n)) for k, n in enumerate((1, 2, 15, 16, 17, 31, 32, 33, 200, 333, 500))] + [(50, ""), (51, None), (52, "C" * 40)]
    scored = [(k, s, *(None if s is None else [(p, rng.uniform(-3, 3)) for p in range(len(s)) for _ in range(2)] for _ in range(3))) for k, s in rows]
    for _, _, *lists in scored:
        for x in lists:
            rng.shuffle(x or [])
    kind = "array<struct<pos:int,score:double>>"
    data = spark.createDataFrame(scored, f"k int, seq string, donor {kind}, acceptor {kind}, start {kind}").fillna({"seq": ""}).repartition(3)
    data = data.selectExpr("k", "seq", *(f"coalesce({c}, array()) as {c}" for c in ("donor", "acceptor", "start")))
    pmf = np.full(30, -3.4)
    pmf[0] = t.NEG_INF
    for kw in ({}, {"penalty": 1.5}, {"ties": True}, {"longest": 9}, {"shortest": 2, "longest": 20, "pmf": pmf.tolist()}):
        kw = dict(kw)
        m = random_model(3, kw.pop("ties", False))
        want = {r.k: r for r in d.decode(data, m, **kw).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(d, "CHUNK", 16)
            got = {r.k: r for r in d.decode(data, m, **kw).collect()}
        assert got.keys() == want.keys()
        assert len({c for r in want.values() for c in r.path}) > 5 or kw
        for k, w in want.items():
            assert got[k].path == w.path and len(got[k].confidence) == len(w.confidence)
            assert np.allclose(got[k].confidence, w.confidence, atol=1e-9)
            assert np.isclose(got[k].score, w.score) or got[k].score == w.score or (math.isnan(got[k].score) and math.isnan(w.score))


def test_an_impossible_part_of_a_long_interval(spark, monkeypatch):
    from strandloom.operators import decode as d

    m = forced((0, SC1, 1.0), (SC1, SC2, 1.0), (SC2, SC3, 1.0), (SC3, 20, 1.0))
    rows = spark.createDataFrame([(1, "ATGCCCCCCCCCCCCC")], "k int, seq string").selectExpr("k", "seq", *(f"cast(array() as array<struct<pos:int,score:double>>) {c}" for c in ("donor", "acceptor", "start")))
    want = d.decode(rows, m).first()
    monkeypatch.setattr(d, "CHUNK", 6)
    got = d.decode(rows, m).first()
    assert got.path == want.path == "A" * 16 and got.confidence == want.confidence == [0.0] * 16


def test_parts_have_the_emissions_of_the_whole():
    from strandloom.operators.emission import BEFORE_PART, BEHIND_PART, part_matrix

    rng = random.Random(8)
    m, s = random_model(4), with_genes(rng, 120)
    scores = [{p: rng.random() for p in range(len(s))} for _ in range(3)]
    full = matrix(m, s, *scores)
    for at in range(0, 120, 11):
        first = max(0, at - BEFORE_PART) if at else 0
        if at and at < BEFORE_PART:
            continue
        own = [{p - first: v for p, v in x.items()} for x in scores]
        part = part_matrix(m, s[first : at + 11 + BEHIND_PART], at - first, min(11, 120 - at), *own)
        assert (part == full[at : at + 11]).all()
