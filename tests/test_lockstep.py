import random

import numpy as np
import pyarrow as pa
import pytest
from test_decode import random_model, with_genes

from strandloom import topology as t
from strandloom.operators import decode as d
from strandloom.operators import lockstep
from strandloom.operators.emission import matrix

KIND = pa.list_(pa.struct([("pos", pa.int32()), ("score", pa.float64())]))


def rows_of(seqs, rng):
    """A batch, and the scores as dictionaries; places without motif and outside too, and two scores for one place."""
    lists = [[[(rng.randint(-2, len(s or "") + 2), rng.uniform(-3, 3)) for _ in range(len(s or ""))] for s in seqs] for _ in range(3)]
    scores = [{name: {p: v for p, v in lists[c][k]} for c, name in enumerate(d.SCORES)} for k in range(len(seqs))]
    columns = [pa.array([[{"pos": p, "score": v} for p, v in row] for row in own], KIND) for own in lists]
    return pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array(seqs, pa.string()), *columns], ["k", "seq", *d.SCORES]), scores


def solved(m, batch, penalty=0.0, shortest=0, longest=d.UNLIMITED, pmf=None, piece=d.CHUNK):
    return {r["k"]: r for part in lockstep.packed(iter([batch.slice(0, 5), batch.slice(5)])) for r in lockstep.solved(m, part, penalty, shortest, longest, pmf, True, piece).to_pylist()}


@pytest.mark.parametrize("kw", [{}, {"penalty": 1.5}, {"ties": True}, {"longest": 9}, {"shortest": 2, "longest": 20, "pmf": np.array([t.NEG_INF, *[-3.4] * 29])}])
def test_lockstep_is_the_dense_recurrence(kw, monkeypatch):
    kw, rng = dict(kw), random.Random(11)
    m = random_model(3, kw.pop("ties", False))
    seqs = [with_genes(rng, n) for n in (1, 2, 3, 5, 6, 7, 40, 41, 333, 334, 90, 91, 500)] + ["", None, "C" * 40, "A" * 70, "NNATGNRYGTTAA"]
    batch, scores = rows_of(seqs, rng)
    monkeypatch.setattr(lockstep, "AREA", 900)
    monkeypatch.setattr(lockstep, "CELLS", 64)
    got, penalty = solved(m, batch, **kw), kw.pop("penalty", 0.0)
    assert len({c for r in got.values() for c in r["path"]}) > 5
    for k, s in enumerate(seqs):
        e = matrix(m, s or "", **scores[k])
        path = d.viterbi(m, [e], penalty, **kw)[0] if s else np.zeros(0, np.int8)
        assert got[k]["path"] == d.letters_of(path)
        assert got[k]["score"] == d.path_score(m, e, path, penalty)
        want = d.confidence(d.posteriors(m, [e], penalty)[0], path) if s else []
        assert np.allclose(got[k]["confidence"], want, atol=1e-9)


def test_sums_of_states_without_a_way_out():
    """An intron without acceptor outgrows the only path there is by more than numbers can hold: 900 nats, then 15,000."""
    m, rng = random_model(5), random.Random(3)
    m.intron[:], m.intergenic[:] = -30.0, -0.5
    m.intron[0, 0], m.intergenic[0, 0] = -0.01, -3.0
    for many in (300, 5000):
        seqs = [with_genes(rng, 60) + "GT" + "A" * many + "CCC", with_genes(rng, 100)]
        batch, scores = rows_of(seqs, rng)
        got = solved(m, batch)
        for k, s in enumerate(seqs):
            e = matrix(m, s, **scores[k])
            path = d.viterbi(m, [e])[0]
            want = d.confidence(d.posteriors(m, [e])[0], path)
            assert got[k]["path"] == d.letters_of(path) and want.max() > 0.9
            assert np.allclose(got[k]["confidence"], want, atol=1e-7)


def test_impossible_rows_and_missing_scores():
    m = random_model(1)
    m.trans[t.START] = t.NEG_INF
    batch, _ = rows_of(["ATGC", "CC"], random.Random(1))
    assert [(r["path"], r["score"], r["confidence"]) for r in solved(m, batch).values()] == [("AAAA", t.NEG_INF, [0.0] * 4), ("AA", t.NEG_INF, [0.0] * 2)]
    bare = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["CCCC"])], ["k", "seq"])
    assert solved(random_model(1), bare)[0]["path"] == "BBBB"
    with pytest.raises(ValueError):
        solved(m, pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["CGTC"])], ["k", "seq"]))


def test_intervals_up_to_many_chunks_take_one_pass(spark, monkeypatch):
    """Above one chunk they cost 19 passes before, and with intron lengths a lane each."""
    monkeypatch.setattr(d, "decode_long", lambda *_: pytest.fail("cut into chunks"))
    rows = spark.createDataFrame([(k, "ACGTTGCA" * 2500) for k in range(6)], "k int, seq string").selectExpr("k", "seq", *(f"cast(array() as array<struct<pos:int,score:double>>) {c}" for c in d.SCORES))
    for kw in ({}, {"longest": 50, "pmf": [-4.0] * 51}):
        assert [len(r.path) for r in d.decode(rows, random_model(2), with_confidence=False, **kw).collect()] == [20_000] * 6


def test_mean_confidence_by_label(spark):
    from strandloom.operators.genes import label_confidence

    rows = spark.createDataFrame([("BCDEF", [0.1, 0.2, 0.3, 0.4, 0.5]), ("BBR", [0.3, 0.5, 1.0]), ("", [])], "path string, confidence array<double>")
    plan = label_confidence(rows)
    assert "explode" not in plan._jdf.queryExecution().optimizedPlan().toString()  # each base was a row before
    assert {r.label: (r.bases, round(r.confidence, 12)) for r in plan.collect()} == {"Intergenic": (3, 0.3), "Start": (3, 0.3), "UTR": (1, 0.5), "Stop": (1, 1.0)}


def test_genes_are_scored_where_they_are_found(spark, monkeypatch):
    from strandloom.operators import genes
    from strandloom.operators.emission import Model

    rng, m = random.Random(2), random_model(6)
    seqs = [with_genes(rng, n) for n in (60, 200, 90)]
    rows = spark.createDataFrame([(None if k == 2 else "s", k, s, *[[(p, rng.uniform(-3, 3)) for p in range(len(s))] for _ in range(6)]) for k, s in enumerate(seqs)], "species string, scaffold long, sequence string, " + ", ".join(f"{c}{x} array<struct<pos:int,score:double>>" for x in ("", "_minus") for c in d.SCORES))
    seen = []
    monkeypatch.setattr(genes, "stored", lambda rows, *_: seen.append(rows.columns) or d.stored(rows))
    got = genes.predict(rows, m, 0.5).collect()
    # paths of all bases with their confidences were written for each strand before, and records joined with their scores
    assert len(seen) == 4 and not any("path" in c for c in seen) and "exons" in seen[1] and "exons" in seen[3]
    bare = genes.predict(rows, m, 0.5, with_confidence=False)
    assert "confidence" not in bare.columns and sorted(tuple(r[c] for c in bare.columns) for r in got) == sorted(map(tuple, bare.collect()))
    assert got and {r.scaffold for r in got} <= {0, 1} and sorted(r.id for r in got) == [f"pred_{i + 1:04d}" for i in range(len(got))]
    data = {r.scaffold: r for r in rows.collect()}
    for r in got:
        own, suffix = data[r.scaffold], "_minus" if r.strand == "-" else ""
        s = own.sequence if r.strand == "+" else own.sequence[::-1].translate(str.maketrans("ACGT", "TGCA"))
        e = matrix(m, s, *({x.pos: x.score for x in own[f"{c}{suffix}"]} for c in d.SCORES))
        path = d.viterbi(m, [e], 0.5)[0]
        assert r.sequence == s[r.path_start : r.path_end] and len(r.confidence) == len(r.sequence) and isinstance(m, Model)
        assert np.isclose(r.score, d.path_score(m, e, path, 0.5, r.path_start, r.path_end))
