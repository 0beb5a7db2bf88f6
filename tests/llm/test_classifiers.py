import random

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import cnn, toxicity
from strandloom.llm.columnar import utf8


def made(n, seed):
    rng = random.Random(seed)
    words = ["tree", "river", "cloud", "stone", "über", "walk", "green", "the", "of"]
    rows = []
    for i in range(n):
        bad, toxic = rng.random() < 0.4, rng.random() < 0.4
        w = [rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(20, 200))]
        if bad:
            w = [x + "%%%" if rng.random() < 0.5 else x for x in w]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grumbler", "grumbling", "nitwit"]))
        rows.append((i, " ".join(w), int(not bad), int(toxic)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, 3) for i, t, *_ in rows] + [(9000, None, 3), (9001, "", 3), (None, "no id.", 3)], "doc_id long, text string, predicted int").repartition(3)
    return docs, spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = made(500, 1)
    docs, labels = tables(spark, rows)
    usable = F.col("doc_id") % 3 != 1
    for found, at in ((cnn.classify_quality(docs, labels, usable), 2), (toxicity.score_toxicity(docs, labels, usable), 3)):
        got = {r.doc_id: r for r in found.collect()}
        assert len(got) == 503 and all(0 <= r.score <= 1 for r in got.values())
        right = [got[r[0]].predicted == r[at] for r in rows if r[0] % 3 == 1]
        assert sum(right) / len(right) > 0.93


def test_sentences_are_found(spark):
    rows = made(400, 2)
    model = toxicity.train([t.encode() for _, t, *_ in rows], np.array([x for *_, x in rows]))
    docs = spark.createDataFrame([(1, "A green tree. What a nitwit he is! The river."), (2, "A green tree."), (3, None)], "doc_id long, text string")
    got = toxicity.locate_sentences(docs, model).collect()
    assert [(r.doc_id, r.sentence.strip()) for r in got] == [(1, "What a nitwit he is!")]


def test_without_labels(spark):
    docs, labels = tables(spark, made(5, 3))
    for found in (cnn.classify_quality(docs, labels.limit(0), F.lit(True)), toxicity.score_toxicity(docs, labels.limit(0), F.lit(True))):
        assert {r.score for r in found.collect() if r.doc_id in (9000, 9001)} == {0.5}
    assert cnn.classify_quality(docs.limit(0), labels, F.lit(True)).collect() == []


def test_chunks_cover_every_byte():
    import pyarrow as pa

    data, offsets = utf8(pa.array(["a" * 600, None, "b" * 256, "é"]))
    chunks, first = cnn.layout(data, offsets)
    assert np.diff(first).tolist() == [3, 1, 1, 1] and (chunks[:, : cnn.CHUNK] != cnn.PAD).sum() == len(data)


def naive_toxicity(model, text):
    """The noisy-or by words: 1 - prod(1 - p) over sentences, and the worst of them."""
    import re

    from strandloom.llm.columnar import M1, RangeHash, mix

    raw = text.encode()
    stops = [m.end() for m in re.finditer(rb"[.!?\n]", raw)]
    bounds = [0, *[s for s in stops if s < len(raw)], len(raw)]
    safe, worst = 1.0, None
    for a, b in zip(bounds, bounds[1:], strict=False):
        z = model.bias
        for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw[a:b]):
            word = np.frombuffer(m.group().lower(), np.uint8)
            h, shift = RangeHash(word), np.uint64(64 - toxicity.BUCKETS_LOG2)
            one = lambda x: np.array([x])
            z += model.weights[int((h.of(one(0), one(len(word))) >> shift)[0])]
            if len(word) > toxicity.STEM:
                z += model.weights[int((mix(h.of(one(0), one(toxicity.STEM)) + M1) >> shift)[0])]
        p = 1 / (1 + np.exp(-z))
        safe *= 1 - p
        if worst is None or p > worst[2]:
            worst = (a, b - a, p)
    return 1 - safe, worst


def test_noisy_or_by_words(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(-0.3, 0.6, 1 << toxicity.BUCKETS_LOG2), -1.0)
    said = ["A b! Größe nine? no\nWhatever it_is", "", "...", "One. One.", "x" * 50 + ". " + "yes and NO! " * 30]
    for size in (1 << 20, 16):
        monkeypatch.setattr(toxicity, "PART", size)
        batches = [said] if size > 100 else [[s] for s in said]
        for batch in batches:
            score, start, length, worst = model.judged(*utf8(pa.array(batch)))
            for i, text in enumerate(batch):
                want, (a, n, p) = naive_toxicity(model, text)
                assert np.isclose(score[i], want) and np.isclose(worst[i], p)
                assert not text.strip(".") or (start[i], length[i]) == (a, n)


def test_convolution_chunk_by_chunk(monkeypatch):
    import pyarrow as pa

    net = cnn.Network.fresh(3)
    rng = np.random.default_rng(6)
    net.weights[:] = rng.normal(0, 0.3, len(net.weights))
    net.shift[:] = rng.normal(0, 0.3, len(net.shift))
    said = ["a" * 700, "", "Ünlike " * 40, "z"]
    data, offsets = utf8(pa.array(said))
    for together in (2048, 2):
        monkeypatch.setattr(cnn, "TOGETHER", together)
        got = cnn.score(net, data, offsets)
        for i, text in enumerate(said):
            raw = list(text.encode())
            pools = []
            for a in range(0, max(1, len(raw)), cnn.CHUNK):
                seen = (raw[a : a + cnn.CHUNK + cnn.WIDTH - 1] + [cnn.PAD] * (cnn.CHUNK + cnn.WIDTH))[: cnn.CHUNK + cnn.WIDTH - 1]
                rows = [np.concatenate([net.embed[b] for b in seen[k : k + cnn.WIDTH]]) @ net.filters for k in range(cnn.CHUNK)]
                pools.append(np.maximum(np.max(rows, 0) + net.shift, 0))
            x = np.concatenate([np.mean(pools, 0), np.max(pools, 0)])
            assert abs(got[i] - 1 / (1 + np.exp(-(x @ net.weights + net.bias[0])))) < 1e-5


def test_gradients_by_finite_differences():
    net = cnn.Network.fresh(4)
    for name in ("embed", "filters", "shift", "weights", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(7)
    net.weights[:] = rng.normal(0, 0.5, len(net.weights))
    data, offsets = np.frombuffer(bytes(rng.integers(0, 256, 700).tolist()), np.uint8), np.array([0, 300, 320, 700])
    chunks, first = cnn.layout(data, offsets)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        w = cnn.windows(net, chunks)
        pools = np.maximum((w @ net.filters).reshape(len(chunks), cnn.CHUNK, -1).max(1) + net.shift, 0)
        p = cnn.sigmoid(cnn.features(pools, first) @ net.weights + net.bias[0])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for part, grad in zip(net.parts(), cnn.gradients(net, chunks, first, y), strict=True):
        for i in rng.choice(part.size, min(part.size, 25), replace=False):
            at = np.unravel_index(i, part.shape)
            old = part[at]
            part[at] = old + 1e-6
            up = loss()
            part[at] = old - 1e-6
            slope = (up - loss()) / 2e-6
            part[at] = old
            assert abs(slope - grad[at]) < 1e-4 * (1 + abs(slope))


def test_odd_tables(spark):
    """Columns that clash in any spelling, repeated rows, and one very long text."""
    rows = made(60, 8)
    docs, labels = tables(spark, rows)
    odd = docs.selectExpr("doc_id", "text", "predicted as Predicted", "1 as Score", "'x' as Worst_Start").unionByName(docs.selectExpr("doc_id", "text", "0 as Predicted", "2 as Score", "'y' as Worst_Start"))
    for found in (cnn.classify_quality(odd, labels, F.lit(True)), toxicity.score_toxicity(odd, labels, F.lit(True))):
        got = found.collect()
        assert len(got) == 126 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert all(len({round(r.score, 4) for r in got if r.doc_id == i}) == 1 for i in range(60))
    long = spark.createDataFrame([(5000, "tree river nitwit. " * 300_000)], "doc_id long, text string")
    r = toxicity.score_toxicity(long, labels, F.lit(True)).first()
    assert 0 <= r.score <= 1 and r.worst_length <= 20
    assert 0 <= cnn.classify_quality(long, labels, F.lit(True)).first().score <= 1


def test_registered_queries(spark, tmp_path):
    from strandloom.llm.queries import QUERIES

    docs, labels = tables(spark, made(80, 9))
    docs.selectExpr("doc_id", "text", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    import zlib

    for name, n, of, at in (("op4_toxicity", 4, 2, 0.3), ("op7_quality", 3, 1, 0.5)):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == 83
        for r in got:
            assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == of)
            assert r.predicted == int(r.score >= at)
