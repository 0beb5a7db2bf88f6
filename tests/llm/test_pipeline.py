import random

from test_lines import brute as plain_lines
from test_minhash import brute as plain_groups

import corpus_pipeline as p
from strandloom.llm.suffixes import cut_text


def plain_passages(rows, length=200):
    seen = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = {}
    for i, b in raw.items():
        spans = []
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        text = cut_text(b, spans)
        if not spans or text.strip(" "):
            out[i] = text
    return out


def test_stages(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: rng.choice(["tree", "river", "über", "stone"]) + rng.choice("abcdefgh") + str(rng.randint(0, 99))
    passage = " ".join(word() for _ in range(50))
    rows = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(rng.randint(3, 25))) for _ in range(rng.randint(1, 6))]
        if i % 6 == 0:
            lines[0] += " " + passage
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300 + i, rows[i][1].replace("stone", "rock", 1)) for i in range(10)]
    bad = [(400 + i, "%%% ".join(word() for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + bad], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(p.STAGES)
    good = stages["quality"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, _ in rows) and good.columns == docs.columns
    deduped = {r.doc_id: r.text for r in stages["line_dedup"](spark, good, str(tmp_path)).collect()}
    want = {k[1]: t for k, t in plain_lines(rows, 2).items()}
    assert {i: t for i, t in want.items() if t.strip() or not dict(rows)[i].strip()} == {i: t for i, t in deduped.items()}
    left = sorted(deduped.items())
    mid = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in left], docs.schema)
    kept = {r.doc_id for r in stages["near_dedup"](spark, mid, str(tmp_path)).collect()}
    assert kept == {r[2] for r in plain_groups(left, 5, 80)}
    cut = {r.doc_id: r for r in stages["passage_dedup"](spark, mid, str(tmp_path)).collect()}
    assert {i: r.text for i, r in cut.items()} == plain_passages(left) and all(r.n_chars == len(r.text) for r in cut.values())
    out = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= kept and len({(r.sequence_id, r.offset) for r in out}) == len(out)
