"""Steps whose work must grow with their input and whose vectors must stay small, against plain versions."""

import math
import random
import time

import numpy as np
import pyarrow as pa

from strandloom import topology as t
from strandloom.operators import counting, genes, intervals, labels


def test_slices_bound_the_letters_that_are_looked_at_together(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["A" * 300_000] * 20 + [None, "C"]), pa.array(range(22))], ["sequence", "n"])
    parts = list(counting.slices([batch]))
    assert max(sum(len(s or "") for s in p.column("sequence").to_pylist()) for p in parts) <= counting.BYTES
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(22))


def test_many_paints_on_one_place(spark):
    rng = random.Random(3)
    paints = [(1, a, a + rng.randint(1, 900), rng.randint(1, 3), (rng.random() < 0.5, f"t{i}", i)) for i, a in enumerate(rng.randint(-50, 3000) for _ in range(20_000))]
    want = np.zeros(3000, int)
    for _, a, b, r, _p in sorted(paints, key=lambda x: x[4]):
        want[max(a, 0) : max(b, 0)] = r
    rows = spark.createDataFrame(paints, "scaffold long, start long, end long, region int, priority struct<supported: boolean, parent: string, k: int>")
    began = time.time()
    found = intervals.paint(spark.createDataFrame([(1, "A" * 3000), (2, "ACGT")], "scaffold long, sequence string"), rows).collect()
    assert time.time() - began < 60  # every segment met every paint of its bucket before
    got = np.full(3000, -1)
    for r in found:
        if r.scaffold == 1:
            got[r.start : r.end] = r.region
    assert (got == want).all()
    assert [tuple(r) for r in found if r.scaffold == 2] == [(2, 0, 4, 0)]


def test_state_runs_and_records_of_a_long_gene(spark):
    inner = "".join(t.letter(t.EXON[i % 3]) for i in range(30_000))
    path = t.letter(1) * 4 + "".join(map(t.letter, t.START_CODON)) + inner + "".join(map(t.letter, t.STOP_CODON)) + t.letter(1) * 2
    n = len(path)
    rows = spark.createDataFrame([("s", 7, "ACGT" * (n // 4) + "A" * (n % 4), path, [i / n for i in range(n)])], "species string, scaffold long, seq string, path string, confidence array<double>")
    began = time.time()
    for strand in "+-":
        r = genes.gene_records(rows, strand).first()
        first, last = (5, n - 2) if strand == "+" else (3, n - 4)
        assert (r.start, r.end, r.intron_count, [tuple(x) for x in r.exons], r.introns) == (first, last, 0, [(first, last)], [])
        assert [c.position for c in r.confidence] == list(range(first, last + 1))
        inside = [i / n for i in range(4, n - 2)]
        assert [c.confidence for c in r.confidence] == (inside if strand == "+" else inside[::-1])
        assert r.confidence[0].state == t.label(t.START_CODON[0] if strand == "+" else t.STOP_CODON[2])
    assert time.time() - began < 60  # each base's state was cut out of the whole gene anew before


def test_usable_intervals_of_scaffolds_without_annotation(spark):
    seq = spark.createDataFrame([("s", 1, "ACGTAC"), ("s", 2, "TTTT")], "species string, scaffold long, sequence string")
    f = spark.createDataFrame([(1, "t1", "+", 2, 2)], "scaffold long, parent string, strand string, start0 long, end0 long")
    got = sorted(tuple(r) for r in labels.usable_intervals(seq, f).collect())
    assert got == [("s", 1, 0, 2, "AC", "BB"), ("s", 1, 3, 6, "TAC", "BBB"), ("s", 2, 0, 4, "TTTT", "BBBB")]


def test_bases_of_any_letters(spark):
    from strandloom.sources.adapters import bases

    got = bases(pa.array(["aBc Zé😀t", None, "", "ÄÖx"])).to_pylist()
    plain = lambda s: "".join("ACGT"[(ord(c.lower()) - 97) % 26 % 4] if c.isascii() and c.isalpha() else "A" for c in s)
    assert got == [plain("aBc Zé😀t"), None, "", plain("ÄÖx")]


def test_fasta_of_one_file_is_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from strandloom.sources import files

    lines = spark.range(4000).select(F.when(F.col("id") < 3990, "a").when(F.col("id") < 3999, "b").alias("file"), F.col("id").alias("line_no"), F.when(F.col("id") % 4 == 1, F.concat(F.lit(">r"), F.col("id").cast("string"))).otherwise("acg").alias("value"))
    rows = files.fasta_lines(lines)
    # a window by file put all of one file into one task before
    assert not any("Window" in x._jdf.queryExecution().optimizedPlan().toString() for x in (rows, files.fasta_ranges(files.fasta_records(lines))))
    want, seen = set(), {}
    for r in sorted(lines.collect(), key=lambda r: (r.file or "", r.line_no)):
        seen[r.file] = seen.get(r.file, 0) + r.value.startswith(">")
        if seen[r.file]:
            want.add((r.file, r.line_no, seen[r.file]))
    assert {(r.file, r.line_no, r.ord) for r in rows.collect()} == want
    ranges = sorted((r.file, r.ord, r.start, r.end) for r in files.fasta_ranges(files.fasta_records(lines)).collect())
    assert [x for x in ranges if x[0] == "b"] == [("b", 1, 0, 9), ("b", 2, 9, 12)]


def test_usable_intervals_are_made_once(spark, monkeypatch):
    from strandloom.plans import annotation_queries as a

    rows = spark.createDataFrame([("s", 1, 0, 2, "AC", "BB")], "species string, scaffold long, start long, end long, seq string, states string")
    monkeypatch.setattr(a, "scaffolds", lambda *x: None)
    monkeypatch.setattr(a, "features", lambda *x: None)
    monkeypatch.setattr(a.labels, "usable_intervals", lambda *x: rows)
    assert hasattr(a.training(spark, ""), "_stored_at")


def test_batches_of_scaffolds_stay_small(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandloom.sources import adapters

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        text = F.concat(F.col("id").cast("string"), F.repeat(F.lit("abcd"), 4000))
        spark.range(2000).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
        rows = adapters.scaffolds(spark, str(tmp_path)).select("sequence")
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"]) for b in batches), "size long").collect()
        # 2,000 texts of 16 KB, 32 MB, came as one batch before
        assert max(r.size for r in sizes) <= adapters.BATCH_BYTES + 20_000 and sum(r.size for r in sizes) > 30_000_000
    finally:
        spark.conf.set(key, before)


def test_paints_are_gathered_by_transcripts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        at, strand = rng.randint(-30, 700), rng.choice("++-")
        for _ in range(rng.randint(1, 5)):
            size = 3 * rng.randint(1, 30) + (rng.random() < 0.05)
            rows.append((i % 3, None if i == 4 else f"t{i}", strand if rng.random() < 0.95 else "-", at, at + size - 1))
            at += size + rng.choice([-2, 0, 20, 25, 40, 60])
    f = spark.createDataFrame(rows, "scaffold long, parent string, strand string, start0 long, end0 long")
    seq = spark.createDataFrame([("s", i, "ACGT" * 200, 800) for i in range(4)] + [("s", 9, "", 0)], "species string, scaffold long, sequence string, n int")
    for strand in "+-":
        tiles = lambda painted: sorted(map(tuple, intervals.paint(seq, painted).collect()))
        want = tiles(intervals.paints(f, strand))
        assert tiles(intervals.transcript_paints(f, strand)) == want and {r[3] for r in want} == {0, 1, 2, 3}
        assert {r.scaffold: r.states for r in labels.paths(seq, f, strand).collect()} == {r.scaffold: r.states for r in labels.labelled(seq, f, strand).collect()}
    # each paint was a row of its own before, and the letters went along where only their number counts
    rows = labels.with_paints(seq, f, "+", "n")
    assert "sequence" not in rows.columns and "explode" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_digests_of_joined_strings_hold_a_batch(spark):
    import hashlib

    from strandloom.plans.sequence_queries import joined_digests

    rows = [(s, k, x) for s, k, x in (("a", 2, "CC"), ("a", 1, "T" * 9), ("b", 5, "G"), (None, 3, "AC"), ("a", None, "GG"), ("a", 2, "CA"), ("b", 4, ""))]
    found = joined_digests(spark.createDataFrame(rows, "species string, scaffold long, s string").repartition(4))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()  # a species' strings were gathered in one row before
    want = {"a": "GG" + "T" * 9 + "CACC", "b": "G", None: "AC"}
    assert {r.species: r.digest for r in found.collect()} == {k: hashlib.md5(v.encode()).hexdigest() for k, v in want.items()}


def test_lines_of_scores(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandloom.plans import decode_queries as q
    from strandloom.sinks import files
    from strandloom.sources import adapters

    values = [0.0, -0.0, 1.5, -4.0, 0.004, 1e-9, -1e-12, 123456.123456789, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, x double")
    got = {r.pos: r.value for r in files.dense_scores(rows, ("x",)).collect()}
    assert got == {r.pos: f"{r.pos}\t{r.v}" for r in rows.select("pos", F.format_string("%.8f", "x").alias("v")).collect()} and got[1] == "1\t-0.00000000"
    seq = spark.createDataFrame([(7, "AGTAGGTG"), (2, "G"), (None, "CAGT"), (3, "")], "scaffold long, sequence string")
    score = lambda p, k, f: 0.0 if k is None else int(math.fmod(p * f + k * 31, 2001) - 1000) / 250
    want = {(k, p, None if k is None and s[p : p + 2] == "GT" else score(p, k, adapters.DONOR) if s[p : p + 2] == "GT" else 0.0, None if k is None and s[max(0, p - 1) : p + 1] == "AG" else score(p, k, adapters.ACCEPTOR) if s[max(0, p - 1) : p + 1] == "AG" else 0.0) for k, s in ((r.scaffold, r.sequence) for r in seq.collect()) for p in range(len(s))}
    assert {tuple(r) for r in adapters.base_scores(seq).collect()} == want
    spark.range(3).select(F.col("id").alias("doc_id"), F.lit("ab cd").alias("text"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    assert "explode" not in q.snk_scores_dense(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()  # letters became arrays and rows of strings before
