import random

import numpy as np

from strandloom.llm.lines import dedup_lines, delete_lines
from strandloom.llm.winnow import owned_runs, window_minima


def brute(rows, min_lines):
    """Line by line: deleted if a window that holds it occurs at an earlier place."""
    docs = {}
    for doc_id, text in rows:
        docs.setdefault((doc_id is None, doc_id or 0, text or ""), None)
    seen, out = set(), {}
    for key in sorted(docs):
        lines = [x for x in key[2].split("\n") if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for i in range(len(lines) - min_lines + 1):
            window = tuple(lines[i : i + min_lines])
            if window in seen:
                gone |= set(range(i, i + min_lines))
            seen.add(window)
        out[key] = delete_lines(key[2], [(i, i + 1) for i in gone])[0]
    return out


def test_minima():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7):
        for n in (0, 1, 2, 7, 50):
            v = rng.integers(0, 5, n).astype(np.uint64) << np.uint64(40)
            assert window_minima(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(n - width + 1)]
    o, a, b = owned_runs(np.array([3, 1, 2, 1, 0], np.uint64) << np.uint64(40), 2, np.ones(4, bool))
    assert o.tolist() == [1, 3, 4] and a.tolist() == [0, 2, 3] and b.tolist() == [1, 2, 3]


def check(spark, rows, min_lines):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_lines int, owner string").repartition(3)
    got = dedup_lines(docs, min_lines).collect()
    assert len(got) == len(rows)
    want = brute(rows, min_lines)
    texts = {}
    for k, t in want.items():
        texts.setdefault(k[:2], []).append(t)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((i is None, i or 0, want[i is None, i or 0, t or ""]) for i, t in rows)
    assert all(r.owner == "x" and r.n_lines >= r.n_removed for r in got)
    assert sum(r.text is None for r in got) == sum(t is None for _, t in rows)


def test_against_brute_force(spark):
    rng = random.Random(5)
    for min_lines in (2, 3):
        rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "  ", "d é"]) + rng.choice(["", "x"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
        rows += [(3, rows[3][1]), (None, rows[4][1]), (None, "q\nr\ns"), (90, "q\nr\nt\r"), (91, None), (91, ""), (92, "\n\n"), (93, "z\nz\nz\nz")]
        check(spark, rows, min_lines)


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_single_lines(spark):
    """Long lines between unlike neighbours, and texts of one line: the SQL's own rule, in plain Python."""
    rng = random.Random(6)
    long = [" ".join(rng.choice(["é", "wood", "a\tb"]) + str(k) for k in range(n)) for n in (49, 50, 60, 70)]
    rows = [(i, "\n".join(rng.choice([*long, "x", "y", "z" + str(i), " "]) for _ in range(rng.randint(1, 5)))) for i in range(80)]
    rows += [(100, long[2]), (101, long[2] + "\n"), (102, "x"), (103, "x\n\n"), (104, None), (105, "u" + str(5)), (105, "u" + str(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, want = set(), []
    for i, text in sorted({(i, t or "") for i, t in rows}):
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        windows = [(k, k + 2, tuple(lines[k : k + 2])) for k in range(len(lines) - 1)]
        windows += [(k, k + 1, x) for k, x in enumerate(lines) if len(x.split()) >= 50] + ([(0, 1, ("all", lines[0]))] if len(lines) == 1 else [])
        gone = set()
        for a, b, key in windows:
            gone |= set(range(a, b)) if key in seen else set()
            seen.add(key)
        want += [(i, delete_lines(text, [(k, k + 1) for k in gone])[0])] * max(1, sum(r == (i, text) for r in rows))
    got = dedup_lines(docs, long_words=50, short_texts=True).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted(want)
    assert sum(r.n_removed for r in got) > sum(r.n_removed for r in dedup_lines(docs).collect())


def test_single_lines_sql(spark, tmp_path):
    import duckdb

    from strandloom.llm.queries import ORACLE_SQL, QUERIES

    rng = random.Random(8)
    long = " ".join("w" + str(k) for k in range(55))
    rows = [(i, "\n".join(rng.choice([long, "x", "y" + str(i)]) for _ in range(rng.randint(1, 4)))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES["op6_single_lines"](spark, str(tmp_path)).collect())) == sorted(base.execute(ORACLE_SQL["op6_single_lines"]).fetchall())


def test_clashing_columns(spark):
    names = "text_key long, at_doc string, at_text long, ranges array<int>, doc_id long, text string"
    got = dedup_lines(spark.createDataFrame([(1, "a", 2, [3], i, "one\ntwo") for i in range(2)], names)).collect()
    assert sorted((r.text_key, r.at_doc, r.at_text, r.ranges, r.doc_id, r.text) for r in got) == [(1, "a", 2, [3], 0, "one\ntwo"), (1, "a", 2, [3], 1, "")]


def test_lines_made_to_collide(spark):
    """Lines of two letters that no polynomial modulo a power of two tells apart."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    check(spark, [(1, f"{one}\nsame"), (2, f"{two}\nsame"), (3, f"{one}\nsame")], 2)


def test_registered_query(spark, tmp_path):
    import duckdb

    from strandloom.llm.queries import ORACLE_SQL, QUERIES

    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice("abc ") for _ in range(rng.randint(0, 6)))) for i in range(50)] + [(None, "a\nb"), (60, None), (3, "x")]
    spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()), key=str) == sorted(base.execute(ORACLE_SQL["op6_line_dedup"]).fetchall(), key=str)
