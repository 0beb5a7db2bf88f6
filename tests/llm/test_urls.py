import random

import duckdb
from pyspark.sql import functions as F

from strandloom.llm import urls
from strandloom.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

PAGES = [
    (1, "http://a.example.org/es/x#top", None),
    (2, "HTTP://A.net/q", '<link href="http://a.example.org/es/x" rel=canonical>'),
    (3, "https://B.org", '<meta http-equiv="refresh" content="0; url=http://A.NET/q#f">'),  # allowed by name
    (4, None, "<link rel=canonical href=http://A.net/q>"),
    (5, "nourl", "x"),
    (6, "http://c.net/d/e/f?x=1", "<!-- <link rel=canonical href=http://other.net/q> --><link rel='canonical' href='../../../g/./h'>"),
    (7, "http://c.net/g/h", '<LINK REL="next canonical" HREF="//x.com/de/1?a=1&amp;b=2">'),  # its target is blocked and no page
    (8, "http://x.com/de", ""),  # shorter than the rule's path
    (8, "http://x.com/de", ""),
    (9, "http://example.org/en/12", "<script>'<link rel=canonical href=http://z.net/>'</script>"),
    (10, "http://z.net/", "<link rel=canonical href='mailto:x@y.z'><link rel=canonical><meta http-equiv=refresh content=5>"),
    (11, "http://notexample.org/es/", None),
    (None, "http://x.com/fr/1", '<link rel="canonical" href="?p=2">'),
    (12, "http://x.com/fr/1?p=2#s", '<link rel=canonical href="#here">'),
    (13, "http://", "<link rel=canonical href=http://A.net/q>"),
]


def saved(spark, path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, verdict int").repartition(3).write.parquet(f"{path}/pages.parquet")


def test_cases_and_sql(spark, tmp_path):
    saved(spark, tmp_path, PAGES)
    rows = QUERIES["op11_url_filter"](spark, str(tmp_path)).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.aliases) for r in rows}
    assert len(rows) == len(PAGES)
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block", 3),
        2: ("a.net", "/q", None, "block", 3),
        3: ("b.org", "", None, "block", 3),  # the rule org/ needs a path
        4: ("", "", None, "allow", 1),
        5: ("", "", None, "allow", 1),
        6: ("c.net", "/d/e/f", None, "block", 3),
        7: ("c.net", "/g/h", None, "block", 3),
        8: ("x.com", "/de", None, "allow", 1),
        9: ("example.org", "/en/12", "example.org/en/1", "block", 1),
        10: ("z.net", "/", None, "allow", 1),
        11: ("notexample.org", "/es/", "org/", "allow", 1),
        None: ("x.com", "/fr/1", "com/fr/", "allow", 2),
        12: ("x.com", "/fr/1", "com/fr/", "allow", 2),
        13: ("", "", None, "allow", 1),
    }
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select page_id, host, path, rule, verdict, aliases from ({ORACLE_SQL['op11_url_filter']})").fetchall()
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(want, key=order) == sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.aliases) for r in rows), key=order)


def test_empty_table(spark, tmp_path):
    saved(spark, tmp_path, [])
    assert QUERIES["op11_url_filter"](spark, str(tmp_path)).collect() == []


def test_explicit_allow_in_a_blocked_component(spark):
    pages = [(i, u, None) for i, u in enumerate(["http://a.example.org/es/1", "http://b.net/", "http://c.com/fr/1"])]
    redirects = spark.createDataFrame([("http://b.net", "http://a.example.org/es/1"), ("http://c.com/fr/1", "http://b.net/"), (None, "http://b.net/"), ("http://b.net/", None)], "from_url string, to_url string")
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES, redirects)
    assert {r.page_id: (r.verdict, r.aliases) for r in got.collect()} == {0: ("block", 3), 1: ("block", 3), 2: ("allow", 3)}


def test_components_with_a_hub_and_a_chain(spark):
    rng = random.Random(5)
    name = lambda i: f"http://h{i:04}.net/"
    edges = [(i, 500) for i in range(400)]  # one target of many
    edges += [(i, i + 1) for i in range(600, 700)]
    edges += [(rng.randrange(800, 900), rng.randrange(800, 900)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in urls.components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a string, b string")).collect()}
    assert got == {name(x): name(root(x)) for x in list(up)}


def test_longest_rule_and_no_python(spark):
    rows = spark.createDataFrame([("http://A.Example.org:80/x/y?z",), ("x://b.example.org",), ("http://u@example.org/x#",)], "url string")
    rules = [("allow", "org", "/x/"), ("block", "example.org", "/x"), ("allow", "b.example.org", ""), ("block", "org:80", "/x/y")]
    found = rows.select(urls.rule_of(urls.host_of(F.col("url")), urls.path_of(F.col("url")), rules).alias("r")).collect()
    assert [None if r.r is None else r.r.rule for r in found] == ["org:80/x/y", "b.example.org", None]
    plan = urls.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string"), URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
