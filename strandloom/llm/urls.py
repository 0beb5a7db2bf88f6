"""URL filters by redirect equivalence.

Addresses that redirect to each other, or name each other as canonical, are one resource under several names. They are the nodes of a graph; its edges
are the `canonical` links and `refresh` redirects in the pages' HTML and, if given, a table of HTTP redirects. A block rule that hits any address
of a connected component blocks all of its addresses, except those that a rule allows by name: an explicit rule, allow or block, always decides its own
addresses. What no rule and no alias blocks is allowed.

Rules are a bounded list (`MOST_RULES`), compiled into one expression. Only addresses with an edge enter the graph. Components come from repeated smallest
labels with pointer jumping, all in tables and with salted joins, as one address may be the target of a third of all edges. Only DataFrame functions are
used.

Defined cases: a null url, or one without `://`, has empty host and path, no rule and no edge, and is allowed; addresses are compared without fragment,
with scheme and host in lower case and `/` for an empty path; a link of a page counts also if its target isn't a page (and blocks the page if a rule blocks
the target); relative links are resolved against the page's url (`base` elements aren't read); links inside comments and scripts don't count; other schemes
than http and https make no edge; null html has no links; rows that repeat are judged alike, one result row each; an empty table stays empty;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

MOST_RULES = 1000
SALTS = 16
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# an attribute's value, quoted or not, in the groups 1 to 3
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def host_of(url: Column) -> Column:
    """What lies between the first `://` and the next `/`, `?` or `#`, A-Z lower-cased; empty without `://` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to `?` or `#`; empty without `://` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest of the rules (verdict, host, path) that fits, or null; of equally long ones the one with the longer host."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    fits = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        own = F.struct(F.lit(len(of + start)).alias("size"), F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start)), own).otherwise(fits)
    return fits


def without_dots(path: Column) -> Column:
    """The path with its `.` and `..` segments resolved; they never climb above the root."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == ".", kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")).cast("array<string>"), step)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def node_of(url: Column) -> Column:
    """The address that stands for a url; null if it isn't an http address."""
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z]+)://", 1))
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    clean = F.when(path.rlike(r"/\.\.?(/|$)"), without_dots(path)).otherwise(path)
    whole = F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(clean), F.rtrim(query))
    return F.when(scheme.isin("http", "https") & (host_of(url) != ""), whole)


def resolved(base: Column, link: Column) -> Column:
    """An absolute url of a link on a page; null for schemes without `://` and for relative links of a page that has none."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme, site = (F.regexp_extract(base, p, 1) for p in (r"^\s*([A-Za-z]+):", r"^\s*([A-Za-z]+://[^/?#]*)"))
    path = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    own = F.regexp_extract(base, r"(?s)^([^#]*)", 1)
    here = F.when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link)).when(F.startswith(link, F.lit("/")), F.concat(site, link))
    here = here.when(F.startswith(link, F.lit("?")), F.concat(site, path, link)).when((link == "") | F.startswith(link, F.lit("#")), own)
    here = here.otherwise(F.concat(site, F.regexp_extract(path, r"(?s)^(.*/)", 1), link))
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (site != ""), here)


def html_links(url: Column, html: Column) -> Column:
    """Array of what a page names as canonical and where it refreshes to, as absolute urls (null where a link has none)."""
    code = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<script\b.*?</script\s*>", "")
    tags = lambda name: F.regexp_extract_all(code, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))
    value = lambda tag, name: F.concat(*(F.regexp_extract(tag, rf"(?i)\s{name}{VALUE}", i) for i in (1, 2, 3)))
    canonical = F.filter(tags("link"), lambda x: value(x, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)") & x.rlike(rf"(?i)\shref{VALUE}"))
    refresh = F.filter(tags("meta"), lambda x: value(x, "http-equiv").rlike(r"(?i)^\s*refresh\s*$") & value(x, "content").rlike(r"(?i)[;,\s]\s*url\s*="))
    target = lambda x: F.regexp_extract(value(x, "content"), r"""(?i)[;,\s]\s*url\s*=\s*["']?([^"']*)""", 1)
    found = F.concat(F.transform(canonical, lambda x: resolved(url, value(x, "href"))), F.transform(refresh, lambda x: resolved(url, target(x))))
    return F.when(html.rlike("(?i)canonical|refresh"), found)


def edges_of(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b): addresses that stand for one resource. redirects: (from_url, to_url)."""
    links = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", html_links(F.col("url"), F.col("html")).alias("links"))
    both = links.select(F.col("url").alias("from_url"), F.explode("links").alias("to_url"))
    if redirects is not None:
        both = both.unionByName(redirects.select("from_url", "to_url"))
    return both.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a != b").distinct()


def salted_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of `right`, which has a key once, to `left`, which may have one key in a third of its rows: such a key's rows go to SALTS tasks."""
    dealt = left.withColumn("salt_", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    every = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return dealt.join(every, [key, "salt_"], "left").drop("salt_")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of `edges` (a, b) the smallest node that it is connected with."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = salted_join(labels, up, "component").select("node", "component", F.least("component", "top").alias("new"))
        near = salted_join(both, jumped.select(F.col("node").alias("b"), F.col("new").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        found = stored(jumped.join(near, "node").select("node", F.least("new", "theirs").alias("component"), (F.least("new", "theirs") != F.col("component")).alias("moved")))
        discard(labels)
        labels = found
        if found.where("moved").limit(1).count() == 0:
            discard(both)
            return found.drop("moved")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, aliases): `pages` (page_id, url, html) by `rules` (verdict, host, path). aliases: addresses of the page's
    component, itself included; 1 for a page without links."""
    edges = stored(edges_of(pages, redirects))
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    plain = judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), node_of(F.col("url")).alias("node"), F.col("own.verdict").alias("verdict"))
    out = ["page_id", "host", "path", "rule", "verdict", "aliases"]
    if not edges.limit(1).count():
        discard(edges)
        return plain.select(*out[:4], F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"), F.lit(1).cast("long").alias("aliases"))
    parts = stored(components(edges))
    discard(edges)
    ruled = parts.withColumn("own", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    marks = ruled.groupBy("component").agg(F.bool_or(F.coalesce(F.col("own.verdict") == BLOCK, F.lit(False))).alias("blocked"), F.count(F.lit(1)).alias("aliases"))
    known = stored(salted_join(parts, marks, "component").select("node", "blocked", F.col("aliases").alias("aliases")))
    discard(parts)
    # pages without an address would all meet in one task
    found = salted_join(plain.where("node is not null"), known, "node").unionByName(plain.where("node is null"), allowMissingColumns=True)
    verdict = F.coalesce("verdict", F.when(F.col("blocked"), BLOCK), F.lit(ALLOW))
    return found.select(*out[:4], verdict.alias("verdict"), F.coalesce("aliases", F.lit(1)).cast("long").alias("aliases"))
