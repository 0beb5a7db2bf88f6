"""Near-duplicate documents by an inverted join on the coordinates of MinHash signatures.

A document's set holds the hashes of its distinct word shingles; documents with equal sets form a class, and only classes are compared. Each class
posts its signature under every (coordinate, value). Two classes are candidates if `match` or more of `coordinates` collide; `match` lies
seven deviations below what the similarity threshold leads to expect, so a link is missed with a chance of about 1e-12.

*Prefix and skip.* Of two classes with `match` collisions, at least one collision is among the coordinates - match + 1 rarest postings of both, so only
those are merged; a posting that nobody shares counts as the rarest, and a class with fewer than `match` shared postings is skipped. The
long lists are not merged but looked up: the collisions of two classes that met are counted over all coordinates.

*What nobody shares.* A class that is linked at all has at most one shingle in some that no other class in the lists has. That drops documents
which only hold a passage in common, before any two of them are compared.

*Hubs and differences instead of pairs.* In each list every class is compared with the list's hub, the class whose postings are the most common ones.
Candidates are confirmed on the full sets. Lists that then hold several components go on: their classes are reduced to the shingles in which they
differ from the hub, and what two of them share follows from the sizes and from the differences that they share. Of two classes, one of
them not linked with the hub, about half of the other's differences must be shared, so classes meet under their rarest
differences only (`linked_by_differences`). No list, group or candidate is cut short.

Components come from repeated minimum labels with pointer jumping, all in tables.

Defined cases: null text is empty; a document without words has an empty set, is linked with nothing and is its own component; with fewer words than a
shingle, the whole sequence is the one shingle; rows with equal texts are in one class; null doc_id joins in but never names a component
unless nobody else is there; an empty table stays empty; extra columns are ignored (near_duplicates) or kept (drop_near_duplicates).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import RangeHash, fresh, mix, packed, slices, unpacked, utf8
from .shared import discard, release, stored

COORDINATES = 48
WORDS, THRESHOLD = 5, 0.8  # where a contract says nothing else
HUB_ROWS = 256  # members that meet one copy of a hub's text
SMALL_LIST = 512  # classes that are compared without a hub of their own
DEPTH = 3  # times that a list is dealt by differences before its classes are compared whatever its length

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def match_threshold(threshold: float, coordinates: int = COORDINATES) -> int:
    return max(1, math.floor(coordinates * threshold - 7 * math.sqrt(coordinates * threshold * (1 - threshold))))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order, and the n + 1 offsets of the documents among them. 52 bits of a hash count."""
    docs = len(offsets) - 1
    assert docs < 1 << 12
    n = len(data)
    ink = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = ink[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink & (~before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = ~ink[1:]
    ends = np.flatnonzero(ink & (after | edge[1:])) + 1
    hashes = RangeHash(LOWER[data]).of(starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(docs + 1))
    count = np.diff(first)
    m = len(hashes) - words + 1
    parts = []
    if m > 0:
        inside = np.flatnonzero(doc[:m] == doc[words - 1 :])
        h = np.zeros(len(inside), np.uint64)
        for i in range(words):
            h = mix(h ^ hashes[inside + i]) if i else hashes[inside]
        parts.append((doc[inside], h))
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        values = []
        for d in short:
            h = np.zeros(1, np.uint64)
            for i in range(first[d], first[d + 1]):
                h = mix(h ^ hashes[i : i + 1] + np.uint64(i - first[d] + 1))
            values.append(h)
        parts.append((short, np.concatenate(values)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    keys = np.sort((np.concatenate([d for d, _ in parts]).astype(np.uint64) << np.uint64(52)) | (np.concatenate([h for _, h in parts]) >> np.uint64(12)))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    at = np.searchsorted(keys, np.arange(docs + 1, dtype=np.uint64) << np.uint64(52))
    return keys & np.uint64((1 << 52) - 1), at


def small_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 20):
        for at in range(0, batch.num_rows, 4000):
            yield batch.slice(at, 4000)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small slices with texts as they are, packed or not."""
    for batch in batches:
        yield from small_slices(unpacked([batch]) if pa.types.is_binary(batch.column("text").type) else [batch])


def classes_of(hashes: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each document's set; None for an empty one."""
    full = np.flatnonzero(np.diff(at))
    one = np.add.reduceat(mix(hashes), at[full]) if len(full) else hashes
    two = np.add.reduceat(mix(hashes ^ np.uint64(0x5DEECE66D)), at[full]) if len(full) else hashes
    out: list[bytes | None] = [None] * (len(at) - 1)
    for d, a, b in zip(full.tolist(), mix(one), mix(two + np.diff(at)[full].astype(np.uint64)), strict=True):
        out[d] = a.tobytes() + b.tobytes()
    return out


def signatures(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """(doc_id, text_key, n, class, signature) of every document; class and signature are null for an empty set."""
    factor = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64)).reshape(2, -1) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            hashes, at = shingle_hashes(*utf8(batch.column("text")), words)
            full = np.flatnonzero(np.diff(at))
            out = np.empty((len(full), coordinates), np.uint32)
            for k in range(coordinates if len(full) else 0):
                out[:, k] = np.minimum.reduceat(((hashes * factor[0, k] + factor[1, k]) >> np.uint64(32)).astype(np.uint32), at[full])
            rows = np.zeros(batch.num_rows + 1, np.int32)
            rows[full + 1] = coordinates
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(rows), pa.int32()), pa.array(out.ravel().view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.diff(at)), pa.array(classes_of(hashes, at), pa.binary()), lists], ["doc_id", "text_key", "n", "class", "signature"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n long, class binary, signature array<int>")


def components(links: DataFrame) -> DataFrame:
    """(class, component): for every class in `links` (a, b), a stored table, the smallest class that it is connected with."""
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = stored(both.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("low")).select("class", F.least("class", "low").alias("component")))
    while True:
        jumped = labels.join(labels.select(F.col("class").alias("up"), F.col("component").alias("top")), F.col("component") == F.col("up"), "left").select("class", "component", F.least("component", F.coalesce("top", "component")).alias("new"))
        near = both.join(jumped.select(F.col("class").alias("b"), F.col("new").alias("theirs")), "b").groupBy(F.col("a").alias("class")).agg(F.min("theirs").alias("theirs"))
        found = stored(jumped.join(near, "class").select("class", F.least("new", "theirs").alias("component"), (F.least("new", "theirs") != F.col("component")).alias("moved")))
        discard(labels)
        labels = found
        if found.where("moved").limit(1).count() == 0:
            return found.drop("moved")


def similar(both, a_n, b_n, threshold: tuple[int, int]):
    """threshold[1] * intersection >= threshold[0] * union."""
    up, down = threshold
    return down * both >= up * (a_n + b_n - both)


def compatible(threshold: tuple[int, int]) -> F.Column:
    return similar(F.least("a_n", "b_n"), F.col("a_n"), F.col("b_n"), threshold)


COMPARED = "a binary, a_n long, b binary, b_n long, linked boolean, diff array<long>"


def compared(pairs: DataFrame, bodies: DataFrame, words: int, threshold: tuple[int, int], differences: bool) -> DataFrame:
    """The pairs (a, b) with the sizes of their sets: those that are linked, or all of them with the shingles that only one of them has. Texts of
    a meet a stream of texts of b; an a with many b is dealt out with some hundred of them each. No pair is there twice; the texts of `bodies` may be packed."""
    pairs = pairs.select("a", "b")
    counts = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / HUB_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    heads = counts.select(F.col("a").alias("class"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    rows = heads.unionByName(dealt.select(F.col("b").alias("class"), "a", "part", F.lit(True).alias("member"))).join(bodies.select("class", "text"), "class")
    schema = pa.schema([("a", pa.binary()), ("a_n", pa.int64()), ("b", pa.binary()), ("b_n", pa.int64()), ("linked", pa.bool_()), ("diff", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in opened(batches):
            hashes, at = shingle_hashes(*utf8(batch.column("text")), words)
            out = []
            for i, (name, own, part, member) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("class", "a", "part", "member")), strict=True)):
                mine = hashes[at[i] : at[i + 1]]
                if not member:
                    key, head = (own, part), mine
                    continue
                assert key == (own, part)
                both = len(np.intersect1d(head, mine, assume_unique=True))
                linked = similar(both, len(head), len(mine), threshold)
                if linked or differences:
                    out.append((own, len(head), name, len(mine), linked, np.setxor1d(head, mine, assume_unique=True).view(np.int64) if differences else None))
            yield pa.record_batch([pa.array([x[j] for x in out], kind) for j, kind in enumerate(schema.types)], schema=schema)

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "member").select("class", "a", "part", "member", "text").mapInArrow(run, COMPARED)


def shared_counts(bodies: DataFrame, words: int) -> DataFrame:
    """(class, n, common): how many of its n shingles another of these classes has as well. The texts of `bodies` may be packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in opened(batches):
            hashes, at = shingle_hashes(*utf8(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))), pa.array(hashes.view(np.int64))], ["name", "shingle"])

    name = F.xxhash64("class").alias("name")  # half as long, and this is the largest table that is dealt out
    posted = bodies.select(name, "text").mapInArrow(run, "name long, shingle long")
    # the number of classes and, if it is one, which: only those with a single class travel on
    alone = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("name").alias("name")).where("times = 1").groupBy("name").agg(F.count(F.lit(1)).alias("alone"))
    # classes of one name can't be told apart, so all their shingles count as common: that only keeps candidates
    single = bodies.select("class", "n", name).groupBy("name").agg(F.count(F.lit(1)).alias("classes"), F.collect_list(F.struct("class", "n")).alias("of"))
    counted = single.join(alone, "name", "left").select("classes", "alone", F.explode("of").alias("c"))
    return counted.select("c.class", "c.n", (F.col("c.n") - F.when(F.col("classes") == 1, F.coalesce("alone", F.lit(0))).otherwise(F.lit(0))).alias("common"))


def one_text(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, n, text) of `wanted` (class, n, text_key), each class once, with a text of `keyed` (text_key, text). Copies are dropped where the join has put them."""
    return keyed.join(wanted, "text_key").select("text_key", "class", "n", "text").dropDuplicates(["text_key", "class"]).drop("text_key")


def with_shared(sets: DataFrame, match: int) -> DataFrame:
    """(class, n, text_key) of the classes of `sets` that share `match` or more postings with others. Postings and classes travel with 8 bytes each."""
    name = F.xxhash64("class").alias("name")
    tokens = sets.select(name, F.posexplode("signature").alias("k", "value")).select("name", (F.col("value").cast("long") * 65536 + F.col("k")).alias("post"))
    common = tokens.groupBy("post").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("post")
    # classes of one name can't be told apart, so their postings are counted together: that only keeps more of them
    able = tokens.join(common, "post", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= match).select("name")
    return sets.select(name, "class", "n", "text_key").join(able, "name", "left_semi").drop("name")


def prefix_posts(sets: DataFrame, match: int) -> DataFrame:
    """(class, n, posts, weight): the rarest postings of every class (class, n, signature) that shares `match` or more, each (times, k, value)."""
    tokens = sets.select("class", "n", F.posexplode("signature").alias("k", "value"))
    common = tokens.groupBy("k", "value").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    posts = tokens.join(common, ["k", "value"]).groupBy("class").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("times", "k", "value"))).alias("posts"), F.sum("times").alias("weight"))
    # postings that nobody shares are the rarest, so they take up the prefix first
    return posts.where(F.size("posts") >= match).select("class", "n", "weight", F.slice("posts", 1, F.size("posts") - F.lit(match - 1)).alias("posts"))


def with_hubs(lists: DataFrame, key: list[str], rank: F.Column) -> DataFrame:
    """`lists` (key, class, n, ..) of more than one class, with the `hub` (class, n, ..) that `rank`, a struct, puts first."""
    hubs = lists.groupBy(*key).agg(F.max(rank).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return lists.join(hubs, key)


def still_open(lists: DataFrame, key: list[str]) -> DataFrame:
    """The lists whose classes are in several components."""
    return lists.join(lists.groupBy(*key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(*key), key)


def placed(classes: DataFrame, label: DataFrame) -> DataFrame:
    """`classes` with their `component`, so far their own `class` if they have no link."""
    return classes.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))


def sized(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """`members` (key, hub, hub_n, class, n, diff) with the numbers of shingles that a member `lacks` of the hub's, their `weight` with those that it
    has besides, and by how much that is `over` what a link with the hub allows."""
    up, down = threshold
    lacks = ((F.size("diff") + F.col("hub_n") - F.col("n")) / 2).cast("long")
    out = members.withColumn("lacks", lacks).withColumn("weight", down * F.col("lacks") + up * (F.size("diff") - F.col("lacks")))
    return out.withColumn("over", F.col("weight") - (down - up) * F.col("hub_n"))


def difference_lists(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(key, shingle, class, n, weight, over, short, rest, component): `members`, sized and placed, posted under those of their differences that a link of two
    of them, at least one of which is not linked with the hub, can't do without; only `short` posts count where neither is. `rest` is the number of
    differences from this one on, in the order of rarity."""
    whole = sum(threshold)
    posted = members.select("key", "class", F.explode("diff").alias("shingle"))
    common = posted.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = posted.join(common, ["key", "shingle"]).groupBy("key", "class").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("shared"))
    both = members.join(shared, ["key", "class"])
    # the rarest come first, so of two sets with m in common, one is among all but the last m - 1 of each
    alone = F.size("diff") - F.size("shared")
    short = F.size("diff") - F.floor(F.col("weight") / whole) - alone
    long = F.size("diff") + 1 - F.greatest(F.lit(1), F.ceil(F.col("over") / whole)) - alone
    both = both.withColumn("short", short.cast("int")).withColumn("many", F.when(F.col("over") > 0, F.greatest(long, short)).otherwise(short).cast("int"))
    each = both.where("many > 0").select("key", "class", "n", "weight", "over", "short", "component", F.size("shared").alias("of"), F.posexplode(F.slice("shared", 1, F.col("many"))).alias("i", "at"))
    lists = each.select("key", F.col("at.shingle").alias("shingle"), "class", "n", "weight", "over", (F.col("i") < F.col("short")).alias("short"), (F.col("of") - F.col("i")).alias("rest"), "component")
    # what follows must hold enough for a link with the lightest member
    lightest = lists.groupBy("key", "shingle").agg(F.min("weight").alias("lightest"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    return lists.join(lightest, ["key", "shingle"]).where(whole * F.col("rest") >= F.col("over") + F.col("lightest")).drop("lightest")


def met_by_differences(lists: DataFrame, members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): the links of classes in different components that meet in `lists`. The rarest difference that two classes share is followed, in both of
    their lists, by all others that they share."""

    def side(name: str) -> DataFrame:
        return lists.select("key", "shingle", F.col("class").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "weight", "over", "short", "rest", "component")))

    def difference(name: str) -> DataFrame:
        return members.select("key", F.col("class").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "lacks", "diff")))

    a_loose, b_loose = F.col("a_over") > 0, F.col("b_over") > 0
    counts = (a_loose | b_loose) & (~a_loose | ~b_loose | (F.col("a_short") & F.col("b_short")))
    enough = sum(threshold) * F.least("a_rest", "b_rest") >= F.col("a_over") + F.col("b_weight")
    apart = (F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component"))
    met = side("a").join(side("b"), ["key", "shingle"]).where(apart & counts & enough & compatible(threshold)).select("key", "a", "b").distinct()
    hubs = members.groupBy("key").agg(F.first("hub_n").alias("hub_n"))
    pairs = met.join(hubs, "key").join(difference("a"), ["key", "a"]).join(difference("b"), ["key", "b"])
    both = F.col("hub_n") - F.col("a_lacks") - F.col("b_lacks") + F.size(F.array_intersect("a_diff", "b_diff"))
    return pairs.where(similar(both, F.col("a_n"), F.col("b_n"), threshold)).select("a", "b")


def linked_by_differences(members: DataFrame, links: DataFrame, label: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """`links` (a, b) and those that join further components within the lists of `members` (key, hub, hub_n, class, n, diff), each of which has several.
    label: the components of `links`.

    Let a class lack d of the hub's shingles and have e besides; its weight is d + threshold * e, and it is linked with the hub where that is at most `allowed`,
    (1 - threshold) times the hub's size. Two classes with m differences in common share hub_n - d - d' + m shingles, so a link needs
    (1 + threshold) * m >= weight + weight' - allowed. Where one isn't linked with the hub, the other's weight alone must be exceeded. Long lists of
    classes that share a difference are dealt again, by their members' differences from a hub of their own."""
    depth = 0
    while True:
        depth += 1
        members = stored(sized(members, threshold))
        links = stored(links.unionByName(members.where("over <= 0").select(F.col("hub").alias("a"), F.col("class").alias("b"))))
        unsettled = members
        if depth > 1:  # before, the lists are open, and a label without the few links just added at worst leaves more to compare
            heads = members.select("key", F.col("hub").alias("class")).distinct()
            label = components(links)
            unsettled = members.join(still_open(placed(members.select("key", "class").unionByName(heads), label), ["key"]).select("key").distinct(), "key")
        before = stored(difference_lists(placed(unsettled, label), threshold))
        key = ["key", "shingle"]
        wanted = before.groupBy(*key).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("over").alias("over"), F.count(F.lit(1)).alias("size")).where("low < high and over > 0")
        lists = stored(before.join(wanted.select(*key, "size"), key))
        many = F.lit(depth < DEPTH) & (F.col("size") > SMALL_LIST)
        links = stored(links.unionByName(met_by_differences(lists.where(~many), members, threshold)))
        long = lists.where(many).select("key", "shingle", "class", "weight")
        discard(before)
        if not long.limit(1).count():
            discard(lists, members)
            return links
        long = with_hubs(long, key, F.struct(-F.col("weight"), "class")).select("key", "class", F.concat("key", F.unhex(F.lpad(F.hex("shingle"), 16, "0"))).alias("inner"), F.col("hub.class").alias("hub"))
        deeper = stored(long.join(members.select("key", "class", "n", "diff"), ["key", "class"]).select(F.col("inner").alias("key"), "hub", "class", "n", "diff"))
        heads = deeper.where("class = hub").select("key", F.col("n").alias("hub_n"), F.col("diff").alias("of_hub"))
        apart = F.array_union(F.array_except("diff", "of_hub"), F.array_except("of_hub", "diff"))
        discard(lists, members)
        members = deeper.where("class != hub").join(heads, "key").select("key", "hub", "hub_n", "class", "n", apart.alias("diff"))


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of every row of `docs` (doc_id, text); text_key is a hash of the text."""
    per_cent = (round(threshold * 100), 100)
    match, spark = match_threshold(threshold, coordinates), docs.sparkSession
    keyed = docs.select("doc_id", text_hash().alias("text_key"), "text")
    signed = stored(signatures(keyed, words, coordinates))
    row = F.xxhash64(F.col("doc_id").cast("long"), "text_key")  # one row's text stands for a class: by texts alone, all copies of one would meet in one task
    sets = signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("low_id"), F.min(row).alias("text_key"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    sets = stored(sets)
    release(spark)
    # written first, so that the postings are gone before texts travel. Texts are dealt by their keys at every size: those wanted grow with the input, and
    # fit every task only while it is small
    wanted = stored(with_shared(sets, match))
    release(spark)
    bodies = stored(one_text(packed(keyed.select(row.alias("text_key"), "text")).hint("merge"), wanted))
    discard(wanted)
    release(spark)
    able = shared_counts(bodies, words).where(per_cent[1] * F.col("common") >= per_cent[0] * F.col("n")).select("class")
    able = stored(sets.join(able, "class", "left_semi").select("class", "n", "signature"))
    release(spark)
    key = ["k", "value"]
    lists = prefix_posts(able, match).select("class", "n", "weight", F.explode("posts").alias("p")).select("class", "n", "weight", "p.k", "p.value")
    lists = stored(with_hubs(lists, key, F.struct("weight", "class", "n")).select(*key, "class", "n", "hub"))

    def with_hub(lists: DataFrame) -> DataFrame:
        return lists.where(F.col("class") != F.col("hub.class")).select(F.col("hub.class").alias("a"), F.col("hub.n").alias("a_n"), F.col("class").alias("b"), F.col("n").alias("b_n")).where(compatible(per_cent)).distinct()

    def collide(pairs: DataFrame) -> DataFrame:
        """Those of which `match` or more coordinates collide."""
        met = pairs.join(able.select(F.col("class").alias("a"), F.col("signature").alias("x")), "a").join(able.select(F.col("class").alias("b"), F.col("signature").alias("y")), "b")
        return met.where(F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda e: e)) >= match).select("a", "b")

    links = stored(compared(stored(collide(with_hub(lists))), bodies, words, per_cent, False).select("a", "b"))
    label = components(links)
    left = stored(still_open(placed(lists, label), key).where(F.col("class") != F.col("hub.class")).select(F.col("hub.class").alias("a"), F.col("class").alias("b")).distinct())
    if left.limit(1).count():
        members = compared(left, bodies, words, per_cent, True).select(F.col("a").alias("key"), F.col("a").alias("hub"), F.col("a_n").alias("hub_n"), F.col("b").alias("class"), F.col("b_n").alias("n"), "diff")
        label = components(linked_by_differences(members, links, label, per_cent))
    discard(bodies, able, lists)
    release(spark)
    names = sets.select("class", "low_id").join(label, "class", "left").select("class", F.coalesce("component", "class").alias("component"), "low_id")
    lowest = names.groupBy("component").agg(F.min("low_id").alias("component_id"))
    known = names.join(lowest, "component").select("class", "component_id")
    out = signed.select("doc_id", "text_key", "n", "class").join(known, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def text_hash() -> F.Column:
    return F.xxhash64(F.lit(5), F.coalesce("text", F.lit("")))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one document of each component, the one with its smallest doc_id."""
    kept = near_duplicates(docs, words, threshold).where("kept")
    kept_id, kept_text, key = fresh(docs, "kept_id", "kept_text", "text_key")
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_text)).distinct()
    keyed = docs.withColumn(key, text_hash())
    return keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_text)), "left_semi").drop(key)
