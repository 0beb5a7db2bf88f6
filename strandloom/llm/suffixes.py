"""Repeated byte strings removed with the help of suffix arrays, built by linear grouping.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else, in the same document or another one.

*Meeting places.* A window is a string of LENGTH bytes; it is owned by the smallest hash among its GRAM-byte grams (the first of equal ones), so
equal windows have equal owners at equal places. Each owner posts its hash and one hash of the bytes that its windows cover. Owners whose hash occurs
once own nothing that is repeated. Where all places of a hash have one cover, or several have the same, all their windows are repeated: that settles
the inside of every repeated run and all exact copies by counting.

*Suffix arrays.* What remains are the ends of runs, where one owner hash has several covers. One place of each cover sends its windows in
blocks of BLOCK neighbours: the bytes that all windows of a block share become a single symbol, between the few bytes left and right of it,
so a window is always BLOCK symbols long. Blocks with the same owner and core meet, many such groups make up a text, and in its suffix array a window is
repeated if it begins like its neighbour for BLOCK symbols. Groups with more than `MOST_BLOCKS` members are settled
window by window by counting instead, which is exact too and can be split among tasks.

The suffix array is built as the group construction does it: suffixes are grouped by their first symbol; groups are taken from the last to the first,
each member finds the closest earlier suffix of a lower group, and those move behind their group's other members, the more often found the
further, which sorts suffixes by their longest Lyndon prefix; then one pass emits each group's order along the same pointers. Nothing is
renamed and nothing recurses.

Defined cases: null is empty; texts shorter than LENGTH keep all; a repeated row repeats its strings; null doc_id is as good as any; an empty
table stays empty; extra columns are kept by drop_repeats (those that it computes replace the input's).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import RangeHash, fresh, mix, packed, slices, unpacked, utf8, widened
from .shared import discard, release, stored
from .winnow import owned_runs

LENGTH, GRAM, BLOCK = 200, 32, 16
MOST_BLOCKS = 20_000
TEXT_SYMBOLS = 200_000
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))
HALVES = {1 << i: mix(np.array([1000 + i], np.uint64))[0] | np.uint64(1) for i in range(5)}


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of integers, of which the last is smaller than all others."""
    n = len(text)
    symbols = np.array(text, np.int64)
    order = np.argsort(symbols, kind="stable")
    _, first, counts = np.unique(symbols[order], return_index=True, return_counts=True)
    # of a suffix; suffixes by place; where a suffix's group begins
    place, sizes, begins = np.empty(n, np.int64), np.zeros(n, np.int64), np.empty(n, np.int64)
    place[order], sizes[first], begins[order] = np.arange(n), counts, np.repeat(first, counts)
    place, members, group, size = place.tolist(), order.tolist(), begins.tolist(), sizes.tolist()
    before = [-1] * n
    end = n
    while end:
        start = group[members[end - 1]]
        if end - start == 1:  # most groups, at the end: one suffix, and one that moves
            s, end = members[start], start
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                g = group[p]
                m = size[g] - 1
                if m:
                    to, at = g + m, place[p]
                    other = members[to]
                    members[at], members[to], place[other], place[p] = other, p, at, to
                    group[p], size[g], size[to] = to, m, 1
            continue
        found: dict[int, int] = {}
        for s in sorted(members[start:end]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        if len(found) == 1:
            moves = [list(found)]
        else:
            by_times: dict[int, list[int]] = {}
            for p, times in found.items():
                by_times.setdefault(times, []).append(p)
            moves = [by_times[times] for times in sorted(by_times, reverse=True)]
        for chosen in moves:
            shift: dict[int, list[int]] = {}
            for p in chosen:
                shift.setdefault(group[p], []).append(p)
            for g, those in shift.items():
                whole, m = size[g], len(those)
                if m == whole:
                    continue
                to = g + whole
                for p in those:  # swap it to the end of its group
                    to -= 1
                    at, other = place[p], members[to]
                    members[at], members[to], place[other], place[p] = other, p, at, to
                for p in those:
                    group[p] = to
                size[g], size[to] = whole - m, m
        end = start
    out = [-1] * n
    free_at = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free_at[g]] = s
            free_at[g] += 1
            placed[s] = 1
            s = before[s]
    return out


def repeated_starts(text: list[int], length: int) -> np.ndarray:
    """Flags of the positions whose next `length` symbols also start elsewhere; the text ends with a symbol that occurs nowhere else in it."""
    flags = np.zeros(len(text), bool)
    order = np.array(suffix_array(text))
    order = order[order <= len(text) - length]
    if len(order) > 1:
        views = np.lib.stride_tricks.sliding_window_view(np.array(text), length)
        same = (views[order[1:]] == views[order[:-1]]).all(1)
        flags[order[1:][same]] = flags[order[:-1][same]] = True
    return flags


def row_key() -> F.Column:
    return F.xxhash64(F.lit(3), F.col("doc_id"), F.coalesce("text", F.lit("")))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes from each place, by halves of halves. They only choose owners: grams that collide make windows meet, not be equal."""
    out, step = SYMBOLS[data], 1
    while step < GRAM:
        out = out[:-step] * HALVES[step] + out[step:]
        step *= 2
    return mix(out)


def owners(docs: DataFrame, length: int) -> DataFrame:
    """(key, at, most, least, owner, cover): the owners of `docs` (key, text); their windows start at at - most .. at - least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            data, offsets = utf8(batch.column("text"))
            if len(data) < length:
                continue
            hashes = RangeHash(data)
            grams = gram_hashes(data)
            usable = np.zeros(len(data) - length + 1, bool)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                usable[a : max(a, b - length + 1)] = True
            at, first, last = owned_runs(grams, length - GRAM + 1, usable)
            doc = np.searchsorted(offsets, at, side="right") - 1
            cover = hashes.of(first, last + length)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), pa.array((at - offsets[doc]).astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array((at - last).astype(np.int32)), pa.array(grams[at].view(np.int64)), pa.array(cover.view(np.int64))], ["key", "at", "most", "least", "owner", "cover"])

    return docs.mapInArrow(run, "key long, at int, most int, least int, owner long, cover long")


BLOCKS = "key long, start int, owner long, number int, core long, skip int, left binary, right binary, several boolean"


def cut_blocks(asked: DataFrame, length: int) -> DataFrame:
    """Blocks of the windows of places (at, most, least, owner, several) in `asked` (key, packed text, places)."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("owner", pa.int64()), ("number", pa.int32()), ("core", pa.int64()), ("skip", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("several", pa.bool_())])
    inner = length - BLOCK + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(unpacked(batches)):
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("places")
            places = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at, most, least = (places.field(n).to_numpy().astype(np.int64) for n in ("at", "most", "least"))
            low, high = least // BLOCK, most // BLOCK
            counts = high - low + 1
            each = np.repeat(np.arange(len(at)), counts)
            number = np.arange(counts.sum()) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + low[each]
            base = offsets[doc[each]]
            core_at = base + at[each] - BLOCK * number
            core = RangeHash(data).of(core_at, core_at + inner).view(np.int64)
            # windows of the block start at core_at - far .. core_at - near
            far, near = np.minimum(most[each] - BLOCK * number, BLOCK - 1), np.maximum(least[each] - BLOCK * number, 0)
            raw = data.tobytes()
            left = [raw[a - f : a] for a, f in zip(core_at.tolist(), far.tolist(), strict=True)]
            right = [raw[a + inner : a + inner + r] for a, r in zip(core_at.tolist(), (BLOCK - 1 - near).tolist(), strict=True)]
            key = batch.column("key").take(pa.array(doc[each]))
            yield pa.record_batch([key, pa.array((core_at - far - base).astype(np.int32)), places.field("owner").take(pa.array(each)), pa.array(number.astype(np.int32)), pa.array(core), pa.array((BLOCK - 1 - far).astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary()), places.field("several").take(pa.array(each))], schema=schema)

    return asked.mapInArrow(run, BLOCKS)


GROUP = ("owner", "number", "core")


def settle_groups(blocks: DataFrame) -> DataFrame:
    """(key, start, last): runs of repeated windows, from suffix arrays over whole groups of blocks."""

    def solve(groups: list[list[tuple]]) -> pa.RecordBatch:
        text, keys, starts, spans = [], [], [], []
        for i, group in enumerate(groups):
            for key, start, left, right in group:
                keys.append(key)
                starts.append(start)
                spans.append((len(text), len(left) + len(right) + 2 - BLOCK))
                text += [b + 2 for b in left] + [258 + i] + [b + 2 for b in right] + [1]
        flags = repeated_starts([*text, 0], BLOCK)
        out: list[tuple] = []
        for key, start, (at, n) in zip(keys, starts, spans, strict=True):
            hits = np.flatnonzero(flags[at : at + n])
            if len(hits):
                cuts = np.flatnonzero(np.diff(hits) > 1)
                for a, b in zip(hits[np.append(0, cuts + 1)].tolist(), hits[np.append(cuts, len(hits) - 1)].tolist(), strict=True):
                    out.append((key, start + a, start + b))
        return pa.record_batch([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["key", "start", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size, key = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*GROUP, "key", "start", "left", "right")), strict=True):
                if row[:3] != key:
                    if groups and len(groups[-1]) == 1:  # nothing met it
                        size -= sum(map(len, groups.pop()[0][2:])) + 2
                    if size > TEXT_SYMBOLS:
                        yield solve(groups)
                        groups, size = [], 0
                    groups.append([])
                    key = row[:3]
                groups[-1].append(row[3:])
                size += len(row[5]) + len(row[6]) + 2
        if groups:
            yield solve(groups)

    dealt = blocks.select(*GROUP, "key", "start", "left", "right").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(run, "key long, start int, last int")


def count_windows(blocks: DataFrame) -> DataFrame:
    """The same for groups of any size: each window of a block by itself, with its place in the block."""
    each = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("left") + F.length("right") + 1 - BLOCK)))
    window = each.select(*GROUP, "key", (F.col("start") + F.col("i")).alias("start"), (F.col("skip") + F.col("i")).alias("place"), F.expr(f"concat(substring(left, i + 1), substring(right, 1, {BLOCK - 1} - (length(left) - i)))").alias("ends"))
    twice = window.groupBy(*GROUP, "place", "ends").count().where("count > 1").drop("count")
    return window.join(twice, [*GROUP, "place", "ends"]).select("key", "start", F.col("start").alias("last"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(key, runs) of the documents (key, text) with repeated windows; a run (start, last) is one of starts. Every step is stored and its tables and
    shuffle files go before the next but one, so the disk holds the largest step and not their sum."""
    spark = docs.sparkSession
    posted = owners(docs, length)
    common = stored(posted.groupBy("owner").agg(F.count(F.lit(1)).alias("times"), (F.min("cover") == F.max("cover")).alias("alike")).where("times > 1").drop("times"))
    release(spark)
    hits = stored(posted.join(common, "owner"))
    discard(common)
    release(spark)
    start, last = F.col("at") - F.col("most"), F.col("at") - F.col("least")
    inside = hits.where("alike").select("key", start.alias("start"), last.alias("last"))
    unlike = hits.where("not alike")
    covers = stored(unlike.groupBy("owner", "cover").agg(F.min(F.struct("key", "at", "most", "least")).alias("one"), (F.count(F.lit(1)) > 1).alias("several")))
    settled = stored(unlike.join(covers.where("several").select("owner", "cover"), ["owner", "cover"]).select("key", start.alias("start"), last.alias("last")))
    places = covers.select("one.key", F.struct("one.at", "one.most", "one.least", "owner", "several").alias("place")).groupBy("key").agg(F.collect_list("place").alias("places"))
    # rows that are alike in key and text are one place here; what they repeat is settled above
    asked = packed(docs).join(places, "key").dropDuplicates(["key"])
    blocks = stored(cut_blocks(asked.select("key", "text", "places"), length))
    discard(covers)
    release(spark)
    large = stored(blocks.groupBy(*GROUP).count().where(F.col("count") > most_blocks).select(*GROUP))
    if large.limit(1).count():
        ends = settle_groups(blocks.join(large, [*GROUP], "left_anti")).unionByName(count_windows(blocks.join(large, [*GROUP])))
    else:
        ends = settle_groups(blocks)
    ends = stored(ends)
    discard(blocks, large)
    release(spark)
    runs = inside.unionByName(settled).unionByName(ends)
    out = stored(runs.groupBy("key").agg(F.collect_set(F.struct("start", "last")).alias("runs")))
    discard(hits, settled, ends)
    release(spark)
    return out


def merged(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Disjoint byte ranges, in order, covered by windows that start in the given runs."""
    out: list[list[int]] = []
    for start, last in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([start, last + length])
    return [(a, b) for a, b in out]


def with_runs(docs: DataFrame, length: int, most_blocks: int) -> tuple[DataFrame, str]:
    """`docs` with packed texts and a further column, and its name, of repeated runs; null where nothing is repeated."""
    key, at_key, runs = fresh(docs, "key", "at_key", "runs")
    found = repeated_runs(docs.select(row_key().alias("key"), "text"), length, most_blocks).select(F.col("key").alias(at_key), F.col("runs").alias(runs))
    return packed(docs.withColumn(key, row_key())).join(found, F.col(key) == F.col(at_key), "left").drop(key, at_key), runs


def measure_repeats(docs: DataFrame, length: int = LENGTH, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of `docs` (doc_id, text)."""
    met, _ = with_runs(docs.select("doc_id", "text"), length, most_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(unpacked(batches)):
            data, offsets = utf8(batch.column("text"))
            rows = []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                spans = merged([(r["start"], r["last"]) for r in runs or ()], length)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a character that a span covers in part stays whole."""
    out, at = [], 0
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode()


def drop_repeats(docs: DataFrame, length: int = LENGTH, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """`docs` with repeated strings cut from `text`, on whole characters, and n_removed (bytes)."""
    docs = docs.drop("n_removed")
    names = docs.columns
    schema = widened(docs.schema, n_removed="long")
    met, at_runs = with_runs(docs, length, most_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(unpacked(batches)):
            data, offsets = utf8(batch.column("text"))
            new, gone = [], []
            for i, (runs, null) in enumerate(zip(batch.column(at_runs).to_pylist(), batch.column("text").is_null().to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                said = cut_text(text, merged([(r["start"], r["last"]) for r in runs or ()], length))
                new.append(None if null else said)
                gone.append(len(text) - len(said.encode()))
            columns = [pa.array(new, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], [*names, "n_removed"])

    return met.mapInArrow(run, schema)
