"""Line deduplication by winnowing: runs of lines that an earlier place already holds are deleted.

A document is the sequence of its lines that hold more than white space. Every window of `min_lines` consecutive lines is owned by the line
with the smallest hash in it; these window minima are the fingerprints, and equal windows are owned by equal fingerprints, so comparing
the places of one fingerprint finds every repeated run of `min_lines` or more. Each fingerprint is posted once, with a hash of all the lines
that the windows it owns cover. Places with the same cover match in all their windows at once; only where a fingerprint has different covers are the
windows compared one by one, which extends the match to both sides as far as it goes. Overlapping matches make up the maximal runs.
The first place, in the order of doc_id and line, is kept; the lines of later ones are deleted.

With `long_words` each line of at least so many words is a window of its own as well, and so, with `short_texts`, are all the lines of a
document that has fewer than `min_lines`; both meet their first place as the fingerprints do.

Nothing is paired: places meet their first occurrence by aggregation, so a line that a third of all documents hold costs one row of
each partition. Texts are shuffled once, to meet their deletions.

Defined cases: a null or empty text has no lines and is kept as it is; lines are compared byte for byte, blank ones never count and stay; rows of the
same doc_id and text are one document and not each other's copies; null doc_id comes last in the order; an empty table stays empty; extra
columns are kept (a clash with the columns `n_lines`, `n_removed` drops the input's).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import RangeHash, fresh, mix, reduced, slices, texts, times, utf8, widened
from .shared import stored
from .winnow import owned_runs

MIN_LINES = 2
LONG_WORDS = 50

# windows of their own never share a fingerprint with others
LONG, SHORT = 0xA24BAED4963EE407, 0x9FB21C651E98DF25

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
POSTS = "doc_id long, text_key long, owner long, first long, last long, fingerprint long, cover long, windows array<long>"


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every line that isn't blank, in order."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([offsets, breaks + 1]))
    start, end = bounds[:-1], bounds[1:]
    doc = np.searchsorted(offsets, start, side="right") - 1
    ink = np.concatenate(([0], np.cumsum(~BLANK[data]))) if n else np.zeros(1, np.int64)
    keep = ink[end] > ink[start]
    start, end, doc = start[keep], end[keep], doc[keep]
    end = end - (data[end - 1] == 10) if len(end) else end
    return doc, start, end


def word_counts(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of runs of bytes that aren't blank in each line."""
    ink = ~BLANK[data]
    begins = ink & np.append(True, ~ink[:-1])
    first = offsets[offsets < len(data)]
    begins[first] = ink[first]
    before = np.concatenate(([0], np.cumsum(begins)))
    return before[end] - before[start]


def post_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None, short_texts: bool = False) -> DataFrame:
    """The fingerprints of `docs` (doc_id, text_key, text) with what they cover. A window of its own has `last` so that it ends at last + min_lines."""
    schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "text_key", "owner", "first", "last", "fingerprint", "cover")), ("windows", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            doc, start, end = line_spans(data, offsets)
            if not len(doc):
                continue
            of_bytes = RangeHash(data)
            lines = of_bytes.of(start, end)
            first_line = np.searchsorted(doc, np.arange(len(offsets)))  # a document's first line here
            # hashes of runs of lines, from a prefix sum over the lines' hashes as over bytes
            prefix = LineHash(lines)

            def rows(owner, first, last, fingerprint, cover, counts, windows):
                base = first_line[doc[owner]]
                of = pa.array(doc[owner])
                return pa.record_batch([batch.column("doc_id").take(of), batch.column("text_key").take(of), pa.array(owner - base), pa.array(first - base), pa.array(last - base), pa.array(fingerprint.view(np.int64)), pa.array(cover.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(windows, pa.int64()))], schema=schema)

            def alone(first, end_line, salt):
                """Windows of their own: the second hash is of the latter half of the bytes, with their number."""
                lo, hi = start[first], end[end_line - 1]
                cover = mix(of_bytes.of((lo + hi) // 2, hi) + (hi - lo).astype(np.uint64))
                return rows(first, first, end_line - min_lines, mix(prefix.of(first, end_line) ^ np.uint64(salt)), cover, np.zeros(len(first), np.int64), np.zeros(0, np.int64))

            if long_words is not None:
                at = np.flatnonzero(word_counts(data, offsets, start, end) >= long_words)
                if len(at):
                    yield alone(at, at + 1, LONG)
            if short_texts:
                size = np.diff(first_line)
                few = np.flatnonzero((size > 0) & (size < min_lines))
                if len(few):
                    yield alone(first_line[few], first_line[few] + size[few], SHORT)
            if len(doc) < min_lines:
                continue
            usable = doc[min_lines - 1 :] == doc[: len(doc) - min_lines + 1]
            owner, first, last = owned_runs(lines, min_lines, usable)
            if not len(owner):
                continue
            cover = prefix.of(first, last + min_lines)
            counts = last - first + 1
            each = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            yield rows(owner, first, last, lines[owner], cover, counts, prefix.of(each, each + min_lines).view(np.int64))

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, POSTS)


class LineHash(RangeHash):
    """Hashes of ranges of a sequence of 64-bit hashes."""

    def __init__(self, values: np.ndarray):
        values = mix(values) >> np.uint64(3)
        self._add(len(values), lambda a, b, power: times(power, reduced(values[a:b])))


def later_lines(posts: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text_key, start, end): ranges of lines of which an earlier place holds a copy."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "owner")
    covers = posts.groupBy("fingerprint", "cover").agg(F.min(F.struct(place.alias("place"), "first", "last", "windows")).alias("kept"), F.count(F.lit(1)).alias("copies"))
    covers = stored(covers)
    repeated = covers.where("copies > 1").select("fingerprint", "cover", F.col("kept.place").alias("kept_place"))
    whole = posts.drop("windows").join(repeated, ["fingerprint", "cover"]).where(place != F.col("kept_place")).select("doc_id", "text_key", F.col("first").alias("start"), (F.col("last") + min_lines).alias("end"))
    # fingerprints with different covers: window by window, among the first places of the covers
    mixed = covers.groupBy("fingerprint").agg(F.min("cover").alias("low"), F.max("cover").alias("high")).where("low < high").select("fingerprint")
    single = covers.join(mixed, "fingerprint", "left_semi").select("fingerprint", "kept.place", "kept.first", F.posexplode("kept.windows").alias("i", "window")).select("window", F.struct("place.no_id", "place.doc_id", "place.text_key", (F.col("first") + F.col("i")).alias("line")).alias("at"))
    firsts = single.groupBy("window").agg(F.min("at").alias("kept_at"), F.count(F.lit(1)).alias("places")).where("places > 1").drop("places")
    parts = single.join(firsts, "window").where("at != kept_at").select("at.doc_id", "at.text_key", F.col("at.line").alias("start"), (F.col("at.line") + min_lines).alias("end"))
    return whole.unionByName(parts)


def delete_lines(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the given ranges of its lines that aren't blank: (text, such lines, deleted ones)."""
    gone = {i for start, end in ranges for i in range(start, end)}
    kept, n = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            n += 1
            if n - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept), n, len(gone)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None, short_texts: bool = False) -> DataFrame:
    """`docs` with later copies of runs of lines deleted from `text`, and n_lines and n_removed (lines that aren't blank)."""
    docs = docs.drop("n_lines", "n_removed")
    text_key, at_doc, at_text, at_ranges = fresh(docs, "text_key", "at_doc", "at_text", "ranges")
    keyed = docs.withColumn(text_key, F.xxhash64(F.lit(6), F.coalesce("text", F.lit(""))))
    posts = stored(post_lines(keyed.select("doc_id", F.col(text_key).alias("text_key"), "text"), min_lines, long_words, short_texts))
    ranges = later_lines(posts, min_lines).groupBy(F.col("doc_id").alias(at_doc), F.col("text_key").alias(at_text)).agg(F.collect_set(F.struct("start", "end")).alias(at_ranges))
    met = keyed.join(ranges, F.col("doc_id").eqNullSafe(F.col(at_doc)) & (F.col(text_key) == F.col(at_text)), "left").drop(at_doc, at_text, text_key)
    names = docs.columns
    schema = widened(docs.schema, n_lines="long", n_removed="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said = batch.column("text")
            found = [delete_lines(t, [(r["start"], r["end"]) for r in ranges or ()]) for t, ranges in zip(texts(said), batch.column(at_ranges).to_pylist(), strict=True)]
            new = pa.array([None if null else t for (t, _, _), null in zip(found, said.is_null().to_pylist(), strict=True)], said.type)
            columns = [new if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], [*names, "n_lines", "n_removed"])

    return met.mapInArrow(run, schema)
