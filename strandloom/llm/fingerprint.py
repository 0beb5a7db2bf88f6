"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its blank-separated words, each with its number of occurrences. For every coordinate k a word draws r and c from
Gamma(2, 1) and b from (0, 1), all by hashing (word, k), so every text sees the same draws. With weight w it takes the step
t = floor(ln w / r + b), the point y = exp(r (t - b)) and the rank a = c / (y exp(r)); the word of the lowest rank and its step are the
sample. Two texts agree in a coordinate with probability sum(min(w, v)) / sum(max(w, v)), the generalised Jaccard similarity, so
the share of equal coordinates estimates it. A fingerprint holds 16 bits of each sample, as 4 hexadecimal digits.

Defined cases: null is empty; a text without words has a fingerprint of zeros, which is like another of its kind (1.0) and unlike any
other (0.0); equal texts have equal fingerprints; other columns are kept out of the way of the new ones or dropped as each function says.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import mix, slices, texts, widened

COORDINATES = 128
BLOCK = 4096  # words ranked at once

_x = np.linspace(0, 40, 400_001)
# what Gamma(2, 1) draws for 12 bits
QUANTILE = np.interp((np.arange(4096) + 0.5) / 4096, 1 - (1 + _x) * np.exp(-_x), _x).astype(np.float32)


class Sampler:
    def __init__(self, coordinates: int = COORDINATES):
        self.k = coordinates
        self.salt = mix(np.arange(1, coordinates + 1, dtype=np.uint64))
        self.every = np.arange(coordinates)

    def draw(self, items: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """ln a and the code of the sample, for each (word, weight) and coordinate."""
        h = np.array([xxhash.xxh64_intdigest(w) for w, _ in items], np.uint64)[:, None]
        log_w = np.log(np.array([n for _, n in items], np.float32))[:, None]
        bits = mix(h ^ self.salt)

        def uniform(shift: int, size: int) -> np.ndarray:
            low = (bits >> np.uint64(shift)).astype(np.uint32) & np.uint32((1 << size) - 1)
            return (low.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-size)

        r = QUANTILE[(bits & np.uint64(4095)).astype(np.intp)]
        b = uniform(12, 12)
        log_c = np.log(-np.log(uniform(24, 20) * uniform(44, 20)))
        t = np.floor(log_w / r + b)
        code = ((h & np.uint64(0xFFFF)).astype(np.int64) + t.astype(np.int64) * 40503) & 0xFFFF
        return log_c - r * (t - b + 1), np.maximum(code, 1).astype(np.uint16)

    def signatures(self, batch: list[str]) -> np.ndarray:
        """(n, coordinates) codes; zeros for a text without words. The draws of a (word, weight) are made once for the batch."""
        place: dict[tuple[str, int], int] = {}
        at = [np.array([place.setdefault(x, len(place)) for x in Counter(text.split()).items()], np.intp) for text in batch]
        items = list(place)
        rank, code = np.empty((len(items), self.k), np.float32), np.empty((len(items), self.k), np.uint16)
        for i in range(0, len(items), BLOCK):
            rank[i : i + BLOCK], code[i : i + BLOCK] = self.draw(items[i : i + BLOCK])
        out = np.zeros((len(batch), self.k), np.uint16)
        for i, rows in enumerate(at):
            if len(rows):
                low = rank.take(rows, 0).argmin(0)
                out[i] = code[rows[low], self.every]
        return out


def written(signatures: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signatures]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of two arrays of signatures."""
    return (a == b).mean(1)


def fingerprint_documents(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """`docs` with a string column `fingerprint`; any earlier column of that name is replaced. No shuffle."""
    kept = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            found = written(Sampler(coordinates).signatures(texts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "fingerprint"])

    return kept.mapInArrow(run, widened(kept.schema, fingerprint="string"))


def with_following(docs: DataFrame, partitions: int) -> DataFrame:
    """(copy, doc_id, text) in descending order of doc_id over numbered partitions: each ends with the first row of the next one that has
    rows (copy true), the last one with the first row of all. Ties are in the order of their texts, null ids come last.

    Texts are shuffled once. The driver sees a few values for each partition: the bounds of its ids and the largest id.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / partitions for i in range(1, partitions)], 0.1 / partitions) if partitions > 1 else []
    bounds = sorted({int(x) for x in marks}, reverse=True)
    number = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0))
    dealt = docs.withColumn("number", number)
    firsts = dealt.select("doc_id", "number").groupBy("number").agg(F.max("doc_id").alias("first")).orderBy("number").collect()
    if not firsts:
        return docs.select(F.lit(False).alias("copy"), "doc_id", "text")
    before = {firsts[i]["first"]: firsts[i - 1]["number"] for i in range(len(firsts))}
    to = F.lit(None).cast("int")
    plain = {k: v for k, v in before.items() if k is not None}
    if plain:
        to = F.element_at(F.create_map(*(F.lit(x) for kv in plain.items() for x in kv)), F.col("doc_id"))
    if None in before:
        to = F.when(F.col("doc_id").isNull(), F.lit(before[None])).otherwise(to)
    places = F.filter(F.array(F.struct(F.lit(False).alias("copy"), F.col("number").alias("place")), F.struct(F.lit(True).alias("copy"), to.alias("place"))), lambda x: x["place"].isNotNull())
    spread = dealt.select("doc_id", "text", F.explode(places).alias("p")).select("p.copy", "doc_id", "text", "p.place")
    return spread.repartitionById(len(bounds) + 2, F.col("place")).sortWithinPartitions("copy", F.col("doc_id").desc_nulls_last(), "text").select("copy", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_following(docs: DataFrame, partitions: int, coordinates: int = COORDINATES) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it finds itself and its edited text and the next document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler(coordinates)
        held: tuple[list, list[str]] | None = None  # the last row, which still waits for its next one
        for batch in slices(batches, limit=1 << 20):
            copies = batch.column("copy").to_pylist()
            if True in copies:  # one row is enough
                batch = batch.slice(0, copies.index(True) + 1)
            ids, said = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
            if held is not None:
                ids, said = held[0] + ids, held[1] + said
            changed = [edited(a, b) for a, b in zip(said, said[1:], strict=False)]
            found = sample.signatures(said + changed)
            own, other = found[: len(said)], found[len(said) :]
            held = ids[-1:], said[-1:]
            if changed:
                columns = [ids[:-1], [len(x) for x in said[:-1]], [hashlib.sha256(x.encode()).hexdigest() for x in changed], written(own[:-1]), written(other), likeness(own[:-1], other), likeness(own[:-1], own[1:])]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            if True in copies:
                return

    return with_following(docs, partitions).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
