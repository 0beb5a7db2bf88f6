"""Genome-shaped relations derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.counting import MOTIFS, flat, hits, place_in_row, slices

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYCLE = "".join("ACGT"[i % 4] for i in range(26))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BASE = np.full(256, ord("A"), np.uint8)
for _known in (LOWER, UPPER):
    BASE[np.frombuffer(_known.encode(), np.uint8)] = np.frombuffer(CYCLE.encode(), np.uint8)


def bases(text: pa.Array) -> pa.Array:
    """One base for each character of UTF-8 texts, whose first byte alone tells it."""
    out = []
    for part in slices([pa.RecordBatch.from_arrays([text], ["text"])]):
        data, offsets = flat(part.column("text"))
        first = (data & 0xC0) != 0x80
        ends = offsets if first.all() else np.concatenate(([0], np.cumsum(first)))[offsets]
        found = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(BASE[data[first]]))
        valid = part.column("text").is_valid()
        out.append(pc.if_else(valid, found, pa.scalar(None, pa.string())) if part.column("text").null_count else found)
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def sequence_of(text: Column) -> Column:
    """One base for each character: letters by their place in the alphabet, anything else A. Spark's translate and regexp_replace look at a letter at a time; a table
    of bytes does the same several times as fast."""

    @F.arrow_udf("string")
    def to_bases(text: pa.Array) -> pa.Array:
        return bases(text)

    return to_bases(text)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most some 4 MB (or one row) from here on in this session. A batch is held several times over in every Python worker, of which each task has
    one for each step in Python; at the default of 64 MB these grow with the files until batches are full."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, scaffold, sequence, n): one base for each character of a document, and their number, which is known without the bases."""
    small_batches(spark)
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select(F.col("lang").alias("species"), F.col("doc_id").alias("scaffold"), sequence_of(F.col("text")).alias("sequence"), F.length("text").alias("n"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scaffold, parent, strand, start0, end0): an order is a transcript, its lines are CDS fragments (0-based, closed)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    ids = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1).first()[0]
    line = table(spark, sf_dir, "lineitem")
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    line = line.withColumn("rn", F.row_number().over(one)).where("rn = 1").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), (3 * F.col("l_quantity").cast("long") + F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)).alias("len"), (12 + F.col("l_suppkey") % 60).alias("gap"))
    by = Window.partitionBy("k")
    placed = line.withColumn("rel", F.coalesce(F.sum(F.col("len") + F.col("gap")).over(by.orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("span", F.sum(F.col("len") + F.col("gap")).over(by))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"))
    joined = placed.join(orders, "k").withColumn("doc_id", F.col("k") % ids).join(docs, "doc_id").where(F.col("n") > F.col("span") + 5)
    start = (F.col("k") * 37) % F.greatest(F.col("n") - F.col("span"), F.lit(1)) + F.col("rel")
    return joined.select(F.col("doc_id").alias("scaffold"), F.concat(F.lit("t"), F.col("k")).alias("parent"), "strand", start.alias("start0"), (start + F.col("len") - 1).alias("end0"))


def score(position, scaffold, factor: int):
    """A deterministic stand-in for a network's log-odds."""
    return ((position * factor + scaffold * 31) % 2001 - 1000).cast("double") / F.lit(250.0)


DONOR, ACCEPTOR, START = 7919, 104729, 15485863


def scores_of(sequence: Column, key: Column) -> Column:
    """Struct of donor, acceptor and start: arrays of struct<pos, score> with `score` at every motif of a sequence, found for many sequences at once."""
    kinds = {"donor": ((0, "GT"),), "acceptor": ((1, "AG"),), "start": ((0, "ATG"),)}
    factors = {"donor": DONOR, "acceptor": ACCEPTOR, "start": START}

    def found(part: pa.RecordBatch) -> pa.Array:
        (data, offsets), names, out = flat(part.column("sequence")), part.column("key").to_numpy(zero_copy_only=False).astype(np.int64), []
        for kind, motifs in kinds.items():
            at = hits(data, offsets, motifs)
            cuts = np.searchsorted(at, offsets)
            row = np.repeat(np.arange(part.num_rows), np.diff(cuts))
            pos = at - offsets[row]
            value = (np.fmod(pos * factors[kind] + names[row] * 31, 2001) - 1000) / 250.0
            both = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(value)], ["pos", "score"])
            out.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), both))
        return pa.StructArray.from_arrays(out, list(kinds))

    @F.arrow_udf("struct<" + ", ".join(f"{k}: array<struct<pos: int, score: double>>" for k in kinds) + ">")
    def scored(sequence: pa.Array, key: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([sequence, key], ["sequence", "key"])
        return pa.concat_arrays([found(part) for part in slices([whole])] or [found(whole)])

    return scored(sequence, key)


def base_scores(rows: DataFrame) -> DataFrame:
    """(scaffold, pos, donor, acceptor): a row for each base of `rows` (scaffold, sequence) with its `score` at a motif and 0 elsewhere, made for many bases at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, BASES):
            (data, offsets), names = flat(part.column("sequence")), part.column("scaffold")
            row, pos = np.repeat(np.arange(part.num_rows), np.diff(offsets)), place_in_row(offsets)
            unknown, key, found = names.is_null().to_numpy(zero_copy_only=False), pc.fill_null(names, 0).to_numpy().astype(np.int64), []
            for kind, factor in (("donor", DONOR), ("acceptor", ACCEPTOR)):
                at, value, missing = hits(data, offsets, MOTIFS[kind]), np.zeros(len(data)), np.zeros(len(data), bool)
                value[at], missing[at] = (np.fmod(pos[at] * factor + key[row[at]] * 31, 2001) - 1000) / 250.0, unknown[row[at]]
                found.append(pa.array(value, mask=missing))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(pos), *found], ["scaffold", "pos", "donor", "acceptor"])

    return rows.select("scaffold", "sequence").mapInArrow(run, f"scaffold {dict(rows.dtypes)['scaffold']}, pos long, donor double, acceptor double")


BASES = 1 << 16  # that become rows together


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
