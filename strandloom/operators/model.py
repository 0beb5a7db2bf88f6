"""Counting and smoothing: transitions, Markov emissions and intron lengths, by grouped aggregation over interval strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import topology as t
from ..storage import stored
from .counting import CODE, contexts_of, counted, edges_of, flat
from .intervals import state_runs
from .prefix import ranked

FAMILIES = {"intergenic": (t.INTERGENIC,), "intron": tuple(t.INTRON), "exon_1": (t.EXON[0],), "exon_2": (t.EXON[1],), "exon_3": (t.EXON[2],)}


def bigram_counts(intervals: DataFrame) -> DataFrame:
    """(from_state, to_state, cnt) inside intervals, plus START to each first and each last state to END; never across intervals."""
    return _bigrams(counted(intervals.select("states"), 441, edges_of))


def _bigrams(cells: DataFrame) -> DataFrame:
    return cells.select(F.floor(F.col("code") / 21).cast("int").alias("from_state"), (F.col("code") % 21).alias("to_state"), "cnt")


def outgoing_counts(intervals: DataFrame) -> DataFrame:
    """(state, cnt): START once for each interval, every state once for each base."""
    return bigram_counts(intervals).groupBy(F.col("from_state").alias("state")).agg(F.sum("cnt").alias("cnt"))


def transition_log_probs(counts: DataFrame, alpha: float = 0.02) -> DataFrame:
    """(from_state, to_state, cnt, log_p) of the legal edges; others are impossible and have no row."""
    legal = F.broadcast(t.edges(counts.sparkSession))  # 32 rows
    c = legal.join(counts, ["from_state", "to_state"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))
    w = Window.partitionBy("from_state")
    total = F.sum("cnt").over(w) + alpha * F.count(F.lit(1)).over(w)
    p = (F.col("cnt") + alpha) / F.when(total > 0, total)
    return c.withColumn("log_p", F.when(p > 0, F.ln(p)).otherwise(F.lit(t.NEG_INF)))


def context_counts(sequences: DataFrame, order: int) -> DataFrame:
    """(ctx, base, cnt) of all bases of `sequence`, from the first position with a whole context."""

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = flat(batch.column("sequence"))
        ctx, fine = contexts_of(data, offsets, order)
        return (ctx * 4 + CODE[data])[fine]

    return _cells(counted(sequences.select("sequence"), 4 ** (order + 1), codes))


def _cells(cells: DataFrame) -> DataFrame:
    return cells.select(F.floor(F.col("code") / 4).cast("int").alias("ctx"), (F.col("code") % 4).alias("base"), "cnt")


def markov_counts(intervals: DataFrame, codes, order: int) -> DataFrame:
    """(ctx, base, cnt) of the bases in the given states, from the first position with a whole context."""
    wanted = np.isin(np.arange(256) - ord(t.letter(0)), list(codes))

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        (data, offsets), (states, _) = flat(batch.column("seq")), flat(batch.column("states"))
        ctx, fine = contexts_of(data, offsets, order)
        return (ctx * 4 + CODE[data])[fine & wanted[states]]

    return _cells(counted(intervals.select("seq", "states"), 4 ** (order + 1), cells))


def family_counts(intervals: DataFrame) -> DataFrame:
    """(family, ctx, base, cnt) for all five tables in one pass."""
    return _families(counted(intervals.select("seq", "states"), 4096 * len(FAMILIES), family_codes()))


def family_codes():
    """For a batch of intervals (seq, states) the code of every base that a family counts: family * 4096 + context * 4 + base."""
    names, of = list(FAMILIES), np.full(256, -1)
    for i, codes in enumerate(FAMILIES.values()):
        of[np.array(codes) + ord(t.letter(0))] = i
    deep = np.array([n.startswith("exon") for n in names])

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        (data, offsets), (states, _) = flat(batch.column("seq")), flat(batch.column("states"))
        family = of[states]
        (one, fine1), (five, fine5) = contexts_of(data, offsets, 1), contexts_of(data, offsets, 5)
        fine = (family >= 0) & np.where(deep[family], fine5, fine1)
        return (family * 4096 + np.where(deep[family], five, one) * 4 + CODE[data])[fine]

    return cells


def _families(found: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.floor(F.col("code") / 4096).cast("int") + 1)
    return found.select(name.alias("family"), F.floor(F.col("code") % 4096 / 4).cast("int").alias("ctx"), (F.col("code") % 4).alias("base"), "cnt")


def markov_log_probs(counts: DataFrame, order: int, alpha: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """Counts of all contexts, also unseen ones, with log_p = ln((c + a) / (row + 4a))."""
    by = by or []
    spark = counts.sparkSession
    grid = spark.range(4**order).select(F.col("id").cast("int").alias("ctx")).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("base")))  # 4**(order+1) rows
    if by:
        grid = counts.select(*by).distinct().crossJoin(F.broadcast(grid))
    c = grid.join(counts, [*by, "ctx", "base"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))
    total = F.sum("cnt").over(Window.partitionBy(*by, "ctx"))
    return c.withColumn("log_p", F.ln((F.col("cnt") + alpha) / (total + 4 * alpha)))


def emission_tables(intervals: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(family, ctx, base, cnt, log_p), with every family whether or not it occurs; the intervals are read once."""
    return emission_log_probs(family_counts(intervals), alpha)


def emission_log_probs(counts: DataFrame, alpha: float = 0.1) -> DataFrame:
    grid = uniform_tables(counts.sparkSession).select("family", "ctx", "base")  # 12,320 rows
    c = grid.join(counts, ["family", "ctx", "base"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))
    total = F.sum("cnt").over(Window.partitionBy("family", "ctx"))
    return c.withColumn("log_p", F.ln((F.col("cnt") + alpha) / (total + 4 * alpha)))


def uniform_tables(spark: SparkSession) -> DataFrame:
    """What an untrained model emits: ln(1/4) everywhere."""
    rows = spark.createDataFrame([(f, 1024 if f.startswith("exon") else 4) for f in FAMILIES], "family string, n int")
    ctx = rows.select("family", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ctx"))
    return ctx.select("family", "ctx", F.explode(F.array(*map(F.lit, range(4)))).alias("base"), F.lit(0).cast("long").alias("cnt"), F.ln(F.lit(0.25)).alias("log_p"))


def intron_lengths(intervals: DataFrame) -> DataFrame:
    """(length): one row for each maximal run of intron body."""
    runs = state_runs(F.col("states"), t.letters(t.INTRON))
    return intervals.select(F.explode(runs).alias("r")).select((F.col("r.end") - F.col("r.start")).cast("long").alias("length"))


def length_percentile(lengths: DataFrame, p: float) -> DataFrame:
    """One row: sorted[floor(p * (n - 1))], from counts by length so no list is gathered; empty gives the largest BIGINT."""
    counts = stored(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("c")))  # a row for each length, read three times
    total = counts.agg(F.sum("c").alias("n"))
    run = ranked(counts, ["length"], {"upto": F.col("c")})
    hit = run.crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)))
    return hit.agg(F.coalesce(F.min("length"), F.lit(2**63 - 1)).alias("percentile_length"))


def length_pmf(lengths: DataFrame, longest: int) -> DataFrame:
    """(length, log_p) for 0..longest: add-one counts, longer introns dropped, length 0 impossible."""
    spark = lengths.sparkSession
    counts = lengths.where(F.col("length").between(1, longest)).groupBy("length").agg(F.count(F.lit(1)).alias("c"))
    grid = spark.range(longest + 1).select(F.col("id").alias("length")).join(counts, "length", "left").withColumn("c", F.when(F.col("length") > 0, F.coalesce("c", F.lit(0)) + 1))
    total = grid.agg(F.sum("c").alias("total"))
    return grid.crossJoin(F.broadcast(total)).select("length", F.when(F.col("length") > 0, F.ln(F.col("c") / F.col("total"))).otherwise(F.lit(t.NEG_INF)).alias("log_p"))


def fit(intervals: DataFrame, transition_alpha: float = 0.02, emission_alpha: float = 0.1) -> dict[str, DataFrame]:
    """Transitions and emissions from one pass over the intervals; its counts, some 13,000 rows, are written once."""
    of_family, first = family_codes(), 441

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate((edges_of(batch), of_family(batch) + first))

    cells = stored(counted(intervals.select("seq", "states"), first + 4096 * len(FAMILIES), codes))
    families = cells.where(F.col("code") >= first).withColumn("code", F.col("code") - first)
    return {"transitions": transition_log_probs(_bigrams(cells.where(F.col("code") < first)), transition_alpha), "emissions": emission_log_probs(_families(families), emission_alpha)}


def finite(column: Column) -> Column:
    """Null for what JSON can't hold."""
    return F.when(F.abs(column) < float("inf"), column)
