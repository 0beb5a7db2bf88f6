"""Ranks, running sums and the n-th row of a whole table, without a window that puts all rows into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

DIGITS = 3  # hexadecimal digits of a hash that one histogram looks at
FEW = 4096  # rows that one task may rank


def ranked(rows: DataFrame, order: list, sums: dict[str, Column] | None = None, rank: str = "rank_") -> DataFrame:
    """`rows` with `rank` (from 1, in the given order, which should be total) and running sums up to and with each row. Two passes: rows are dealt by ranges of
    the order and written with their sums inside the range; the ranges' totals, a row each, then shift them."""
    sums = sums or {}
    dealt = rows.withColumns(sums).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    names = list(sums)
    kinds = dict(dealt.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * len(names)
        for batch in batches:
            own = []
            for i, c in enumerate(names):
                up = np.cumsum(batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)) + totals[i]
                totals[i] = up[-1] if len(up) else totals[i]
                own.append(pa.array(up, batch.schema.field(c).type))
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own, pa.array(np.arange(n + 1, n + 1 + batch.num_rows))], [*kept, *names, rank])
            n += batch.num_rows

    rest = [c for c in dealt.columns if c not in names]
    inside = stored(dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*rest, *names]) + f", {rank} long"))
    ends = inside.groupBy("part_").agg(F.max(rank).alias(rank), *(F.max_by(c, rank).alias(c) for c in names)).orderBy("part_").collect()  # a row for each range
    shifts, before = [], [0, *(0.0 if kinds[c] == "double" else 0 for c in names)]
    for r in ends:
        shifts.append((r["part_"], *before))
        before = [b + r[c] for b, c in zip(before, (rank, *names), strict=True)]
    shift = rows.sparkSession.createDataFrame(shifts, "part_ int, shift_rank_ long" + "".join(f", shift_{c} {kinds[c]}" for c in names))
    moved = inside.join(F.broadcast(shift), "part_")
    return moved.select(*(c for c in rest if c != "part_"), *((F.col(c) + F.col(f"shift_{c}")).alias(c) for c in names), (F.col(rank) + F.col("shift_rank_")).alias(rank))


def lowest(rows: DataFrame, key: Column, count: int, order: list) -> DataFrame:
    """The `count` rows with the lowest hexadecimal `key` (all, if there are fewer), ties by `order`. Histograms of the key's digits narrow down the place of the last one
    until few rows are left there; all before it are a filter, and nothing is gathered or sorted."""
    if count <= 0:
        return rows.limit(0)
    marked = stored(rows.withColumn("key_", key))
    prefix, left = "", count
    while True:
        here = marked.where(F.startswith("key_", F.lit(prefix)))
        digits = len(prefix) + DIGITS
        bins = sorted((r[0], r[1]) for r in here.groupBy(F.substring("key_", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 16 ** DIGITS rows
        last = None
        for p, n in bins:
            if n >= left:
                last = (p, n)
                break
            left -= n
        if last is None:
            return marked.drop("key_")
        prefix = last[0]
        if last[1] == left:
            return marked.where(F.substring("key_", 1, len(prefix)) <= prefix).drop("key_")
        if last[1] <= FEW or len(prefix) < digits:
            break
    among = ranked(marked.where(F.startswith("key_", F.lit(prefix))), ["key_", *order]).where(F.col("rank_") <= left).drop("rank_")
    return marked.where(F.substring("key_", 1, len(prefix)) < prefix).unionByName(among).drop("key_")


def percentiles_floor(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """(by, percentile): sorted[floor(p * (n - 1))] of each group's values, nulls left out. Ranks run over the whole table, so a group with most of the rows is
    spread like any other."""
    inside = ranked(rows.where(F.col(value).isNotNull()).select(*by, value), [*by, value])
    groups = inside.groupBy(*by).agg(F.min("rank_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    wanted = groups.select(*(F.col(c).alias(f"{c}_") for c in by), (F.col("first_") + F.floor(F.lit(p) * (F.col("n_") - 1)).cast("long")).alias("rank_"))
    return inside.join(wanted, "rank_").select(*by, F.col(value).alias("percentile"))
