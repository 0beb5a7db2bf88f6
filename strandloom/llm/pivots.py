"""Hard negatives by a pivot table.

A vector x gets one more component, sqrt(M^2 - |x|^2) for M the largest norm, an anchor q gets 0. Then |x' - q'|^2 = M^2 + |q|^2 - 2 x.q: the best inner product
is the smallest distance, and distances obey the triangle inequality. With every row lie its distances to `PIVOTS` pivots. For any pivot p, |d(q, p) -
d(x, p)| <= d(q, x) <= d(q, p) + d(x, p), so the table alone brackets every score; only rows whose bracket can still matter are checked, exactly.

Rows are dealt to cells, by their nearest pivot and in buckets of bounded size, so neither a hot label nor a group of copies gathers in a task; blocks of anchors
meet cells by key. First each anchor finds its positives, then, knowing the scores that negatives may have, it meets only cells whose own brackets
reach them. Pivots come from a bounded sample (`SAMPLE` rows in the order of a hash), which changes only how much is pruned; the driver receives
the sample, one row of totals and the cells' sizes and extremes (`PIVOTS` rows).

Defined cases: rows with null label, null vector, or null or non-finite components take no part; vectors of unlike lengths are continued by zeros; rows that
repeat are rows of their own, also with one vec_id, and each is another row to the other; rows without vec_id are never anchors, come after
others of the same score, and return as null; scores beyond the range of a long count as its ends; components that scaling takes out of the
range of a double count as +-1e300; an anchor without positives, or a positive without negatives, yields no rows; an empty table yields no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .annulus import matrix as padded
from .shared import discard, stored

SCALE = 256
PIVOTS, SAMPLE = 16, 2048
CELL_ROWS, ANCHOR_ROWS = 4096, 1024
SLACK = 1e-6  # of M^2 + |q|^2: far more than rounding adds to a bracket
LONG = np.iinfo(np.int64)
# fixed values: what share of its positive's score a negative has, in per cent
LEAST, MOST = 30, 90


def matrix(column, width: int) -> np.ndarray:
    """(n, width) doubles of a list column; shorter lists are continued by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width and not (column.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        return flat.reshape(len(column), width)
    return padded(column, width) if flat.dtype.kind == "i" else np.stack([np.pad(v.values.to_numpy(zero_copy_only=False), (0, width - len(v))) for v in column])


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows with q: int64, or Python's integers where doubles can't hold them."""
    if not len(x) or np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2**53:
        return (x @ q).astype(np.int64)
    whole = [int(b) for b in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x], object)


def in_range(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), LONG.min), LONG.max) for s in scores], np.int64)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that gives them all the norm sqrt(most); NaN where doubles can't hold that, and NaN rules nothing out."""
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], 1)


def choose_pivots(sample: np.ndarray, most: float, count: int = PIVOTS) -> np.ndarray:
    """Augmented rows far from each other: each next one is the farthest from those chosen."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _far_apart(augmented(sample, most), count)


def _far_apart(x: np.ndarray, count: int) -> np.ndarray:
    chosen = [0]
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(n, pivots), from differences and not from products, which would cancel."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def bracket(of_q: np.ndarray, low: np.ndarray, high: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score with q, given its distances to the pivots, of rows whose own lie between low and high; total is M^2 + |q|^2."""
    near = np.maximum(np.maximum(of_q - high, low - of_q), 0).max(1)
    far = (of_q + high).min(1)
    slack = SLACK * total
    return (total - far * far) / 2 - slack, (total - near * near) / 2 + slack


def prepared(vectors: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """(row, vec_id, label, v, norm, is_anchor) of the rows that take part; `row` tells repeated ones apart."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.lit(-1e300), x * float(SCALE)), F.lit(1e300)))
    # beyond 2**53 every double is whole
    floors = F.transform(whole, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    rows = vectors.where(fine & F.col("label").isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), floors.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))


def by_order(score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """The first `count` places: higher scores first, ties by smaller id."""
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:count], np.int64) if score.dtype == object else np.lexsort((ids, -score))[:count]


def ids_of(table: pa.Table) -> np.ndarray:
    """vec_ids for ordering; a missing one comes last."""
    return table.column("vec_id").fill_null(LONG.max).to_numpy()


class Meeting:
    """A block of anchors and a cell of rows, as matrices."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, width: int, most: float):
        self.anchors, self.rows, self.most = anchors, rows, most
        self.q, self.x = matrix(anchors.column("v"), width), matrix(rows.column("v"), width)
        self.of_q, self.of_x = (matrix(t.column("far"), len(t.column("far")[0])) for t in (anchors, rows))
        self.row, self.label, self.ids = rows.column("row").to_numpy(), rows.column("label").to_numpy(), ids_of(rows)

    def scored(self, i: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Brackets of the rows `mine` with anchor i."""
        return bracket(self.of_q[i], self.of_x[mine], self.of_x[mine], self.most + float(self.q[i] @ self.q[i]))


def positives_of(m: Meeting, count: int) -> pa.Table:
    """The first `count` rows of the same label of each anchor."""
    rows, labels = m.anchors.column("row").to_numpy(), m.anchors.column("label").to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for i, (row, label) in enumerate(zip(rows, labels, strict=True)):
        mine = np.flatnonzero((m.label == label) & (m.row != row))
        if len(mine) > count:
            low, high = m.scored(i, mine)
            mine = mine[~(high < np.partition(low, -count)[-count])]  # `count` rows are certain to score no less
        score = products(m.x[mine], m.q[i])
        best = by_order(score, m.ids[mine], count)
        out.append((np.full(len(best), row), m.row[mine[best]], mine[best], in_range(score[best])))
    at, positive, place, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"anchor_row": at, "positive_row": positive, "positive_id": m.rows.column("vec_id").combine_chunks().take(pa.array(place.astype(np.int64))), "positive_score": score.astype(np.int64)})


def negatives_of(m: Meeting, count: int) -> pa.Table:
    """The first `count` rows of other labels within the allowed share of each positive's score."""
    rows, labels = m.anchors.column("row").to_numpy(), m.anchors.column("label").to_numpy()
    wanted = m.anchors.column("positives").to_pylist()
    out: list[tuple[np.ndarray, ...]] = []
    for i, (row, label) in enumerate(zip(rows, labels, strict=True)):
        asked = [p for p in wanted[i] if p["score"] >= 0]  # 30 s <= 90 s
        mine = np.flatnonzero(m.label != label)
        if not asked or not len(mine):
            continue
        low, high = m.scored(i, mine)
        needed = np.zeros(len(mine), bool)
        for p in asked:
            least, most = LEAST * p["score"] / 100, MOST * p["score"] / 100
            sure = low[(low >= least) & (high <= most)]
            least = max(least, np.partition(sure, -count)[-count]) if len(sure) >= count else least
            needed |= ~((high < least) | (low > most))
        mine = mine[needed]
        score = products(m.x[mine], m.q[i])
        for p in asked:
            fits = np.flatnonzero((LEAST * p["score"] <= 100 * score) & (100 * score <= MOST * p["score"])) if score.dtype != object else np.array([j for j, s in enumerate(score) if LEAST * p["score"] <= 100 * s <= MOST * p["score"]], np.int64)
            best = fits[by_order(score[fits], m.ids[mine[fits]], count)]
            out.append((np.full(len(best), row), np.full(len(best), p["row"]), mine[best], in_range(score[best])))
    at, positive, place, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    return pa.table({"anchor_row": at.astype(np.int64), "positive_row": positive.astype(np.int64), "negative_id": m.rows.column("vec_id").combine_chunks().take(pa.array(place.astype(np.int64))), "negative_score": score.astype(np.int64)})


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `vectors` (vec_id, embedding, label). `label` is the label that counts,
    `is_anchor` marks the anchors."""
    spark = vectors.sparkSession
    rows = stored(prepared(vectors, label, is_anchor))
    total = rows.agg(F.max("norm").alias("most"), F.max(F.size("v")).alias("width"), F.count_if("is_anchor").alias("anchors")).first()
    if not total["anchors"]:
        discard(rows)
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    most, width, blocks = total["most"], max(1, total["width"]), -(-total["anchors"] // ANCHOR_ROWS)
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "row").limit(SAMPLE).select("v").collect()
    pivots = choose_pivots(np.stack([np.pad(np.array(r["v"], float), (0, width - len(r["v"]))) for r in sample]), most)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), width)
                with np.errstate(over="ignore", invalid="ignore"):
                    far = distances(augmented(x, most), pivots)
                    asked = distances(np.concatenate([x, np.zeros((len(x), 1))], 1), pivots)
                each = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, each(far), each(asked), pa.array(far.argmin(1), pa.int32())], [*batch.schema.names, "far", "asked", "home"])

    table = stored(rows.mapInArrow(measure, "row long, vec_id long, label long, v array<double>, is_anchor boolean, norm double, far array<double>, asked array<double>, home int"))
    discard(rows)
    ends = [f(F.col("far")[i]).alias(f"{n}{i}") for i in range(len(pivots)) for n, f in (("low", F.min), ("high", F.max))]
    cells = table.groupBy("home").agg(F.count(F.lit(1)).alias("n"), *ends).collect()  # a row for each pivot
    buckets = {r["home"]: -(-r["n"] // CELL_ROWS) for r in cells}
    low, high = (np.array([[r[f"{n}{i}"] for i in range(len(pivots))] for r in cells]) for n in ("low", "high"))
    of_home = F.create_map(*(F.lit(x) for pair in buckets.items() for x in pair))
    dealt = table.withColumn("bucket", F.pmod(F.xxhash64("row"), of_home[F.col("home")]).cast("int"))
    cell = dealt.select("row", "vec_id", "label", "v", "far", "home", "bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    anchors = table.where("is_anchor").select("row", "vec_id", "label", "v", F.col("asked").alias("far"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    key = ["home", "bucket", "block"]

    def visiting(asking: DataFrame, homes: Column) -> DataFrame:
        """Anchors once for every bucket of the cells that they visit."""
        to = asking.select("*", F.explode(homes).alias("home"))
        return to.select("*", F.explode(F.sequence(F.lit(0), of_home[F.col("home")] - 1)).alias("bucket"))

    def meet(work, count: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return empty
            return work(Meeting(left, right, width, most), count)

        empty = pa.table({"anchor_row": pa.array([], pa.int64()), "positive_row": pa.array([], pa.int64()), ("positive_id" if work is positives_of else "negative_id"): pa.array([], pa.int64()), ("positive_score" if work is positives_of else "negative_score"): pa.array([], pa.int64())})
        return run

    homes = F.array(*(F.lit(r["home"]) for r in cells))
    found = visiting(anchors, homes).groupBy(*key).cogroup(cell.groupBy(*key)).applyInArrow(meet(positives_of, positives), "anchor_row long, positive_row long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last(), "positive_row")
    chosen = stored(found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= positives).drop("i"))
    lists = chosen.groupBy("anchor_row").agg(F.collect_list(F.struct(F.col("positive_row").alias("row"), F.col("positive_score").alias("score"))).alias("positives"))  # at most `positives` each

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells whose brackets reach the scores that an anchor's negatives may have."""
        for batch in batches:
            if batch.num_rows:
                q, of_q, out = matrix(batch.column("v"), width), matrix(batch.column("far"), len(pivots)), []
                for i, asked in enumerate(batch.column("positives").to_pylist()):
                    least, best = bracket(of_q[i], low, high, most + float(q[i] @ q[i]))
                    scores = [p["score"] for p in asked if p["score"] >= 0]
                    out.append([cells[j]["home"] for j in range(len(cells)) if any(not (best[j] < LEAST * s / 100 or least[j] > MOST * s / 100) for s in scores)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "homes"])

    able = anchors.join(lists.withColumnRenamed("anchor_row", "row"), "row")
    able = able.mapInArrow(reach, "row long, vec_id long, label long, v array<double>, far array<double>, block int, positives array<struct<row:long,score:long>>, homes array<int>")
    hard = visiting(able, F.col("homes")).groupBy(*key).cogroup(cell.groupBy(*key)).applyInArrow(meet(negatives_of, negatives), "anchor_row long, positive_row long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    best = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = chosen.join(table.where("is_anchor").select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    return best.join(named, ["anchor_row", "positive_row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
