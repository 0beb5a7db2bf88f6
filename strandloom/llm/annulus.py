"""Vector code compression: product codes whose nearest entry is found by annular norm pruning.

Components become integers, vectors are cut into equal consecutive parts, and every part position has a codebook that a few rounds of assignment and
averaging refine. All of it is integer arithmetic, so results don't depend on the partitioning.

*Annular search.* A part with norm r and an entry with norm s are at least |r - s| apart. Entries are sorted by norm; the few whose norms are closest to a part's
give a first distance; binary search finds the annulus of norms that this distance still allows, its ends included, and only entries in
it are evaluated, exactly. So ties are seen too and go to the lower index.

A round is one pass over the stored rows with the codebooks in its closure (4 * ENTRIES entries, whatever the table's size). Every task hands on sums by part
and entry, which are added up in a shuffle; the driver receives one row for each entry.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; integers beyond +-2^24 count as these; vectors of unlike lengths,
or of a length that the parts don't divide, are continued by zeros; an empty vector is all zeros; rows without vec_id come last in the order of
vec_ids and rows with one vec_id are ordered by vector; rows that repeat stay, one result row each; with fewer rows than entries the codebooks are that
much smaller; `label_error` is null where the sum leaves the range of a long; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

SCALE, MOST = 1024, 1 << 24
PARTS, ENTRIES, ROUNDS = 4, 256, 4
ROWS = 8192  # rows that are searched together
FIRST = 4  # entries on each side of a part's norm that give the first distance
HOT_LABELS = 1000


def integers(vectors: DataFrame, scale: int, most: int) -> DataFrame:
    """(vec_id, label, v array<int>): floors of the scaled components of the rows without null or non-finite ones."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    return vectors.where(fine).select("vec_id", "label", whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """(n, width) of a list column; shorter lists are continued by zeros."""
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width and (np.diff(ends) == width).all():
        return flat.reshape(len(column), width).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    out[row, np.arange(len(flat)) - ends[row]] = flat
    return out


def nearest_in_annulus(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row (the lower index of equally near ones) and the squared distance: x (n, w), book (k, w), integers."""
    of_x, of_book = (x * x).sum(1), (book * book).sum(1)
    order = np.lexsort((np.arange(len(book)), of_book))
    norms, r = np.sqrt(of_book[order].astype(float)), np.sqrt(of_x.astype(float))
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(book))

    def evaluate(rows, entry: np.ndarray | int) -> None:
        d = of_x[rows] + of_book[entry] - 2 * (x[rows] * book[entry]).sum(1)
        closer = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
        best[rows] = np.where(closer, d, best[rows])
        at[rows] = np.where(closer, entry, at[rows])

    every, middle = np.arange(len(x)), np.searchsorted(norms, r)
    for step in range(-FIRST, FIRST):
        evaluate(every, order[np.clip(middle + step, 0, len(book) - 1)])
    reach = np.sqrt(best.astype(float)) * (1 + 1e-12) + 1e-9 * (1 + r)  # rounding never shuts out an entry at the very edge
    low, high = np.searchsorted(norms, r - reach, "left"), np.searchsorted(norms, r + reach, "right")
    for i, entry in enumerate(order.tolist()):
        rows = np.flatnonzero((low <= i) & (i < high) & ((i < middle - FIRST) | (i >= middle + FIRST)))
        if len(rows):
            evaluate(rows, entry)
    return at, best


def assigned(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, parts) indexes and squared distances of vectors (n, parts * w) by books (parts, k, w)."""
    w = books.shape[2]
    found = [nearest_in_annulus(v[:, p * w : (p + 1) * w], book) for p, book in enumerate(books)]
    return np.stack([a for a, _ in found], 1), np.stack([d for _, d in found], 1)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after one round over `rows` (v): each entry the floored mean of its parts; unused entries stay."""
    parts, k, w = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * k, np.int64), np.zeros((parts * k, w), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                v = matrix(batch.column("v").slice(a, ROWS), parts * w)
                at, _ = assigned(v, books)
                for p in range(parts):
                    n += np.bincount(at[:, p] + p * k, minlength=parts * k)
                    np.add.at(total, at[:, p] + p * k, v[:, p * w : (p + 1) * w])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["entry", "n", "total"])

    added = rows.select("v").mapInArrow(sums, "entry int, n long, total array<long>").groupBy("entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[j]) for j in range(w))).alias("total"))
    out = books.reshape(-1, w).copy()
    for r in added.collect():  # at most parts * k rows
        out[r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return out.reshape(books.shape)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of `error` over rows with the same label. Labels with over a thousandth of the rows, so at most HOT_LABELS, are
    broadcast; the others are joined."""
    label, error = F.col("label").isNull().alias("no_label"), F.try_sum("error").alias("label_error")
    by = coded.groupBy("label", label).agg(F.count(F.lit(1)).alias("n"), error)
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    by = stored(by.crossJoin(F.broadcast(total)).withColumn("hot", F.col("n") * HOT_LABELS > F.col("total")))  # total: one row
    hot, cold = (by.where(c).select(F.col("label").alias("of"), "label_error") for c in ("hot", "not hot"))
    same = F.col("label").eqNullSafe(F.col("of"))
    common = coded.join(F.broadcast(hot), same).drop("of")  # at most HOT_LABELS rows
    rare = coded.join(F.broadcast(hot), same, "left_anti").join(cold, same).drop("of")
    return common.unionByName(rare)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of `vectors` (vec_id, embedding, label)."""
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    rows = stored(integers(vectors, scale, MOST))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # at most `entries` rows
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 1) // parts)
    books = np.zeros((parts, max(1, len(first)), width), np.int64)
    for i, r in enumerate(first):
        books[:, i] = np.pad(np.array(r["v"], np.int64), (0, parts * width - len(r["v"]))).reshape(parts, width)
    for _ in range(rounds if first else 0):
        books = refined(rows, books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                piece = batch.slice(a, ROWS)
                at, error = assigned(matrix(piece.column("v"), parts * width), books)
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), pa.array([c.tobytes().hex() for c in at.astype(np.uint8)]), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = stored(rows.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    discard(rows)
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
