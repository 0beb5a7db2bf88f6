"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (`SAMPLE` rows in the order of a hash of vec_id); every row is indexed: its list is
that of the nearest centroid, its code quantises what is left. A query visits its `probes` nearest lists (more, if those hold too few rows),
ranks each list's codes by a table of distances from its own residual to all codewords, and takes the exact distance of the original vectors for
the best `rerank` of each bucket. With every code lies the length of what it leaves out, so a row's exact distance is at least the table's less that
length: every further row that this bound doesn't put behind the k-th exact distance is reranked too. Inside a bucket nothing is lost to the codes.

Lists are dealt out in buckets of bounded size, and so are the queries that visit them, so neither a hot list nor many queries for one gather
in a task; a bucket meets a block of queries by key. Only the lists' sizes (at most `MOST_LISTS` numbers) reach the driver.

Defined cases: vectors that are null, all zero, or that hold null or non-finite components take no part, neither do rows without vec_id; vectors of unlike
lengths are continued by zeros; rows that repeat, also with one vec_id, are rows of their own: each is a neighbour of the other, and each of them that is
a query gets its own result; ties in distance go to the smaller vec_id; a row is never its own neighbour; with fewer candidates than k all are
returned; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SAMPLE = 16_384
MOST_LISTS, ROWS_PER_LIST = 1024, 800
# share of the lists that a query visits: on vectors without clear clusters 0.3 finds 0.76 of the true ten, 0.5 finds 0.91, 0.7 finds 0.97
PROBE_SHARE, LEAST_PROBES = 0.7, 8
SUBSPACES, CODEWORDS = 16, 256
RERANK = 100
BUCKET_ROWS, QUERY_ROWS = 4096, 1024


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(n, centers) squared distances."""
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centers).argmin(1)
        counts = np.bincount(at, minlength=len(centers))
        sums = np.stack([np.bincount(at, x[:, d], len(centers)) for d in range(x.shape[1])], 1)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


@dataclass
class Index:
    centers: np.ndarray  # (lists, d)
    spans: list[tuple[int, int]]  # dimensions of each subspace
    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Index:
        centers = k_means(sample, lists, 10, 1)
        rest = sample - centers[nearest(sample, centers).argmin(1)]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return cls(centers, spans, [k_means(rest[:, a:b], CODEWORDS, 6, 2 + i) for i, (a, b) in enumerate(spans)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and length of the code's error of every row."""
        at = nearest(x, self.centers).argmin(1)
        rest = x - self.centers[at]
        codes = np.stack([nearest(rest[:, a:b], book).argmin(1) for (a, b), book in zip(self.spans, self.books, strict=True)], 1).astype(np.uint8)
        told = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return at, codes, np.sqrt(((rest - told) ** 2).sum(1))

    def table(self, query: np.ndarray, at: int) -> np.ndarray:
        """(subspaces, CODEWORDS) squared distances from the query's residual to the codewords."""
        rest = query - self.centers[at]
        out = np.full((len(self.spans), CODEWORDS), np.inf)
        for i, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            out[i, : len(book)] = ((book - rest[a:b]) ** 2).sum(1)
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v array<double>) of the rows that take part; `row` tells repeated ones apart once it is written."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v")).where(F.coalesce(finite, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 10, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row of `vectors` (vec_id, embedding) that `is_query` marks."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    whole = usable(vectors)
    d, n = whole.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not n:
        return none
    table = whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), d - F.size("v"))))
    sample = np.array([r["v"] for r in table.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()])
    index = Index.fit(sample, max(1, min(MOST_LISTS, n // ROWS_PER_LIST)))
    lists = len(index.centers)
    visits = probes or max(LEAST_PROBES, int(np.ceil(PROBE_SHARE * lists)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, codes, errors = index.encode(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.float64())], ["row", "vec_id", "v", "list", "code", "error"])

    indexed = stored(table.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(encode, "row long, vec_id long, v array<double>, list int, code binary, error double"))
    rows = dict.fromkeys(range(lists), 0) | {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}
    in_list = np.array([rows[i] for i in range(lists)])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = nearest(matrix(batch.column("v")), index.centers).argsort(1, kind="stable")
            enough = (np.cumsum(in_list[order], 1) > k).argmax(1) + 1  # lists until k others are sure; 1 if they never are
            enough = np.where(in_list.sum() > k, enough, lists)
            taken = np.maximum(enough, min(visits, lists))
            q = np.repeat(np.arange(batch.num_rows), taken)
            chosen = np.concatenate([order[i, :t] for i, t in enumerate(taken)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(q)) for c in ("row", "vec_id", "v")), pa.array(chosen, pa.int32())], ["query_row", "query_id", "q", "list"])

    visiting = indexed.where(is_query).select("row", "vec_id", "v").mapInArrow(visit, "query_row long, query_id long, q array<double>, list int")
    asked = {r["list"]: r["count"] for r in visiting.groupBy("list").count().collect()}
    plan = F.broadcast(spark.createDataFrame([(i, max(1, -(-rows[i] // BUCKET_ROWS)), max(1, -(-asked.get(i, 0) // QUERY_ROWS))) for i in range(lists) if i in asked and rows[i]], "list int, buckets int, blocks int"))

    def every(size: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(size) - 1))

    left = visiting.join(plan, "list").select("query_row", "query_id", "q", "list", F.pmod(F.xxhash64("query_row"), "blocks").cast("int").alias("block"), every("buckets").alias("bucket"))
    right = indexed.join(plan, "list").select("row", "vec_id", "v", "code", "error", "list", F.pmod(F.xxhash64("row"), "buckets").cast("int").alias("bucket"), every("blocks").alias("block"))

    def meet(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(there):
            there = there.sort_values("vec_id")
            ids, own, x = there["vec_id"].to_numpy(), there["row"].to_numpy(), np.stack(there["v"].to_numpy())
            codes = np.frombuffer(b"".join(there["code"]), np.uint8).reshape(len(ids), -1).T.astype(np.intp)
            errors, at, most = there["error"].to_numpy(), int(there["list"].iloc[0]), max(rerank, k)
            size = np.sqrt((x * x).sum(1)).max()
            for query, name, q in zip(asking["query_row"].to_numpy(), asking["query_id"].to_numpy(), asking["q"].to_numpy(), strict=True):
                table = index.table(q, at)
                far = sum(table[i][c] for i, c in enumerate(codes))
                near = np.arange(len(far))
                if len(far) > most + 1:
                    first = np.argpartition(far, most)[: most + 1]  # +1: the query itself
                    kth = np.partition(((x[first[own[first] != query]] - q) ** 2).sum(1), k - 1)[k - 1]
                    # what rounding may add is far below the slack
                    near = near[~(np.sqrt(far) - errors > np.sqrt(kth) + 1e-9 * (size + np.sqrt(q @ q)))]
                near = near[own[near] != query]
                exact = np.sqrt(((x[near] - q) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))[:k]
                out.append(pd.DataFrame({"query_row": query, "query_id": name, "vec_id": ids[near][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ("list", "bucket", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
