"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are laid out in chunks of `CHUNK` positions; every chunk also sees the first bytes of the next one, so chunks overlap and
each window of `WIDTH` bytes of the document is read exactly once. Bytes are embedded, filters slide over all windows, a rectifier and a
max-pool give each chunk one value per filter, and the mean and the maximum over a document's chunks go through a logistic layer.

Training uses documents with a label and no other input than the bytes, at most `MAX_TRAINING` of them, taken by the order of a hash of
doc_id; the network is the same whatever the order of rows. Scoring reads every whole text in one pass, without a shuffle.

Defined cases: a null or empty text is one chunk of padding and gets its score; without labelled rows every score is 0.5; with several labels
for a document each counts; repeated rows are scored each; null doc_id is scored but never trained on; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columnar import slices, utf8, widened

CHUNK, WIDTH, EMBED, FILTERS, PAD = 256, 6, 6, 16, 256
MAX_TRAINING = 3000
EPOCHS, BATCH, RATE, DECAY = 8, 32, 4e-3, 1e-4
LEAST_STEPS = 400


@dataclass
class Network:
    embed: np.ndarray  # (257, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    bias: np.ndarray  # (1,)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        f = np.float32
        return cls(rng.normal(0, 0.5, (257, EMBED)).astype(f), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f), np.zeros(FILTERS, f), np.zeros(2 * FILTERS, f), np.zeros(1, f))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.weights, self.bias]


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of CHUNK + WIDTH - 1 bytes, and the first chunk of every document (n + 1 values)."""
    first = first_chunks(offsets)
    return chunks_between(data, offsets, first, 0, int(first[-1])), first


TOGETHER = 2048  # chunks that are laid out at once, so a long text takes little besides itself


def first_chunks(offsets: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.maximum(1, -(-np.diff(offsets) // CHUNK)))))


def chunks_between(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, low: int, high: int) -> np.ndarray:
    """The chunks low to high of all."""
    number = np.arange(low, high)
    doc = np.searchsorted(first, number, side="right") - 1
    at = (offsets[doc] + (number - first[doc]) * CHUNK)[:, None] + np.arange(CHUNK + WIDTH - 1)
    inside = at < offsets[doc + 1][:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)].astype(np.int16), np.int16(PAD))


def windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    embedded = net.embed[chunks]  # (n, CHUNK + WIDTH - 1, EMBED)
    n, s = len(chunks), embedded.strides
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(embedded, (n, CHUNK, WIDTH * EMBED), (s[0], s[1], s[2]))).reshape(-1, WIDTH * EMBED)


def pooled(net: Network, chunks: np.ndarray) -> np.ndarray:
    """(n, FILTERS): the largest rectified response of each filter in each chunk."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for at in range(0, len(chunks), 64):  # stays in cache
        part = chunks[at : at + 64]
        out[at : at + 64] = (windows(net, part) @ net.filters).reshape(len(part), CHUNK, FILTERS).max(1)
    return np.maximum(out + net.shift, 0)


def features(pools: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.concatenate([np.add.reduceat(pools, first[:-1]) / np.diff(first)[:, None], np.maximum.reduceat(pools, first[:-1])], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0)
    first = first_chunks(offsets)
    pools = np.concatenate([pooled(net, chunks_between(data, offsets, first, a, min(a + TOGETHER, int(first[-1])))) for a in range(0, int(first[-1]), TOGETHER)])
    x = features(pools, first)
    return sigmoid(x.astype(np.float64) @ net.weights.astype(np.float64) + float(net.bias[0]))


def gradients(net: Network, chunks: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    w = windows(net, chunks)
    z = (w @ net.filters).reshape(len(chunks), CHUNK, FILTERS)
    best = z.argmax(1)
    pools = np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0] + net.shift, 0)
    x = features(pools, first)
    slope = ((sigmoid(x @ net.weights + net.bias[0]) - y) / len(y)).astype(np.float32)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(y)), counts)
    back = slope[:, None] * net.weights
    top = pools == x[doc, FILTERS:]
    ties = np.add.reduceat(top.astype(np.float32), first[:-1])
    to_pool = (back[:, :FILTERS] / counts[:, None])[doc] + top * (back[:, FILTERS:] / ties)[doc]
    to_pool *= pools > 0
    rows = (np.arange(len(chunks))[:, None] * CHUNK + best).ravel()  # one window for each chunk and filter
    seen = w[rows].reshape(len(chunks), FILTERS, -1)
    g_filters = np.einsum("cf,cfk->kf", to_pool, seen)
    g_window = (to_pool[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH, EMBED)
    bytes_ = chunks[np.arange(len(chunks))[:, None, None], best[:, :, None] + np.arange(WIDTH)].ravel()
    g_embed = np.stack([np.bincount(bytes_, g_window[:, :, e].ravel(), 257) for e in range(EMBED)], 1)
    return [g_embed.astype(np.float32), g_filters, to_pool.sum(0), x.T @ slope, slope.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss; rare and common labels weigh as they occur."""
    net = Network.fresh()
    if not texts:
        return net
    y = np.asarray(labels, np.float32)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    net.bias[:] = np.log(rate / (1 - rate))
    rng = np.random.default_rng(11)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    each = -(-len(texts) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // each))  # few texts are seen more often
    step, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            data = np.frombuffer(b"".join(texts[i] for i in chosen), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(texts[i]) for i in chosen])))
            chunks, first = layout(data, offsets)
            step += 1
            rate_now = RATE * 0.5 * (1 + np.cos(np.pi * step / total)) + 1e-5
            for p, g, (m, v) in zip(net.parts(), gradients(net, chunks, first, y[chosen]), moments, strict=True):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate_now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> tuple[list[bytes], np.ndarray]:
    """At most `bound` labelled texts, by a hash of doc_id: the labels are cut first, so what is broadcast and fetched is bounded."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("label_value")).orderBy(F.xxhash64("labelled_id"), "labelled_id", "label_value").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("labelled_id", "label_value", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.xxhash64("labelled_id"), "labelled_id", "label_value", "t").limit(bound).toArrow()
    return [x.encode() for x in rows.column("t").to_pylist()], np.array(rows.column("label_value").to_pylist(), np.float32)


def score_column(docs: DataFrame, scorer, **kinds: str) -> DataFrame:
    """`docs` with `score` and the columns `kinds`: scorer(bytes, offsets) gives them, in this order, for the texts of a batch. Columns of these names, however
    they are written, give way."""
    kinds = {"score": "double"} | kinds
    kept = docs.select(*(F.col(f"`{n}`") for n in docs.columns if n.lower() not in kinds))
    schema = widened(kept.schema, **kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            found = scorer(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(x if isinstance(x, pa.Array) else pa.array(x) for x in (found if isinstance(found, tuple) else (found,)))], [*batch.schema.names, *kinds])

    return kept.mapInArrow(run, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", bound: int = MAX_TRAINING, threshold: float = 0.5) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (0 or 1). `usable` says which rows of `labels` may be learned from."""
    net = train(*labelled_sample(docs, labels, label, usable, bound))
    scored = score_column(docs, lambda data, offsets: score(net, data, offsets))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
