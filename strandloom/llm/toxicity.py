"""Toxicity by multiple-instance learning: only documents have labels, sentences are what is scored.

A sentence's logit is a bias plus the weights of its words and their stems; its probability p says that it offends. A document is toxic if any of its
sentences is: 1 - prod(1 - p), the noisy-or. The weights are trained from document labels through that product, with a penalty that
leaves most words at zero, and the trained sentence scores then locate the sentences that made a document toxic.

Sentences end at ``.``, ``!``, ``?`` and line ends; words are runs of letters and digits (every byte beyond ASCII counts as a letter), with A-Z
lower-cased, hashed to `BUCKETS` weights. Training takes at most `MAX_TRAINING` labelled documents, in the order of a hash of doc_id; scoring
reads every whole text in one pass, without a shuffle.

Defined cases: a null or empty text is one empty sentence and gets the score of the bias; without labelled rows every score is 0.5; several
labels of a document count each; repeated rows are scored each; null doc_id is scored but never trained on; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cnn import labelled_sample, score_column, sigmoid
from .columnar import M1, RangeHash, mix, slices, utf8

BUCKETS_LOG2 = 20
MAX_TRAINING = 8000
TRAINING_SLICE = 250
STEM = 4  # bytes of a longer word that count as a feature of their own, so unseen endings don't hide a known stem
LEAST_DOCS = 3  # a word seen in fewer training documents has no weight
STEPS, RATE, PENALTY = 150, 0.15, 5e-5
PART = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[97:123] = LETTER[128:] = True
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True


@dataclass
class Words:
    """Words of a batch of documents: bucket, sentence; sentences: document, byte range."""

    bucket: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def read(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = LOWER[data]
    n = len(data)
    letter = LETTER[data]
    before = np.zeros(n, bool)
    before[1:] = letter[:-1]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False  # a word doesn't reach into the next document
    starts = np.flatnonzero(letter & ~before)
    gap = np.ones(n + 1, bool)
    gap[:n] = ~letter
    gap[offsets] = True
    stops = np.flatnonzero(gap)
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    cut = np.zeros(n + 1, bool)
    cut[1:] = ENDS[data]
    # every document begins a sentence, even where it has no bytes
    inner = np.flatnonzero(cut)
    owner = np.searchsorted(offsets, inner, side="right") - 1
    inner = inner[inner > offsets[np.clip(owner, 0, len(offsets) - 1)]] if len(inner) else inner
    begin = np.sort(np.concatenate([offsets[:-1], inner]), kind="stable")
    doc_of = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, inner, side="right") - 1])
    order = np.argsort(np.concatenate([offsets[:-1], inner]), kind="stable")
    doc_of = doc_of[order]
    order = np.lexsort((begin, doc_of))
    begin, doc_of = begin[order], doc_of[order]
    last = np.append(doc_of[1:] != doc_of[:-1], True) if len(doc_of) else np.zeros(0, bool)
    end = np.where(last, offsets[doc_of + 1], np.append(begin[1:], n)) if len(doc_of) else begin
    hashes, shift = RangeHash(data), np.uint64(64 - BUCKETS_LOG2)
    longer = np.flatnonzero(ends - starts > STEM)
    stems = mix(hashes.of(starts[longer], starts[longer] + STEM) + M1)  # a stem isn't the word of the same letters
    bucket = (np.concatenate([hashes.of(starts, ends), stems]) >> shift).astype(np.int64)
    starts = np.concatenate([starts, starts[longer]])
    word_doc = np.searchsorted(offsets, starts, side="right") - 1
    # the sentence of a word: the last one that begins at or before it, among those that aren't empty
    real = np.flatnonzero(end > begin)
    sentence = real[np.searchsorted(begin[real], starts, side="right") - 1] if len(starts) else np.zeros(0, np.int64)
    assert not len(starts) or (doc_of[sentence] == word_doc).all()
    return Words(bucket, sentence, doc_of, begin, end)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, words: Words) -> np.ndarray:
        return self.bias + np.bincount(words.sentence, self.weights[words.bucket], len(words.doc))

    def documents(self, words: Words, n: int) -> np.ndarray:
        return -np.expm1(-np.bincount(words.doc, np.logaddexp(0, self.logits(words)), n))

    def judged(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores of documents, and start, length and score of the worst sentence of each. A text of over PART bytes is read in parts that end with a
        sentence, as long as it has ends, so it takes little besides itself."""
        n = len(offsets) - 1
        total, worst = np.zeros(n), (np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1.0))
        for base, piece, ends in parts_of(data, offsets):
            words = read(piece, ends)
            z = self.logits(words)
            total += np.bincount(words.doc, np.logaddexp(0, z), n)
            p = sigmoid(z)
            order = np.lexsort((words.start, -p, words.doc))
            top = order[np.unique(words.doc[order], return_index=True)[1]]
            top = top[p[top] > worst[2][words.doc[top]]]
            doc = words.doc[top]
            worst[0][doc], worst[1][doc], worst[2][doc] = base + words.start[top] - ends[doc], words.end[top] - words.start[top], p[top]
        return -np.expm1(-total), *worst


def parts_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets): a batch as it is, but one long text in parts behind sentence ends."""
    if len(offsets) != 2 or len(data) <= PART:
        yield 0, data, offsets
        return
    at = 0
    while at < len(data):
        to = min(at + PART, len(data))
        while to < len(data) and not ENDS[data[to - 1]]:
            ends = np.flatnonzero(ENDS[data[to : to + PART]])
            to = to + int(ends[0]) + 1 if len(ends) else min(to + PART, len(data))
        yield at, data[at:to], np.array([0, to - at])
        at = to


def train(texts: list[bytes], labels: np.ndarray) -> Model:
    model = Model(np.zeros(1 << BUCKETS_LOG2), float(np.log(2**1 - 1)))
    if not texts:
        return model
    y = np.asarray(labels, np.float64)
    n = len(y)
    size = 1 << BUCKETS_LOG2
    parts, sentence_doc, begun = [], [], 0
    seen, hits = np.zeros(size, np.int64), np.zeros(size)
    for first in range(0, n, TRAINING_SLICE):  # what is kept of a slice is a few numbers a word
        some = texts[first : first + TRAINING_SLICE]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in some]))).astype(np.int64)
        words = read(np.frombuffer(b"".join(some), np.uint8), offsets)
        parts.append((words.bucket.astype(np.int32), (words.sentence + begun).astype(np.int32)))
        sentence_doc.append((words.doc + first).astype(np.int32))
        pairs = np.unique(words.doc[words.sentence] * (1 << BUCKETS_LOG2) + words.bucket)  # a word once for each document
        seen += np.bincount(pairs & (size - 1), minlength=size)
        hits += np.bincount(pairs & (size - 1), y[first + (pairs >> BUCKETS_LOG2)], size)
        begun += len(words.doc)
    buckets, sentences, owner = np.concatenate([b for b, _ in parts]), np.concatenate([s for _, s in parts]), np.concatenate(sentence_doc)
    parts.clear()
    known = np.flatnonzero(seen >= LEAST_DOCS)
    place = np.full(size, -1)
    place[known] = np.arange(len(known))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    # start from how much likelier a word makes the label, less two deviations of chance
    hits, docs_with = hits[known], seen[known]
    low = np.maximum(0, (hits - 2 * np.sqrt(docs_with * rate * (1 - rate))) / docs_with)
    w = np.log(np.clip(low, rate, 0.99) / rate)
    at = place[buckets].astype(np.int32)
    sentence = sentences[at >= 0]
    at = at[at >= 0]
    del buckets, sentences
    per_doc = len(owner) / n
    params = np.append(w, np.log(rate / per_doc))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        z = params[-1] + np.bincount(sentence, params[at], len(owner))
        total = np.bincount(owner, np.logaddexp(0, z), n)
        slope = ((1 - y) - y / np.maximum(np.expm1(np.minimum(total, 50)), 0.02)) / n
        by_sentence = slope[owner] * sigmoid(z)
        g = np.append(np.bincount(at, by_sentence[sentence], len(known)), by_sentence.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        pace = RATE * 0.5 * (1 + np.cos(np.pi * step / STEPS))
        scale = pace / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        params -= scale * m / (1 - 0.9**step)
        params[:-1] = np.sign(params[:-1]) * np.maximum(0, np.abs(params[:-1]) - scale[:-1] * PENALTY)
    model.weights[known] = params[:-1]
    model.bias = float(params[-1])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", bound: int = MAX_TRAINING, threshold: float = 0.3) -> DataFrame:
    """`docs` with score (0 to 1), predicted (0 or 1) and the worst sentence, the first of equally bad ones: worst_start and worst_length in bytes of UTF-8 and
    worst_score. `usable` says which rows of `labels` may be learned from."""
    model = train(*labelled_sample(docs, labels, label, usable, bound))

    scored = score_column(docs, model.judged, worst_start="long", worst_length="long", worst_score="double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def locate_sentences(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """Sentences of `docs` with a probability of `least` or more: doc_id, start and length in bytes of UTF-8, sentence, probability."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("sentence", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            words = read(data, offsets)
            p = sigmoid(model.logits(words))
            hits = np.flatnonzero(p >= least)
            d = words.doc[hits]
            said = [bytes(data[a:b]).decode() for a, b in zip(words.start[hits], words.end[hits], strict=True)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(d)), pa.array(words.start[hits] - offsets[d]), pa.array(words.end[hits] - words.start[hits]), pa.array(said, pa.string()), pa.array(p[hits])], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, sentence string, probability double")
