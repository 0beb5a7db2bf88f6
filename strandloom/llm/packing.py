"""Packing token sequences into fixed windows by best-fit decreasing.

A window of W tokens starts open with W free places. Pieces are placed from the longest to the shortest, each in the open window
whose free space is the smallest that still holds it; a segment tree over the possible free sizes finds that window in log W steps.
Documents longer than a window are first cut into full windows, so only their remainders compete for places.

Packing needs no shuffle: every input partition packs its own documents, in shards that hold a bounded number of tokens. Windows that
stay clearly underfull at the end of a shard are emptied again and their tokens dealt out anew, into full windows and then into windows
that hold a power of two (which are kept at that length and not padded), so small partitions lose nothing either.

Defined cases: a null text is empty and still yields its end token; a null doc_id is carried through; repeated rows are packed each on its
own; an empty table yields no pieces; other columns of the input are ignored. Sequence ids are unique in one result, not across results.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columnar import slices, texts

WINDOW, END_ID = 4096, 2
SHARD_TOKENS = 6_000_000  # ids that a shard keeps in memory, 24 MB
MEMO_WORDS = 300_000  # words whose ids a task remembers
UNDERFULL = 15 / 16
PROBE = "The quick-brown FOX's 12 na\u00efve\t\u00dcber  (x)\n<br> don't 3.14 \u00c9t\u00e9 well-known_name e-mail@x.org #1 50% \u4e16\u754c"

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Encoder:
    """Ids of whole texts as little-endian uint32, by way of the ids of their blank-separated words.

    The tokenizer drops white space before it merges, so a text's ids are those of its words in a row. Its idea of white space and that of
    str.split differ in four control characters only; texts with one of these are encoded whole. Most words hold nothing but Latin letters,
    digits and ASCII signs: those are cut into the tokenizer's own units here and only merged by its model, many in one call. All
    other words go through the whole tokenizer. A tokenizer that gives other ids for PROBE this way has rules of its own: its texts are encoded whole.
    """

    odd = re.compile("[\x1c-\x1f]")
    plain = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")  # no apostrophe
    unit = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, end_id: int | None = END_ID, memo: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.memo = Tokenizer.from_file(path), memo, {}
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.alphabet[32] = " "  # between units
        self.by_words = bool(self.ends.any()) and self._agrees()

    def _agrees(self) -> bool:
        words = PROBE.split()
        self._learn(words)
        found, self.memo = b"".join(self.memo[w] for w in words), {}
        return found == self._whole([PROBE])[0]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        easy, rest = [], []
        for w in words:
            (easy if self.plain.fullmatch(w) and "<|" not in w else rest).append(w)
        self.memo.update(zip(rest, self._whole(rest), strict=True))
        if easy:
            units = [self.unit.findall(w.lower()) for w in easy]
            line = " ".join([" ".join(u) for u in units]).encode().decode("latin-1").translate(self.alphabet)
            ids = np.array(self.merger.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids])[np.cumsum([len(u) for u in units]) - 1] + 1
            raw, at = ids.tobytes(), 0
            for w, stop in zip(easy, (4 * stops).tolist(), strict=True):
                self.memo[w] = raw[at:stop]
                at = stop

    def __call__(self, batch: list[str]) -> list[bytes]:
        words = [text.split() if self.by_words and not self.odd.search(text) else None for text in batch]
        new = set().union(*(w for w in words if w is not None)).difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo = {}
            new = set().union(*(w for w in words if w is not None))
        if new:
            self._learn(list(new))
        find = self.memo.__getitem__
        return [(self._whole([text])[0] if w is None else b"".join(map(find, w))) + self.end for text, w in zip(batch, words, strict=True)]


class OpenWindows:
    """Open windows by free space. tree[i] says whether any leaf below node i has a window; leaf `size + c` stands for c free places."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, free: int, window: int) -> None:
        self.at[free].append(window)
        i, tree = self.size + free, self.tree
        while i and not tree[i]:
            tree[i] = 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out a window with the least free space that is `need` or more: (free, window)."""
        tree, i = self.tree, self.size + need
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up to a node whose right neighbour has a window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not tree[2 * i])
        free = i - self.size
        window = self.at[free].pop()
        if not self.at[free]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return free, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indexes of the pieces (each 1 to `window` long) in every window, in the order of their placement."""
    open_, windows = OpenWindows(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_.tightest(lengths[i])
        if found:
            free, w = found
        else:
            free, w = window, len(windows)
            windows.append([])
        windows[w].append(i)
        if free > lengths[i]:
            open_.add(free - lengths[i], w)
    return windows


def settle(pieces: list[tuple[int, int, int]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length). Underfull windows are dealt out anew as the module says."""
    done, loose = [], []
    for members in best_fit_decreasing([p[2] for p in pieces], window):
        used = sum(pieces[i][2] for i in members)
        if used >= UNDERFULL * window or not used & (used - 1):
            done.append([pieces[i] for i in members])
        else:
            loose += [pieces[i] for i in members]
    left = sum(p[2] for p in loose)
    loose.reverse()
    while left:
        room = window if left >= UNDERFULL * window else 1 << (left.bit_length() - 1)
        if left < window and left >= UNDERFULL * window:
            room = left
        room, filled = min(room, left), []
        left -= room
        while room:
            doc, start, length = loose.pop()
            take = min(room, length)
            filled.append((doc, start, take))
            if take < length:
                loose.append((doc, start + take, length - take))
            room -= take
        done.append(filled)
    return done


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): where its ids lie in the document and in which sequence, and the ids themselves
    (little-endian uint32)."""
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer_path, end_id)  # of this task: a reused worker keeps nothing
        sequence = TaskContext.get().partitionId() << 36  # a partition has fewer sequences than that

        def rows(windows: list, known: list) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[list] = [[] for _ in schema]
            size = 0
            for members in windows:
                offset = 0
                for d, start, length in members:
                    doc_id, ids = known[d]
                    size += 4 * length
                    for column, value in zip(out, (doc_id, start, length, len(ids) // 4, sequence, offset, ids[4 * start : 4 * (start + length)]), strict=True):
                        column.append(value)
                    offset += length
                sequence += 1
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out, size = [[] for _ in schema], 0
            if out[0]:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        known: list[tuple[int | None, bytes]] = []
        pieces: list[tuple[int, int, int]] = []
        held = 0
        for batch in slices(batches, limit=1 << 20):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch.column("text"))), strict=True):
                n = len(ids) // 4
                full = n - n % window if n > window else 0
                if full:
                    yield from rows([[(0, at, window)] for at in range(0, full, window)], [(doc_id, ids)])
                if n > full:
                    pieces.append((len(known), full, n - full))
                    known.append((doc_id, ids))
                    held += n
                if held > shard_tokens:
                    yield from rows(settle(pieces, window), known)
                    known, pieces, held = [], [], 0
        yield from rows(settle(pieces, window), known)

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)
