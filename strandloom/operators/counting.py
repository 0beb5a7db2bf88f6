"""Counts over sequences and paths as vectors: a task adds one `bincount` a batch and hands on one row for each cell that it saw, so nothing becomes a row a
base and next to nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import topology as t

CODE = np.full(256, 4, np.int64)  # 4: not a base
for _i, _b in enumerate(b"ACGT"):
    CODE[_b] = _i


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an ASCII string column and its n + 1 offsets, from 0; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def place_in_row(offsets: np.ndarray) -> np.ndarray:
    """For each byte its position in its own row."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


BYTES = 1 << 20  # letters that are looked at together: Spark's batches hold up to 64 MB, and the vectors made of them take many times as much


def slices(batches: Iterator[pa.RecordBatch], limit: int = BYTES, sizes: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text, or of one row. sizes: a column with numbers of letters that count besides."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        if sizes:
            size += batch.column(sizes).to_numpy(zero_copy_only=False)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def counted(rows: DataFrame, cells: int, codes: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(code, cnt) of the codes below `cells` that `codes` gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in slices(batches):
            total += np.bincount(codes(batch), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["code", "cnt"])

    return rows.mapInArrow(run, "code int, cnt long").groupBy("code").agg(F.sum("cnt").alias("cnt"))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of `inside`, none of which goes on into another row."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    begin = inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1])))
    end = inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def edges_of(batch: pa.RecordBatch) -> np.ndarray:
    """from * 21 + to of every step along `states`, START before the first base and END behind the last one."""
    data, offsets = flat(batch.column("states"))
    state, full = data.astype(np.int64) - ord(t.letter(0)), offsets[:-1] < offsets[1:]
    prior = np.concatenate(([t.START], state[:-1])) if len(state) else state
    prior[offsets[:-1][full]] = t.START
    return np.concatenate((prior * 21 + state, state[offsets[1:][full] - 1] * 21 + t.END))


def contexts_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Base-4 codes of the `order` bases before each byte, and which of them are whole."""
    code, fine, ctx = CODE[data], place_in_row(offsets) >= order, np.zeros(len(data), np.int64)
    for i in range(1, order + 1):
        before = np.concatenate((np.full(min(i, len(code)), 4), code[:-i]))
        fine &= before < 4
        ctx += before * 4 ** (i - 1)
    return ctx, fine & (code < 4)


# which letter of which motif counts as its place
MOTIFS = {"donor": ((0, "GT"),), "acceptor": ((1, "AG"),), "splice": ((0, "GT"), (1, "AG")), "start": ((0, "ATG"),), "stop": ((2, "TAA"), (2, "TAG"), (2, "TGA"))}


def hits(data: np.ndarray, offsets: np.ndarray, motifs: tuple[tuple[int, str], ...]) -> np.ndarray:
    """Ascending places in `data` of the counting letters of all motifs that lie inside one row."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    hit = np.zeros(len(data), bool)
    for shift, motif in motifs:
        here = left >= len(motif)
        for i, letter in enumerate(motif.encode()):
            here[: len(data) - i] &= data[i:] == letter
        hit[np.flatnonzero(here) + shift] = True
    return np.flatnonzero(hit)


def motif_places(rows: DataFrame, kind: str) -> DataFrame:
    """`rows` (keys, sequence) with `places` (ascending positions) in place of `sequence`: of GT and ATG the first base, of AG and stop codons the last."""
    keys, motifs, kinds = [c for c in rows.columns if c != "sequence"], MOTIFS[kind], dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = flat(batch.column("sequence"))
            at = hits(data, offsets, motifs)
            within = at - np.repeat(offsets[:-1], np.diff(np.searchsorted(at, offsets)))
            ends = np.searchsorted(at, offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(within))], [*keys, "places"])

    return rows.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keys) + "places array<long>")


def confused(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, code, cnt): pred * 21 + gold of every base of two paths, in one row for each cell of each group of a task."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            (pred, a), (gold, b) = flat(batch.column("pred")), flat(batch.column("gold"))
            if (a != b).any():
                raise ValueError("paths differ in length")
            code = (pred.astype(np.int64) - 65) * 21 + gold - 65
            group, first = np.zeros(batch.num_rows, np.int64), [0]
            if by:
                coded = pa.StructArray.from_arrays([batch.column(c) for c in by], by).to_pylist()
                known: dict[tuple, int] = {}
                group = np.array([known.setdefault(tuple(r.values()), len(known)) for r in coded])
                first = np.unique(group, return_index=True)[1]
            cells = np.bincount(np.repeat(group, np.diff(a)) * 441 + code, minlength=441 * len(first))
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(np.asarray(first)[at // 441])) for c in by), pa.array(at % 441, pa.int32()), pa.array(cells[at])], [*by, "code", "cnt"])

    return rows.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in by) + "code int, cnt long").groupBy(*by, "code").agg(F.sum("cnt").alias("cnt"))
