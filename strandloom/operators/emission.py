"""Emission scores: as columns for one state and as a matrix of all states for the decoders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import topology as t
from ..functions.sequence import IS_ACCEPTOR, IS_DONOR, IS_START, IS_STOP

QUARTER, HALF = float(np.log(0.25)), float(np.log(0.5))


@dataclass
class Model:
    """Dense tables of a fitted model: small (3 * 1024 * 4 numbers), so it travels with the decoder's closure."""

    trans: np.ndarray = field(default_factory=lambda: np.full((21, 21), t.NEG_INF))
    intergenic: np.ndarray = field(default_factory=lambda: np.full((4, 4), QUARTER))
    intron: np.ndarray = field(default_factory=lambda: np.full((4, 4), QUARTER))
    exon: np.ndarray = field(default_factory=lambda: np.full((3, 1024, 4), QUARTER))
    donor_scale: float = 1.0
    donor_bias: float = 0.0
    acceptor_scale: float = 1.0
    acceptor_bias: float = 0.0
    start_scale: float = 1.0
    start_bias: float = 0.0

    @classmethod
    def collect(cls, tables: dict[str, DataFrame], **calibration: float) -> Model:
        """From fitted tables; the driver receives 32 edges and some 12,000 emissions, whatever the data."""
        out = cls(**calibration)
        for r in tables["transitions"].collect():
            out.trans[r["from_state"], r["to_state"]] = r["log_p"]
        for r in tables["emissions"].collect():
            f = r["family"]
            (out.exon[int(f[-1]) - 1] if f.startswith("exon") else getattr(out, f))[r["ctx"], r["base"]] = r["log_p"]
        return out


CODES = np.full(256, 0, np.int64)
for _i, _b in enumerate(b"ACGT"):
    CODES[_b] = _i


def matrix(model: Model, sequence: str, donor=None, acceptor=None, start=None) -> np.ndarray:
    """(T, 21) emission log scores. donor, acceptor, start: {position: score} or (positions, scores), of which the last counts for a position; None means
    that no scores were loaded, which is an error as soon as a motif asks for one; a position without score counts 0."""
    x = CODES[np.frombuffer(sequence.encode(), np.uint8)]
    n = len(x)
    out = np.full((n, 21), t.NEG_INF)
    out[:, [t.START, t.END]] = 0.0
    if not n:
        return out
    out[0, [t.INTERGENIC, *t.INTRON]] = QUARTER
    out[1:, t.INTERGENIC] = model.intergenic[x[:-1], x[1:]]
    out[1:, list(t.INTRON)] = model.intron[x[:-1], x[1:]][:, None]
    out[:5, list(t.EXON)] = QUARTER
    if n > 5:
        ctx = sum(x[i : n - 5 + i] * 4 ** (4 - i) for i in range(5))
        out[5:, list(t.EXON)] = model.exon[:, ctx, x[5:]].T
    pair = x[:-1] * 4 + x[1:]

    def scores(found, at: np.ndarray, what: str) -> np.ndarray:
        if found is None:
            if len(at):
                raise ValueError(f"no {what} scores were loaded")
            return np.zeros(0)
        places, values = (np.array(list(found), np.int64), np.array(list(found.values()), float)) if isinstance(found, dict) else found
        dense, inside = np.zeros(n), (places >= 0) & (places < n)
        dense[places[inside]] = values[inside]
        return dense[at]

    at = np.flatnonzero(pair == 11)  # GT
    out[at[:, None], list(t.DONOR)] = (model.donor_scale * scores(donor, at, "splice") + model.donor_bias)[:, None]
    at = np.flatnonzero(pair == 2) + 1  # AG
    out[at[:, None], list(t.ACCEPTOR)] = (model.acceptor_scale * scores(acceptor, at, "splice") + model.acceptor_bias)[:, None]
    if n > 2:
        three = x[:-2] * 16 + x[1:-1] * 4 + x[2:]
        at = np.flatnonzero(three == 14)  # ATG
        out[at, t.START_CODON[0]] = model.start_scale * scores(start, at, "start") + model.start_bias
        out[np.flatnonzero(np.isin(three, (48, 50, 56))) + 2, t.STOP_CODON[2]] = 0.0  # TAA, TAG, TGA
    out[x == 3, t.START_CODON[1]] = 0.0
    out[x == 2, t.START_CODON[2]] = 0.0
    out[x == 3, t.STOP_CODON[0]] = 0.0
    out[(x == 0) | (x == 2), t.STOP_CODON[1]] = HALF
    return out


BEFORE_PART, BEHIND_PART = 5, 2  # letters around a part of a sequence that its emissions depend on


def part_matrix(model: Model, piece: str, left: int, size: int, donor=None, acceptor=None, start=None) -> np.ndarray:
    """(size, 21) of the letters of `piece` from `left` on; `left` is 0 at a sequence's start and else BEFORE_PART. Positions of scores count from the
    piece's first letter."""
    return matrix(model, piece, donor, acceptor, start)[left : left + size]


def loaded_scores(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Arrays of struct<pos, score> as the pairs of arrays that matrix() takes; None for null."""
    if column.null_count == len(column):
        return [None] * len(column)
    flat, ends = column.flatten(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    pos, score = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False)
    return [(pos[e - k : e], score[e - k : e]) if there else None for e, k, there in zip(ends, np.diff(ends, prepend=0), column.is_valid().to_pylist(), strict=True)]


def average_emission(rows: DataFrame, model: Model) -> DataFrame:
    """(state, n, avg_log_emission) of the states along given paths: `rows` (seq, states, donor, acceptor, start). Impossible emissions are left
    out. A batch of intervals becomes 21 sums at most, so next to nothing is shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(21, np.int64), np.zeros(21)
        for batch in batches:
            signals = [loaded_scores(batch.column(c)) for c in ("donor", "acceptor", "start")]
            for seq, states, *found in zip(batch.column("seq").to_pylist(), batch.column("states").to_pylist(), *signals, strict=True):
                path = np.frombuffer((states or "").encode(), np.uint8).astype(np.int64) - ord(t.letter(0))
                value = matrix(model, seq or "", *found)[np.arange(len(path)), path]
                fine = value > t.NEG_INF
                n += np.bincount(path[fine], minlength=21)
                total += np.bincount(path[fine], value[fine], 21)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(total[at])], ["state", "n", "total"])

    parts = rows.select("seq", "states", "donor", "acceptor", "start").mapInArrow(sums, "state int, n long, total double")
    return parts.groupBy("state").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avg_log_emission"))


def signal_columns(score: Column, scale: float = 1.0, bias: float = 0.0) -> dict[str, Column]:
    """donor, acceptor and start emissions as columns over the rows of around()."""
    value = scale * F.coalesce(score, F.lit(0.0)) + bias
    never = F.lit(t.NEG_INF)
    return {k: F.when(F.expr(c), value).otherwise(never) for k, c in (("donor", IS_DONOR), ("acceptor", IS_ACCEPTOR), ("start", IS_START))}


def deterministic() -> dict[str, Column]:
    """The codon states that need no score, over the rows of around()."""
    never, sure = F.lit(t.NEG_INF), F.lit(0.0)
    known = {"start_2": "base = 'T'", "start_3": "base = 'G'", "stop_1": "base = 'T'", "stop_3": IS_STOP}
    return {k: F.when(F.expr(c), sure).otherwise(never) for k, c in known.items()} | {"stop_2": F.when(F.expr("base in ('A', 'G')"), F.ln(F.lit(0.5))).otherwise(never)}
