"""From painted regions to the 21 states: one Arrow pass, run by run and not base by base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import topology as t
from .counting import slices
from .intervals import CDS, IGNORED, INTRON, painted_over, transcript_paints

ALLOWED = np.zeros((21, 21), bool)
for _a, _b in t.EDGES:
    ALLOWED[_a, _b] = True


def label_regions(regions: np.ndarray) -> np.ndarray:
    """States of one scaffold's regions. A locus opens with a start codon if its first three bases are coding, ends with a stop codon if its last three are
    and don't belong to the start; frames and intron phases count the coding bases between."""
    n = len(regions)
    states = np.full(n, t.INTERGENIC, np.int8)
    if not n:
        return states
    cuts = np.flatnonzero(np.diff(regions)) + 1
    frame = phase = 0
    inside = False
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, n).tolist(), strict=True):
        kind = regions[a]
        last = b == n or regions[b] not in (CDS, INTRON)
        if kind == CDS:
            at = a
            if not inside and b - a >= 3:
                states[a : a + 3] = t.START_CODON
                at, frame = a + 3, 0
            stop = last and b - at >= 3
            body = b - at - 3 * stop
            states[at : at + body] = (np.arange(body) + frame) % 3 + t.EXON[0]
            frame = (frame + body) % 3
            if stop:
                states[b - 3 : b] = t.STOP_CODON
            inside = True
        elif kind == INTRON:
            donor = a == 0 or regions[a - 1] == CDS
            if donor:
                phase = frame + 1
            if phase:
                states[a:b] = t.INTRON[phase - 1]
                if b < n and regions[b] == CDS:
                    states[b - 1] = t.ACCEPTOR[phase - 1]
                if donor:
                    states[a] = t.DONOR[phase - 1]
            inside = True
        if last:
            frame, inside = 0, False
    return states


def erase_illegal(states: np.ndarray) -> np.ndarray:
    """Intergenic for every locus with an illegal edge inside it, into it or out of it."""
    n = len(states)
    if n < 2:
        return states
    gene = states != t.INTERGENIC
    bad = ~ALLOWED[states[:-1], states[1:]]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gene.view(np.int8), [0]))))
    sums = np.concatenate(([0], np.cumsum(bad)))
    out = states.copy()
    for a, b in edge.reshape(-1, 2).tolist():
        if sums[min(b, n - 1)] > sums[max(a - 1, 0)]:
            out[a:b] = t.INTERGENIC
    return out


def with_paints(sequences: DataFrame, features: DataFrame, strand: str, column: str = "sequence") -> DataFrame:
    """(species, scaffold, `column`) and the scaffold's gathered paints."""
    rows = sequences.where("scaffold is not null").select("species", "scaffold", column)
    return rows.join(transcript_paints(features, strand), "scaffold", "left").select("species", "scaffold", column, "starts", "ends", "regions")


def letters(x: np.ndarray, first: int) -> str:
    return (x + first).astype(np.uint8).tobytes().decode()


def labelled(sequences: DataFrame, features: DataFrame, strand: str = "+", erase: bool = True) -> DataFrame:
    """(species, scaffold, sequence, regions, states) of every scaffold: painted and labelled in one pass over the scaffolds with their paints."""
    rows = with_paints(sequences, features, strand)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, regions, states = [len(s or "") for s in batch.column("sequence").to_pylist()], [], []
            for r in painted_over(batch, sizes):
                s = label_regions(r)
                regions.append(letters(r, 48))
                states.append(letters(erase_illegal(s) if erase else s, 65))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(regions, pa.string()), pa.array(states, pa.string())], ["species", "scaffold", "sequence", "regions", "states"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"species {kinds['species']}, scaffold {kinds['scaffold']}, sequence string, regions string, states string")


def paths(sequences: DataFrame, features: DataFrame, strand: str = "+") -> DataFrame:
    """(species, scaffold, states): the states of `labelled`, from the number n of every scaffold's letters, which themselves are not read."""
    rows = with_paints(sequences, features, strand, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, sizes="n"):
            states = [letters(erase_illegal(label_regions(r)), 65) for r in painted_over(batch, batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(states, pa.string())], ["species", "scaffold", "states"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"species {kinds['species']}, scaffold {kinds['scaffold']}, states string")


def usable_intervals(sequences: DataFrame, features: DataFrame, strand: str = "+") -> DataFrame:
    """(species, scaffold, start, end, seq, states): the parts that training and evaluation see, the maximal stretches without ignored bases. They are
    cut in the pass that labels a scaffold, whose regions it has at hand."""
    rows = with_paints(sequences, features, strand)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, starts, ends, seqs, states, texts = [], [], [], [], [], batch.column("sequence").to_pylist()
            for i, regions in enumerate(painted_over(batch, [len(s or "") for s in texts])):
                labels = letters(erase_illegal(label_regions(regions)), 65)
                usable = np.concatenate(([0], (regions != IGNORED).view(np.int8), [0]))
                for a, b in np.flatnonzero(np.diff(usable)).reshape(-1, 2).tolist():
                    of.append(i)
                    starts.append(a)
                    ends.append(b)
                    seqs.append(texts[i][a:b])
                    states.append(labels[a:b])
            own = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("species").take(own), batch.column("scaffold").take(own), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(seqs, pa.string()), pa.array(states, pa.string())], ["species", "scaffold", "start", "end", "seq", "states"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"species {kinds['species']}, scaffold {kinds['scaffold']}, start long, end long, seq string, states string")
