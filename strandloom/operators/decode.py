"""Viterbi and Forward-Backward over many intervals at once, and over intervals of any length.

The recurrences are sequential in the position and independent between intervals, so a batch of intervals of similar length goes through them in
lockstep: one numpy step advances all of them by a base, along the 32 legal edges only. Backpointers take one byte a state and base. Queries decode whole intervals
by `lockstep`, which makes do without dense emissions; what follows here says what its results are, and decodes the chunks.

*Long intervals.* What a part of a sequence does to the scores before it is a 19 x 19 matrix: the best score (or the log-sum) from every state at the last base
before it to every state at its last base. Matrices combine associatively, so an interval above `ONE_PASS` chunks is cut into chunks of `CHUNK` bases: parallel tasks make their
matrices, a scan over an interval's few matrices gives the scores before (and, for posteriors, behind) every chunk, and parallel tasks decode the
chunks between them. Scores are multiples of `QUANTUM`, which makes their sums exact, so chunks give the very path that one pass gives, ties
included. Bounds or a distribution of intron lengths depend on the path taken and don't combine; such intervals go chunk by chunk in one task, which keeps
the scores between chunks and makes the backpointers again on the way back. No task holds more than a chunk's arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import topology as t
from ..storage import discard, stored
from . import lockstep
from .emission import BEFORE_PART, BEHIND_PART, Model, loaded_scores, part_matrix

INNER = range(t.INTERGENIC, t.END)
BEFORE = {s: [a for a, b in t.EDGES if b == s and a in INNER] for s in INNER}  # ascending, so ties go to the smaller state
AFTER = {s: [b for a, b in t.EDGES if a == s and b in INNER] for s in INNER}


def _ranks(neighbours: dict[int, list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(states, neighbours) of the first neighbour of every state, of the second of those that have two, and so on, in ascending order: with them a step looks
    at the legal edges only. START, which nothing reaches, stands for a missing first one."""
    first = np.array([neighbours.get(s, [])[0] if neighbours.get(s) else t.START for s in range(21)])
    more = [[(s, own[k]) for s, own in neighbours.items() if len(own) > k] for k in range(1, max(map(len, neighbours.values())))]
    return [(np.arange(21), first), *((np.array([s for s, _ in x]), np.array([n for _, n in x])) for x in more)]


SOURCES, TARGETS = _ranks(BEFORE), _ranks(AFTER)
FIRST_SOURCES = SOURCES[0][1].astype(np.int8)[:, None]
CHUNK = 16_384
ONE_PASS = 16  # chunks that an interval may have to be decoded in one pass: matrices of chunks cost as much as 19 passes
BATCH_BASES = 400_000
LANE_BASES = 200_000  # of chunks whose matrices are made together: each has a lane for every state
UNLIMITED = np.iinfo(np.int64).max
QUANTUM = 2.0**-24  # sums stay exact up to 2**29, some 200 million bases
SCORES = ("donor", "acceptor", "start")


def whole(x: np.ndarray) -> np.ndarray:
    """Multiples of QUANTUM."""
    return np.round(x / QUANTUM) * QUANTUM


def _stack(emissions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, 21, n), and the n sizes: lanes lie side by side, so a step works on whole rows of them."""
    sizes = np.array([len(e) for e in emissions])
    out = np.full((max(sizes), 21, len(emissions)), t.NEG_INF)
    for i, e in enumerate(emissions):
        out[: len(e), :, i] = e
    return out, sizes


class Best:
    """The max-product recurrence. shortest, longest: bounds of an intron's body along the best path; pmf: log probabilities of its length, which replace
    the self-loop's cost."""

    def __init__(self, model: Model, penalty: float = 0.0, shortest: int = 0, longest: int = UNLIMITED, pmf: np.ndarray | None = None):
        self.begin, self.end = whole(model.trans[t.START]), whole(model.trans[:, t.END])
        trans = whole(model.trans)
        if pmf is not None:
            for s in t.INTRON:
                trans[s, s] = 0.0
        trans[t.INTERGENIC, t.START_CODON[0]] -= whole(np.array(penalty))
        trans[t.START] = t.NEG_INF
        self.costs = [trans[sources, states][:, None] for states, sources in SOURCES]
        self.shortest, self.longest, self.pmf = shortest, longest, None if pmf is None else whole(pmf)
        self.bounded = shortest > 0 or longest < UNLIMITED or pmf is not None
        self.intron, self.acceptor = list(t.INTRON), list(t.ACCEPTOR)

    def first(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (21, n) at the first base of an interval, and lengths (3, n) of the bodies of introns."""
        score = self.begin[:, None] + e
        score[[t.START, t.END]] = t.NEG_INF
        return score, np.ones((len(self.intron), e.shape[1]), np.int64)

    def step(self, score: np.ndarray, body: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and bodies one base on, and the states that they come from (any for a state that can't be reached: no path leads there)."""
        (_, sources), cost = SOURCES[0], self.costs[0]
        best = score.take(sources, 0)
        best += cost
        if self.bounded:  # an acceptor has but one state before it, the body of its intron
            best[self.acceptor] += np.where(body >= self.shortest, 0.0 if self.pmf is None else self.pmf[np.minimum(body, len(self.pmf) - 1)], t.NEG_INF)
        chosen = np.empty(score.shape, np.int8)
        chosen[:] = FIRST_SOURCES
        for (states, sources), cost in zip(SOURCES[1:], self.costs[1:], strict=True):
            value = score.take(sources, 0)
            value += cost
            if self.bounded:
                for k, s in enumerate(self.intron):
                    for i in np.flatnonzero((states == s) & (sources == s)):
                        value[i, body[k] >= self.longest] = t.NEG_INF
            held = best.take(states, 0)
            better = value > held  # ties go to the smaller state
            best[states] = np.where(better, value, held)
            chosen[states] = np.where(better, sources.astype(np.int8)[:, None], chosen.take(states, 0))
        best += e
        if self.bounded:
            own = chosen[self.intron]
            body = np.where(own == np.array(self.intron)[:, None], body + 1, 1)
        return best, body, chosen

    def run(self, e: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None, opening: np.ndarray | None = None, body: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backpointers (steps, 21, n) and, for each lane, scores and bodies at its last base. before: scores (21, n) in front of the lanes that aren't
        `opening` an interval."""
        score, bodies = self.first(e[0])
        back = np.zeros(e.shape, np.int8)
        if before is not None:
            on, grown, chosen = self.step(before, np.zeros_like(bodies) if body is None else body, e[0])
            score, bodies = np.where(opening, score, on), np.where(opening, bodies, grown)
            back[0] = np.where(opening, 0, chosen)
        last, last_body, ends = score.copy(), bodies.copy(), set(sizes.tolist())
        for i in range(1, len(e)):
            score, bodies, back[i] = self.step(score, bodies, e[i])
            if i + 1 in ends:
                ending = sizes == i + 1
                last[:, ending], last_body[:, ending] = score[:, ending], bodies[:, ending]
        return back, last, last_body

    def ends(self, last: np.ndarray) -> np.ndarray:
        """The state at the last base of each interval; 0 if no path is possible."""
        final = last + self.end[:, None]
        final[[t.START, t.END]] = t.NEG_INF
        return np.where(np.isfinite(final).any(0), final.argmax(0), t.START)


def traced(back: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths (steps, n) that end in the given states, and the states in front of them."""
    steps, _, n = back.shape
    paths, state, every = np.zeros((steps, n), np.int8), np.zeros(n, np.int64), np.arange(n)
    for i in range(steps - 1, -1, -1):
        state = np.where(sizes == i + 1, end, state)
        paths[i] = state
        state = back[i, state, every].astype(np.int64)
    return paths, state


def viterbi(model: Model, emissions: list[np.ndarray], penalty: float = 0.0, shortest: int = 0, longest: int = UNLIMITED, pmf: np.ndarray | None = None) -> list[np.ndarray]:
    """Best paths of whole intervals, in lockstep. Without any possible path the states are 0."""
    if not emissions:
        return []
    best = Best(model, penalty, shortest, longest, pmf)
    e, sizes = _stack([whole(x) for x in emissions])
    with np.errstate(invalid="ignore"):
        back, last, _ = best.run(e, sizes)
        paths, _ = traced(back, sizes, best.ends(last))
    return [paths[: sizes[k], k] for k in range(len(sizes))]


def viterbi_in_turn(best: Best, part: Callable[[int], np.ndarray], chunks: int) -> np.ndarray:
    """The best path of one interval whose emissions come chunk by chunk, also with intron lengths: scores and bodies between chunks are kept, and
    backpointers made again from the last chunk back."""
    before, bodies, opening, kept = None, None, np.array([True]), []
    with np.errstate(invalid="ignore"):
        for c in range(chunks):
            e = whole(part(c))
            kept.append((before, bodies, opening))
            _, before, bodies = best.run(e[:, :, None], np.array([len(e)]), before, opening, bodies)
            opening = np.array([False])
        state, pieces = best.ends(before), []
        for c in range(chunks - 1, -1, -1):
            e = whole(part(c))
            own, bodies, opening = kept[c]
            back, _, _ = best.run(e[:, :, None], np.array([len(e)]), own, opening, bodies)
            path, state = traced(back, np.array([len(e)]), state)
            pieces.append(path[:, 0])
    return np.concatenate(pieces[::-1])


class Sums:
    """The sum-product recurrences, in logarithms."""

    def __init__(self, model: Model, penalty: float = 0.0):
        trans = model.trans.copy()
        trans[t.INTERGENIC, t.START_CODON[0]] -= penalty
        self.begin, self.end = model.trans[t.START].copy(), model.trans[:, t.END].copy()
        self.begin[[t.START, t.END]] = self.end[[t.START, t.END]] = t.NEG_INF
        trans[t.START], trans[:, t.START] = t.NEG_INF, t.NEG_INF
        self.into = [trans[sources, states][:, None] for states, sources in SOURCES]
        self.out_of = [trans[states, targets][:, None] for states, targets in TARGETS]

    @staticmethod
    def added(column: np.ndarray, ranks: list[tuple[np.ndarray, np.ndarray]], costs: list[np.ndarray]) -> np.ndarray:
        """For every state the log-sum over its neighbours."""
        out = column.take(ranks[0][1], 0)
        out += costs[0]
        for (states, others), cost in zip(ranks[1:], costs[1:], strict=True):
            out[states] = np.logaddexp(out.take(states, 0), column.take(others, 0) + cost)
        return out

    def forward(self, e: np.ndarray, before: np.ndarray | None = None, opening: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Columns (21, n) from the first base on."""
        column = self.begin[:, None] + e[0]
        if before is not None:
            column = np.where(opening, column, self.added(before, SOURCES, self.into) + e[0])
        yield column
        for x in e[1:]:
            column = self.added(column, SOURCES, self.into) + x
            yield column

    def backward(self, e: np.ndarray, sizes: np.ndarray, behind: np.ndarray) -> Iterator[np.ndarray]:
        """Columns (21, n) from the last base back; behind: those at each lane's own last base."""
        column, ends = np.full(behind.shape, t.NEG_INF), set(sizes.tolist())
        for i in range(len(e) - 1, -1, -1):
            if i + 1 < len(e):
                column = self.added(e[i + 1] + column, TARGETS, self.out_of)
            if i + 1 in ends:
                closing = sizes == i + 1
                column[:, closing] = behind[:, closing]
            yield column


def posteriors(model: Model, emissions: list[np.ndarray], penalty: float = 0.0) -> list[np.ndarray]:
    """(T, 21) log posteriors; no length model. An impossible sequence gives NaN."""
    if not emissions:
        return []
    sums = Sums(model, penalty)
    e, sizes = _stack(emissions)
    n = len(sizes)
    both = np.empty(e.shape)
    with np.errstate(invalid="ignore", divide="ignore"):
        for i, column in enumerate(sums.forward(e)):
            both[i] = column
        total = np.logaddexp.reduce(both[sizes - 1, :, np.arange(n)] + sums.end, axis=1)
        for i, column in zip(range(len(e) - 1, -1, -1), sums.backward(e, sizes, np.tile(sums.end[:, None], (1, n))), strict=True):
            both[i] += column
        return [both[: sizes[k], :, k] - total[k] for k in range(n)]


def along(both: np.ndarray, total: float, path: np.ndarray) -> np.ndarray:
    """exp of forward and backward less the total along a path, in [0, 1]; impossible gives 0."""
    with np.errstate(invalid="ignore"):
        return np.clip(np.nan_to_num(np.exp(both[np.arange(len(path)), path] - total), nan=0.0), 0.0, 1.0)


def confidence(posterior: np.ndarray, path: np.ndarray) -> np.ndarray:
    """exp of the posterior along a path, in [0, 1]; impossible gives 0."""
    if len(posterior) != len(path):
        raise ValueError("path and sequence differ in length")
    return along(posterior, 0.0, path)


def path_score(model: Model, emission: np.ndarray, path: np.ndarray, penalty: float = 0.0, start: int = 0, end: int | None = None, before: int = t.START) -> float:
    """Emissions and transitions along path[start:end], less the penalty for each gene entered; no length model. before: the state in front of the path."""
    end = len(path) if end is None else min(end, len(path))
    prior = np.concatenate(([before], path[:-1])).astype(int)
    i = np.arange(start, end)
    entered = (prior[i] == t.INTERGENIC) & (path[i] == t.START_CODON[0])
    return float((emission[i, path[i]] + model.trans[prior[i], path[i]]).sum() - penalty * entered.sum())


def letters_of(path: np.ndarray) -> str:
    return (path + 65).astype(np.uint8).tobytes().decode()


def codes_of(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode(), np.uint8).astype(np.int64) - 65


def decode(rows: DataFrame, model: Model, penalty: float = 0.0, shortest: int = 0, longest: int = UNLIMITED, pmf: list[float] | None = None, with_confidence: bool = True, dealt: bool = False, logs: bool = False) -> DataFrame:
    """`rows` (key, seq, and donor, acceptor, start: arrays of struct<pos, score>, null for none loaded) with `path` (letters), `score` of the whole path and
    `confidence` (array, empty unless asked for). Rows are written once, as long intervals are looked for first. dealt: they lie in enough partitions, so they aren't
    shuffled with their scores, which take twice the letters' room. logs: confidences by sums of logarithms, which cost several times as much and differ in their last digits."""
    lengths = None if pmf is None else np.asarray(pmf, float)
    rows = rows if hasattr(rows, "_stored_at") else stored(rows)
    size, most = F.coalesce(F.length("seq"), F.lit(0)), ONE_PASS * CHUNK
    short = decode_short(rows.where(size <= most), model, penalty, shortest, longest, lengths, with_confidence, dealt, logs)
    if not rows.where(size > most).limit(1).count():
        return short
    long = decode_long(rows.where(size > most), model, penalty, shortest, longest, lengths, with_confidence)
    return short.unionByName(long)


def columns_sql(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Dealt over all cores: a scan of few files would leave the work to few tasks, and decoding costs far more than this shuffle."""
    session = rows.sparkSession
    return rows.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), *by)


def alike(batches: Iterator[pa.RecordBatch], bases: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of sequences of like length and some `bases` in all."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("seq")), 0).to_numpy(zero_copy_only=False)
        order, at = np.argsort(-sizes, kind="stable"), 0
        while at < len(order):
            many = max(1, bases // max(1, int(sizes[order[at]])))
            yield batch.take(pa.array(order[at : at + many]))
            at += many


def decode_short(rows: DataFrame, model: Model, penalty: float, shortest: int, longest: int, pmf: np.ndarray | None, with_confidence: bool, dealt: bool = False, logs: bool = False) -> DataFrame:
    """Whole intervals in lockstep."""
    scores_in_pieces_of = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lockstep.packed(batches):
            yield lockstep.solved(model, batch, penalty, shortest, longest, pmf, with_confidence, scores_in_pieces_of, logs)

    return (rows if dealt else spread(rows)).mapInArrow(run, columns_sql(rows) + ", path string, score double, confidence array<double>")


# long intervals


def chunks_of(rows: DataFrame) -> DataFrame:
    """(row_, chunk, left, size, seq, and the scores): CHUNK bases each, with the letters around them that emissions depend on; scores as bytes."""
    scores = [c for c in SCORES if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loaded = {c: loaded_scores(batch.column(c)) for c in scores}
            for i, (row, seq) in enumerate(zip(batch.column("row_").to_pylist(), batch.column("seq").to_pylist(), strict=True)):
                by_place = {c: None if loaded[c][i] is None else tuple(a[np.argsort(loaded[c][i][0], kind="stable")] for a in loaded[c][i]) for c in scores}
                for chunk, at in enumerate(range(0, len(seq), CHUNK)):
                    first, end = max(0, at - BEFORE_PART), min(len(seq), at + CHUNK)
                    behind = min(len(seq), end + BEHIND_PART)
                    own = []
                    for c in scores:
                        if by_place[c] is None:
                            own.append(None)
                            continue
                        places, values = by_place[c]
                        a, b = np.searchsorted(places, (first, behind))
                        own.append((places[a:b] - first).astype(np.int64).tobytes() + values[a:b].astype(float).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([chunk], pa.int32()), pa.array([at - first], pa.int32()), pa.array([end - at], pa.int32()), pa.array([seq[first:behind]]), *(pa.array([x], pa.binary()) for x in own)], ["row_", "chunk", "left", "size", "seq", *scores])

    return spread(rows.select("row_", "seq", *scores).mapInArrow(run, "row_ long, chunk int, left int, size int, seq string" + "".join(f", {c} binary" for c in scores)), "row_", "chunk")


def part_of(model: Model, batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Emissions of a chunk."""
    found = {}
    for c in SCORES:
        data = batch.column(c)[i].as_py() if c in batch.schema.names else None
        found[c] = None if data is None else (np.frombuffer(data[: len(data) // 2], np.int64), np.frombuffer(data[len(data) // 2 :]))
    return part_matrix(model, batch.column("seq")[i].as_py(), batch.column("left")[i].as_py(), batch.column("size")[i].as_py(), **found)


def chunk_matrices(chunks: DataFrame, model: Model, penalty: float, with_sums: bool) -> DataFrame:
    """(row_, chunk, best, sums): matrices (19, 21) from the state before a chunk to that at its last base, as bytes; the rows of an interval's first
    chunk are all alike."""
    inner = len(INNER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, sums = Best(model, penalty), Sums(model, penalty)
        before = np.full((21, inner), t.NEG_INF)
        before[list(INNER), np.arange(inner)] = 0.0
        for batch in alike(batches, LANE_BASES):
            e, sizes = _stack([part_of(model, batch, i) for i in range(batch.num_rows)])
            w, n, lanes = whole(e), len(sizes), np.repeat(sizes, inner)
            opening, start = np.repeat(batch.column("chunk").to_numpy() == 0, inner), np.tile(before, (1, n))
            ends = set(sizes.tolist())
            wide = lambda x: np.repeat(x, inner, 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                score, body = top.first(wide(w[0]))
                on, _, _ = top.step(start, body, wide(w[0]))
                score = np.where(opening, score, on)
                best = score.copy()
                for i in range(1, len(e)):
                    score, _, _ = top.step(score, body, wide(w[i]))
                    if i + 1 in ends:
                        best[:, lanes == i + 1] = score[:, lanes == i + 1]
                added = np.full(best.shape, t.NEG_INF)
                if with_sums:
                    for i, column in enumerate(sums.forward(Repeated(e, inner), start, opening)):
                        if i + 1 in ends:
                            added[:, lanes == i + 1] = column[:, lanes == i + 1]
            blob = lambda x: pa.array([m.tobytes() for m in np.ascontiguousarray(x.T).reshape(n, inner, 21)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row_"), batch.column("chunk"), blob(best), blob(added)], ["row_", "chunk", "best", "sums"])

    return chunks.mapInArrow(run, "row_ long, chunk int, best binary, sums binary")


class Repeated:
    """A stack of emissions (steps, 21, n) with every lane `times` times, made step by step."""

    def __init__(self, e: np.ndarray, times: int):
        self.e, self.times = e, times

    def __len__(self) -> int:
        return len(self.e)

    def __getitem__(self, i):
        return Repeated(self.e[i], self.times) if isinstance(i, slice) else np.repeat(self.e[i], self.times, 1)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (np.repeat(x, self.times, 1) for x in self.e)


def scanned(matrices: DataFrame, model: Model, penalty: float, with_sums: bool) -> DataFrame:
    """(row_, chunk, before, ahead, behind, total): the best scores and the log-sums in front of every chunk, what follows its last base, and the
    interval's whole log-sum. An interval's matrices are scanned in one task: 6 KB for every CHUNK bases."""
    inner = list(INNER)

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        best = [np.frombuffer(m).reshape(len(inner), 21) for m in rows["best"]]
        sums, adding = [np.frombuffer(m).reshape(len(inner), 21) for m in rows["sums"]], Sums(model, penalty)
        before, ahead, behind = [np.full(21, t.NEG_INF)], [np.full(21, t.NEG_INF)], [adding.end]
        with np.errstate(invalid="ignore", divide="ignore"):
            for c in range(len(best)):
                before.append(best[0][0] if c == 0 else (before[-1][inner][:, None] + best[c]).max(0))
                ahead.append(sums[0][0] if c == 0 else np.logaddexp.reduce(ahead[-1][inner][:, None] + sums[c], axis=0))
            for c in range(len(best) - 1, 0, -1):
                on = np.full(21, t.NEG_INF)
                on[inner] = np.logaddexp.reduce(sums[c] + behind[-1][None, :], axis=1)
                behind.append(on)
            total = float(np.logaddexp.reduce(ahead[-1] + adding.end)) if with_sums else 0.0
        ends = [b""] * (len(best) - 1) + [before[-1].tobytes()]
        return pd.DataFrame({"row_": rows["row_"].to_numpy(), "chunk": rows["chunk"].to_numpy(), "before": [x.tobytes() for x in before[:-1]], "ahead": [x.tobytes() for x in ahead[:-1]], "behind": [x.tobytes() for x in behind[::-1]], "last": ends, "total": total})

    return matrices.groupBy("row_").applyInPandas(scan, "row_ long, chunk int, before binary, ahead binary, behind binary, last binary, total double")


def chunk_runs(batch: pa.RecordBatch, model: Model, best: Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, sizes and backpointers of chunks with the scores in front of them."""
    e, sizes = _stack([part_of(model, batch, i) for i in range(batch.num_rows)])
    before = np.stack([np.frombuffer(x) for x in batch.column("before").to_pylist()], 1)
    with np.errstate(invalid="ignore"):
        back, _, _ = best.run(whole(e), sizes, before, batch.column("chunk").to_numpy() == 0)
    return e, sizes, back


def decode_long(rows: DataFrame, model: Model, penalty: float, shortest: int, longest: int, pmf: np.ndarray | None, with_confidence: bool) -> DataFrame:
    """Intervals of any length, chunk by chunk."""
    rows = stored(rows.withColumn("row_", F.monotonically_increasing_id()))
    chunks = stored(chunks_of(rows))
    best, inner, key, made = Best(model, penalty, shortest, longest, pmf), list(INNER), ["row_", "chunk"], [rows, chunks]
    if best.bounded and not with_confidence:  # nothing asks for what lies around a chunk
        met = chunks
    else:
        matrices = stored(chunk_matrices(chunks, model, penalty, with_confidence))
        places = stored(scanned(matrices, model, penalty, with_confidence))
        met = chunks.join(places, key)
        made += [matrices, places]
    if best.bounded:
        paths = paths_in_turn(chunks, model, best)
    else:

        def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The state in front of a chunk for every state at its last base."""
            for batch in alike(batches, BATCH_BASES):
                _, sizes, back = chunk_runs(batch, model, best)
                each = np.stack([traced(back, sizes, np.full(len(sizes), s))[1] for s in range(21)], 1)
                yield pa.RecordBatch.from_arrays([batch.column("row_"), batch.column("chunk"), pa.array([x.astype(np.int8).tobytes() for x in each], pa.binary()), batch.column("last")], ["row_", "chunk", "ways", "last"])

        def walk(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("chunk")
            state, out = int(best.ends(np.frombuffer(rows["last"].iloc[-1])[:, None])[0]), []
            for way in reversed(list(rows["ways"])):
                out.append(state)
                state = int(np.frombuffer(way, np.int8)[state])
            return pd.DataFrame({"row_": rows["row_"].to_numpy(), "chunk": rows["chunk"].to_numpy(), "end": np.array(out[::-1], np.int32)})

        ends = spread(met, *key).mapInArrow(ways, "row_ long, chunk int, ways binary, last binary").groupBy("row_").applyInPandas(walk, "row_ long, chunk int, end int")

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in alike(batches, BATCH_BASES):
                _, sizes, back = chunk_runs(batch, model, best)
                found, front = traced(back, sizes, batch.column("end").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("row_"), batch.column("chunk"), pa.array([letters_of(found[:n, k]) for k, n in enumerate(sizes)]), pa.array(front.astype(np.int32))], ["row_", "chunk", "path", "front"])

        paths = spread(met.join(ends, key), *key).mapInArrow(follow, "row_ long, chunk int, path string, front int")
    paths = stored(paths)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's part of the score and its confidence."""
        sums = Sums(model, penalty)
        for batch in alike(batches, BATCH_BASES // 4):
            e, sizes = _stack([part_of(model, batch, i) for i in range(batch.num_rows)])
            found, fronts, n = [codes_of(p) for p in batch.column("path").to_pylist()], batch.column("front").to_numpy(), len(sizes)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = [path_score(model, e[: sizes[k], :, k], p, penalty, before=int(fronts[k])) for k, p in enumerate(found)]
                sure: list[np.ndarray] = [np.zeros(0)] * n
                if with_confidence:
                    ahead, behind = (np.stack([np.frombuffer(x) for x in batch.column(c).to_pylist()], 1) for c in ("ahead", "behind"))
                    both = np.empty(e.shape)
                    for i, column in enumerate(sums.forward(e, ahead, batch.column("chunk").to_numpy() == 0)):
                        both[i] = column
                    for i, column in zip(range(len(e) - 1, -1, -1), sums.backward(e, sizes, behind), strict=True):
                        both[i] += column
                    sure = [along(both[: sizes[k], :, k], total, p) for k, (p, total) in enumerate(zip(found, batch.column("total").to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("row_"), batch.column("chunk"), batch.column("path"), pa.array(score), pa.array(sure, pa.list_(pa.float64()))], ["row_", "chunk", "path", "score", "confidence"])

    done = spread(met.join(paths, key), *key).mapInArrow(finish, "row_ long, chunk int, path string, score double, confidence array<double>")
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "path", "score", "confidence")))  # of one interval, whose path they are
    whole_rows = done.groupBy("row_").agg(pieces.alias("p")).select("row_", F.array_join("p.path", "").alias("path"), F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["score"]).alias("score"), F.flatten("p.confidence").alias("confidence"))
    out = stored(rows.join(whole_rows, "row_").drop("row_"))
    discard(*made, paths)
    return out


def paths_in_turn(chunks: DataFrame, model: Model, best: Best) -> DataFrame:
    """(row_, chunk, path, front) with intron lengths: an interval's chunks follow each other in one task, which holds its letters and scores and one chunk's
    arrays."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.sort_by("chunk").combine_chunks().to_batches()[0]
        path = viterbi_in_turn(best, lambda c: part_of(model, batch, c), batch.num_rows)
        cuts = np.cumsum(batch.column("size").to_numpy())
        found = np.split(path, cuts[:-1])
        fronts = [t.START, *(int(p[-1]) for p in found[:-1])]
        return pa.table({"row_": batch.column("row_"), "chunk": batch.column("chunk"), "path": [letters_of(p) for p in found], "front": pa.array(fronts, pa.int32())})

    return chunks.groupBy("row_").applyInArrow(run, "row_ long, chunk int, path string, front int")
