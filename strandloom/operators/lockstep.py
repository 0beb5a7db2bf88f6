"""Viterbi and posteriors of many whole intervals in lockstep, from letters and signals alone.

`decode` describes the recurrences over dense emissions. Here a base is a code of its last six letters, by which tables give its emissions, and the signals
(donor, acceptor, start) are lists of their places; emissions are made for some steps at a time and dropped. Lanes lie from the longest to the shortest, so those that
still run are the first ones; states with several edges lie side by side, so a step is a few operations on all lanes; and a backpointer is kept only for the
eight states that have a choice. Sums of scores are exact (`decode.QUANTUM`), so paths are those of `decode.viterbi`, ties
included. Posteriors are products and sums of probabilities, scaled every few steps, and taken along the path only; where their range is too
small, by a wider one or by logarithms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import topology as t
from .counting import flat
from .emission import CODES, HALF, QUARTER, Model

AREA = 2_000_000  # steps times lanes of those that go together
POOL = 5_000_000  # letters of a task among which like lengths are looked for
CELLS = 8_192  # steps times lanes whose emissions are made at a time
SCALE = 8  # steps between scalings
UNLIMITED = np.iinfo(np.int64).max

# rows of the states: first those that a path may come to from several states, from the second on those that it may leave to several
ORDER = (t.DONOR[0], *t.INTRON, *t.EXON, t.INTERGENIC, t.START_CODON[2], *t.DONOR[1:], *t.ACCEPTOR, *t.START_CODON[:2], *t.STOP_CODON)
ROWS = len(ORDER)
CODE_OF, ROW_OF = np.array(ORDER), np.zeros(21, np.int64)
ROW_OF[CODE_OF] = np.arange(ROWS)
SOURCES, TARGETS = ([[(ROW_OF[s], ROW_OF[a], ROW_OF[b]) for a, b in t.EDGES if (a, b)[1 - i] == s and (a, b)[i] in ORDER] for s in ORDER] for i in (0, 1))  # ascending by the other state's code
MANY_IN, MANY_OUT = slice(0, 8), slice(1, 9)
INTRONS, ACCEPTORS = slice(1, 4), slice(11, 14)
THIRD_IN, THIRD_OUT = ROW_OF[t.EXON[0]], ROW_OF[t.EXON[2]]  # the states with three edges
assert [r for r, x in enumerate(SOURCES) if len(x) > 1] == list(range(8)) and [r for r, x in enumerate(TARGETS) if len(x) > 1] == list(range(1, 9))

EARLY, SECOND, FIRST = 4096, 4160, 4224  # codes of a row's third to fifth base, of its second and of its first, by three letters
KINDS = 4288

# choices are kept for the states with several edges, then whether the third edge was taken, then a row of zeros for all others
NOWHERE, KEPT = ROWS, 10
CHOICE = np.array([*range(8), *[KEPT - 1] * (ROWS - 7)])
PRIOR = np.full((ROWS + 1, 3), NOWHERE)
for _row, _edges in enumerate(SOURCES):
    PRIOR[_row, : len(_edges)] = [a for _, a, _ in _edges]
LETTER = np.append(CODE_OF, t.START).astype(np.uint8) + 65


class Edges:
    """The legal edges into (or out of) all states in ranks: what they come from (or lead to), and their costs."""

    def __init__(self, edges: list[list[tuple]], some: slice, third: int, trans: np.ndarray, to: int):
        cost = lambda pairs: np.array([trans[CODE_OF[a], CODE_OF[b]] for _, a, b in pairs])[:, None]
        one, two = [x[0] for x in edges], [x[1] for x in edges[some]]
        self.one, self.two, self.three = (np.array([x[to] for x in r]) for r in (one, two, [edges[third][2]]))
        self.one_cost, self.two_cost, self.three_cost = cost(one), cost(two), cost([edges[third][2]])


def tables(model: Model) -> np.ndarray:
    """(21, KINDS): what the states emit whose emission is told by the last letters; the others' rows are not used."""
    out = np.full((21, KINDS), t.NEG_INF)
    out[[t.START, t.END]] = 0.0
    code = np.arange(KINDS)
    x, before, three = code % 4, code // 4 % 4, code % 64
    out[t.INTERGENIC] = np.where(code < FIRST, model.intergenic[before, x], QUARTER)
    out[list(t.INTRON)] = np.where(code < FIRST, model.intron[before, x], QUARTER)
    out[list(t.EXON), :EARLY] = model.exon[:, code[:EARLY] // 4, x[:EARLY]]
    out[list(t.EXON), EARLY:] = QUARTER
    out[t.START_CODON[1], x == 3] = out[t.START_CODON[2], x == 2] = out[t.STOP_CODON[0], x == 3] = 0.0
    out[t.STOP_CODON[1], (x == 0) | (x == 2)] = HALF
    out[t.STOP_CODON[2], np.isin(three, (48, 50, 56)) & (code < SECOND)] = 0.0  # TAA, TAG, TGA
    return out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, from the longest to the shortest among POOL letters, in batches of at most AREA steps times lanes."""

    def cut(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        size = pc.fill_null(pc.binary_length(table.column("seq")), 0).to_numpy()
        order, at = np.argsort(-size, kind="stable"), 0
        while at < len(order):
            to = at + max(1, AREA // max(1, int(size[order[at]])))
            part = table.take(pa.array(order[at:to])).combine_chunks()
            yield from part.to_batches()
            at = to

    held, letters = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            letters += pc.sum(pc.binary_length(batch.column("seq"))).as_py() or 0
        if letters >= POOL:
            yield from cut(held)
            held, letters = [], 0
    if held:
        yield from cut(held)


class Lanes:
    """Rows (seq, and donor, acceptor, start: arrays of struct<pos, score>, null or no column for none loaded) from the longest to the shortest, as codes (steps, lanes) and
    signals. Raises where a motif asks for scores that weren't loaded."""

    def __init__(self, model: Model, batch: pa.RecordBatch):
        data, offsets = flat(batch.column("seq"))
        self.model, self.offsets, self.sizes = model, offsets, np.diff(offsets)
        self.n, self.steps = int((self.sizes > 0).sum()), int(self.sizes.max(initial=0))
        x, of = CODES[data].astype(np.int16), np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        place = np.arange(len(x), dtype=np.int32) - offsets.astype(np.int32)[of]
        code = x.copy()
        for i in range(1, 6):
            code[i:] += x[:-i] * 4**i
        early = np.flatnonzero(place < 5)
        code[early] = code[early] % 64 + np.array([FIRST, SECOND, EARLY, EARLY, EARLY])[place[early]]
        self.code = code
        inside = lambda k: place[: max(0, len(x) - k)] + k < self.sizes[of[: max(0, len(x) - k)]]
        pair = inside(1)
        a, b = x[:-1], x[1:]
        donor, acceptor = np.flatnonzero(pair & (a == 2) & (b == 3)), np.flatnonzero(pair & (a == 0) & (b == 2)) + 1
        start = np.flatnonzero(inside(2) & (x[:-2] == 0) & (x[1:-1] == 3) & (x[2:] == 2))
        self.signals = {}  # flat places and values
        for name, at in (("donor", donor), ("acceptor", acceptor), ("start", start)):
            scores = self._scores(batch, name, at, of)
            self.signals[name] = at, getattr(model, f"{name}_scale") * scores + getattr(model, f"{name}_bias")
        self.lane_codes = np.zeros((self.n, self.steps), np.int16)
        self.lane_codes[np.arange(self.steps) < self.sizes[: self.n, None]] = code
        self.lane_codes = np.ascontiguousarray(self.lane_codes.T)
        families = {"donor": t.DONOR, "acceptor": t.ACCEPTOR, "start": t.START_CODON[:1]}
        events = [(place[at], of[at], np.full(len(at), ROW_OF[state]), value) for name, (at, value) in self.signals.items() for state in families[name]]
        step, lane, row, value = (np.concatenate(c) for c in zip(*events, strict=True))
        order = np.argsort(step, kind="stable")
        self.events = step[order].astype(np.int64), lane[order], row[order], value[order]

    def _scores(self, batch: pa.RecordBatch, name: str, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of the places `at`; 0 where a row has none."""
        column = batch.column(name) if name in batch.schema.names else pa.nulls(batch.num_rows)
        if column.null_count:
            if column.is_null().to_numpy(zero_copy_only=False)[of[at]].any():
                raise ValueError(f"no {'start' if name == 'start' else 'splice'} scores were loaded")
            if column.null_count == len(column):
                return np.zeros(len(at))
        items = column.flatten()
        place, value = items.field(0).to_numpy(zero_copy_only=False).astype(np.int64), items.field(1).to_numpy(zero_copy_only=False)
        lane = np.repeat(np.arange(batch.num_rows), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        fine = (place >= 0) & (place < self.sizes[lane])
        dense = np.zeros(len(of))
        dense[self.offsets[lane[fine]] + place[fine]] = value[fine]
        return dense[at]

    def running(self, step: int) -> int:
        """How many lanes have a base there."""
        return int(np.searchsorted(-self.sizes[: self.n], -step, side="left"))

    def blocks(self, table: np.ndarray, never: float, kind, backwards: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(first step, emissions (ROWS, steps, lanes)); kind: what becomes of a score."""
        step, lane, row, value = self.events
        value, size = kind(value), max(1, CELLS // max(1, self.n))
        told = [(ROW_OF[s], table[s]) for s in (t.INTERGENIC, t.INTRON[0], *t.EXON, *t.START_CODON[1:], *t.STOP_CODON)]
        firsts = range(0, self.steps, size)
        for first in reversed(firsts) if backwards else firsts:
            n, end = self.running(first), min(self.steps, first + size)
            code = self.lane_codes[first:end, :n].astype(np.intp)
            out = np.empty((ROWS, end - first, n))
            for own, by_code in told:
                by_code.take(code, 0, out[own], "clip")
            out[[ROW_OF[s] for s in t.INTRON[1:]]] = out[ROW_OF[t.INTRON[0]]]
            out[[ROW_OF[s] for s in (*t.DONOR, *t.ACCEPTOR, t.START_CODON[0])]] = never
            a, b = np.searchsorted(step, (first, end))
            out[row[a:b], step[a:b] - first, lane[a:b]] = value[a:b]
            yield first, out


def whole(x: np.ndarray) -> np.ndarray:
    from .decode import whole as rounded

    return rounded(x)


def best_paths(lanes: Lanes, penalty: float = 0.0, shortest: int = 0, longest: int = UNLIMITED, pmf: np.ndarray | None = None) -> np.ndarray:
    """(steps, lanes) rows of the states along the best paths; NOWHERE along a lane without any. Bounds and pmf as in `decode.Best`."""
    trans = whole(lanes.model.trans)
    begin, end = trans[t.START][CODE_OF][:, None], trans[:, t.END][CODE_OF][:, None]
    if pmf is not None:
        trans[list(t.INTRON), list(t.INTRON)], pmf = 0.0, whole(pmf)
    trans[t.INTERGENIC, t.START_CODON[0]] -= whole(np.array(penalty))
    into, bounded = Edges(SOURCES, MANY_IN, THIRD_IN, trans, 1), shortest > 0 or longest < UNLIMITED or pmf is not None
    n, closing = lanes.n, set(lanes.sizes.tolist())
    back = np.zeros((lanes.steps, KEPT, n), bool)
    last, run = np.empty((ROWS, n)), n
    x, body = np.empty((ROWS, n)), np.ones((3, n), np.int64)
    for first, e in lanes.blocks(whole(tables(lanes.model)), t.NEG_INF, whole):
        for j in range(e.shape[1]):
            i = first + j
            if i in closing:  # the lanes of that size ended at the step before
                to = lanes.running(i)
                last[:, to:run] = x[:, to:]
                x, body, run = x[:, :to].copy(), body[:, :to].copy(), to
            if not i or y.shape != x.shape:
                y, two, third = np.empty_like(x), np.empty((8, run)), np.empty((1, run))
            if i:
                kept = back[i, :, :run]
                x.take(into.one, 0, y, "clip")
                np.add(y, into.one_cost, y)
                x.take(into.two, 0, two, "clip")
                np.add(two, into.two_cost, two)
                if bounded:  # an acceptor has but one state before it, the body of its intron
                    y[ACCEPTORS] += np.where(body >= shortest, 0.0 if pmf is None else pmf[np.minimum(body, len(pmf) - 1)], t.NEG_INF)
                    two[INTRONS][body >= longest] = t.NEG_INF
                held = y[MANY_IN]
                np.greater(two, held, kept[MANY_IN])  # ties go to the smaller state
                np.maximum(two, held, held)
                held = y[THIRD_IN]
                np.add(x[into.three[0]], into.three_cost[0], third[0])
                np.greater(third[0], held, kept[8])
                np.maximum(third[0], held, held)
                if bounded:
                    body += 1
                    body[~kept[INTRONS]] = 1
            else:
                y[:] = begin
            y += e[:, j, :run]
            x, y = y, x
    last[:, :run] = x
    choice = back.view(np.uint8)
    np.copyto(choice[:, THIRD_IN], 2, where=back[:, 8])
    final = np.full((21, n), t.NEG_INF)
    final[CODE_OF] = last + end
    return traced(choice, lanes, np.where(np.isfinite(final).any(0), ROW_OF[final.argmax(0)], NOWHERE))


def traced(choice: np.ndarray, lanes: Lanes, ends: np.ndarray) -> np.ndarray:
    steps, _, n = choice.shape
    paths, now, every = np.full((steps, n), NOWHERE, np.uint8), np.zeros(0, np.int64), np.arange(n)
    kept, prior, closing = 3 * np.arange(ROWS + 1), 3 * PRIOR.reshape(-1), set(lanes.sizes.tolist())
    place = np.repeat(CHOICE * n, 3)
    for i in range(steps - 1, -1, -1):
        if i + 1 in closing:
            now = np.concatenate((now, kept[ends[len(now) : lanes.running(i)]]))
        run = len(now)
        paths[i, :run] = now
        at = place.take(now)
        at += every[:run]
        now = prior.take(now + choice[i].reshape(-1).take(at))
    paths //= 3
    return paths


def confidences(lanes: Lanes, paths: np.ndarray, penalty: float = 0.0, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(lanes, steps) posteriors of the states along the paths, and for which lanes the range of `kind` was too small to tell them. States that a path can't be left
    from, as an intron without an end, may have far larger sums than the best path's; where these push the latter down to numbers that are nearly
    nothing, a lane's posteriors aren't given."""
    trans = lanes.model.trans.astype(kind)
    trans[t.INTERGENIC, t.START_CODON[0]] -= penalty
    begin, end = np.exp(lanes.model.trans[t.START][CODE_OF].astype(kind))[:, None], np.exp(lanes.model.trans[:, t.END][CODE_OF].astype(kind))[:, None]
    trans, table, least = np.exp(trans), np.exp(tables(lanes.model)), np.finfo(kind).tiny ** kind(0.65)
    into, out_of = Edges(SOURCES, MANY_IN, THIRD_IN, trans, 1), Edges(TARGETS, MANY_OUT, THIRD_OUT, trans, 2)
    n, steps, closing, every = lanes.n, lanes.steps, set(lanes.sizes.tolist()), np.arange(lanes.n)
    sure, scale = np.zeros((steps, n), kind), np.zeros((-(-steps // SCALE), n))  # ahead along the path; logarithms of what was taken out by then
    total, run, x, low = np.full(n, t.NEG_INF), n, np.empty((ROWS, n), kind), np.ones(n, kind)
    path = np.minimum(paths, ROWS - 1)  # a lane without a path has no sum either

    def step(x: np.ndarray, y: np.ndarray, edges: Edges, some: slice, third: int, two: np.ndarray) -> None:
        x.take(edges.one, 0, y, "clip")
        np.multiply(y, edges.one_cost, y)
        x.take(edges.two, 0, two, "clip")
        np.multiply(two, edges.two_cost, two)
        y[some] += two
        y[third] += x[edges.three[0]] * edges.three_cost[0]

    def lowered(x: np.ndarray) -> np.ndarray:
        """Takes the largest numbers out, and gives their logarithms."""
        top = x.max(0)
        top[~(top > 0)] = 1.0
        x /= top
        return np.log(top).astype(float)

    def along(x: np.ndarray, i: int) -> np.ndarray:
        at = path[i, : x.shape[1]] * np.int64(x.shape[1])
        at += every[: x.shape[1]]
        own, held = x.reshape(-1).take(at), low[: x.shape[1]]
        np.minimum(held, own, held)
        return own

    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        for first, e in lanes.blocks(table, 0.0, np.exp):
            for j in range(e.shape[1]):
                i = first + j
                if i in closing:
                    to = lanes.running(i)
                    total[to:run] = np.log((x[:, to:] * end).sum(0)).astype(float) + scale[(i - 1) // SCALE, to:run]
                    x, run = x[:, :to].copy(), to
                if not i or y.shape != x.shape:
                    y, two = np.empty_like(x), np.empty((8, run), kind)
                if i and i % SCALE == 0:
                    scale[i // SCALE, :run] = scale[i // SCALE - 1, :run] + lowered(x)
                if i:
                    step(x, y, into, MANY_IN, THIRD_IN, two)
                else:
                    y[:] = begin
                y *= e[:, j, :run]
                x, y = y, x
                sure[i, :run] = along(x, i)
        total[:run] = np.log((x * end).sum(0)).astype(float) + scale[(steps - 1) // SCALE, :run]
        # `out` is taken out of what lies behind; a state has behind it what those that it leads to emit and have behind them
        x, out = np.empty((ROWS, 0), kind), np.zeros(n)
        y, two = x.copy(), np.empty((8, 0), kind)
        for first, e in lanes.blocks(table, 0.0, np.exp, True):
            for j in range(e.shape[1] - 1, -1, -1):
                i = first + j
                step(x, y, out_of, MANY_OUT, THIRD_OUT, two)
                x, y = y, x
                if i + 1 in closing:
                    run = lanes.running(i)
                    x = np.concatenate((x, np.tile(end, (1, run - x.shape[1]))), 1)
                    y, two = np.empty_like(x), np.empty((8, run), kind)
                run = x.shape[1]
                if i % SCALE == 0:
                    out[:run] += lowered(x)
                sure[i, :run] *= along(x, i)
                sure[i, :run] *= np.exp((scale[i // SCALE, :run] + out[:run] - total[:run]).astype(kind))
                x *= e[:, j, :run]
    unknown = ~(np.isfinite(total) & (low > least))
    sure[:, unknown] = 0.0
    return np.ascontiguousarray(np.clip(sure, 0.0, 1.0, out=sure).astype(float, copy=False).T), unknown


def sure_of(lanes: Lanes, paths: np.ndarray, penalty: float, batch: pa.RecordBatch, logs: bool = False) -> np.ndarray:
    """(lanes, steps) posteriors along the paths; 0 where there is no path. Lanes that numbers don't suffice for are done again with a wider range, and, if that
    doesn't do either (or with `logs` at once), by sums of logarithms."""
    from .decode import confidence, posteriors
    from .emission import loaded_scores, matrix

    there = paths[0] != NOWHERE
    if logs:
        sure, left = np.zeros(paths.shape[::-1]), np.flatnonzero(there)
    else:
        sure, unknown = confidences(lanes, paths, penalty)
        left = np.flatnonzero(unknown & there)
        if len(left):
            steps = int(lanes.sizes[left[0]])
            sure[left, :steps], still = confidences(Lanes(lanes.model, batch.take(pa.array(left))), paths[:steps, left], penalty, np.longdouble)
            left = left[still]
    for k in left.tolist():
        scores = {c: loaded_scores(batch.column(c).slice(k, 1))[0] for c in ("donor", "acceptor", "start") if c in batch.schema.names}
        codes = LETTER[paths[: lanes.sizes[k], k]].astype(np.int64) - 65
        sure[k, : len(codes)] = confidence(posteriors(lanes.model, [matrix(lanes.model, batch.column("seq")[k].as_py(), **scores)], penalty)[0], codes)
    return sure


def path_scores(lanes: Lanes, states: np.ndarray, penalty: float, piece: int) -> np.ndarray:
    """Of each lane, as `decode.path_score` gives them; states: codes along all paths, lane after lane. Summed piece by piece, as those of long intervals are."""
    offsets, trans = lanes.offsets, lanes.model.trans
    emitted = tables(lanes.model)[states, lanes.code]
    for name, family in (("donor", t.DONOR), ("acceptor", t.ACCEPTOR), ("start", t.START_CODON[:1])):
        at, value = lanes.signals[name]
        here = np.isin(states[at], list(family))
        emitted[at[here]] = value[here]
    prior = np.concatenate(([t.START], states[:-1])) if len(states) else states
    prior[offsets[:-1][lanes.sizes > 0]] = t.START
    value, entered = emitted + trans[prior, states], (prior == t.INTERGENIC) & (states == t.START_CODON[0])
    out = np.zeros(len(lanes.sizes))
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, b, piece):
            to = min(b, at + piece)
            out[k] += value[at:to].sum() - penalty * entered[at:to].sum()
    return out


def solved(model: Model, batch: pa.RecordBatch, penalty: float, shortest: int, longest: int, pmf: np.ndarray | None, with_confidence: bool, piece: int, logs: bool = False) -> pa.RecordBatch:
    """The rows of a batch, from the longest to the shortest, with `path`, `score` and `confidence`."""
    lanes = Lanes(model, batch)
    rows, letters, sure = batch.num_rows, np.zeros(0, np.uint8), np.zeros(0)
    if lanes.n:
        paths = best_paths(lanes, penalty, shortest, longest, pmf)
        there = np.arange(lanes.steps) < lanes.sizes[: lanes.n, None]
        letters = LETTER[np.ascontiguousarray(paths.T)[there]]
        if with_confidence:
            sure = sure_of(lanes, paths, penalty, batch, logs)[there]
    offsets = pa.array(lanes.offsets.astype(np.int32))
    path = pa.StringArray.from_buffers(rows, pa.py_buffer(lanes.offsets.astype(np.int32)), pa.py_buffer(letters))
    score = path_scores(lanes, letters.astype(np.int64) - 65, penalty, piece)
    sure_lists = pa.ListArray.from_arrays(offsets if with_confidence else pa.array(np.zeros(rows + 1, np.int32)), pa.array(sure))
    return pa.RecordBatch.from_arrays([*batch.columns, path, pa.array(score), sure_lists], [*batch.schema.names, "path", "score", "confidence"])
