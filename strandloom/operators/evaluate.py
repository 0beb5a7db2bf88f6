"""Metrics of predicted against gold paths, start offsets and calibration search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import topology as t
from ..storage import stored
from .counting import confused, counted, edges_of
from .intervals import nearest, state_runs
from .prefix import ranked

WINDOW = 300
GROUP = 64  # candidates of a grid search that are decoded together


def confusion(paths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., pred, gold, cnt): every metric below comes from these at most 441 rows, so paths are read once."""
    cells = confused(paths.select(*(by or []), "pred", "gold"), by or [])
    letter = lambda code: F.char(code + ord(t.letter(0)))
    return cells.select(*(by or []), letter(F.floor(F.col("code") / 21)).alias("pred"), letter(F.col("code") % 21).alias("gold"), "cnt")


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("cnt"))), F.lit(0)).cast("long")


def binary_metrics(cells: DataFrame, codes, by: list[str] | None = None) -> DataFrame:
    p, g = t.one_of(F.col("pred"), codes), t.one_of(F.col("gold"), codes)
    return cells.groupBy(*(by or [])).agg(count_where(p & g).alias("tp"), count_where(p & ~g).alias("fp"), count_where(~p & g).alias("fn"), count_where(~p & ~g).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """precision, recall, f1, accuracy; an empty denominator gives 0."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}


BOUNDARIES = {"start": t.START_CODON[:1], "stop": t.STOP_CODON[2:], "donor": tuple(t.DONOR), "acceptor": tuple(t.ACCEPTOR)}


def boundary_metrics(cells: DataFrame) -> DataFrame:
    """(boundary, exact, predicted, gold): exact needs the same state, phase included, at the same base."""
    parts = []
    for name, codes in BOUNDARIES.items():
        p, g = t.one_of(F.col("pred"), codes), t.one_of(F.col("gold"), codes)
        parts.append(F.struct(F.lit(name).alias("boundary"), count_where(p & (F.col("pred") == F.col("gold"))).alias("exact"), count_where(p).alias("predicted"), count_where(g).alias("gold")))
    return cells.agg(F.array(*parts).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def illegal_transitions(paths: DataFrame, column: str) -> DataFrame:
    """One row: adjacent pairs of states that aren't edges."""
    cells = counted(paths.select(F.col(column).alias("states")), 441, edges_of)
    outside = [t.START * 21 + s for s in range(21)] + [s * 21 + t.END for s in range(21)]  # steps into and out of a path
    wrong = ~F.col("code").isin([a * 21 + b for a, b in t.EDGES] + outside)
    return cells.agg(F.coalesce(F.sum(F.when(wrong, F.col("cnt"))), F.lit(0)).cast("long").alias("illegal"))


def error_runs(paths: DataFrame, key: str) -> DataFrame:
    """(key, kind, start, end): maximal runs of false-positive and false-negative gene bases."""
    from .genes import GENE

    gene = lambda c: F.regexp_replace(F.translate(F.col(c), GENE, "1" * len(GENE)), "[^1]", "0")
    marked = paths.select(key, F.split(gene("pred"), "").alias("p"), F.split(gene("gold"), "").alias("g"))
    both = marked.select(key, F.array_join(F.zip_with("p", "g", lambda a, b: F.when((a == "1") & (b == "0"), "P").when((a == "0") & (b == "1"), "N").otherwise("-")), "").alias("m"))
    rows = [both.select(key, F.lit(kind).alias("kind"), F.explode(state_runs(F.col("m"), letter)).alias("r")) for kind, letter in (("false_positive", "P"), ("false_negative", "N"))]
    return rows[0].unionByName(rows[1]).select(key, "kind", "r.start", "r.end")


def start_runs(column: str) -> Column:
    return state_runs(F.col(column), t.letter(t.START_CODON[0]))


def start_positions(paths: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, pos) of the first bases of start codons."""
    return positions_in(paths.select(*keys, start_runs(column).alias("runs")), "runs", keys)


def positions_in(rows: DataFrame, runs: str, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.explode(runs).alias("r")).select(*keys, F.explode(F.sequence("r.start", F.col("r.end") - 1)).alias("pos"))


def start_offsets(paths: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Predicted starts with the signed offset to the closest gold one, and gold starts with theirs; null offset: none in the sequence. The paths are
    read once, and only their starts are kept."""
    starts = stored(paths.select(*keys, start_runs("pred").alias("p_runs"), start_runs("gold").alias("g_runs")))
    p, g = positions_in(starts, "p_runs", keys), positions_in(starts, "g_runs", keys)
    return nearest(p, g, keys), nearest(g, p, keys)


def offset_report(predicted: DataFrame, gold: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row of counts; the median is the upper one of the matched distances, found from counts by distance."""
    o, a = F.col("offset"), F.abs("offset")
    near = (a > 0) & (a <= window)
    bucket = lambda lo, hi: F.count_if(a.between(lo, hi))
    main = predicted.agg(F.count(F.lit(1)).alias("predicted"), F.count_if(o == 0).alias("exact"), F.count_if(near).alias("within_window"), F.count_if(o.isNull() | (a > window)).alias("spurious"), F.count_if(near & (o < 0)).alias("upstream"), F.count_if(near & (o > 0)).alias("downstream"), F.count_if(near & (o % 3 == 0)).alias("in_frame"), F.count_if(near & (o % 3 != 0)).alias("out_of_frame"), bucket(1, 2).alias("d_1_2"), bucket(3, 3).alias("d_3"), bucket(4, 9).alias("d_4_9"), bucket(10, 30).alias("d_10_30"), bucket(31, 100).alias("d_31_100"), bucket(101, window).alias("d_101_window"), F.histogram_numeric(F.when(near, a), F.lit(window + 1)).alias("h"))
    missed = gold.agg(F.count(F.lit(1)).alias("gold"), F.count_if(o.isNull() | (a > window)).alias("missed"))
    # at most `window` distinct distances, so the histogram holds each one's count
    upto = F.aggregate("h", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("median")), lambda acc, b: F.struct((acc["sum"] + b["y"]).alias("sum"), F.when(acc["median"].isNull() & (acc["sum"] + b["y"] > F.floor(F.col("within_window") / 2)), F.round(b["x"]).cast("long")).otherwise(acc["median"]).alias("median")), lambda acc: acc["median"])
    return main.withColumn("median_abs", F.when(F.col("within_window") > 0, upto).otherwise(F.lit(0).cast("long"))).drop("h").crossJoin(missed)  # one row each


def objective(intron_f1: Column, donor_f1: Column, acceptor_f1: Column) -> Column:
    return (intron_f1 + donor_f1 + acceptor_f1) / 3


def splice_grid(current: tuple[float, float, float, float] = (1.0, 0.0, 1.0, 0.0)) -> list[tuple[float, float, float, float]]:
    """(donor scale, donor bias, acceptor scale, acceptor bias): the current one, then 6 x 9 x 9."""
    scales = (0.35, 0.5, 0.75, 1.0, 1.25, 1.5)  # fixed values
    biases = [float(b) for b in range(-4, 5)]
    return [current, *((s, d, s, a) for s in scales for d in biases for a in biases)]


def start_grid() -> list[tuple[float, float]]:
    """(scale, bias) of 4 x 8 start candidates."""
    return [(s, float(b)) for s in (0.5, 0.75, 1.0, 1.25) for b in range(-6, 2)]


def grid_search(intervals: DataFrame, model, candidates: list[dict[str, float]], kind: str, penalty: float = 0.0, longest: int | None = None) -> DataFrame:
    """(candidate, objective) of every candidate, the best first; ties go to the earlier one. `intervals` (seq, donor, acceptor, start, gold) meet the
    candidates in groups of `GROUP`, which are dealt over all cores and decoded in lockstep; a row of counts returns for each candidate and interval."""
    from collections.abc import Iterator
    from dataclasses import replace

    import pyarrow as pa

    from .decode import BATCH_BASES, UNLIMITED, viterbi
    from .emission import matrix

    sets = {"intron": t.INTRONIC, "donor": tuple(t.DONOR), "acceptor": tuple(t.ACCEPTOR), "start": t.START_CODON[:1]}
    names = [f"{k}_{m}" for k in sets for m in ("hit", "pred", "gold")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not r["seq"]:
                    continue
                gold = np.frombuffer(r["gold"].encode(), np.uint8).astype(int) - 65
                loaded = [{x["pos"]: x["score"] for x in r[k] or ()} for k in ("donor", "acceptor", "start")]
                own, many = range(r["group"] * GROUP, min(len(candidates), (r["group"] + 1) * GROUP)), max(1, BATCH_BASES // len(gold))
                for at in range(own.start, own.stop, many):
                    some = range(at, min(own.stop, at + many))
                    # only emissions depend on the calibration
                    paths = viterbi(model, [matrix(replace(model, **candidates[i]), r["seq"], *loaded) for i in some], penalty, longest=longest or UNLIMITED)
                    for i, path in zip(some, paths, strict=True):
                        pred, counts = path.astype(int), []
                        for name, codes in sets.items():
                            p, g = np.isin(pred, codes), np.isin(gold, codes)
                            counts += [int((p & g & ((pred == gold) | (name == "intron"))).sum()), int(p.sum()), int(g.sum())]
                        out.append((i, *counts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["candidate", *names])

    session = intervals.sparkSession
    parts = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    dealt = intervals.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit((len(candidates) - 1) // GROUP)))).repartition(parts)
    cells = dealt.mapInArrow(run, "candidate long, " + ", ".join(f"{n} long" for n in names)).groupBy("candidate").agg(*(F.sum(n).alias(n) for n in names))
    f1 = lambda k: ratio(2 * F.col(f"{k}_hit"), F.col(f"{k}_pred") + F.col(f"{k}_gold"))
    value = f1("start") if kind == "start" else objective(f1("intron"), f1("donor"), f1("acceptor"))
    return cells.select("candidate", value.alias("objective")).orderBy(F.desc("objective"), "candidate")


def even_sample(rows: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """`limit` rows spread evenly: those with index i * n / limit, each once."""
    n = rows.count()
    if n <= limit:
        return rows
    wanted = rows.sparkSession.range(limit).select((F.floor(F.col("id") * n / limit) + 1).alias("rank_")).distinct()
    return ranked(rows, order).join(F.broadcast(wanted), "rank_").drop("rank_")  # limit rows


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: sum of the precision at each hit over the number of positives, by descending score (label, score, tie); NaN without positives."""
    r = ranked(scored.select("label", "score", "tie"), [F.desc("score"), "tie"], {"hits": F.col("label").cast("long")}, rank="rank")
    total = F.sum("label")
    return r.agg(F.when(total > 0, F.sum(F.when(F.col("label") == 1, F.col("hits") / F.col("rank"))) / total).otherwise(F.lit(float("nan"))).alias("average_precision"))


def prior_logit(label: Column) -> Column:
    p = F.least(F.greatest(F.avg(label), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The scale that makes logits / T best in cross-entropy: golden-section search over ln T."""
    y = np.asarray(labels, float)

    def loss(log_t: float) -> float:
        z = np.asarray(logits, float) / np.exp(log_t)
        return float((np.logaddexp(0, z) - y * z).mean())

    a, b, g = -5.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(80):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit_temperature_of(rows: DataFrame, logit: str, label: str, rounds: int = 7, steps: int = 20) -> float:
    """As fit_temperature, over all rows that have both columns, by aggregation: every scan sums the loss of a grid over ln T, which the next one
    refines between the neighbours of the best. The loss is convex in 1 / T, so the least one lies there."""
    z, y = F.col(logit), F.col(label)
    # ln(1 + e^z) without overflow
    total = lambda log_t: F.sum(F.greatest(z * float(np.exp(-log_t)), F.lit(0.0)) + F.log1p(F.exp(-F.abs(z * float(np.exp(-log_t))))) - y * z * float(np.exp(-log_t)))
    used = rows.where(z.isNotNull() & ~F.isnan(z) & y.isNotNull()).select(z.cast("double").alias(logit), y.cast("double").alias(label))
    a, b = -5.0, 5.0
    for _ in range(rounds):
        grid = np.linspace(a, b, steps + 1)
        sums = used.agg(*(total(g).alias(f"s{i}") for i, g in enumerate(grid))).first()
        if sums[0] is None:
            return float("nan")
        best = int(np.argmin(sums))
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, steps)]
    return float(np.exp((a + b) / 2))
