"""Gene records from decoded paths: nested intervals, strand mapping, merge, ids, and the browser's queries on them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import topology as t
from ..storage import discard, stored
from .counting import flat, place_in_row, runs, slices
from .decode import Model, columns_sql, decode
from .prefix import ranked

GENE, CODING, INTRONIC, BODY = (t.letters(c) for c in ((*t.CODING, *t.INTRONIC), t.CODING, t.INTRONIC, t.INTRON))


def label_of(letter: Column) -> Column:
    out = F.lit(None).cast("string")
    for code in range(21):
        out = F.when(letter == t.letter(code), t.label(code)).otherwise(out)
    return out


def label_confidence(paths: DataFrame) -> DataFrame:
    """(label, bases, confidence): the mean confidence of the bases of each label along `paths` (path, confidence)."""
    labels = sorted({t.label(code) for code in range(21)})
    of = np.array([labels.index(t.label(code)) for code in range(21)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(labels), np.int64), np.zeros(len(labels))
        for batch in batches:
            own = of[flat(batch.column("path"))[0].astype(np.int64) - ord(t.letter(0))]
            n += np.bincount(own, minlength=len(labels))
            total += np.bincount(own, batch.column("confidence").flatten().to_numpy(zero_copy_only=False), len(labels))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()).take(pa.array(at)), pa.array(n[at]), pa.array(total[at])], ["label", "n", "total"])

    sums = paths.select("path", "confidence").mapInArrow(run, "label string, n long, total double")
    return sums.groupBy("label").agg(F.sum("n").alias("bases"), (F.sum("total") / F.sum("n")).alias("confidence"))


def base_confidences(paths: DataFrame) -> DataFrame:
    """`paths` (scaffold, path, confidence) with the position (from 1), the state's label and the confidence of every base in place of path and confidence."""
    states = pa.array([t.label(code) for code in range(21)], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = flat(batch.column("path"))
            sure, ends = batch.column("confidence"), pa.array(offsets.astype(np.int32))
            if (sure.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) != np.diff(offsets)).any():
                raise ValueError("path and confidence differ in length")
            base = pa.StructArray.from_arrays([pa.array((place_in_row(offsets) + 1).astype(np.int32)), states.take(pa.array(data.astype(np.int64) - ord(t.letter(0)))), sure.flatten()], ["position", "state", "confidence"])
            yield pa.RecordBatch.from_arrays([batch.column("scaffold"), pa.ListArray.from_arrays(ends, base)], ["scaffold", "confidence"])

    return paths.select("scaffold", "path", "confidence").mapInArrow(run, f"scaffold {dict(paths.dtypes)['scaffold']}, confidence array<struct<position: int, state: string, confidence: double>>")


def among(codes: str) -> np.ndarray:
    """Which bytes are one of the letters."""
    out = np.zeros(256, bool)
    out[np.frombuffer(codes.encode(), np.uint8)] = True
    return out


RUN = "array<struct<start: int, end: int>>"
RECORD = f"strand string, fwd_start int, fwd_end int, start int, end int, exons {RUN}, introns {RUN}, intron_count int, sequence string, confidence array<struct<position: int, state: string, confidence: double>>, path_start int, path_end int"


def gene_records(paths: DataFrame, strand: str, with_confidence: bool = True, scored: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], list[float]] | None = None) -> DataFrame:
    """One row for each maximal gene run of `paths` (species, scaffold, seq, path, confidence): fwd_start, fwd_end (0-based, half-open), the record's
    1-based closed start and end, exons, introns, intron_count (runs of intron body), sequence and confidence by base (null where a path has none;
    without `with_confidence` there is no such column). Rows of strand - hold the reverse complement; their coordinates are turned to the forward strand here.
    scored: gives the genes a `score`, from their rows of a batch of `paths` (with donor, acceptor, start) and their starts and ends in these.
    The genes of many paths are found together, in time linear in their bases."""
    signals = ["donor", "acceptor", "start"] if scored else []
    rows = paths.where(F.length("path") > 0).select("species", "scaffold", "seq", "path", *(["confidence"] if with_confidence else []), *signals)
    minus, states = strand == "-", pa.array([t.label(code) for code in range(21)], pa.string())
    masks = {k: among(v) for k, v in (("gene", GENE), ("exons", CODING), ("introns", INTRONIC), ("body", BODY))}

    def records(batch: pa.RecordBatch) -> pa.RecordBatch:
        (data, offsets), (seq, ends) = flat(batch.column("path")), flat(batch.column("seq"))
        if (offsets != ends).any():
            raise ValueError("path and sequence differ in length")
        inside = masks["gene"][data]
        a, b = runs(inside, offsets)
        row = np.searchsorted(offsets, a, side="right") - 1
        n, first, size = np.diff(offsets)[row], offsets[row], b - a
        start, end = a - first, b - first
        cuts = np.concatenate(([0], np.cumsum(size)))
        ints = lambda x: pa.array(np.asarray(x).astype(np.int32))

        def placed(kind: str) -> pa.Array:
            """Runs inside the genes as 1-based closed forward intervals, sorted by start."""
            x, y = runs(masks[kind][data], offsets)
            gene = np.searchsorted(a, x, side="right") - 1
            x, y = x - first[gene], y - first[gene]
            left, right = (n[gene] - y + 1, n[gene] - x) if minus else (x + 1, y)
            order = np.lexsort((left, gene))
            return pa.ListArray.from_arrays(ints(np.searchsorted(gene, np.arange(len(a) + 1))), pa.StructArray.from_arrays([ints(left[order]), ints(right[order])], ["start", "end"]))

        bodies = np.bincount(np.searchsorted(a, runs(masks["body"][data], offsets)[0], side="right") - 1, minlength=len(a))
        letters = pa.StringArray.from_buffers(len(a), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(seq[inside]))
        fwd_start, fwd_end = (n - end, n - start) if minus else (start, end)
        out = [batch.column("species").take(pa.array(row)), batch.column("scaffold").take(pa.array(row)), pa.array([strand] * len(a), pa.string()), ints(fwd_start), ints(fwd_end), ints(fwd_start + 1), ints(fwd_end), placed("exons"), placed("introns"), ints(bodies), letters]
        names = ["species", "scaffold", "strand", "fwd_start", "fwd_end", "start", "end", "exons", "introns", "intron_count", "sequence"]
        if with_confidence:
            sure, there = np.zeros(len(data)), np.zeros(len(data), bool)
            column = batch.column("confidence")
            sizes, values = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
            fits = sizes == np.diff(offsets)
            there[:] = np.repeat(fits, np.diff(offsets))
            sure[there] = values[np.repeat(fits, sizes)]
            at, gene = np.flatnonzero(inside), np.repeat(np.arange(len(a)), size)
            if minus:  # from the last base back
                at = at[cuts[gene] + cuts[gene + 1] - 1 - np.arange(len(at))]
            pos = at - first[gene]
            base = pa.StructArray.from_arrays([ints(n[gene] - pos if minus else pos + 1), states.take(pa.array(data[at].astype(np.int64) - ord(t.letter(0)))), pa.array(sure[at], mask=~there[at])], ["position", "state", "confidence"])
            out.append(pa.ListArray.from_arrays(ints(cuts), base))
            names.append("confidence")
        more = [pa.array(scored(batch, row, start, end), pa.float64())] if scored else []
        return pa.RecordBatch.from_arrays([*out, ints(start), ints(end), *more], [*names, "path_start", "path_end", *(["score"] if scored else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield records(batch)

    kinds = dict(rows.dtypes)
    kept = RECORD if with_confidence else RECORD.replace("confidence array<struct<position: int, state: string, confidence: double>>, ", "")
    return rows.mapInArrow(run, f"species {kinds['species']}, scaffold {kinds['scaffold']}, {kept}{', score double' if scored else ''}")


def merge_strands(genes: DataFrame) -> DataFrame:
    """Genes of both strands of a scaffold without overlaps. In the order of (fwd_start, fwd_end) a gene evicts the kept ones that it overlaps, from the last
    back, as long as its score is strictly higher; the first that resists drops it. Genes that don't overlap, also not by way of others, can't meet: a
    running maximum of the ends cuts a scaffold into clusters, which are dealt over all tasks and swept in order, so the work is linear and only the kept
    genes of one cluster are held. A missing score is the lowest."""
    cols = genes.columns
    w = Window.partitionBy("species", "scaffold").orderBy("fwd_start", "fwd_end", "strand", F.desc("score"))
    reach = F.max("fwd_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = genes.withColumn("first_", (F.coalesce(reach, F.col("fwd_start")) <= F.col("fwd_start")).cast("int"))
    clustered = marked.withColumn("cluster_", F.sum("first_").over(w)).drop("first_")
    near = ["species", "scaffold", "cluster_"]
    order = [*near, "fwd_start", "fwd_end", "strand", F.desc("score")]
    rows = clustered.repartition(*near).sortWithinPartitions(*order)
    return rows.mapInArrow(sweep, columns_sql(rows)).select(*cols)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The genes that stay, of clusters (species, scaffold, cluster_) in order."""
    cluster, kept, done = None, [], []  # of kept ones: their batch, place, end and score

    def taken() -> Iterator[pa.RecordBatch]:
        for _, rows in itertools.groupby(done, key=lambda g: id(g[0])):
            rows = list(rows)
            yield rows[0][0].take(pa.array([g[1] for g in rows]))
        done.clear()

    for batch in batches:
        values = [batch.column(c).to_pylist() for c in ("species", "scaffold", "cluster_", "fwd_start", "fwd_end", "score")]
        for i, (*own, start, end, score) in enumerate(zip(*values, strict=True)):
            score = float("-inf") if score is None else score
            if own != cluster:
                done += kept
                cluster, kept = own, []
            while kept and kept[-1][2] > start and score > kept[-1][3]:
                kept.pop()
            if not kept or kept[-1][2] <= start:
                kept.append((batch, i, end, score))
        yield from taken()
    done += kept
    yield from taken()


def number_genes(genes: DataFrame) -> DataFrame:
    """Adds id pred_0001, pred_0002, ... in the order of species, scaffold and start."""
    text = F.col("rank_").cast("string")
    numbered = ranked(genes, ["species", "scaffold", "start", "end", "strand"])
    return numbered.withColumn("id", F.concat(F.lit("pred_"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))).drop("rank_")


def predict(sequences: DataFrame, model: Model, penalty: float = 1.0, minus: bool = True, dealt: bool = False, with_confidence: bool = True) -> DataFrame:
    """Numbered genes, with or without the confidence of every base, of `sequences` (dealt: over all cores; species, scaffold, sequence, and donor, acceptor, start scores for each strand as arrays of struct<pos, score>:
    columns donor, acceptor, start and donor_minus, acceptor_minus, start_minus)."""
    from ..functions.sequence import reverse_complement

    plus = sequences.select("species", "scaffold", F.col("sequence").alias("seq"), "donor", "acceptor", "start")
    parts = [("+", plus)]
    if minus:
        parts.append(("-", sequences.select("species", "scaffold", reverse_complement(F.col("sequence")).alias("seq"), F.col("donor_minus").alias("donor"), F.col("acceptor_minus").alias("acceptor"), F.col("start_minus").alias("start"))))
    found = None
    for strand, rows in parts:
        # one strand's letters and scores lie on disk at a time; records are written once, and only what strands are merged and genes numbered by goes on from there
        rows = stored(rows)
        some = stored(decoded_genes(decode(rows, model, penalty, with_confidence=with_confidence, dealt=dealt), model, penalty, strand, with_confidence).withColumn("record_", F.monotonically_increasing_id()))
        discard(rows)
        found = some if found is None else found.unionByName(some)
    kept = number_genes(merge_strands(found.select("species", "scaffold", "strand", "fwd_start", "fwd_end", "start", "end", "score", "record_")))
    return found.join(kept.select("strand", "record_", "id"), ["strand", "record_"]).drop("record_")


def decoded_genes(paths: DataFrame, model: Model, penalty: float, strand: str, with_confidence: bool = True) -> DataFrame:
    """Gene records of decoded rows of known species and scaffold, with the score of each gene's part of the path."""
    from .decode import codes_of, path_score
    from .emission import BEFORE_PART, BEHIND_PART, loaded_scores, part_matrix

    def scored(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[float]:
        loaded, out, of = {c: loaded_scores(batch.column(c)) for c in ("donor", "acceptor", "start")}, [], None
        for i, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
            if i != of:
                of, seq, path = i, batch.column("seq")[i].as_py(), batch.column("path")[i].as_py()
                by_place = {c: None if x[i] is None else tuple(v[np.argsort(x[i][0], kind="stable")] for v in x[i]) for c, x in loaded.items()}
            # only the letters around a gene and the scores in it are looked at
            first, behind = a - BEFORE_PART if a >= BEFORE_PART else 0, b + BEHIND_PART
            near = {c: None if x is None else (x[0][slice(*np.searchsorted(x[0], (first, behind)))] - first, x[1][slice(*np.searchsorted(x[0], (first, behind)))]) for c, x in by_place.items()}
            e = part_matrix(model, seq[first:behind], a - first, b - a, **near)
            out.append(path_score(model, e, codes_of(path[a:b]), penalty, before=ord(path[a - 1]) - 65 if a else t.START))
        return out

    return gene_records(paths.where("species is not null and scaffold is not null"), strand, with_confidence, scored)


def summary(genes: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row: bases, scaffolds, genes, exons, introns (sum of intron_count)."""
    s = sequences.agg(F.sum(F.length("sequence").cast("long")).alias("bases"), F.count(F.lit(1)).alias("scaffolds"))
    g = genes.agg(F.count(F.lit(1)).alias("genes"), F.coalesce(F.sum(F.size("exons").cast("long")), F.lit(0)).alias("exons"), F.coalesce(F.sum(F.col("intron_count").cast("long")), F.lit(0)).alias("introns"))
    return s.crossJoin(g)  # one row each


# the result browser

def search(genes: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    return genes.where(F.contains(F.lower("id"), F.lit(q)) | F.contains(F.lower(F.col("scaffold").cast("string")), F.lit(q)))


def in_range(genes: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Overlap with optional bounds; two bounds in the wrong order are swapped."""
    if lo is not None and hi is not None:
        lo, hi = min(lo, hi), max(lo, hi)
    if lo is not None:
        genes = genes.where(F.col("end") >= lo)
    return genes if hi is None else genes.where(F.col("start") <= hi)


def page(genes: DataFrame, number: int, size: int = 10, order: tuple[str, ...] = ("id",)) -> DataFrame:
    return genes.orderBy(*order).offset((number - 1) * size).limit(size)


def locus(start: Column, end: Column, strand: Column) -> dict[str, Column]:
    minus = strand == "-"
    return {"start_codon": F.when(minus, end - 2).otherwise(start), "stop_codon": F.when(minus, start).otherwise(end - 2), "length": end - start + 1}


def highlight(seq: Column) -> dict[str, Column]:
    short = F.length(seq) <= 6
    return {"head": F.when(short, seq).otherwise(F.left(seq, F.lit(3))), "middle": F.when(short, "").otherwise(F.substr(seq, F.lit(4), F.length(seq) - 6)), "tail": F.when(short, "").otherwise(F.right(seq, F.lit(3)))}


def clamp_view(start: Column, end: Column, length: Column, least: int = 5, most: int = 500_000) -> tuple[Column, Column]:
    """A view inside the scaffold, `least` to `most` bases wide."""
    a = F.greatest(F.lit(1), F.least(start, length))
    width = F.least(F.greatest(end - a + 1, F.lit(least)), F.lit(most), length)
    a = F.greatest(F.lit(1), F.least(a, length - width + 1))
    return a, a + width - 1


def range_message(start: Column, end: Column, length: Column, least: int = 5, most: int = 500_000) -> Column:
    """Why a typed range is refused, or null."""
    return F.when(start.isNull() | end.isNull(), "Enter both a start and an end.").when(start > end, "Start must not lie behind end.").when((start < 1) | (end > length), "The range leaves the scaffold.").when(end - start + 1 < least, f"Show at least {least} bases.").when(end - start + 1 > most, f"Show at most {most} bases.")


def focus_view(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """A gene with a quarter of its length on both sides."""
    pad = F.ceil((end - start + 1) * 0.25)
    return F.greatest(F.lit(1), start - pad), F.least(length, end + pad)


def track(start: Column, end: Column, view_start: Column, view_end: Column) -> tuple[Column, Column]:
    """Left edge and width in per cent of the view."""
    span = (view_end - view_start + 1).cast("double")
    return (start - view_start) / span * 100, (end - start + 1) / span * 100


def base_under(pointer: Column, view_start: Column, view_end: Column) -> Column:
    """The base at a share (0 to 1) of the view's width."""
    return view_start + F.least(F.floor(F.least(F.greatest(pointer, F.lit(0.0)), F.lit(1.0)) * (view_end - view_start + 1)), view_end - view_start)


def regional_confidence(genes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, start, end, confidence): runs of adjacent positions with one state, and their mean confidence, of the bases in all `confidence` of
    a key. A record's own runs are found in one pass; only these, not the bases, are then sorted to join those that meet."""
    kinds = dict(genes.dtypes)

    def own_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("confidence")
        base, offsets = column.flatten(), np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        position = base.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = base.field(1).dictionary_encode()
        state = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        value = base.field(2).to_numpy(zero_copy_only=False).astype(float)
        known = ~np.isnan(value)
        new = np.zeros(len(position) + 1, bool)
        new[offsets] = True
        new[1:-1] |= (np.diff(position) != 1) | (np.diff(state) != 0)
        edge = np.flatnonzero(new[:-1])
        last = np.append(edge[1:], len(position)) - 1 if len(edge) else edge
        sums = lambda x: np.add.reduceat(x, edge) if len(edge) else np.zeros(0)
        row = np.searchsorted(offsets, edge, side="right") - 1
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), base.field(1).take(pa.array(edge)), pa.array(position[edge].astype(np.int32)), pa.array(position[last].astype(np.int32)), pa.array(sums(np.where(known, value, 0.0))), pa.array(sums(known.astype(np.int64)).astype(np.int64))], [*keys, "state", "start", "end", "total", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield own_runs(batch)

    pieces = genes.select(*keys, "confidence").mapInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "state string, start int, end int, total double, n long")
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.lag("state").over(w).isNull() | (F.lag("state").over(w) != F.col("state")) | (F.lag("end").over(w) != F.col("start") - 1)
    joined = pieces.withColumn("run", F.sum(new.cast("int")).over(w)).groupBy(*keys, "run", "state")
    return joined.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.try_divide(F.sum("total"), F.sum("n")).alias("confidence")).drop("run")
