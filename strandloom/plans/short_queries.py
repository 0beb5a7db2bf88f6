"""The decoders on the texts of `benchmark`, read as short sequences, with recursive SQL that decodes the same texts base by base.

The model is the one that the other queries fit, from all usable intervals. Scores are multiples of a quantum on both sides (see `operators.decode`), so both pick the
same path among equally good ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import topology as t
from ..operators import decode, genes, model, prefix
from ..sinks import files as sinks
from ..sources import adapters, files
from ..storage import shared_folder, stored
from .annotation_queries import CTX5, FAMILY, training
from .annotation_queries import RUNS as INTRON_RUNS
from .decode_queries import EMIT, PENALTY, fitted, score_sql, with_scores
from .oracle import SEQ, usable
from .registry import query

START_BIAS = 12.0  # high, so that the short texts have genes


def sequences(spark, sf) -> DataFrame:
    """(species, scaffold, seq and scores): a benchmark text is a scaffold."""
    texts = adapters.table(spark, sf, "benchmark").select(F.lit("benchmark").alias("species"), F.col("item_id").alias("scaffold"), adapters.sequence_of(F.col("text")).alias("sequence"))
    return with_scores(texts.where(F.length("sequence") > 0)).withColumnRenamed("sequence", "seq")


def decoded(spark, sf, penalty: float = PENALTY, intervals: DataFrame | None = None, **kw) -> DataFrame:
    return decode.decode(sequences(spark, sf), fitted(spark, sf, intervals, start_bias=START_BIAS), penalty, **kw)


WHOLE = "(round(({}) * 16777216) / 16777216)"

BENCH_SEQ = SEQ.replace("seqs as", "bt as").replace("lang as species", "'benchmark' as species").replace("doc_id", "item_id").replace("from documents", "from benchmark")
# lt: log transitions as fitted; em: emissions of every possible state at every base
EMISSIONS = f"""{EMIT}, {FAMILY},
gr as (select family, c.range as ctx, b.range as base from (select unnest(['intergenic', 'intron', 'exon_1', 'exon_2', 'exon_3']) as family, unnest([4, 4, 1024, 1024, 1024]) as n), range(1024) c, range(4) b where c.range < n),
mk as materialized (select family, ctx, base, ln((coalesce(cnt, 0) + 0.1) / (sum(coalesce(cnt, 0)) over (partition by family, ctx) + 0.4)) as lp from gr left join fg using (family, ctx, base)),
{BENCH_SEQ},
b0 as (select scaffold, length(sequence) as n, unnest(range(length(sequence))) as pos, unnest(string_split(sequence, '')) as base from bt),
b1 as (select *, lag(base) over w as b1, lag(base, 2) over w as b2, lead(base) over w as n1, lead(base, 2) over w as n2,
  lag(base,5) over w || lag(base,4) over w || lag(base,3) over w || lag(base,2) over w || lag(base,1) over w as ctx5 from b0 window w as (partition by scaffold order by pos)),
b2 as (select *, instr('ACGT', base) - 1 as c, instr('ACGT', b1) - 1 as c1, {CTX5} as c5 from b1),
em0 as (select scaffold, pos, 1 as state, case when pos = 0 then ln(0.25) else lp end as lp from b2 left join mk on family = 'intergenic' and ctx = c1 and mk.base = c
  union all select scaffold, pos, s.range, case when pos = 0 then ln(0.25) else lp end from range(11, 14) s, b2 left join mk on family = 'intron' and ctx = c1 and mk.base = c
  union all select scaffold, pos, s.range, case when pos < 5 then ln(0.25) else lp end from range(5, 8) s join b2 on true left join mk on family = 'exon_' || (s.range - 4) and ctx = c5 and mk.base = c
  union all select scaffold, pos, 2, {score_sql(adapters.START)} + ({START_BIAS}) from b2 where base = 'A' and n1 = 'T' and n2 = 'G'
  union all select scaffold, pos, s.range, {score_sql(adapters.DONOR)} from range(8, 11) s, b2 where base = 'G' and n1 = 'T'
  union all select scaffold, pos, s.range, {score_sql(adapters.ACCEPTOR)} from range(14, 17) s, b2 where base = 'G' and b1 = 'A'
  union all select scaffold, pos, s, 0.0 from b2, (select unnest([3, 17]) as s) where base = 'T'
  union all select scaffold, pos, 4, 0.0 from b2 where base = 'G'
  union all select scaffold, pos, 18, ln(0.5) from b2 where base in ('A', 'G')
  union all select scaffold, pos, 19, 0.0 from b2 where b2 || b1 || base in ('TAA', 'TAG', 'TGA')),
em as materialized (select scaffold, pos, state, lp, {WHOLE.format("lp")} as w from em0),
lt as materialized (select f, t, lp, {WHOLE.format("lp")} as w from tl),
size_b as (select scaffold, length(sequence) as n from bt)"""


def best_paths(name: str, penalty: float, bounded: bool = False) -> str:
    """{name}(scaffold, path, raw): the best path of every text and its score; bounded: introns by their lengths (cap, pmf)."""
    body = "case when x.t between 11 and 13 then case when x.f = x.t then x.body + 1 else 1 end else 0 end"
    loop = "case when l.f = l.t and l.f between 11 and 13 then 0.0 else l.w end" if bounded else "l.w"
    leave = "+ case when l.t between 14 and 16 then (select w from pmf where length = least(v.body, cap.longest)) else 0.0 end" if bounded else ""
    stay = "and not (l.f = l.t and l.f between 11 and 13 and v.body >= cap.longest)" if bounded else ""
    cap = ", cap" if bounded else ""
    own = f"case when l.f = 1 and l.t = 2 then {penalty} else 0.0 end"
    return f"""{name}_v(scaffold, pos, state, score, raw, body, path) as (
  select e.scaffold, 0, e.state, l.w + e.w, l.lp + e.lp, case when e.state between 11 and 13 then 1 else 0 end, chr((65 + e.state)::int) from em e join lt l on l.f = 0 and l.t = e.state where e.pos = 0
  union all
  select x.scaffold, x.pos, x.t, x.best.score, x.best.raw, {body.replace("x.f", "x.best.f").replace("x.body", "x.best.body")}, x.best.path || chr((65 + x.t)::int)
  from (select v.scaffold, v.pos + 1 as pos, l.t, arg_max({{'score': v.score + {loop} - {own} {leave} + e.w, 'raw': v.raw + l.lp - {own} + e.lp, 'f': l.f, 'body': v.body, 'path': v.path}}, (v.score + {loop} - {own} {leave} + e.w, -l.f)) as best
    from {name}_v v join lt l on l.f = v.state and l.t between 1 and 19 join em e on e.scaffold = v.scaffold and e.pos = v.pos + 1 and e.state = l.t {cap} where true {stay} group by v.scaffold, v.pos + 1, l.t) x),
{name} as (select v.scaffold, arg_max(v.path, (v.score + l.w, -v.state)) as path, arg_max(v.raw, (v.score + l.w, -v.state)) as raw
  from {name}_v v join size_b z on z.scaffold = v.scaffold and v.pos = z.n - 1 join lt l on l.f = v.state and l.t = 20 group by v.scaffold)"""


def recursive(tail: str) -> str:
    return usable(tail).replace("with ", "with recursive ", 1)


@query("dec_viterbi_short", recursive(f"{EMISSIONS}, {best_paths('vb', PENALTY)} select scaffold, path, round(raw, 6) as score from vb"))
def dec_viterbi_short(spark, sf):
    """Also emt_dispatch, emt_markov1 and emt_markov5."""
    return decoded(spark, sf, with_confidence=False).select("scaffold", "path", F.round("score", 6).alias("score"))


def score_files(spark, sf) -> str:
    """A folder with the benchmark texts' scores as text files: `splice` and `start`, positions in the concatenation of the texts."""
    rows = sequences(spark, sf).withColumn("n", F.length("seq").cast("long"))
    at = prefix.ranked(rows, ["scaffold"], {"upto": F.col("n")}).withColumn("offset", F.col("upto") - F.col("n"))
    folder = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    score = lambda c: F.coalesce(c, F.lit(0.0)).cast("string")
    each = lambda kind: at.select("offset", F.explode(kind).alias("x")).select((F.col("offset") + F.col("x.pos")).alias("pos"), F.col("x.score").alias(kind))
    splice = each("donor").join(each("acceptor"), "pos", "full").select(F.concat_ws("\t", F.col("pos").cast("string"), score(F.col("donor")), score(F.col("acceptor"))))
    splice.repartition(3).write.text(f"{folder}/splice")
    each("start").select(F.concat_ws("\t", F.col("pos").cast("string"), score(F.col("start")))).repartition(2).write.text(f"{folder}/start")
    return folder


def loaded(spark, sf) -> DataFrame:
    """The sequences with scores read from files."""
    folder, rows = score_files(spark, sf), sequences(spark, sf).select("species", "scaffold", "seq")
    ranges = prefix.ranked(rows.select("scaffold", F.length("seq").cast("long").alias("n")), ["scaffold"], {"end": F.col("n")}).select(F.lit("all").alias("file"), F.col("scaffold").alias("name"), (F.col("end") - F.col("n")).alias("start"), "end")
    for kind, names in (("splice", ("donor", "acceptor")), ("start", ("start",))):
        lines = files.read_score_lines(spark, f"{folder}/{kind}").withColumn("file", F.lit("all"))
        packed = files.pack_scores(lines, ranges, names).withColumnRenamed("name", "scaffold")
        rows = files.with_packed(rows, packed, names, ["scaffold"])
    return rows


@query("dec_viterbi_loaded", recursive(f"{EMISSIONS}, {best_paths('vb', PENALTY)} select scaffold, path, round(raw, 6) as score from vb"))
def dec_viterbi_loaded(spark, sf):
    """Also emt_load_and_calibrate: scores written to and read from files, packed by scaffold, then decoded."""
    found = decode.decode(loaded(spark, sf), fitted(spark, sf, start_bias=START_BIAS), PENALTY, with_confidence=False)
    return found.select("scaffold", "path", F.round("score", 6).alias("score"))


@query("emt_load_and_calibrate", f"""with {BENCH_SEQ}, b0 as (select scaffold, unnest(range(length(sequence))) as pos, unnest(string_split(sequence, '')) as base from bt),
b1 as (select *, lag(base) over w as b1, lead(base) over w as n1, lead(base, 2) over w as n2 from b0 window w as (partition by scaffold order by pos))
select scaffold, count(*) filter (where base = 'G' and n1 = 'T') as donors, round(coalesce(sum({score_sql(adapters.DONOR)}) filter (where base = 'G' and n1 = 'T'), 0), 6) as donor,
  round(coalesce(sum({score_sql(adapters.ACCEPTOR)}) filter (where base = 'G' and b1 = 'A'), 0), 6) as acceptor, count(*) filter (where base = 'A' and n1 = 'T' and n2 = 'G') as starts,
  round(coalesce(sum(0.75 * {score_sql(adapters.START)} + ({START_BIAS})) filter (where base = 'A' and n1 = 'T' and n2 = 'G'), 0), 6) as start from b1 group by scaffold""")
def emt_load_and_calibrate(spark, sf):
    """Loaded scores by scaffold, start scores calibrated."""
    total = lambda c, f: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x["score"])), 6)
    fits = lambda motif: F.regexp_count("seq", F.lit(motif)).cast("long")
    same = lambda x: x
    return loaded(spark, sf).select("scaffold", fits("GT").alias("donors"), total("donor", same).alias("donor"), total("acceptor", same).alias("acceptor"), F.size("start").cast("long").alias("starts"), total("start", lambda x: 0.75 * x + START_BIAS).alias("start"))


@query("dec_gene_penalty_short", recursive(f"{EMISSIONS}, {best_paths('none', 0.0)}, {best_paths('high', 5.0)}, both_ as (select 0.0::double as penalty, path from none union all select 5.0, path from high) select penalty, cast(sum(len(regexp_extract_all(path, 'C'))) as bigint) as genes from both_ group by penalty"))
def dec_gene_penalty_short(spark, sf):
    count = lambda p: decoded(spark, sf, p, with_confidence=False).agg(F.sum(F.length(F.regexp_replace("path", f"[^{t.letter(2)}]", ""))).cast("long").alias("genes")).select(F.lit(p).alias("penalty"), "genes")
    return count(0.0).unionByName(count(5.0))


LENGTHS = f"""{INTRON_RUNS}, so as (select list(length order by length) as v from il), cap as materialized (select v[cast(floor(0.95 * (len(v) - 1)) as int) + 1] as longest from so),
pc as (select x.i as length, count(il.length) + 1 as c from (select unnest(range(1, longest + 1)) as i from cap) x left join il on il.length = x.i group by x.i),
pmf as materialized (select length, {WHOLE.format("ln(c / sum(c) over ())")} as w from pc)"""


@query("dec_intron_length_short", recursive(f"{EMISSIONS}, {LENGTHS}, {best_paths('vb', PENALTY, True)} select scaffold, path from vb"))
def dec_intron_length_short(spark, sf):
    """Also dec_duration."""
    iv = training(spark, sf)
    lengths = stored(model.intron_lengths(iv))
    cap = model.length_percentile(lengths, 0.95).first()[0]
    pmf = [r["log_p"] for r in model.length_pmf(lengths, cap).orderBy("length").collect()]  # cap + 1 numbers
    return decoded(spark, sf, intervals=iv, with_confidence=False, longest=cap, pmf=pmf).select("scaffold", "path")


ADD = "list_max(xs) + ln(list_sum(list_transform(xs, lambda y: exp(y - list_max(xs)))))"
SUMS = f"""fw(scaffold, pos, state, a) as (
  select e.scaffold, 0, e.state, l.lp + e.lp from em e join lt l on l.f = 0 and l.t = e.state where e.pos = 0
  union all select scaffold, pos, t, {ADD} from (select v.scaffold, v.pos + 1 as pos, l.t, list(v.a + l.lp - case when l.f = 1 and l.t = 2 then {PENALTY} else 0.0 end + e.lp) as xs
    from fw v join lt l on l.f = v.state and l.t between 1 and 19 join em e on e.scaffold = v.scaffold and e.pos = v.pos + 1 and e.state = l.t group by v.scaffold, v.pos + 1, l.t)),
bw(scaffold, pos, state, b) as (
  select z.scaffold, z.n - 1, l.f, l.lp from size_b z join lt l on l.t = 20 and l.f > 0
  union all select scaffold, pos, f, {ADD} from (select v.scaffold, v.pos - 1 as pos, l.f, list(v.b + e.lp + l.lp - case when l.f = 1 and l.t = 2 then {PENALTY} else 0.0 end) as xs
    from bw v join em e on e.scaffold = v.scaffold and e.pos = v.pos and e.state = v.state join lt l on l.t = v.state and l.f > 0 where v.pos > 0 group by v.scaffold, v.pos - 1, l.f)),
total as (select scaffold, {ADD} as z from (select fw.scaffold, list(a + lp) as xs from fw join size_b s on s.scaffold = fw.scaffold and pos = n - 1 join lt on f = state and t = 20 group by fw.scaffold)),
step as (select scaffold, unnest(range(length(path))) as pos, ascii(unnest(string_split(path, ''))) - 65 as state from vb)"""


@query("dec_confidence_short", recursive(f"""{EMISSIONS}, {best_paths('vb', PENALTY)}, {SUMS} select step.scaffold, cast(step.pos as int) as pos, cast(step.state as int) as state, round(least(1.0, greatest(0.0, exp(a + b - z))), 6) as confidence
from step join fw using (scaffold, pos, state) join bw using (scaffold, pos, state) join total using (scaffold)"""))
def dec_confidence_short(spark, sf):
    """Also dec_forward, dec_backward and dec_posterior: the posterior of the best path, base by base."""
    p = decoded(spark, sf).select("scaffold", F.posexplode(F.arrays_zip(F.split("path", "").alias("s"), F.col("confidence").alias("c"))).alias("pos", "x"))
    return p.where("x.c is not null").select("scaffold", "pos", t.code_of(F.col("x.s")).alias("state"), F.round("x.c", 6).alias("confidence"))


@query("prj_confidence_short", recursive(f"""{EMISSIONS}, {best_paths('vb', PENALTY)}, {SUMS}, sure as (select step.scaffold, step.pos, step.state, least(1.0, greatest(0.0, exp(a + b - z))) as c from step join fw using (scaffold, pos, state) join bw using (scaffold, pos, state) join total using (scaffold)),
lab_ as (select scaffold, pos, c, case when state between 2 and 4 then 'Start' when state between 17 and 19 then 'Stop' when state between 5 and 7 then 'UTR' else 'Intron' end as state from sure where state between 2 and 19),
run_ as (select *, pos - row_number() over (partition by scaffold, state order by pos) as g from lab_)
select scaffold, state, cast(min(pos) + 1 as int) as start, cast(max(pos) + 1 as int) as "end", round(avg(c), 6) as confidence from run_ group by scaffold, state, g"""))
def prj_confidence_short(spark, sf):
    """Also prj_gene_confidence and agg_regional_confidence: decoded genes' confidence by base, then by region."""
    records = genes.gene_records(decoded(spark, sf), "+")
    return genes.regional_confidence(records, ["scaffold"]).withColumn("confidence", F.round("confidence", 6))


@query("snk_prediction_document")
def snk_prediction_document(spark, sf):
    """The whole JSON document of the benchmark texts' predictions, written to files and read back: a row for each of its lines with the line's digest."""
    paths = stored(decoded(spark, sf, logs=True))  # all digits are written
    rows = sinks.prediction_document(genes.number_genes(genes.gene_records(paths, "+")), paths, "benchmark.fna")
    folder = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    sinks.write_document(rows, folder)
    back = spark.read.text(folder)
    kind = F.when(F.startswith("value", F.lit('{"summary"')), "summary").when(F.contains("value", F.lit('"sequence"')), "prediction").when(F.contains("value", F.lit('"name"')), "scaffold").when(F.contains("value", F.lit('"position"')), "confidence").otherwise("between")
    return back.select(kind.alias("kind"), F.length("value").alias("chars"), F.md5("value").alias("digest"))
