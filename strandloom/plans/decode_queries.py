"""Queries over emissions, decoding, gene records, exports, networks and the whole runs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import topology as t
from ..functions import sequence as sq
from ..operators import cnn, dataset, decode, emission, evaluate, genes, labels, model, stages
from ..operators import training as training_of
from ..sources import adapters
from ..sources.adapters import features, scaffolds
from ..sinks import files as sinks
from ..storage import file_system, shared_folder, stored
from .annotation_queries import start_examples, training
from .oracle import SEQ, labelled, usable
from .registry import query
from .sequence_queries import GENES, GFF

PENALTY = 1.0


def with_scores(rows: DataFrame, sequence: str = "sequence", key: str = "scaffold", suffix: str = "") -> DataFrame:
    """Sparse deterministic scores as arrays of struct<pos, score>: the left join of scores to bases, packed by interval."""
    found = adapters.scores_of(F.col(sequence), F.col(key))
    return rows.withColumns({f"{kind}{suffix}": found[kind] for kind in ("donor", "acceptor", "start")})


def fitted(spark, sf, intervals: DataFrame | None = None, **calibration) -> emission.Model:
    """The model of the usable intervals, or of those given."""
    return emission.Model.collect(model.fit(training(spark, sf) if intervals is None else intervals), **calibration)


# emission kernels as columns

NEIGHBOURS = "nb as (select scaffold, pos, base, lag(base) over w as p1, lag(base, 2) over w as p2, lead(base) over w as n1, lead(base, 2) over w as n2 from (select scaffold, unnest(range(length(sequence))) as pos, unnest(string_split(sequence, '')) as base from seqs) window w as (partition by scaffold order by pos))"


def score_sql(factor: int) -> str:
    return f"(cast((pos * {factor} + scaffold * 31) % 2001 - 1000 as double) / cast(250 as double))"


def signal(name: str, kind: str, factor: int, condition: str, scale: float, bias: float) -> None:
    @query(name, f"with {SEQ}, {NEIGHBOURS} select scaffold, count(*) as n, round(sum({scale} * {score_sql(factor)} + ({bias})), 6) as total from nb where {condition} group by scaffold")
    def run(spark, sf):
        rows = sq.around(scaffolds(spark, sf).select("scaffold", "sequence"))
        value = emission.signal_columns(adapters.score(F.col("pos"), F.col("scaffold"), factor), scale, bias)[kind]
        return rows.select("scaffold", value.alias("v")).where(F.col("v") > t.NEG_INF).groupBy("scaffold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


signal("emt_donor", "donor", adapters.DONOR, "base = 'G' and n1 = 'T'", 1.0, 0.0)
signal("emt_acceptor", "acceptor", adapters.ACCEPTOR, "base = 'G' and p1 = 'A'", 0.75, 1.0)
signal("emt_start", "start", adapters.START, "base = 'A' and n1 = 'T' and n2 = 'G'", 1.0, -6.0)


@query("emt_deterministic", f"with {SEQ}, {NEIGHBOURS} select scaffold, count(*) filter (where base = 'T') as start_2, count(*) filter (where base = 'G') as start_3, count(*) filter (where base = 'T') as stop_1, round(coalesce(sum(case when base in ('A', 'G') then ln(0.5) end), 0), 6) as stop_2, count(*) filter (where p2 || p1 || base in ('TAA', 'TAG', 'TGA')) as stop_3 from nb group by scaffold")
def emt_deterministic(spark, sf):
    rows = sq.around(scaffolds(spark, sf).select("scaffold", "sequence")).select("scaffold", *(c.alias(n) for n, c in emission.deterministic().items()))
    sure = lambda c: F.count_if(F.col(c) == 0)
    return rows.groupBy("scaffold").agg(*(sure(c).alias(c) for c in ("start_2", "start_3", "stop_1")), F.round(F.coalesce(F.sum(F.when(F.col("stop_2") > t.NEG_INF, F.col("stop_2"))), F.lit(0.0)), 6).alias("stop_2"), sure("stop_3").alias("stop_3"))


@query("jn_scores_bases", f"with {SEQ}, {NEIGHBOURS} select scaffold, count(*) as bases, round(sum(case when base = 'G' and n1 = 'T' then {score_sql(adapters.DONOR)} else 0.0 end), 6) as total from nb group by scaffold")
def jn_scores_bases(spark, sf):
    rows = sq.around(scaffolds(spark, sf).select("scaffold", "sequence"), before=0, after=1)
    sparse = rows.where(sq.IS_DONOR).select("scaffold", "pos", adapters.score(F.col("pos"), F.col("scaffold"), adapters.DONOR).alias("donor"))
    from ..sources.files import look_up

    return look_up(rows.select("scaffold", "pos"), sparse, ("donor",), ["scaffold", "pos"]).groupBy("scaffold").agg(F.count(F.lit(1)).alias("bases"), F.round(F.sum("donor"), 6).alias("total"))


# the log score of a gold path, base by base: emissions, transitions and penalty

EMIT = """bgl as (select f, t, count(*) as cnt from (select state as f, coalesce(nx, 20) as t from use union all select 0, state from use where i = 0) group by f, t),
tl as (select l.f, l.t, ln((coalesce(cnt, 0) + 0.02) / (sum(coalesce(cnt, 0)) over w + 0.02 * count(*) over w)) as lp from legal l left join bgl on bgl.f = l.f and bgl.t = l.t window w as (partition by l.f))"""


@query("dec_path_score", usable(f"""{EMIT}, x as (select scaffold, pos, i, state, lag(state) over (partition by scaffold, cutno order by pos) as prior from use)
select scaffold, round(sum(lp) - sum(case when prior = 1 and state = 2 then 1.0 else 0.0 end), 6) as score from x join tl on tl.f = coalesce(prior, 0) and tl.t = state group by scaffold"""))
def dec_path_score(spark, sf):
    """The transition part of the gold paths' scores, less the penalty for every gene, by joins alone."""
    iv = training(spark, sf)
    table = F.broadcast(model.transition_log_probs(model.bigram_counts(iv)).select("from_state", "to_state", "log_p"))  # 32 rows
    rows = sq.per_base(iv.select("scaffold", "states"), {"s": ("states", 0), "prior": ("states", -1)}).select("scaffold", F.coalesce(t.code_of(F.col("prior")), F.lit(t.START)).alias("from_state"), t.code_of(F.col("s")).alias("to_state"))
    entered = (F.col("from_state") == t.INTERGENIC) & (F.col("to_state") == t.START_CODON[0])
    return rows.join(table, ["from_state", "to_state"]).groupBy("scaffold").agg(F.round(F.sum("log_p") - F.sum(F.when(entered, PENALTY).otherwise(0.0)), 6).alias("score"))


AVERAGE = f"""nbr as (select *, lead(base) over w as n1, lead(base, 2) over w as n2, lag(base, 2) over w as p2 from use window w as (partition by scaffold, cutno order by pos)),
one as (select *, case when state = 1 then 1 when state between 11 and 13 then 2 end as family from nbr),
m1 as (select family, b1, base, count(*) as c, sum(count(*)) over (partition by family, b1) as n from one where family is not null and b1 is not null group by family, b1, base),
m5 as (select state, ctx5, base, count(*) as c, sum(count(*)) over (partition by state, ctx5) as n from one where state between 5 and 7 and ctx5 is not null group by state, ctx5, base),
pe as (select one.state, case
    when family is not null then coalesce(ln((m1.c + 0.1) / (m1.n + 0.4)), ln(0.25))
    when one.state between 5 and 7 then coalesce(ln((m5.c + 0.1) / (m5.n + 0.4)), ln(0.25))
    when one.state = 2 and one.base = 'A' and n1 = 'T' and n2 = 'G' then {score_sql(adapters.START).replace("pos", "i")}
    when one.state between 8 and 10 and one.base = 'G' and n1 = 'T' then {score_sql(adapters.DONOR).replace("pos", "i")}
    when one.state between 14 and 16 and one.base = 'G' and one.b1 = 'A' then {score_sql(adapters.ACCEPTOR).replace("pos", "i")}
    when (one.state = 3 and one.base = 'T') or (one.state = 4 and one.base = 'G') or (one.state = 17 and one.base = 'T') then 0.0
    when one.state = 18 and one.base in ('A', 'G') then ln(0.5)
    when one.state = 19 and p2 || one.b1 || one.base in ('TAA', 'TAG', 'TGA') then 0.0 end as lp
  from one left join m1 using (family, b1, base) left join m5 on m5.state = one.state and m5.ctx5 = one.ctx5 and m5.base = one.base)
select cast(state as int) as state, count(*) as n, round(avg(lp), 6) as avg_log_emission from pe where lp is not null group by state"""


@query("agg_avg_emission", usable(AVERAGE))
def agg_avg_emission(spark, sf):
    """Mean log emission of the labels' own states over all usable intervals, with scores."""
    iv = training(spark, sf)
    rows = with_scores(iv.select("scaffold", "seq", "states"), "seq")
    return emission.average_emission(rows, fitted(spark, sf, iv)).withColumn("avg_log_emission", F.round("avg_log_emission", 6))


# decoders


def dealt_scaffolds(spark, sf) -> DataFrame:
    """Scaffolds over all cores, before they get their scores."""
    return decode.spread(scaffolds(spark, sf).drop("n"))


def decoded(spark, sf, intervals: DataFrame | None = None, **kw) -> DataFrame:
    rows = with_scores(dealt_scaffolds(spark, sf)).withColumnRenamed("sequence", "seq")
    return decode.decode(rows, fitted(spark, sf, intervals, start_bias=-2.0), PENALTY, dealt=True, **kw)


@query("dec_viterbi")
def dec_viterbi(spark, sf):
    """Also emt_dispatch, emt_markov1, emt_markov5 and emt_load_and_calibrate: the best path of every scaffold."""
    return decoded(spark, sf, with_confidence=False).select("scaffold", F.length("path").alias("bases"), F.md5("path").alias("digest"), F.round("score", 6).alias("score"))


@query("dec_intron_length")
def dec_intron_length(spark, sf):
    """Also dec_duration: with a cap and a length distribution of introns."""
    iv = training(spark, sf)
    lengths = stored(model.intron_lengths(iv))
    cap = model.length_percentile(lengths, 0.95).first()[0]
    # without any intron the percentile is the largest number, and there is no length distribution; else cap + 1 numbers
    pmf = None if lengths.isEmpty() else [r["log_p"] for r in model.length_pmf(lengths, cap).orderBy("length").collect()]
    return decoded(spark, sf, iv, with_confidence=False, longest=cap, pmf=pmf).select("scaffold", F.md5("path").alias("digest"))


@query("dec_gene_penalty")
def dec_gene_penalty(spark, sf):
    """Predicted genes without and with a high penalty."""
    rows = stored(with_scores(dealt_scaffolds(spark, sf)).withColumnRenamed("sequence", "seq"))
    m = fitted(spark, sf, start_bias=-2.0)
    count = lambda p: decode.decode(rows, m, p, with_confidence=False, dealt=True).agg(F.sum(F.length("path") - F.length(F.translate("path", t.letter(2), ""))).alias("genes")).select(F.lit(p).alias("penalty"), "genes")
    return count(0.0).unionByName(count(5.0))


@query("dec_confidence")
def dec_confidence(spark, sf):
    """Also dec_forward, dec_backward and dec_posterior: mean posterior of the best path by state family."""
    return genes.label_confidence(decoded(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query("dec_validation")
def dec_validation(spark, sf):
    """Decode the usable intervals and compare with their labels: svc_cli_validate's metric table."""
    iv = training(spark, sf)
    found = decode.decode(with_scores(iv.select("species", "scaffold", "seq", F.col("states").alias("gold")), "seq"), fitted(spark, sf, iv, start_bias=-2.0), PENALTY, with_confidence=False)
    return evaluate.boundary_metrics(evaluate.confusion(found.select(F.col("path").alias("pred"), "gold")))


@query("svc_cli_validate")
def svc_cli_validate(spark, sf):
    iv = training(spark, sf)
    found = decode.decode(with_scores(iv.select("species", "scaffold", "seq", F.col("states").alias("gold")), "seq"), fitted(spark, sf, iv, start_bias=-2.0), PENALTY, with_confidence=False)
    m = evaluate.binary_metrics(evaluate.confusion(found.select("species", F.col("path").alias("pred"), "gold"), ["species"]), t.CODING, ["species"])
    return m.select("species", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(n) for n, c in evaluate.rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()))


def tuning_intervals(spark, sf, intervals: DataFrame | None = None) -> DataFrame:
    """64 evenly spread ones of all usable intervals, of any length; only their keys are ranked."""
    iv = (training(spark, sf) if intervals is None else intervals).select("scaffold", F.col("start").alias("at"), "seq", F.col("states").alias("gold"))
    chosen = evaluate.even_sample(iv.select("scaffold", "at"), 64, ["scaffold", "at"])
    return with_scores(iv.join(F.broadcast(chosen), ["scaffold", "at"], "left_semi"), "seq").select("seq", "donor", "acceptor", "start", "gold")  # chosen: 64 rows


@query("agg_grid_search_splice")
def agg_grid_search_splice(spark, sf):
    """Splice calibration on 64 evenly spread intervals: 487 candidates."""
    names = ("donor_scale", "donor_bias", "acceptor_scale", "acceptor_bias")
    iv = training(spark, sf)
    return evaluate.grid_search(tuning_intervals(spark, sf, iv), fitted(spark, sf, iv), [dict(zip(names, c, strict=True)) for c in evaluate.splice_grid()], "splice", PENALTY)


@query("agg_grid_search")
def agg_grid_search(spark, sf):
    """Start calibration on 64 evenly spread intervals: 32 candidates."""
    iv = training(spark, sf)
    return evaluate.grid_search(tuning_intervals(spark, sf, iv), fitted(spark, sf, iv), [{"start_scale": a, "start_bias": b} for a, b in evaluate.start_grid()], "start", PENALTY)


# genes


def predicted(spark, sf) -> DataFrame:
    both = with_scores(with_scores(dealt_scaffolds(spark, sf)).withColumn("rc", sq.reverse_complement(F.col("sequence"))), "rc", suffix="_minus").drop("rc")
    return genes.predict(both, fitted(spark, sf, start_bias=-2.0), PENALTY, dealt=True, with_confidence=False)


@query("svc_cli_predict")
def svc_cli_predict(spark, sf):
    """The flagship: fit, decode both strands, build records, merge strands, number. Confidences are no part of what it returns; `dec_confidence` and
    `snk_prediction_document` have them."""
    return predicted(spark, sf).select("id", "species", "scaffold", "strand", "start", "end", "exons", "introns", "intron_count", "sequence", F.round("score", 6).alias("score"))


def labelled_paths(spark, sf) -> DataFrame:
    """The labels of every scaffold as a path."""
    return labels.labelled(scaffolds(spark, sf), features(spark, sf)).select("species", "scaffold", F.col("sequence").alias("seq"), F.col("states").alias("path"))


def surely(paths: DataFrame) -> DataFrame:
    """`paths` with the same confidence everywhere."""
    return paths.withColumn("confidence", F.array_repeat(F.lit(0.5), F.length("path")))


def labelled_genes(spark, sf, with_confidence: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """Records from the labels themselves, which SQL can make too; with or without the confidence of every base."""
    records = genes.gene_records(surely(labelled_paths(spark, sf) if paths is None else paths), "+", with_confidence)
    return records.withColumn("id", F.concat(F.lit("g"), F.col("scaffold").cast("string"), F.lit("_"), F.col("start").cast("string")))


RUNS = """gb as (select scaffold, pos, state, base, pos - row_number() over (partition by scaffold order by pos) as g from lab where state between 2 and 19),
gr as (select scaffold, g, min(pos) + 1 as start, max(pos) + 1 as "end", string_agg(base, '' order by pos) as sequence from gb group by scaffold, g),
ge as (select gr.scaffold, gr.g, start, "end", sequence, 'g' || gr.scaffold || '_' || start as id from gr),
ex as (select scaffold, g, min(pos) + 1 as a, max(pos) + 1 as b from (select *, pos - row_number() over (partition by scaffold, g order by pos) as h from gb where state between 2 and 7 or state between 17 and 19) group by scaffold, g, h),
nt as (select scaffold, g, count(*) as introns from (select scaffold, g, h from (select *, pos - row_number() over (partition by scaffold, g order by pos) as h from gb where state between 8 and 16) group by scaffold, g, h) group by scaffold, g),
nb as (select scaffold, g, count(*) as bodies from (select scaffold, g, h from (select *, pos - row_number() over (partition by scaffold, g order by pos) as h from gb where state between 11 and 13) group by scaffold, g, h) group by scaffold, g)"""


@query("win_gene_runs", labelled(f"{RUNS} select id, ge.scaffold, cast(start as int) as start, cast(\"end\" as int) as \"end\", cast((select count(*) from ex where ex.scaffold = ge.scaffold and ex.g = ge.g) as int) as exons, cast(coalesce(bodies, 0) as int) as intron_count, md5(sequence) as digest from ge left join nb using (scaffold, g)"))
def win_gene_runs(spark, sf):
    g = labelled_genes(spark, sf)
    return g.select("id", "scaffold", "start", "end", F.size("exons").alias("exons"), "intron_count", F.md5("sequence").alias("digest"))


@query("agg_summary", labelled(f"{RUNS} select (select cast(sum(length(sequence)) as bigint) from seqs) as bases, (select count(*) from seqs) as scaffolds, (select count(*) from ge) as genes, (select count(*) from ex) as exons, (select cast(coalesce(sum(bodies), 0) as bigint) from nb) as introns"))
def agg_summary(spark, sf):
    return genes.summary(labelled_genes(spark, sf), scaffolds(spark, sf))


@query("prj_gene_confidence", labelled(f"{RUNS} select scaffold, cast(pos + 1 as int) as position, case when state between 2 and 4 then 'Start' when state between 17 and 19 then 'Stop' when state between 5 and 7 then 'UTR' else 'Intron' end as state, cast(0.5 as double) as confidence from gb"))
def prj_gene_confidence(spark, sf):
    return labelled_genes(spark, sf, True).select("scaffold", F.explode("confidence").alias("c")).select("scaffold", "c.position", "c.state", "c.confidence")


@query("flt_confidence_range", labelled(f"{RUNS} select scaffold, count(*) as n from gb where pos + 1 between 100 and 900 group by scaffold"))
def flt_confidence_range(spark, sf):
    c = labelled_genes(spark, sf, True).select("scaffold", F.explode("confidence").alias("c")).where(F.col("c.position").between(100, 900))
    return c.groupBy("scaffold").agg(F.count(F.lit(1)).alias("n"))


@query("agg_regional_confidence", labelled(f"{RUNS}, rl as (select scaffold, pos, case when state between 2 and 4 then 'Start' when state between 17 and 19 then 'Stop' when state between 5 and 7 then 'UTR' else 'Intron' end as state from gb), rr as (select *, pos - row_number() over (partition by scaffold, state order by pos) as h from rl) select scaffold, state, cast(min(pos) + 1 as int) as start, cast(max(pos) + 1 as int) as \"end\", cast(0.5 as double) as confidence from rr group by scaffold, state, h"))
def agg_regional_confidence(spark, sf):
    return genes.regional_confidence(labelled_genes(spark, sf, True), ["scaffold"])


@query("snk_csv", labelled(f"{RUNS} select id, ge.scaffold, '+' as strand, cast(start as int) as start, cast(\"end\" as int) as \"end\", cast(\"end\" - start + 1 as int) as length, cast((select count(*) from ex where ex.scaffold = ge.scaffold and ex.g = ge.g) as int) as exon_count, cast(coalesce(introns, 0) as int) as intron_count from ge left join nt using (scaffold, g)"))
def snk_csv(spark, sf):
    return sinks.csv(labelled_genes(spark, sf))


@query("snk_bed", labelled(f"{RUNS} select scaffold, cast(start - 1 as int) as chrom_start, cast(\"end\" as int) as chrom_end, id as name, 0 as score, '+' as strand from ge"))
def snk_bed(spark, sf):
    return sinks.bed(labelled_genes(spark, sf))


@query("snk_fasta_pred", labelled(f"{RUNS} select id, '>' || id || ' ' || scaffold || ':' || start || '-' || \"end\" || chr(10) || sequence as value from ge"))
def snk_fasta_pred(spark, sf):
    return sinks.fasta(labelled_genes(spark, sf))


@query("snk_gff3", labelled(f"""{RUNS}, xx as (select ex.*, row_number() over (partition by scaffold, g order by a) as k from ex),
rows_ as (select '##gff-version 3' as value union all select array_to_string([cast(scaffold as varchar), 'predicted', 'gene', cast(start as varchar), cast("end" as varchar), '.', '+', '.', 'ID=' || id], chr(9)) from ge
union all select array_to_string([cast(ge.scaffold as varchar), 'predicted', 'CDS', cast(a as varchar), cast(b as varchar), '.', '+', '.', 'ID=' || id || '.cds' || k || ';Parent=' || id], chr(9)) from xx join ge using (scaffold, g)) select value from rows_"""))
def snk_gff3(spark, sf):
    return sinks.gff3(labelled_genes(spark, sf)).select("value")


LABEL = "case when state between 2 and 4 then 'Start' when state between 17 and 19 then 'Stop' when state between 5 and 7 then 'UTR' when state between 8 and 16 then 'Intron' else 'Intergenic' end"
LINES = f"""{RUNS}, it as (select scaffold, g, min(pos) + 1 as a, max(pos) + 1 as b from (select *, pos - row_number() over (partition by scaffold, g order by pos) as h from gb where state between 8 and 16) group by scaffold, g, h),
sure as (select scaffold, pos, '{{"position":' || (pos + 1) || ',"state":"' || {LABEL} || '","confidence":0.5}}' as j from lab),
exj as (select scaffold, g, string_agg('{{"start":' || a || ',"end":' || b || '}}', ',' order by a) as exons from ex group by scaffold, g),
itj as (select scaffold, g, string_agg('{{"start":' || a || ',"end":' || b || '}}', ',' order by a) as introns from it group by scaffold, g),
gj as (select gb.scaffold, g, string_agg(j, ',' order by pos) as bases from gb join sure using (scaffold, pos) group by gb.scaffold, g),
lines_ as (select 'summary' as section, 'documents' as name, '{{"inputFile":"documents","totalBases":' || (select cast(sum(length(sequence)) as bigint) from seqs) || ',"scaffolds":' || (select count(*) from seqs) || ',"genes":' || (select count(*) from ge) || ',"exons":' || (select count(*) from ex) || ',"introns":' || (select cast(coalesce(sum(bodies), 0) as bigint) from nb) || '}}' as value
union all select 'scaffolds', cast(scaffold as varchar), '{{"name":"' || scaffold || '","length":' || length(sequence) || '}}' from seqs
union all select 'predictions', id, '{{"id":"' || id || '","scaffold":' || ge.scaffold || ',"strand":"+","start":' || start || ',"end":' || "end" || ',"exons":[' || coalesce(exons, '') || '],"introns":[' || coalesce(introns, '') || '],"intron_count":' || coalesce(bodies, 0) || ',"sequence":"' || sequence || '","confidence":[' || bases || ']}}'
  from ge join gj using (scaffold, g) left join exj using (scaffold, g) left join itj using (scaffold, g) left join nb using (scaffold, g)
union all select 'confidenceByScaffold', cast(scaffold as varchar), '{{"name":"' || scaffold || '","confidence":[' || string_agg(j, ',' order by pos) || ']}}' from sure group by scaffold)"""


@query("snk_prediction_json", labelled(f"{LINES} select section, name, cast(length(value) as int) as chars, md5(value) as digest from lines_"))
def snk_prediction_json(spark, sf):
    """All lines, whole: the query returns their lengths and digests."""
    paths = stored(labelled_paths(spark, sf))
    lines = sinks.prediction_json(labelled_genes(spark, sf, True, paths), surely(paths), "documents")
    return lines.select("section", "name", F.length("value").alias("chars"), F.md5("value").alias("digest"))


MERGE = """g0 as (select scaffold, start as a, "end" as b, strand, min(o_orderkey) as k from gn where "end" > start group by all),
g1 as (select *, cast(k * 7919 % 1009 as double) as score from g0),
folded as (select scaffold, list_reduce(list([{'a': a, 'b': b, 'strand': strand, 'k': k, 'score': score}] order by a, b, strand), lambda kept, new: case
    when len(list_filter(kept, lambda x: x.b > new[1].a and x.score >= new[1].score)) = 0 then list_filter(kept, lambda x: x.b <= new[1].a) || new
    else kept[1:list_max(list_transform(kept, lambda x, i: case when x.b > new[1].a and x.score >= new[1].score then i else 0 end))] end) as kept from g1 group by scaffold)"""


def merged_orders(spark, sf) -> DataFrame:
    from .sequence_queries import gene_table

    keys = ["scaffold", "fwd_start", "fwd_end", "strand"]
    g = gene_table(spark, sf).select("scaffold", "strand", F.col("start").alias("fwd_start"), F.col("end").alias("fwd_end"), "o_orderkey").where("fwd_end > fwd_start")
    one = g.groupBy(*keys).agg(F.min("o_orderkey").alias("o_orderkey")).withColumn("species", F.lit("s"))
    return genes.merge_strands(one.withColumn("score", (F.col("o_orderkey") * 7919 % 1009).cast("double")))


@query("jn_strand_merge", f"with {GENES.replace('select ', 'select o_orderkey, ', 1)}, {MERGE} select scaffold, x.k as o_orderkey, x.a as fwd_start, x.b as fwd_end, x.strand as strand from (select scaffold, unnest(kept) as x from folded)")
def jn_strand_merge(spark, sf):
    """Also agg_merge_strands, srt_genes and set_union_strand: orders as genes of two strands, merged by score."""
    return merged_orders(spark, sf).select("scaffold", "o_orderkey", "fwd_start", "fwd_end", "strand")


@query("snk_scores_sparse", f"with {SEQ}, {NEIGHBOURS} select scaffold, pos, pos || chr(9) || format('{{:.8f}}', {score_sql(adapters.START)}) as value from nb where base = 'A' and n1 = 'T' and n2 = 'G'")
def snk_scores_sparse(spark, sf):
    c = sq.around(scaffolds(spark, sf).select("scaffold", "sequence"), before=0).where(sq.IS_START)
    rows = c.select("scaffold", "pos", adapters.score(F.col("pos"), F.col("scaffold"), adapters.START).alias("start"))
    return rows.select("scaffold", "pos", F.concat_ws("\t", F.col("pos").cast("string"), F.format_string("%.8f", "start")).alias("value"))


CHECKSUM = "sum(cast('0x' || substr(md5(value), 1, 7) as bigint))"


@query("snk_scores_dense", f"""with {SEQ}, {NEIGHBOURS}, dense as (select scaffold, pos || chr(9) || format('{{:.8f}}', case when base = 'G' and n1 = 'T' then {score_sql(adapters.DONOR)} else 0.0::double end)
  || chr(9) || format('{{:.8f}}', case when base = 'G' and p1 = 'A' then {score_sql(adapters.ACCEPTOR)} else 0.0::double end) as value from nb)
select scaffold, count(*) as lines, cast({CHECKSUM} as bigint) as checksum from dense group by scaffold""")
def snk_scores_dense(spark, sf):
    """A line for every base with both splice scores; the query returns the lines' checksum for each scaffold."""
    lines = sinks.dense_scores(adapters.base_scores(scaffolds(spark, sf)), ("donor", "acceptor"), ["scaffold"])
    return lines.groupBy("scaffold").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.conv(F.substring(F.md5("value"), 1, 7), 16, 10).cast("long")).alias("checksum"))


LINE_DIGEST = f"select count(*) as lines, cast(coalesce({CHECKSUM}, 0) as bigint) as checksum from kept"


def line_digest(lines: DataFrame) -> DataFrame:
    """Their number and a checksum of their contents and multiplicities."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.conv(F.substring(F.md5("value"), 1, 7), 16, 10).cast("long")), F.lit(0)).alias("checksum"))


@query("snk_fasta_split", f"with kept as (select unnest(string_split(text, chr(10))) as value from documents where source in ('src1', 'src2') union all select '>' || doc_id || ' ' || source from documents where source in ('src1', 'src2')) {LINE_DIGEST}")
def snk_fasta_split(spark, sf):
    from .sequence_queries import fasta_table

    chosen = adapters.table(spark, sf, "documents").where(F.col("source").isin("src1", "src2")).select(F.col("doc_id").cast("string").alias("name"))
    return line_digest(sinks.fasta_split(fasta_table(spark, sf), chosen))


@query("snk_gff_split", f"with {GFF}, kept as (select value from g where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') union all select '##gff-version 3' union all select '# note') {LINE_DIGEST}")
def snk_gff_split(spark, sf):
    from .sequence_queries import gff_table

    lines = gff_table(spark, sf).select(F.lit("f").alias("file"), F.lit(1).alias("line_no"), "value")
    more = spark.createDataFrame([("f", 0, "##gff-version 3"), ("f", 0, "# note"), ("f", 0, "##sequence-region nowhere 1 5")], "file string, line_no int, value string")
    chosen = adapters.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("name"))
    return line_digest(sinks.gff_split(lines.unionByName(more), chosen))


# networks


@query("ml_score")
def ml_score(spark, sf):
    """Also ml_start_cnn: the dilated network (random weights) over the start examples."""
    return cnn.score_windows(start_examples(spark, sf), {"start": cnn.Backbone.random()}).select("scaffold", "pos", "label", F.round("start", 4).alias("logit"))


@query("ml_score_splice")
def ml_score_splice(spark, sf):
    """Also ml_splice_cnn: the donor and the acceptor network (random weights) over the windows of all splice candidates."""
    nets = {"donor": cnn.Backbone.random(seed=14), "acceptor": cnn.Backbone.random(seed=15)}
    found = cnn.score_candidates(scaffolds(spark, sf).select("scaffold", "sequence"), nets, "splice")
    return found.select("scaffold", "pos", F.round("donor", 4).alias("donor"), F.round("acceptor", 4).alias("acceptor"))


def species_examples(spark, sf) -> DataFrame:
    """Windows around every start candidate, labelled by whether the species is `en`: what no single position tells."""
    s = scaffolds(spark, sf)
    windows = dataset.start_candidates(s).join(s, "scaffold").select("scaffold", "pos", (F.col("species") == "en").cast("int").alias("label"), sq.window_at(F.col("sequence"), F.col("pos"), cnn.RADIUS).alias("window"))
    return windows.where("label is not null")


CHANNELS, EPOCHS, RATE = 128, 10, 4e-3  # of the networks trained here; the rate is for batches of 2,048 and more


def learned(examples: DataFrame):
    """The state fitted to nine tenths of the examples, the held-out tenth with the network's logits, and the training share."""
    rows = stored(dataset.split_validation(examples, ["scaffold", "pos"]))
    fit, held_out = rows.where("not is_validation"), rows.where("is_validation")
    state = training_of.train(fit, "start", ["scaffold", "pos"], CHANNELS, EPOCHS, RATE)
    return state, stored(cnn.score_windows(held_out, {"start": state.network()}).withColumnRenamed("start", "logit")), fit


@query("ml_train")
def ml_train(spark, sf):
    """Networks trained on the start examples and on windows of species, and the linear models beside them: average precision on the held-out tenth."""
    out = None
    for name, x in (("start", start_examples(spark, sf)), ("species", species_examples(spark, sf))):
        state, held_out, fit = learned(x)
        line = cnn.train_linear(fit, 10)
        linear = cnn.linear_scores(held_out.drop("logit"), [float(v) for v in line.coefficients], line.intercept)
        for model_name, scored in (("network", held_out), ("linear", linear)):
            ap = evaluate.average_precision(scored.select("label", F.col("logit").alias("score"), F.struct("scaffold", "pos").alias("tie")))
            n = scored.agg(F.count(F.lit(1)).alias("held_out"), F.sum("label").alias("positives"))
            row = ap.crossJoin(n).select(F.lit(name).alias("examples"), F.lit(model_name).alias("model"), "held_out", "positives", F.round("average_precision", 4).alias("average_precision"), F.lit(round(state.losses[-1], 4)).alias("training_loss"))  # one row each
            out = row if out is None else out.unionByName(row)
    return out


@query("ml_train_linear")
def ml_train_linear(spark, sf):
    """A linear model of the start windows, scored as columns."""
    x = stored(start_examples(spark, sf))
    fit = cnn.train_linear(x, 5)
    scored = cnn.linear_scores(x, [float(v) for v in fit.coefficients], fit.intercept)
    return scored.select("scaffold", "pos", "label", F.round("logit", 6).alias("logit"))


@query("ml_score_strands")
def ml_score_strands(spark, sf):
    """A start network trained on the examples, calibrated on the held-out tenth, over all candidates of both strands; positions on strand - count on the
    reversed sequence."""
    state, held_out, fit = learned(start_examples(spark, sf))
    temperature = evaluate.fit_temperature_of(held_out, "logit", "label")
    prior = fit.agg(evaluate.prior_logit(F.col("label"))).first()[0]
    found = cnn.score_candidates(cnn.both_strands(scaffolds(spark, sf).select("species", "scaffold", "sequence")), {"start": state.network()}, "start")
    return found.select("species", "scaffold", "strand", "pos", F.round(cnn.calibrated(F.col("start"), temperature, prior), 4).alias("score"))


@query("ml_checkpoint")
def ml_checkpoint(spark, sf):
    """A run cut behind its first epoch and taken up again, and one that wasn't cut: epochs, steps and a digest of the weights."""
    x = stored(start_examples(spark, sf))
    own = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    step = lambda name, **kw: training_of.train(x, "start", ["scaffold", "pos"], 4, 3, folder=f"{own}/{name}", **kw)
    step("cut", stop_after=1)
    rows = [(name, s.epoch, s.step, hashlib.sha256(s.weights.tobytes()).hexdigest()) for name, s in ((name, step(name)) for name in ("cut", "uncut"))]
    files, where = file_system(spark, own)
    files.delete(where, True)
    return spark.createDataFrame(rows, "run string, epochs int, steps int, weights_sha256 string")


# the loss is convex, so thirds of an interval narrow down its least place
LOSS = "sum(greatest(z * exp(-{0}), 0.0) + ln(1 + exp(-abs(z * exp(-{0})))) - y * z * exp(-{0}))"
TEMPERATURE = f"""with recursive l as materialized (select value - avg(value) over () as z, case when event_type in ('purchase', 'click') then 1 else 0 end as y from events where value is not null and not isnan(value) and event_type is not null),
s(i, a, b) as (select 0, -5.0::double, 5.0::double union all select i + 1, case when low < high then a else a + (b - a) / 3 end, case when low < high then b - (b - a) / 3 else b end
  from (select i, a, b, {LOSS.format('(a + (b - a) / 3)')} as low, {LOSS.format('(b - (b - a) / 3)')} as high from s, l where i < 50 group by i, a, b))
select round(exp((a + b) / 2), 3) as temperature from s where i = 50"""


@query("agg_fit_temperature", TEMPERATURE)
def agg_fit_temperature(spark, sf):
    """The temperature for all events as logits: their values less the mean."""
    rows = adapters.events(spark, sf).select("value", F.col("event_type").isin("purchase", "click").cast("int").alias("y")).where("value is not null and not isnan(value) and y is not null")
    mean = rows.agg(F.avg("value")).first()[0]
    logits = rows.select((F.col("value") - F.lit(mean)).alias("logit"), "y")
    return spark.createDataFrame([(round(evaluate.fit_temperature_of(logits, "logit", "y"), 3),)], "temperature double")


@query("svc_cached_pipeline")
def svc_cached_pipeline(spark, sf):
    """Labels, counts and predictions as stages: made, found again, and after a changed parameter made again from the first stage that it touches."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    sources = stages.files_digest(spark, *(f"{sf}/{n}.parquet" for n in ("documents", "lineitem", "orders")))
    rows = []
    for name, alpha in (("first", 0.1), ("again", 0.1), ("changed", 0.2)):
        run = stages.Run(spark, folder)
        labelled_ = run.stage("labels", {"strand": "+"}, [sources], lambda: training(spark, sf))
        run.stage("emissions", {"alpha": alpha}, [labelled_], lambda iv, a=alpha: model.emission_tables(iv, a))
        run.stage("transitions", {"alpha": 0.02}, [labelled_], lambda iv: model.transition_log_probs(model.bigram_counts(iv)))
        run.stage("lengths", {}, [labelled_], lambda iv: model.intron_lengths(iv).groupBy("length").agg(F.count(F.lit(1)).alias("n")))
        rows += [(name, s.name, s.reused, s.rows.count()) for s in run.stages]
    files, where = file_system(spark, folder)
    files.delete(where, True)
    return spark.createDataFrame(rows, "run string, stage string, reused boolean, n long")


@query("svc_cli_train")
def svc_cli_train(spark, sf):
    """The fitted matrices as JSON lines."""
    tables = model.fit(training(spark, sf))
    a = sinks.matrix_json(tables["transitions"], ["from_state", "to_state"]).select(F.lit("transitions").alias("matrix"), "value")
    return a.unionByName(sinks.matrix_json(tables["emissions"], ["family", "ctx", "base"]).select(F.lit("emissions").alias("matrix"), "value"))
