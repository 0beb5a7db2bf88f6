"""Queries over annotation: transcripts, painting, labels, fitted tables, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import topology as t
from ..operators import dataset, evaluate, intervals, labels, model
from ..sources.adapters import features, scaffolds, table
from ..storage import stored
from .oracle import FEAT, FRAG, SEQ, compared, labelled, usable
from .registry import query


@query("agg_transcripts", f"with {FEAT}, {FRAG} select scaffold, parent, n, total from tr")
def agg_transcripts(spark, sf):
    return intervals.transcripts(features(spark, sf)).select("scaffold", "parent", "n", intervals.fragment_sum(F.col("fragments")).alias("total"))


@query("srt_fragments", f"with {FEAT}, {FRAG} select scaffold, parent, cast(i as int) as i, start0, end0 from frag")
def srt_fragments(spark, sf):
    return intervals.transcripts(features(spark, sf)).select("scaffold", "parent", F.posexplode("fragments").alias("i", "f")).select("scaffold", "parent", "i", "f.start0", "f.end0")


@query("flt_transcript_quality", f"with {FEAT}, {FRAG} select scaffold, parent, first_size >= 3 and last_size >= 3 and total % 3 = 0 and not short_gap as ok from tr")
def flt_transcript_quality(spark, sf):
    return intervals.transcripts(features(spark, sf)).select("scaffold", "parent", intervals.passes_filters(F.col("fragments")).alias("ok"))


@query("flt_transcript_quality_py", f"with {FEAT}, {FRAG} select scaffold, parent, total % 3 = 0 and not bad_gap as ok from tr")
def flt_transcript_quality_py(spark, sf):
    return intervals.transcripts(features(spark, sf)).select("scaffold", "parent", intervals.passes_site_filters(F.col("fragments")).alias("ok"))


@query("flt_supported_strand", f"with {FEAT} select scaffold, parent, bool_and(strand = '-') as supported from feats group by scaffold, parent")
def flt_supported_strand(spark, sf):
    return features(spark, sf).groupBy("scaffold", "parent").agg(F.bool_and(F.col("strand") == "-").alias("supported"))


@query("prj_mirror_interval", f"with {SEQ}, {FEAT} select f.scaffold, parent, strand, length(sequence) - 1 - end0 as start0, length(sequence) - 1 - start0 as end0 from feats f join seqs s using (scaffold)")
def prj_mirror_interval(spark, sf):
    return intervals.mirror_features(features(spark, sf), scaffolds(spark, sf)).select("scaffold", "parent", "strand", "start0", "end0")


@query("agg_cds_counts", f"with {FEAT} select scaffold, count(*) as cds from feats group by scaffold")
def agg_cds_counts(spark, sf):
    return dataset.cds_counts(features(spark, sf))


CHOSEN = """cnt as (select scaffold, count(*) as cds from feats group by scaffold), tot as (select sum(cds) as total from cnt),
able as (select scaffold, cds, coalesce(sum(cds) over (order by md5(cast(scaffold as varchar)), scaffold rows between unbounded preceding and 1 preceding), 0) as before_, total from cnt, tot where cds > 0 and cds <= 0.25 * total),
picked as (select scaffold, cds from able where before_ < 0.1 * total)"""


@query("agg_choose_test", f"with {FEAT}, {CHOSEN} select scaffold, cds from picked union all (select scaffold, cds from cnt where not exists (select 1 from picked) order by cds, scaffold limit 1)")
def agg_choose_test(spark, sf):
    return dataset.choose_test(dataset.cds_counts(features(spark, sf)))


@query("prj_species_stats", f"with {FEAT}, {CHOSEN} select d.lang as species, count(*) as sequences, count(*) filter (where doc_id % 9 = 0) as organelles, cast(coalesce(sum(c.cds), 0) as bigint) as cds, round(coalesce(sum(p.cds) / sum(c.cds), 0), 9) as test_share from documents d left join cnt c on c.scaffold = doc_id left join picked p on p.scaffold = doc_id group by d.lang")
def prj_species_stats(spark, sf):
    f = features(spark, sf)
    heads = table(spark, sf, "documents").select(F.col("lang").alias("species"), F.col("doc_id").alias("scaffold"), F.concat("source", F.when(F.col("doc_id") % 9 == 0, " mitochondrion").otherwise("")).alias("header"))
    out = dataset.species_stats(heads, f, dataset.choose_test(dataset.cds_counts(f)))
    return out.withColumn("test_share", F.round("test_share", 9))


GAPS = "gp as (select f.scaffold, f.parent, last_.strand, end0 + 1 as l, next0 - 1 as r from frag f join tr using (scaffold, parent) join (select scaffold, parent, arg_max(strand, (start0, end0)) as strand from feats group by all) last_ using (scaffold, parent) where tr.total % 3 = 0 and not tr.bad_gap and next0 is not null)"


@query("agg_splice_sites", f"with {FEAT}, {FRAG}, {GAPS} select scaffold, kind, pos, max(strand) as strand from (select scaffold, 'donor' as kind, case when strand = '-' then r else l end as pos, strand from gp union all select scaffold, 'acceptor', case when strand = '-' then l else r end, strand from gp) group by scaffold, kind, pos")
def agg_splice_sites(spark, sf):
    return dataset.splice_sites(features(spark, sf))


@query("set_union_sites", f"with {FEAT}, {FRAG}, {GAPS} select scaffold, l as pos from gp union select scaffold, r from gp")
def set_union_sites(spark, sf):
    s = dataset.splice_sites(features(spark, sf))
    return s.where("kind = 'donor'").select("scaffold", "pos").union(s.where("kind = 'acceptor'").select("scaffold", "pos")).distinct()


STARTS = "st as (select scaffold, pos, max(strand) as strand from (select f.scaffold, case when last_.strand = '-' then max(end0) else min(start0) end as pos, last_.strand from feats f join tr using (scaffold, parent) join (select scaffold, parent, arg_max(strand, (start0, end0)) as strand from feats group by all) last_ using (scaffold, parent) where tr.total % 3 = 0 and not tr.bad_gap group by f.scaffold, f.parent, last_.strand) group by scaffold, pos)"


@query("agg_start_sites", f"with {FEAT}, {FRAG}, {STARTS} select * from st")
def agg_start_sites(spark, sf):
    return dataset.start_sites(features(spark, sf))


NEG = f"""ps as (select scaffold, unnest(range(length(sequence))) as pos, sequence from seqs), ca as (select scaffold, pos from ps where substr(sequence, pos + 1, 3) = 'ATG'),
fr_ as (select ca.* from ca anti join st using (scaffold, pos)), ng as (select * from (select *, row_number() over (order by md5('7:' || scaffold || ':' || pos), scaffold, pos) as rn from fr_) where rn <= 5 * (select count(*) from st))"""


@query("smp_negatives", f"with {SEQ}, {FEAT}, {FRAG}, {STARTS}, {NEG} select scaffold, pos from ng")
def smp_negatives(spark, sf):
    s = scaffolds(spark, sf)
    return dataset.sample_negatives(dataset.start_candidates(s), dataset.start_sites(features(spark, sf)))


def start_examples(spark, sf) -> DataFrame:
    s = scaffolds(spark, sf)
    sites = stored(dataset.start_sites(features(spark, sf)))  # used three times
    return dataset.examples(s, sites, dataset.sample_negatives(dataset.start_candidates(s), sites))


WINDOW = "substr(repeat('N', 60) || sequence || repeat('N', 60), pos + 1, 121)"


@query("ml_build_examples", f"with {SEQ}, {FEAT}, {FRAG}, {STARTS}, {NEG}, ex as (select scaffold, pos, 1 as label, strand from st union all select scaffold, pos, 0, '+' from ng) select scaffold, pos, label, md5(case when strand = '-' then translate(reverse({WINDOW}), 'ACGT', 'TGCA') else {WINDOW} end) as digest from ex join seqs using (scaffold)")
def ml_build_examples(spark, sf):
    return start_examples(spark, sf).select("scaffold", "pos", "label", F.md5("window").alias("digest"))


# painting and labels


def segments(spark, sf, strand: str = "+") -> DataFrame:
    return intervals.paint(scaffolds(spark, sf), intervals.transcript_paints(features(spark, sf), strand))


@query("jn_paint_regions", labelled("seg as (select scaffold, region, pos, pos - row_number() over (partition by scaffold, region order by pos) as g from reg) select scaffold, cast(min(pos) as bigint) as start, cast(max(pos) + 1 as bigint) as \"end\", region from seg group by scaffold, region, g"))
def jn_paint_regions(spark, sf):
    return segments(spark, sf)


@query("win_usable_ranges", usable("select scaffold, cast(min(pos) as bigint) as start, cast(max(pos) + 1 as bigint) as \"end\" from use group by scaffold, cutno"))
def win_usable_ranges(spark, sf):
    return intervals.usable_ranges(segments(spark, sf))


@query("flt_usable", labelled("select count(*) filter (where region <> 3) as usable, count(*) filter (where region = 3) as ignored from reg"))
def flt_usable(spark, sf):
    size = F.col("end") - F.col("start")
    return segments(spark, sf).agg(F.coalesce(F.sum(F.when(F.col("region") != 3, size)), F.lit(0)).alias("usable"), F.coalesce(F.sum(F.when(F.col("region") == 3, size)), F.lit(0)).alias("ignored"))


@query("win_label_states", labelled("select scaffold, md5(string_agg(chr(65 + cast(raw as int)), '' order by pos)) as digest from r5 group by scaffold"))
def win_label_states(spark, sf):
    return labels.labelled(scaffolds(spark, sf), features(spark, sf), erase=False).select("scaffold", F.md5("states").alias("digest"))


@query("win_erase_illegal", labelled("select scaffold, md5(string_agg(chr(65 + cast(state as int)), '' order by pos)) as digest from lab group by scaffold"))
def win_erase_illegal(spark, sf):
    return labels.labelled(scaffolds(spark, sf), features(spark, sf)).select("scaffold", F.md5("states").alias("digest"))


def training(spark, sf) -> DataFrame:
    """The usable intervals, written once: nearly every query reads them more than once."""
    return stored(labels.usable_intervals(scaffolds(spark, sf), features(spark, sf)))


BIGRAMS = "bg as (select f, t, count(*) as cnt from (select state as f, coalesce(nx, 20) as t from use union all select 0, state from use where i = 0) group by f, t)"


@query("agg_bigram_counts", usable(f"{BIGRAMS} select cast(f as int) as from_state, cast(t as int) as to_state, cnt from bg"))
def agg_bigram_counts(spark, sf):
    return model.bigram_counts(training(spark, sf))


@query("agg_outgoing_counts", usable("o as (select state as s from use union all select 0 from use where i = 0) select cast(s as int) as state, count(*) as cnt from o group by s"))
def agg_outgoing_counts(spark, sf):
    return model.outgoing_counts(training(spark, sf))


@query("agg_transition_logp", usable(f"{BIGRAMS} select cast(l.f as int) as from_state, cast(l.t as int) as to_state, coalesce(cnt, 0) as cnt, round(ln((coalesce(cnt, 0) + 0.02) / (sum(coalesce(cnt, 0)) over w + 0.02 * count(*) over w)), 9) as log_p from legal l left join bg on bg.f = l.f and bg.t = l.t window w as (partition by l.f)"))
def agg_transition_logp(spark, sf):
    return model.transition_log_probs(model.bigram_counts(training(spark, sf))).withColumn("log_p", F.round("log_p", 9))


CODE = "instr('ACGT', {}) - 1"


@query("agg_markov1_counts", usable(f"select cast({CODE.format('b1')} as int) as ctx, cast({CODE.format('base')} as int) as base, count(*) as cnt from use where state = 1 and b1 is not null group by all"))
def agg_markov1_counts(spark, sf):
    return model.markov_counts(training(spark, sf), [t.INTERGENIC], 1)


CTX5 = " + ".join(f"{4 ** (5 - i)} * (instr('ACGT', substr(ctx5, {i}, 1)) - 1)" for i in range(1, 6))


@query("agg_markov5_counts", usable(f"select cast({CTX5} as int) as ctx, cast({CODE.format('base')} as int) as base, count(*) as cnt from use where state = 5 and ctx5 is not null group by all"))
def agg_markov5_counts(spark, sf):
    return model.markov_counts(training(spark, sf), [t.EXON[0]], 5)


FAMILY = f"""fc as (select case when state = 1 then 'intergenic' when state between 11 and 13 then 'intron' when state between 5 and 7 then 'exon_' || (state - 4) end as family,
  case when state between 5 and 7 then {CTX5} else {CODE.format('b1')} end as ctx, {CODE.format('base')} as base from use where state = 1 or state between 11 and 13 or state between 5 and 7),
fg as (select family, ctx, base, count(*) as cnt from fc where ctx is not null group by all)"""


@query("agg_train_emissions", usable(f"{FAMILY} select family, cast(ctx as int) as ctx, cast(base as int) as base, cnt from fg"))
def agg_train_emissions(spark, sf):
    return model.family_counts(training(spark, sf))


@query("agg_markov_logp", usable(f"""{FAMILY}, fam as (select unnest(['intergenic', 'intron', 'exon_1', 'exon_2', 'exon_3']) as family, unnest([4, 4, 1024, 1024, 1024]) as n),
gr as (select family, c.range as ctx, b.range as base from fam, range(1024) c, range(4) b where c.range < n)
select family, cast(ctx as int) as ctx, cast(base as int) as base, coalesce(cnt, 0) as cnt, round(ln((coalesce(cnt, 0) + 0.1) / (sum(coalesce(cnt, 0)) over (partition by family, ctx) + 0.4)), 9) as log_p from gr left join fg using (family, ctx, base)"""))
def agg_markov_logp(spark, sf):
    return model.emission_tables(training(spark, sf)).withColumn("log_p", F.round("log_p", 9))


@query("emt_uniform_default", "with fam as (select unnest(['intergenic', 'intron', 'exon_1', 'exon_2', 'exon_3']) as family, unnest([4, 4, 1024, 1024, 1024]) as n) select family, count(*) as n_cells, round(min(ln(0.25)), 9) as low, round(max(ln(0.25)), 9) as high from fam, range(1024) c, range(4) b where c.range < n group by family")
def emt_uniform_default(spark, sf):
    return model.uniform_tables(spark).groupBy("family").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.min("log_p"), 9).alias("low"), F.round(F.max("log_p"), 9).alias("high"))


RUNS = "body as (select scaffold, cutno, i - row_number() over (partition by scaffold, cutno order by i) as g from use where state between 11 and 13), il as (select count(*) as length from body group by scaffold, cutno, g)"


@query("agg_intron_lengths", usable(f"{RUNS} select length, count(*) as n from il group by length"))
def agg_intron_lengths(spark, sf):
    return model.intron_lengths(training(spark, sf)).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


@query("agg_intron_cap", usable(f"{RUNS}, so as (select list(length order by length) as v from il) select v[cast(floor(0.95 * (len(v) - 1)) as int) + 1] as percentile_length from so"))
def agg_intron_cap(spark, sf):
    return model.length_percentile(model.intron_lengths(training(spark, sf)), 0.95)


@query("agg_intron_length_pmf", usable(f"{RUNS}, c as (select x.range as length, count(il.length) + 1 as c from range(1, 101) x left join il on il.length = x.range group by x.range) select length, round(ln(c / sum(c) over ()), 9) as log_p from c"))
def agg_intron_length_pmf(spark, sf):
    return model.length_pmf(model.intron_lengths(training(spark, sf)), 100).where("length > 0").withColumn("log_p", F.round("log_p", 9))


@query("snk_matrices_json", usable(f"{BIGRAMS} select cast(l.f as int) as from_state, cast(l.t as int) as to_state, coalesce(cnt, 0) as cnt, round(ln((coalesce(cnt, 0) + 0.02) / (sum(coalesce(cnt, 0)) over w + 0.02 * count(*) over w)), 9) as log_p from legal l left join bg on bg.f = l.f and bg.t = l.t window w as (partition by l.f)"))
def snk_matrices_json(spark, sf):
    """The transitions as JSON lines, read back."""
    from ..sinks.files import matrix_json

    j = matrix_json(model.transition_log_probs(model.bigram_counts(training(spark, sf))), ["from_state", "to_state"])
    return j.select(F.from_json("value", "from_state int, to_state int, cnt long, log_p double").alias("j")).select("j.from_state", "j.to_state", "j.cnt", F.round("j.log_p", 9).alias("log_p"))


# metrics: labels against a shifted and thinned copy of themselves


def pairs(spark, sf) -> DataFrame:
    """(species, scaffold, gold, pred) as the SQL makes them."""
    lab = labels.paths(scaffolds(spark, sf), features(spark, sf))
    n = F.length("states")
    shift = F.concat(F.repeat(F.lit(t.letter(1)), F.least(n, F.lit(3))), F.substr("states", F.lit(1), F.greatest(n - 3, F.lit(0))))
    return lab.select("species", "scaffold", F.col("states").alias("gold"), F.when(F.col("scaffold") % 3 == 1, shift).when(F.col("scaffold") % 15 == 2, F.repeat(F.lit(t.letter(1)), n)).otherwise(F.col("states")).alias("pred"))


CODING, INTRONIC = "({} between 2 and 7 or {} between 17 and 19)", "({} between 8 and 16)"


def flags(p: str, of: str) -> str:
    return of.format(p, p)


def binary(of: str) -> str:
    p, g = flags("pred", of), flags("gold", of)
    return f"count(*) filter (where {p} and {g}) as tp, count(*) filter (where {p} and not {g}) as fp, count(*) filter (where not {p} and {g}) as fn, count(*) filter (where not {p} and not {g}) as tn"


@query("agg_binary_metrics", compared(f"select 'coding' as kind, {binary(CODING)} from pg union all select 'intron', {binary(INTRONIC)} from pg"))
def agg_binary_metrics(spark, sf):
    cells = evaluate.confusion(pairs(spark, sf))
    named = lambda k, c: evaluate.binary_metrics(cells, c).select(F.lit(k).alias("kind"), "tp", "fp", "fn", "tn")
    return named("coding", t.CODING).unionByName(named("intron", t.INTRONIC))


@query("agg_prf", compared(f"m as (select species, {binary(CODING)} from pg join (select scaffold, species from seqs) using (scaffold) group by species), r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as q from m) select species, round(p, 9) as precision, round(q, 9) as recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 9) as f1, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy from r"))
def agg_prf(spark, sf):
    m = evaluate.binary_metrics(evaluate.confusion(pairs(spark, sf), ["species"]), t.CODING, ["species"])
    return m.select("species", *(F.round(c, 9).alias(n) for n, c in evaluate.rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()))


@query("agg_exact_matches", compared("select count(*) as bases, count(*) filter (where pred = gold) as exact from pg"))
def agg_exact_matches(spark, sf):
    return evaluate.confusion(pairs(spark, sf)).agg(F.sum("cnt").alias("bases"), evaluate.count_where(F.col("pred") == F.col("gold")).alias("exact"))


BOUNDARY = "bd as (select unnest(['start', 'stop', 'donor', 'acceptor']) as boundary, unnest([2, 19, 8, 14]) as lo, unnest([2, 19, 10, 16]) as hi)"


BOUNDARY_ROWS = """select boundary, count(*) filter (where pred between lo and hi and pred = gold) as exact, count(*) filter (where pred between lo and hi) as predicted,
  count(*) filter (where gold between lo and hi) as gold from pg, bd group by boundary"""


@query("agg_boundary_exact", compared(f"{BOUNDARY} {BOUNDARY_ROWS}"))
def agg_boundary_exact(spark, sf):
    return evaluate.boundary_metrics(evaluate.confusion(pairs(spark, sf)))


@query("agg_state_counts", compared("select cast(gold as int) as state, count(*) as n from pg group by gold"))
def agg_state_counts(spark, sf):
    return evaluate.confusion(pairs(spark, sf)).groupBy(t.code_of(F.col("gold")).alias("state")).agg(F.sum("cnt").alias("n"))


LABELS = "case when gold between 2 and 4 then 'Start' when gold between 17 and 19 then 'Stop' when gold between 5 and 7 then 'UTR' when gold between 8 and 16 then 'Intron' else 'Intergenic' end"


@query("jn_state_dim", compared(f"select {LABELS} as label, count(*) as n from pg group by 1"))
def jn_state_dim(spark, sf):
    """Also agg_family_counts and prj_state_family: states joined to their dimension."""
    dim = F.broadcast(t.state_dimension(spark))  # 21 rows
    return evaluate.confusion(pairs(spark, sf)).withColumn("state", t.code_of(F.col("gold"))).join(dim, "state").groupBy("label").agg(F.sum("cnt").alias("n"))


@query("flt_is_coding", compared(f"select {flags('gold', CODING)} as is_coding, {flags('gold', INTRONIC)} as is_intron, gold between 11 and 13 as is_intron_body, gold between 2 and 19 as is_gene, count(*) as n from pg group by all"))
def flt_is_coding(spark, sf):
    dim = F.broadcast(t.state_dimension(spark))  # 21 rows
    return evaluate.confusion(pairs(spark, sf)).withColumn("state", t.code_of(F.col("gold"))).join(dim, "state").groupBy("is_coding", "is_intron", "is_intron_body", "is_gene").agg(F.sum("cnt").alias("n"))


@query("jn_pred_gold", compared("select scaffold, count(*) filter (where pred <> gold) as differ from pg group by scaffold"))
def jn_pred_gold(spark, sf):
    """Positional 1:1 pairs, by zipping the two paths of a row."""
    cells = evaluate.confusion(pairs(spark, sf), ["scaffold"])
    return cells.groupBy("scaffold").agg(evaluate.count_where(F.col("pred") != F.col("gold")).alias("differ"))


@query("agg_illegal_transitions", compared("n as (select pred, lead(pred) over (partition by scaffold order by pos) as nx from pg) select count(*) as illegal from n anti join legal on pred = f and nx = t where nx is not null"))
def agg_illegal_transitions(spark, sf):
    return evaluate.illegal_transitions(pairs(spark, sf), "pred")


@query("agg_merge_results", compared(f"m as (select scaffold % 2 as part, {binary(CODING)} from pg group by 1) select cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tn) as bigint) as tn from m"))
def agg_merge_results(spark, sf):
    """Counts of two parts, added up."""
    cells = stored(evaluate.confusion(pairs(spark, sf).withColumn("part", F.col("scaffold") % 2), ["part"]))
    parts = [evaluate.binary_metrics(cells.where(F.col("part") == i), t.CODING) for i in (0, 1)]
    return parts[0].unionByName(parts[1]).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))


def runs_sql(predicate: str) -> str:
    return f"rn as (select scaffold, pos, pos - row_number() over (partition by scaffold order by pos) as g from pg where {predicate}) select scaffold, cast(min(pos) as int) as start, cast(max(pos) + 1 as int) as \"end\" from rn group by scaffold, g"


@query("win_state_intervals", compared(runs_sql(flags("gold", CODING))))
def win_state_intervals(spark, sf):
    return pairs(spark, sf).select("scaffold", F.explode(intervals.state_runs(F.col("gold"), t.letters(t.CODING))).alias("r")).select("scaffold", "r.start", "r.end")


@query("win_error_intervals", compared("er as (select scaffold, pos, case when pred between 2 and 19 and gold not between 2 and 19 then 'false_positive' when gold between 2 and 19 and pred not between 2 and 19 then 'false_negative' end as kind from pg), rn as (select *, pos - row_number() over (partition by scaffold, kind order by pos) as g from er where kind is not null) select scaffold, kind, cast(min(pos) as int) as start, cast(max(pos) + 1 as int) as \"end\" from rn group by scaffold, kind, g"))
def win_error_intervals(spark, sf):
    return evaluate.error_runs(pairs(spark, sf), "scaffold")


@query("jn_start_positions", compared("select scaffold, cast(pos as int) as pos from pg where pred = 2"))
def jn_start_positions(spark, sf):
    return evaluate.start_positions(pairs(spark, sf), "pred", ["scaffold"])


NEAR = """sp as (select scaffold, pos from pg where pred = 2), sg as (select scaffold, pos from pg where gold = 2),
po as (select sp.scaffold, sp.pos, arg_min(sp.pos - sg.pos, (abs(sp.pos - sg.pos), case when sg.pos >= sp.pos then 0 else 1 end)) as \"offset\" from sp left join sg using (scaffold) group by all),
go as (select sg.scaffold, sg.pos, min(abs(sp.pos - sg.pos)) as d from sg left join sp using (scaffold) group by all)"""


@query("jn_nearest_start", compared(f"{NEAR} select scaffold, cast(pos as int) as pos, cast(\"offset\" as int) as \"offset\" from po"))
def jn_nearest_start(spark, sf):
    return evaluate.start_offsets(pairs(spark, sf), ["scaffold"])[0]


OFFSET_MEDIAN = """m as (select list(abs("offset") order by abs("offset")) as v from po where abs("offset") between 1 and 300)"""
OFFSET_ROWS = """select count(*) as predicted, count(*) filter (where "offset" = 0) as exact, count(*) filter (where abs("offset") between 1 and 300) as within_window, count(*) filter (where "offset" is null or abs("offset") > 300) as spurious,
count(*) filter (where "offset" between -300 and -1) as upstream, count(*) filter (where "offset" between 1 and 300) as downstream, count(*) filter (where abs("offset") between 1 and 300 and "offset" % 3 = 0) as in_frame, count(*) filter (where abs("offset") between 1 and 300 and "offset" % 3 <> 0) as out_of_frame,
count(*) filter (where abs("offset") between 1 and 2) as d_1_2, count(*) filter (where abs("offset") = 3) as d_3, count(*) filter (where abs("offset") between 4 and 9) as d_4_9, count(*) filter (where abs("offset") between 10 and 30) as d_10_30, count(*) filter (where abs("offset") between 31 and 100) as d_31_100, count(*) filter (where abs("offset") between 101 and 300) as d_101_window,
(select cast(coalesce(v[cast(len(v) // 2 as int) + 1], 0) as bigint) from m) as median_abs, (select count(*) from go) as gold, (select count(*) from go where d is null or d > 300) as missed from po"""


@query("agg_start_offsets_hist", compared(f"{NEAR}, {OFFSET_MEDIAN} {OFFSET_ROWS}"))
def agg_start_offsets_hist(spark, sf):
    return evaluate.offset_report(*evaluate.start_offsets(pairs(spark, sf), ["scaffold"]))


@query("agg_merge_offsets", compared(f"{NEAR} select species, count(*) as n, count(*) filter (where \"offset\" is null) as unmatched from po join seqs using (scaffold) group by species"))
def agg_merge_offsets(spark, sf):
    p, _ = evaluate.start_offsets(pairs(spark, sf), ["species", "scaffold"])
    return p.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset").isNull()).alias("unmatched"))


@query("agg_calibration_objective", "select 1 as one, round((0.5 + 0.25 + 0.75) / 3, 9) as objective")
def agg_calibration_objective(spark, sf):
    return spark.range(1).select(F.lit(1).alias("one"), F.round(evaluate.objective(F.lit(0.5), F.lit(0.25), F.lit(0.75)), 9).alias("objective"))


@query("set_union_species", f"with {SEQ} select species, count(*) as scaffolds, cast(sum(length(sequence)) as bigint) as bases from seqs group by species")
def set_union_species(spark, sf):
    s = scaffolds(spark, sf)
    both = s.where("species = 'en'").unionByName(s.where("species <> 'en'"))
    return both.groupBy("species").agg(F.count(F.lit(1)).alias("scaffolds"), F.sum(F.length("sequence").cast("long")).alias("bases"))


@query("flt_species_prefix", f"with {SEQ} select scaffold from seqs where species = 'en'")
def flt_species_prefix(spark, sf):
    return scaffolds(spark, sf).where("species = 'en'").select("scaffold")


@query("jn_zip_species", f"with {SEQ}, {FEAT} select species, count(*) as cds from feats join seqs using (scaffold) group by species")
def jn_zip_species(spark, sf):
    return features(spark, sf).join(scaffolds(spark, sf).select("species", "scaffold"), "scaffold").groupBy("species").agg(F.count(F.lit(1)).alias("cds"))


def report_sql(title: str, columns: list[str]) -> str:
    """The lines of `r` as a fixed-width report."""
    cells = " || ".join(f"lpad(cast({c} as varchar), 14, ' ')" for c in columns)
    return f"select 0 as ord, '{title}' as value union all select 1, '{''.join(f'{c:>14}' for c in columns)}' union all select 2, {cells} from r"


OFFSETS = ["predicted", "exact", "within_window", "spurious", "upstream", "downstream", "in_frame", "out_of_frame", "d_1_2", "d_3", "d_4_9", "d_10_30", "d_31_100", "d_101_window", "median_abs", "gold", "missed"]


@query("snk_validation_report", compared(f"{BOUNDARY}, r as ({BOUNDARY_ROWS}) {report_sql('Boundaries', ['boundary', 'exact', 'predicted', 'gold'])}"))
def snk_validation_report(spark, sf):
    from ..sinks.files import report_lines

    return report_lines(evaluate.boundary_metrics(evaluate.confusion(pairs(spark, sf))), "Boundaries", ["boundary", "exact", "predicted", "gold"])


@query("snk_offset_report", compared(f"{NEAR}, {OFFSET_MEDIAN}, r as ({OFFSET_ROWS}) {report_sql('Start offsets', OFFSETS)}"))
def snk_offset_report(spark, sf):
    from ..sinks.files import report_lines

    return report_lines(evaluate.offset_report(*evaluate.start_offsets(pairs(spark, sf), ["scaffold"])), "Start offsets", OFFSETS)
