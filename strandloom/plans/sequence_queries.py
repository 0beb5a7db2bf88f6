"""Queries over sources, sequences and columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import runs
from ..functions import sequence as sq
from ..operators import counting, dataset, genes, model, prefix
from ..sources import adapters, files
from ..sources.adapters import scaffolds, table
from ..sinks import files as sinks
from .oracle import SEQ
from .registry import query

# every document as a FASTA record with CRLF ends, a species as a file
LINES = """lines as (select lang as file, doc_id * 1000000 as line_no, '>' || doc_id || ' ' || source as value from documents
  union all select lang, doc_id * 1000000 + i, value from (select lang, doc_id, unnest(string_split(text, chr(10))) as value, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"""


def fasta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = docs.select(F.col("lang").alias("file"), (F.col("doc_id") * 1000000).alias("line_no"), F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" "), "source").alias("value"))
    body = docs.select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "value")).select(F.col("lang").alias("file"), (F.col("doc_id") * 1000000 + F.col("i") + 1).alias("line_no"), "value")
    return head.unionByName(body)


CLEAN = "regexp_replace(translate(trim(value), 'acgt', 'ACGT'), '[^ACGT]', 'A', 'g')"
RECORDS = f"""{LINES}, recs as (select file, line_no // 1000000 as id, string_agg(case when line_no % 1000000 > 0 then {CLEAN} end, '' order by line_no) as sequence from lines group by all),
rng as (select file, id, cast(id as varchar) as name, row_number() over (partition by file order by id) as ord, length(sequence) as n, sum(length(sequence)) over (partition by file order by id) as e from recs)"""


@query("src_fasta_sequence", f"with {RECORDS} select rng.file, cast(rng.ord as bigint) as ord, name, cast(n as bigint) as length, md5(sequence) as digest from rng join recs using (file, id)")
def src_fasta_sequence(spark, sf):
    r = files.fasta_records(fasta_table(spark, sf))
    return r.select("file", "ord", "name", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("digest"))


@query("src_fasta_length", f"with {LINES} select file, cast(sum(length(value)) as bigint) as length from lines where line_no % 1000000 > 0 and value not like '>%' group by file")
def src_fasta_length(spark, sf):
    return files.fasta_length(fasta_table(spark, sf))


@query("src_fasta_ranges", f"with {RECORDS} select file, cast(ord as bigint) as ord, name, cast(e - n as bigint) as start, cast(e as bigint) as \"end\" from rng")
def src_fasta_ranges(spark, sf):
    return files.fasta_ranges(files.fasta_records(fasta_table(spark, sf)))


@query("src_fasta_offsets", f"with {RECORDS} select file, name, cast(max(e - n) as bigint) as \"offset\" from rng group by file, name")
def src_fasta_offsets(spark, sf):
    return files.fasta_offsets(files.fasta_ranges(files.fasta_records(fasta_table(spark, sf))))


@query("src_fasta_py", f"with {LINES} select file, cast(line_no // 1000000 as varchar) as name, md5(string_agg(case when line_no % 1000000 > 0 then translate(trim(value), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') end, '' order by line_no)) as digest from lines group by file, line_no // 1000000")
def src_fasta_py(spark, sf):
    return files.fasta_records(fasta_table(spark, sf), keep_letters=True).select("file", "name", F.md5("sequence").alias("digest"))


@query("src_upload_stats", f"with {LINES} select file, cast(greatest(count(*) filter (where value like '>%'), 1) as bigint) as scaffolds, cast(sum(case when value not like '>%' then length(regexp_replace(value, '[^ACGTNacgtn]', '', 'g')) else 0 end) as bigint) as bases from lines group by file")
def src_upload_stats(spark, sf):
    return files.upload_stats(fasta_table(spark, sf))


@query("agg_upload_totals", f"with {LINES}, u as (select file, count(*) filter (where value like '>%') as s, sum(case when value not like '>%' then length(regexp_replace(value, '[^ACGTNacgtn]', '', 'g')) else 0 end) as b from lines group by file) select count(*) as files, cast(sum(s) as bigint) as scaffolds, cast(sum(b) as bigint) as bases from u where file <> 'de'")
def agg_upload_totals(spark, sf):
    return files.upload_stats(fasta_table(spark, sf)).where("file <> 'de'").agg(F.count(F.lit(1)).alias("files"), F.sum("scaffolds").alias("scaffolds"), F.sum("bases").alias("bases"))


# lineitem as GFF3 lines: every third has another type, every seventh no parent, every eleventh a wrong number of fields
GFF = """g as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_orderkey || chr(9) || 'src' || chr(9) || case when l_partkey % 3 = 0 then 'exon' else 'CDS' end || chr(9) || l_partkey || chr(9) || (l_partkey + 10 * l_linenumber)
  || chr(9) || '.' || chr(9) || case when l_returnflag = 'R' then '-' else '+' end || chr(9) || '0' || case when l_suppkey % 11 = 0 then '' else chr(9) || 'ID=c' || l_linenumber || case when l_suppkey % 7 = 0 then ';XParent=q' || l_suppkey || ';N=1' when l_suppkey % 7 = 1 then '' else ';Parent=t' || l_orderkey || ';N=1' end end as value from lineitem)"""


def gff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    kind = F.when(F.col("l_partkey") % 3 == 0, "exon").otherwise("CDS")
    who = F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit(";XParent=q"), s("l_suppkey"), F.lit(";N=1"))).when(F.col("l_suppkey") % 7 == 1, "").otherwise(F.concat(F.lit(";Parent=t"), s("l_orderkey"), F.lit(";N=1")))
    attrs = F.when(F.col("l_suppkey") % 11 == 0, "").otherwise(F.concat(F.lit("\tID=c"), s("l_linenumber"), who))
    value = F.concat(F.concat_ws("\t", s("l_orderkey"), F.lit("src"), kind, s("l_partkey"), (F.col("l_partkey") + 10 * F.col("l_linenumber")).cast("string"), F.lit("."), F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.lit("0")), attrs)
    return li.select(value.alias("value"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


CDS = f"""{GFF}, cds as (select string_split(value, chr(9)) as f from g where len(string_split(value, chr(9))) = 9),
c as (select f[1] as scaffold, regexp_extract(f[9], 'Parent=([^;]*)', 1) as parent, cast(f[4] as bigint) - 1 as start0, cast(f[5] as bigint) - 1 as end0, f[7] as strand from cds where f[3] = 'CDS')"""


@query("src_gff_cds", f"with {CDS} select * from c where parent <> ''")
def src_gff_cds(spark, sf):
    return files.gff_cds(gff_table(spark, sf))


ATTRS = f"{GFF}, a as (select value, string_split(value, chr(9))[9] as attrs from g where len(string_split(value, chr(9))) = 9)"


@query("src_gff_parent", f"with {ATTRS} select attrs, regexp_extract(attrs, 'Parent=([^;]*)', 1) as parent, count(*) as n from a group by all")
def src_gff_parent(spark, sf):
    f = F.split("value", "\t")
    return gff_table(spark, sf).where(F.size(f) == 9).select(f[8].alias("attrs")).select("attrs", files.parent(F.col("attrs")).alias("parent")).groupBy("attrs", "parent").agg(F.count(F.lit(1)).alias("n"))


@query("src_gff_parent_py", f"with {ATTRS} select attrs, substr(list_filter(string_split(attrs, ';'), lambda x: x like 'Parent=%')[1], 8) as parent, count(*) as n from a group by all")
def src_gff_parent_py(spark, sf):
    f = F.split("value", "\t")
    return gff_table(spark, sf).where(F.size(f) == 9).select(f[8].alias("attrs")).select("attrs", files.parent_field(F.col("attrs")).alias("parent")).groupBy("attrs", "parent").agg(F.count(F.lit(1)).alias("n"))


@query("jn_feature_scaffold", f"with {CDS} select c.*, cast(o_custkey as bigint) as \"offset\" from c join orders on c.scaffold = cast(o_orderkey as varchar) where parent <> '' and o_orderstatus = 'F'")
def jn_feature_scaffold(spark, sf):
    names = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").alias("offset"))
    return files.known_scaffolds(files.gff_cds(gff_table(spark, sf)), names)


# score files: the events' values by user, several rows a position, two files with an offset each
SCORES = "sc as (select case when event_id % 2 = 0 then 0 else 100000 end + user_id as pos, event_id, floor(value * 100) / 100 as v from events)"


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor(F.col("value") * 100).cast("double") / 100
    return adapters.events(spark, sf_dir).select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), (F.when(F.col("event_id") % 2 == 0, 0).otherwise(100000) + F.col("user_id")).alias("p"), v.alias("v")).select("file", "line_no", F.concat_ws("\t", F.col("p").cast("string"), F.col("v").cast("string"), (-F.col("v")).cast("string")).alias("value"))


@query("src_splice_scores", f"with {SCORES} select pos, arg_max(v, event_id) as donor, -arg_max(v, event_id) as acceptor from sc group by pos")
def src_splice_scores(spark, sf):
    return files.score_lines(score_table(spark, sf), ("donor", "acceptor"), length=10_000_000)


@query("src_start_scores", f"with {SCORES} select pos, arg_max(v, event_id) as start from sc group by pos")
def src_start_scores(spark, sf):
    return files.score_lines(score_table(spark, sf), ("start",), length=10_000_000)


@query("src_score_lookup", f"with {SCORES}, s as (select pos, arg_max(v, event_id) as start from sc group by pos) select c_custkey as pos, coalesce(start, 0.0) as start from customer left join s on pos = c_custkey")
def src_score_lookup(spark, sf):
    scores = files.score_lines(score_table(spark, sf), ("start",))
    return files.look_up(table(spark, sf, "customer").select(F.col("c_custkey").alias("pos")), scores, ("start",), ["pos"])


@query("src_species_tsv", "select 'f' || n_nationkey as folder, n_name as taxon, 'g' || n_regionkey as group_name from nation where n_nationkey % 3 <> 0")
def src_species_tsv(spark, sf):
    n = table(spark, sf, "nation")
    mark = F.when(F.col("n_nationkey") % 3 == 0, "# ").otherwise("")
    lines = n.select(F.concat(mark, F.lit("f"), F.col("n_nationkey").cast("string"), F.lit("\t"), "n_name", F.lit("\tg"), F.col("n_regionkey").cast("string")).alias("value"))
    return files.species_list(lines)


@query("src_manifest_json", "select cast(s_suppkey as varchar) as accession, s_name as organism from supplier where s_suppkey % 4 <> 0")
def src_manifest_json(spark, sf):
    s = table(spark, sf, "supplier")
    text = s.select(F.to_json(F.struct(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey").cast("string")).alias("accession"), F.col("s_name").alias("organism"))).alias("j"))
    return files.with_accession(text.select(F.from_json("j", "accession string, organism string").alias("j")).select("j.*"))


PROFILE = {"dataset": {"species": [{"name": "a"}, {"name": "b"}]}, "filters": {"min_first_cds_bp": 3, "min_intron_bp": 20, "require_3n_cds": True}, "smoothing": {"transition_alpha": 0.02, "emission_alpha": 0.1}, "splice_cnn": {"train_scores": "x.tsv"}, "start_cnn": {"test_scores": ["y.tsv", "z.tsv"], "start_bias": -6.0}}


@query("src_profile_json", "select 2 as species, 3 as min_last_cds_bp, 20 as min_intron_bp, true as require_3n_cds, cast(0.02 as double) as transition_alpha, cast(0.1 as double) as emission_alpha, cast(-6 as double) as start_bias, cast(1 as double) as donor_scale, 1 as splice_files, 2 as start_files")
def src_profile_json(spark, sf):
    p = files.Profile.from_dict(PROFILE)
    row = (len(p.species), p.min_last_cds_bp, p.min_intron_bp, p.require_3n_cds, p.transition_alpha, p.emission_alpha, p.start_bias, p.donor_scale, len(p.splice_scores["train_scores"]), len(p.start_scores["test_scores"]))
    return spark.createDataFrame([row], "species int, min_last_cds_bp int, min_intron_bp int, require_3n_cds boolean, transition_alpha double, emission_alpha double, start_bias double, donor_scale double, splice_files int, start_files int")


@query("src_manual_profile", "select 30 as min_intron_bp, cast(0.5 as double) as donor_bias, true as include_minus_strand")
def src_manual_profile(spark, sf):
    p = files.Profile.from_dict({}, min_intron_bp=30, donor_bias=0.5)
    return spark.createDataFrame([(p.min_intron_bp, p.donor_bias, p.include_minus_strand)], "min_intron_bp int, donor_bias double, include_minus_strand boolean")


@query("snk_profile_build", "select n_name as species, 20 as min_intron_bp from nation")
def snk_profile_build(spark, sf):
    names = [r[0] for r in table(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]  # a species list is configuration
    text = sinks.profile_json(files.Profile(species=[{"name": n} for n in names]))
    d = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "dataset struct<species:array<struct<name:string>>>, filters struct<min_intron_bp:int>").alias("j"))
    return d.select(F.explode("j.dataset.species").alias("s"), "j.filters.min_intron_bp").select(F.col("s.name").alias("species"), "min_intron_bp")


# columns over sequences


@query("prj_reverse_complement", f"with {SEQ} select scaffold, md5(translate(reverse(sequence), 'ACGT', 'TGCA')) as digest from seqs")
def prj_reverse_complement(spark, sf):
    return scaffolds(spark, sf).select("scaffold", F.md5(sq.reverse_complement(F.col("sequence"))).alias("digest"))


@query("prj_revcomp_per_scaffold", f"with {SEQ} select species, md5(string_agg(translate(reverse(sequence), 'ACGT', 'TGCA'), '' order by scaffold)) as digest from seqs group by species")
def prj_revcomp_per_scaffold(spark, sf):
    return joined_digests(scaffolds(spark, sf).select("species", "scaffold", sq.reverse_complement(F.col("sequence")).alias("s")))


def joined_digests(rows: DataFrame) -> DataFrame:
    """(species, digest): MD5 of the strings `s` of each species one after the other, by scaffold. A digest is made in order, so a species goes through one task, which
    sorts on disk and holds a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, of = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([of], pa.string()), pa.array([made.hexdigest()])], ["species", "digest"])
        for batch in batches:
            for species, s in zip(batch.column("species").to_pylist(), batch.column("s").to_pylist(), strict=True):
                if made is None or species != of:
                    if made is not None:
                        yield out()
                    made, of = hashlib.md5(usedforsecurity=False), species
                made.update((s or "").encode())
        if made is not None:
            yield out()

    return rows.repartition("species").sortWithinPartitions("species", "scaffold", "s").select("species", "s").mapInArrow(run, "species string, digest string")


@query("prj_slice", f"with {SEQ} select scaffold, substr(sequence, 11, 30) as part from seqs")
def prj_slice(spark, sf):
    return scaffolds(spark, sf).select("scaffold", F.substr("sequence", F.lit(11), F.lit(30)).alias("part"))


MOTIF = f"""with {SEQ}, p as (select scaffold, sequence, unnest(range(length(sequence))) as pos from seqs)"""


@query("prj_encode_5mer", f"{MOTIF}, c as (select 256 * (instr('ACGT', substr(sequence, pos - 4, 1)) - 1) + 64 * (instr('ACGT', substr(sequence, pos - 3, 1)) - 1) + 16 * (instr('ACGT', substr(sequence, pos - 2, 1)) - 1) + 4 * (instr('ACGT', substr(sequence, pos - 1, 1)) - 1) + instr('ACGT', substr(sequence, pos, 1)) - 1 as ctx from p where pos >= 5) select cast(ctx as int) as ctx, count(*) as n from c group by ctx")
def prj_encode_5mer(spark, sf):
    return model.context_counts(scaffolds(spark, sf), 5).groupBy("ctx").agg(F.sum("cnt").alias("n"))


def motif(name: str, kind: str, sql: str) -> None:
    @query(name, f"{MOTIF} select scaffold, count(*) as n, cast(sum(pos) as bigint) as places from p where {sql} group by scaffold")
    def run(spark, sf):
        hits = counting.motif_places(scaffolds(spark, sf).select("scaffold", "sequence"), kind).where(F.size("places") > 0)
        return hits.select("scaffold", F.size("places").cast("long").alias("n"), F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p).alias("places"))


motif("flt_donor_consensus", "donor", "substr(sequence, pos + 1, 2) = 'GT'")
motif("flt_acceptor_consensus", "acceptor", "pos > 0 and substr(sequence, pos, 2) = 'AG'")
motif("flt_start_consensus", "start", "substr(sequence, pos + 1, 3) = 'ATG'")
motif("flt_stop_codon", "stop", "pos >= 2 and substr(sequence, pos - 1, 3) in ('TAA', 'TAG', 'TGA')")


@query("flt_candidates_splice", f"{MOTIF} select scaffold, pos from p where pos between 1 and length(sequence) - 2 and (substr(sequence, pos + 1, 2) = 'GT' or substr(sequence, pos, 2) = 'AG')")
def flt_candidates_splice(spark, sf):
    return dataset.splice_candidates(scaffolds(spark, sf))


@query("flt_candidates_start", f"{MOTIF} select scaffold, pos from p where substr(sequence, pos + 1, 3) = 'ATG'")
def flt_candidates_start(spark, sf):
    return dataset.start_candidates(scaffolds(spark, sf))


WIN = f"{MOTIF}, w as (select scaffold, pos, substr(repeat('N', 60) || sequence || repeat('N', 60), pos + 1, 121) as win from p where substr(sequence, pos + 1, 3) = 'ATG')"


@query("prj_window_at", f"{WIN} select scaffold, pos, md5(win) as digest from w")
def prj_window_at(spark, sf):
    s = scaffolds(spark, sf)
    return dataset.start_candidates(s).join(s, "scaffold").select("scaffold", "pos", F.md5(sq.window_at(F.col("sequence"), F.col("pos"))).alias("digest"))


@query("prj_one_hot", f"{WIN} select scaffold, pos, cast(len(list_filter(string_split(win, ''), lambda x: x = 'A')) as double) as a, cast(len(list_filter(string_split(win, ''), lambda x: x in ('A','C','G','T'))) as double) as known from w")
def prj_one_hot(spark, sf):
    from ..operators.cnn import one_hot_column

    s = scaffolds(spark, sf)
    w = dataset.start_candidates(s).join(s, "scaffold").select("scaffold", "pos", one_hot_column(sq.window_at(F.col("sequence"), F.col("pos"))).alias("x"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return w.select("scaffold", "pos", add(F.filter("x", lambda v, i: (i % 4 == 0) & (v > 0))).alias("a"), add(F.col("x")).alias("known"))


@query("prj_calibrate", "select event_id, round(value / 1.7 - (-2.5), 9) as train_side, round(0.75 * value + (-6.0), 9) as decode_side from events")
def prj_calibrate(spark, sf):
    from ..operators.cnn import calibrated

    return adapters.events(spark, sf).select("event_id", F.round(calibrated(F.col("value"), 1.7, -2.5), 9).alias("train_side"), F.round(0.75 * F.col("value") - 6.0, 9).alias("decode_side"))


@query("flt_organelle", "select source, count(*) filter (where regexp_matches(lower(source || case when doc_id % 5 = 0 then ' Mitochondrion' when doc_id % 7 = 0 then ' PLASTID x' else '' end), 'mitochond|chloroplast|plastid|apicoplast|kinetoplast')) as organelles from documents group by source")
def flt_organelle(spark, sf):
    header = F.concat("source", F.when(F.col("doc_id") % 5 == 0, " Mitochondrion").when(F.col("doc_id") % 7 == 0, " PLASTID x").otherwise(""))
    return table(spark, sf, "documents").groupBy("source").agg(F.count_if(dataset.is_organelle(header)).alias("organelles"))


# minimum slice and generic chains: events as states, by user


@query("minimum_slice", f"""with {SEQ}, b as (select unnest(range(1, length(sequence))) as pos, sequence from seqs where length(sequence) > 1),
c as (select instr('ACGT', substr(sequence, pos, 1)) - 1 as ctx, instr('ACGT', substr(sequence, pos + 1, 1)) - 1 as base, count(*) as cnt from b group by all),
g as (select x.range as ctx, y.range as base from range(4) x, range(4) y)
select cast(g.ctx as int) as ctx, cast(g.base as int) as base, coalesce(cnt, 0) as cnt, round(ln((coalesce(cnt, 0) + 0.1) / (sum(coalesce(cnt, 0)) over (partition by g.ctx) + 0.4)), 9) as log_p from g left join c using (ctx, base)""")
def minimum_slice(spark, sf):
    """For each previous base and base the count and the smoothed log probability."""
    return model.markov_log_probs(model.context_counts(scaffolds(spark, sf), 1), 1).select("ctx", "base", "cnt", F.round("log_p", 9).alias("log_p"))


CHAIN = "e as (select user_id, event_type as s, lead(event_type) over (partition by user_id order by ts, event_id) as nx, lag(event_type) over (partition by user_id order by ts, event_id) as pv from events)"


@query("chain_bigrams", f"with {CHAIN} select f, t, count(*) as cnt from (select s as f, coalesce(nx, 'END') as t from e union all select 'START', s from e where pv is null) group by f, t")
def chain_bigrams(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = adapters.events(spark, sf).select(F.col("event_type").alias("f"), F.coalesce(F.lead("event_type").over(w), F.lit("END")).alias("t"), F.lag("event_type").over(w).alias("p"))
    return e.select("f", "t").unionByName(e.where("p is null").select(F.lit("START").alias("f"), F.col("f").alias("t"))).groupBy("f", "t").agg(F.count(F.lit(1)).alias("cnt"))


# the browser's column logic, on orders as genes

GENES = """gn as (select 'pred_' || repeat('0', 4 - length(cast(o_orderkey as varchar))) || o_orderkey as id, 'sc' || o_custkey % 50 as scaffold, case when o_orderstatus = 'F' then '-' else '+' end as strand,
  o_orderkey % 9000 + 1 as start, o_orderkey % 9000 + 1 + o_custkey % 700 as \"end\" from orders)"""


def gene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    start = F.col("o_orderkey") % 9000 + 1
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("pred_"), F.when(F.length(key) < 4, F.lpad(key, 4, "0")).otherwise(key)).alias("id"), F.concat(F.lit("sc"), (F.col("o_custkey") % 50).cast("string")).alias("scaffold"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"), start.alias("start"), (start + F.col("o_custkey") % 700).alias("end"), "o_orderkey")


@query("prj_gene_locus", f"with {GENES} select id, start, case when strand = '-' then \"end\" - 2 else start end as start_codon, case when strand = '-' then start else \"end\" - 2 end as stop_codon, \"end\" - start + 1 as length from gn")
def prj_gene_locus(spark, sf):
    return gene_table(spark, sf).select("id", "start", *(c.alias(n) for n, c in genes.locus(F.col("start"), F.col("end"), F.col("strand")).items()))


@query("prj_highlight", f"with {SEQ}, h as (select scaffold, sequence as s from seqs) select scaffold, case when length(s) <= 6 then s else substr(s, 1, 3) end as head, case when length(s) <= 6 then '' else substr(s, 4, length(s) - 6) end as middle, case when length(s) <= 6 then '' else right(s, 3) end as tail from h")
def prj_highlight(spark, sf):
    s = scaffolds(spark, sf).select("scaffold", F.col("sequence").alias("s"))
    return s.select("scaffold", *(c.alias(n) for n, c in genes.highlight(F.col("s")).items()))


@query("flt_gene_search", f"with {GENES} select * from gn where contains(lower(id), 'c7') or contains(lower(scaffold), 'c7')")
def flt_gene_search(spark, sf):
    return genes.search(gene_table(spark, sf).drop("o_orderkey"), " C7 ")


@query("flt_gene_range", f"with {GENES} select * from gn where \"end\" >= 2000 and start <= 2500")
def flt_gene_range(spark, sf):
    return genes.in_range(gene_table(spark, sf).drop("o_orderkey"), 2500, 2000)


@query("flt_track_visible", f"with {GENES} select id, start, greatest(start, 3000) as from_, least(\"end\", 3600) as to_, round((greatest(start, 3000) - 3000) / 601.0 * 100, 9) as left_, round((least(\"end\", 3600) - greatest(start, 3000) + 1) / 601.0 * 100, 9) as width from gn where \"end\" >= 3000 and start <= 3600")
def flt_track_visible(spark, sf):
    a, b = F.greatest("start", F.lit(3000)), F.least("end", F.lit(3600))
    left, width = genes.track(a, b, F.lit(3000), F.lit(3600))
    return genes.in_range(gene_table(spark, sf), 3000, 3600).select("id", "start", a.alias("from_"), b.alias("to_"), F.round(left, 9).alias("left_"), F.round(width, 9).alias("width"))


@query("prj_track_geometry", f"with {GENES} select id, start, cast(3000 + least(floor(least(greatest(((start % 120) - 10) / 100.0, 0), 1) * 601), 600) as bigint) as base from gn")
def prj_track_geometry(spark, sf):
    pointer = ((F.col("start") % 120) - 10) / F.lit(100.0)
    return gene_table(spark, sf).select("id", "start", genes.base_under(pointer, F.lit(3000), F.lit(3600)).cast("long").alias("base"))


@query("prj_focus_window", f"with {GENES} select id, start, greatest(1, start - cast(ceil((\"end\" - start + 1) * 0.25) as bigint)) as view_start, least(9500, \"end\" + cast(ceil((\"end\" - start + 1) * 0.25) as bigint)) as view_end from gn")
def prj_focus_window(spark, sf):
    a, b = genes.focus_view(F.col("start"), F.col("end"), F.lit(9500))
    return gene_table(spark, sf).select("id", "start", a.alias("view_start"), b.alias("view_end"))


@query("flt_clamp_range", f"with {GENES}, v as (select id, start, start - 40 as a, start - 40 + (\"end\" - start) * (case when strand = '-' then -1 else 3 end) as b from gn), c as (select *, greatest(1, least(a, 9500)) as a1, least(greatest(b - greatest(1, least(a, 9500)) + 1, 5), 500000, 9500) as w from v) select id, start, greatest(1, least(a1, 9500 - w + 1)) as view_start, greatest(1, least(a1, 9500 - w + 1)) + w - 1 as view_end from c")
def flt_clamp_range(spark, sf):
    a = F.col("start") - 40
    b = a + (F.col("end") - F.col("start")) * F.when(F.col("strand") == "-", -1).otherwise(3)
    x, y = genes.clamp_view(a, b, F.lit(9500))
    return gene_table(spark, sf).select("id", "start", x.alias("view_start"), y.alias("view_end"))


@query("flt_validate_range", f"with {GENES}, v as (select id, start as s, start - 40 as a, start - 40 + (\"end\" - start) * (case when strand = '-' then -1 else 3 end) as b from gn) select id, s as start, case when a > b then 1 when a < 1 or b > 9500 then 2 when b - a + 1 < 5 then 3 else 0 end as refused from v")
def flt_validate_range(spark, sf):
    a = F.col("start") - 40
    b = a + (F.col("end") - F.col("start")) * F.when(F.col("strand") == "-", -1).otherwise(3)
    m = genes.range_message(a, b, F.lit(9500))
    code = F.when(m.startswith("Start"), 1).when(m.startswith("The range"), 2).when(m.startswith("Show at least"), 3).when(m.isNull(), 0).otherwise(4)
    return gene_table(spark, sf).select("id", "start", code.alias("refused"))


@query("srt_page", f"with {GENES} select id, start, strand from gn order by scaffold, start, id, strand, \"end\" limit 10 offset 20")
def srt_page(spark, sf):
    return genes.page(gene_table(spark, sf), 3, order=("scaffold", "start", "id", "strand", "end")).select("id", "start", "strand")


@query("srt_run_order", "select event_id, cast(row_number() over (order by ts desc, event_id desc) as int) as place from events where event_type = 'purchase'")
def srt_run_order(spark, sf):
    """The newest first."""
    runs_of = adapters.events(spark, sf).where("event_type = 'purchase'").select("event_id", "ts")
    return prefix.ranked(runs_of, [F.desc("ts"), F.desc("event_id")]).select("event_id", F.col("rank_").cast("int").alias("place"))


@query("prj_intervals_fwd", f"with {GENES} select id, start, 10000 - \"end\" + 1 as fwd_start, 10000 - start + 1 as fwd_end from gn where strand = '-'")
def prj_intervals_fwd(spark, sf):
    a, b = sq.revcomp_interval(F.col("start"), F.col("end"), F.lit(10000))
    return gene_table(spark, sf).where("strand = '-'").select("id", "start", a.alias("fwd_start"), b.alias("fwd_end"))


@query("prj_pred_id", "select 'pred_' || case when rn < 10000 then lpad(cast(rn as varchar), 4, '0') else cast(rn as varchar) end as id, o_orderkey as scaffold from (select o_orderkey, row_number() over (order by o_orderkey) as rn from orders)")
def prj_pred_id(spark, sf):
    g = table(spark, sf, "orders").select(F.lit("s").alias("species"), F.col("o_orderkey").alias("scaffold"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("+").alias("strand"))
    return genes.number_genes(g).select("id", "scaffold")


@query("fn_formats", "select s_suppkey, format('{:.4f}', s_acctbal) as acct, array_to_string([s_name, cast(s_nationkey as varchar)], ',') as joined from supplier")
def fn_formats(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.format_string("%.4f", F.col("s_acctbal")).alias("acct"), F.array_join(F.array("s_name", F.col("s_nationkey").cast("string")), ",").alias("joined"))


# data sets


@query("agg_rank_assembly", """select p_brand as taxon, accession from (select p_brand, lpad(cast(p_partkey as varchar), 9, '0') as accession, row_number() over (partition by p_brand order by case when p_size % 2 = 0 then 0 else 1 end,
 case when p_size % 5 = 0 then 0 when p_size % 5 = 1 then 1 else 2 end, case when p_size % 7 = 0 then 0 when p_size % 7 = 1 then 1 when p_size % 7 = 2 then 2 when p_size % 7 = 3 then 3 else 4 end, lpad(cast(p_partkey as varchar), 9, '0')) as rn from part where p_size % 3 <> 0) where rn = 1""")
def agg_rank_assembly(spark, sf):
    m = lambda k, names: F.coalesce(F.get(F.array(*map(F.lit, names)), (F.col("p_size") % k).cast("int")), F.lit("other"))
    r = table(spark, sf, "part").select(F.col("p_brand").alias("taxon"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("accession"), F.when(F.col("p_size") % 2 == 0, "refseq").otherwise("genbank").alias("source"), m(5, ["Reference genome", "representative genome"]).alias("category"), m(7, ["Complete Genome", "chromosome", "Scaffold", "Contig"]).alias("level"), (F.col("p_size") % 3 != 0).alias("annotated"))
    return dataset.rank_assembly(r).select("taxon", "accession")


SPLIT = "chosen as (select distinct l_orderkey as scaffold from lineitem where l_returnflag = 'R'), excl as (select distinct l_orderkey as scaffold from lineitem where l_linestatus = 'O' and l_quantity > 45)"


def split_tables(spark, sf):
    li = table(spark, sf, "lineitem")
    pick = lambda c: li.where(c).select(F.col("l_orderkey").alias("scaffold")).distinct()
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("scaffold")), pick("l_returnflag = 'R'"), pick("l_linestatus = 'O' and l_quantity > 45")


@query("jn_split_semi", f"with {SPLIT} select o_orderkey as scaffold from orders where o_orderkey in (select scaffold from chosen)")
def jn_split_semi(spark, sf):
    o, c, _ = split_tables(spark, sf)
    return dataset.test_split(o, c)


@query("jn_split_anti", f"with {SPLIT} select o_orderkey as scaffold from orders where o_orderkey not in (select scaffold from chosen) and o_orderkey not in (select scaffold from excl)")
def jn_split_anti(spark, sf):
    return dataset.train_split(*split_tables(spark, sf))


@query("set_minus_train", f"with {SPLIT} select o_orderkey as scaffold from orders except select scaffold from chosen except select scaffold from excl")
def set_minus_train(spark, sf):
    o, c, e = split_tables(spark, sf)
    return o.exceptAll(c.unionByName(e).distinct()).distinct()


@query("smp_train_val", "select o_orderkey, row_number() over (order by md5('13:' || o_orderkey), o_orderkey) > count(*) over () - greatest(1, floor(count(*) over () / 10)) as is_validation from orders")
def smp_train_val(spark, sf):
    return dataset.split_validation(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("smp_even_ranges", "with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders) select o_orderkey from r where i in (select distinct x.range * n // 64 from range(64) x)")
def smp_even_ranges(spark, sf):
    from ..operators.evaluate import even_sample

    return even_sample(table(spark, sf, "orders").select("o_orderkey"), 64, ["o_orderkey"])


@query("srt_example_intervals", "select o_orderkey from orders order by o_orderkey limit 5")
def srt_example_intervals(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(5)


AP = "x as (select event_id as tie, value as score, case when event_type in ('purchase', 'click') then 1 else 0 end as label from events)"


@query("agg_average_precision", f"with {AP}, r as (select *, row_number() over (order by score desc, tie) as k, sum(label) over (order by score desc, tie rows unbounded preceding) as h from x) select round(sum(case when label = 1 then h / k else 0 end) / sum(label), 9) as average_precision from r")
def agg_average_precision(spark, sf):
    from ..operators.evaluate import average_precision

    x = adapters.events(spark, sf).select(F.col("event_id").alias("tie"), F.col("value").alias("score"), F.col("event_type").isin("purchase", "click").cast("int").alias("label"))
    return average_precision(x).select(F.round("average_precision", 9).alias("average_precision"))


@query("agg_prior_logit", f"with {AP} select round(ln(avg(label) / (1 - avg(label))), 9) as prior_logit from x")
def agg_prior_logit(spark, sf):
    from ..operators.evaluate import prior_logit

    return adapters.events(spark, sf).agg(F.round(prior_logit(F.col("event_type").isin("purchase", "click").cast("int")), 9).alias("prior_logit"))


@query("agg_percentile_floor", "with s as (select user_id, list(value order by value) as v from events group by user_id) select user_id, round(v[cast(floor(0.95 * (len(v) - 1)) as int) + 1], 9) as p95 from s")
def agg_percentile_floor(spark, sf):
    return prefix.percentiles_floor(adapters.events(spark, sf), ["user_id"], "value", 0.95).select("user_id", F.round("percentile", 9).alias("p95"))


@query("fn_date", """select event_id, regexp_replace(event_type || case event_id % 3 when 0 then '.fna' when 1 then '.FASTA' else '.txt' end, '\\.(fna|fa|fasta)$', '', 'i') || '_' || strftime(ts, '%Y%m%dT%H%M%S') as name, strftime(ts, '%b %-d, %Y') as display,
  epoch_us(ts) // 1000 - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) // 1000 as elapsed_ms from events""")
def fn_date(spark, sf):
    """Events as runs: name, display date and the whole milliseconds since the user's run before."""
    file = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, ".fna").when(F.col("event_id") % 3 == 1, ".FASTA").otherwise(".txt"))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return adapters.events(spark, sf).select("event_id", runs.run_name(file, F.col("ts")).alias("name"), runs.display_date(F.col("ts")).alias("display"), runs.elapsed_ms(before, F.col("ts")).alias("elapsed_ms"))


UNITS = "u as (select doc_id, length(text) * (case doc_id % 3 when 0 then 1 when 1 then 97 else length(text) end) as n from documents where text is not null and doc_id is not null)"


@query("fn_units", f"""with {UNITS} select doc_id, format('{{:,}}', n) as shown, case when n < 1024 then n || ' B' when n < 1048576 then format('{{:.1f}} KB', floor(n / 1024.0::double * 10 + 0.5) / 10) else format('{{:.1f}} MB', floor(n / 1048576.0::double * 10 + 0.5) / 10) end as size,
  '1-' || n || ', ' || (n + 1) || '-' || (n + 5) as intervals from u""")
def fn_units(spark, sf):
    """Sizes made of text lengths: separators, byte units and interval lists."""
    size = F.char_length("text").cast("long")
    n = size * F.when(F.col("doc_id") % 3 == 0, F.lit(1)).when(F.col("doc_id") % 3 == 1, F.lit(97)).otherwise(size)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    rows = table(spark, sf, "documents").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", n.alias("n"))
    both = F.array(span(F.lit(1).cast("long"), F.col("n")), span(F.col("n") + 1, F.col("n") + 5))
    return rows.select("doc_id", runs.thousands(F.col("n")).alias("shown"), runs.byte_size(F.col("n")).alias("size"), runs.interval_list(both).alias("intervals"))
