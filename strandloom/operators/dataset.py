"""Building data sets: splits, sites, examples, samples, assembly choice and organelles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement, window_at
from .counting import motif_places
from .intervals import passes_site_filters, transcripts
from .prefix import lowest, ranked

# fixed values: parts of words in a sequence's header that mark an organelle
ORGANELLES = ("mitochond", "chloroplast", "plastid", "apicoplast", "kinetoplast")


def is_organelle(header: Column) -> Column:
    return F.lower(header).rlike("|".join(ORGANELLES))


def test_split(scaffolds: DataFrame, chosen: DataFrame) -> DataFrame:
    return scaffolds.join(chosen, "scaffold", "left_semi")


def train_split(scaffolds: DataFrame, chosen: DataFrame, excluded: DataFrame) -> DataFrame:
    """What is neither test nor excluded; nothing left is an error when the rows are read."""
    left = scaffolds.join(chosen, "scaffold", "left_anti").join(excluded, "scaffold", "left_anti")
    n = left.agg(F.count(F.lit(1)).alias("n_"))
    return left.crossJoin(F.broadcast(n)).where(F.when(F.col("n_") == 0, F.raise_error(F.lit("no training scaffolds are left")).cast("boolean")).otherwise(F.lit(True))).drop("n_")  # n: one row


def cds_counts(cds: DataFrame) -> DataFrame:
    return cds.groupBy("scaffold").agg(F.count(F.lit(1)).alias("cds"))


def choose_test(counts: DataFrame, share: float = 0.1, most: float = 0.25) -> DataFrame:
    """Scaffolds with some CDS, but no more than `most` of all, in a hashed order until `share` of all CDS is reached; else the smallest with any."""
    total = counts.agg(F.sum("cds").alias("total"))
    able = counts.crossJoin(F.broadcast(total)).where((F.col("cds") > 0) & (F.col("cds") <= most * F.col("total")))
    running = ranked(able, [F.md5(F.col("scaffold").cast("string")), "scaffold"], {"upto": F.col("cds")}).withColumn("before", F.col("upto") - F.col("cds"))
    picked = running.where(F.col("before") < share * F.col("total")).select("scaffold", "cds")
    smallest = counts.where("cds > 0").orderBy("cds", "scaffold").limit(1)
    return picked.unionByName(smallest.join(picked.limit(1).select(F.lit(1).alias("any_")), F.lit(True), "left_anti"))


def rank_assembly(reports: DataFrame) -> DataFrame:
    """The best annotated assembly of each taxon: refseq before genbank, then category, level and accession."""
    # fixed values: the order of categories and levels
    kinds, levels = ("reference genome", "representative genome"), ("complete genome", "chromosome", "scaffold", "contig")
    place = lambda c, known: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, known)), F.lower(F.coalesce(c, F.lit("")))), F.lit(0)), F.lit(len(known) + 1))
    category, level = place(F.col("category"), kinds), place(F.col("level"), levels)
    w = Window.partitionBy("taxon").orderBy(F.when(F.col("source") == "refseq", 0).otherwise(1), category, level, "accession")
    return reports.where("annotated").withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def site_transcripts(features: DataFrame, strand_of: str = "strand") -> DataFrame:
    """Transcripts that the networks learn from, with one strand: that of the last fragment."""
    t = transcripts(features).where(passes_site_filters(F.col("fragments")))
    last = features.groupBy("scaffold", "parent").agg(F.max_by(strand_of, F.struct("start0", "end0")).alias("strand"))
    return t.join(last, ["scaffold", "parent"])


def splice_sites(features: DataFrame) -> DataFrame:
    """(scaffold, kind, pos, strand): first and last base of each gap; on strand - the ends change roles. One strand for a site."""
    t = site_transcripts(features).where("n > 1").select("scaffold", "strand", F.explode(F.transform(F.sequence(F.lit(1), F.size("fragments") - 1), lambda i: F.struct((F.element_at("fragments", i)["end0"] + 1).alias("left"), (F.element_at("fragments", i + 1)["start0"] - 1).alias("right")))).alias("g"))
    minus = F.col("strand") == "-"
    both = t.select("scaffold", "strand", F.explode(F.array(F.struct(F.lit("donor").alias("kind"), F.when(minus, F.col("g.right")).otherwise(F.col("g.left")).alias("pos")), F.struct(F.lit("acceptor").alias("kind"), F.when(minus, F.col("g.left")).otherwise(F.col("g.right")).alias("pos")))).alias("s"))
    return both.groupBy("scaffold", F.col("s.kind").alias("kind"), F.col("s.pos").alias("pos")).agg(F.max("strand").alias("strand"))


def start_sites(features: DataFrame) -> DataFrame:
    """(scaffold, pos, strand): where translation begins."""
    t = site_transcripts(features)
    pos = F.when(F.col("strand") == "-", F.element_at("fragments", -1)["end0"]).otherwise(F.element_at("fragments", 1)["start0"])
    return t.select("scaffold", pos.alias("pos"), "strand").groupBy("scaffold", "pos").agg(F.max("strand").alias("strand"))


def splice_candidates(sequences: DataFrame) -> DataFrame:
    """(scaffold, pos) with GT here or AG ending here, without a scaffold's two end bases."""
    rows = sequences.select("scaffold", F.length("sequence").alias("n"), "sequence")
    return motif_places(rows, "splice").select("scaffold", "n", F.explode("places").alias("pos")).where("pos > 0 and pos < n - 1").select("scaffold", "pos")


def start_candidates(sequences: DataFrame) -> DataFrame:
    return motif_places(sequences.select("scaffold", "sequence"), "start").select("scaffold", F.explode("places").alias("pos"))


def sample_negatives(candidates: DataFrame, sites: DataFrame, ratio: int = 5, seed: int = 7) -> DataFrame:
    """Up to `ratio` candidates that aren't sites for each site, in the order of a seeded hash; the hash up to which they go is found by histograms."""
    free = candidates.join(sites.select("scaffold", "pos").distinct(), ["scaffold", "pos"], "left_anti")
    want = sites.count() * ratio
    return lowest(free, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("scaffold").cast("string"), F.col("pos").cast("string"))), want, ["scaffold", "pos"])


def split_validation(rows: DataFrame, keys: list[str], seed: int = 13) -> DataFrame:
    """Adds is_validation: the last tenth, at least one row, of a seeded hash order."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    places = ranked(rows, [h, *keys], rank="i_")
    n = places.agg(F.max("i_").alias("n_"))  # one row
    return places.crossJoin(F.broadcast(n)).withColumn("is_validation", F.col("i_") > F.col("n_") - F.greatest(F.lit(1), F.floor(F.col("n_") / 10))).drop("i_", "n_")


def examples(sequences: DataFrame, sites: DataFrame, negatives: DataFrame, radius: int = 60) -> DataFrame:
    """(scaffold, pos, label, window): windows around positives, turned round on strand -, and around negatives."""
    rows = sites.select("scaffold", "pos", "strand", F.lit(1).alias("label")).unionByName(negatives.select("scaffold", "pos", F.lit("+").alias("strand"), F.lit(0).alias("label")))
    w = window_at(F.col("sequence"), F.col("pos"), radius)
    return rows.join(sequences.select("scaffold", "sequence"), "scaffold").select("scaffold", "pos", "label", F.when(F.col("strand") == "-", reverse_complement(w)).otherwise(w).alias("window"))


def species_stats(headers: DataFrame, cds: DataFrame, chosen: DataFrame) -> DataFrame:
    """(species, sequences, organelles, cds, test_share): headers (species, scaffold, header), cds and chosen by scaffold."""
    per = headers.join(cds_counts(cds), "scaffold", "left").join(chosen.select("scaffold", F.lit(1).alias("is_test")), "scaffold", "left")
    return per.groupBy("species").agg(F.count(F.lit(1)).alias("sequences"), F.count_if(is_organelle(F.col("header"))).alias("organelles"), F.coalesce(F.sum("cds"), F.lit(0)).alias("cds"), F.coalesce(F.try_divide(F.sum(F.when(F.col("is_test") == 1, F.col("cds"))).cast("double"), F.sum("cds").cast("double")), F.lit(0.0)).alias("test_share"))
