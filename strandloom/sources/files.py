"""Text sources as DataFrames: FASTA, GFF3, score tables, profiles, species lists. Parsers work on numbered lines (file, line_no, value), so they can be
fed from files or from any table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import clean
from ..operators.prefix import ranked


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) in file order; carriage returns are dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return whole.withColumn("value", F.regexp_replace("value", "\r", ""))


def fasta_lines(lines: DataFrame) -> DataFrame:
    """Sequence lines with their record's ordinal and header; lines before the first header belong to none and are dropped. Headers are counted by ranges of
    (file, line_no), so a large file is spread over all tasks; a row for each file then says how many lie in the files before it."""
    head = F.startswith("value", F.lit(">"))
    counted = ranked(lines.withColumn("is_head", head), ["file", "line_no"], {"ord": F.coalesce(head.cast("long"), F.lit(0).cast("long"))}).drop("rank_")
    before = counted.groupBy(F.col("file").alias("file_")).agg((F.max("ord") - F.count_if("is_head")).alias("before_"))
    marked = counted.join(F.broadcast(before), F.col("file").eqNullSafe(F.col("file_"))).withColumn("ord", F.col("ord") - F.col("before_")).drop("file_", "before_").where("ord > 0")  # a row for each file
    return marked.withColumn("header", F.when(F.col("is_head"), F.substr("value", F.lit(2))))


def first_token(header: Column) -> Column:
    return F.regexp_extract(header, r"^\s*(\S*)", 1)


def fasta_records(lines: DataFrame, keep_letters: bool = False) -> DataFrame:
    """(file, ord, name, header, sequence): letters other than ACGT become A, or stay (upper-cased ASCII) with keep_letters."""
    rows = fasta_lines(lines)
    body = F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line_no", "value"))))
    text = F.array_join(F.transform(body, lambda x: F.trim(F.regexp_replace(x["value"], "\r", ""))), "")
    seq = F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if keep_letters else clean(text)
    return rows.groupBy("file", "ord").agg(F.max("header").alias("header"), seq.alias("sequence")).select("file", "ord", first_token(F.col("header")).alias("name"), "header", "sequence")


def fasta_length(lines: DataFrame) -> DataFrame:
    """(file, length): characters of all lines that aren't headers, without line ends."""
    size = F.when(~F.startswith("value", F.lit(">")), F.length(F.regexp_replace("value", "[\r\n]", "")))
    return lines.groupBy("file").agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("length"))


def fasta_ranges(records: DataFrame) -> DataFrame:
    """(file, ord, name, start, end): places of the records in their concatenation."""
    sizes = records.select("file", "ord", "name", F.length("sequence").cast("long").alias("n"))
    placed = ranked(sizes, ["file", "ord"], {"end": F.col("n")})  # by ranges: no file in one task
    before = placed.groupBy(F.col("file").alias("file_")).agg(F.min(F.col("end") - F.col("n")).alias("before_"))
    own = placed.join(F.broadcast(before), F.col("file").eqNullSafe(F.col("file_"))).withColumn("end", F.col("end") - F.col("before_"))
    return own.select("file", "ord", "name", (F.col("end") - F.col("n")).alias("start"), "end")


def fasta_offsets(ranges: DataFrame) -> DataFrame:
    """(file, name, offset); of records with one name the last counts."""
    return ranges.groupBy("file", "name").agg(F.max_by("start", "ord").alias("offset"))


def upload_stats(lines: DataFrame) -> DataFrame:
    """(file, scaffolds, bases): headers, or 1 without any; ACGTN letters of the other lines."""
    head = F.startswith("value", F.lit(">"))
    return lines.groupBy("file").agg(F.greatest(F.count_if(head), F.lit(1)).alias("scaffolds"), F.coalesce(F.sum(F.when(~head, F.length(F.regexp_replace("value", "[^ACGTNacgtn]", "")))), F.lit(0)).cast("long").alias("bases"))


def parent(attributes: Column) -> Column:
    """What follows the first `Parent=` anywhere, up to a semicolon; empty if there is none."""
    return F.regexp_extract(attributes, "Parent=([^;]*)", 1)


def parent_field(attributes: Column) -> Column:
    """The value of the first field that begins with `Parent=`, or null."""
    fields = F.filter(F.split(attributes, ";"), lambda f: F.startswith(f, F.lit("Parent=")))
    return F.when(F.size(fields) > 0, F.substr(F.element_at(fields, 1), F.lit(8)))


def gff_cds(lines: DataFrame) -> DataFrame:
    """(scaffold, parent, start0, end0, strand) of the CDS lines with nine fields and a parent, 0-based and closed."""
    f = F.split("value", "\t")
    rows = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(f.alias("f")).where(F.size("f") == 9).where(F.col("f")[2] == "CDS")
    return rows.select(F.col("f")[0].alias("scaffold"), parent(F.col("f")[8]).alias("parent"), (F.col("f")[3].cast("long") - 1).alias("start0"), (F.col("f")[4].cast("long") - 1).alias("end0"), F.col("f")[6].alias("strand")).where("parent <> ''")


def known_scaffolds(cds: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """CDS of scaffolds that exist, with the scaffold's offset (scaffolds: name, offset)."""
    return cds.join(scaffolds.withColumnRenamed("name", "scaffold"), "scaffold")


def score_lines(lines: DataFrame, names: tuple[str, ...], length: Column | int | None = None, offset: Column | int = 0) -> DataFrame:
    """(pos, names...) of white-space separated rows; the last row of a position counts; a position outside [0, length) is an error."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select("file", "line_no", (f[0].cast("long") + offset).alias("pos"), *(f[i + 1].cast("double").alias(n) for i, n in enumerate(names)))
    if length is not None:
        rows = rows.withColumn("pos", F.when((F.col("pos") >= 0) & (F.col("pos") < length), F.col("pos")).otherwise(F.raise_error(F.lit("score position out of range")).cast("long")))
    order = F.struct("file", "line_no")
    return rows.groupBy("pos").agg(*(F.max_by(n, order).alias(n) for n in names))


def read_score_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of score files of any size; line_no orders the lines of a file and is no count. A missing path is an error."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("line_no"), "value")


def pack_scores(lines: DataFrame, ranges: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(file, name, and for each of `names` an array of struct<pos, score> by position): what `decode` takes, from `lines` (file, line_no, value) with positions in the
    concatenation of a file's sequences. ranges: (file, name, start, end) of the sequences. The last line of a position counts; a line with another
    number of fields, a position outside all sequences, or a file without sequences is an error. A scaffold's scores are gathered by scaffold, as its
    letters are."""
    from ..operators.intervals import range_join

    f = F.split(F.trim("value"), r"\s+")
    wrong = F.raise_error(F.concat(F.lit(f"a score line needs {1 + len(names)} fields: "), "value")).cast("long")
    pos = F.when(F.size(f) == 1 + len(names), f[0].cast("long")).otherwise(wrong)
    rows = lines.where(F.trim("value") != "").select("file", "line_no", pos.alias("pos"), *(F.get(f, F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(names)))
    last = rows.groupBy("file", "pos").agg(*(F.max_by(n, "line_no").alias(n) for n in names))
    ends = ranges.groupBy("file").agg(F.max("end").alias("file_end"))
    outside = F.raise_error(F.concat(F.lit("score position out of range: "), F.col("pos").cast("string"))).cast("long")
    inside = last.join(ends, "file", "left").withColumn("pos", F.when((F.col("pos") >= 0) & (F.col("pos") < F.col("file_end")), F.col("pos")).otherwise(outside)).drop("file_end")
    spans = ranges.select("file", "name", F.col("start").alias("first_"), F.col("end").alias("behind_"))  # `start` is a score's name too
    met = range_join(inside, spans, ["file"], "pos", "first_", "behind_")
    packed = (F.array_sort(F.collect_list(F.struct((F.col("pos") - F.col("first_")).alias("pos"), F.col(n).alias("score")))).alias(n) for n in names)
    return met.groupBy("file", "name").agg(*packed)


def with_packed(sequences: DataFrame, packed: DataFrame, names: tuple[str, ...], keys: list[str]) -> DataFrame:
    """`sequences` with the arrays of `packed`, empty where a sequence has no scores."""
    there = sequences.join(packed.select(*keys, *names), keys, "left")
    return there.withColumns({n: F.coalesce(n, F.array().cast("array<struct<pos:bigint,score:double>>")) for n in names})


def look_up(bases: DataFrame, scores: DataFrame, names: tuple[str, ...], keys: list[str]) -> DataFrame:
    """Scores by position, 0 where there is none."""
    return bases.join(scores, keys, "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def species_list(lines: DataFrame) -> DataFrame:
    """(folder, taxon, group_name); blank lines and comments don't count."""
    f = F.split("value", "\t")
    return lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(f[0].alias("folder"), f[1].alias("taxon"), f[2].alias("group_name"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return with_accession(spark.read.json(path, multiLine=True))


def with_accession(genomes: DataFrame) -> DataFrame:
    return genomes.where(F.coalesce("accession", F.lit("")) != "")


@dataclass
class Profile:
    """A run's settings; keyword arguments replace what a profile file leaves out."""

    species: list[dict] = field(default_factory=list)
    min_first_cds_bp: int = 3
    min_last_cds_bp: int = 3
    min_intron_bp: int = 20
    require_3n_cds: bool = True
    include_minus_strand: bool = True
    transition_alpha: float = 0.02
    emission_alpha: float = 0.1
    donor_scale: float = 1.0
    donor_bias: float = 0.0
    acceptor_scale: float = 1.0
    acceptor_bias: float = 0.0
    start_scale: float = 1.0
    start_bias: float = 0.0
    splice_scores: dict = field(default_factory=dict)
    start_scores: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict, **over) -> Profile:
        data = d.get("dataset", {})
        known = {"species": data.get("species", [data] if data else [])}
        known |= {k: v for k, v in d.get("filters", {}).items() if k in cls.__dataclass_fields__}
        known |= {k: v for k, v in d.get("smoothing", {}).items() if k in cls.__dataclass_fields__}
        as_list = lambda v: v if isinstance(v, list) else [v]
        for section, target in (("splice_cnn", "splice_scores"), ("start_cnn", "start_scores")):
            s = d.get(section, {})
            known |= {k: float(v) for k, v in s.items() if k in cls.__dataclass_fields__}
            known[target] = {k: as_list(v) for k, v in s.items() if "scores" in k}
        return cls(**known | over)

    @classmethod
    def read(cls, spark: SparkSession, path: str, **over) -> Profile:
        import json

        return cls.from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]), **over)
