"""A corpus made ready for training: quality filter, line dedup, near-dedup, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as Parquet to the shared folder and reads them
back as the next one's documents. Stages before the last return the columns of `documents`, with `n_chars` brought up to date. A document
goes only by a stage's own decision: the classifier rejects it, all its lines are later copies, it is a near copy of a kept one, or nothing of it is
left when its repeated passages are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import cnn, lines, minhash, packing, suffixes
from strandloom.llm.queries import bucket_of_id, table, tokenizer_path
from strandloom.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some 4 MB (or one row) from here on in this session. At the default of 64 MB each task holds several such copies in the JVM's
    buffers and in Python, beside the joins that share the executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the byte-level network takes for good."""
    small_batches(spark)
    return as_documents(cnn.classify_quality(docs, table(spark, sf_dir, "labels"), bucket_of_id(3) != 1).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines and of single lines of 50 words or more; a document of which every line goes is dropped."""
    small_batches(spark)
    return as_documents(lines.dedup_lines(docs, long_words=lines.LONG_WORDS).where("n_removed = 0 or n_removed < n_lines"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    small_batches(spark)
    return as_documents(minhash.drop_near_duplicates(docs))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 200 bytes or more that also stands elsewhere; a document of which nothing else is left is dropped."""
    small_batches(spark)
    return as_documents(suffixes.drop_repeats(docs).where("n_removed = 0 or length(trim(text)) > 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 ids."""
    small_batches(spark)
    pieces = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", pack)]

ORACLE_SQL = None  # SQL can't run the classifier or the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
