"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset in a local session, a temporary folder of this machine, kept for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """The same rows, written once and read back: cuts the lineage, survives lost executors; deleted by `discard` or when the driver ends. by: a column
    whose values get folders of their own, so a filter on it reads only those."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    files, where = file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        files, where = file_system(table.sparkSession, table._stored_at)
        files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file whole or not at all: written aside, then renamed; an older one gives way."""
    files, where = file_system(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(aside, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    files.delete(where, False)
    if not files.rename(aside, where):
        raise OSError(f"{path} can't be written")


def get_bytes(spark: SparkSession, path: str) -> bytes:
    """A file's bytes; for small files only."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"])


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, where = file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []
