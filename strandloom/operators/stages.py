"""Stages of a run that are kept under a digest of what they are made from, and read again while that stays the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..storage import file_system, finished


def digest(*what) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:24]


def files_digest(spark: SparkSession, *paths: str) -> str:
    """Of names, lengths and times of the files under the paths; a path that isn't there is an error."""
    found = []
    for path in paths:
        files, where = file_system(spark, path)
        if not files.exists(where):
            raise FileNotFoundError(path)
        walk = files.listFiles(where, True)
        while walk.hasNext():
            s = walk.next()
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return digest(sorted(found))


@dataclass
class Stage:
    """A table that was made or found, and the digest that later stages build on."""

    name: str
    key: str
    rows: DataFrame
    reused: bool


class Run:
    """Stages in one folder. A stage's table is written beside its place and renamed, so a run that broke off leaves nothing that looks finished."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.stages = spark, folder, []

    def stage(self, name: str, parameters: dict, sources: list[Stage | str], make: Callable[..., DataFrame]) -> Stage:
        """`make` gets the sources' tables, of those that are stages. Strings among the sources are digests of files."""
        key = digest(name, parameters, [s if isinstance(s, str) else s.key for s in sources])
        path = f"{self.folder}/{name}-{key}"
        reused = finished(self.spark, path)
        if not reused:
            aside = f"{self.folder}/.{name}-{key}"
            make(*(s.rows for s in sources if isinstance(s, Stage))).write.mode("overwrite").parquet(aside)
            files, to = file_system(self.spark, path)
            files.delete(to, True)
            if not files.rename(file_system(self.spark, aside)[1], to):
                raise OSError(f"{path} can't be written")
        out = Stage(name, key, self.spark.read.parquet(path), reused)
        self.stages.append(out)
        return out
