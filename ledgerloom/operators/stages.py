"""Stages of a run whose outputs are named by what they are made of: a stage that was computed before is read, not computed again."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """rows is what the stage says, kept what is stored of it and what later stages are made of; mostly they are the same."""

    name: str
    fingerprint: str
    rows: DataFrame
    kept: DataFrame


def content_fingerprint(df: DataFrame) -> str:
    """A name for the table's schema and rows, whatever their order: counts and sums of two hashes of each row."""
    hashes = [F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)") for salt in (1, 2)]
    sums = df.agg(F.count("*").alias("n"), *[F.sum(h).alias(f"s{k}") for k, h in enumerate(hashes)]).first()
    return hashlib.sha256("|".join([df.schema.json(), *map(str, sums)]).encode()).hexdigest()[:32]


class Stages:
    """Outputs under a folder that the driver and all executors share. computed lists the stages that this run had to compute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.computed = spark, folder.rstrip("/"), []

    def given(self, name: str, rows: DataFrame) -> Stage:
        return Stage(name, content_fingerprint(rows), rows, rows)

    def run(self, name: str, make: Callable[..., DataFrame], *inputs: Stage, version: str = "1", view: Callable[[DataFrame], DataFrame] | None = None) -> Stage:
        """make(what the inputs keep) as a stored table; with view its rows are made of it when they are asked for. version is to change when make does. An output counts once it is whole: it is written elsewhere and renamed."""
        fingerprint = hashlib.sha256("|".join([name, version, *[i.fingerprint for i in inputs]]).encode()).hexdigest()[:32]
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}-{fingerprint}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/draft-{uuid.uuid4().hex}")
            make(*[i.kept for i in inputs]).write.parquet(draft.toString())
            if not fs.rename(draft, at) and not fs.exists(at):
                raise OSError(f"{at.toString()} could not be written")
            self.computed.append(name)
        kept = self.spark.read.parquet(at.toString())
        return Stage(name, fingerprint, view(kept) if view else kept, kept)
