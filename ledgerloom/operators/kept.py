"""A ledger that is kept: tables of keyed rows in a shared folder, changed by commits that arrive whole or not at all.

A commit writes its rows to folders of their own and then one small manifest, created only if no other has its number. The manifest
names each table's folders, so a reader stays with the version it opened, and a job that dies before the manifest has changed nothing.
A table is its state, hash-bucketed by key, and a log of the commits since. Its rows are the last of each key; compaction
folds the log into the buckets it touches and leaves the others as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.texts import first_of

#: What a commit adds to a row: its number, the row's place in it, whether the key goes, and the bucket of its key.
_OWN = "_commit long, _nth long, _gone boolean, _bucket int"


class Conflict(RuntimeError):
    """Another commit came first, or rows of the commit are at fault."""


class Ledger:
    """A handle on the ledger in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- manifests

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/versions")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last whole one: a manifest cut off in writing counts as none."""
        for n in reversed(self._numbers()) if version is None else [version]:
            fs, at = self._fs(f"{self.path}/versions/{n:010}.json")
            if fs.exists(at):
                stream = fs.open(at)
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                if text.endswith("\n"):
                    return json.loads(text)
        raise FileNotFoundError(f"no version {'' if version is None else version} of a ledger in {self.path}")

    def version(self) -> int:
        return self.manifest()["version"]

    def _put(self, manifest: dict, based_on: int | None) -> int:
        numbers = self._numbers()
        if (self.version() if numbers else None) != based_on:
            raise Conflict(f"the ledger is no longer at version {based_on}")
        n = numbers[-1] + 1 if numbers else 1
        fs, at = self._fs(f"{self.path}/versions/{n:010}.json")
        try:
            out = fs.create(at, False)
        except Exception as e:  # the file system's own error says that the file is there
            raise Conflict(f"another commit made version {n}") from e
        out.write(bytearray((json.dumps(manifest | {"version": n}) + "\n").encode()))
        out.close()
        return n

    # --- tables

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: dict[str, tuple[list[str], str]], buckets: int = 32, format: int = 1) -> Ledger:
        """A new, empty ledger of tables name -> (key columns, schema). buckets: as many as make one bucket's rows a task's work."""
        new = cls(spark, path)
        new._put({"format": format, "buckets": buckets, "tables": {t: {"keys": k, "schema": s, "state": {}, "log": []} for t, (k, s) in tables.items()}}, None)
        return new

    def _rows(self, manifest: dict, table: str, only: list[int] | None = None) -> DataFrame:
        """State and log as they lie there, of some buckets or all."""
        t = manifest["tables"][table]
        folders = [f"{f}/_part={b}" for b, f in t["state"].items() if only is None or int(b) in only] + t["log"]
        schema = f"{t['schema']}, {_OWN}"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return rows if only is None else rows.where(F.col("_bucket").isin(only))

    @staticmethod
    def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
        others = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max(F.struct("_commit", "_nth", *[c for c in others if c not in ("_commit", "_nth")])).alias("_row"))
        return last.where("not _row._gone").select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows in a version, by default the last."""
        manifest = self.manifest(version)
        return self._last(self._rows(manifest, table), manifest["tables"][table]["keys"]).drop("_commit", "_nth", "_gone", "_bucket")

    def commit(self, changes: dict[str, DataFrame], based_on: int | None = None) -> int:
        """The new version's number after all changes: table -> rows to put, with a column gone where some keys are to go.

        Of several rows of one key in a table the greatest counts. It fails, without any effect that a reader sees, if a write fails or the
        ledger has left version based_on, by default the one at the start.
        """
        manifest = self.manifest(based_on)
        based_on, n = manifest["version"], manifest["version"] + 1
        for table, rows in changes.items():
            t = manifest["tables"][table]
            columns = self.spark.createDataFrame([], t["schema"]).columns
            bucket = F.pmod(F.xxhash64(*t["keys"]), F.lit(manifest["buckets"])).cast("int")
            gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
            own = [F.lit(n).cast("long").alias("_commit"), F.lit(0).cast("long").alias("_nth"), gone.alias("_gone"), bucket.alias("_bucket")]
            folder = f"data/{table}/{n:010}-{uuid.uuid4().hex}"
            rows.select(*columns, *own).write.parquet(f"{self.path}/{folder}")
            t["log"].append(folder)
        return self._put(manifest, based_on)

    def compact(self, table: str) -> int:
        """The version in which the table's log is part of its state. Only buckets that the log touches are written anew."""
        manifest = self.manifest()
        t = manifest["tables"][table]
        if not t["log"]:
            return manifest["version"]
        log = self.spark.read.schema(f"{t['schema']}, {_OWN}").parquet(*[f"{self.path}/{f}" for f in t["log"]])
        touched = sorted(r[0] for r in log.select("_bucket").distinct().collect())  # at most as many as there are buckets
        folder = f"data/{table}/{manifest['version'] + 1:010}-{uuid.uuid4().hex}"
        rows = self._last(self._rows(manifest, table, touched), t["keys"]).withColumn("_part", F.col("_bucket"))
        rows.repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        filled = {r[0] for r in self.spark.read.parquet(f"{self.path}/{folder}").select("_bucket").distinct().collect()} if touched and rows.limit(1).count() else set()
        t["state"] = {b: f for b, f in t["state"].items() if int(b) not in touched} | {str(b): folder for b in filled}
        t["log"] = []
        return self._put(manifest, manifest["version"])

    def delete_all(self) -> DataFrame:
        """(table, n_rows) of what an empty version has just replaced; the version before can be read until it is forgotten."""
        manifest = self.manifest()
        counts = [self.read(t, manifest["version"]).agg(F.lit(t).alias("table"), F.count("*").alias("n_rows")) for t in sorted(manifest["tables"])]
        empty = {t: x | {"state": {}, "log": []} for t, x in manifest["tables"].items()}
        self._put(manifest | {"tables": empty}, manifest["version"])
        return reduce(DataFrame.unionByName, counts)

    def forget(self, before: int) -> None:
        """Versions before the given one go for good, with the folders that no later one names. Not while they are being read."""
        kept = {f for n in self._numbers() if n >= before for t in self.manifest(n)["tables"].values() for f in (*t["state"].values(), *t["log"])}
        for n in [n for n in self._numbers() if n < before]:
            for t in self.manifest(n)["tables"].values():
                for f in {*t["state"].values(), *t["log"]} - kept:
                    fs, at = self._fs(f"{self.path}/{f}")
                    fs.delete(at, True)
            fs, at = self._fs(f"{self.path}/versions/{n:010}.json")
            fs.delete(at, False)

    def upgrade(self, steps: dict[int, tuple[dict, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]]) -> int:
        """The version in the newest format. steps: format -> (tables as for create, function from the tables of the format before).

        Steps are chained and written once, at the end, so a failed one leaves the old version; that version stays as the
        backup. A format that is newer than the steps, or that no chain of them begins at, is refused.
        """
        manifest = self.manifest()
        now, newest = manifest["format"], max(steps)
        if now > newest:
            raise ValueError(f"format {now} is newer than {newest}, the newest known")
        if missing := [k for k in range(now + 1, newest + 1) if k not in steps]:
            raise ValueError(f"format {now} is too old: no step to {missing[0]}")
        if now == newest:
            return manifest["version"]
        tables = {t: self.read(t, manifest["version"]) for t in manifest["tables"]}
        for k in range(now + 1, newest + 1):
            tables = steps[k][1](tables)
        shapes = {t: {"keys": k, "schema": s, "state": {}, "log": []} for t, (k, s) in steps[newest][0].items()}
        new, n = manifest | {"format": newest, "tables": shapes}, manifest["version"] + 1
        for t, rows in tables.items():
            bucket = F.pmod(F.xxhash64(*shapes[t]["keys"]), F.lit(manifest["buckets"])).cast("int")
            own = [F.lit(n).cast("long").alias("_commit"), F.lit(0).cast("long").alias("_nth"), F.lit(False).alias("_gone"), bucket.alias("_bucket")]
            shapes[t]["log"] = [f"data/{t}/{n:010}-{uuid.uuid4().hex}"]
            rows.select(*self.spark.createDataFrame([], shapes[t]["schema"]).columns, *own).write.parquet(f"{self.path}/{shapes[t]['log'][0]}")
        return self._put(new, manifest["version"])


def _faults(rows: DataFrame, cases: list[tuple[Column, str]]) -> DataFrame:
    return rows.withColumn("fault", first_of([(c, F.lit(f)) for c, f in cases], F.lit(None).cast("string")))


def link_changes(links: DataFrame, canonicals: DataFrame, raws: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (canonical_id, raw_id, action link or unlink, confidence, actor) with fault, null where the change can be made.

    At fault are unknown actions, pairs asked for twice, links of rows that aren't there or are linked already, and unlinking what isn't linked.
    """
    n = asked.groupBy("canonical_id", "raw_id").agg((F.count("*") > 1).alias("twice"))
    both = asked.join(n, ["canonical_id", "raw_id"]).join(links.select("canonical_id", "raw_id", F.lit(True).alias("linked")), ["canonical_id", "raw_id"], "left")
    both = both.join(canonicals.select("canonical_id", F.lit(True).alias("c")), "canonical_id", "left").join(raws.select("raw_id", F.lit(True).alias("r")), "raw_id", "left")
    link, unlink = F.col("action") == "link", F.col("action") == "unlink"
    cases = [
        (~F.coalesce(link | unlink, F.lit(False)), "unknown action"), (F.col("twice"), "asked twice"), (link & F.col("c").isNull(), "no canonical row"), (link & F.col("r").isNull(), "no raw row"),
        (link & F.col("linked").isNotNull(), "linked already"), (unlink & F.col("linked").isNull(), "not linked"),
    ]
    return _faults(both, cases).select(*asked.columns, "fault")


def canonical_changes(canonicals: DataFrame, asked: DataFrame, fields: list[str]) -> DataFrame:
    """asked (canonical_id, action create, update, delete or restore, actor, happened_at, fields, null where not changed) as rows to put: canonical_id, fields, deleted, action, actor, happened_at, before, after, fault.

    before and after are JSON for the audit log; what a row doesn't change it keeps. At fault are unknown actions, ids asked for twice,
    creating what is there, changing what isn't, deleting what is deleted, restoring what isn't, and updating a deleted row.
    """
    n = asked.groupBy("canonical_id").agg((F.count("*") > 1).alias("twice"))
    now = canonicals.select("canonical_id", F.struct(*fields).alias("old"), F.col("deleted").alias("was"))
    both = asked.join(n, "canonical_id").join(now, "canonical_id", "left")
    a, there, was = F.col("action"), F.col("old").isNotNull(), F.coalesce("was", F.lit(False))
    cases = [
        (~F.coalesce(a.isin("create", "update", "delete", "restore"), F.lit(False)), "unknown action"), (F.col("twice"), "asked twice"), ((a == "create") & there, "there already"), ((a != "create") & ~there, "not there"),
        ((a == "delete") & was, "deleted already"), ((a == "restore") & ~was, "not deleted"), ((a == "update") & was, "deleted"),
    ]
    new = F.struct(*[F.when(a.isin("create", "update"), F.coalesce(F.col(f), F.col(f"old.{f}"))).otherwise(F.col(f"old.{f}")).alias(f) for f in fields])
    mark = lambda gone: F.to_json(F.struct(gone.alias("deleted")))
    both = _faults(both, cases).withColumn("new", new)
    before = F.when(a == "create", "{}").when(a == "restore", mark(F.lit(True))).otherwise(F.to_json("old"))
    after = F.when(a == "delete", mark(F.lit(True))).when(a == "restore", mark(F.lit(False))).otherwise(F.to_json("new"))
    return both.select("canonical_id", *[F.col(f"new.{f}").alias(f) for f in fields], (a == "delete").alias("deleted"), "action", "actor", "happened_at", before.alias("before"), after.alias("after"), "fault")


def faultless(changes: DataFrame) -> DataFrame:
    """changes without their fault column; if any row is at fault, none is taken."""
    bad = changes.where("fault is not null").groupBy("fault").agg(F.count("*").alias("n")).orderBy("fault").collect()
    if bad:
        raise Conflict(", ".join(f"{r.n} x {r.fault}" for r in bad))
    return changes.drop("fault")
