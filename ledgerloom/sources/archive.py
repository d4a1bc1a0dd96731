"""Portable archives: each table as JSON lines, with a manifest of columns, row counts and checksums that a restore verifies."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT_VERSION = 2
_MANIFEST = "format_version int, table string, columns array<string>, rows long, checksum string"
_GENERATIONS = "nth long, folder string, tables array<string>"


def _checksum(line: Column) -> Column:
    """Sum of the lines' 60-bit hashes: it combines before the shuffle, and neither order nor file layout changes it."""
    return F.coalesce(F.sum(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")


def _facts(spark: SparkSession, path: str) -> DataFrame:
    """(table, found_rows, found_checksum) of the written lines, all tables in one job; a table without lines isn't there."""
    name = F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -2))
    return spark.read.text(f"{path}/data/*").select(name.alias("table"), "value").groupBy("table").agg(F.count("*").alias("found_rows"), _checksum(F.col("value")).alias("found_checksum"))


def export_archive(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write the tables under path/data and return the manifest (format_version, table, columns, rows, checksum), also in path/manifest.

    Columns go in the order of their names; null fields are left out. Facts are taken from the written lines.
    """
    if not tables:
        raise ValueError("an archive needs a table")
    columns = None
    for name, df in tables.items():
        spark = df.sparkSession
        fields = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
        df.select(F.to_json(fields).alias("value")).write.option("compression", "gzip").text(f"{path}/data/{name}")
        one = spark.range(1).select(F.lit(name).alias("table"), F.array(*[F.lit(c) for c in sorted(df.columns)]).cast("array<string>").alias("columns"))
        columns = one if columns is None else columns.unionByName(one)
    manifest = columns.join(_facts(spark, path), "table", "left").select(
        F.lit(FORMAT_VERSION).alias("format_version"), "table", "columns", F.coalesce("found_rows", F.lit(0)).alias("rows"), F.coalesce("found_checksum", F.lit("0")).alias("checksum")
    )
    manifest.write.json(f"{path}/manifest")
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest")


def inspect_archive(spark: SparkSession, path: str) -> DataFrame:
    """(table, columns, rows, fault), a row per table of the manifest or the data; fault is null if the data is as the manifest says.

    The checksum tells damage and loss, not a forger's work.
    """
    manifest = spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    both = manifest.join(_facts(spark, path), "table", "full_outer")
    rows, checksum = F.coalesce("found_rows", F.lit(0)), F.coalesce("found_checksum", F.lit("0"))
    differs = lambda key, found: F.concat(F.lit(f"{key} is "), found.cast("string"), F.lit(", the manifest has "), F.coalesce(F.col(key).cast("string"), F.lit("none")))
    fault = (
        F.when(F.col("rows").isNull(), F.lit("not in the manifest"))
        .when(~F.col("format_version").eqNullSafe(FORMAT_VERSION), F.concat(F.lit("format_version is "), F.col("format_version").cast("string")))
        .when(F.col("rows") != rows, differs("rows", rows))
        .when(~F.col("checksum").eqNullSafe(checksum), differs("checksum", checksum))
    )
    return both.select("table", "columns", F.coalesce("rows", "found_rows").alias("rows"), fault.alias("fault"))


def restore_archive(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The tables named in schemas. ValueError if one is missing, has other columns, is of another version, or differs from its count or checksum."""
    known = {r["table"]: r for r in inspect_archive(spark, path).collect()}  # a row per table
    for name, schema in schemas.items():
        if name not in known:
            raise ValueError(f"{name} is not in the archive")
        if known[name]["fault"]:
            raise ValueError(f"{name}: {known[name]['fault']}")
        if sorted(schema.names) != known[name]["columns"]:
            raise ValueError(f"{name}: columns are {known[name]['columns']}, asked for {sorted(schema.names)}")
    return {n: spark.read.text(f"{path}/data/{n}").select(F.from_json("value", schema).alias("r")).select("r.*") for n, schema in schemas.items()}


def restore_into(spark: SparkSession, path: str, schemas: dict[str, StructType], target: str) -> dict[str, DataFrame]:
    """Restore the whole archive below target, all tables or none, and return current_tables.

    schemas must name exactly the archive's tables. Tables are verified, then written into a folder of their own; a marker row, written last,
    makes that folder the current one, so a job that dies on the way leaves the tables before it in force. No rename is needed.
    """
    held = {r["table"] for r in inspect_archive(spark, path).select("table").collect()}
    if held != set(schemas):
        raise ValueError(f"the archive holds {sorted(held)}, asked for {sorted(schemas)}")
    folder = f"tables-{uuid.uuid4().hex}"
    for name, df in restore_archive(spark, path, schemas).items():
        df.write.parquet(f"{target}/{folder}/{name}")
    nth = max((r["nth"] for r in _generations(spark, target)), default=0) + 1
    marker = spark.range(1).select(F.lit(nth).cast("long").alias("nth"), F.lit(folder).alias("folder"), F.array(*[F.lit(n) for n in sorted(schemas)]).alias("tables"))
    marker.coalesce(1).write.mode("append").json(f"{target}/generations")
    return current_tables(spark, target)


def _generations(spark: SparkSession, target: str) -> list:
    """The marker rows, one per restore; none before the first."""
    try:
        return spark.read.schema(_GENERATIONS).json(f"{target}/generations").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def current_tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of the last restore into target that ended; none if there was none. Of two that ran at once, the greater folder name's."""
    found = _generations(spark, target)
    if not found:
        return {}
    last = max(found, key=lambda r: (r["nth"], r["folder"]))
    return {n: spark.read.parquet(f"{target}/{last['folder']}/{n}") for n in last["tables"]}
