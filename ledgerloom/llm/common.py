"""Shared helpers: table reading, durable intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 48 << 20
#: A key with more than this part of all rows counts as hot: 1/HOT.
HOT = 10_000
#: Rows of one Arrow batch handed to Python; texts are long, so batches stay small.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Without one, only a local master, which is one machine, gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='corpus-')}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing. options are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured size is within limit; otherwise df, and Spark shuffles the join.

    Rows are counted first, at 16 bytes each, the least a row takes; if they may fit, the bytes of their values are summed too.
    df should be cheap to read twice: a materialized or bounded table.
    """
    if df.count() * 16 > limit:
        return df
    size = df.agg(F.sum(16 * len(df.columns) + F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("s")).first()["s"] or 0
    return F.broadcast(df) if size <= limit else df


def with_keys(rows: DataFrame, counted: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """The rows whose key columns on are in counted (on and n, the rows of each key; one row a key, no nulls).

    A key that holds more than 1/HOT of the counted rows would be one task's work in a shuffle. There are fewer than HOT such
    keys whatever the input, so they are broadcast, and their rows stay where they are; the other keys shuffle.
    """
    counted = materialize(counted.select(*on, n), "keys")
    least = (counted.agg(F.sum(n)).first()[0] or 0) / HOT
    hot = F.broadcast(counted.where(F.col(n) > least).select(*on))
    rest = counted.where(F.col(n) <= least).select(*on)
    return rows.join(hot, on, "left_semi").union(rows.join(hot, on, "left_anti").join(rest, on, "left_semi"))


def renamed(name: str, *tables: DataFrame) -> str:
    """name, or name with underscores, so that no column of the tables clashes with it, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_row_each(counted: DataFrame, n: str, nth: str, chunk: int = 100_000) -> DataFrame:
    """counted with each row repeated column n times and nth counting from 0 in place of n. Large counts spread over tasks."""
    part = renamed("part", counted)
    pieces = counted.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk)))).repartition(*counted.columns, part)
    last = F.least(F.col(n), (F.col(part) + 1) * chunk) - 1
    return pieces.withColumn(nth, F.explode(F.sequence(F.col(part) * chunk, last))).drop(n, part)


def text_key(doc_id: Column, text: Column) -> Column:
    """A hash that with doc_id names a row: rows of one id differ by their texts, and a missing id differs from id 0."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain lower() where the text is ASCII, which is the same and faster."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, low))
