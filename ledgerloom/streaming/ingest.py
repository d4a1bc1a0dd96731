"""Incremental loads as Structured Streaming: files once, rows once, pairs in a window, idempotent appends, weekly sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import MONEY


def new_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """A stream of statement files (path, file_hash, content), each content once, whatever its name or time; the checkpoint keeps what was read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), "content").dropDuplicates(["file_hash"])


def first_seen(rows: DataFrame, keys: list[str], within: str | None = None, at: str = "ts") -> DataFrame:
    """rows whose keys did not come before. State grows with the keys; with within (such as '30 days') a key is only remembered so long."""
    return rows.dropDuplicates(keys) if within is None else rows.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def paired(payments: DataFrame, banks: DataFrame, seconds: int = 120, late: str = "1 day") -> DataFrame:
    """Stream-stream join of payments and bank rows (raw_id, ts, amount) of equal amount within seconds: left_raw_id, right_raw_id, amount."""
    p = payments.select(F.col("raw_id").alias("left_raw_id"), F.col("ts").alias("p_ts"), F.col("amount").alias("p_amount")).withWatermark("p_ts", late)
    b = banks.select(F.col("raw_id").alias("right_raw_id"), F.col("ts").alias("b_ts"), "amount").withWatermark("b_ts", late)
    near = F.col("b_ts").between(F.col("p_ts") - F.expr(f"INTERVAL {seconds} SECONDS"), F.col("p_ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return p.join(b, (F.col("p_amount") == F.col("amount")) & near).select("left_raw_id", "right_raw_id", "amount")


def appender(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the rows whose key the table at path lacks. A batch that runs again replaces what it wrote."""

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = f"{path}/batch={batch_id}"
        rows = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(path).where(F.col("batch") < batch_id).select(key)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        (rows if known is None else rows.join(known, key, "left_anti")).write.mode("overwrite").parquet(table)

    return append


def weekly(rows: DataFrame, amount: Column, late: str = "7 days") -> DataFrame:
    """Sums of tumbling weeks from Monday on: week, n_rows, total. Day 0 of the epoch is a Thursday, so windows start four days later."""
    w = F.window("ts", "1 week", "1 week", "4 days")
    return rows.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n_rows"), F.sum(amount).cast(MONEY).alias("total")).select(F.col("window.start").cast("date").alias("week"), "n_rows", "total")


def run_once(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Read what there is, write it under folder/out, and stop; the checkpoint in folder/state lets the next run go on from there."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if each is not None or mode == "complete":
        writer = writer.foreachBatch(each or replace)
    else:
        writer = writer.format("parquet").option("path", f"{folder}/out")
    writer.start().awaitTermination()
