"""Sharding through fixed virtual slots.

A record's id hashes to one of a few thousand virtual slots for good. Shards own slots through a stored, versioned
map: one version per shard count, and growing it by a shard only hands slots to the new shard. Bytes are
aggregated per slot; rebalance turns them into moves, and move_slots applies moves as a new version. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, one_row_each

VIRTUAL_SLOTS = 4096
#: Rows of a virtual slot are numbered in so many parts, so that an id with many texts is many tasks.
PARTS = 16
#: Rows of one file that are numbered together when slots follow the files' order.
CHUNK_ROWS = 20_000


def virtual_slot(doc_id: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    """The id's slot; a null id hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots


def slot_map(spark: SparkSession, shards: int, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """(vslot, shard) for a shard count: start with one shard and, for each further shard m, hand it the slots
    whose own hash for m falls under 1/(m+1). Slot and count decide, and a step only moves slots into the new shard.
    """
    shard = F.lit(0)
    for m in range(1, shards):
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(m)))), 1, 8), 16, 10).cast("long")
        shard = F.when(draw * (m + 1) < (1 << 32), F.lit(m)).otherwise(shard)
    return spark.range(slots).select(F.col("id").alias("vslot"), shard.cast("int").alias("shard"))


def slot_maps(spark: SparkSession, counts: tuple[int, ...], slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """The versioned map: (version, shards, vslot, shard), one version per shard count in order, stored as a table."""
    maps = [slot_map(spark, n, slots).select(F.lit(v).alias("version"), F.lit(n).alias("shards"), "vslot", "shard") for v, n in enumerate(counts, 1)]
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return materialize(out, "slot-maps")


def slot_bytes(docs: DataFrame, slots: int = VIRTUAL_SLOTS, text: str = "text") -> DataFrame:
    """(vslot, rows, bytes) of each virtual slot in use, combined before the shuffle: at most `slots` rows."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    return docs.select(virtual_slot(F.col("doc_id"), slots).alias("vslot"), size.alias("s")).groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("s").alias("bytes"))


def rebalance(maps: DataFrame, version: int, sizes: DataFrame) -> DataFrame:
    """(vslot, shard): the moves that even out a version's bytes, from slot_bytes.

    Every shard keeps its largest slots up to the mean of all shards; the rest goes to the shards with room, in the order of size,
    so that shards end within about one slot of the mean. A map has `slots` rows whatever the input, few enough for one task.
    """
    one = Window.partitionBy(F.lit(1))
    held = maps.where(F.col("version") == version).join(sizes, "vslot", "left").select("vslot", "shard", "shards", F.coalesce("bytes", F.lit(0)).alias("b"))
    filled = F.sum("b").over(Window.partitionBy("shard").orderBy(F.col("b").desc(), "vslot"))
    held = held.select("*", (F.sum("b").over(one) / F.col("shards")).alias("mean"), filled.alias("filled")).withColumn("stays", F.col("filled") <= F.col("mean"))
    room = held.groupBy("shard").agg(F.greatest(F.max("mean") - F.sum(F.when(F.col("stays"), F.col("b")).otherwise(0)), F.lit(0)).alias("room"))
    upto = F.sum("room").over(Window.partitionBy(F.lit(1)).orderBy("shard"))
    room = room.select(F.col("shard").alias("to"), (upto - F.col("room")).alias("a"), upto.alias("z"))
    middle = F.sum("b").over(Window.partitionBy(F.lit(1)).orderBy(F.col("b").desc(), "vslot")) - F.col("b") / 2
    free = held.where("not stays").select("vslot", "shard", middle.alias("at"))
    found = free.join(F.broadcast(room), (F.col("at") >= F.col("a")) & (F.col("at") < F.col("z")))
    return found.where("to <> shard").select("vslot", F.col("to").alias("shard"))


def move_slots(maps: DataFrame, version: int, moves: DataFrame) -> DataFrame:
    """The map with one more version: that of the given version with the slots of moves (vslot, shard), one row a slot, on their new shards."""
    new = maps.agg(F.max("version") + 1).first()[0]
    to = moves.select("vslot", F.col("shard").alias("to"))
    edited = maps.where(F.col("version") == version).join(F.broadcast(to), "vslot", "left")
    edited = edited.select(F.lit(new).alias("version"), "shards", "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))
    return materialize(maps.unionByName(edited), "slot-maps")


def _owners(maps: DataFrame, version: int, grown: int) -> DataFrame:
    """(vslot, shard, map_version, grown_shard) of two versions of the map."""
    later = maps.where(F.col("version") == grown).select("vslot", F.col("shard").alias("grown_shard"))
    return maps.where(F.col("version") == version).select("vslot", "shard", F.col("version").alias("map_version")).join(later, "vslot")


def shard_rows(docs: DataFrame, shards: int = 8, slots: int = VIRTUAL_SLOTS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law 'key', shard, slot, grown_shard (with one more shard), vslot, map_version, vslot_bytes.

    shard depends on the id and the count alone, by version 1 of a stored map; version 2 has one more shard.
    slot is the row's place in its shard, gapless from 0: rows are numbered inside a part of their virtual slot, and each part
    starts where the one before ends, so no task sees a whole shard, nor an id's rows when they are many: rows equal in
    id, size and checksum are counted before they are numbered. A null text has size 1 and checksum 0; a null id is an id like
    others; repeated rows get slots of their own; an empty table gives an empty result. Only ids, sizes and
    checksums are shuffled, never texts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), virtual_slot(F.col("doc_id"), slots).alias("vslot"))
    part = F.pmod(F.xxhash64("size", "text_crc32"), F.lit(PARTS)).alias("part")
    equal = materialize(rows.groupBy("vslot", part, "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "sized-rows")
    parts = equal.groupBy("vslot", "part").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    # the map has `slots` rows and there are PARTS times as many parts whatever the input: few enough to number and to broadcast
    owned = parts.join(_owners(slot_maps(docs.sparkSession, (shards, shards + 1), slots), 1, 2), "vslot")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = owned.select("*", F.coalesce(before, F.lit(0)).alias("start"), F.sum("bytes").over(Window.partitionBy("vslot")).alias("vslot_bytes")).drop("rows", "bytes")
    before = F.sum("n").over(Window.partitionBy("vslot", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1))
    placed = equal.withColumn("place", F.coalesce(before, F.lit(0)))
    return one_row_each(placed, "n", "nth").join(F.broadcast(starts), ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place") + F.col("nth")).alias("slot"), "grown_shard", "vslot", "map_version", "vslot_bytes"
    )


def shard_rows_in_order(docs: DataFrame, shards: int = 8, slots: int = VIRTUAL_SLOTS, text: str = "text") -> DataFrame:
    """shard_rows, but the slots of a shard follow the order of docs' rows in their Parquet files.

    docs must be read straight from files that Spark wrote: the order is the part number, then the row
    inside the file, whatever the order of reading. Rows are numbered by shard and chunk of a file, and each
    chunk starts where the one before ends, so no task sees a whole shard or a whole file.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    chunk = F.struct(part.alias("part"), F.col("_metadata.file_name").alias("file"), F.floor(F.col("_metadata.row_index") / CHUNK_ROWS).alias("k"))
    vslot = virtual_slot(F.col("doc_id"), slots).alias("vslot")
    owned = _owners(slot_maps(docs.sparkSession, (shards, shards + 1), slots), 1, 2)
    rows = docs.select(
        "doc_id", (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), vslot, chunk.alias("chunk"), F.col("_metadata.row_index").alias("row")
    ).join(F.broadcast(owned), "vslot")
    counts = docs.select(vslot, chunk.alias("chunk")).join(F.broadcast(owned), "vslot").groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row"))
    return rows.withColumn("place", place).join(starts, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place") - 1).alias("slot"), "grown_shard", "vslot", "map_version"
    )
