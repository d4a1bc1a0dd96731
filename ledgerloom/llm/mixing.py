"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. A source of weight w gives its i-th block the release time
floor(i/w) and the deadline ceil((i+1)/w); the earliest deadline among released blocks goes next, so in
every prefix each source is less than one block off its target. With weights in units of 1/period the
schedule repeats, so one period is scheduled once, in the driver, from the sources' weights alone, and every
block looks up its place. Rows meet built-in expressions only.
"""

from __future__ import annotations

from array import array
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, one_row_each

#: Least time slots of one period; weights are rounded to multiples of one slot. More or smaller sources make it longer.
PERIOD = 1000
BLOCK_ROWS = 32


def scatter(doc_id: Column) -> Column:
    """32 bits of the id's hash, from 0; a null id has a hash too."""
    return F.shiftrightunsigned(F.xxhash64(doc_id), 32)


def period_for(sizes: DataFrame, power: float = 0.5, least: int = PERIOD) -> int:
    """Time slots of a period: the first multiple of least in which the smallest target weight has a whole slot."""
    w = F.pow("n", F.lit(power))
    slots = sizes.agg((F.sum(w) / F.min(w)).alias("slots")).first()["slots"] or 0
    return (int(slots / least) + 1) * least


def source_weights(sizes: DataFrame, power: float = 0.5, period: int = PERIOD) -> DataFrame:
    """(source, units) from (source, n): target weight n^power, in units of 1/period that add up to period.

    The units go in proportion by largest remainder (ties by name). In the period of period_for every source has one
    at least; in a shorter one it is an error if not all sources can have one.
    """
    one = Window.partitionBy(F.lit(1))  # one row per source
    share = F.pow("n", F.lit(power)) / F.sum(F.pow("n", F.lit(power))).over(one) * F.lit(period)
    rows = sizes.select("source", share.alias("share"), F.floor(share).alias("whole"))
    left = F.lit(period) - F.sum("whole").over(one)
    nth = F.row_number().over(one.orderBy(F.round(F.col("whole") - F.col("share"), 9), F.col("source").asc_nulls_first()))
    units = (F.col("whole") + F.when(nth <= left, 1).otherwise(0)).cast("long")
    rows = rows.select("source", units.alias("units"))
    return rows.select("source", F.when(F.col("units") > 0, F.col("units")).otherwise(F.raise_error(F.lit("a source without a time slot")).cast("long")).alias("units"))


def schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, j, at): the time slot of each source's j-th block inside one period, earliest deadline first.

    Each slot picks, among sources whose next block is released, the earliest deadline (ties: first name).
    Only sources and units come to the driver, where two heaps take `period` steps; no rows do.
    """
    rows = weights.orderBy(F.col("source").asc_nulls_first()).collect()
    units, had = [r["units"] for r in rows], [0] * len(rows)
    waiting, ready, picks, nth = [(0, k) for k in range(len(rows))], [], array("q"), array("q")  # equal times in order of k: a heap
    for t in range(period if rows else 0):
        while waiting and waiting[0][0] <= t:
            k = heappop(waiting)[1]
            heappush(ready, (-(-(had[k] + 1) * period // units[k]), k))
        k = heappop(ready)[1]
        picks.append(k)
        nth.append(had[k])
        had[k] += 1
        heappush(waiting, (had[k] * period // units[k], k))
    names = pa.array([r["source"] for r in rows], pa.string())
    plan = pa.table({"source": names.take(pa.array(picks, pa.int64())), "j": pa.array(nth, pa.int64()), "at": pa.array(range(len(picks)), pa.int64())})
    return weights.sparkSession.createDataFrame(plan)


def mix_order(docs: DataFrame, power: float = 0.5, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """doc_id, source, block, time_slot, in_block, units: every input row once, in its place in the mix.

    Rows of a source are ordered by a scattered id, then id; rows equal in source and id are interchangeable here, and counted
    before they are numbered. Order by (time_slot, in_block) to read the mix: every prefix of time slots holds each source to
    within one block of its share units / period, which is its target to within 1 / period,
    until a source runs out; then its slots stay empty and the others keep theirs. A null source is a source. Texts are not read.
    Numbering goes by (source, range of scattered id): about as many ranges as rows in each, so a source with a
    third of all rows is many tasks at any size.
    """
    slim = materialize(docs.groupBy("source", "doc_id").agg(F.count("*").alias("n")), "counted-ids").withColumn("h", scatter(F.col("doc_id")))
    sizes = materialize(slim.groupBy("source").agg(F.sum("n").alias("n")), "source-sizes")
    period = period_for(sizes, power, period)
    weights = materialize(source_weights(sizes, power, period), "mix-weights")
    ranges = sizes.agg(F.ceil(F.sqrt(F.max("n"))).alias("r")).first()["r"] or 1
    slim = slim.withColumn("b", F.floor(F.col("h") / F.lit((1 << 32) // ranges + 1)))
    source_b = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.groupBy("source", "b").agg(F.sum("n").alias("n")).select("source", "b", F.coalesce(F.sum("n").over(source_b), F.lit(0)).alias("start"))
    before = F.sum("n").over(Window.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    same = lambda x, y, *keys: [x[k].eqNullSafe(y[k]) for k in keys]
    rows = slim.withColumn("before", F.coalesce(before, F.lit(0)))
    rows = rows.join(starts, same(rows, starts, "source", "b"), "left").select("doc_id", rows["source"], rows["n"], (F.col("start") + F.col("before")).alias("first"))
    rows = one_row_each(rows, "n", "nth").select("doc_id", "source", (F.col("first") + F.col("nth")).alias("pos"))
    rows = rows.select("doc_id", "source", F.floor(F.col("pos") / block_rows).alias("block"), (F.col("pos") % block_rows).alias("in_block"))
    plan = materialize(schedule(weights, period), "mix-plan")
    plan = plan.join(weights, plan["source"].eqNullSafe(weights["source"])).select(plan["source"].alias("s"), "j", "at", "units")
    units = checked_broadcast(weights.select(F.col("source").alias("s0"), F.col("units").alias("u0")))
    rows = rows.join(units, F.col("source").eqNullSafe(F.col("s0")))
    hit = rows["source"].eqNullSafe(F.col("s")) & (F.pmod(rows["block"], F.col("u0")) == F.col("j"))
    # plan has `period` rows
    return rows.join(checked_broadcast(plan), hit).select(
        "doc_id", "source", "block", (F.floor(F.col("block") / F.col("units")) * period + F.col("at")).alias("time_slot"), "in_block", "units"
    )


def mixed(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """docs with its own columns and all its rows, laid out in the order of the mix: range-partitioned and sorted by place.

    Rows that repeat an id within a source share the first of their places.
    """
    at = F.min(F.col("time_slot") * BLOCK_ROWS + F.col("in_block")).alias("at")
    places = checked_broadcast(materialize(mix_order(docs, power).groupBy("doc_id", "source").agg(at), "mix-places"))
    out = docs.join(places, docs["doc_id"].eqNullSafe(places["doc_id"]) & docs["source"].eqNullSafe(places["source"]))
    return out.repartitionByRange(places["at"]).sortWithinPartitions(places["at"]).select(*[docs[f"`{c}`"] for c in docs.columns])
