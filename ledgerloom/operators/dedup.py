"""Observations of one event: three levels of fingerprints and the pairs they make.

Rows are (raw_id, source, ts, amount, party). Pairs are found by equality joins: exact levels on the
hash, the fuzzy level on a day and a cent bucket, never by comparing all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.functions import texts as T
from ledgerloom.operators.durable import cut

#: Seconds of the exact levels and of the fuzzy one, and the fuzzy level's cents.
EXACT_SECONDS, FUZZY_SECONDS, FUZZY_CENTS = 120, 86_400, 100


def booking_days(ts: Column, source: Column) -> Column:
    """The days a row may have been booked on: its own, and the day before for a bank's early rows."""
    day = ts.cast("date")
    return F.array_compact(F.array(day, F.when((source == "bank") & (F.hour(ts) < 2), F.date_sub(day, 1))))


def level_hashes(rows_ts: Column, source: Column, amount: Column, party: Column) -> tuple[Column, Column]:
    """(l1, l2): the exact and the loose hash for each booking day; party is the counterparty as it stands in the row."""
    days, name = booking_days(rows_ts, source), T.party_name(party)
    return F.transform(days, lambda d: X.l1_fingerprint(d, amount, name)), F.transform(days, lambda d: X.l2_fingerprint(d, amount))


def fingerprints(rows: DataFrame) -> DataFrame:
    """rows with cents, l1, l2 (hashes of the row's own day), and l1_all, l2_all with the day before for early bank rows."""
    l1, l2 = level_hashes(F.col("ts"), F.col("source"), F.col("amount"), F.col("party"))
    rows = rows.withColumns({"cents": X.cents(F.col("amount")), "l1_all": l1, "l2_all": l2})
    return rows.withColumns({"l1": F.get("l1_all", F.lit(0)), "l2": F.get("l2_all", F.lit(0))})


def _pairs(prints: DataFrame, level: str, allowed: Column) -> DataFrame:
    """Rows of one hash within 120 seconds: the join is on the hash and a bucket of so many seconds, so a frequent hash spreads over the day."""
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    each = prints.select("raw_id", "source", secs.alias("s"), F.floor(secs / EXACT_SECONDS).alias("cell"), F.explode(F.array_distinct(f"{level}_all")).alias("h"))
    a, b = (each.select("h", "cell", *[F.col(c).alias(f"{p}_{c}") for c in ("raw_id", "source", "s")]) for p in ("left", "right"))
    a = a.withColumn("cell", F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)])))
    near = F.abs(F.col("left_s") - F.col("right_s")) <= EXACT_SECONDS
    return a.join(b, ["h", "cell"]).where((F.col("left_raw_id") < F.col("right_raw_id")) & near & allowed).select("left_raw_id", "right_raw_id").distinct()


def l1_pairs(prints: DataFrame) -> DataFrame:
    """Pairs of different sources with a common L1 hash within 120 seconds."""
    return _pairs(prints, "l1", F.col("left_source") != F.col("right_source"))


def l2_pairs(prints: DataFrame) -> DataFrame:
    """Pairs with a common L2 hash within 120 seconds whose sources may describe one payment."""
    both = F.sort_array(F.array("left_source", "right_source"))
    pairs = [F.array(*map(F.lit, p)) for p in (("alipay", "bank"), ("bank", "wechat"), ("alipay", "wechat"))]
    return _pairs(prints, "l2", (both == pairs[0]) | (both == pairs[1]) | (both == pairs[2]))


#: Radii in seconds that nearest looks in, one after the other; its cells are WIDE radii long, and CROWD is how many offers of a cell an ask may meet on average.
RADII, WIDE, CROWD = (60, 3_600, FUZZY_SECONDS), 4, 64


def _cells(offers: DataFrame, keys: tuple[str, ...], radius: int):
    return offers.groupBy(*keys, F.floor(F.col("s2") / (WIDE * radius)).alias("cell"), F.floor(F.col("c2") / (WIDE * FUZZY_CENTS)).alias("bucket"))


def _fitting(offers: DataFrame, keys: tuple[str, ...], radii: tuple[int, ...]) -> tuple[int, ...]:
    """radii without the small ones that are not needed, as a larger one's cells are not crowded."""
    for k in range(len(radii) - 1, 0, -1):
        n = F.col("count").cast("double")
        if (_cells(offers, keys, radii[k]).count().agg(F.sum(n * n) / F.sum(n)).first()[0] or 0) <= CROWD:
            return radii[k:]
    return radii


def nearest(asks: DataFrame, offers: DataFrame, ties: Callable[[Column], list[Column]], allowed: Callable[[Column], Column], keys: tuple[str, ...] = (), radii: tuple[int, ...] = RADII) -> DataFrame:
    """asks' row_id with other_id, seconds and cents_off of its nearest offer in time, within a day and 100 cents, for each that has one.

    asks: keys, row_id, cents, s (seconds), more; offers: keys, other_id, c2, s2, more. ties of an offer order those as near as each other, allowed
    says whether it may be taken. Offers are gathered in cells of time and cents, and an ask meets the one to four cells that its reach
    touches, so pairs are never rows. Small radii come first where cells are crowded: an ask that finds one there has its nearest, and only
    the others look further, so a popular amount on a busy day never meets itself as a whole.
    """
    reach = lambda c, r: F.explode(F.sequence(F.floor((F.col(c) - r) / (WIDE * r)), F.floor((F.col(c) + r) / (WIDE * r))))
    gap, off = (lambda o: F.abs(F.col("s") - o["s2"])), (lambda o: F.abs(F.col("cents") - o["c2"]))
    fields = [c for c in offers.columns if c not in keys]
    left, out = asks, None
    radii = _fitting(offers, keys, radii)
    for radius in radii:
        look = left.withColumn("cell", reach("s", radius)).withColumn("bucket", reach("cents", FUZZY_CENTS))
        gathered = _cells(offers, keys, radius).agg(F.collect_list(F.struct(*fields)).alias("offers"))
        fit = F.filter("offers", lambda o: (gap(o) <= radius) & (off(o) <= FUZZY_CENTS) & allowed(o))  # noqa: B023
        best = F.array_min(F.transform(fit, lambda o: F.struct(gap(o).alias("g"), *[t.alias(f"t{k}") for k, t in enumerate(ties(o))], o["other_id"].alias("other_id"), off(o).alias("o"))))
        near = look.join(gathered, [*keys, "cell", "bucket"]).select(*keys, "row_id", best.alias("b"))
        found = near.groupBy(*keys, "row_id").agg(F.min("b").alias("b")).where("b is not null").select(*keys, "row_id", "b.other_id", F.col("b.g").alias("seconds"), F.col("b.o").alias("cents_off"))
        if radius != radii[-1]:
            found = cut(found)
            left = left.join(found, [*keys, "row_id"], "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def l3_best(prints: DataFrame, radii: tuple[int, ...] = RADII) -> DataFrame:
    """For each row that has one, its nearest other row in time: within a day and 100 cents (ties: fewest cents, then id)."""
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    asks = prints.select(F.col("raw_id").alias("row_id"), "cents", secs.alias("s"))
    offers = asks.toDF("other_id", "c2", "s2")
    found = nearest(asks, offers, lambda o: [F.abs(F.col("cents") - o["c2"])], lambda o: F.col("row_id") != o["other_id"], radii=radii)
    return found.withColumnRenamed("row_id", "raw_id")


def dedup_report(prints: DataFrame, exact: DataFrame) -> DataFrame:
    """Per source: rows, rows that an exact pair makes duplicates (of two, the lower priority, then the later id), and rest.

    Priority: alipay, wechat, bank, others.
    """
    rank = lambda c: F.when(c == "alipay", 3).when(c == "wechat", 2).when(c == "bank", 1).otherwise(0)
    src = prints.select("raw_id", "source")
    left, right = src.toDF("left_raw_id", "ls"), src.toDF("right_raw_id", "rs")
    judged = exact.join(left, "left_raw_id").join(right, "right_raw_id")
    loser = F.when(rank(F.col("ls")) >= rank(F.col("rs")), F.col("right_raw_id")).otherwise(F.col("left_raw_id"))
    lost = judged.select(loser.alias("raw_id")).distinct().withColumn("dup", F.lit(1))
    return prints.join(lost, "raw_id", "left").groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count("dup").alias("n_duplicates"), (F.count("*") - F.count("dup")).alias("n_unique")
    )


def occurrence_numbers(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows with occurrence: null for the first of equal keys, then 2, 3, and so on."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("occurrence", F.when(n > 1, n))
