"""The sequential deduplication of one person's rows, settled by islands: own transfers, then exact, loose and fuzzy matches with earlier rows, in order of arrival.

A row's exact and loose matches have its cents, its direction and a time within 120 seconds of it, and only they decide whether later rows
may match it in turn. So order matters only inside an island: rows of one owner, amount and direction without a gap of more than 120
seconds. Islands are a few rows each and are settled in order, each in one group. The fuzzy level changes nothing for later
rows; it is a search for the nearest earlier row that the islands left open, and runs as joins over buckets of time and cents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.functions import texts as T
from ledgerloom.functions.lexicon import PRIORITY
from ledgerloom.operators.dedup import EXACT_SECONDS, level_hashes, nearest
from ledgerloom.operators.durable import cut
from ledgerloom.operators.grouped import map_groups

_LOOSE = {frozenset(p) for p in (("alipay", "bank"), ("wechat", "bank"), ("alipay", "wechat"))}
#: Seconds, and days, of one cell in which island borders are first looked for.
CELL_SECONDS, CELL_DAYS = 86_400, 365


def prepared(rows: DataFrame, *more: str) -> DataFrame:
    """What the engine looks at: owner, row_id, seq, source, secs, day, cents, out, party, transfer, rank, said_length, the hashes of both levels, whether it is a bank's early row, and more columns as they are."""
    day = F.col("ts").cast("date")
    rank = T.first_of([(F.col("source") == s, F.lit(p)) for s, p in PRIORITY], F.lit(0))
    l1, l2 = level_hashes(F.col("ts"), F.col("source"), F.col("amount"), F.col("party"))
    return rows.select(
        "owner", "row_id", "seq", "source", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("secs"), F.datediff(day, F.lit("1970-01-01")).alias("day"), X.cents(F.col("amount")).alias("cents"), (F.col("amount") < 0).alias("out"), T.party_name(F.col("party")).alias("party"),
        T.is_transfer(F.col("source"), T.text("description", "party")).alias("transfer"), rank.alias("rank"), F.char_length(T.text("party", "description")).alias("said_length"), l1.alias("l1"), l2.alias("l2"), F.coalesce((F.col("source") == "bank") & (F.hour("ts") < 2), F.lit(False)).alias("early"), *more,
    )


def with_islands(rows: DataFrame, keys: list[str], at: str, gap: int, span: int, name: str = "island") -> DataFrame:
    """rows with a number that changes, within equal keys, wherever the values of column at leave a gap of more than `gap`.

    Windows run over cells of `span` (at least `gap`), so no task takes a key's rows as a whole; then the cells' edges, a row each, say
    which islands go on in the next cell. A row without at is an island by itself.
    """
    cell, w = F.floor(F.col(at) / span), Window.partitionBy(*keys, "_cell").orderBy(at)
    inner = rows.withColumn("_cell", cell).withColumn("_cut", F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("long"), F.lit(1).cast("long")))
    inner = inner.withColumn("_nth", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edges = inner.groupBy(*keys, "_cell").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.max("_nth").alias("n"))
    over = Window.partitionBy(*keys).orderBy("_cell")
    goes_on = F.coalesce((F.col("lo") - F.lag("hi").over(over) <= gap).cast("long"), F.lit(0).cast("long"))
    edges = edges.withColumn("_on", goes_on).withColumn("_base", F.sum(F.col("n") - F.col("_on")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*keys, "_cell")]
    joined = inner.alias("r").join(edges.select(*keys, "_cell", "_base").alias("e"), same)
    return joined.select(*[f"r.`{c}`" for c in rows.columns], (F.col("r._nth") + F.col("e._base")).alias(name))


def in_company(rows: DataFrame, keys: list[str], at: str, gap: int, span: int) -> DataFrame:
    """rows with company: false only where with_islands, of the same arguments, makes the row an island of its own. A row near a cell's edge counts as in company."""
    cell = F.floor(F.col(at) / span)
    w = Window.partitionBy(*keys, cell).orderBy(at)
    before, after = F.col(at) - F.lag(at).over(w) <= gap, F.lead(at).over(w) - F.col(at) <= gap
    edge = (F.col(at) - cell * span < gap) | ((cell + 1) * span - F.col(at) <= gap)
    return rows.withColumn("company", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)) | F.coalesce(edge, F.lit(False)))


class Arrivals:
    """Rows of one owner that later ones may match, by their hashes."""

    def __init__(self) -> None:
        self.l1, self.l2 = defaultdict(list), defaultdict(list)

    def add(self, r) -> None:
        for h in r.l1:
            self.l1[h].append(r)
        for h in r.l2:
            self.l2[h].append(r)

    def match(self, r):
        """(row, level) of the first earlier row that r repeats, exactly or else loosely; or None."""
        near = lambda c: abs(c.secs - r.secs) <= EXACT_SECONDS
        exact = ((c, "L1") for h in r.l1 for c in self.l1[h] if c.source != r.source and near(c))
        loose = ((c, "L2") for h in r.l2 for c in self.l2[h] if frozenset((c.source, r.source)) in _LOOSE and near(c))
        return next(exact, None) or next(loose, None)


def wins(r, other) -> bool:
    """Whether the later row r takes the place of the earlier one: by source, then by how much it says, and if neither tells, as well."""
    return (r.rank, r.said_length) >= (other.rank, other.said_length)


#: What is kept of a row once its island is settled, and what settling says of it.
_JUDGED = ["owner", "row_id", "seq", "secs", "day", "cents", "transfer"]
#: What the engine carries from task to task; the hashes are not among it, as within an island days and parties say the same.
_CARRIED = [*_JUDGED, "source", "out", "party", "early", "rank", "said_length"]


def _settled(rows: list) -> Iterator[tuple]:
    """One island in order of arrival: what is kept of each row; level and duplicate_of if it found a match or lost to one, whether kept, and whether later rows may match it.

    A row that matched is no candidate for later rows; its partner may lose to it and stays one.
    """
    earlier, out = Arrivals(), {}
    for r in rows:
        mine = out[r.row_id] = [None, None, True, True]
        found = None if r.transfer else earlier.match(r)
        if not found:
            earlier.add(r)
            continue
        other, level = found
        loser, winner = (out[other.row_id], r.row_id) if wins(r, other) else (mine, other.row_id)
        mine[0], mine[3] = level, False
        loser[:3] = [level, winner, False]
    for r in rows:
        yield (*(getattr(r, c) for c in _JUDGED), *out[r.row_id])


def _days() -> Column:
    return F.when(F.col("early"), F.array(F.col("day"), F.col("day") - 1)).otherwise(F.array(F.col("day")))


def _unseen(rows: list) -> Iterator[tuple]:
    """An island's rows none of whose days came before."""
    met: set[int] = set()
    for r in rows:
        days = {r.day, r.day - 1} if r.early else {r.day}
        if not met & days:
            met |= days
            yield tuple(getattr(r, c) for c in _CARRIED)


def _new_rows(ready: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows that an incremental load takes. Rows share exact hashes only if cents, direction, party and a booking day are the same."""
    known = seen.select("owner", "h").distinct().withColumn("known", F.lit(True))
    rows = ready.select(*_CARRIED, F.explode("l1").alias("h")).join(known, ["owner", "h"], "left").drop("h")
    first = {c: F.first(c).alias(c) for c in _CARRIED if c != "row_id"}
    # rows of two booking days came twice
    twice = rows.where("early").groupBy("row_id").agg(*first.values(), F.bool_or(F.coalesce("known", F.lit(False))).alias("known")).where("not known")
    unknown = rows.where("not early and known is null").select(*_CARRIED).unionByName(twice.select(*_CARRIED))
    keys = ["owner", "cents", "out", "party"]
    flagged = cut(in_company(unknown, keys, "day", 1, CELL_DAYS))
    kinds = dict(ready.dtypes)
    several = map_groups(with_islands(flagged.where("company"), keys, "day", 1, CELL_DAYS), [*keys, "island"], ["seq"], _unseen, ", ".join(f"{c} {kinds[c]}" for c in _CARRIED))
    return flagged.where("not company").select(*_CARRIED).unionByName(several)


def islands(rows: DataFrame) -> DataFrame:
    """(owner, cents, out, island, n_rows) of rows as for resolve: the groups that are settled in order."""
    keys = ["owner", "cents", "out"]
    return with_islands(prepared(rows).select(*keys, "secs"), keys, "secs", EXACT_SECONDS, CELL_SECONDS).groupBy(*keys, "island").agg(F.count("*").alias("n_rows"))


def resolve(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(row_id, status, level, duplicate_of, kept), one row per input row (owner, row_id, seq, source, ts, amount, party, description; ids and seqs differ, ts and amount are there).

    status: INTERNAL_TRANSFER, UNIQUE, DUPLICATE, REVIEW, or SKIPPED where the row's exact hash is in seen (owner, h) or came before in
    this run of an incremental load. Each row is held against earlier ones alone. A higher-priority later row takes the earlier one's
    place. An empty table gives an empty one. The largest group is an island: equal amounts of one owner in one direction at most two minutes apart.
    """
    ready = prepared(rows)
    taken = ready.select(*_CARRIED) if seen is None else cut(_new_rows(ready, seen))
    keys, kinds = ["owner", "cents", "out"], dict(ready.dtypes)
    kind, says = kinds["row_id"], f"level string, duplicate_of {kinds['row_id']}, kept boolean, open boolean"
    flagged = cut(in_company(taken, keys, "secs", EXACT_SECONDS, CELL_SECONDS))
    several = with_islands(flagged.where("company"), keys, "secs", EXACT_SECONDS, CELL_SECONDS).withColumns({"l1": F.transform(_days(), lambda d: F.concat_ws("|", d, "party")), "l2": _days()})
    settled = map_groups(several, [*keys, "island"], ["seq"], _settled, ", ".join(f"{c} {kinds[c]}" for c in _JUDGED) + ", " + says)
    # rows of islands of one have nothing to match
    alone = flagged.where("not company").select(*_JUDGED, F.lit(None).cast("string").alias("level"), F.lit(None).cast(kind).alias("duplicate_of"), F.lit(True).alias("kept"), F.lit(True).alias("open"))
    judged = cut(alone.unionByName(settled))
    asks = judged.where("not transfer and open and duplicate_of is null").select("owner", "row_id", "cents", F.col("secs").alias("s"), "seq", "day")
    offers = judged.where("open").select("owner", F.col("row_id").alias("other_id"), F.col("cents").alias("c2"), F.col("secs").alias("s2"), F.col("seq").alias("q2"), F.col("day").alias("d2"))
    # rows as near as each other: of the day before, the same day, the day after, then in order of arrival
    fuzzy = nearest(asks, offers, lambda o: [o["d2"] - F.col("day"), o["q2"]], lambda o: o["q2"] < F.col("seq"), ("owner",)).select("row_id", F.col("other_id").alias("near_id"))
    status: Column = F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE").when(F.col("transfer"), "INTERNAL_TRANSFER").when(F.col("near_id").isNotNull(), "REVIEW").otherwise("UNIQUE")
    level = F.coalesce("level", F.when(F.col("near_id").isNotNull(), "L3"))
    out = judged.join(fuzzy, "row_id", "left").select("row_id", status.alias("status"), level.alias("level"), F.coalesce("duplicate_of", "near_id").alias("duplicate_of"), "kept")
    if seen is None:
        return out
    skipped = ready.join(taken.select("row_id"), "row_id", "left_anti").select("row_id", F.lit("SKIPPED").alias("status"), F.lit(None).cast("string").alias("level"), F.lit(None).cast(kind).alias("duplicate_of"), F.lit(False).alias("kept"))
    return out.unionByName(skipped)


def hashes(rows: DataFrame) -> DataFrame:
    """(owner, h): the exact hashes to keep for later incremental loads."""
    return prepared(rows).select("owner", F.explode("l1").alias("h")).distinct()


def report(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Per source: rows and how many are unique, duplicate, transfers and for review, and the share of duplicates."""
    both = rows.select("row_id", "source").join(results, "row_id")
    n = lambda s: F.count_if(F.col("status") == s)
    out = both.groupBy("source").agg(F.count("*").alias("n_rows"), n("UNIQUE").alias("n_unique"), n("DUPLICATE").alias("n_duplicates"), n("INTERNAL_TRANSFER").alias("n_transfers"), n("REVIEW").alias("n_review"))
    return out.withColumn("duplicate_rate", F.round(F.col("n_duplicates") / F.col("n_rows"), 6))


def transfer_pairs(rows: DataFrame) -> DataFrame:
    """(out_id, in_id): rows of equal cents and opposite direction within a day, one of them a bank's, one of them by its words a transfer.

    rows as for resolve. The join is on owner, cents and a day or its neighbour.
    """
    r = prepared(rows).select("owner", "row_id", "cents", "day", "secs", "source", "transfer", "out")
    a = r.where("out").select("owner", "cents", F.col("row_id").alias("out_id"), F.col("secs").alias("s1"), F.col("source").alias("from"), F.col("transfer").alias("t1"), F.explode(F.array(*[F.col("day") + k for k in (-1, 0, 1)])).alias("day"))
    b = r.where("not out").select("owner", "cents", F.col("row_id").alias("in_id"), F.col("secs").alias("s2"), F.col("source").alias("to"), F.col("transfer").alias("t2"), "day")
    return a.join(b, ["owner", "cents", "day"]).where("abs(s1 - s2) <= 86400 and (from = 'bank' or to = 'bank') and (t1 or t2)").select("out_id", "in_id")
