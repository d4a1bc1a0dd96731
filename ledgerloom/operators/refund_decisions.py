"""Decisions on refund relationships, a batch at a time: confirm within what the original has room for, reject, or exclude the refund as a whole."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import MONEY
from ledgerloom.functions.texts import first_of
from ledgerloom.operators.grouped import map_groups

# What a decision makes of a relationship.
BECOMES = {"confirm": "confirmed", "reject": "rejected", "exclude": "rejected"}


def _fitting(rows: list) -> Iterator[tuple]:
    """The confirmations of one original, in order, that its room is left for."""
    room = rows[0].room
    for r in rows:
        if r.amount <= room:
            room -= r.amount
            yield (r.relationship_id,)


def judged(relationships: DataFrame, canonicals: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (relationship_id, seq, decision, actor) with from_id and fault, null where it holds.

    relationships: relationship_id, from_id (the refund), to_id (the original), amount, status; canonicals: canonical_id, amount. At fault are unknown
    decisions and relationships, decided ones, a second decision on a refund that one of the batch is on already, confirming a refund that is linked already or whose original
    isn't there, and what goes beyond the original's amount less the refunds confirmed before, in this batch by seq.
    """
    r = relationships.select("relationship_id", "from_id", "to_id", "amount", "status")
    linked = r.where("status = 'confirmed'").select("from_id", F.lit(True).alias("linked")).distinct()
    taken = r.where("status = 'confirmed'").groupBy("to_id").agg(F.sum("amount").alias("taken"))
    rows = decisions.join(r, "relationship_id", "left").join(linked, "from_id", "left").join(taken, "to_id", "left")
    rows = rows.join(canonicals.select(F.col("canonical_id").alias("to_id"), F.abs("amount").alias("paid")), "to_id", "left")
    known, confirm = F.coalesce(F.col("decision").isin(*BECOMES), F.lit(False)), F.col("decision") == "confirm"
    before = Window.partitionBy("from_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    again = F.coalesce(F.sum((known & (F.col("status") == "pending")).cast("int")).over(before), F.lit(0)) > 0
    cases = [
        (~known, "unknown decision"), (F.col("status").isNull(), "unknown relationship"), (F.col("status") != "pending", "decided already"), (again, "refund decided in this batch"),
        (confirm & F.col("linked"), "refund linked already"), (confirm & F.col("paid").isNull(), "no original"),
    ]
    rows = rows.withColumn("f", first_of([(c, F.lit(f)) for c, f in cases], F.lit(None).cast("string")))
    asked = rows.where("f is null").where(confirm).select("to_id", "relationship_id", "seq", "amount", (F.col("paid") - F.coalesce("taken", F.lit(0))).cast(MONEY).alias("room"))
    fits = map_groups(asked, ["to_id"], ["seq"], _fitting, f"relationship_id {dict(decisions.dtypes)['relationship_id']}").withColumn("fits", F.lit(True))
    rows = rows.join(fits, "relationship_id", "left")
    fault = F.when(F.col("f").isNotNull(), F.col("f")).when(confirm & F.col("fits").isNull(), "beyond the original")
    return rows.select(*decisions.columns, "from_id", fault.alias("fault"))


def refund_events(relationships: DataFrame, decided: DataFrame) -> DataFrame:
    """(relationship_id, actor, before, after) of every relationship that judged decisions change: the decided one, and with it the refund's other pending
    ones, superseded by a confirmation and rejected by an exclusion."""
    good = decided.where("fault is null").select("from_id", F.col("relationship_id").alias("own"), "decision", "actor")
    waiting = relationships.where("status = 'pending'").select("relationship_id", "from_id").join(good, "from_id")
    own = F.col("relationship_id") == F.col("own")
    after = F.when(own, first_of([(F.col("decision") == d, F.lit(s)) for d, s in BECOMES.items()], F.lit(None))).when(F.col("decision") == "confirm", "superseded").when(F.col("decision") == "exclude", "rejected")
    return waiting.select("relationship_id", "actor", F.lit("pending").alias("before"), after.alias("after")).where("after is not null")


def after_decisions(relationships: DataFrame, events: DataFrame) -> DataFrame:
    """relationships with the status that the events give them."""
    return relationships.join(events.select("relationship_id", F.col("after").alias("s")), "relationship_id", "left").withColumn("status", F.coalesce("s", "status")).drop("s").select(relationships.columns)


def excluded_refunds(decided: DataFrame) -> DataFrame:
    """(canonical_id, actor) of the refunds that exclusions take out of the ledger."""
    return decided.where("fault is null and decision = 'exclude'").select(F.col("from_id").alias("canonical_id"), "actor")
