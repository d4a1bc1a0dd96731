"""Decisions on doubtful refunds as events, what the relationships become under them, and checks of balance anchors before they are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.texts import first_of
from ledgerloom.operators.records import attention

# What a decision is called in the log, and the queue that a relationship leaves and enters by it.
DECISIONS = [("acknowledge", "warning_acknowledged", "warning", "acknowledged"), ("escalate", "warning_escalated", "warning", "required"), ("restore", "warning_restored", "acknowledged", "warning")]
BALANCE_KINDS = ["cash", "investment", "credit_limit"]


def warning_events(relationships: DataFrame, decisions: DataFrame) -> DataFrame:
    """An event per row of decisions (relationship_id, decision, actor): relationship_id, actor, action, before, after, fault.

    before and after are queues as records.attention names them. A row with a fault changes nothing: a decision that isn't known, an id
    that is decided twice or that no relationship has, or one that isn't in the queue the decision is for. A caller that wants all or
    nothing looks for faults before appending.
    """
    now = attention(relationships).select("relationship_id", "queue")
    twice = decisions.groupBy("relationship_id").agg(F.count("*").alias("n")).where("n > 1").select("relationship_id", F.lit(True).alias("twice"))
    both = decisions.join(twice, "relationship_id", "left").join(now, "relationship_id", "left")
    pick = lambda k: first_of([(F.col("decision") == d[0], F.lit(d[k])) for d in DECISIONS], F.lit(None).cast("string"))
    both = both.select("relationship_id", "actor", pick(1).alias("action"), "queue", pick(2).alias("due"), pick(3).alias("then"), "twice")
    faults = [
        (F.col("action").isNull(), "unknown decision"), (F.col("twice"), "decided twice"), (F.col("queue").isNull(), "unknown relationship"), (F.col("queue") != F.col("due"), F.concat(F.lit("not in queue "), "due")),
    ]
    fault = first_of([(c, F.lit(f) if isinstance(f, str) else f) for c, f in faults], F.lit(None).cast("string"))
    both = both.withColumn("fault", fault)
    return both.select("relationship_id", "actor", "action", F.col("queue").alias("before"), F.when(F.col("fault").isNull(), F.col("then")).otherwise(F.col("queue")).alias("after"), "fault")


def after_warnings(relationships: DataFrame, events: DataFrame) -> DataFrame:
    """relationships under faultless events of one batch: acknowledged is set or taken back, and an escalated one reopens every choice of its
    from_id that was confirmed or superseded."""
    good = events.where("fault is null")
    said = good.select("relationship_id", F.col("action").alias("said"))
    reopened = good.where("action = 'warning_escalated'").join(relationships.select("relationship_id", "from_id"), "relationship_id").select("from_id", F.lit(True).alias("reopened")).distinct()
    both = relationships.join(said, "relationship_id", "left").join(reopened, "from_id", "left")
    acknowledged = F.when(F.col("said") == "warning_acknowledged", True).when(F.col("said") == "warning_restored", False).otherwise(F.col("acknowledged"))
    status = F.when(F.col("reopened") & F.col("status").isin("confirmed", "superseded"), "pending").otherwise(F.col("status"))
    return both.withColumns({"acknowledged": acknowledged, "status": status}).select(relationships.columns)


def checked_snapshots(rows: DataFrame) -> DataFrame:
    """Balance anchors (source, source_account, balance as text, balance_kind, as_of, created_by, note) in their stored form, with fault.

    Texts are trimmed, source and kind in lower case, a null text is empty. fault is null for a row that may be appended; else it names what
    is missing, an unknown kind, or a balance that is no finite number.
    """
    plain = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    form: dict[str, Column] = {c: plain(c) for c in ("source_account", "created_by", "note")} | {c: F.lower(plain(c)) for c in ("source", "balance_kind")}
    out = rows.withColumns(form).withColumn("balance", F.col("balance").try_cast("decimal(18,2)"))
    missing = [(F.col(c) == "", F.lit(f"no {c}")) for c in ("source", "source_account", "created_by")]
    wrong = [(~F.col("balance_kind").isin(BALANCE_KINDS), F.lit("unknown kind")), (F.col("balance").isNull(), F.lit("no finite balance"))]
    return out.withColumn("fault", first_of([*missing, *wrong], F.lit(None).cast("string")))
