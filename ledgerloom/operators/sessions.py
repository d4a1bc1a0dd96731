"""Review sessions of imports: items to decide, the log of decisions folded into states, and what an item looked like when it was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.texts import first_of

# What an item is, and what it may be decided to be.
LINKED, UNMATCHED, MISSING = "linked", "unmatched", "existing_missing_from_import"
DECISIONS = ["confirmed", "rejected", "modified"]


def review_items(observed: DataFrame, missing: DataFrame, links: DataFrame) -> DataFrame:
    """(session_id, review_item_id, raw_id, canonical_id, item_type, created_at): one session per import batch, an item for each of its rows and for each row that it lacks.

    observed: import_batch_id, raw_id, is_new, at; missing: import_batch_id, raw_id, at. Ids follow from batch and row, so the same import
    makes the same items; of rows linked more than once the least canonical id counts.
    """
    kind = F.concat(F.when(F.col("is_new"), "new_").otherwise("existing_"), F.when(F.col("canonical_id").isNull(), UNMATCHED).otherwise(LINKED))
    rows = observed.select("import_batch_id", "raw_id", "at", F.coalesce("is_new", F.lit(False)).alias("is_new"), F.lit(False).alias("lacks"))
    rows = rows.unionByName(missing.select("import_batch_id", "raw_id", "at", F.lit(False).alias("is_new"), F.lit(True).alias("lacks")))
    one = links.groupBy("raw_id").agg(F.min("canonical_id").alias("canonical_id"))
    session = F.sha2(F.concat_ws("|", F.lit("session"), "import_batch_id"), 256)
    return rows.join(one, "raw_id", "left").select(
        session.alias("session_id"), F.sha2(F.concat_ws("|", session, "raw_id"), 256).alias("review_item_id"), "raw_id", "canonical_id", F.when(F.col("lacks"), MISSING).otherwise(kind).alias("item_type"), F.col("at").alias("created_at"),
    )


def judged(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (review_item_id, seq, decision, actor, at) with before, after and fault: an item is pending until its first lawful decision, and then it stays as decided.

    At fault are unknown decisions and items, and whatever comes after the item is decided; they change nothing.
    """
    known = decisions.join(items.select("review_item_id", F.lit(True).alias("there")), "review_item_id", "left")
    lawful = F.coalesce(F.col("there") & F.col("decision").isin(DECISIONS), F.lit(False))
    order = Window.partitionBy("review_item_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.first(F.when(lawful, F.col("decision")), ignorenulls=True).over(order), F.lit("pending"))
    out = known.withColumns({"before": before, "lawful": lawful})
    cases: list[tuple[Column, Column]] = [
        (F.col("there").isNull(), F.lit("unknown item")), (~F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False)), F.lit("unknown decision")), (F.col("before") != "pending", F.lit("already decided")),
    ]
    out = out.withColumn("fault", first_of(cases, F.lit(None).cast("string")))
    return out.select(*decisions.columns, "before", F.when(F.col("fault").isNull(), F.col("decision")).otherwise(F.col("before")).alias("after"), "fault")


def item_states(items: DataFrame, events: DataFrame) -> DataFrame:
    """items with status, reviewed_by and reviewed_at under judged events."""
    good = events.where("fault is null").select("review_item_id", F.col("after").alias("s"), F.col("actor").alias("reviewed_by"), F.col("at").alias("reviewed_at"))
    return items.join(good, "review_item_id", "left").withColumn("status", F.coalesce("s", F.lit("pending"))).drop("s")


def session_states(states: DataFrame) -> DataFrame:
    """(session_id, created_at, n_items, n_pending, status, completed_at): a session is completed at the last decision of its last pending item."""
    out = states.groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.count("*").alias("n_items"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.max("reviewed_at").alias("last"))
    done = F.col("n_pending") == 0
    return out.select("session_id", "created_at", "n_items", "n_pending", F.when(done, "completed").otherwise("pending").alias("status"), F.when(done, F.col("last")).alias("completed_at"))


def bulk_confirmable(states: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pending unmatched items whose row stands in no pending candidate: those that may be confirmed at one go."""
    waits = candidates.where("status = 'pending'")
    ends = waits.select(F.col("left_raw_id").alias("raw_id")).union(waits.select("right_raw_id")).distinct()
    return states.where(F.col("status") == "pending").where(F.col("item_type").isin(f"new_{UNMATCHED}", f"existing_{UNMATCHED}")).join(ends, "raw_id", "left_anti")


def as_of(items: DataFrame, versions: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """items with the fields of the version (key, at, fields) of their key that was valid at items' column at: the last one not later; null where there was none.

    Versions and items of a key are walked in one ordered window, so no item meets every version of its key; a version of the same time counts.
    Items without a key have no version and are spread, so that no task takes them all.
    """
    v = versions.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(0).alias("late"), F.struct(*fields).alias("v"), F.lit(None).cast(items.select(F.struct("*")).schema[0].dataType).alias("i"))
    i = items.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("late"), F.lit(None).cast(v.schema["v"].dataType).alias("v"), F.struct("*").alias("i"))
    sofar = Window.partitionBy("k", "spread").orderBy("t", "late").rowsBetween(Window.unboundedPreceding, 0)
    spread = F.when(F.col("k").isNull(), F.xxhash64("i")).otherwise(0)
    both = v.unionByName(i).withColumn("spread", spread).withColumn("v", F.last("v", ignorenulls=True).over(sofar)).where("i is not null")
    return both.select("i.*", *[F.col(f"v.{f}").alias(f) for f in fields])


def hydrated(items: DataFrame, raws: DataFrame, overrides: DataFrame, versions: DataFrame, fields: list[str], audit: list[str]) -> DataFrame:
    """items with persisted and imported, structs of fields: the row as it is kept and as the import told it, and affected, the canonical row (audit fields) as it was at created_at.

    overrides: review_item_id and fields, null where the import said nothing else; a row that the import lacks has no imported.
    versions: canonical_id, created_at and audit fields.
    """
    told = overrides.select("review_item_id", *[F.col(f).alias(f"o_{f}") for f in fields])
    rows = items.join(raws.select("raw_id", F.struct(*fields).alias("persisted")), "raw_id", "left").join(told, "review_item_id", "left")
    imported = F.struct(*[F.coalesce(F.col(f"o_{f}"), F.col(f"persisted.{f}")).alias(f) for f in fields])
    rows = rows.withColumn("imported", F.when(F.col("item_type") != MISSING, imported)).drop(*[f"o_{f}" for f in fields])
    return as_of(rows, versions.select("canonical_id", "created_at", F.struct(*audit).alias("affected")), "canonical_id", "created_at", ["affected"])
