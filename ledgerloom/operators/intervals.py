"""Reconciling statement intervals with canonical rows, and carrying balances past the last statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import MONEY


def interval_reconciliation(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Each statement row with its difference to the row before and to its canonical row.

    rows: account, ts, row_id, amount, balance; canonical: row_id, canonical_id, canonical_amount, at most
    one per row_id. reasons names every fault in order; status is the last of them, or ok. A row's
    opening has no source difference (0); a row without a canonical one has a null canonical difference.
    """
    order = Window.partitionBy("account").orderBy("ts", "row_id")
    both = rows.withColumn("previous", F.lag("balance").over(order)).join(canonical, "row_id", "left")
    source = F.coalesce(F.col("balance") - F.col("previous") - F.col("amount"), F.lit(0)).cast(MONEY)
    missing = F.col("canonical_id").isNull()
    both = both.withColumns({"source_difference": source, "canonical_difference": F.when(~missing, (F.col("canonical_amount") - F.col("amount")).cast(MONEY))})
    reasons = F.concat_ws(
        ",", F.when(F.col("source_difference") != 0, F.lit("source_balance_break")), F.when(missing, F.lit("canonical_missing")),
        F.when(F.col("canonical_difference") != 0, F.lit("canonical_amount_mismatch")),
    )
    last = F.element_at(F.split(reasons, ","), -1)
    return both.withColumns({"reasons": reasons, "status": F.when(reasons == "", "ok").otherwise(last)})


def interval_summary(intervals: DataFrame) -> DataFrame:
    """Per account: intervals, faulty ones, and the first faulty row with its status (null where all is well)."""
    bad, at = F.col("status") != "ok", F.struct("ts", "row_id")
    return intervals.groupBy("account").agg(
        F.count("*").alias("n_rows"), F.count_if(bad).alias("n_failures"),
        F.min_by("row_id", F.when(bad, at)).alias("first_failure"), F.min_by("status", F.when(bad, at)).alias("first_status"),
    )


def roll_forward(latest: DataFrame, pending: DataFrame) -> DataFrame:
    """Each card's last statement balance carried on with later wallet rows: suffix, statement_balance, pending_adjustment, balance, as_of.

    latest: suffix, day, balance, a row per card; pending: suffix, day, amount. Only rows after the
    statement's day count; as_of is the last such day, else the statement's. A name inside a payment
    method is to be turned into its suffix first (exprs.card_suffix), so the join is on equal keys.
    """
    p = pending.select("suffix", F.col("day").alias("d"), F.col("amount").alias("a"))
    later = latest.join(p, "suffix").where("d > day").groupBy("suffix").agg(F.sum("a").cast(MONEY).alias("adj"), F.max("d").alias("till"))
    adjustment = F.coalesce("adj", F.lit(0)).cast(MONEY)
    return latest.join(later, "suffix", "left").select(
        "suffix", F.col("balance").alias("statement_balance"), adjustment.alias("pending_adjustment"),
        (F.col("balance") + adjustment).cast(MONEY).alias("balance"), F.coalesce("till", "day").alias("as_of"),
    )
