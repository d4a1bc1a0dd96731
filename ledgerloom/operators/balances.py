"""Running balances: does each row's balance follow from the one before?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import MONEY


def balance_chain(rows: DataFrame) -> DataFrame:
    """Each row of (account, ts, row_id, amount, balance) with previous, expected and status opening, ok or break."""
    order = Window.partitionBy("account").orderBy("ts", "row_id")
    chained = rows.withColumn("previous", F.lag("balance").over(order))
    expected = (F.col("previous") + F.col("amount")).cast(MONEY)
    status = F.when(F.col("previous").isNull(), "opening").when(expected == F.col("balance"), "ok").otherwise("break")
    return chained.withColumns({"expected": expected, "status": status})


def chain_summary(chain: DataFrame) -> DataFrame:
    """Per account: rows, breaks, and the first and last balance."""
    at = F.struct("ts", "row_id")
    return chain.groupBy("account").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("status") == "break").alias("n_breaks"),
        F.min_by("balance", at).alias("opening"), F.max_by("balance", at).alias("closing"),
    )


def first_break(chain: DataFrame) -> DataFrame:
    """Per account with a break, the first one: row_id, ts, expected, balance."""
    at = F.struct("ts", "row_id", "expected", "balance")
    first = chain.where("status = 'break'").groupBy("account").agg(F.min(at).alias("b"))
    return first.select("account", "b.row_id", "b.ts", "b.expected", "b.balance")


def repaired_chain(rows: DataFrame, explains: Column, booked: Column | None = None) -> DataFrame:
    """rows (account, ts, row_id, amount, balance) as a chain that says what it adds: account, ts, row_id, part, amount, balance, nature, unexplained.

    An account's first row becomes its opening anchor, with the balance as amount. Where a balance is off by a gap and `explains`
    (over the columns of rows, previous and gap) holds, an inferred row of that amount is put before it (part 0), at the time
    booked (the row's own by default). Other gaps stay, in unexplained. A row lacking amount, balance or the balance before has no
    gap. A table without rows gives none. One account is one task; accounts are many.
    """
    order = Window.partitionBy("account").orderBy("ts", "row_id")
    before = rows.withColumns({"previous": F.lag("balance").over(order), "first": F.lag(F.lit(1)).over(order).isNull()})
    gap = before.withColumn("gap", (F.col("balance") - F.col("previous") - F.col("amount")).cast(MONEY))
    filled = gap.withColumn("filled", F.coalesce((F.col("gap") != 0) & explains, F.lit(False)))

    def line(ts: Column, part: int, amount: Column, balance: Column, nature: str, unexplained: Column) -> Column:
        return F.struct(ts.alias("ts"), F.lit(part).alias("part"), amount.cast(MONEY).alias("amount"), balance.cast(MONEY).alias("balance"), F.lit(nature).alias("nature"), unexplained.cast(MONEY).alias("unexplained"))

    none, ts, balance = F.lit(None), F.col("ts"), F.col("balance")
    anchor = line(ts, 1, balance, balance, "anchor", none)
    added = line(ts if booked is None else booked, 0, F.col("gap"), F.col("previous") + F.col("gap"), "inferred", none)
    seen = line(ts, 1, F.col("amount"), balance, "observed", F.when(~F.col("filled") & (F.col("gap") != 0), F.col("gap")))
    lines = F.when(F.col("first"), F.array(anchor)).when(F.col("filled"), F.array(added, seen)).otherwise(F.array(seen))
    return filled.select("account", "row_id", F.explode(lines).alias("l")).select("account", "l.ts", "row_id", "l.part", "l.amount", "l.balance", "l.nature", "l.unexplained")


def signed_chain(rows: DataFrame, spends: Column) -> DataFrame:
    """Rows (account, ts, row_id, amount without sign, balance) with the sign by which the balance follows: account, ts, row_id, part, amount, balance, nature.

    An account's first row is spending if spends holds, after an opening row (part -1) of what was there before it. A later row takes the sign
    that leads from the balance before to its own; if neither does and spends holds, it is spending after an inferred row (part 0) of
    what is missing. Everything else, rows lacking amount or balance among it, is unsolved: amount null. The balance before is the last one known.
    """
    order = Window.partitionBy("account").orderBy("ts", "row_id")
    before = F.last("balance", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    known = rows.withColumns({"spends": F.coalesce(spends, F.lit(False)), "previous": before}).withColumn("moved", (F.col("balance") - F.col("previous")).cast(MONEY))

    def line(part: int, amount: Column, balance: Column, nature: str) -> Column:
        return F.struct(F.lit(part).alias("part"), amount.cast(MONEY).alias("amount"), balance.cast(MONEY).alias("balance"), F.lit(nature).alias("nature"))

    amount, balance, previous, moved = (F.col(c) for c in ("amount", "balance", "previous", "moved"))
    paid, gap, start = line(1, -amount, balance, "observed"), moved + amount, balance + amount
    unsolved = F.array(line(1, F.lit(None), balance, "unsolved"))
    lines = (
        F.when(amount.isNull() | balance.isNull(), unsolved).when(previous.isNull(), F.when(F.col("spends"), F.array(line(-1, start, start, "opening"), paid)).otherwise(unsolved))
        .when(moved == amount, F.array(line(1, amount, balance, "observed"))).when(moved == -amount, F.array(paid))
        .when(F.col("spends"), F.array(line(0, gap, previous + gap, "inferred"), paid)).otherwise(unsolved)
    )
    return known.select("account", "ts", "row_id", F.explode(lines).alias("l")).select("account", "ts", "row_id", "l.part", "l.amount", "l.balance", "l.nature")


def latest_balance(rows: DataFrame) -> DataFrame:
    """The last row of each account. An aggregate, not a window: it combines before the shuffle."""
    last = rows.groupBy("account").agg(F.max(F.struct("ts", "row_id", "balance")).alias("b"))
    return last.select("account", "b.row_id", "b.ts", "b.balance")


def wallet_projection(rows: DataFrame, opening: int = 0) -> DataFrame:
    """Each row with the balance its account would have from `opening` on, effects added row by row."""
    order = Window.partitionBy("account").orderBy("ts", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("projected", (F.lit(opening) + F.sum("amount").over(order)).cast(MONEY))


def forward_fill(rows: DataFrame, column: str) -> DataFrame:
    """column with its last non-null value in (account, ts, row_id) order."""
    order = Window.partitionBy("account").orderBy("ts", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(order))
