"""The provided test tables in the shape of ledger rows, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment and bank rows of orders: raw_id, source, ts, amount, party, suffix."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda secs: (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))).cast("timestamp_ntz")
    amount = (-(F.floor(F.col("o_totalprice") / 50000) * 50 + 9.9)).cast(MONEY).alias("amount")
    suffix = (9000 + c % 3).cast("string").alias("suffix")
    orders = table(spark, sf_dir, "orders")
    secs = (k * 37) % 86000
    pay = orders.where(k % 5 != 0).select(F.concat(F.lit("P"), k).alias("raw_id"), F.when(k % 2 == 0, "alipay").otherwise("wechat").alias("source"), at(secs).alias("ts"), amount, F.concat(F.lit("M"), c % 40).alias("party"), suffix)
    shifted = (c + F.when(k % 11 == 0, 1).otherwise(0)) % 40
    bank = orders.where(k % 5 != 1).select(F.concat(F.lit("B"), k).alias("raw_id"), F.lit("bank").alias("source"), at(secs + (k * 7) % 300).alias("ts"), amount, F.concat(F.lit("M"), shifted).alias("party"), suffix)
    return pay.unionByName(bank)


OBSERVATIONS = """
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, (-(floor(o_totalprice / 50000) * 50 + 9.9))::DECIMAL(18,2) AS amount FROM orders),
obs AS (
  SELECT 'P' || k AS raw_id, CASE WHEN k % 2 = 0 THEN 'alipay' ELSE 'wechat' END AS source, d + to_seconds((k * 37) % 86000) AS ts, amount, 'M' || (c % 40) AS party, (9000 + c % 3)::VARCHAR AS suffix FROM o WHERE k % 5 <> 0
  UNION ALL
  SELECT 'B' || k, 'bank', d + to_seconds((k * 37) % 86000 + (k * 7) % 300), amount, 'M' || ((c + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) % 40), (9000 + c % 3)::VARCHAR FROM o WHERE k % 5 <> 1)
"""


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account rows of events with a running balance that is off by one every 97th row: account, row_id, ts, amount, balance, kind."""
    from pyspark.sql import Window

    value = F.col("value").cast(MONEY)
    amount = F.when(F.col("event_type").isin("purchase", "error"), -value).otherwise(value).cast(MONEY)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.col("event_id").alias("row_id"), "ts", amount.alias("amount"), F.col("event_type").alias("kind"))
    run = F.sum("amount").over(Window.partitionBy("account").orderBy("ts", "row_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("balance", (run + F.when(F.col("row_id") % 97 == 0, 1).otherwise(0)).cast(MONEY))


STATEMENT = """
s0 AS (SELECT user_id AS account, event_id AS row_id, ts, event_type AS kind, CASE WHEN event_type IN ('purchase', 'error') THEN -(value::DECIMAL(18,2)) ELSE value::DECIMAL(18,2) END AS amount FROM events),
st AS (SELECT account, row_id, ts, kind, amount::DECIMAL(18,2) AS amount, (sum(amount) OVER (PARTITION BY account ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) + CASE WHEN row_id % 97 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2) AS balance FROM s0)
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows of orders: row_id, source, ts, amount, kind, category."""
    total, k = F.col("o_totalprice").cast(MONEY), F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "P", "REFUND").when(k % 4 == 0, "INCOME").otherwise("EXPENSE")
    return table(spark, sf_dir, "orders").select(
        k.alias("row_id"), F.when(k % 3 == 0, "bank").when(k % 3 == 1, "alipay").otherwise("wechat").alias("source"), F.col("o_orderdate").alias("ts"),
        F.when(kind == "EXPENSE", -total).otherwise(total).cast(MONEY).alias("amount"), kind.alias("kind"), F.when(k % 13 == 0, "").otherwise(F.col("o_orderpriority")).alias("category"),
    )


LEDGER = """
l0 AS (SELECT o_orderkey AS row_id, CASE o_orderkey % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'alipay' ELSE 'wechat' END AS source, o_orderdate AS ts, o_totalprice::DECIMAL(18,2) AS total,
  CASE WHEN o_orderstatus = 'P' THEN 'REFUND' WHEN o_orderkey % 4 = 0 THEN 'INCOME' ELSE 'EXPENSE' END AS kind, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS category FROM orders),
lg AS (SELECT row_id, source, ts, (CASE WHEN kind = 'EXPENSE' THEN -total ELSE total END)::DECIMAL(18,2) AS amount, kind, category FROM l0)
"""


def sums_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(banks, payments) of events: row_id, account, day, amount; purchases are twice their unit, clicks once."""
    v = F.floor(F.col("value")).cast("int") % 6 + 1
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("account"), F.col("ts").cast("date").alias("day"), v.alias("v"), "event_type")
    pick = lambda t, n: rows.where(F.col("event_type") == t).select("row_id", "account", "day", (F.col("v") * n).cast(MONEY).alias("amount"))
    return pick("purchase", 2), pick("click", 1)


SUMS = """
e AS (SELECT event_id AS row_id, user_id AS account, ts::DATE AS day, floor(value)::INT % 6 + 1 AS v, event_type FROM events),
bk AS (SELECT row_id, account, day, 2 * v AS amount FROM e WHERE event_type = 'purchase'),
py AS (SELECT row_id, account, day, v AS amount FROM e WHERE event_type = 'click')
"""


def canonical_sides(statement_rows: DataFrame) -> DataFrame:
    """Canonical rows of the statement: every 53rd is missing, every 31st is off by a cent."""
    k = F.col("row_id")
    return statement_rows.where(k % 53 != 0).select("row_id", (k + 1000000).alias("canonical_id"), (F.col("amount") + F.when(k % 31 == 0, 0.01).otherwise(0).cast(MONEY)).cast(MONEY).alias("canonical_amount"))


INTERVALS = STATEMENT + """,
cn AS (SELECT row_id, row_id + 1000000 AS canonical_id, (amount + CASE WHEN row_id % 31 = 0 THEN 0.01 ELSE 0 END)::DECIMAL(18,2) AS canonical_amount FROM st WHERE row_id % 53 <> 0),
iv0 AS (SELECT account, row_id, ts, amount, balance, lag(balance) OVER (PARTITION BY account ORDER BY ts, row_id) AS previous FROM st),
iv1 AS (SELECT iv0.*, canonical_id, canonical_amount, coalesce(balance - previous - amount, 0)::DECIMAL(18,2) AS source_difference, (canonical_amount - amount)::DECIMAL(18,2) AS canonical_difference FROM iv0 LEFT JOIN cn USING (row_id)),
iv AS (SELECT *, concat_ws(',', CASE WHEN source_difference <> 0 THEN 'source_balance_break' END, CASE WHEN canonical_id IS NULL THEN 'canonical_missing' END, CASE WHEN canonical_difference <> 0 THEN 'canonical_amount_mismatch' END) AS reasons,
  CASE WHEN canonical_id IS NULL THEN 'canonical_missing' WHEN canonical_difference <> 0 THEN 'canonical_amount_mismatch' WHEN source_difference <> 0 THEN 'source_balance_break' ELSE 'ok' END AS status FROM iv1)
"""


def roll_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(latest, pending): bank rows before 1997 summed by card suffix, and the wallet rows of all years."""
    rows = observations(spark, sf_dir).withColumn("day", F.col("ts").cast("date"))
    bank = rows.where("source = 'bank' AND ts < timestamp_ntz'1997-01-01 00:00:00'").groupBy("suffix").agg(F.max("day").alias("day"), F.sum("amount").cast(MONEY).alias("balance"))
    return bank, rows.where("source <> 'bank'").select("suffix", "day", "amount")


ROLL = OBSERVATIONS + """,
lt AS (SELECT suffix, max(ts::DATE) AS day, sum(amount)::DECIMAL(18,2) AS balance FROM obs WHERE source = 'bank' AND ts < TIMESTAMP '1997-01-01' GROUP BY suffix)
"""
