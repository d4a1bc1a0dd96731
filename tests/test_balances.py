from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators.balances import repaired_chain


def test_repaired_chain_adds_anchor_and_interest_and_keeps_other_gaps(spark):
    rows = [("a", 1, 1, "9", "10"), ("a", 2, 2, "5", "15"), ("a", 3, 3, "1", "20.12"), ("a", 4, 4, "1", "30"), ("a", 5, 5, "1", None), ("a", 6, 6, "1", "31"), ("b", 1, 7, None, None), (None, 1, 8, "1", "1")]
    text = spark.createDataFrame(rows, "account string, day int, row_id long, amount string, balance string")
    chain = text.select("account", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("ts"), "row_id", F.col("amount").cast("decimal(18,2)"), F.col("balance").cast("decimal(18,2)"))
    out = repaired_chain(chain, F.col("gap") == Decimal("4.12"), F.date_sub("ts", 1).cast("timestamp"))
    got = [(r.row_id, r.part, r.ts.day, None if r.amount is None else str(r.amount), None if r.balance is None else str(r.balance), r.nature, None if r.unexplained is None else str(r.unexplained)) for r in out.orderBy("row_id", "part").collect()]
    assert got == [
        (1, 1, 1, "10.00", "10.00", "anchor", None), (2, 1, 2, "5.00", "15.00", "observed", None), (3, 0, 2, "4.12", "19.12", "inferred", None), (3, 1, 3, "1.00", "20.12", "observed", None),
        (4, 1, 4, "1.00", "30.00", "observed", "8.88"), (5, 1, 5, "1.00", None, "observed", None), (6, 1, 6, "1.00", "31.00", "observed", None), (7, 1, 1, None, None, "anchor", None), (8, 1, 1, "1.00", "1.00", "anchor", None),
    ]
    assert repaired_chain(chain.limit(0), F.lit(True)).count() == 0
