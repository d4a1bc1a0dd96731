from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X


def _one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()["y"]


def test_amounts(spark):
    assert _one(spark, X.clean_amount, "¥ +1,234.50") == Decimal("1234.50")
    assert _one(spark, X.clean_amount, "n/a") == 0
    assert _one(spark, X.clean_amount, None) == 0
    assert _one(spark, X.cents, Decimal("-10.99"), "decimal(18,2)") == 1099


def test_dates_and_suffixes(spark):
    assert str(_one(spark, X.parse_datetime, "2024/03/01 10:20:30")) == "2024-03-01 10:20:30"
    assert _one(spark, X.parse_datetime, "soon") is None
    assert _one(spark, X.card_suffix, "card 12345 end 6789") == "6789"
    assert _one(spark, X.card_suffix, "62220001234") == "1234"
    assert _one(spark, X.card_suffix, "none") is None


def test_short_names_have_no_bigrams(spark):
    assert _one(spark, X.bigrams, "a") == []
    assert _one(spark, X.bigrams, "abc") == ["ab", "bc"]


def test_only_texts_with_a_formats_marks_are_parsed(spark):
    texts = ["2024-03-01 10:00:00", "2024/03/01 10:00", " 20240301 ", "20240301100000", "2024-03-01", "2024-13-01", "soon", "08:00:00", "", None, "2024-3-1", "20240301 10:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tried = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in X.DATE_FORMATS])
    assert df.where(~X.parse_datetime(F.col("t")).eqNullSafe(tried)).isEmpty() and df.where(X.parse_datetime(F.col("t")).isNotNull()).count() == 6
    plan = df.select(X.try_stamp(F.col("t"), "yyyy-MM-dd"))._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" in plan  # each failure throws, which costs as much as many rows
