"""Bank rows from the cards of a message list, as a screen shows them: each card is an ordered array of texts, values stand after their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import MONEY

# Labels and forms of the cards.
FULL_DATE, DAY_TIME, SUM = r"(20\d{2})年(\d{1,2})月(\d{1,2})日", r"^(\d{1,2})日\s*(\d{2}):(\d{2})$", r"^([0-9,]+\.\d{2})元$"
AMOUNT, TIME, KIND = "金额", "时间", "类型"


def text_after(texts: Column, label: str, offset: int = 1) -> Column:
    """The text `offset` places after the first one that is the label, else an empty one."""
    at = F.array_position(texts, F.lit(label))
    return F.coalesce(F.when(at > 0, F.get(texts, (at - 1 + offset).cast("int"))), F.lit(""))


def money_text(text: Column) -> Column:
    """An amount such as 1,234.50元, else null."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, SUM, 1), F.lit("")), ",", "").try_cast(MONEY)


def captured_rows(cards: DataFrame) -> DataFrame:
    """(capture, transaction_time, amount, balance, kind, dated) of cards (capture, nth, page, texts): rows without sign, dated where the card itself says its year and month.

    A card without a full date takes the last one before it in its capture; cards before the first full date take the last full date of their
    page. Cards that lack a part, or name a day that isn't there, are left out. The same card is captured more than once as the list is
    scrolled: of cards of one clock time, amount, balance and kind the first that is dated counts, else the first.
    """
    dates = F.transform(F.filter("texts", lambda t: t.rlike(FULL_DATE)), lambda t: F.regexp_extract(t, FULL_DATE, 1).cast("int") * 12 + F.regexp_extract(t, FULL_DATE, 2).cast("int") - 1)
    own = F.get(dates, F.lit(0))
    order = Window.partitionBy("capture").orderBy("nth")
    page = Window.partitionBy("capture", "page").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cards = cards.withColumn("own", own)
    month = F.coalesce(F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.last("own", ignorenulls=True).over(page))
    clock = F.get(F.filter("texts", lambda t: t.rlike(DAY_TIME)), F.lit(0))
    part = lambda k: F.regexp_extract(clock, DAY_TIME, k)
    made = cards.select("capture", "nth", F.col("own").isNotNull().alias("dated"), month.alias("m"), part(1).alias("d"), F.concat(part(2), F.lit(":"), part(3)).alias("clock"), money_text(text_after(F.col("texts"), AMOUNT)).alias("amount"), money_text(text_after(F.col("texts"), TIME)).alias("balance"), text_after(F.col("texts"), KIND, 2).alias("kind"))
    day = F.concat_ws("-", F.floor(F.col("m") / 12).cast("string"), F.lpad((F.col("m") % 12 + 1).cast("string"), 2, "0"), F.lpad("d", 2, "0"))
    at = F.try_to_timestamp(F.concat(day, F.lit(" "), F.col("clock")), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    whole = made.withColumn("transaction_time", at).where("m is not null and transaction_time is not null and amount is not null and balance is not null and kind <> ''")
    first = whole.groupBy("capture", "clock", "amount", "balance", "kind").agg(F.min(F.struct((~F.col("dated")).alias("undated"), "nth", "transaction_time", "dated")).alias("b"))
    return first.select("capture", "b.transaction_time", "amount", "balance", "kind", "b.dated")
