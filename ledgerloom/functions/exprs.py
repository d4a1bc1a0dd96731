"""Column builders for money, dates, parties and fingerprints. Built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Date formats that statements use, most specific first.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyyMMdd HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")


def money(c: Column) -> Column:
    return c.cast(MONEY)


def clean_amount(text: Column) -> Column:
    """Text to money: currency signs, commas, blanks and plus signs go; what doesn't parse is 0."""
    return F.coalesce(F.regexp_replace(text, r"[¥￥$,\s+]", "").try_cast(MONEY), F.lit(0).cast(MONEY))


def cents(amount: Column) -> Column:
    """Whole cents of the absolute amount, truncated; the amount is a decimal before it is scaled."""
    return F.floor(F.abs(money(amount)) * 100).cast("long")


def try_stamp(text: Column, fmt: str) -> Column:
    """The time in text, or null. Only texts with the format's marks are parsed, as each failure costs as much as many rows."""
    return F.when(text.rlike(r"^\s*[+-]?" + re.sub("[A-Za-z]+", r"\\d+", fmt) + r"\s*$"), F.try_to_timestamp(text, F.lit(fmt)))


def parse_datetime(text: Column) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*[try_stamp(F.trim(text), f) for f in DATE_FORMATS])


def card_suffix(text: Column) -> Column:
    """The last run of exactly four digits, else the last four of an all-digit text, else null."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1))
    return F.coalesce(F.try_element_at(runs, F.lit(-1)), F.when(text.rlike(r"^\d{4,}$"), F.right(text, F.lit(4))))


def direction(amount: Column) -> Column:
    return F.when(amount < 0, "OUT").otherwise("IN")


def l1_fingerprint(day: Column, amount: Column, party: Column) -> Column:
    """The exact hash; party is a normal form (texts.party_name)."""
    return F.md5(F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), cents(amount).cast("string"), party, direction(amount)))


def l2_fingerprint(day: Column, amount: Column) -> Column:
    return F.md5(F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), cents(amount).cast("string"), direction(amount)))


def period_start(day: Column, period: str) -> Column:
    """First day of the day, ISO week, month or year."""
    return day.cast("date") if period == "day" else F.date_trunc(period, day).cast("date")


def seconds_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp")))


def bigrams(text: Column) -> Column:
    """Neighbouring character pairs; shorter texts have none."""
    n = F.char_length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
