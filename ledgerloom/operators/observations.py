"""What single raw rows say: features, keys, faults, and the rows of one account side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as L
from ledgerloom.functions import texts as T
from ledgerloom.functions.exprs import MONEY


def said(*more: str) -> Column:
    return T.text("merchant", "counterparty", "description", *more)


def features(raws: DataFrame, accounts: list[tuple[str, list[str]]]) -> DataFrame:
    """raws with rail, internal_product, families, refund, own_transfer, cancelled and funding_account; accounts is the table of funding names."""
    return raws.withColumns({
        "rail": T.payment_rail(said()), "internal_product": T.is_internal_product(T.text("description", "counterparty")), "families": T.bank_families(F.col("payment_method")),
        "refund": T.refund_words(said("status")), "own_transfer": T.is_transfer(F.col("source"), T.text("description", "counterparty")), "cancelled": F.coalesce(F.col("status").isin(L.CANCELLED), F.lit(False)),
        "funding_account": T.account_by_alias(T.text("payment_method", "description"), accounts),
    })


def cancelled(rows: DataFrame, mode: str = "filter") -> DataFrame:
    """rows without those of a cancelled status, or, in mode mark, all rows with `cancelled` among their tags (array)."""
    if mode not in ("filter", "mark"):
        raise ValueError("mode is filter or mark")
    off = F.coalesce(F.col("status").isin(L.CANCELLED), F.lit(False)) | F.coalesce(F.array_contains("tags", "cancelled"), F.lit(False))
    return rows.where(~off) if mode == "filter" else rows.withColumn("tags", F.when(off, F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("cancelled")))).otherwise(F.col("tags")))


def is_refund(kind: Column, status: Column, words: Column, amount: Column) -> Column:
    """A refund by type, by status, or by words with a positive amount."""
    return (kind == "REFUND") | F.coalesce(status.isin(L.REFUND_DONE + L.REFUND_PENDING), F.lit(False)) | (T.has_any(words, ["退款", "退还", "退回"]) & (amount > 0))


def dedup_key(raws: DataFrame) -> DataFrame:
    """raws with key, the same for the same observation in overlapping exports.

    By the outside number where there is one; else a bank row by its balance and occurrence; else by file and row. Parts are written
    as JSON, so that neither nulls nor separators in values make different rows equal; amounts are decimals of one scale.
    """
    number = F.coalesce(F.nullif("transaction_id", F.lit("")), F.nullif("merchant_order_id", F.lit("")))
    write = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    outside = write("source", "source_account", number.alias("number"))
    bank = write("source", "source_account", F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("booking_date").cast("string").alias("day"), F.col("amount").cast("string").alias("amount"), "direction", F.col("balance").cast("string").alias("balance"), "occurrence")
    row = write("source", "source_account", "source_file", "raw_row_number")
    return raws.withColumn("key", F.sha2(F.when(number.isNotNull(), outside).when((F.col("source") == "bank") & F.col("balance").isNotNull(), bank).otherwise(row), 256))


def properties(rows: DataFrame) -> DataFrame:
    """rows with is_expense, is_income, cents, day and clock."""
    amount = F.col("amount")
    return rows.withColumns({"is_expense": amount < 0, "is_income": amount > 0, "cents": F.floor(F.abs(amount) * 100).cast("long"), "day": F.date_format("transaction_time", "yyyy-MM-dd"), "clock": F.date_format("transaction_time", "HH:mm:ss")})


def faults(raws: DataFrame) -> DataFrame:
    """(raw_id, fault) of rows that a ledger refuses: an unknown direction, a suffix that isn't four digits, no date, no source."""
    checks = {
        "direction": F.col("direction").isin("expense", "income", "neutral"), "suffix": F.col("bank_card_suffix").rlike(r"^\d{4}$") | F.col("bank_card_suffix").isNull(),
        "date": F.col("booking_date").isNotNull(), "source": F.trim("source") != "", "sign": ~((F.col("direction") == "expense") & (F.col("amount") > 0)),
    }
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return raws.select("raw_id", F.explode(found).alias("fault"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new): what differs between two versions of rows, as text; a row of one side alone isn't a change."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), before[f].cast("string").alias("old"), after[f].cast("string").alias("new")) for f in fields])
    both = before.join(after, key).select(key, F.explode(pairs).alias("d"))
    return both.where(~F.col("d.old").eqNullSafe(F.col("d.new"))).select(key, "d.field", "d.old", "d.new")


def chain_faults(rows: DataFrame) -> DataFrame:
    """(file, row_no, fault) of statement rows whose balance is missing or doesn't follow from the row before in the file."""
    of = Window.partitionBy("file").orderBy("row_no")
    before = rows.select("file", "row_no", "amount", "balance", F.lag("balance").over(of).alias("previous"), F.row_number().over(of).alias("n"))
    fault = F.when(F.col("previous").isNull() | F.col("balance").isNull(), "balance_missing").when(F.col("previous") + F.col("amount") != F.col("balance"), "balance_break")
    return before.where("n > 1").select("file", "row_no", fault.alias("fault")).where("fault is not null")


def preferred(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows equal in keys, the first in order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("n_", first).where("n_ = 1").drop("n_")


def investment_scope(description: Column, counterparty: Column) -> Column:
    inside = T.has_any(description, ["朝朝宝", "天天盈"]) | ((description == "基金购买") & ~F.contains(counterparty, F.lit("基金销售")))
    return F.when(inside, "bank_internal").otherwise("external_or_review")


def investment_flows(raws: DataFrame) -> DataFrame:
    """Per bank account, description and scope: rows and net amount of investment rows."""
    d, c = F.coalesce("description", F.lit("")), F.coalesce("counterparty", F.lit(""))
    rows = raws.where((F.col("source") == "bank") & (T.has_any(d, ["朝朝宝", "天天盈", "基金", "理财"]) | F.contains(c, F.lit("基金销售"))))
    return rows.groupBy("source_account", F.when(d == "", "未注明类型").otherwise(d).alias("description"), investment_scope(d, c).alias("scope")).agg(F.count("*").alias("n_rows"), F.sum("amount").cast(MONEY).alias("net"))


def balance_collisions(raws: DataFrame, large: int = 1000) -> DataFrame:
    """Bank rows equal in account, day, amount and balance: how many, whether they say the same, whether a reversal lies between two of a file, and a priority.

    high: no reversal between, and the same description with the same party or a large amount; else review.
    """
    # the next row of a file with the opposite amount, by a running least row number from the file's end on
    later = Window.partitionBy("source_file", "size").orderBy(F.col("r").desc()).rangeBetween(Window.unboundedPreceding, -1)
    least = lambda of: F.min(F.when(of, F.col("r"))).over(later)
    a = F.col("amount")
    turn = F.when(a > 0, least(a < 0)).when(a < 0, least(a > 0)).when(a == 0, least(a == 0))
    placed = raws.withColumns({"size": F.abs("amount"), "r": F.col("raw_row_number").cast("long")}).withColumn("turn", F.when(F.col("source_file").isNotNull(), turn))
    told = lambda rows, *more: rows.where("source = 'bank' and balance is not null").select("source_account", "booking_date", "amount", "balance", *more)
    bank = told(raws, T.audit_form(F.col("counterparty")).alias("party"), T.audit_form(F.col("description")).alias("what"))
    key = ["source_account", "booking_date", "amount", "balance"]
    groups = bank.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct(F.nullif("party", F.lit(""))).alias("parties"), F.count_distinct(F.nullif("what", F.lit(""))).alias("whats")).where("n_rows > 1")
    following = F.lead("r").over(Window.partitionBy(*key, "source_file").orderBy("r"))
    gaps = told(placed, "source_file", "r", "turn").withColumn("next", following)
    between = gaps.where("turn < next").select(*key).distinct().withColumn("reversal", F.lit(True))
    out = groups.join(between, key, "left").withColumns({"interleaved_reversal": F.coalesce("reversal", F.lit(False)), "same_counterparty": F.col("parties") == 1, "same_description": F.col("whats") == 1})
    high = ~F.col("interleaved_reversal") & F.col("same_description") & (F.col("same_counterparty") | (F.abs("amount") >= large))
    return out.select(*key, "n_rows", "same_counterparty", "same_description", "interleaved_reversal", F.when(high, "high").otherwise("review").alias("priority"))
