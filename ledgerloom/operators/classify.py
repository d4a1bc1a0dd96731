"""Rule classification, coverage of an import, and text entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as L
from ledgerloom.functions import texts as T

AUTO_CONFIRM = "0.88"


def classify(rows: DataFrame, rules: list[tuple[str, Column, str]], auto_confirm: str = AUTO_CONFIRM) -> DataFrame:
    """rows with proposed, confidence and auto_confirmed by the first rule (name, condition, confidence) that holds; else NONE and 0."""
    name, sure = F.lit("NONE"), F.lit("0").cast("decimal(4,2)")
    for rule, holds, confidence in reversed(rules):
        hit = F.coalesce(holds, F.lit(False))
        name, sure = F.when(hit, rule).otherwise(name), F.when(hit, F.lit(confidence).cast("decimal(4,2)")).otherwise(sure)
    out = rows.withColumns({"proposed": name, "confidence": sure})
    return out.withColumn("auto_confirmed", F.col("confidence") >= F.lit(auto_confirm).cast("decimal(4,2)"))


def missing_from_import(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Per account, how many known rows lie in the date range that an import covers but are not in it."""
    span = seen.groupBy("account").agg(F.min(F.col("ts").cast("date")).alias("a"), F.max(F.col("ts").cast("date")).alias("z"))
    inside = known.join(span, "account").where(F.col("ts").cast("date").between(F.col("a"), F.col("z")))
    return inside.join(seen.select("row_id"), "row_id", "left_anti").groupBy("account").agg(F.count("*").alias("n_missing"))


def entry_lines(rows: DataFrame) -> DataFrame:
    """Double-entry text of (row_id, source, ts, amount, kind, category): header, leg and other, one entry a row."""
    name = F.regexp_replace(F.substring(F.regexp_replace(F.col("category"), r'["\n\r]', ""), 1, 50), r"^\s*$", "Unknown")
    header = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(' * "'), name, F.lit('"'))
    leg = F.concat(F.lit("  Assets:"), F.initcap("source"), F.lit("  "), F.col("amount").cast("string"), F.lit(" CNY"))
    side = F.when(F.col("kind") == "INCOME", "Income").otherwise("Expenses")
    other = F.concat(F.lit("  "), side, F.lit(":Unclassified  "), (-F.col("amount")).cast("decimal(18,2)").cast("string"), F.lit(" CNY"))
    return rows.select("row_id", header.alias("header"), leg.alias("leg"), other.alias("other"))


def propose(canonicals: DataFrame) -> DataFrame:
    """Proposals for rows of type EXPENSE, INCOME or UNKNOWN: proposed_type, proposed_category, confidence, evidence, auto_confirmed; rows without one are left out.

    canonicals carry bank_backed and internal_product (records.backed_by_bank). A bank's own product comes first, then money between a
    wallet and a bank, then the word rules in order; a closed trade that a bank row backs was paid after all, so that rule is passed over.
    """
    said = F.lower(T.text("merchant", "normalized_merchant", "payment_channel", "funding_account", "status", "notes"))
    to_bank = (F.col("tx_type") == "UNKNOWN") & F.col("payment_channel").isin("alipay", "wechat") & F.contains("merchant", F.lit("银行")) & F.col("funding_account").isin(L.WALLET_FUNDS)
    make = lambda kind, category, sure, evidence: F.struct(F.lit(kind).alias("proposed_type"), F.lit(category).alias("proposed_category"), F.lit(sure).cast("decimal(4,2)").alias("confidence"), evidence.alias("evidence"))
    rules = [(F.col("internal_product"), make(*L.PRODUCT_CLASS, F.lit("statement:bank_internal_product"))), (to_bank, make(*L.WALLET_TO_BANK, F.lit("funding-account:wallet_to_bank")))]
    for kind, category, words, sure in L.CLASSES:
        word = T.first_of([(F.contains(said, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))
        holds = word.isNotNull() & ~((word == "交易关闭") & F.col("bank_backed"))
        rules.append((F.coalesce(holds, F.lit(False)), make(kind, category, sure, F.concat(F.lit("keyword:"), word))))
    found = canonicals.where(F.col("tx_type").isin("EXPENSE", "INCOME", "UNKNOWN")).withColumn("p", T.first_of(rules, F.lit(None))).where("p is not null")
    return found.select(*canonicals.columns, "p.*").withColumn("auto_confirmed", F.col("confidence") >= F.lit(AUTO_CONFIRM).cast("decimal(4,2)"))
