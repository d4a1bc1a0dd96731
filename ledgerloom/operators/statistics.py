"""Summary, categories, timelines, facets and pages over (row_id, source, ts, amount, kind, category) rows.

kind is EXPENSE (amount below 0), INCOME or REFUND.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import MONEY, period_start
from ledgerloom.functions.lexicon import UNCATEGORISED


def _sum(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.abs("amount"))), F.lit(0)).cast(MONEY)


def _net() -> list[Column]:
    return [(F.col("gross_expense") - F.col("refunds")).cast(MONEY).alias("net_expense"), (F.col("income") + F.col("refunds") - F.col("gross_expense")).cast(MONEY).alias("net_flow")]


def summary(rows: DataFrame) -> DataFrame:
    """One row: gross_expense, income, refunds, n_rows, net_expense and net_flow."""
    sums = rows.agg(_sum("EXPENSE").alias("gross_expense"), _sum("INCOME").alias("income"), _sum("REFUND").alias("refunds"), F.count("*").alias("n_rows"))
    return sums.select("*", *_net())


def categories(rows: DataFrame) -> DataFrame:
    """Per category (blank: uncategorised): expense, refunds, net."""
    category = F.when(F.trim(F.coalesce("category", F.lit(""))) == "", "uncategorised").otherwise(F.col("category"))
    sums = rows.where("kind <> 'INCOME'").groupBy(category.alias("category")).agg(_sum("EXPENSE").alias("expense"), _sum("REFUND").alias("refunds"))
    return sums.withColumn("net", (F.col("expense") - F.col("refunds")).cast(MONEY))


def timeline(rows: DataFrame, period: str) -> DataFrame:
    """Per day, week, month or year: sums, nets and count."""
    sums = rows.groupBy(period_start(F.col("ts"), period).alias("period")).agg(_sum("EXPENSE").alias("gross_expense"), _sum("INCOME").alias("income"), _sum("REFUND").alias("refunds"), F.count("*").alias("n_rows"))
    return sums.select("*", *_net())


def facets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.countDistinct("row_id").alias("n_rows"))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page, newest first, then by id."""
    if not (number >= 1 and 1 <= size <= 200):
        raise ValueError("page numbers start at 1 and a page has 1 to 200 rows")
    return rows.orderBy(F.col("ts").desc_nulls_last(), "row_id").offset((number - 1) * size).limit(size)


def search(rows: DataFrame, words: str | None = None, kind: str | None = None, source: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows within all given filters; words are looked for in the category, whatever the case."""
    out = rows
    for keep, given in (
        (lambda: F.contains(F.lower("category"), F.lower(F.lit(words))), words), (lambda: F.col("kind") == kind, kind), (lambda: F.col("source") == source, source),
        (lambda: F.col("ts") >= F.lit(start).cast("timestamp_ntz"), start), (lambda: F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"), end),
    ):
        out = out.where(keep()) if given is not None else out
    return out


def search_texts(canonicals: DataFrame, words: str, columns: tuple[str, ...] = ("merchant", "normalized_merchant", "notes")) -> DataFrame:
    """canonicals one of whose text columns holds the words as they stand, whatever the case; null texts hold none, and empty words are everywhere."""
    if not words:
        return canonicals
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(words))), F.lit(False))
    return canonicals.where(hit)


def collisions(rows: DataFrame, key: list[str], party: str) -> DataFrame:
    """Groups of equal keys with several rows: count, and whether they name one party."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.countDistinct(party).alias("parties"))
    return groups.where("n_rows > 1").select(*key, "n_rows", (F.col("parties") <= 1).alias("same_party"))


def pending_ids(classifications: DataFrame, relationships: DataFrame) -> DataFrame:
    """canonical_id of rows that wait for a decision, as a class or as a refund; reports leave them out."""
    waits = lambda df, c: df.where("status = 'pending'").select(F.col(c).alias("canonical_id"))
    return waits(classifications, "canonical_id").union(waits(relationships, "from_id")).distinct()


def in_range(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """rows whose booking_date lies between the given days, both included."""
    if start and end and start > end:
        raise ValueError("the range ends before it starts")
    for day, keep in ((start, F.col("booking_date") >= F.lit(start).cast("date")), (end, F.col("booking_date") <= F.lit(end).cast("date"))):
        rows = rows.where(keep) if day else rows
    return rows


def report_facts(canonicals: DataFrame, relationships: DataFrame, classifications: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(canonical_id, fact, category, booking_date, amount): what reports add up, one fact a row or confirmed refund.

    fact: expense, income, refund, excluded (transfers, investments, preauthorisations), unclassified or pending. A confirmed refund
    counts under its original's category on its own day, even where the row itself waits for a class; a refund row without a
    confirmed link counts under its own category. Amounts are absolute but for incomes.
    """
    rows = in_range(canonicals, start, end)
    category = lambda c: F.when(F.coalesce(c, F.lit("")) == "", UNCATEGORISED).otherwise(c).alias("category")
    waits = pending_ids(classifications, relationships).withColumn("waits", F.lit(True))
    linked = relationships.where("status = 'confirmed'").select("from_id", "to_id", F.col("amount").alias("returned"))
    fact = F.when(F.col("waits"), "pending").when(F.col("tx_type") == "EXPENSE", "expense").when(F.col("tx_type") == "INCOME", "income").when(F.col("tx_type") == "REFUND", "refund")
    fact = fact.when(F.col("tx_type").isin("TRANSFER", "INVESTMENT", "PREAUTHORIZATION"), "excluded").otherwise("unclassified")
    own = rows.join(waits, "canonical_id", "left").withColumn("fact", fact).join(linked.select(F.col("from_id").alias("canonical_id")).distinct().withColumn("linked", F.lit(True)), "canonical_id", "left")
    own = own.where("fact <> 'refund' or linked is null").select("canonical_id", "fact", category(F.col("category")), "booking_date", F.when(F.col("fact") == "income", F.col("amount")).otherwise(F.abs("amount")).alias("amount"))
    originals = canonicals.select(F.col("canonical_id").alias("to_id"), category(F.col("category")))
    back = linked.join(rows.select(F.col("canonical_id").alias("from_id"), "booking_date"), "from_id").join(originals, "to_id")
    return own.unionByName(back.select(F.col("from_id").alias("canonical_id"), F.lit("refund").alias("fact"), "category", "booking_date", F.col("returned").alias("amount")))


def _fact(name: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("fact") == name, F.col("amount"))), F.lit(0)).cast(MONEY)


def report_summary(facts: DataFrame, asset_change: DataFrame | None = None) -> DataFrame:
    """One row of sums and counts; net_flow is the verified asset change (one row, asset_change) where there is one."""
    n = lambda name: F.count_if(F.col("fact") == name)
    out = facts.agg(
        _fact("expense").alias("gross_expense"), _fact("refund").alias("refunds"), _fact("income").alias("income"), n("expense").alias("n_expenses"), n("income").alias("n_incomes"), n("refund").alias("n_refunds"),
        n("excluded").alias("n_excluded"), n("unclassified").alias("n_unclassified"), n("pending").alias("n_pending"),
    )
    flow = (F.col("income") + F.col("refunds") - F.col("gross_expense")).cast(MONEY)
    out = out.withColumns({"net_expense": (F.col("gross_expense") - F.col("refunds")).cast(MONEY), "net_flow": flow})
    if asset_change is None:
        return out
    return out.withColumn("j", F.lit(1)).join(asset_change.withColumn("j", F.lit(1)), "j").withColumn("net_flow", F.coalesce("asset_change", "net_flow")).drop("j", "asset_change")


def report_categories(facts: DataFrame) -> DataFrame:
    """Per category of expenses and refunds: gross_expense, refunds, net."""
    out = facts.where("fact in ('expense', 'refund')").groupBy("category").agg(_fact("expense").alias("gross_expense"), _fact("refund").alias("refunds"))
    return out.withColumn("net", (F.col("gross_expense") - F.col("refunds")).cast(MONEY))


def report_timeline(facts: DataFrame, period: str) -> DataFrame:
    """Per period, newest first: expenses, refunds, incomes and net flow."""
    rows = facts.where("fact in ('expense', 'refund', 'income')").groupBy(period_start(F.col("booking_date"), period).alias("period"))
    out = rows.agg(_fact("expense").alias("gross_expense"), _fact("refund").alias("refunds"), _fact("income").alias("income"))
    return out.withColumn("net_flow", (F.col("income") + F.col("refunds") - F.col("gross_expense")).cast(MONEY)).orderBy(F.col("period").desc())


def facets_by_account(canonicals: DataFrame, links: DataFrame, raws: DataFrame) -> DataFrame:
    """(source, source_account, n_rows): distinct canonical rows per source, with null account, and per account of it."""
    each = links.select("canonical_id", "raw_id").join(raws.select("raw_id", "source", "source_account"), "raw_id").join(canonicals.select("canonical_id"), "canonical_id", "left_semi")
    both = each.select("canonical_id", "source", F.explode(F.array(F.col("source_account"), F.lit(None).cast("string"))).alias("source_account"))
    return both.groupBy("source", "source_account").agg(F.count_distinct("canonical_id").alias("n_rows"))


def page_with_total(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page in order, each row with the total of all pages."""
    if not (number >= 1 and 1 <= size <= 200):
        raise ValueError("page numbers start at 1 and a page has 1 to 200 rows")
    total = rows.agg(F.count("*").alias("total")).withColumn("j_", F.lit(1))
    page = rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("j_", F.lit(1))
    return page.join(F.broadcast(total), "j_").drop("j_")  # total is one row


def validation(facts: DataFrame, canonicals: DataFrame) -> DataFrame:
    """(check, holds): yearly sums add up to the totals, nets follow from their parts, every row has a day, an amount that isn't zero and a type."""
    years, whole = report_timeline(facts, "year").withColumn("j", F.lit(1)), report_summary(facts).withColumn("j", F.lit(1))
    sums = years.groupBy("j").agg(*[F.sum(c).alias(f"y_{c}") for c in ("gross_expense", "refunds", "income")]).join(whole, "j")
    ok = [F.struct(F.lit(f"yearly_{c}").alias("check"), (F.col(f"y_{c}") == F.col(c)).alias("holds")) for c in ("gross_expense", "refunds", "income")]
    ok.append(F.struct(F.lit("net_flow").alias("check"), (F.col("net_flow") == F.col("income") - F.col("net_expense")).alias("holds")))
    first = sums.select(F.explode(F.array(*ok)).alias("c")).select("c.*")
    bad = canonicals.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in (("day", F.col("booking_date").isNull()), ("amount", F.col("amount") == 0), ("type", F.trim("tx_type") == ""))])
    return first.union(bad.select(F.explode(F.array(*[F.struct(F.lit(f"rows_have_{n}").alias("check"), (F.col(n) == 0).alias("holds")) for n in ("day", "amount", "type")])).alias("c")).select("c.*"))
