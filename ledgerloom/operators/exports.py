"""Ledgers and reports as text lines, and checks of what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENCY, INDENT, UNCLASSIFIED = "CNY", "  ", "Unclassified"
#: Sections of an export in their order.
OPEN, ENTRY = 1, 2


def account_names(rows: DataFrame, assets: dict[str, str]) -> DataFrame:
    """rows with asset and other, the accounts of both postings; assets maps a source to its account and may be replaced by the user's own."""
    asset = F.lit(f"Assets:{UNCLASSIFIED}")
    for source, account in assets.items():
        asset = F.when(F.col("source") == source, account).otherwise(asset)
    kind = F.when(F.col("amount") > 0, "Income").otherwise("Expenses")
    part = F.regexp_replace(F.coalesce("category", F.lit("")), r"[^\p{L}\p{N}-]", "")
    return rows.withColumns({"asset": asset, "other": F.concat(kind, F.lit(":"), F.when(part == "", UNCLASSIFIED).otherwise(part))})


def narration(c: Column) -> Column:
    """Text for a line of a ledger: no quotes or line ends, 50 characters, never blank."""
    plain = F.trim(F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r'["\n\r]', ""), 1, 50))
    return F.when(plain == "", "Unknown").otherwise(plain)


def posting(account: Column, amount: Column) -> Column:
    return F.concat(F.lit(INDENT), account, F.lit("  "), amount.cast("decimal(18,2)").cast("string"), F.lit(f" {CURRENCY}"))


def ledger_lines(rows: DataFrame, opened: str) -> DataFrame:
    """(section, day, key, nth, line): account openings, then per row a heading, its two postings and a blank line, in order of section, day, key, nth.

    rows: row_id, ts, amount, merchant, asset, other, review (a row for review is flagged ! instead of *). Entries are ordered by time, then id.
    """
    accounts = rows.select(F.explode(F.array("asset", "other")).alias("a")).distinct()
    heads = accounts.select(F.lit(OPEN).alias("section"), F.lit(opened).alias("day"), F.col("a").alias("key"), F.lit(0).alias("nth"), F.concat(F.lit(f"{opened} open "), "a", F.lit(f" {CURRENCY}")).alias("line"))
    flag = F.when(F.col("review"), "!").otherwise("*")
    title = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" "), flag, F.lit(' "'), narration(F.col("merchant")), F.lit('"'))
    lines = F.array(title, posting(F.col("asset"), F.col("amount")), posting(F.col("other"), -F.col("amount")), F.lit(""))
    entries = rows.select(F.lit(ENTRY).alias("section"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("day"), F.col("row_id").cast("string").alias("key"), F.posexplode(lines).alias("nth", "line"))
    return heads.unionByName(entries)


def duplicate_lines(rows: DataFrame, results: DataFrame) -> DataFrame:
    """(section, key, line) of a report on duplicates and rows for review, as comments: row_id, ts, amount, party; results as of engine.resolve."""
    both = rows.select("row_id", "ts", "amount", "party").join(results.where("status in ('DUPLICATE', 'REVIEW')"), "row_id")
    return both.select(
        F.col("status").alias("section"), F.col("row_id").alias("key"),
        F.concat(F.lit("; "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("amount").cast("string"), F.lit(" "), narration(F.col("party")), F.lit(" <- "), F.col("duplicate_of"), F.lit(" ["), F.col("level"), F.lit("]")).alias("line"),
    )


def unbalanced(lines: DataFrame) -> DataFrame:
    """(key, total) of entries of ledger_lines whose postings don't add up to zero."""
    amount = F.regexp_extract("line", rf"(-?\d+\.\d{{2}}) {CURRENCY}$", 1).try_cast("decimal(18,2)")
    sums = lines.where(f"section = {ENTRY} and nth in (1, 2)").groupBy("key").agg(F.sum(amount).alias("total"))
    return sums.where("total <> 0 or total is null")


def json_lines(rows: DataFrame) -> DataFrame:
    """(line): each row as JSON with its fields in the order of their names, nulls written."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV with a heading in UTF-8, a file per partition."""
    rows.write.option("header", True).option("quoteAll", True).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of ledger_lines as text files; files in order of their names, and lines in them, are in the ledger's order."""
    order = ["section", "day", "key", "nth"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def interval_gate(summary: DataFrame) -> DataFrame:
    """One row: accounts, failing accounts, and whether the report passes."""
    return summary.agg(F.count("*").alias("n_accounts"), F.count_if(F.col("n_failures") > 0).alias("n_failing"), (F.count_if(F.col("n_failures") > 0) == 0).alias("passes"))
