"""The ledger's tables joined, listed and queued: canonical rows with their sources, review queues and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import texts as T
from ledgerloom.functions.exprs import MONEY
from ledgerloom.operators.durable import cut
from ledgerloom.operators.keywords import keyword_hits

#: Accounts up to which a table of them is broadcast to the rows that may name one.
FEW = 10_000


def live(canonicals: DataFrame, deletions: DataFrame) -> DataFrame:
    return canonicals.join(deletions.select("canonical_id").distinct(), "canonical_id", "left_anti")


def from_sources(canonicals: DataFrame, links: DataFrame, raws: DataFrame, wanted: list[tuple[str, str | None]]) -> DataFrame:
    """Canonical rows with a raw row of one of the wanted (source, account or None for all its accounts)."""
    hit = F.lit(False)
    for source, account in wanted:
        hit = hit | ((F.col("source") == source) & (F.lit(True) if account is None else F.col("source_account") == account))
    ids = links.join(raws.where(hit).select("raw_id"), "raw_id", "left_semi").select("canonical_id").distinct()
    return canonicals.join(ids, "canonical_id", "left_semi")


def with_sources(canonicals: DataFrame, links: DataFrame, raws: DataFrame) -> DataFrame:
    """Each canonical row with its number of sources and its raw rows as an array, by raw_id."""
    raw = raws.select("raw_id", "source", "amount", "booking_date")
    each = links.select("canonical_id", "raw_id").join(raw, "raw_id").groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("raw_id", "source", "amount"))).alias("sources"))
    return canonicals.join(each, "canonical_id", "left").withColumn("source_count", F.coalesce(F.size("sources"), F.lit(0)))


def source_counts(canonicals: DataFrame, links: DataFrame) -> DataFrame:
    n = links.groupBy("canonical_id").agg(F.count("*").alias("source_count"))
    return canonicals.join(n, "canonical_id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0).cast("long")))


def linked_rows(raws: DataFrame, links: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Every raw row with its canonical row, or nulls."""
    side = canonicals.select("canonical_id", F.col("amount").alias("canonical_amount"), "tx_type")
    return raws.join(links.select("raw_id", "canonical_id"), "raw_id", "left").join(side, "canonical_id", "left")


def backed_by_bank(canonicals: DataFrame, links: DataFrame, raws: DataFrame, products: list[str]) -> DataFrame:
    """canonicals with bank_backed and internal_product, from their bank rows."""
    bank = links.join(raws.where("source = 'bank'").select("raw_id", "description", "counterparty"), "raw_id")
    inside = F.col("description").isin(products) | ((F.col("description") == "基金购买") & ~F.contains(F.coalesce("counterparty", F.lit("")), F.lit("基金销售")))
    marks = bank.groupBy("canonical_id").agg(F.bool_or(F.coalesce(inside, F.lit(False))).alias("p"))
    both = canonicals.join(marks, "canonical_id", "left")
    return both.withColumns({"bank_backed": F.col("p").isNotNull(), "internal_product": F.coalesce("p", F.lit(False))}).drop("p")


def naming(rows: DataFrame, row_id: str, text: str, accounts: DataFrame, few: int = FEW) -> DataFrame:
    """rows (row_id without repeats, text, more) with each of accounts (account, more; accounts differ) that the text names.

    Up to `few` accounts are broadcast, more are found through the index of their character pairs.
    """
    names = F.contains(text, "account")
    if accounts.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(accounts), names)
    numbered = cut(accounts.select("account").withColumn("nth", F.monotonically_increasing_id()))
    hits = keyword_hits(rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")), numbered.select("nth", F.col("account").alias("word")))
    pairs = hits.join(numbered, "nth").select(F.col("row_id").alias(row_id), "account")
    return rows.join(pairs, row_id).join(accounts, "account").where(names)


def pending_after(canonicals: DataFrame, links: DataFrame, raws: DataFrame, closings: DataFrame) -> DataFrame:
    """(account, canonical_id, amount): rows after an account's last statement day, funded by it and known to a wallet but not to a bank.

    closings: account, day; an account's name is looked for inside the funding text.
    """
    kinds = links.join(raws.select("raw_id", "source"), "raw_id").groupBy("canonical_id").agg(F.bool_or(F.col("source").isin("wechat", "alipay")).alias("wallet"), F.bool_or(F.col("source") == "bank").alias("bank"))
    rows = canonicals.join(kinds.where("wallet and not bank"), "canonical_id", "left_semi")
    return naming(rows, "canonical_id", "funding_account", closings).where("booking_date > day").select("account", "canonical_id", "amount")


def merge_candidates(known: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Found candidates over known ones: a known one keeps its status and takes the new confidence; a new one is pending; one not found again stays."""
    old = known.select(*key, F.col("status").alias("s"), F.col("confidence").alias("c"))
    both = found.select(*key, "confidence").join(old, key, "full")
    return both.select(*key, F.coalesce("s", F.lit("pending")).alias("status"), F.coalesce("confidence", "c").alias("confidence"))


def current_states(changes: DataFrame) -> DataFrame:
    """(candidate_id, status, seq, actor) from an append-only log: the last change that decides, by seq."""
    decides = changes.where("action in ('confirm', 'reject', 'supersede')")
    last = decides.groupBy("candidate_id").agg(F.max(F.struct("seq", "action", "actor")).alias("b"))
    status = F.when(F.col("b.action") == "confirm", "confirmed").when(F.col("b.action") == "reject", "rejected").otherwise("superseded")
    return last.select("candidate_id", status.alias("status"), "b.seq", "b.actor")


def with_status(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """candidates under the log: a decided one has the log's status, others their own."""
    state = current_states(changes).select("candidate_id", F.col("status").alias("s"))
    return candidates.join(state, "candidate_id", "left").withColumn("status", F.coalesce("s", "status")).drop("s")


def superseded_by(candidates: DataFrame) -> DataFrame:
    """(candidate_id, by): pending candidates that share an end with a confirmed one, and the least such."""
    won, open_ = candidates.where("status = 'confirmed'"), candidates.where("status = 'pending'")
    sides = [open_.select("candidate_id", end).join(won.select(F.col("candidate_id").alias("by"), end), end).select("candidate_id", "by") for end in ("left_raw_id", "right_raw_id")]
    return sides[0].union(sides[1]).groupBy("candidate_id").agg(F.min("by").alias("by"))


def history(changes: DataFrame) -> DataFrame:
    """changes with their number in the candidate's history."""
    return changes.withColumn("nth", F.row_number().over(Window.partitionBy("candidate_id").orderBy("happened_at", "seq")))


def queue(rows: DataFrame, order: list[Column], number: int = 1, size: int = 30) -> DataFrame:
    """A page of a review queue with its place from 1."""
    if not (number >= 1 and 1 <= size <= 200):
        raise ValueError("page numbers start at 1 and a page has 1 to 200 rows")
    page = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return page.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) + (number - 1) * size)  # a page's rows


def attention(relationships: DataFrame) -> DataFrame:
    """relationships with the refund queue each belongs to: required while pending, warning if confirmed but doubtful, acknowledged, else settled."""
    doubt = F.col("is_ambiguous") | F.col("is_partial")
    name = F.when(F.col("status") == "pending", "required").when((F.col("status") == "confirmed") & doubt & F.col("acknowledged"), "acknowledged").when((F.col("status") == "confirmed") & doubt, "warning").otherwise("settled")
    return relationships.withColumn("queue", name)


def unreviewed(raws: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Raw rows with neither a canonical row nor a pending candidate at either end."""
    waits = candidates.where("status = 'pending'")
    ends = waits.select(F.col("left_raw_id").alias("raw_id")).union(waits.select("right_raw_id")).distinct()
    return raws.join(links, "raw_id", "left_anti").join(ends, "raw_id", "left_anti")


def candidate_details(candidates: DataFrame, raws: DataFrame) -> DataFrame:
    """candidates with amount, day and source of both ends."""
    side = lambda p: raws.select(F.col("raw_id").alias(f"{p}_raw_id"), F.col("source").alias(f"{p}_source"), F.col("amount").alias(f"{p}_amount"), F.col("booking_date").alias(f"{p}_day"))
    return candidates.join(side("left"), "left_raw_id").join(side("right"), "right_raw_id")


def import_history(batches: DataFrame, raws: DataFrame, links: DataFrame) -> DataFrame:
    """Per batch: rows, linked rows, first and last day; batches without rows have zeros."""
    rows = raws.select("import_batch_id", "raw_id", "booking_date").join(links.select("raw_id").distinct().withColumn("l", F.lit(1)), "raw_id", "left")
    n = rows.groupBy(F.col("import_batch_id").alias("batch_id")).agg(F.count("*").alias("n_rows"), F.count("l").alias("n_linked"), F.min("booking_date").alias("first_day"), F.max("booking_date").alias("last_day"))
    zero = F.lit(0).cast("long")
    return batches.join(n, "batch_id", "left").withColumns({"n_rows": F.coalesce("n_rows", zero), "n_linked": F.coalesce("n_linked", zero)})


def new_batches(batches: DataFrame, known: DataFrame) -> DataFrame:
    """Batches whose file, by its hash, is neither known nor an earlier one of these."""
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("imported_at", "batch_id"))
    return batches.withColumn("n_", first).where("n_ = 1").drop("n_").join(known.select("file_hash"), "file_hash", "left_anti")


def upsert_raws(known: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, occurrences) for rows with a key: of equal keys the first by raw_id comes in unless the key is known; every arrival is an occurrence."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("raw_id"))
    new = arrived.withColumn("n_", first).where("n_ = 1").drop("n_").join(known.select("key"), "key", "left_anti")
    stored = known.select("key", F.col("raw_id").alias("stored_id")).union(new.select("key", "raw_id"))
    return new, arrived.select("key", "raw_id", "import_batch_id").join(stored, "key").withColumn("is_new", F.col("raw_id") == F.col("stored_id"))


def canonical_from(raws: DataFrame) -> DataFrame:
    """Canonical rows built from confirmed raw rows; ids follow from the raw ids."""
    kind = F.when(F.col("direction") == "income", "INCOME").when(F.col("direction") == "expense", "EXPENSE").otherwise("UNKNOWN")
    return raws.select(
        F.sha2(F.concat_ws("|", F.lit("canonical"), "raw_id"), 256).alias("canonical_id"), "raw_id", "transaction_time", "booking_date", "amount", "merchant", T.party_name(F.col("merchant")).alias("normalized_merchant"),
        F.col("source").alias("payment_channel"), F.col("payment_method").alias("funding_account"), kind.alias("tx_type"), "status",
    )


def canonical_from_match(pairs: DataFrame, raws: DataFrame) -> DataFrame:
    """(canonical_id, raw_ids, ...) of payment-to-bank pairs: time and merchant of the payment, account of the bank, both raw rows linked."""
    p = raws.select(F.col("raw_id").alias("left_raw_id"), "transaction_time", "booking_date", "amount", "merchant", F.col("source").alias("payment_channel"))
    b = raws.select(F.col("raw_id").alias("right_raw_id"), F.col("source_account").alias("funding_account"))
    both = pairs.select("left_raw_id", "right_raw_id", "confidence").join(p, "left_raw_id").join(b, "right_raw_id")
    return both.select(F.sha2(F.concat_ws("|", F.lit("match"), "left_raw_id", "right_raw_id"), 256).alias("canonical_id"), F.array("left_raw_id", "right_raw_id").alias("raw_ids"), "transaction_time", "booking_date", "amount", "merchant", "payment_channel", "funding_account", "confidence")


def canonical_from_sum(groups: DataFrame, raws: DataFrame) -> DataFrame:
    """Canonical rows of bank rows that several payments add up to: groups (bank_id, payment_ids); earliest time, merchants in order joined by +, channels sorted."""
    each = groups.select("bank_id", F.posexplode("payment_ids").alias("nth", "raw_id")).join(raws.select("raw_id", "transaction_time", "merchant", "source"), "raw_id")
    parts = each.groupBy("bank_id").agg(
        F.min("transaction_time").alias("transaction_time"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("nth", "merchant"))), lambda x: x["merchant"])), " + ").alias("merchant"),
        F.array_join(F.sort_array(F.collect_set("source")), "+").alias("payment_channel"),
    )
    bank = raws.select(F.col("raw_id").alias("bank_id"), "booking_date", "amount", F.col("source_account").alias("funding_account"))
    return parts.join(bank, "bank_id").withColumn("confidence", F.lit("0.95").cast("decimal(4,2)"))


def versions(base: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """base rows under an append-only log of edits (canonical_id, seq, action create, update, delete or restore, and fields, null where not edited).

    Each field has its last edited value; rows deleted and not restored since are out.
    """
    of = edits.groupBy("canonical_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"n_{f}") for f in fields], F.max_by("action", F.when(F.col("action").isin("create", "delete", "restore"), F.col("seq"))).alias("last")
    )
    out = base.join(of, "canonical_id", "left").where("last is null or last <> 'delete'")
    return out.select(*[F.coalesce(f"n_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The latest balance of each source, account and kind, by day, then order of entry."""
    last = snapshots.groupBy("source", "source_account", "balance_kind").agg(F.max(F.struct("as_of", "seq", "balance")).alias("b"))
    return last.select("source", "source_account", "balance_kind", F.col("b.as_of").alias("as_of"), F.col("b.balance").alias("balance"))


def bank_cash(raws: DataFrame) -> DataFrame:
    """Each bank account's last balance, carried on with later wallet rows of its card or naming it: account, statement_balance, pending_adjustment, balance, as_of.

    A wallet row counts once for an account, by suffix or by name.
    """
    at = F.struct("booking_date", F.coalesce(F.col("transaction_time").cast("string"), F.lit("")).alias("t"), F.coalesce("raw_row_number", F.lit(0)).alias("r"), "raw_id", "balance", "bank_card_suffix")
    last = raws.where("source = 'bank' and balance is not null").groupBy(F.col("source_account").alias("account")).agg(F.max(at).alias("b"))
    last = last.select("account", F.col("b.booking_date").alias("day"), F.col("b.balance").alias("statement_balance"), F.coalesce("b.bank_card_suffix", F.lit("")).alias("suffix"))
    wallet = raws.where("source in ('wechat', 'alipay') and amount <> 0").select("raw_id", F.coalesce("bank_card_suffix", F.lit("")).alias("s"), F.coalesce("payment_method", F.lit("")).alias("m"), F.col("booking_date").alias("d"), "amount")
    last = cut(last)
    by_suffix = wallet.join(last.where("suffix <> ''"), F.col("s") == F.col("suffix"))
    by_name = naming(wallet, "raw_id", "m", last)
    hits = by_suffix.unionByName(by_name).where("d > day").dropDuplicates(["raw_id", "account"])
    later = hits.groupBy("account").agg(F.sum("amount").cast(MONEY).alias("adj"), F.max("d").alias("till"))
    adjustment = F.coalesce("adj", F.lit(0)).cast(MONEY)
    return last.join(later, "account", "left").select("account", "statement_balance", adjustment.alias("pending_adjustment"), (F.col("statement_balance") + adjustment).cast(MONEY).alias("balance"), F.coalesce("till", "day").alias("as_of"))


def product_positions(raws: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Products inside banks, from the rows that move money in and out: account, balance, as_of; zero positions and those with a snapshot are left out."""
    move = F.col("description").isin("朝朝宝转入", "朝朝宝转出")
    fund = F.contains("source_account", F.lit("工商银行")) & (F.col("description") == "基金购买") & ~F.contains(F.coalesce("counterparty", F.lit("")), F.lit("基金销售"))
    rows = raws.where((F.col("source") == "bank") & (move | fund))
    name = F.concat("source_account", F.when(move, "朝朝宝").otherwise("天天盈"))
    out = rows.groupBy(name.alias("account")).agg(F.sum(F.when(move, -F.col("amount")).otherwise(F.abs("amount"))).cast(MONEY).alias("balance"), F.max("booking_date").alias("as_of"))
    return out.where("balance <> 0").join(snapshots.select(F.col("source_account").alias("account")).distinct(), "account", "left_anti")


def account_totals(cash: DataFrame, products: DataFrame, latest: DataFrame) -> DataFrame:
    """One row: cash_total, internal_product_total, snapshot_total (credit limits left out), known_balance, as_of."""
    kinds = cash.select(F.lit("cash").alias("k"), "balance", "as_of").union(products.select(F.lit("product"), "balance", "as_of")).union(latest.select(F.when(F.col("balance_kind") == "credit_limit", "limit").otherwise("snapshot"), "balance", "as_of"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("balance"))), F.lit(0)).cast(MONEY)
    sums = kinds.agg(of("cash").alias("cash_total"), of("product").alias("internal_product_total"), of("snapshot").alias("snapshot_total"), F.max("as_of").alias("as_of"))
    return sums.withColumn("known_balance", (F.col("cash_total") + F.col("internal_product_total") + F.col("snapshot_total")).cast(MONEY))


def asset_closure(bank: DataFrame, wallets: DataFrame, products: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: closing assets computed with projected wallet balances, known with actual ones, and their difference.

    bank (balance), wallets (projected, actual or null), products (balance), pending (amount).
    """
    parts = bank.select(F.lit("bank").alias("k"), F.col("balance").alias("v")).union(wallets.select(F.lit("projected"), "projected")).union(wallets.select(F.lit("actual"), "actual"))
    parts = parts.union(products.select(F.lit("product"), "balance")).union(pending.select(F.lit("pending"), "amount"))
    of = lambda *k: F.coalesce(F.sum(F.when(F.col("k").isin(*k), F.col("v"))), F.lit(0)).cast(MONEY)
    sums = parts.agg(of("bank", "projected", "product", "pending").alias("computed_total"), of("bank", "actual", "product", "pending").alias("known_total"))
    return sums.withColumn("difference", (F.col("known_total") - F.col("computed_total")).cast(MONEY))


def verified_change(intervals: DataFrame, wallets: DataFrame, closure: DataFrame) -> DataFrame:
    """One row: asset_change, the known closing total if every chain closes, else null.

    It holds if no interval has a fault, every account opens at zero, no wallet's actual balance differs from or is
    missing beside its projection, and there is an account or an actual balance at all.
    """
    i = intervals.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("bad"), F.count_if((F.col("previous").isNull()) & (F.col("balance") != F.col("amount"))).alias("opened"))
    w = wallets.agg(F.count("actual").alias("anchored"), F.count_if(F.col("actual").isNull() | (F.col("actual") != F.col("projected"))).alias("off"))
    one = i.withColumn("j", F.lit(1)).join(w.withColumn("j", F.lit(1)), "j").join(closure.withColumn("j", F.lit(1)), "j")  # three single rows
    holds = (F.col("bad") == 0) & (F.col("opened") == 0) & (F.col("off") == 0) & ((F.col("n") > 0) | (F.col("anchored") > 0))
    return one.select(F.when(holds, F.col("known_total")).alias("asset_change"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows) of every table."""
    out = None
    for name, df in sorted(tables.items()):
        n = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out
