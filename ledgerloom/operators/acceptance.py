"""The passes over a whole ledger in their order: matches, sums, safe confirmations, classes, refunds, balances and counts, each a stored stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import texts as T
from ledgerloom.functions.exprs import MONEY
from ledgerloom.operators import balances, classify, lone, matching, records, refunds
from ledgerloom.operators.stages import Stage, Stages

_PAIR = ["left_raw_id", "right_raw_id"]


def sure_payment(evidence: Column) -> Column:
    """Whether a match's evidence has card and time."""
    return F.contains(evidence, F.lit("bank_suffix_exact")) & F.contains(evidence, F.lit("datetime_"))


def _waiting(rows: DataFrame, ordered: DataFrame) -> DataFrame:
    """The candidate_rows that wait for a decision, with degree. Ordered pairs take all of the shorter side of their group, so no candidate of the group is left open."""
    settled = rows.where("not bank").join(ordered.select(F.col("left_raw_id").alias("raw_id")), "raw_id", "left_semi").select("component", "exact").distinct()
    return lone.with_degrees_of(rows.where("n_rows > 2").join(settled, ["component", "exact"], "left_anti"))


def _sums(raws: DataFrame, taken: DataFrame) -> DataFrame:
    rows = raws.join(taken.select(F.explode(F.array(*_PAIR)).alias("raw_id")), "raw_id", "left_anti").where("coalesce(bank_card_suffix, '') <> ''")
    side = lambda of: rows.where(of).select(F.col("raw_id").alias("row_id"), F.col("bank_card_suffix").alias("account"), F.col("booking_date").alias("day"), "amount")
    return matching.subset_sums(side("source = 'bank'"), side("source <> 'bank'")).where(F.col("unique")).select("bank_id", "payment_ids")


def _canonicals(raws: DataFrame, pairs: DataFrame, sums: DataFrame, waiting: DataFrame) -> DataFrame:
    """Canonical rows of confirmed pairs, of sums, and of rows that are in neither and wait for no decision, with their raw ids and how they came."""
    fields = ["canonical_id", "raw_ids", "transaction_time", "booking_date", "amount", "merchant", "payment_channel", "funding_account", "came"]
    sure = F.lit("1.00").cast("decimal(4,2)")
    by_pair = records.canonical_from_match(pairs.withColumn("confidence", sure), raws).withColumn("came", F.lit("match"))
    by_sum = records.canonical_from_sum(sums, raws).join(sums, "bank_id").withColumns({"canonical_id": F.sha2(F.concat_ws("|", F.lit("sum"), "bank_id"), 256), "raw_ids": F.concat(F.array("bank_id"), "payment_ids"), "came": F.lit("sum")})
    used = pairs.select(F.explode(F.array(*_PAIR)).alias("raw_id")).union(by_sum.select(F.explode("raw_ids"))).union(waiting.select("raw_id"))
    alone = records.canonical_from(raws.join(used.distinct(), "raw_id", "left_anti")).withColumns({"raw_ids": F.array("raw_id"), "came": F.lit("row")})
    made = reduce(DataFrame.unionByName, [x.select(*fields) for x in (by_pair, by_sum, alone)])
    told = made.select("canonical_id", F.explode("raw_ids").alias("raw_id")).join(raws.select("raw_id", "source", "status", "description", "direction"), "raw_id")
    more = told.groupBy("canonical_id").agg(F.max(F.when(F.col("source") != "bank", F.col("status"))).alias("status"), F.array_join(F.array_sort(F.collect_set("description")), " ").alias("notes"), F.min(F.struct(F.col("source") == "bank", "direction")).alias("d"))
    kind = F.when(F.col("d.direction") == "income", "INCOME").when(F.col("d.direction") == "expense", "EXPENSE").otherwise("UNKNOWN")
    return made.join(more, "canonical_id").withColumns({"tx_type": kind, "normalized_merchant": T.party_name(F.col("merchant")), "category": F.lit("")}).drop("d")


def _classes(canonicals: DataFrame, raws: DataFrame) -> DataFrame:
    links = canonicals.select("canonical_id", F.explode("raw_ids").alias("raw_id"))
    marked = records.backed_by_bank(canonicals, links, raws, ["朝朝宝转入", "朝朝宝转出"])
    return classify.propose(marked).select("canonical_id", "proposed_type", "proposed_category", "confidence", "auto_confirmed")


def _refund_sides(canonicals: DataFrame) -> tuple[DataFrame, DataFrame]:
    size = canonicals.select(F.col("canonical_id").alias("row_id"), "merchant", F.col("booking_date").alias("day"), F.abs("amount").alias("amount"), (F.col("amount") > 0).alias("earned"), T.refund_words(T.text("merchant", "status", "notes")).alias("said"))
    return size.where("earned and said").drop("earned", "said"), size.where("not earned").drop("earned", "said")


def _refunds(canonicals: DataFrame) -> DataFrame:
    back, paid = _refund_sides(canonicals)
    at = F.coalesce("transaction_time", F.col("booking_date").cast("timestamp_ntz"))
    no = F.array().cast("array<string>")
    return refunds.assigned_refunds(back, paid, canonicals.select(F.col("canonical_id").alias("row_id"), at.alias("at"), no.alias("orders"), no.alias("ids")))


def _report(parts: dict[str, DataFrame]) -> DataFrame:
    """(measure, value): counts and sums of all passes, as whole numbers or texts of money."""
    count = lambda name, rows: rows.agg(F.lit(name).alias("measure"), F.count("*").cast("string").alias("value"))
    out = [count(f"{n}_count", parts[n]) for n in ("exact_payment_match", "unique_statement_match", "ordered_statement_match", "aggregate_match", "raw", "canonical")]
    waiting = F.coalesce(F.sum(F.when(~F.col("bank"), F.col("degree"))), F.lit(0))
    out.append(parts["pending_match_candidate"].agg(F.lit("pending_match_candidate_count").alias("measure"), waiting.cast("string").alias("value")))
    out += [count("safe_confirmed_review_count", parts["canonical"].where("came = 'row'")), count("safe_classification_count", parts["classes"].where("auto_confirmed")), count("safe_refund_count", parts["refunds"]), count("refund_warning_count", parts["refunds"].where("warning"))]
    money = lambda name, rows, c: rows.agg(F.lit(name).alias("measure"), F.coalesce(F.sum(c), F.lit(0)).cast(MONEY).cast("string").alias("value"))
    c = parts["canonical"]
    out += [money("gross_expense", c.where("tx_type = 'EXPENSE'"), F.abs("amount")), money("income", c.where("tx_type = 'INCOME'"), F.col("amount")), money("bank_cash", parts["cash"], F.col("balance")), count("balance_break_count", parts["chain"].where("status = 'break'"))]
    return reduce(DataFrame.unionByName, out)


def accept(stages: Stages, raws: DataFrame) -> dict[str, Stage]:
    """All stages of one run over raw rows, the report among them. Candidates are computed once; a second run over the same rows computes nothing.

    Exact payment matches come first, then unique statement matches; both are candidates alone at both ends, which no other candidate depends on. Ordered ones are judged on the
    candidates that are left; sums are sought among rows in no pair; rows that wait for no candidate are confirmed as they are. Candidates, of which there may be far more than
    rows, are kept as the rows they are made of, and those that wait are counted at their ends.
    """
    run, raw = stages.run, stages.given("raw", raws)
    sides = lambda r: (r.where("source <> 'bank'"), r.where("source = 'bank'"))
    candidates = run("candidates", lambda r: lone.candidate_rows(*sides(r)), raw, version="2", view=lone.candidates_of)
    exact = run("exact_payment_match", lambda c: lone.lone_of(c).where(sure_payment(F.col("evidence"))).select(*_PAIR), candidates)
    unique = run("unique_statement_match", lambda c: lone.lone_of(c).where(~sure_payment(F.col("evidence"))).select(*_PAIR), candidates)
    both = run("first_matches", DataFrame.unionByName, exact, unique)
    ordered = run("ordered_statement_match", lambda c, r: lone.ordered_of(c, *sides(r)).select(*_PAIR), candidates, raw)
    pairs = run("matches", DataFrame.unionByName, both, ordered)
    sums = run("aggregate_match", _sums, raw, pairs)
    waiting = run("pending_match_candidate", _waiting, candidates, ordered, version="2", view=lambda rows: lone.candidates_of(rows).select(*_PAIR))
    canonical = run("canonical", _canonicals, raw, pairs, sums, waiting)
    classes = run("classes", _classes, canonical, raw)
    returned = run("refunds", _refunds, canonical)
    cash = run("cash", records.bank_cash, raw)
    chain = run("chain", lambda r: balances.balance_chain(r.where("source = 'bank' and balance is not null").select(F.col("source_account").alias("account"), F.coalesce("transaction_time", F.col("booking_date").cast("timestamp_ntz")).alias("ts"), F.col("raw_id").alias("row_id"), "amount", "balance")).select("account", "row_id", "status"), raw)
    all_ = {s.name: s for s in (raw, candidates, exact, unique, ordered, sums, waiting, canonical, classes, returned, cash, chain)}
    return all_ | {"report": run("report", lambda *rows: _report(dict(zip(all_, rows, strict=True))), *all_.values())}
