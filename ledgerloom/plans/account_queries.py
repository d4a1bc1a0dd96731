"""Registered queries on accounts of entries, decisions on doubtful refunds, balance anchors and found files, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import accounts as A
from ledgerloom.functions.texts import text
from ledgerloom.operators import warnings
from ledgerloom.operators.durable import shared_folder
from ledgerloom.plans.record_queries import _any, _cases
from ledgerloom.plans.registry import Registry
from ledgerloom.plans.store import ctes, load
from ledgerloom.sources import discovery

query = Registry()
#: Accounts and expense keywords as a user would give them.
WALLETS = {"alipay": "Assets:Wallet:Alipay", "wechat": "Assets:Wallet:WeChat", "bank": "Assets:Current:Bank"}
EXPENSES = [("星巴克", "Expenses:Food:Coffee"), ("KFC", "Expenses:Food:Restaurant"), ("超市", "Expenses:Food:Groceries"), ("打车", "Expenses:Transport:Taxi"), ("美团", "Expenses:Food:Delivery"), ("书店", "Expenses:Education:Books")]

_SAID = "lower(concat_ws(' ', coalesce(counterparty, ''), coalesce(description, '')))"
_KIND = "CASE direction WHEN 'neutral' THEN '' ELSE direction END"


def _code(c: str) -> str:
    return _cases([(f"contains({c}, '{name}')", f"'{code}'") for name, code in A.BANK_CODES], "NULL")


def _first(rules: list[tuple[str, str]], default: str) -> str:
    return _cases([(f"contains(said, '{k.lower()}')", f"'{a}'") for k, a in rules], f"'{default}'")


_OTHER = _cases(
    [
        (f"kind = 'expense' OR (kind = '' AND {_any('said', A.LIKELY_EXPENSE)})", _first(EXPENSES, "Expenses:Unknown")),
        (f"kind = 'income' OR {_any('said', A.LIKELY_INCOME)}", _first(A.INCOME_RULES, "Income:Other")),
        (_any("said", A.LIKELY_EXPENSE), "'Expenses:Unknown'"),
    ],
    "'Income:Unknown'",
)
_TAGS = ", ".join("CASE WHEN " + " OR ".join([*(f"contains(coalesce(counterparty, ''), '{w}')" for w in own), *(f"contains(said, '{w}')" for w in words)]) + f" THEN '{tag}' END" for tag, own, words in A.TAG_WORDS)


@query("entry_accounts", f"""WITH {ctes('raws')}, t AS (SELECT *, {_SAID} AS said, {_KIND} AS kind FROM raws), o AS (SELECT *, {_OTHER} AS opposing FROM t)
SELECT raw_id, {_cases([("source = 'bank'", f"coalesce('Assets:Current:Bank:' || {_code('counterparty')}, 'Assets:Current:Bank')"), *[(f"source = '{k}'", f"'{a}'") for k, a in WALLETS.items() if k != 'bank']], "'Assets:Current:Cash'")} AS asset, opposing,
  split_part(opposing, ':', 2) AS category, array_to_string(list_filter([{_TAGS}], lambda x: x IS NOT NULL), ',') AS tags FROM o""")
def entry_accounts(spark, d):
    party, about = F.col("counterparty"), F.col("description")
    kind = F.when(F.col("direction") == "neutral", "").otherwise(F.col("direction"))
    rows = load(spark, d, "raws").select("raw_id", A.asset_account(F.col("source"), party, WALLETS).alias("asset"), A.opposing_account(party, about, kind, EXPENSES).alias("opposing"), A.account_tags(party, about).alias("tags"))
    return rows.select("raw_id", "asset", "opposing", A.account_part(F.col("opposing")).alias("category"), F.array_join("tags", ",").alias("tags"))


@query("plain_accounts", f"""WITH {ctes('raws')}, t AS (SELECT *, {_SAID} AS said FROM raws)
SELECT raw_id, {_cases([("source = 'bank'", f"coalesce('Assets:Bank:' || {_code('payment_method')}, 'Assets:Current:Bank')"), *[(f"source = '{k}'", f"'{a}'") for k, a in WALLETS.items() if k != 'bank']], "'Assets:Unknown'")} AS asset,
  {_cases([(_any('said', words), f"'{c}'") for c, words in A.CATEGORY_WORDS], "'unknown'")} AS category FROM t""")
def plain_accounts(spark, d):
    rows = load(spark, d, "raws")
    return rows.select("raw_id", A.plain_asset_account(F.col("source"), F.col("payment_method"), WALLETS).alias("asset"), A.word_category(F.col("counterparty"), F.col("description")).alias("category"))


_BATCH = """w0 AS (SELECT *, CAST(relationship_id[2:] AS BIGINT) AS k FROM relationships),
rel AS (SELECT * REPLACE ('C' || (k // 40) AS from_id) FROM w0),
att AS (SELECT *, CASE WHEN status = 'pending' THEN 'required' WHEN status = 'confirmed' AND (is_ambiguous OR is_partial) AND acknowledged THEN 'acknowledged' WHEN status = 'confirmed' AND (is_ambiguous OR is_partial) THEN 'warning' ELSE 'settled' END AS queue FROM rel),
said AS (SELECT relationship_id, ['acknowledge', 'escalate', 'restore', 'drop'][1 + k // 16 % 4] AS decision, 'a' || (k % 3) AS actor FROM rel WHERE k % 16 = 1 UNION ALL SELECT 'R0', 'escalate', 'a0'
  UNION ALL SELECT relationship_id, 'restore', 'a1' FROM rel WHERE k % 400 = 1),
ev0 AS (SELECT s.relationship_id, actor, decision, queue, count(*) OVER (PARTITION BY s.relationship_id) AS n FROM said s LEFT JOIN att USING (relationship_id)),
ev1 AS (SELECT *, CASE WHEN decision = 'drop' THEN 'unknown decision' WHEN n > 1 THEN 'decided twice' WHEN queue IS NULL THEN 'unknown relationship' WHEN decision = 'restore' AND queue <> 'acknowledged' THEN 'not in queue acknowledged'
  WHEN decision <> 'restore' AND queue <> 'warning' THEN 'not in queue warning' END AS fault FROM ev0),
ev AS (SELECT relationship_id, actor, CASE decision WHEN 'acknowledge' THEN 'warning_acknowledged' WHEN 'escalate' THEN 'warning_escalated' WHEN 'restore' THEN 'warning_restored' END AS action, queue AS before,
  CASE WHEN fault IS NOT NULL THEN queue WHEN decision = 'acknowledge' THEN 'acknowledged' WHEN decision = 'escalate' THEN 'required' ELSE 'warning' END AS after, fault FROM ev1)"""


def _batch(spark, d):
    k = F.substring("relationship_id", 2, 20).cast("long")
    rows = load(spark, d, "relationships").withColumn("from_id", F.concat(F.lit("C"), F.floor(k / 40).cast("string")))
    decision = F.get(F.array(*map(F.lit, ("acknowledge", "escalate", "restore", "drop"))), (F.floor(k / 16) % 4).cast("int"))
    made = rows.where(k % 16 == 1).select("relationship_id", decision.alias("decision"), F.concat(F.lit("a"), (k % 3).cast("string")).alias("actor"))
    again = rows.where(k % 400 == 1).select("relationship_id", F.lit("restore").alias("decision"), F.lit("a1").alias("actor"))
    lost = spark.range(1).select(F.lit("R0").alias("relationship_id"), F.lit("escalate").alias("decision"), F.lit("a0").alias("actor"))
    return rows, warnings.warning_events(rows, made.unionByName(again).unionByName(lost))


@query("warning_events", f"WITH {ctes('relationships')}, {_BATCH} SELECT * FROM ev")
def warning_events(spark, d):
    return _batch(spark, d)[1]


@query("after_warnings", f"""WITH {ctes('relationships')}, {_BATCH}, re AS (SELECT DISTINCT from_id FROM ev JOIN rel USING (relationship_id) WHERE fault IS NULL AND action = 'warning_escalated')
SELECT relationship_id, from_id, CASE WHEN from_id IN (SELECT from_id FROM re) AND status IN ('confirmed', 'superseded') THEN 'pending' ELSE status END AS status,
  CASE WHEN relationship_id IN (SELECT relationship_id FROM ev WHERE fault IS NULL AND action = 'warning_acknowledged') THEN true WHEN relationship_id IN (SELECT relationship_id FROM ev WHERE fault IS NULL AND action = 'warning_restored') THEN false ELSE acknowledged END AS acknowledged FROM rel""")
def after_warnings(spark, d):
    rows, events = _batch(spark, d)
    return warnings.after_warnings(rows, events).select("relationship_id", "from_id", "status", "acknowledged")


@query("checked_snapshots", f"""WITH {ctes('snapshots')}, t AS (SELECT seq, lower(source) AS source, CASE WHEN seq % 7 = 0 THEN '' ELSE source_account END AS source_account, CASE WHEN seq % 13 = 0 THEN NULL ELSE balance END AS balance,
  CASE WHEN seq % 11 = 0 THEN 'loan' ELSE balance_kind END AS balance_kind, as_of, CASE WHEN seq % 17 = 0 THEN '' ELSE 'me' END AS created_by, '' AS note FROM snapshots)
SELECT *, CASE WHEN source_account = '' THEN 'no source_account' WHEN created_by = '' THEN 'no created_by' WHEN balance_kind = 'loan' THEN 'unknown kind' WHEN balance IS NULL THEN 'no finite balance' END AS fault FROM t""")
def checked_snapshots(spark, d):
    seq = F.col("seq")
    rows = load(spark, d, "snapshots").select(
        "seq", F.concat(F.lit(" "), F.upper("source")).alias("source"), F.when(seq % 7 == 0, "  ").otherwise(F.concat("source_account", F.lit(" "))).alias("source_account"),
        F.when(seq % 13 == 0, "NaN").otherwise(F.col("balance").cast("string")).alias("balance"), F.when(seq % 11 == 0, "loan").otherwise(F.initcap("balance_kind")).alias("balance_kind"), "as_of",
        F.when(seq % 17 != 0, "me").alias("created_by"), F.lit(" ").alias("note"),
    )
    return warnings.checked_snapshots(rows)


@query("found_files", f"WITH {ctes('raws')} SELECT DISTINCT 'account=' || source AS folder, '.txt' AS suffix, CASE source WHEN 'alipay' THEN 'alipay.csv' WHEN 'bank' THEN 'cmb.pdf' END AS format, CASE WHEN source NOT IN ('alipay', 'bank') THEN '{discovery.REASONS['other']}' END AS reason FROM raws")
def found_files(spark, d):
    path = f"{shared_folder(spark)}/found-{uuid.uuid4().hex}"
    rows = load(spark, d, "raws").select(F.col("source").alias("account"), text("raw_id", "description").alias("line"))
    rows.write.partitionBy("account").text(path)  # a file of each task, as only the folders are told
    return discovery.discover(spark, path, {("account=alipay", ".txt"): "alipay.csv", ("account=bank", ".txt"): "cmb.pdf"}).select("folder", "suffix", "format", "reason").distinct()
