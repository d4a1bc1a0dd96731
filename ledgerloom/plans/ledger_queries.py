"""Registered ledger queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import balances, classify, dedup, intervals, statistics
from ledgerloom.plans import bridge as B
from ledgerloom.plans.registry import Registry

query = Registry()


_CHAIN = f"""WITH {B.STATEMENT},
ch AS (SELECT *, lag(balance) OVER (PARTITION BY account ORDER BY ts, row_id) AS previous FROM st),
bc AS (SELECT account, row_id, ts, kind, amount, balance, previous, (previous + amount)::DECIMAL(18,2) AS expected,
  CASE WHEN previous IS NULL THEN 'opening' WHEN previous + amount = balance THEN 'ok' ELSE 'break' END AS status FROM ch)
"""


@query("balance_chain", _CHAIN + "SELECT * FROM bc")
def balance_chain(spark, d):
    return balances.balance_chain(B.statement(spark, d)).select("account", "row_id", "ts", "kind", "amount", "balance", "previous", "expected", "status")


@query("balance_chain_summary", _CHAIN + "SELECT account, count(*) AS n_rows, count(*) FILTER (status = 'break') AS n_breaks, arg_min(balance, (ts, row_id)) AS opening, arg_max(balance, (ts, row_id)) AS closing FROM bc GROUP BY account")
def balance_chain_summary(spark, d):
    return balances.chain_summary(balances.balance_chain(B.statement(spark, d)))


@query("first_break", _CHAIN + "SELECT account, row_id, ts, expected, balance FROM bc WHERE status = 'break' QUALIFY row_number() OVER (PARTITION BY account ORDER BY ts, row_id) = 1")
def first_break(spark, d):
    return balances.first_break(balances.balance_chain(B.statement(spark, d)))


@query("repaired_chain", _CHAIN + """SELECT account, ts, row_id, 1 AS part, CASE WHEN previous IS NULL THEN balance ELSE amount END AS amount, balance,
CASE WHEN previous IS NULL THEN 'anchor' ELSE 'observed' END AS nature, CASE WHEN balance < expected THEN balance - expected END::DECIMAL(18,2) AS unexplained FROM bc
UNION ALL SELECT account, ts, row_id, 0, (balance - expected)::DECIMAL(18,2), (previous + balance - expected)::DECIMAL(18,2), 'inferred', NULL FROM bc WHERE balance > expected""")
def repaired_chain(spark, d):
    return balances.repaired_chain(B.statement(spark, d), F.col("gap") > 0)


@query("latest_balance", f"WITH {B.STATEMENT} SELECT account, row_id, ts, balance FROM st QUALIFY row_number() OVER (PARTITION BY account ORDER BY ts DESC, row_id DESC) = 1")
def latest_balance(spark, d):
    return balances.latest_balance(B.statement(spark, d))


@query("wallet_projection", f"WITH {B.STATEMENT} SELECT account, row_id, (100 + sum(amount) OVER (PARTITION BY account ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING))::DECIMAL(18,2) AS projected FROM st WHERE kind <> 'error'")
def wallet_projection(spark, d):
    return balances.wallet_projection(B.statement(spark, d).where("kind <> 'error'"), 100).select("account", "row_id", "projected")


@query("forward_fill", f"WITH {B.STATEMENT} SELECT account, row_id, last_value(CASE WHEN kind = 'purchase' THEN amount END IGNORE NULLS) OVER (PARTITION BY account ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) AS filled FROM st")
def forward_fill(spark, d):
    rows = B.statement(spark, d).withColumn("filled", F.when(F.col("kind") == "purchase", F.col("amount")))
    return balances.forward_fill(rows, "filled").select("account", "row_id", "filled")


_SUMS = """coalesce(sum(abs(amount)) FILTER (kind = 'EXPENSE'), 0)::DECIMAL(18,2) AS gross_expense, coalesce(sum(abs(amount)) FILTER (kind = 'INCOME'), 0)::DECIMAL(18,2) AS income,
  coalesce(sum(abs(amount)) FILTER (kind = 'REFUND'), 0)::DECIMAL(18,2) AS refunds, count(*) AS n_rows"""
_NET = "*, (gross_expense - refunds)::DECIMAL(18,2) AS net_expense, (income + refunds - gross_expense)::DECIMAL(18,2) AS net_flow"


@query("summary_stats", f"WITH {B.LEDGER}, s AS (SELECT {_SUMS} FROM lg) SELECT {_NET} FROM s")
def summary_stats(spark, d):
    return statistics.summary(B.ledger(spark, d))


@query("category_stats", f"""WITH {B.LEDGER}, s AS (SELECT CASE WHEN trim(coalesce(category, '')) = '' THEN 'uncategorised' ELSE category END AS category,
  coalesce(sum(abs(amount)) FILTER (kind = 'EXPENSE'), 0)::DECIMAL(18,2) AS expense, coalesce(sum(abs(amount)) FILTER (kind = 'REFUND'), 0)::DECIMAL(18,2) AS refunds FROM lg WHERE kind <> 'INCOME' GROUP BY 1)
  SELECT *, (expense - refunds)::DECIMAL(18,2) AS net FROM s""")
def category_stats(spark, d):
    return statistics.categories(B.ledger(spark, d))


def _timeline(period):
    def run(spark, d):
        return statistics.timeline(B.ledger(spark, d), period)

    return run


for _p in ("day", "week", "month", "year"):
    query(f"timeline_{_p}", f"WITH {B.LEDGER}, s AS (SELECT date_trunc('{_p}', ts)::DATE AS period, {_SUMS} FROM lg GROUP BY 1) SELECT {_NET} FROM s")(_timeline(_p))


@query("source_facets", f"WITH {B.LEDGER} SELECT source, count(DISTINCT row_id) AS n_rows FROM lg GROUP BY source")
def source_facets(spark, d):
    return statistics.facets(B.ledger(spark, d))


@query("transaction_page", f"WITH {B.LEDGER} SELECT * FROM lg ORDER BY ts DESC NULLS LAST, row_id LIMIT 30 OFFSET 30")
def transaction_page(spark, d):
    return statistics.page(B.ledger(spark, d), 2, 30)


@query("transaction_search", f"WITH {B.LEDGER} SELECT * FROM lg WHERE category ILIKE '%urgent%' AND kind = 'EXPENSE' AND source = 'bank' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01'")
def transaction_search(spark, d):
    return statistics.search(B.ledger(spark, d), "urgent", "EXPENSE", "bank", "1996-01-01", "1998-12-31")


@query("collisions", f"WITH {B.OBSERVATIONS} SELECT source, ts::DATE AS day, amount, count(*) AS n_rows, count(DISTINCT party) <= 1 AS same_party FROM obs GROUP BY ALL HAVING count(*) > 1")
def collisions(spark, d):
    return statistics.collisions(B.observations(spark, d).withColumn("day", F.col("ts").cast("date")), ["source", "day", "amount"], "party")


_PRINTS = f"""WITH {B.OBSERVATIONS},
fp AS (SELECT raw_id, source, ts, floor(abs(amount) * 100)::BIGINT AS cents, party, CASE WHEN amount < 0 THEN 'OUT' ELSE 'IN' END AS dir,
  CASE WHEN source = 'bank' AND hour(ts) < 2 THEN [ts::DATE, ts::DATE - 1] ELSE [ts::DATE] END AS days FROM obs),
l1 AS (SELECT raw_id, source, ts, md5(strftime(unnest(days), '%Y-%m-%d') || '|' || cents || '|' || party || '|' || dir) AS h FROM fp),
l2 AS (SELECT raw_id, source, ts, md5(strftime(unnest(days), '%Y-%m-%d') || '|' || cents || '|' || dir) AS h FROM fp),
p1 AS (SELECT DISTINCT a.raw_id AS left_raw_id, b.raw_id AS right_raw_id FROM l1 a JOIN l1 b USING (h) WHERE a.raw_id < b.raw_id AND a.source <> b.source AND abs(epoch(a.ts) - epoch(b.ts)) <= 120),
p2 AS (SELECT DISTINCT a.raw_id AS left_raw_id, b.raw_id AS right_raw_id FROM l2 a JOIN l2 b USING (h) WHERE a.raw_id < b.raw_id AND a.source <> b.source AND abs(epoch(a.ts) - epoch(b.ts)) <= 120)
"""


@query("fingerprints", _PRINTS + "SELECT raw_id, cents, md5(strftime(ts::DATE, '%Y-%m-%d') || '|' || cents || '|' || party || '|' || dir) AS l1, md5(strftime(ts::DATE, '%Y-%m-%d') || '|' || cents || '|' || dir) AS l2, len(days)::INT AS n_days FROM fp")
def fingerprints(spark, d):
    return dedup.fingerprints(B.observations(spark, d)).select("raw_id", "cents", "l1", "l2", F.size("l1_all").alias("n_days"))


@query("l1_pairs", _PRINTS + "SELECT * FROM p1")
def l1_pairs(spark, d):
    return dedup.l1_pairs(dedup.fingerprints(B.observations(spark, d)))


@query("l2_pairs", _PRINTS + "SELECT * FROM p2")
def l2_pairs(spark, d):
    return dedup.l2_pairs(dedup.fingerprints(B.observations(spark, d)))


@query("l3_best", _PRINTS + """, l3 AS (SELECT raw_id, cents, epoch(ts)::BIGINT AS s FROM fp)
SELECT a.raw_id, b.raw_id AS other_id, abs(a.s - b.s) AS seconds, abs(a.cents - b.cents) AS cents_off FROM l3 a JOIN l3 b ON a.raw_id <> b.raw_id AND abs(a.s - b.s) <= 86400 AND abs(a.cents - b.cents) <= 100
QUALIFY row_number() OVER (PARTITION BY a.raw_id ORDER BY abs(a.s - b.s), abs(a.cents - b.cents), b.raw_id) = 1""")
def l3_best(spark, d):
    return dedup.l3_best(dedup.fingerprints(B.observations(spark, d)))


@query("dedup_report", _PRINTS + """, k AS (SELECT * FROM (VALUES ('alipay', 3), ('wechat', 2), ('bank', 1)) v(source, p)),
lost AS (SELECT DISTINCT CASE WHEN ka.p >= kb.p THEN right_raw_id ELSE left_raw_id END AS raw_id FROM p1 JOIN fp a ON a.raw_id = left_raw_id JOIN fp b ON b.raw_id = right_raw_id JOIN k ka ON ka.source = a.source JOIN k kb ON kb.source = b.source)
SELECT fp.source, count(*) AS n_rows, count(lost.raw_id) AS n_duplicates, count(*) - count(lost.raw_id) AS n_unique FROM fp LEFT JOIN lost USING (raw_id) GROUP BY fp.source""")
def dedup_report(spark, d):
    prints = dedup.fingerprints(B.observations(spark, d))
    return dedup.dedup_report(prints, dedup.l1_pairs(prints))


@query("occurrence_numbers", f"WITH {B.OBSERVATIONS}, n AS (SELECT raw_id, row_number() OVER (PARTITION BY source, ts::DATE, amount, party ORDER BY raw_id) AS r FROM obs) SELECT raw_id, CASE WHEN r > 1 THEN r END::INT AS occurrence FROM n")
def occurrence_numbers(spark, d):
    rows = B.observations(spark, d).withColumn("day", F.col("ts").cast("date"))
    return dedup.occurrence_numbers(rows, ["source", "day", "amount", "party"], "raw_id").select("raw_id", "occurrence")


@query("exact_text_groups", "SELECT md5(lower(text)) AS fingerprint, min(doc_id) AS first_id, count(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_text_groups(spark, d):
    docs = B.table(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.md5(F.lower("text")).alias("fingerprint")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")).where("n_rows > 1")


@query("json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_field(spark, d):
    return B.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("dedup_keys", f"WITH {B.STATEMENT} SELECT row_id, sha256(concat_ws('|', 'bank', account, strftime(ts, '%Y-%m-%d %H:%M:%S'), amount, balance)) AS key FROM st")
def dedup_keys(spark, d):
    parts = [F.lit("bank"), F.col("account").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("amount").cast("string"), F.col("balance").cast("string")]
    return B.statement(spark, d).select("row_id", F.sha2(F.concat_ws("|", *parts), 256).alias("key"))


@query("export_lines", f"""WITH {B.LEDGER} SELECT row_id, strftime(ts, '%Y-%m-%d') || ' * "' || CASE WHEN trim(category) = '' THEN 'Unknown' ELSE category END || '"' AS header,
  '  Assets:' || upper(source[1:1]) || source[2:] || '  ' || amount || ' CNY' AS leg, '  ' || CASE kind WHEN 'INCOME' THEN 'Income' ELSE 'Expenses' END || ':Unclassified  ' || -amount || ' CNY' AS other FROM lg""")
def export_lines(spark, d):
    return classify.entry_lines(B.ledger(spark, d))


@query("classification", """SELECT event_id AS row_id, CASE WHEN props LIKE '%1}' THEN 'INVESTMENT' WHEN event_type = 'error' THEN 'TRANSFER' WHEN props LIKE '%2}' AND value < 100 THEN 'CREDIT_REPAYMENT' ELSE 'NONE' END AS proposed,
  CASE WHEN props LIKE '%1}' THEN 0.98 WHEN event_type = 'error' THEN 0.96 WHEN props LIKE '%2}' AND value < 100 THEN 0.80 ELSE 0 END::DECIMAL(4,2) AS confidence,
  CASE WHEN props LIKE '%1}' OR event_type = 'error' THEN true ELSE false END AS auto_confirmed FROM events""")
def classification(spark, d):
    rules = [("INVESTMENT", F.col("props").endswith("1}"), "0.98"), ("TRANSFER", F.col("event_type") == "error", "0.96"), ("CREDIT_REPAYMENT", F.col("props").endswith("2}") & (F.col("value") < 100), "0.80")]
    return classify.classify(B.table(spark, d, "events").withColumnRenamed("event_id", "row_id"), rules).select("row_id", "proposed", "confidence", "auto_confirmed")


@query("import_coverage", f"""WITH {B.STATEMENT}, seen AS (SELECT * FROM st WHERE row_id % 3 <> 0), r AS (SELECT account, min(ts::DATE) AS a, max(ts::DATE) AS z FROM seen GROUP BY account)
SELECT st.account, count(*) AS n_missing FROM st JOIN r ON st.account = r.account AND st.ts::DATE BETWEEN a AND z WHERE st.row_id % 3 = 0 GROUP BY st.account""")
def import_coverage(spark, d):
    rows = B.statement(spark, d)
    return classify.missing_from_import(rows, rows.where("row_id % 3 <> 0"))


@query("parsed_amounts", """SELECT event_id AS row_id, (CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END)::DECIMAL(18,2) AS amount FROM events""")
def parsed_amounts(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat(F.lit("¥ +"), F.format_number("value", 2)))
    return B.table(spark, d, "events").select(F.col("event_id").alias("row_id"), X.clean_amount(text).alias("amount"))


_INTERVAL_COLUMNS = "account, row_id, ts, amount, balance, previous, canonical_id, canonical_amount, source_difference, canonical_difference, reasons, status"


@query("interval_reconciliation", f"WITH {B.INTERVALS} SELECT {_INTERVAL_COLUMNS} FROM iv")
def interval_reconciliation(spark, d):
    rows = B.statement(spark, d)
    return intervals.interval_reconciliation(rows, B.canonical_sides(rows)).select(*_INTERVAL_COLUMNS.split(", "))


@query("interval_summary", f"""WITH {B.INTERVALS} SELECT account, count(*) AS n_rows, count(*) FILTER (status <> 'ok') AS n_failures,
  arg_min(row_id, (ts, row_id)) FILTER (status <> 'ok') AS first_failure, arg_min(status, (ts, row_id)) FILTER (status <> 'ok') AS first_status FROM iv GROUP BY account""")
def interval_summary(spark, d):
    rows = B.statement(spark, d)
    return intervals.interval_summary(intervals.interval_reconciliation(rows, B.canonical_sides(rows)))


@query("roll_forward", f"""WITH {B.ROLL}, ad AS (SELECT lt.suffix, sum(obs.amount) AS adj, max(obs.ts::DATE) AS till FROM lt JOIN obs ON obs.suffix = lt.suffix AND source <> 'bank' AND obs.ts::DATE > lt.day GROUP BY lt.suffix)
SELECT suffix, balance AS statement_balance, coalesce(adj, 0)::DECIMAL(18,2) AS pending_adjustment, (balance + coalesce(adj, 0))::DECIMAL(18,2) AS balance, coalesce(till, day) AS as_of FROM lt LEFT JOIN ad USING (suffix)""")
def roll_forward(spark, d):
    return intervals.roll_forward(*B.roll_sides(spark, d))
