"""Registered queries of matching, sums, refunds, the engine, reports and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as L
from ledgerloom.operators import engine, exports, lone, matching, refunds, statistics
from ledgerloom.plans import bridge as B
from ledgerloom.plans import record_queries as R
from ledgerloom.plans.registry import Registry
from ledgerloom.plans.store import ctes, load

query = Registry()
_any, _cases = R._any, R._cases

_FEATURES = f"""ft0 AS (SELECT *, lower({R._SAID}) AS low, {R._CORE} AS core FROM raws),
ft AS (SELECT raw_id, source, amount, booking_date, direction, epoch(transaction_time) AS secs, coalesce(bank_card_suffix, '') AS suffix, balance IS NOT NULL AS anchored,
  list_filter([{', '.join(f"CASE WHEN {_any('lower(payment_method)', w)} THEN '{k}' END" for k, w in L.BANK_FAMILIES.items())}], lambda x: x IS NOT NULL) AS fam,
  list_distinct(list_concat(list_filter([{', '.join(f"CASE WHEN {_any('low', w)} THEN '{k}' END" for k, w in L.MERCHANT_ALIASES.items())}], lambda x: x IS NOT NULL), list_transform(range(1, length(core)), lambda i: core[i:i+1]))) AS tok,
  {_any("lower(concat_ws(' ', low, status))", L.REFUND_WORDS)} AS refund, {_cases([(_any('low', w), f"'{r}'") for r, w in L.RAILS], 'NULL')} AS rail, {_any("lower(concat_ws(' ', description, counterparty))", L.INTERNAL_PRODUCTS)} AS product FROM ft0)"""
_MATCH = f"""WITH {ctes('raws')}, {_FEATURES},
m0 AS (SELECT p.raw_id AS l, b.raw_id AS r, p.booking_date = b.booking_date AS same, p.amount > 0 AND p.direction IN ('neutral', 'income') AND b.direction = 'income' AND p.refund AND b.refund AS pair,
    p.booking_date = b.booking_date AND p.amount > 0 AND b.direction = 'income' AND b.anchored AND p.refund AS anch, p.direction = b.direction AS dir, p.suffix AS ps, p.suffix <> '' AND p.suffix = b.suffix AS suf, list_has_any(p.fam, b.fam) AS bank,
    b.rail IS NOT NULL AS rail, list_has_any(p.tok, b.tok) AS mer, coalesce(abs(p.secs - b.secs) <= 5, false) AS t5, coalesce(abs(p.secs - b.secs) > 5 AND abs(p.secs - b.secs) <= 120, false) AS t120, b.secs IS NULL AS tn
  FROM ft p JOIN ft b ON p.source <> 'bank' AND b.source = 'bank' AND p.amount = b.amount AND abs(date_diff('day', p.booking_date, b.booking_date)) <= 1 AND NOT b.product AND (b.rail IS NULL OR b.rail = p.source)),
m1 AS (SELECT *, same AND (suf OR bank) AND (t5 OR mer OR rail) AS ex FROM m0 WHERE (dir OR pair OR anch) AND (ps <> '' OR bank) AND (same OR mer OR rail) AND (suf OR bank OR t5 OR t120 OR mer)),
mc AS (SELECT l AS left_raw_id, r AS right_raw_id, CASE WHEN ex THEN 'exact' ELSE 'fuzzy' END AS phase,
  least(0.35 + CASE WHEN same THEN 0.15 ELSE 0.05 END + CASE WHEN suf THEN 0.25 ELSE 0 END + CASE WHEN bank THEN 0.10 ELSE 0 END + CASE WHEN rail THEN 0.10 ELSE 0 END + CASE WHEN t5 THEN 0.20 WHEN t120 THEN 0.12 ELSE 0 END + CASE WHEN mer THEN 0.10 ELSE 0 END, 0.99)::DECIMAL(4,2) AS confidence,
  concat_ws(',', 'amount_exact', CASE WHEN pair THEN 'refund_credit_direction' WHEN anch THEN 'anchored_refund_credit' ELSE 'direction_exact' END, CASE WHEN same THEN 'booking_date_exact' ELSE 'booking_date_adjacent' END, CASE WHEN suf THEN 'bank_suffix_exact' END,
    CASE WHEN bank THEN 'bank_name_exact' END, CASE WHEN rail THEN 'payment_rail_exact' END, CASE WHEN t5 THEN 'datetime_exact' WHEN t120 THEN 'datetime_close' WHEN tn THEN 'bank_time_unavailable' END, CASE WHEN mer THEN 'merchant_semantic_match' END, CASE WHEN ex THEN 'match_phase_exact' ELSE 'match_phase_fuzzy' END) AS evidence FROM m1),
ex AS (SELECT * FROM mc WHERE phase = 'exact'),
sp AS (SELECT * FROM ex UNION ALL SELECT * FROM mc WHERE phase = 'fuzzy' AND left_raw_id NOT IN (SELECT left_raw_id FROM ex) AND right_raw_id NOT IN (SELECT right_raw_id FROM ex)),
dg AS (SELECT *, count(*) OVER (PARTITION BY left_raw_id) AS left_degree, count(*) OVER (PARTITION BY right_raw_id) AS right_degree FROM sp)
"""


def _match_sides(spark, d):
    rows = load(spark, d, "raws")
    return rows.where("source <> 'bank'"), rows.where("source = 'bank'")


@query("match_candidates", _MATCH + "SELECT * FROM mc")
def match_candidates(spark, d):
    return matching.match_candidates(*_match_sides(spark, d))


@query("exact_suppression", _MATCH + "SELECT * FROM sp")
def exact_suppression(spark, d):
    return lone.suppressed_candidates(*_match_sides(spark, d))


@query("ambiguity", _MATCH + "SELECT left_raw_id, right_raw_id, left_degree, right_degree, left_degree > 1 OR right_degree > 1 AS ambiguous FROM dg")
def ambiguity(spark, d):
    return lone.suppressed_with_degrees(*_match_sides(spark, d)).select("left_raw_id", "right_raw_id", "left_degree", "right_degree", "ambiguous")


@query("unique_matches", _MATCH + "SELECT left_raw_id, right_raw_id, phase, confidence, evidence FROM dg WHERE left_degree = 1 AND right_degree = 1")
def unique_matches(spark, d):
    return lone.lone_matches(*_match_sides(spark, d))


@query("exact_payment_matches", _MATCH + "SELECT left_raw_id, right_raw_id FROM dg WHERE left_degree = 1 AND right_degree = 1 AND contains(evidence, 'bank_suffix_exact') AND contains(evidence, 'datetime_')")
def exact_payment_matches(spark, d):
    sure = F.contains("evidence", F.lit("bank_suffix_exact")) & F.contains("evidence", F.lit("datetime_"))
    return unique_matches(spark, d).where(sure).select("left_raw_id", "right_raw_id")


@query("competing_candidates", _MATCH + "SELECT c.left_raw_id, c.right_raw_id FROM mc c JOIN ex x ON c.left_raw_id = x.left_raw_id AND c.right_raw_id <> x.right_raw_id UNION SELECT c.left_raw_id, c.right_raw_id FROM mc c JOIN ex x ON c.right_raw_id = x.right_raw_id AND c.left_raw_id <> x.left_raw_id")
def competing_candidates(spark, d):
    return lone.competing_exact(*_match_sides(spark, d))


@query("unlinked_raw", _MATCH + "SELECT raw_id, source FROM raws WHERE raw_id NOT IN (SELECT left_raw_id FROM dg WHERE left_degree = 1 AND right_degree = 1) AND raw_id NOT IN (SELECT right_raw_id FROM dg WHERE left_degree = 1 AND right_degree = 1)")
def unlinked_raw(spark, d):
    return matching.unlinked(load(spark, d, "raws"), unique_matches(spark, d)).select("raw_id", "source")


@query("ordered_matches")
def ordered_matches(spark, d):
    return lone.ordered_groups(*_match_sides(spark, d)).select("left_raw_id", "right_raw_id")


@query("aggregate_pairs", f"""WITH {B.SUMS}, f AS (SELECT b.row_id AS bank_id, p.row_id::VARCHAR || ',' || q.row_id AS payment_ids, [p.row_id, q.row_id] AS ids FROM bk b JOIN py p ON b.account = p.account AND b.day = p.day JOIN py q ON q.account = b.account AND q.day = b.day AND p.row_id < q.row_id AND p.amount + q.amount = b.amount
  UNION ALL SELECT b.row_id, p.row_id::VARCHAR || ',' || q.row_id || ',' || r.row_id, [p.row_id, q.row_id, r.row_id] FROM bk b JOIN py p ON b.account = p.account AND b.day = p.day JOIN py q ON q.account = b.account AND q.day = b.day AND p.row_id < q.row_id JOIN py r ON r.account = b.account AND r.day = b.day AND q.row_id < r.row_id AND p.amount + q.amount + r.amount = b.amount),
g AS (SELECT *, count(*) OVER (PARTITION BY bank_id) AS solutions FROM f), u AS (SELECT id, count(*) AS uses FROM (SELECT unnest(ids) AS id FROM g WHERE solutions = 1) GROUP BY id HAVING count(*) > 1)
SELECT bank_id, payment_ids, solutions, solutions = 1 AND NOT list_has_any(ids, (SELECT coalesce(list(id), []) FROM u)) AS "unique" FROM g""")
def aggregate_pairs(spark, d):
    out = matching.subset_sums(*B.sums_sides(spark, d))
    return out.withColumn("payment_ids", F.array_join(F.transform("payment_ids", lambda x: x.cast("string")), ","))


_MIXED = """mp AS (SELECT raw_id, CASE WHEN contains(payment_method, '9001') THEN '招商银行' WHEN contains(payment_method, '9002') THEN '工商银行' END AS account, booking_date AS day, amount, merchant FROM raws WHERE source = 'alipay' AND payment_method <> ''),
mb AS (SELECT raw_id AS bank_id, source_account AS account, booking_date AS day, amount, merchant FROM raws WHERE source = 'bank' AND amount < 0 AND balance IS NOT NULL),
mx AS (SELECT mp.raw_id, mb.bank_id, abs(mb.amount) AS bank_amount, rank() OVER (PARTITION BY mp.raw_id ORDER BY mp.merchant <> mb.merchant, abs(date_diff('day', mp.day, mb.day)), -abs(mb.amount)) AS k FROM mp JOIN mb ON mp.account = mb.account AND abs(date_diff('day', mp.day, mb.day)) <= 3 AND abs(mb.amount) <= abs(mp.amount) AND (mp.merchant = mb.merchant OR contains(mb.merchant, '支付宝'))),
mixed AS (SELECT raw_id, min(bank_id) AS bank_id, min(bank_amount)::DECIMAL(18,2) AS bank_amount FROM mx WHERE k = 1 GROUP BY raw_id HAVING count(*) = 1)"""


def _mixed(spark, d):
    rows = load(spark, d, "raws")
    m = F.col("payment_method")
    account = F.when(F.contains(m, F.lit("9001")), "招商银行").when(F.contains(m, F.lit("9002")), "工商银行")
    pay = rows.where("source = 'alipay' and payment_method <> ''").select("raw_id", account.alias("account"), F.col("booking_date").alias("day"), "amount", "merchant")
    bank = rows.where("source = 'bank' and balance is not null").select(F.col("raw_id").alias("bank_id"), F.col("source_account").alias("account"), F.col("booking_date").alias("day"), "amount", "merchant")
    return matching.mixed_funding(pay, bank)


@query("mixed_funding", f"WITH {ctes('raws')}, {_MIXED} SELECT * FROM mixed")
def mixed_funding(spark, d):
    return _mixed(spark, d)


@query("wallet_effects", f"""WITH {ctes('raws')}, {_MIXED}, w AS (SELECT raws.*, bank_amount, concat_ws(' ', merchant, description, status) AS said FROM raws LEFT JOIN mixed USING (raw_id) WHERE source <> 'bank'),
r AS (SELECT *, CASE WHEN source = 'wechat' THEN CASE WHEN contains(said, '充值完成') THEN 'wallet_recharge' WHEN contains(said, '提现已到账') THEN 'wallet_withdrawal' WHEN contains(payment_method, '零钱') THEN 'wallet_funded' WHEN direction = 'income' AND payment_method IN ('', '/') THEN 'wallet_income' ELSE 'not_wallet_funded' END
  WHEN status = '交易关闭' THEN 'closed' WHEN direction = 'income' AND payment_method = '' THEN 'wallet_income' WHEN NOT contains(payment_method, '余额') THEN 'not_wallet_funded'
  WHEN NOT contains(payment_method, '银行') AND NOT contains(payment_method, '卡(') THEN CASE WHEN direction = 'neutral' AND contains(said, '提现') THEN 'wallet_withdrawal' ELSE 'wallet_funded' END WHEN bank_amount IS NULL THEN 'mixed_funding_unresolved' ELSE 'mixed_funding_split' END AS reason FROM w)
SELECT raw_id, reason, (CASE reason WHEN 'wallet_recharge' THEN abs(amount) WHEN 'wallet_withdrawal' THEN -abs(amount) WHEN 'closed' THEN NULL WHEN 'not_wallet_funded' THEN NULL WHEN 'mixed_funding_split' THEN sign(amount) * greatest(abs(amount) - bank_amount, 0) ELSE amount END)::DECIMAL(18,2) AS effect FROM r""")
def wallet_effects(spark, d):
    from ledgerloom.functions import texts as T

    rows = load(spark, d, "raws").where("source <> 'bank'").join(_mixed(spark, d), "raw_id", "left")
    effect, reason = T.wallet_effect(F.col("source"), F.col("amount"), F.col("direction"), F.col("payment_method"), T.text("merchant", "description", "status"), F.col("status"), F.col("bank_amount"))
    return rows.select("raw_id", reason.alias("reason"), effect.alias("effect"))


_REFUNDS = f"""WITH {ctes('canonicals')}, c AS (SELECT canonical_id AS row_id, booking_date AS day, abs(amount) AS amount, amount > 0 AS inc, tx_type, canonical_id, regexp_replace(lower(merchant), '退款|退回|退还|有限公司|有限责任公司|[^\\p{{L}}\\p{{N}}]', '', 'g') AS m, {_any("lower(concat_ws(' ', merchant, status, notes))", L.REFUND_WORDS)} AS said FROM canonicals),
rc0 AS (SELECT a.row_id AS refund_id, b.row_id AS original_id, date_diff('day', b.day, a.day) AS days, CASE WHEN a.amount = b.amount THEN 'full' ELSE 'partial' END AS kind, (CASE WHEN a.amount = b.amount THEN 0.90 ELSE 0.75 END)::DECIMAL(4,2) AS confidence, a.amount AS ra, b.amount AS oa
  FROM c a JOIN c b ON a.inc AND (a.tx_type = 'REFUND' OR a.said) AND NOT b.inc AND length(a.m) >= 2 AND length(b.m) >= 2 AND (contains(a.m, b.m) OR contains(b.m, a.m)) AND a.amount <= b.amount AND date_diff('day', b.day, a.day) BETWEEN 0 AND 180),
rc AS (SELECT *, count(*) OVER (PARTITION BY refund_id) > 1 AS ambiguous FROM rc0)
"""


def _refund_sides(spark, d):
    from ledgerloom.functions import texts as T

    rows = load(spark, d, "canonicals").select(F.col("canonical_id").alias("row_id"), "merchant", F.col("booking_date").alias("day"), "amount", "tx_type", T.refund_words(T.text("merchant", "status", "notes")).alias("said"))
    size = lambda x: x.select("row_id", "merchant", "day", F.abs("amount").alias("amount"))
    return size(rows.where("amount > 0 and (tx_type = 'REFUND' or said)")), size(rows.where("amount < 0"))


def _refund_candidates(spark, d):
    return refunds.refund_candidates(*_refund_sides(spark, d))


@query("refund_candidates", _REFUNDS + "SELECT refund_id, original_id, days::INT AS days, kind, confidence, ambiguous FROM rc")
def refund_candidates(spark, d):
    return _refund_candidates(spark, d).select("refund_id", "original_id", "days", "kind", "confidence", "ambiguous")


@query("refund_latest", _REFUNDS + "SELECT refund_id, original_id, days::INT AS days FROM rc QUALIFY row_number() OVER (PARTITION BY refund_id ORDER BY days, original_id DESC) = 1")
def refund_latest(spark, d):
    return refunds.latest_candidates(*_refund_sides(spark, d)).select("refund_id", "original_id", "days")


@query("refund_capacity", _REFUNDS + """, x AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY refund_id ORDER BY days, original_id DESC) = 1)
SELECT original_id, max(oa) AS amount, sum(ra)::DECIMAL(18,2) AS refunded, count(*) AS n_refunds, sum(ra) <= max(oa) AS fits FROM x GROUP BY original_id""")
def refund_capacity(spark, d):
    latest = refunds.latest_candidates(*_refund_sides(spark, d))
    return refunds.capacity_of(latest)


def _orders(spark, d):
    return load(spark, d, "canonicals").select(F.col("canonical_id").alias("row_id"), F.coalesce("transaction_time", F.col("booking_date").cast("timestamp_ntz")).alias("at"), F.array(F.concat(F.lit("O"), F.pmod(F.expr("cast(substring(canonical_id, 2) as bigint)"), F.lit(9)))).alias("orders"), F.array(F.concat(F.lit("T"), "canonical_id")).alias("ids"))


def _ranked(spark, d):
    return refunds.ranked_candidates(*_refund_sides(spark, d), _orders(spark, d))


@query("refund_ranks", _REFUNDS + """, o AS (SELECT canonical_id, coalesce(transaction_time, booking_date::TIMESTAMP) AS tm, canonical_id[2:]::BIGINT % 9 AS o FROM canonicals)
SELECT refund_id, original_id, a.o = b.o AS same_order, row_number() OVER (PARTITION BY refund_id ORDER BY a.o <> b.o, days, b.tm, original_id)::INT AS rank FROM rc JOIN o a ON a.canonical_id = refund_id JOIN o b ON b.canonical_id = original_id""")
def refund_ranks(spark, d):
    return _ranked(spark, d).select("refund_id", "original_id", "same_order", "rank")


@query("preferred_refunds")
def preferred_refunds(spark, d):
    return refunds.assigned_refunds(*_refund_sides(spark, d), _orders(spark, d))


def _engine_rows(spark, d):
    rows = B.observations(spark, d)
    k = F.expr("cast(substring(raw_id, 2) as bigint)")
    said = F.when(k % 7 == 3, "余额提现").otherwise("消费")
    return rows.select((k % 23).cast("string").alias("owner"), F.col("raw_id").alias("row_id"), (k * 2 + F.when(F.col("source") == "bank", 1).otherwise(0)).alias("seq"), "source", "ts", "amount", "party", said.alias("description"))


@query("engine_results")
def engine_results(spark, d):
    return engine.resolve(_engine_rows(spark, d))


@query("engine_incremental")
def engine_incremental(spark, d):
    rows = _engine_rows(spark, d)
    return engine.resolve(rows, engine.hashes(rows.where("seq % 5 = 0")))


@query("engine_report")
def engine_report(spark, d):
    rows = _engine_rows(spark, d)
    return engine.report(rows, engine.resolve(rows))


@query("engine_islands", f"""WITH {B.OBSERVATIONS}, k AS (SELECT raw_id[2:]::BIGINT % 23 AS owner, floor(abs(amount) * 100) AS cents, amount < 0 AS out, epoch(ts) AS s FROM obs),
c AS (SELECT *, s - lag(s) OVER w <= 120 AS goes_on FROM k WINDOW w AS (PARTITION BY owner, cents, out ORDER BY s)), i AS (SELECT owner, cents, out, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY owner, cents, out ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM c),
n AS (SELECT count(*) AS n_rows FROM i GROUP BY owner, cents, out, island) SELECT n_rows, count(*) AS n_islands FROM n GROUP BY n_rows""")
def engine_islands(spark, d):
    return engine.islands(_engine_rows(spark, d)).groupBy("n_rows").agg(F.count("*").alias("n_islands"))


@query("transfer_pairs", f"""WITH {B.OBSERVATIONS}, t AS (SELECT raw_id, raw_id[2:]::BIGINT AS k, source, ts, epoch(ts) AS s, CASE WHEN raw_id[2:]::BIGINT % 4 = 0 THEN -amount ELSE amount END AS amount FROM obs), u AS (SELECT *, 1 AS owner, floor(abs(amount) * 100) AS cents, k % 7 = 3 AND source <> 'bank' AS tr FROM t)
SELECT a.raw_id AS out_id, b.raw_id AS in_id FROM u a JOIN u b ON a.owner = b.owner AND a.cents = b.cents AND a.amount < 0 AND b.amount >= 0 AND abs(date_diff('day', a.ts::DATE, b.ts::DATE)) <= 1 AND abs(a.s - b.s) <= 86400 AND (a.source = 'bank' OR b.source = 'bank') AND (a.tr OR b.tr)""")
def transfer_pairs(spark, d):
    k = F.expr("cast(substring(row_id, 2) as bigint)")
    return engine.transfer_pairs(_engine_rows(spark, d).withColumn("owner", F.lit("1")).withColumn("amount", F.when(k % 4 == 0, -F.col("amount")).otherwise(F.col("amount"))))


_FACTS = f"""WITH {ctes('canonicals', 'relationships', 'classifications')}, pn AS (SELECT canonical_id FROM classifications WHERE status = 'pending' UNION SELECT from_id FROM relationships WHERE status = 'pending'),
rw AS (SELECT * FROM canonicals WHERE booking_date BETWEEN DATE '1995-02-01' AND DATE '1997-06-30'), lk AS (SELECT * FROM relationships WHERE status = 'confirmed'),
fx AS (SELECT canonical_id, CASE WHEN canonical_id IN (SELECT canonical_id FROM pn) THEN 'pending' WHEN tx_type IN ('EXPENSE', 'INCOME', 'REFUND') THEN lower(tx_type) WHEN tx_type IN ('TRANSFER', 'INVESTMENT', 'PREAUTHORIZATION') THEN 'excluded' ELSE 'unclassified' END AS fact, CASE WHEN category = '' THEN '未分类' ELSE category END AS category, booking_date, amount FROM rw),
fa AS (SELECT canonical_id, fact, category, booking_date, CASE WHEN fact = 'income' THEN amount ELSE abs(amount) END AS amount FROM fx WHERE fact <> 'refund' OR canonical_id NOT IN (SELECT from_id FROM lk)
  UNION ALL SELECT from_id, 'refund', CASE WHEN o.category = '' THEN '未分类' ELSE o.category END, rw.booking_date, lk.amount FROM lk JOIN rw ON rw.canonical_id = from_id JOIN canonicals o ON o.canonical_id = to_id)
"""
_SUM = lambda n: f"coalesce(sum(amount) FILTER (fact = '{n}'), 0)::DECIMAL(18,2)"
_N = lambda n: f"count(*) FILTER (fact = '{n}')"


def _facts(spark, d):
    return statistics.report_facts(*[load(spark, d, n) for n in ("canonicals", "relationships", "classifications")], "1995-02-01", "1997-06-30")


@query("report_facts", _FACTS + "SELECT * FROM fa")
def report_facts(spark, d):
    return _facts(spark, d)


@query("report_summary", _FACTS + f""", s AS (SELECT {_SUM('expense')} AS gross_expense, {_SUM('refund')} AS refunds, {_SUM('income')} AS income, {_N('expense')} AS n_expenses, {_N('income')} AS n_incomes, {_N('refund')} AS n_refunds, {_N('excluded')} AS n_excluded, {_N('unclassified')} AS n_unclassified, {_N('pending')} AS n_pending FROM fa)
SELECT *, (gross_expense - refunds)::DECIMAL(18,2) AS net_expense, (income + refunds - gross_expense)::DECIMAL(18,2) AS net_flow FROM s""")
def report_summary(spark, d):
    return statistics.report_summary(_facts(spark, d))


@query("report_categories", _FACTS + f", s AS (SELECT category, {_SUM('expense')} AS gross_expense, {_SUM('refund')} AS refunds FROM fa WHERE fact IN ('expense', 'refund') GROUP BY category) SELECT *, (gross_expense - refunds)::DECIMAL(18,2) AS net FROM s")
def report_categories(spark, d):
    return statistics.report_categories(_facts(spark, d))


@query("report_timeline", _FACTS + f", s AS (SELECT date_trunc('week', booking_date)::DATE AS period, {_SUM('expense')} AS gross_expense, {_SUM('refund')} AS refunds, {_SUM('income')} AS income FROM fa WHERE fact IN ('expense', 'refund', 'income') GROUP BY 1) SELECT *, (income + refunds - gross_expense)::DECIMAL(18,2) AS net_flow FROM s")
def report_timeline(spark, d):
    return statistics.report_timeline(_facts(spark, d), "week")


_YEARS = lambda n: f"(SELECT sum(s) FROM (SELECT {_SUM(n)} AS s FROM fa GROUP BY year(booking_date))) = (SELECT {_SUM(n)} FROM fa)"


@query("ledger_validation", _FACTS + f""", p AS (SELECT CASE WHEN canonical_id[2:]::BIGINT % 500 <> 3 THEN booking_date END AS booking_date, CASE WHEN canonical_id[2:]::BIGINT % 700 <> 5 THEN amount ELSE 0 END AS amount, tx_type FROM canonicals)
SELECT 'yearly_gross_expense' AS "check", {_YEARS('expense')} AS holds UNION ALL SELECT 'yearly_refunds', {_YEARS('refund')} UNION ALL SELECT 'yearly_income', {_YEARS('income')}
UNION ALL SELECT 'net_flow', (SELECT sum(CASE fact WHEN 'expense' THEN -amount WHEN 'refund' THEN amount WHEN 'income' THEN amount ELSE 0 END) FROM fa) = (SELECT {_SUM('income')} + {_SUM('refund')} - {_SUM('expense')} FROM fa)
UNION ALL SELECT 'rows_have_day', count(*) FILTER (booking_date IS NULL) = 0 FROM p UNION ALL SELECT 'rows_have_amount', count(*) FILTER (amount = 0 OR amount IS NULL) = 0 FROM p UNION ALL SELECT 'rows_have_type', count(*) FILTER (trim(tx_type) = '' OR tx_type IS NULL) = 0 FROM p""")
def ledger_validation(spark, d):
    """Some canonical rows lose their day or their amount, so two checks fail."""
    n, rows = F.expr("cast(substring(canonical_id, 2) as bigint)"), load(spark, d, "canonicals")
    faulty = rows.withColumns({"booking_date": F.when(n % 500 != 3, F.col("booking_date")), "amount": F.when(n % 700 != 5, F.col("amount")).otherwise(0).cast("decimal(18,2)")})
    return statistics.validation(_facts(spark, d), faulty)


@query("account_facets", f"WITH {ctes('raws', 'links')}, e AS (SELECT DISTINCT canonical_id, source, source_account FROM links JOIN raws USING (raw_id)) SELECT source, source_account, count(DISTINCT canonical_id) AS n_rows FROM e GROUP BY 1, 2 UNION ALL SELECT source, NULL, count(DISTINCT canonical_id) FROM e GROUP BY 1")
def account_facets(spark, d):
    return statistics.facets_by_account(*[load(spark, d, n) for n in ("canonicals", "links", "raws")])


@query("canonical_page", f"WITH {ctes('canonicals')} SELECT canonical_id, booking_date, (SELECT count(*) FROM canonicals) AS total FROM canonicals ORDER BY booking_date DESC, transaction_time DESC NULLS LAST, canonical_id LIMIT 30 OFFSET 60")
def canonical_page(spark, d):
    order = [F.col("booking_date").desc(), F.col("transaction_time").desc_nulls_last(), F.col("canonical_id").asc()]
    return statistics.page_with_total(load(spark, d, "canonicals"), order, 3, 30).select("canonical_id", "booking_date", "total")


_ASSETS = {"alipay": "Assets:Alipay", "wechat": "Assets:WeChat", "bank": "Assets:Bank"}
_OTHER = "CASE WHEN amount > 0 THEN 'Income' ELSE 'Expenses' END || ':' || CASE WHEN regexp_replace(category, '[^\\p{L}\\p{N}-]', '', 'g') = '' THEN 'Unclassified' ELSE regexp_replace(category, '[^\\p{L}\\p{N}-]', '', 'g') END"


def _export_rows(spark, d):
    rows = B.ledger(spark, d).withColumns({"merchant": F.concat(F.lit('"'), "category", F.lit("\n")), "review": F.col("row_id") % 19 == 0})
    return exports.account_names(rows, _ASSETS)


@query("ledger_text", f"""WITH {B.LEDGER}, x AS (SELECT *, CASE source WHEN 'alipay' THEN 'Assets:Alipay' WHEN 'wechat' THEN 'Assets:WeChat' ELSE 'Assets:Bank' END AS asset, {_OTHER} AS other FROM lg),
a AS (SELECT DISTINCT unnest([asset, other]) AS a FROM x), e AS (SELECT ts, row_id, unnest([0, 1, 2, 3]) AS nth, unnest([strftime(ts, '%Y-%m-%d') || CASE WHEN row_id % 19 = 0 THEN ' ! "' ELSE ' * "' END || CASE WHEN category = '' THEN 'Unknown' ELSE trim(category) END || '"', '  ' || asset || '  ' || amount || ' CNY', '  ' || other || '  ' || -amount || ' CNY', '']) AS line FROM x)
SELECT 1 AS section, '1990-01-01' AS day, a AS key, 0 AS nth, '1990-01-01 open ' || a || ' CNY' AS line FROM a UNION ALL SELECT 2, strftime(ts, '%Y-%m-%d %H:%M:%S'), row_id::VARCHAR, nth, line FROM e""")
def ledger_text(spark, d):
    return exports.ledger_lines(_export_rows(spark, d), "1990-01-01")


@query("unbalanced_entries", f"WITH {B.LEDGER} SELECT row_id::VARCHAR AS key, 1::DECIMAL(28,2) AS total FROM lg WHERE row_id % 101 = 0")
def unbalanced_entries(spark, d):
    lines = exports.ledger_lines(_export_rows(spark, d), "1990-01-01")
    broken = (F.col("nth") == 2) & (F.col("section") == exports.ENTRY) & (F.col("key").cast("long") % 101 == 0)
    amount = F.regexp_extract("line", r"(-?\d+\.\d{2}) CNY$", 1)
    wrong = F.concat(F.regexp_extract("line", r"^(.*  )-?\d+\.\d{2} CNY$", 1), (amount.try_cast("decimal(18,2)") + 1).cast("decimal(18,2)").cast("string"), F.lit(" CNY"))
    return exports.unbalanced(lines.withColumn("line", F.when(broken, wrong).otherwise(F.col("line"))))


@query("duplicate_report")
def duplicate_report(spark, d):
    rows = _engine_rows(spark, d)
    return exports.duplicate_lines(rows, engine.resolve(rows))


@query("json_export", f"""WITH {ctes('canonicals')} SELECT '{{"amount":' || amount || ',"canonical_id":"' || canonical_id || '","transaction_time":' || coalesce('"' || strftime(transaction_time, '%Y-%m-%dT%H:%M:%S.000') || '"', 'null') || '}}' AS line FROM canonicals""")
def json_export(spark, d):
    return exports.json_lines(load(spark, d, "canonicals").select("canonical_id", "amount", "transaction_time"))


@query("interval_gate", f"WITH {B.INTERVALS}, s AS (SELECT account, count(*) FILTER (status <> 'ok') AS n FROM iv GROUP BY account) SELECT count(*) AS n_accounts, count(*) FILTER (n > 0) AS n_failing, count(*) FILTER (n > 0) = 0 AS passes FROM s")
def interval_gate(spark, d):
    from ledgerloom.operators import intervals

    rows = B.statement(spark, d)
    return exports.interval_gate(intervals.interval_summary(intervals.interval_reconciliation(rows, B.canonical_sides(rows))))
