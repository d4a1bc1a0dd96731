"""Registered queries over the ledger tables: text rules, record joins, balances, queues and histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as L
from ledgerloom.functions import texts as T
from ledgerloom.operators import intervals, observations, records
from ledgerloom.plans import bridge as B
from ledgerloom.plans.registry import Registry
from ledgerloom.plans.store import ctes, load

query = Registry()
#: The funding names that the examples use; a user gives their own.
ACCOUNTS = [("招商银行", ["招商银行", "招商", "9001", "cmb"]), ("工商银行", ["工商银行", "工行", "9002", "icbc"]), ("重庆农村商业银行", ["重庆农商行", "农商行", "9000", "cqrcb"])]


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '" + w.replace("'", "''") + "')" for w in words) + ")"


def _cases(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


_SAID = "concat_ws(' ', coalesce(merchant, ''), coalesce(counterparty, ''), coalesce(description, ''))"
_PARTY = """bare AS (SELECT *, regexp_replace(trim(merchant), '^(支付宝-|财付通-|微信支付-|微信-|银联-|支付宝（中国）网络技术有限公司-|快钱支付-)', '') AS b FROM raws),
party AS (SELECT raw_id, """ + _cases([("coalesce(merchant, '') = ''", "'未知'"), *[("contains(lower(b), '{0}') OR contains('{0}', lower(b))".format(k.replace("'", "''")), f"'{v}'") for k, v in L.MERCHANTS], ("regexp_replace(b, '[^一-龥a-zA-Z0-9]', '', 'g') = ''", "'未知'")], "regexp_replace(b, '[^一-龥a-zA-Z0-9]', '', 'g')") + " AS party FROM bare)"


@query("party_names", f"WITH {ctes('raws')}, {_PARTY} SELECT raw_id, party FROM party")
def party_names(spark, d):
    return load(spark, d, "raws").select("raw_id", T.party_name(F.col("merchant")).alias("party"))


@query("bank_parties", f"WITH {ctes('raws')} SELECT raw_id, trim(regexp_replace({'regexp_replace(' * 7}counterparty{''.join(f", '^{p}', '')" for p in L.BANK_PREFIXES)}, '\\(\\d+\\)$', '')) AS party FROM raws WHERE source = 'bank'")
def bank_parties(spark, d):
    return load(spark, d, "raws").where("source = 'bank'").select("raw_id", T.bank_party(F.col("counterparty")).alias("party"))


_WAY = "CASE direction WHEN 'expense' THEN '支出' WHEN 'income' THEN '收入' ELSE '/' END"


def _type_sql(p: str) -> str:
    refund, transfer = L.TYPE_WORDS[p]
    rest = {"wechat": [("contains(said, '二维码收款')", "'INCOME'"), ("contains(said, '扫二维码付款')", "'EXPENSE'")], "unionpay": [("amount > 0", "'INCOME'"), ("amount < 0", "'EXPENSE'")]}
    return _cases([(_any("said", refund), "'REFUND'"), (_any("said", transfer), "'TRANSFER'"), *rest.get(p, [("way = '收入'", "'INCOME'"), ("way = '支出'", "'EXPENSE'")])], "'UNKNOWN'")


@query("transaction_types", f"WITH {ctes('raws')}, t AS (SELECT *, concat_ws(' ', counterparty, description) AS said, {_WAY} AS way FROM raws) SELECT raw_id, {', '.join(f'{_type_sql(p)} AS {p}' for p in L.TYPE_WORDS)} FROM t")
def transaction_types(spark, d):
    way = T.first_of([(F.col("direction") == "expense", F.lit("支出")), (F.col("direction") == "income", F.lit("收入"))], F.lit("/"))
    said = T.text("counterparty", "description")
    return load(spark, d, "raws").select("raw_id", *[T.transaction_type(p, said, way, F.col("amount")).alias(p) for p in L.TYPE_WORDS])


@query("unionpay_amounts", f"WITH {ctes('raws')} SELECT raw_id, ({_cases([(_any('description', L.UNIONPAY_OUT), '-abs(amount)'), (_any('description', L.UNIONPAY_IN), 'abs(amount)')], '-abs(amount)')})::DECIMAL(18,2) AS amount FROM raws")
def unionpay_amounts(spark, d):
    return load(spark, d, "raws").select("raw_id", T.unionpay_amount(F.col("amount"), F.col("description")).alias("amount"))


@query("signed_amounts", f"WITH {ctes('raws')} SELECT raw_id, CASE WHEN direction = 'neutral' THEN NULL ELSE amount END AS amount, CASE WHEN direction <> 'neutral' THEN direction END AS direction, abs(amount)::DECIMAL(18,2) AS last_money, CASE WHEN raw_row_number % 3 < 2 THEN transaction_time END AS at FROM raws")
def signed_amounts(spark, d):
    rows = load(spark, d, "raws")
    amount, way = T.signed_amount(F.concat(F.lit("¥ "), F.format_number(F.abs("amount").cast("double"), 2)), T.first_of([(F.col("direction") == "expense", F.lit("支出")), (F.col("direction") == "income", F.lit("收入"))], F.lit("?")))
    money = T.decimal_amount(F.concat(F.lit("CNY 1.00 "), F.lit("+"), F.format_number(F.abs("amount").cast("double"), 2), F.lit(" ok")))
    k = F.col("raw_row_number") % 3
    stamp = F.when(k == 0, F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("transaction_time", "yyyy/MM/ddHH:mm:ss")).otherwise(F.date_format("transaction_time", "dd.MM.yyyy"))
    return rows.select("raw_id", amount.alias("amount"), F.when(way.isNotNull(), way).alias("direction"), money.alias("last_money"), T.strict_datetime(stamp).alias("at"))


_OWN = " OR ".join(f"(source = '{s}' AND {_any("concat_ws(' ', description, counterparty)", w)})" for s, w in L.TRANSFER_WORDS.items())
_FUND = _cases([(_any("lower(concat_ws(' ', payment_method, description))", n), f"'{a}'") for a, n in ACCOUNTS], "NULL")


@query("row_features", f"""WITH {ctes('raws')} SELECT raw_id, {_cases([(_any(f'lower({_SAID})', w), f"'{r}'") for r, w in L.RAILS], 'NULL')} AS rail, {_any("concat_ws(' ', description, counterparty)", L.INTERNAL_PRODUCTS)} AS internal_product,
  concat_ws(',', {', '.join(f"CASE WHEN {_any('lower(payment_method)', w)} THEN '{k}' END" for k, w in L.BANK_FAMILIES.items())}) AS families, {_any(f"lower(concat_ws(' ', {_SAID}, status))", L.REFUND_WORDS)} AS refund, {_OWN} AS own_transfer, status IN ({_quoted(L.CANCELLED)}) AS cancelled, {_FUND} AS funding_account FROM raws""")
def row_features(spark, d):
    rows = observations.features(load(spark, d, "raws"), ACCOUNTS)
    return rows.select("raw_id", "rail", "internal_product", F.array_join("families", ",").alias("families"), "refund", "own_transfer", "cancelled", "funding_account")


_CORE = r"regexp_replace(lower(concat_ws(' ', merchant, counterparty, description)), '" + "|".join(L.TOKEN_NOISE) + r"|[^\p{L}\p{N}]', '', 'g')"


@query("merchant_tokens", f"""WITH {ctes('raws')}, t AS (SELECT raw_id, lower({_SAID}) AS low, {_CORE} AS core FROM raws)
SELECT raw_id, array_to_string(list_sort(list_distinct(list_concat(list_filter([{', '.join(f"CASE WHEN {_any('low', w)} THEN '{k}' END" for k, w in L.MERCHANT_ALIASES.items())}], lambda x: x IS NOT NULL), list_transform(range(1, length(core)), lambda i: core[i:i+1])))), ' ') AS tokens FROM t""")
def merchant_tokens(spark, d):
    return load(spark, d, "raws").select("raw_id", F.array_join(F.sort_array(T.merchant_tokens(observations.said())), " ").alias("tokens"))


@query("refund_predicates", f"""WITH {ctes('raws')} SELECT raw_id, status IN ({_quoted(L.REFUND_DONE + L.REFUND_PENDING)}) OR ({_any("concat_ws(' ', counterparty, description)", ['退款', '退还', '退回'])} AND amount > 0) AS is_refund,
  concat_ws(',', CASE WHEN status IN ({_quoted(L.CANCELLED)}) THEN 'cancelled' END) AS tags FROM raws""")
def refund_predicates(spark, d):
    rows = observations.cancelled(load(spark, d, "raws").withColumn("tags", F.array().cast("array<string>")), "mark")
    return rows.select("raw_id", observations.is_refund(F.lit("UNKNOWN"), F.col("status"), T.text("counterparty", "description"), F.col("amount")).alias("is_refund"), F.array_join("tags", ",").alias("tags"))


@query("raw_keys", f"""WITH {ctes('raws')}, k AS (SELECT raw_id, CASE WHEN transaction_id IS NOT NULL THEN '1|' || source || '|' || source_account || '|' || transaction_id
  WHEN source = 'bank' AND balance IS NOT NULL THEN '2|' || concat_ws('|', source_account, coalesce(transaction_time::VARCHAR, '-'), booking_date, amount, direction, balance) ELSE '3|' || concat_ws('|', source, source_account, source_file, raw_row_number) END AS k FROM raws)
SELECT raw_id, min(raw_id) OVER (PARTITION BY k) AS same_as FROM k""")
def raw_keys(spark, d):
    from pyspark.sql import Window

    rows = observations.dedup_key(load(spark, d, "raws").withColumn("occurrence", F.lit(None).cast("int")))
    return rows.select("raw_id", F.min("raw_id").over(Window.partitionBy("key")).alias("same_as"))


@query("row_properties", f"WITH {ctes('raws')} SELECT raw_id, amount < 0 AS is_expense, amount > 0 AS is_income, floor(abs(amount) * 100)::BIGINT AS cents, strftime(transaction_time, '%Y-%m-%d') AS day, strftime(transaction_time, '%H:%M:%S') AS clock FROM raws")
def row_properties(spark, d):
    return observations.properties(load(spark, d, "raws")).select("raw_id", "is_expense", "is_income", "cents", "day", "clock")


@query("row_faults", f"WITH {ctes('raws')} SELECT raw_id, 'direction' AS fault FROM raws WHERE raw_row_number % 10 = 3 UNION ALL SELECT raw_id, 'suffix' FROM raws WHERE raw_row_number % 10 = 4 AND bank_card_suffix IS NOT NULL UNION ALL SELECT raw_id, 'date' FROM raws WHERE raw_row_number % 10 = 5 UNION ALL SELECT raw_id, 'source' FROM raws WHERE raw_row_number % 10 = 6")
def row_faults(spark, d):
    k = F.col("raw_row_number") % 10
    rows = load(spark, d, "raws").withColumns({"direction": F.when(k == 3, "sideways").otherwise(F.col("direction")), "bank_card_suffix": F.when(k == 4, F.concat("bank_card_suffix", F.lit("x"))).otherwise(F.col("bank_card_suffix")), "booking_date": F.when(k != 5, F.col("booking_date")), "source": F.when(k == 6, " ").otherwise(F.col("source"))})
    return observations.faults(rows)


@query("changed_fields", f"WITH {ctes('canonicals')} SELECT canonical_id, 'category' AS field, category AS old, 'x' AS new FROM canonicals WHERE category <> 'x' AND canonical_id LIKE '%7' UNION ALL SELECT canonical_id, 'notes', notes, NULL FROM canonicals WHERE notes = '书'")
def changed_fields(spark, d):
    rows = load(spark, d, "canonicals")
    after = rows.select("canonical_id", F.when(F.col("canonical_id").endswith("7"), "x").otherwise(F.col("category")).alias("category"), F.when(F.col("notes") != "书", F.col("notes")).alias("notes"), "status")
    return observations.changed_fields(rows, after, "canonical_id", ["category", "notes", "status"])


@query("statement_chain_faults", f"""WITH {B.STATEMENT}, p AS (SELECT account, row_id, amount, CASE WHEN row_id % 41 <> 0 THEN balance END AS balance FROM st), q AS (SELECT *, lag(balance) OVER (PARTITION BY account ORDER BY row_id) AS previous, row_number() OVER (PARTITION BY account ORDER BY row_id) AS n FROM p)
SELECT account AS file, row_id AS row_no, CASE WHEN previous IS NULL OR balance IS NULL THEN 'balance_missing' ELSE 'balance_break' END AS fault FROM q WHERE n > 1 AND (previous IS NULL OR balance IS NULL OR previous + amount <> balance)""")
def statement_chain_faults(spark, d):
    rows = B.statement(spark, d).select(F.col("account").alias("file"), F.col("row_id").alias("row_no"), "amount", F.when(F.col("row_id") % 41 != 0, F.col("balance")).alias("balance"))
    return observations.chain_faults(rows)


@query("preferred_rows", f"WITH {ctes('raws')} SELECT raw_id, source_account, booking_date, amount FROM raws QUALIFY row_number() OVER (PARTITION BY source_account, booking_date, amount ORDER BY transaction_time IS NULL, raw_id) = 1")
def preferred_rows(spark, d):
    rows = observations.preferred(load(spark, d, "raws"), ["source_account", "booking_date", "amount"], [F.col("transaction_time").isNull(), F.col("raw_id")])
    return rows.select("raw_id", "source_account", "booking_date", "amount")


_SCOPE = "CASE WHEN contains(description, '朝朝宝') OR contains(description, '天天盈') OR (description = '基金购买' AND NOT contains(counterparty, '基金销售')) THEN 'bank_internal' ELSE 'external_or_review' END"


@query("investment_flows", f"WITH {ctes('raws')} SELECT source_account, CASE WHEN description = '' THEN '未注明类型' ELSE description END AS description, {_SCOPE} AS scope, count(*) AS n_rows, sum(amount)::DECIMAL(18,2) AS net FROM raws WHERE source = 'bank' AND ({_any('description', ['朝朝宝', '天天盈', '基金', '理财'])} OR contains(counterparty, '基金销售')) GROUP BY ALL")
def investment_flows(spark, d):
    return observations.investment_flows(load(spark, d, "raws"))


@query("balance_collisions", f"""WITH {ctes('raws')}, b AS (SELECT source_account, booking_date, amount, (balance::INT // 100)::DECIMAL(18,2) AS balance, source_file, raw_row_number, counterparty, description FROM raws WHERE source = 'bank' AND balance IS NOT NULL),
g AS (SELECT source_account, booking_date, amount, balance, count(*) AS n_rows, count(DISTINCT nullif(lower(replace(counterparty, ' ', '')), '')) = 1 AS same_counterparty, count(DISTINCT nullif(lower(replace(description, ' ', '')), '')) = 1 AS same_description FROM b GROUP BY ALL HAVING count(*) > 1),
n AS (SELECT *, lead(raw_row_number) OVER (PARTITION BY source_account, booking_date, amount, balance, source_file ORDER BY raw_row_number) AS nx FROM b),
r AS (SELECT DISTINCT n.source_account, n.booking_date, n.amount, n.balance FROM n JOIN raws x ON x.source_file = n.source_file AND x.amount = -n.amount AND x.raw_row_number > n.raw_row_number AND x.raw_row_number < n.nx)
SELECT g.*, r.amount IS NOT NULL AS interleaved_reversal, CASE WHEN r.amount IS NULL AND same_description AND (same_counterparty OR abs(g.amount) >= 1000) THEN 'high' ELSE 'review' END AS priority FROM g LEFT JOIN r USING (source_account, booking_date, amount, balance)""")
def balance_collisions(spark, d):
    rows = load(spark, d, "raws").withColumn("balance", F.floor(F.col("balance") / 100).cast("decimal(18,2)"))
    return observations.balance_collisions(rows)


@query("live_canonicals", f"WITH {ctes('canonicals', 'deletions')} SELECT canonical_id, amount FROM canonicals WHERE canonical_id NOT IN (SELECT canonical_id FROM deletions)")
def live_canonicals(spark, d):
    return records.live(load(spark, d, "canonicals"), load(spark, d, "deletions")).select("canonical_id", "amount")


@query("canonicals_from_sources", f"WITH {ctes('canonicals', 'links', 'raws')} SELECT canonical_id, amount FROM canonicals c WHERE EXISTS (SELECT 1 FROM links l JOIN raws r USING (raw_id) WHERE l.canonical_id = c.canonical_id AND ((r.source = 'bank' AND r.source_account = '招商银行') OR r.source = 'wechat'))")
def canonicals_from_sources(spark, d):
    t = [load(spark, d, n) for n in ("canonicals", "links", "raws")]
    return records.from_sources(*t, [("bank", "招商银行"), ("wechat", None)]).select("canonical_id", "amount")


@query("canonical_details", f"WITH {ctes('canonicals', 'links', 'raws')}, s AS (SELECT canonical_id, count(*) AS n, string_agg(raw_id || ':' || source, ',' ORDER BY raw_id) AS s FROM links JOIN raws USING (raw_id) GROUP BY canonical_id) SELECT canonical_id, tx_type, coalesce(n, 0)::INT AS source_count, s AS sources FROM canonicals LEFT JOIN s USING (canonical_id)")
def canonical_details(spark, d):
    out = records.with_sources(*[load(spark, d, n) for n in ("canonicals", "links", "raws")])
    return out.select("canonical_id", "tx_type", "source_count", F.array_join(F.transform("sources", lambda x: F.concat(x["raw_id"], F.lit(":"), x["source"])), ",").alias("sources"))


@query("source_counts", f"WITH {ctes('canonicals', 'links')} SELECT c.canonical_id, count(l.raw_id) AS source_count FROM canonicals c LEFT JOIN links l USING (canonical_id) GROUP BY c.canonical_id")
def source_counts(spark, d):
    return records.source_counts(load(spark, d, "canonicals"), load(spark, d, "links")).select("canonical_id", "source_count")


@query("linked_rows", f"WITH {ctes('canonicals', 'links', 'raws')} SELECT raw_id, l.canonical_id, c.amount AS canonical_amount, c.tx_type FROM raws LEFT JOIN links l USING (raw_id) LEFT JOIN canonicals c ON c.canonical_id = l.canonical_id")
def linked_rows(spark, d):
    return records.linked_rows(*[load(spark, d, n) for n in ("raws", "links", "canonicals")]).select("raw_id", "canonical_id", "canonical_amount", "tx_type")


_BACKED = f"""bm AS (SELECT canonical_id, bool_or(description IN ({_quoted(['朝朝宝转入', '朝朝宝转出', '基金赎回'])}) OR (description = '基金购买' AND NOT contains(counterparty, '基金销售'))) AS p FROM links JOIN raws USING (raw_id) WHERE source = 'bank' GROUP BY canonical_id),
bb AS (SELECT c.*, p IS NOT NULL AS bank_backed, coalesce(p, false) AS internal_product FROM canonicals c LEFT JOIN bm USING (canonical_id))"""


def _backed(spark, d):
    return records.backed_by_bank(*[load(spark, d, n) for n in ("canonicals", "links", "raws")], ["朝朝宝转入", "朝朝宝转出", "基金赎回"])


@query("bank_backed", f"WITH {ctes('canonicals', 'links', 'raws')}, {_BACKED} SELECT canonical_id, bank_backed, internal_product FROM bb")
def bank_backed(spark, d):
    return _backed(spark, d).select("canonical_id", "bank_backed", "internal_product")


_RULES = [(f"{_any('said', w)}", i) for i, (_, _, w, _) in enumerate(L.CLASSES)]
_CLASS = _cases([("tx_type NOT IN ('EXPENSE', 'INCOME', 'UNKNOWN')", "-1"), ("internal_product", "100"), (f"tx_type = 'UNKNOWN' AND payment_channel IN ('alipay', 'wechat') AND contains(merchant, '银行') AND funding_account IN ({_quoted(L.WALLET_FUNDS)})", "101"), *[(c + (" AND NOT bank_backed" if i == 4 else ""), str(i)) for c, i in _RULES]], "-1")
_CLASS_OF = lambda k: _cases([("r = 100", f"'{L.PRODUCT_CLASS[k]}'"), ("r = 101", f"'{L.WALLET_TO_BANK[k]}'"), *[(f"r = {i}", f"'{(c[0], c[1], c[3])[k]}'") for i, c in enumerate(L.CLASSES)]], "NULL")


@query("classification_rules", f"""WITH {ctes('canonicals', 'links', 'raws')}, {_BACKED}, t AS (SELECT *, lower(concat_ws(' ', merchant, normalized_merchant, payment_channel, funding_account, status, notes)) AS said FROM bb),
r AS (SELECT canonical_id, {_CLASS} AS r FROM t)
SELECT canonical_id, {_CLASS_OF(0)} AS proposed_type, {_CLASS_OF(1)} AS proposed_category, ({_CLASS_OF(2)})::DECIMAL(4,2) AS confidence, ({_CLASS_OF(2)})::DECIMAL(4,2) >= 0.88 AS auto_confirmed FROM r WHERE r >= 0""")
def classification_rules(spark, d):
    from ledgerloom.operators import classify

    return classify.propose(_backed(spark, d)).select("canonical_id", "proposed_type", "proposed_category", "confidence", "auto_confirmed")


@query("pending_after_statement", f"""WITH {ctes('canonicals', 'links', 'raws')}, cl AS (SELECT source_account AS account, DATE '1996-06-01' AS day FROM raws WHERE source = 'bank' GROUP BY 1)
SELECT account, c.canonical_id, c.amount FROM canonicals c JOIN cl ON c.booking_date > cl.day AND contains(c.funding_account, account) WHERE EXISTS (SELECT 1 FROM links l JOIN raws r USING (raw_id) WHERE l.canonical_id = c.canonical_id AND source IN ('wechat', 'alipay')) AND NOT EXISTS (SELECT 1 FROM links l JOIN raws r USING (raw_id) WHERE l.canonical_id = c.canonical_id AND source = 'bank')""")
def pending_after_statement(spark, d):
    raws = load(spark, d, "raws")
    closings = raws.where("source = 'bank'").select(F.col("source_account").alias("account")).distinct().withColumn("day", F.lit("1996-06-01").cast("date"))
    return records.pending_after(load(spark, d, "canonicals"), load(spark, d, "links"), raws, closings)


_FOUND = "fd AS (SELECT left_raw_id, right_raw_id, (confidence / 2)::DECIMAL(4,2) AS confidence FROM candidates WHERE left_raw_id LIKE '%5' UNION ALL SELECT 'N' || left_raw_id, right_raw_id, confidence FROM candidates WHERE left_raw_id LIKE '%1')"


@query("merged_candidates", f"WITH {ctes('candidates')}, {_FOUND} SELECT coalesce(c.left_raw_id, fd.left_raw_id) AS left_raw_id, coalesce(c.right_raw_id, fd.right_raw_id) AS right_raw_id, coalesce(c.status, 'pending') AS status, coalesce(fd.confidence, c.confidence) AS confidence FROM candidates c FULL JOIN fd ON c.left_raw_id = fd.left_raw_id AND c.right_raw_id = fd.right_raw_id")
def merged_candidates(spark, d):
    known = load(spark, d, "candidates")
    again = known.where(F.col("left_raw_id").endswith("5")).select("left_raw_id", "right_raw_id", (F.col("confidence") / 2).cast("decimal(4,2)").alias("confidence"))
    new = known.where(F.col("left_raw_id").endswith("1")).select(F.concat(F.lit("N"), "left_raw_id").alias("left_raw_id"), "right_raw_id", "confidence")
    return records.merge_candidates(known, again.union(new), ["left_raw_id", "right_raw_id"])


_STATES = "dc AS (SELECT * FROM changes WHERE action <> 'note'), cs AS (SELECT candidate_id, CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' ELSE 'superseded' END AS status, seq, actor FROM dc QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY seq DESC) = 1)"


@query("candidate_states", f"WITH {ctes('changes')}, {_STATES} SELECT * FROM cs")
def candidate_states(spark, d):
    return records.current_states(load(spark, d, "changes"))


@query("candidates_under_log", f"WITH {ctes('changes', 'candidates')}, {_STATES} SELECT candidate_id, coalesce(cs.status, candidates.status) AS status FROM candidates LEFT JOIN cs USING (candidate_id)")
def candidates_under_log(spark, d):
    return records.with_status(load(spark, d, "candidates"), load(spark, d, "changes")).select("candidate_id", "status")


@query("superseded_candidates", f"WITH {ctes('candidates')} SELECT p.candidate_id, min(c.candidate_id) AS \"by\" FROM candidates p JOIN candidates c ON p.status = 'pending' AND c.status = 'confirmed' AND (p.left_raw_id = c.left_raw_id OR p.right_raw_id = c.right_raw_id) GROUP BY 1")
def superseded_candidates(spark, d):
    return records.superseded_by(load(spark, d, "candidates"))


@query("change_history", f"WITH {ctes('changes')} SELECT candidate_id, seq, action, actor, row_number() OVER (PARTITION BY candidate_id ORDER BY happened_at, seq)::INT AS nth FROM changes")
def change_history(spark, d):
    return records.history(load(spark, d, "changes")).select("candidate_id", "seq", "action", "actor", "nth")


def _queue(name, table, id_col, where, order, sql_order):
    place = f"row_number() OVER (ORDER BY {sql_order})"

    @query(name, f"WITH {ctes(table)} SELECT {id_col}, {place}::INT AS place FROM {table} WHERE {where} QUALIFY {place} BETWEEN 21 AND 40")
    def run(spark, d):
        return records.queue(load(spark, d, table).where(where), order(), 2, 20).select(id_col, "place")


_queue("match_queue", "candidates", "candidate_id", "status = 'pending'", lambda: [F.col("is_ambiguous").desc(), F.col("confidence").desc(), F.col("created_at").asc(), F.col("candidate_id").asc()], "is_ambiguous DESC, confidence DESC, created_at, candidate_id")
_queue("refund_queue", "relationships", "relationship_id", "status = 'pending'", lambda: [F.col("is_ambiguous").desc(), F.col("confidence").desc(), F.col("created_at").asc(), F.col("relationship_id").asc()], "is_ambiguous DESC, confidence DESC, created_at, relationship_id")
_queue("classification_queue", "classifications", "candidate_id", "status = 'pending'", lambda: [F.col("confidence").desc(), F.col("created_at").asc(), F.col("candidate_id").asc()], "confidence DESC, created_at, candidate_id")


@query("deleted_page", f"WITH {ctes('canonicals', 'deletions')} SELECT canonical_id, amount, deleted_by, row_number() OVER (ORDER BY deleted_at DESC, canonical_id)::INT AS place FROM deletions JOIN canonicals USING (canonical_id) QUALIFY place <= 20")
def deleted_page(spark, d):
    rows = load(spark, d, "deletions").join(load(spark, d, "canonicals"), "canonical_id")
    return records.queue(rows, [F.col("deleted_at").desc(), F.col("canonical_id").asc()], 1, 20).select("canonical_id", "amount", "deleted_by", "place")


@query("refund_attention", f"WITH {ctes('relationships')} SELECT CASE WHEN status = 'pending' THEN 'required' WHEN status = 'confirmed' AND (is_ambiguous OR is_partial) AND acknowledged THEN 'acknowledged' WHEN status = 'confirmed' AND (is_ambiguous OR is_partial) THEN 'warning' ELSE 'settled' END AS queue, count(*) AS n_rows FROM relationships GROUP BY 1")
def refund_attention(spark, d):
    return records.attention(load(spark, d, "relationships")).groupBy("queue").agg(F.count("*").alias("n_rows"))


@query("unreviewed_rows", f"WITH {ctes('raws', 'links', 'candidates')} SELECT raw_id FROM raws WHERE raw_id NOT IN (SELECT raw_id FROM links) AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.status = 'pending' AND (c.left_raw_id = raws.raw_id OR c.right_raw_id = raws.raw_id))")
def unreviewed_rows(spark, d):
    return records.unreviewed(*[load(spark, d, n) for n in ("raws", "links", "candidates")]).select("raw_id")


@query("candidate_details", f"WITH {ctes('raws', 'candidates')} SELECT candidate_id, a.source AS left_source, a.amount AS left_amount, a.booking_date AS left_day, b.source AS right_source, b.amount AS right_amount, b.booking_date AS right_day FROM candidates c JOIN raws a ON a.raw_id = c.left_raw_id JOIN raws b ON b.raw_id = c.right_raw_id")
def candidate_details(spark, d):
    return records.candidate_details(load(spark, d, "candidates"), load(spark, d, "raws")).select("candidate_id", "left_source", "left_amount", "left_day", "right_source", "right_amount", "right_day")


@query("candidate_distribution", f"WITH {ctes('candidates')} SELECT status, confidence, is_ambiguous, count(*) AS n_rows FROM candidates GROUP BY ALL")
def candidate_distribution(spark, d):
    return load(spark, d, "candidates").groupBy("status", "confidence", "is_ambiguous").agg(F.count("*").alias("n_rows"))


@query("import_history", f"WITH {ctes('raws', 'links', 'batches')} SELECT batch_id, count(raw_id) AS n_rows, count(l.canonical_id) AS n_linked, min(booking_date) AS first_day, max(booking_date) AS last_day FROM batches LEFT JOIN raws ON import_batch_id = batch_id LEFT JOIN links l USING (raw_id) GROUP BY batch_id")
def import_history(spark, d):
    return records.import_history(load(spark, d, "batches"), load(spark, d, "raws"), load(spark, d, "links")).select("batch_id", "n_rows", "n_linked", "first_day", "last_day")


@query("new_batches", f"WITH {ctes('batches')} SELECT batch_id, file_hash FROM batches WHERE file_hash NOT IN (SELECT file_hash FROM batches WHERE batch_id = 'b3') QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY imported_at, batch_id) = 1")
def new_batches(spark, d):
    batches = load(spark, d, "batches")
    return records.new_batches(batches, batches.where("batch_id = 'b3'")).select("batch_id", "file_hash")


_UPSERT = "kn AS (SELECT raw_id, source || amount || booking_date AS key FROM raws WHERE raw_row_number % 4 = 0), ar AS (SELECT raw_id, source || amount || booking_date AS key, import_batch_id FROM raws WHERE raw_row_number % 4 <> 0), nw AS (SELECT * FROM ar WHERE key NOT IN (SELECT key FROM kn) QUALIFY row_number() OVER (PARTITION BY key ORDER BY raw_id) = 1)"


def _upsert(spark, d):
    rows = load(spark, d, "raws").withColumn("key", F.concat("source", F.col("amount").cast("string"), F.col("booking_date").cast("string")))
    known = observations.preferred(rows.where("raw_row_number % 4 = 0"), ["key"], [F.col("raw_id")])
    return records.upsert_raws(known, rows.where("raw_row_number % 4 <> 0"))


@query("upserted_rows", f"WITH {ctes('raws')}, {_UPSERT} SELECT raw_id, key FROM nw")
def upserted_rows(spark, d):
    return _upsert(spark, d)[0].select("raw_id", "key")


@query("import_occurrences", f"WITH {ctes('raws')}, {_UPSERT}, sd AS (SELECT key, min(raw_id) AS stored_id FROM kn GROUP BY key UNION ALL SELECT key, raw_id FROM nw) SELECT ar.raw_id, import_batch_id, stored_id, ar.raw_id = stored_id AS is_new FROM ar JOIN sd USING (key)")
def import_occurrences(spark, d):
    return _upsert(spark, d)[1].select("raw_id", "import_batch_id", "stored_id", "is_new")


@query("canonicals_from_rows", f"WITH {ctes('raws')}, {_PARTY} SELECT sha256('canonical|' || raw_id) AS canonical_id, raw_id, amount, party AS normalized_merchant, CASE direction WHEN 'income' THEN 'INCOME' WHEN 'expense' THEN 'EXPENSE' ELSE 'UNKNOWN' END AS tx_type FROM raws JOIN party USING (raw_id)")
def canonicals_from_rows(spark, d):
    return records.canonical_from(load(spark, d, "raws")).select("canonical_id", "raw_id", "amount", "normalized_merchant", "tx_type")


@query("canonicals_from_matches", f"WITH {ctes('raws', 'candidates')} SELECT sha256('match|' || left_raw_id || '|' || right_raw_id) AS canonical_id, a.transaction_time, a.amount, a.merchant, a.source AS payment_channel, b.source_account AS funding_account, confidence FROM candidates JOIN raws a ON a.raw_id = left_raw_id JOIN raws b ON b.raw_id = right_raw_id WHERE candidates.status = 'confirmed'")
def canonicals_from_matches(spark, d):
    out = records.canonical_from_match(load(spark, d, "candidates").where("status = 'confirmed'"), load(spark, d, "raws"))
    return out.select("canonical_id", "transaction_time", "amount", "merchant", "payment_channel", "funding_account", "confidence")


_EDITS = "ed AS (SELECT 'C' || (event_id % 700) AS canonical_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'error' THEN 'restore' ELSE 'update' END AS action, CASE WHEN event_id % 2 = 0 THEN 'cat' || (event_id % 5) END AS category, CASE WHEN event_id % 3 = 0 THEN 'note' || (event_id % 4) END AS notes FROM events)"


@query("canonical_versions", f"""WITH {ctes('canonicals')}, {_EDITS}, lt AS (SELECT canonical_id, arg_max(category, seq) FILTER (category IS NOT NULL) AS c, arg_max(notes, seq) FILTER (notes IS NOT NULL) AS n, arg_max(action, seq) FILTER (action IN ('delete', 'restore')) AS a FROM ed GROUP BY 1)
SELECT canonical_id, coalesce(c, category) AS category, coalesce(n, notes) AS notes, amount FROM canonicals LEFT JOIN lt USING (canonical_id) WHERE a IS NULL OR a <> 'delete'""")
def canonical_versions(spark, d):
    e = F.col("event_id")
    action = T.first_of([(F.col("event_type") == "purchase", F.lit("delete")), (F.col("event_type") == "error", F.lit("restore"))], F.lit("update"))
    edits = B.table(spark, d, "events").select(F.concat(F.lit("C"), e % 700).alias("canonical_id"), e.alias("seq"), action.alias("action"), F.when(e % 2 == 0, F.concat(F.lit("cat"), e % 5)).alias("category"), F.when(e % 3 == 0, F.concat(F.lit("note"), e % 4)).alias("notes"))
    return records.versions(load(spark, d, "canonicals"), edits, ["category", "notes"]).select("canonical_id", "category", "notes", "amount")


_SNAP = "ls AS (SELECT source, source_account, balance_kind, as_of, balance FROM snapshots QUALIFY row_number() OVER (PARTITION BY source, source_account, balance_kind ORDER BY as_of DESC, seq DESC) = 1)"


@query("latest_snapshots", f"WITH {ctes('snapshots')}, {_SNAP} SELECT * FROM ls")
def latest_snapshots(spark, d):
    return records.latest_snapshots(load(spark, d, "snapshots"))


_CASH = """rk AS (SELECT source_account AS account, booking_date AS day, balance, coalesce(bank_card_suffix, '') AS suffix FROM raws WHERE source = 'bank' AND balance IS NOT NULL AND booking_date < DATE '1998-01-01' QUALIFY row_number() OVER (PARTITION BY source_account ORDER BY booking_date DESC, coalesce(transaction_time::VARCHAR, '') DESC, raw_row_number DESC, raw_id DESC) = 1),
pd AS (SELECT account, sum(amount) AS adj, max(booking_date) AS till FROM rk JOIN raws ON source IN ('wechat', 'alipay') AND ((suffix <> '' AND bank_card_suffix = suffix) OR contains(payment_method, account)) AND booking_date > day AND amount <> 0 GROUP BY account),
cash AS (SELECT account, balance AS statement_balance, coalesce(adj, 0)::DECIMAL(18,2) AS pending_adjustment, (balance + coalesce(adj, 0))::DECIMAL(18,2) AS balance, coalesce(till, day) AS as_of FROM rk LEFT JOIN pd USING (account))"""


def _cash(spark, d):
    return records.bank_cash(load(spark, d, "raws").where("source <> 'bank' or booking_date < date'1998-01-01'"))


@query("bank_cash", f"WITH {ctes('raws')}, {_CASH} SELECT * FROM cash")
def bank_cash(spark, d):
    return _cash(spark, d)


_PRODUCTS = """pr0 AS (SELECT source_account || CASE WHEN description IN ('朝朝宝转入', '朝朝宝转出') THEN '朝朝宝' ELSE '天天盈' END AS account, CASE WHEN description IN ('朝朝宝转入', '朝朝宝转出') THEN -amount ELSE abs(amount) END AS m, booking_date FROM raws
  WHERE source = 'bank' AND (description IN ('朝朝宝转入', '朝朝宝转出') OR (contains(source_account, '工商银行') AND description = '基金购买' AND NOT contains(counterparty, '基金销售')))),
products AS (SELECT account, sum(m)::DECIMAL(18,2) AS balance, max(booking_date) AS as_of FROM pr0 WHERE account NOT IN (SELECT source_account FROM snapshots) GROUP BY account HAVING sum(m) <> 0)"""


@query("product_positions", f"WITH {ctes('raws', 'snapshots')}, {_PRODUCTS} SELECT * FROM products")
def product_positions(spark, d):
    return records.product_positions(load(spark, d, "raws"), load(spark, d, "snapshots"))


@query("account_totals", f"""WITH {ctes('raws', 'snapshots')}, {_SNAP}, {_CASH}, {_PRODUCTS}, t AS (SELECT (SELECT sum(balance) FROM cash) AS c, (SELECT sum(balance) FROM products) AS p, (SELECT sum(balance) FROM ls WHERE balance_kind <> 'credit_limit') AS s)
SELECT c::DECIMAL(18,2) AS cash_total, p::DECIMAL(18,2) AS internal_product_total, s::DECIMAL(18,2) AS snapshot_total, (c + p + s)::DECIMAL(18,2) AS known_balance, greatest((SELECT max(as_of) FROM cash), (SELECT max(as_of) FROM products), (SELECT max(as_of) FROM ls)) AS as_of FROM t""")
def account_totals(spark, d):
    return records.account_totals(_cash(spark, d), product_positions(spark, d), latest_snapshots(spark, d))


_CLOSURE = f"""{_SNAP}, {_CASH}, {_PRODUCTS}, wl AS (SELECT source_account, sum(amount)::DECIMAL(18,2) AS projected, CASE WHEN source_account <> 'u7' THEN sum(amount)::DECIMAL(18,2) END AS actual FROM raws WHERE source = 'wechat' GROUP BY 1),
cl AS (SELECT ((SELECT sum(balance) FROM cash) + (SELECT sum(projected) FROM wl) + (SELECT sum(balance) FROM products) + 12.5)::DECIMAL(18,2) AS computed_total, ((SELECT sum(balance) FROM cash) + (SELECT sum(actual) FROM wl) + (SELECT sum(balance) FROM products) + 12.5)::DECIMAL(18,2) AS known_total)"""


def _wallets(spark, d):
    total = F.sum("amount").cast("decimal(18,2)")
    return load(spark, d, "raws").where("source = 'wechat'").groupBy("source_account").agg(total.alias("projected")).withColumn("actual", F.when(F.col("source_account") != "u7", F.col("projected")))


def _closure(spark, d):
    pending = spark.range(1).select(F.lit("12.50").cast("decimal(18,2)").alias("amount"))
    return records.asset_closure(_cash(spark, d), _wallets(spark, d), product_positions(spark, d), pending)


@query("asset_closure", f"WITH {ctes('raws', 'snapshots')}, {_CLOSURE} SELECT *, (known_total - computed_total)::DECIMAL(18,2) AS difference FROM cl")
def asset_closure(spark, d):
    return _closure(spark, d)


@query("verified_change", f"WITH {ctes('raws', 'snapshots')}, {B.INTERVALS.strip().removeprefix('WITH')}, {_CLOSURE} SELECT CASE WHEN (SELECT count(*) FROM iv WHERE status <> 'ok' OR (previous IS NULL AND balance <> amount)) = 0 AND (SELECT count(*) FROM wl WHERE actual IS NULL OR actual <> projected) = 0 THEN known_total END AS asset_change FROM cl")
def verified_change(spark, d):
    rows = B.statement(spark, d)
    return records.verified_change(intervals.interval_reconciliation(rows, B.canonical_sides(rows)), _wallets(spark, d), _closure(spark, d))


@query("verified_change_closed", f"""WITH {ctes('raws', 'snapshots')}, {B.INTERVALS.strip().removeprefix('WITH')}, {_CLOSURE}, s2 AS (SELECT account, amount, sum(amount) OVER w AS balance, sum(amount) OVER w - amount AS p, row_number() OVER w AS k FROM st WINDOW w AS (PARTITION BY account ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING))
SELECT CASE WHEN (SELECT count(*) FROM s2 WHERE balance - p <> amount OR (k = 1 AND balance <> amount)) = 0 AND (SELECT count(*) FROM wl WHERE projected IS NULL) = 0 THEN known_total END AS asset_change FROM cl""")
def verified_change_closed(spark, d):
    """The same gate where every chain closes: balances without their faults, and wallets that hold what was projected."""
    rows = B.statement(spark, d).withColumn("balance", (F.col("balance") - F.when(F.col("row_id") % 97 == 0, 1).otherwise(0)).cast("decimal(18,2)"))
    sides = rows.select("row_id", F.col("row_id").alias("canonical_id"), F.col("amount").alias("canonical_amount"))
    return records.verified_change(intervals.interval_reconciliation(rows, sides), _wallets(spark, d).withColumn("actual", F.col("projected")), _closure(spark, d))


_COUNTED = ("candidates", "canonicals", "deletions", "links", "raws")


@query("table_counts", f"WITH {ctes(*_COUNTED)} " + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in _COUNTED))
def table_counts(spark, d):
    return records.table_counts({t: load(spark, d, t) for t in _COUNTED})


@query("session_counts", f"WITH {ctes('candidates')} SELECT right_raw_id[1:3] AS session, count(*) AS n_items, count(*) FILTER (status = 'pending') AS n_pending FROM candidates GROUP BY 1")
def session_counts(spark, d):
    rows = load(spark, d, "candidates").groupBy(F.substring("right_raw_id", 1, 3).alias("session"))
    return rows.agg(F.count("*").alias("n_items"), F.count_if(F.col("status") == "pending").alias("n_pending"))


_DECIDED = f"""WITH {ctes('relationships', 'canonicals')}, k AS (SELECT *, relationship_id[2:]::BIGINT AS n FROM relationships),
rel AS (SELECT relationship_id, from_id, to_id, amount, status FROM k UNION ALL SELECT 'S' || n, from_id, 'C' || (n + 8), floor(amount / 2)::DECIMAL(18,2), 'pending' FROM k),
rf AS (SELECT rel.*, relationship_id[2:]::BIGINT AS n, abs(c.amount) AS paid, EXISTS (SELECT 1 FROM rel x WHERE x.from_id = rel.from_id AND x.status = 'confirmed') AS linked FROM rel LEFT JOIN canonicals c ON c.canonical_id = rel.to_id),
dec AS (SELECT relationship_id, n AS seq, ['confirm', 'reject', 'exclude', 'confirm'][n // 8 % 4 + 1] AS decision, 'u1' AS actor FROM rf WHERE (relationship_id[1] = 'R') = (n // 32 % 2 = 0) UNION ALL SELECT 'X' || n, n, 'confirm', 'u1' FROM rf WHERE n % 40 = 1 AND relationship_id[1] = 'R'),
jd AS (SELECT dec.*, rf.from_id, CASE WHEN rf.status IS NULL THEN 'unknown relationship' WHEN rf.status <> 'pending' THEN 'decided already' WHEN decision = 'confirm' AND linked THEN 'refund linked already' WHEN decision = 'confirm' AND paid IS NULL THEN 'no original' WHEN decision = 'confirm' AND amount > paid THEN 'beyond the original' END AS fault FROM dec LEFT JOIN rf USING (relationship_id)),
ev AS (SELECT rel.relationship_id, jd.actor, 'pending' AS before, CASE WHEN rel.relationship_id = jd.relationship_id THEN CASE decision WHEN 'confirm' THEN 'confirmed' ELSE 'rejected' END WHEN decision = 'confirm' THEN 'superseded' WHEN decision = 'exclude' THEN 'rejected' END AS after FROM rel JOIN jd ON rel.from_id = jd.from_id AND jd.fault IS NULL AND rel.status = 'pending')
"""


def _decided(spark, d):
    """A second choice for every refund, and a decision on one of both; some decisions name no relationship."""
    from ledgerloom.operators import refund_decisions

    rows = load(spark, d, "relationships").select("relationship_id", "from_id", "to_id", "amount", "status")
    n = F.expr("cast(substring(relationship_id, 2) as bigint)")
    other = rows.select(F.concat(F.lit("S"), n).alias("relationship_id"), "from_id", F.concat(F.lit("C"), n + 8).alias("to_id"), F.floor(F.col("amount") / 2).cast("decimal(18,2)").alias("amount"), F.lit("pending").alias("status"))
    both = rows.unionByName(other)
    what = F.element_at(F.array(*map(F.lit, ["confirm", "reject", "exclude", "confirm"])), (F.floor(n / 8) % 4 + 1).cast("int"))
    asked = both.where(F.startswith("relationship_id", F.lit("R")) == (F.floor(n / 32) % 2 == 0)).select("relationship_id", n.alias("seq"), what.alias("decision"), F.lit("u1").alias("actor"))
    lost = rows.where(n % 40 == 1).select(F.concat(F.lit("X"), n).alias("relationship_id"), n.alias("seq"), F.lit("confirm").alias("decision"), F.lit("u1").alias("actor"))
    return both, refund_decisions.judged(both, load(spark, d, "canonicals"), asked.unionByName(lost))


@query("refund_decisions", _DECIDED + "SELECT * FROM jd")
def refund_decisions(spark, d):
    return _decided(spark, d)[1]


@query("refund_events", _DECIDED + "SELECT * FROM ev WHERE after IS NOT NULL")
def refund_events(spark, d):
    from ledgerloom.operators import refund_decisions

    return refund_decisions.refund_events(*_decided(spark, d))


@query("refunds_decided", _DECIDED + "SELECT rel.relationship_id, rel.from_id, rel.to_id, rel.amount, coalesce(ev.after, rel.status) AS status FROM rel LEFT JOIN ev ON ev.relationship_id = rel.relationship_id AND ev.after IS NOT NULL")
def refunds_decided(spark, d):
    from ledgerloom.operators import refund_decisions

    both, decided = _decided(spark, d)
    return refund_decisions.after_decisions(both, refund_decisions.refund_events(both, decided))


@query("refunds_excluded", _DECIDED + "SELECT from_id AS canonical_id, actor FROM jd WHERE fault IS NULL AND decision = 'exclude'")
def refunds_excluded(spark, d):
    from ledgerloom.operators import refund_decisions

    return refund_decisions.excluded_refunds(_decided(spark, d)[1])


@query("searched_texts", f"WITH {ctes('canonicals')} SELECT canonical_id FROM canonicals WHERE merchant ILIKE '%kfc%' OR normalized_merchant ILIKE '%kfc%' OR notes ILIKE '%kfc%' OR merchant ILIKE '%公付%' OR normalized_merchant ILIKE '%公付%' OR notes ILIKE '%公付%'")
def searched_texts(spark, d):
    from ledgerloom.operators import statistics

    rows = load(spark, d, "canonicals")
    return statistics.search_texts(rows, "kfc").union(statistics.search_texts(rows, "公付")).select("canonical_id").distinct()


def _exact(spark, d):
    rows = load(spark, d, "raws").where("source <> 'bank'")
    refund = (F.col("amount") > 0) & (F.col("status") == "退款成功")
    rows = rows.select(F.lit("o").alias("owner"), "raw_id", "transaction_time", "amount", "merchant", refund.alias("is_refund"), (F.col("status") == "交易关闭").alias("closed"), F.expr("cast(substring(raw_id, 2) as bigint)").alias("seq"))
    return rows.withColumnsRenamed({"raw_id": "row_id", "transaction_time": "at", "merchant": "party"})


@query("exact_refunds")
def exact_refunds(spark, d):
    """Refunds take originals up in order, so there is no SQL for the pairs."""
    from ledgerloom.operators import refunds

    return refunds.exact_refunds(_exact(spark, d))


@query("exact_refund_report")
def exact_refund_report(spark, d):
    from ledgerloom.operators import refunds

    rows = _exact(spark, d)
    return refunds.exact_refund_report(rows, refunds.exact_refunds(rows), rows.where("closed"))
