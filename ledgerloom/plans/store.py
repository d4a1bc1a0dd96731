"""Ledger tables made of the provided test tables: each is one SELECT, rendered for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Texts that rows pick from by their key.
_LISTS = {
    "MERCHANT": ["支付宝-星巴克咖啡", "滴滴快车", "美团点评", "沃尔玛超市", "麦当劳餐厅", "微信支付-全家便利店", "退款-沃尔玛超市", "KFC (8)", "高德打车", "朝阳书店有限公司"],
    "BANKSAID": ["财付通-沃尔玛超市", "支付宝-星巴克咖啡", "快捷支付", "网联-滴滴出行(12)", "全家便利店 退款", "朝朝宝转入", "银联-朝阳书店(3)", "基金购买"],
    "TEXT": ["消费", "转账到银行卡", "退款成功", "零钱充值", "打车", "", "充值完成"],
    "METHOD": ["招商银行(9001)", "零钱", "余额", "工商银行储蓄卡(9002)", "", "余额&招商银行(9001)"],
    "STATUS": ["支付成功", "交易成功", "退款成功", "交易关闭", "提现已到账"],
    "ACCOUNT": ["招商银行", "工商银行", "重庆农村商业银行"],
    "FUND": ["余额", "招商银行(9001)", "微信零钱", "工商银行"],
    "NOTE": ["", "预授权", "信用卡还款", "因公付", "书", "朝朝宝转入"],
    "TYPE": ["INCOME", "REFUND", "TRANSFER", "UNKNOWN", "INVESTMENT", "EXPENSE", "EXPENSE", "EXPENSE"],
    "STATE": ["pending", "confirmed", "rejected", "superseded"],
    "KIND": ["cash", "investment", "credit_limit"],
    "SOURCE": ["alipay", "wechat", "bank"],
}

_K, _C = "o_orderkey", "o_custkey"
_AMOUNT = "CAST(CASE WHEN o_orderkey % 9 IN (0, 1) THEN 1 ELSE -1 END * (floor(o_totalprice / 50000) * 50 + 9.9) AS DECIMAL(18,2))"
_AT = f"o_orderdate + SECS(({_K} * 37) % 86000)"
_BANK_AT = f"o_orderdate + SECS(({_K} * 37) % 86000 + ({_K} * 7) % 300)"

_TABLES = {
    "raws": f"""
SELECT 'W' || {_K} AS raw_id, CASE WHEN {_K} % 2 = 0 THEN 'alipay' ELSE 'wechat' END AS source, 'u' || ({_C} % 50) AS source_account, {_AT} AS transaction_time, CAST({_AT} AS DATE) AS booking_date,
  {_AMOUNT} AS amount, CASE {_K} % 9 WHEN 0 THEN 'income' WHEN 1 THEN 'neutral' ELSE 'expense' END AS direction, PICK(MERCHANT, {_C}) AS merchant, PICK(MERCHANT, {_C}) AS counterparty, PICK(TEXT, {_K}) AS description,
  PICK(METHOD, {_K}) AS payment_method, CASE WHEN {_K} % 6 IN (0, 3, 5) THEN CAST(9000 + {_C} % 3 AS STRING) END AS bank_card_suffix, 'T' || {_K} AS transaction_id, 'O' || ({_K} % 1000) AS merchant_order_id,
  PICK(STATUS, {_K}) AS status, CAST(NULL AS DECIMAL(18,2)) AS balance, 'f' || ({_K} % 4) AS source_file, {_K} AS raw_row_number, 'b' || ({_K} % 6) AS import_batch_id
FROM orders WHERE {_K} % 5 <> 0
UNION ALL
SELECT 'B' || {_K}, 'bank', PICK(ACCOUNT, {_C}), CASE WHEN {_K} % 4 <> 0 THEN {_BANK_AT} END, CAST({_BANK_AT} AS DATE),
  {_AMOUNT}, CASE WHEN {_K} % 9 IN (0, 1) THEN 'income' ELSE 'expense' END, PICK(BANKSAID, {_C}), PICK(BANKSAID, {_C}), PICK(BANKSAID, {_K}),
  PICK(ACCOUNT, {_C}), CAST(9000 + {_C} % 3 AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), '', CASE WHEN {_K} % 7 <> 0 THEN CAST({_K} % 200 AS DECIMAL(18,2)) END, 'g' || ({_K} % 4), {_K}, 'b' || ({_K} % 6)
FROM orders WHERE {_K} % 5 <> 1""",
    "canonicals": f"""
SELECT 'C' || {_K} AS canonical_id, CASE WHEN {_K} % 6 <> 0 THEN {_AT} END AS transaction_time, CAST(o_orderdate AS DATE) AS booking_date,
  CAST(CASE WHEN {_K} % 8 IN (0, 1) THEN 1 ELSE -1 END * o_totalprice AS DECIMAL(18,2)) AS amount, PICK(MERCHANT, {_C}) AS merchant, PICK(MERCHANT, {_C}) AS normalized_merchant,
  CASE WHEN {_K} % 13 = 0 THEN '' ELSE o_orderpriority END AS category, PICK(SOURCE, {_K}) AS payment_channel, PICK(FUND, {_K}) AS funding_account, PICK(TYPE, {_K}) AS tx_type, PICK(STATUS, {_K}) AS status, PICK(NOTE, {_C}) AS notes
FROM orders""",
    "links": f"""
SELECT 'C' || {_K} AS canonical_id, 'W' || {_K} AS raw_id, CAST(0.95 AS DECIMAL(4,2)) AS confidence FROM orders WHERE {_K} % 5 <> 0
UNION ALL SELECT 'C' || {_K}, 'B' || {_K}, CAST(0.90 AS DECIMAL(4,2)) FROM orders WHERE {_K} % 5 <> 1 AND {_K} % 3 = 0""",
    "relationships": f"""
SELECT 'R' || {_K} AS relationship_id, 'C' || {_K} AS from_id, 'C' || ({_K} + 4) AS to_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, PICK(STATE, {_K} // 8) AS status, {_K} % 5 = 0 AS is_ambiguous,
  {_K} % 3 = 0 AS is_partial, {_K} % 11 = 0 AS acknowledged, CAST(CASE WHEN {_K} % 3 = 0 THEN 0.75 ELSE 0.90 END AS DECIMAL(4,2)) AS confidence, o_orderdate AS created_at FROM orders WHERE {_K} % 8 = 1""",
    "classifications": f"""
SELECT 'K' || {_K} AS candidate_id, 'C' || {_K} AS canonical_id, PICK(TYPE, {_K} // 7) AS proposed_type, PICK(STATE, {_K} // 7) AS status, CAST(0.5 + ({_K} % 50) / 100.0 AS DECIMAL(4,2)) AS confidence, o_orderdate AS created_at
FROM orders WHERE {_K} % 7 = 0""",
    "candidates": f"""
SELECT 'M' || {_K} AS candidate_id, 'W' || {_K} AS left_raw_id, 'B' || ({_K} - {_K} % 6) AS right_raw_id, PICK(STATE, {_K} // 3) AS status, CAST(0.5 + ({_K} % 50) / 100.0 AS DECIMAL(4,2)) AS confidence, {_K} % 4 = 0 AS is_ambiguous,
  o_orderdate AS created_at FROM orders WHERE {_K} % 3 = 0""",
    "deletions": f"SELECT 'C' || {_K} AS canonical_id, o_orderdate + SECS({_K}) AS deleted_at, 'a' || ({_K} % 3) AS deleted_by FROM orders WHERE {_K} % 50 = 0",
    "snapshots": """
SELECT PICK(SOURCE, c_custkey) AS source, 'u' || (c_custkey % 50) AS source_account, PICK(KIND, c_custkey // 3) AS balance_kind, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, DATE '1998-01-01' + CAST(c_custkey % 400 AS INT) AS as_of, c_custkey AS seq
FROM customer""",
    "changes": """
SELECT 'M' || (user_id % 300) AS candidate_id, event_id AS seq, ts AS happened_at, CASE event_type WHEN 'click' THEN 'confirm' WHEN 'purchase' THEN 'reject' WHEN 'error' THEN 'supersede' ELSE 'note' END AS action, 'a' || (event_id % 4) AS actor FROM events""",
    "batches": f"SELECT 'b' || {_K} AS batch_id, 'h' || ({_K} % 5) AS file_hash, o_orderdate AS imported_at, PICK(SOURCE, {_K}) AS source FROM orders WHERE {_K} < 6",
}


def _render(sql: str, spark: bool) -> str:
    def pick(m: re.Match) -> str:
        words = ", ".join(f"'{w}'" for w in _LISTS[m[1]])
        at = f"{m[2]} % {len(_LISTS[m[1]])} + 1"
        return f"element_at(array({words}), CAST({at} AS INT))" if spark else f"([{words}])[{at}]"

    def seconds(text: str) -> str:  # SECS(x), x with brackets of its own
        while (at := text.find("SECS(")) >= 0:
            depth, end = 1, at + 5
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            inner = text[at + 5 : end - 1]
            new = f"make_dt_interval(0, 0, 0, CAST({inner} AS DECIMAL(18,6)))" if spark else f"to_seconds({inner})"
            text = text[:at] + new + text[end:]
        return text

    out = re.sub(r"PICK\((\w+), ((?:\w+)(?: // \d+)?)\)", pick, seconds(sql))
    return out.replace("//", "div") if spark else out.replace("AS STRING", "AS VARCHAR")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the ledger tables, made of the test tables in sf_dir."""
    sql = re.sub(r"\bFROM (orders|customer|events)\b", r"FROM {\1}", _render(_TABLES[name], True))
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **base)


def ctes(*names: str) -> str:
    """The same tables as common table expressions, for DuckDB."""
    return ",\n".join(f"{n} AS ({_render(_TABLES[n], False)})" for n in names)
