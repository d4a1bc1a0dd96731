"""Registered queries of review sessions, keyword tables, page geometry, sign inference and statement adapters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import balances, keywords, sessions
from ledgerloom.plans import bridge as B
from ledgerloom.plans.registry import Registry
from ledgerloom.plans.store import ctes, load
from ledgerloom.sources import adapters, captures, geometry, statements

query = Registry()


def _n():
    return F.expr("cast(substring(raw_id, 2) as bigint)")



def _items(spark, d):
    """Wallet rows are observed, every third of them for the first time; every seventh bank row is missing. Some rows have no canonical row yet."""
    raws = load(spark, d, "raws").select("raw_id", "import_batch_id", "source", F.col("booking_date").cast("timestamp_ntz").alias("at"))
    observed = raws.where("source <> 'bank'").withColumn("is_new", _n() % 3 == 0)
    return sessions.review_items(observed, raws.where((F.col("source") == "bank") & (_n() % 7 == 0)), load(spark, d, "links").where(_n() % 4 != 1))


def _decisions(items):
    """Two decisions for every second item of a batch other than b0, where each item has one; some unknown, some of no item."""
    n = F.expr("cast(substring(raw_id, 2) as bigint)")
    what = lambda k: F.when(n % 4 == k % 4, "confirmed").when(n % 4 == (k + 1) % 4, "rejected").when(n % 4 == (k + 2) % 4, "modified").otherwise("maybe")
    one = items.where((n % 2 == 0) | (n % 6 == 0)).select("review_item_id", n.alias("seq"), what(0).alias("decision"), F.lit("u1").alias("actor"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("at"))
    two = items.where(n % 2 == 0).select("review_item_id", (n + 10_000_000).alias("seq"), what(2).alias("decision"), F.lit("u2").alias("actor"), (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("at"))
    lost = items.where(n % 50 == 0).select(F.concat(F.lit("x"), "review_item_id").alias("review_item_id"), n.alias("seq"), F.lit("confirmed").alias("decision"), F.lit("u1").alias("actor"), F.col("created_at").alias("at"))
    return one.unionByName(two).unionByName(lost)


_REVIEW = f"""WITH {ctes('raws', 'links')}, l AS (SELECT raw_id, min(canonical_id) AS canonical_id FROM links WHERE raw_id[2:]::BIGINT % 4 <> 1 GROUP BY raw_id),
b AS (SELECT raws.raw_id, raw_id[2:]::BIGINT AS n, import_batch_id, source, booking_date::TIMESTAMP AS "at", canonical_id FROM raws LEFT JOIN l USING (raw_id)),
it AS (SELECT sha256('session|' || import_batch_id) AS session_id, raw_id, n, canonical_id, "at" AS created_at, CASE WHEN source = 'bank' THEN 'existing_missing_from_import' ELSE CASE WHEN n % 3 = 0 THEN 'new_' ELSE 'existing_' END || CASE WHEN canonical_id IS NULL THEN 'unmatched' ELSE 'linked' END END AS item_type
  FROM b WHERE source <> 'bank' OR n % 7 = 0),
items AS (SELECT session_id, sha256(session_id || '|' || raw_id) AS review_item_id, raw_id, n, canonical_id, item_type, created_at FROM it),
dc AS (SELECT review_item_id, n AS seq, ['confirmed', 'rejected', 'modified', 'maybe'][n % 4 + 1] AS decision, 'u1' AS actor, created_at + INTERVAL 1 DAY AS "at", true AS there FROM items WHERE n % 2 = 0 OR n % 6 = 0
  UNION ALL SELECT review_item_id, n + 10000000, ['modified', 'maybe', 'confirmed', 'rejected'][n % 4 + 1], 'u2', created_at + INTERVAL 2 DAY, true FROM items WHERE n % 2 = 0
  UNION ALL SELECT 'x' || review_item_id, n, 'confirmed', 'u1', created_at, false FROM items WHERE n % 50 = 0),
lw AS (SELECT *, there AND decision <> 'maybe' AS lawful FROM dc), nt AS (SELECT *, coalesce(first_value(CASE WHEN lawful THEN decision END IGNORE NULLS) OVER (PARTITION BY review_item_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'pending') AS before FROM lw),
ev AS (SELECT review_item_id, seq, decision, actor, "at", before, CASE WHEN NOT there THEN 'unknown item' WHEN decision = 'maybe' THEN 'unknown decision' WHEN before <> 'pending' THEN 'already decided' END AS fault FROM nt),
st AS (SELECT items.*, coalesce(ev.decision, 'pending') AS status, ev.actor AS reviewed_by, ev."at" AS reviewed_at FROM items LEFT JOIN ev ON ev.review_item_id = items.review_item_id AND ev.fault IS NULL)
"""


@query("review_items", _REVIEW + "SELECT session_id, review_item_id, raw_id, canonical_id, item_type, created_at FROM items")
def review_items(spark, d):
    return _items(spark, d)


@query("review_events", _REVIEW + "SELECT *, CASE WHEN fault IS NULL THEN decision ELSE before END AS after FROM ev")
def review_events(spark, d):
    items = _items(spark, d)
    return sessions.judged(items, _decisions(items))


@query("review_item_states", _REVIEW + "SELECT review_item_id, item_type, status, reviewed_by, reviewed_at FROM st")
def review_item_states(spark, d):
    items = _items(spark, d)
    return sessions.item_states(items, sessions.judged(items, _decisions(items))).select("review_item_id", "item_type", "status", "reviewed_by", "reviewed_at")


@query("review_sessions", _REVIEW + """SELECT session_id, min(created_at) AS created_at, count(*) AS n_items, count(*) FILTER (status = 'pending') AS n_pending, CASE WHEN count(*) FILTER (status = 'pending') = 0 THEN 'completed' ELSE 'pending' END AS status,
  CASE WHEN count(*) FILTER (status = 'pending') = 0 THEN max(reviewed_at) END AS completed_at FROM st GROUP BY session_id""")
def review_sessions(spark, d):
    items = _items(spark, d)
    return sessions.session_states(sessions.item_states(items, sessions.judged(items, _decisions(items))))


@query("review_bulk", f"{_REVIEW}, {ctes('candidates')} SELECT raw_id FROM st WHERE status = 'pending' AND item_type IN ('new_unmatched', 'existing_unmatched') AND raw_id NOT IN (SELECT left_raw_id FROM candidates WHERE status = 'pending' UNION SELECT right_raw_id FROM candidates WHERE status = 'pending')")
def review_bulk(spark, d):
    items = _items(spark, d)
    states = sessions.item_states(items, sessions.judged(items, _decisions(items)))
    return sessions.bulk_confirmable(states, load(spark, d, "candidates")).select("raw_id")


@query("review_snapshots", f"""{_REVIEW}, {ctes('canonicals')}, v AS (SELECT canonical_id, booking_date::TIMESTAMP - INTERVAL 5 DAY AS "at", category FROM canonicals UNION ALL SELECT canonical_id, booking_date::TIMESTAMP + to_days((canonical_id[2:]::BIGINT % 3)::INT), 'later' FROM canonicals)
SELECT review_item_id, raws.merchant AS persisted, CASE WHEN item_type <> 'existing_missing_from_import' THEN CASE WHEN n % 5 = 0 THEN 'told' ELSE raws.merchant END END AS imported,
  (SELECT arg_max(category, v."at") FROM v WHERE v.canonical_id = items.canonical_id AND v."at" <= created_at) AS affected FROM items JOIN raws USING (raw_id)""")
def review_snapshots(spark, d):
    items, rows = _items(spark, d), load(spark, d, "canonicals")
    day, n = F.col("booking_date").cast("timestamp_ntz"), F.expr("cast(substring(canonical_id, 2) as int)")
    versions = rows.select("canonical_id", (day - F.expr("INTERVAL 5 DAYS")).alias("created_at"), "category")
    versions = versions.unionByName(rows.select("canonical_id", (day + F.make_dt_interval(n % 3)).cast("timestamp_ntz").alias("created_at"), F.lit("later").alias("category")))
    told = items.where(_n() % 5 == 0).select("review_item_id", F.lit("told").alias("merchant"))
    out = sessions.hydrated(items, load(spark, d, "raws"), told, versions, ["merchant"], ["category"])
    return out.select("review_item_id", F.col("persisted.merchant").alias("persisted"), F.col("imported.merchant").alias("imported"), F.col("affected.category").alias("affected"))


_WORDS = """w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark), kw AS (SELECT row_number() OVER (ORDER BY md5(word)) AS nth, word FROM w)"""


@query("keyword_accounts", f"WITH {_WORDS}, t AS (SELECT doc_id AS row_id, lower(text) AS t FROM documents), h AS (SELECT row_id, min(nth) AS nth FROM t JOIN kw ON contains(t, word) GROUP BY row_id) SELECT row_id, coalesce('Expenses:' || length(word), 'Expenses:Unknown') AS account FROM t LEFT JOIN h USING (row_id) LEFT JOIN kw USING (nth)")
def keyword_accounts(spark, d):
    """Every word of the benchmark is a keyword, documents are the texts."""
    from pyspark.sql import Window

    words = B.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).distinct()
    table = words.withColumn("nth", F.row_number().over(Window.orderBy(F.md5("word")))).withColumn("account", F.concat(F.lit("Expenses:"), F.char_length("word")))
    return keywords.first_keyword(B.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text"), table, "Expenses:Unknown")


@query("signed_chain", f"""WITH {B.STATEMENT}, x AS (SELECT account, ts, row_id, abs(amount) AS amount, balance, kind IN ('purchase', 'error') AS spends, lag(balance) OVER (PARTITION BY account ORDER BY ts, row_id) AS previous FROM st),
y AS (SELECT *, CASE WHEN previous IS NULL THEN CASE WHEN spends THEN 'first' ELSE 'unsolved' END WHEN balance - previous = amount THEN 'plus' WHEN balance - previous = -amount THEN 'minus' WHEN spends THEN 'filled' ELSE 'unsolved' END AS how FROM x)
SELECT account, ts, row_id, 1 AS part, CASE how WHEN 'plus' THEN amount WHEN 'unsolved' THEN NULL ELSE -amount END::DECIMAL(18,2) AS amount, balance, CASE how WHEN 'unsolved' THEN 'unsolved' ELSE 'observed' END AS nature FROM y
UNION ALL SELECT account, ts, row_id, -1, (balance + amount)::DECIMAL(18,2), (balance + amount)::DECIMAL(18,2), 'opening' FROM y WHERE how = 'first'
UNION ALL SELECT account, ts, row_id, 0, (balance - previous + amount)::DECIMAL(18,2), (balance + amount)::DECIMAL(18,2), 'inferred' FROM y WHERE how = 'filled'""")
def signed_chain(spark, d):
    rows = B.statement(spark, d)
    return balances.signed_chain(rows.withColumn("amount", F.abs("amount")), F.col("kind").isin("purchase", "error"))


_HEADS = ["记账日期", "货币", "交易金额", "联机余额", "交易摘要", "对手信息"]
_PAGE_COLUMNS = {"source": "bank", "day": "记账日期", "signed": "交易金额", "balance": "联机余额", "what": "交易摘要", "party": "对手信息"}


def _laid_out(rows):
    """Words of statement pages, 25 rows each: a title in large print that names a heading, headings, rows whose party runs over two lines, and a footer."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("account").orderBy("ts", "row_id")) - 1
    placed = rows.withColumn("nth", nth).withColumns({"page": F.floor(F.col("nth") / 25).cast("int") + 1, "y": F.col("nth") % 25 * 30 + 100.0})
    file = [F.col("account").cast("string").alias("file"), F.md5(F.col("account").cast("string")).alias("file_hash"), "page"]
    word = lambda text, x0, x1, y, size=7.0: F.struct(F.lit(text).alias("text") if isinstance(text, str) else text.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), (F.lit(float(y)) if isinstance(y, int) else y).alias("top"), F.lit(size).alias("size"))
    money = lambda c: F.format_number(F.col(c).cast("double"), 2)
    y = F.col("y")
    body = [word(F.date_format("ts", "yyyy-MM-dd"), 20, 60, y), word("人民币", 80, 100, y + 0.4), word(money("amount"), 120, 160, y), word(money("balance"), 180, 220, y - 0.4), word(F.col("kind"), 240, 270, y), word(F.concat(F.lit("户"), F.col("row_id").cast("string")), 290, 330, y), word("号", 295, 310, y + 10)]
    at = [(20, 60), (80, 100), (125, 155), (185, 215), (240, 270), (290, 330)]
    frame = [word("交易金额", 120, 400, 20, 16.0), *[word(h, a, b, 60) for h, (a, b) in zip(_HEADS, at, strict=True)], word("第1页", 150, 200, 900)]
    lines = placed.select(*file, F.explode(F.array(*body)).alias("w")).unionByName(placed.select(*file).distinct().select(*file[:0], "file", "file_hash", "page", F.explode(F.array(*frame)).alias("w")))
    return lines.select("file", "file_hash", "page", "w.*")


@query("word_statements", f"WITH {B.STATEMENT}, n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, row_id) - 1 AS k FROM st) SELECT account::VARCHAR AS source_file, ((k // 25 + 1) * 10000 + k % 25 + 1)::INT AS raw_row_number, ts::DATE AS booking_date, amount, balance, kind AS description, '户' || row_id || '号' AS merchant FROM n")
def word_statements(spark, d):
    words = _laid_out(B.statement(spark, d))
    recs = geometry.page_records(words, "pages", _HEADS, largest=7.1, footer="^第[0-9]+页$")
    return statements.raw_rows(recs, F.col("file"), {"pages": _PAGE_COLUMNS}).select("source_file", "raw_row_number", "booking_date", "amount", "balance", "description", "merchant")


@query("word_statement_breaks", f"WITH {B.STATEMENT}, n AS (SELECT account, balance, lag(balance) OVER (PARTITION BY account ORDER BY ts, row_id) + amount AS expected, row_number() OVER (PARTITION BY account ORDER BY ts, row_id) - 1 AS k FROM st) SELECT account::VARCHAR AS source_file, ((k // 25 + 1) * 10000 + k % 25 + 1)::INT AS raw_row_number, expected::DECIMAL(18,2) AS expected, balance FROM n WHERE expected <> balance")
def word_statement_breaks(spark, d):
    words = _laid_out(B.statement(spark, d))
    recs = geometry.page_records(words, "pages", _HEADS, largest=7.1, footer="^第[0-9]+页$")
    found = geometry.chain_faults(statements.raw_rows(recs, F.col("file"), {"pages": _PAGE_COLUMNS}))
    return found.withColumn("expected", F.col("expected").cast("decimal(18,2)"))


def _adapted(name: str, source: str, heads: list[str], columns: dict[str, str], line, sql: str):
    """A query that writes a format's files, one an account, and reads them through an adapter registered under name."""

    @query(name, sql)
    def run(spark, d):
        from ledgerloom.plans.source_queries import _as_files, _folder

        path = _folder(spark)
        rows = load(spark, d, "raws").where(F.col("source") == source)
        lines = _as_files(rows, "source_account", "raw_row_number", heads, line(), "x")
        lines.repartition(F.xxhash64("source_account")).sortWithinPartitions("source_account", "nth").select("source_account", "line").write.partitionBy("source_account").text(path)
        formats = adapters.built_in()
        if name not in ("alipay_v1_statements", "alipay_v2_statements"):
            formats.register(adapters.by_headings(name, name, (".TXT",), heads, columns))
        out = formats.read(spark, path, name.removesuffix("_statements"), F.regexp_extract("source_file", "source_account=([^/]+)/", 1))
        return out.where("fault is null").select("source_account", "transaction_time", "amount", "direction", "merchant", "description", "status")


_STAMP = lambda: F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss")
_WAY_OUT = lambda: F.when(F.col("direction") == "expense", "支出").when(F.col("direction") == "income", "收入").otherwise("不计收支")
_SAME = f"WITH {ctes('raws')} SELECT source_account, transaction_time, amount, direction, merchant, description, status FROM raws WHERE source = "
_adapted("alipay_v1_statements", "alipay", ["交易号", "商家订单号", "交易创建时间", "交易对方", "商品名称", "金额（元）", "收/支", "交易状态"], {}, lambda: [F.col("transaction_id"), F.col("merchant_order_id"), _STAMP(), F.col("merchant"), F.col("description"), F.abs("amount"), _WAY_OUT(), F.col("status")], _SAME + "'alipay'")
_adapted("alipay_v2_statements", "alipay", ["交易订单号", "商户订单号", "创建时间", "商品名称", "对方账户", "金额", "收/支", "收/付款方式", "交易状态"], {}, lambda: [F.col("transaction_id"), F.col("merchant_order_id"), _STAMP(), F.col("description"), F.col("merchant"), F.abs("amount"), _WAY_OUT(), F.col("payment_method"), F.col("status")], _SAME + "'alipay'")
_adapted("own_wallet", "wechat", ["When", "Sum", "Kind", "Whom", "What", "State"], {"source": "mywallet", "time": "When", "amount": "Sum", "way": "Kind", "party": "Whom", "what": "What", "status": "State"}, lambda: [_STAMP(), F.abs("amount"), _WAY_OUT(), F.col("merchant"), F.col("description"), F.col("status")], _SAME + "'wechat'")


@query("captured_rows", f"""WITH {B.STATEMENT}, n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, row_id) - 1 AS k, year(ts) * 12 + month(ts) - 1 AS own FROM st),
c AS (SELECT *, k // 6 AS page, CASE WHEN k % 4 = 1 THEN own END AS m FROM n), f AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY account ORDER BY k ROWS UNBOUNDED PRECEDING), last_value(m IGNORE NULLS) OVER (PARTITION BY account, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS mm FROM c WHERE k % 11 <> 10),
g AS (SELECT account::VARCHAR AS capture, try_strptime((mm // 12) || '-' || (mm % 12 + 1) || '-' || strftime(ts, '%d %H:%M'), '%Y-%m-%d %H:%M') AS transaction_time, abs(amount)::DECIMAL(18,2) AS amount, abs(balance)::DECIMAL(18,2) AS balance, kind, m IS NOT NULL AS dated, k, strftime(ts, '%H:%M') AS clock FROM f)
SELECT capture, transaction_time, amount, balance, kind, dated FROM g WHERE transaction_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY capture, clock, amount, balance, kind ORDER BY NOT dated, k) = 1""")
def captured_rows(spark, d):
    """Six cards a page; every fourth card says its date, every eleventh lacks its amount, and every fifth is captured twice."""
    from pyspark.sql import Window

    rows = B.statement(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("account").orderBy("ts", "row_id")) - 1)
    money = lambda c: F.concat(F.format_number(F.abs(c).cast("double"), 2), F.lit("元"))
    says = F.when(F.col("k") % 4 == 1, F.date_format("ts", "yyyy年M月d日提醒")).otherwise("交易提醒")
    label = F.when(F.col("k") % 11 == 10, "数额").otherwise(captures.AMOUNT)
    texts = F.array(says, F.date_format("ts", "d日 HH:mm"), F.lit(captures.KIND), F.lit("交易"), F.col("kind"), label, money("amount"), F.lit(captures.TIME), money("balance"))
    cards = rows.select(F.col("account").cast("string").alias("capture"), (F.col("k") * 2).alias("nth"), F.floor(F.col("k") / 6).alias("page"), texts.alias("texts"), "k")
    again = cards.where("k % 5 = 0").withColumn("nth", F.col("nth") + 1)
    return captures.captured_rows(cards.unionByName(again).drop("k"))
