"""Review sessions, keyword tables, words on pages, signs from balances and statement adapters, on small tables."""

import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import balances, keywords, sessions
from ledgerloom.sources import adapters, geometry, statements


def test_keywords_against_a_scan(spark):
    rng = random.Random(9)
    letters = "abcÄ北京店ab "
    said = [None, "", " ", "a", "X", "北京店"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    table = [(k, "".join(rng.choice("abcä北京店") for _ in range(rng.randint(1, 5))), f"acc{k % 7}") for k in range(300)] + [(900, " ", "blank"), (901, None, "none"), (902, "X", "x")]
    texts = spark.createDataFrame(list(enumerate(said)), "row_id long, text string")
    words = spark.createDataFrame(table, "nth int, word string, account string")
    want = {i: {n for n, w, _ in table if w and w.strip() and w.lower() in t.lower()} if t else set() for i, t in enumerate(said)}
    hits = keywords.keyword_hits(texts, words).collect()
    assert len(hits) == len({tuple(h) for h in hits}) and {i: {h.nth for h in hits if h.row_id == i} for i in want} == want
    first = {r.row_id: r.account for r in keywords.first_keyword(texts, words, "none").collect()}
    of = {n: a for n, _, a in table}
    assert first == {i: of[min(s)] if s else "none" for i, s in want.items()}
    nothing = spark.createDataFrame([], "nth int, word string, account string")
    assert {r.account for r in keywords.first_keyword(texts, nothing, "none").collect()} == {"none"}


def test_the_plan_does_not_grow_with_the_table(spark):
    texts = spark.createDataFrame([(1, "word17 and word9001")], "row_id int, text string")
    plans = []
    for n in (10, 10_000):
        words = spark.range(n).select(F.col("id").alias("nth"), F.concat(F.lit("word"), "id").alias("word"), F.lit("a").alias("account"))
        found = keywords.first_keyword(texts, words, "none")
        plans.append(found._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        assert [r.account for r in found.collect()] == ["a"]
    assert plans[0] == plans[1]


AT = datetime(2024, 1, 1)


def test_sessions(spark):
    observed = spark.createDataFrame([("b1", "r1", True, AT), ("b1", "r2", False, AT), ("b1", "r3", True, AT), ("b2", "r4", None, AT)], "import_batch_id string, raw_id string, is_new boolean, at timestamp_ntz")
    missing = spark.createDataFrame([("b1", "r5", AT)], "import_batch_id string, raw_id string, at timestamp_ntz")
    links = spark.createDataFrame([("c2", "r2"), ("c1", "r2"), ("c5", "r5")], "canonical_id string, raw_id string")
    items = sessions.review_items(observed, missing, links)
    rows = {r.raw_id: r for r in items.collect()}
    assert {k: (r.item_type, r.canonical_id) for k, r in rows.items()} == {"r1": ("new_unmatched", None), "r2": ("existing_linked", "c1"), "r3": ("new_unmatched", None), "r4": ("existing_unmatched", None), "r5": ("existing_missing_from_import", "c5")}
    log = [("r1", 1, "confirmed"), ("r1", 2, "rejected"), ("r2", 3, "what"), ("r2", 4, "modified"), ("r3", 5, None), ("r3", 6, "rejected"), ("r5", 7, "confirmed")]
    decisions = spark.createDataFrame([(rows[r].review_item_id, n, d, "u", AT + timedelta(hours=n)) for r, n, d in log] + [("no such", 9, "confirmed", "u", AT)], "review_item_id string, seq int, decision string, actor string, at timestamp_ntz")
    events = sessions.judged(items, decisions)
    assert {r.seq: (r.before, r.after, r.fault) for r in events.collect()} == {
        1: ("pending", "confirmed", None), 2: ("confirmed", "confirmed", "already decided"), 3: ("pending", "pending", "unknown decision"), 4: ("pending", "modified", None), 5: ("pending", "pending", "unknown decision"),
        6: ("pending", "rejected", None), 7: ("pending", "confirmed", None), 9: ("pending", "pending", "unknown item"),
    }
    states = sessions.item_states(items, events)
    got = {(r.n_items, r.n_pending, r.status, r.completed_at) for r in sessions.session_states(states).collect()}
    assert got == {(4, 0, "completed", AT + timedelta(hours=7)), (1, 1, "pending", None)}
    candidates = spark.createDataFrame([("r4", "x", "rejected")], "left_raw_id string, right_raw_id string, status string")
    assert [r.raw_id for r in sessions.bulk_confirmable(states, candidates).collect()] == ["r4"]
    assert sessions.bulk_confirmable(states, candidates.withColumn("status", F.lit("pending"))).collect() == []


def test_an_item_keeps_the_version_that_was_valid(spark):
    rng = random.Random(1)
    versions = [(f"c{rng.randrange(4)}", AT + timedelta(hours=k * 2), k) for k in range(30)]
    items = [(f"i{k}", rng.choice(["c0", "c1", "c2", "c9", None]), AT + timedelta(hours=rng.randrange(-2, 70))) for k in range(60)]
    v, i = spark.createDataFrame(versions, "id string, at timestamp_ntz, n int"), spark.createDataFrame(items, "item string, id string, at timestamp_ntz")
    got = {r.item: r.n for r in sessions.as_of(i, v, "id", "at", ["n"]).collect()}
    assert got == {k: max(((a, n) for c, a, n in versions if c == key and a <= at), default=(0, None))[1] for k, key, at in items}


def _words(texts):
    return [("f", "h", page, t, float(x), float(x + 8 * len(t)), float(y), float(size)) for page, t, x, y, size in texts]


def test_words_on_pages(spark):
    heads = ["记账日期", "交易金额", "对手信息"]
    page = [(1, "交易金额", 10, 5, 16), (1, "记账日期", 10, 40, 7), (1, "交易金额", 100, 40.5, 7), (1, "对手信息", 200, 39.5, 7), (1, "合计", 10, 55, 7)]
    page += [(1, "2024-01-02", 12, 70, 7), (1, "1,234.50", 98, 71, 7), (1, "张三", 200, 70, 7), (1, "商店", 220, 70, 7), (1, "分店", 204, 80, 7), (1, "2024-01-03", 12, 90, 7), (1, "-7.00", 110, 90, 7), (1, "第1页", 100, 300, 7), (1, "2024-01-09", 12, 310, 7)]
    page += [(2, "记账日期", 10, 40, 7), (2, "交易金额", 100, 40, 7), (2, "对手信息", 200, 40, 7), (2, "2024-01-04", 12, 60, 7), (2, "9.00", 110, 60, 7), (3, "记账日期", 10, 40, 7)]
    rows = _words(page)
    random.Random(0).shuffle(rows)
    words = spark.createDataFrame([*rows, ("f", "h", 1, None, 1.0, 2.0, 3.0, 7.0)], "file string, file_hash string, page int, text string, x0 double, x1 double, top double, size double")
    recs = geometry.page_records(words, "p", heads, largest=7.1, footer="^第[0-9]+页$")
    raw = statements.raw_rows(recs, F.lit("acc"), {"p": {"source": "bank", "day": "记账日期", "signed": "交易金额", "party": "对手信息"}})
    got = {(r.raw_row_number, str(r.booking_date), r.amount, r.merchant, r.fault) for r in raw.collect()}
    assert got == {(10001, "2024-01-02", Decimal("1234.50"), "张三商店分店", None), (10002, "2024-01-03", Decimal("-7.00"), "", None), (20001, "2024-01-04", Decimal("9.00"), "", None)}
    assert [tuple(r) for r in geometry.page_faults(words, heads, largest=7.1).collect()] == [("f", 30000, "headings")]
    assert geometry.page_records(words.limit(0), "p", heads).collect() == []


def test_signs_follow_from_balances(spark):
    kinds = {"pay": True, "get": False}
    told = [("a", "pay", 10, 90), ("a", "get", 5, 95), ("a", "pay", 5, 90), ("a", "pay", 7, 85), ("a", "get", 9, 80), ("a", "get", None, 70), ("a", "pay", 3, None), ("a", "pay", 10, 60), ("b", "get", 4, 4), ("b", "get", 6, 10)]
    rows = spark.createDataFrame([(a, AT + timedelta(hours=k), k, kind, None if x is None else Decimal(x), None if y is None else Decimal(y)) for k, (a, kind, x, y) in enumerate(told)], "account string, ts timestamp_ntz, row_id int, kind string, amount decimal(18,2), balance decimal(18,2)")
    got = [(r.row_id, r.part, r.amount, r.nature) for r in balances.signed_chain(rows, F.col("kind").isin([k for k, v in kinds.items() if v])).orderBy("row_id", "part").collect()]
    assert got == [(0, -1, 100, "opening"), (0, 1, -10, "observed"), (1, 1, 5, "observed"), (2, 1, -5, "observed"), (3, 0, 2, "inferred"), (3, 1, -7, "observed"), (4, 1, None, "unsolved"), (5, 1, None, "unsolved"), (6, 1, None, "unsolved"), (7, 1, -10, "observed"), (8, 1, None, "unsolved"), (9, 1, 6, "observed")]


def test_adapters(spark, tmp_path):
    mine = adapters.by_headings(" MyBank ", "My bank", ("TSV", ".csv"), ["Day", "Sum"], {"source": "mybank", "day": "Day", "signed": "Sum"})
    formats = adapters.built_in()
    formats.register(mine)
    with pytest.raises(ValueError, match="registered"):
        formats.register(mine)
    formats.register(mine, replaces=True)
    for wrong in (("", (".csv",)), ("x", ()), ("x", (" ",))):
        with pytest.raises(ValueError):
            formats.register(adapters.Adapter(wrong[0], "n", wrong[1], mine.read))
    with pytest.raises(KeyError):
        formats.get("nothing")
    with pytest.raises(ValueError, match="unknown columns"):
        adapters.by_headings("x", "x", ("csv",), ["A"], {"colour": "A"})
    listed = {r.format_id: r.extensions for r in formats.formats(spark).collect()}
    assert listed["mybank"] == [".tsv", ".csv"] and {"wechat", "bank", "alipay_v1"} <= set(listed)
    (tmp_path / "a.csv").write_text("title\nDay,Sum\n2024-01-02,-3.50\n2024-01-03,x\n", encoding="gb18030")
    (tmp_path / "b.csv").write_text("Day,Other\n1,2\n")
    (tmp_path / "c.pdf").write_text("pages")
    rows = formats.read(spark, f"file://{tmp_path}", "MYBANK", F.regexp_extract("source_file", r"([^/]+)\.\w+$", 1)).collect()
    assert {(r.source_account, r.raw_row_number, r.source, r.amount, r.fault) for r in rows} == {("a", 3, "mybank", Decimal("-3.50"), None), ("a", 4, "mybank", None, "amount"), ("b", 0, None, None, "headings"), ("c", 0, None, None, "extension")}


def test_an_adapter_for_pages(spark, tmp_path):
    (tmp_path / "s.page").write_text("\n".join(f"1 {t} {x} {y}" for t, x, y in [("记账日期", 10, 40), ("交易金额", 100, 40), ("2024-01-02", 12, 60), ("8.00", 110, 60)]))

    def words_of(files):
        line = F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("l")
        part = lambda k: F.split("l", " ")[k]
        x = part(2).cast("double")
        return files.select(F.col("path").alias("file"), "file_hash", line).select("file", "file_hash", part(0).cast("int").alias("page"), part(1).alias("text"), x.alias("x0"), (x + 20).alias("x1"), part(3).cast("double").alias("top"), F.lit(7.0).alias("size"))

    formats = adapters.Registry()
    formats.register(adapters.of_pages("pages", "Pages", (".page",), words_of, ["记账日期", "交易金额"], {"source": "bank", "day": "记账日期", "signed": "交易金额"}, largest=7.1))
    rows = formats.read(spark, f"file://{tmp_path}", "pages", F.lit("acc")).collect()
    assert [(r.source_account, str(r.booking_date), r.amount, r.fault) for r in rows] == [("acc", "2024-01-02", Decimal("8.00"), None)]


def test_cards_of_a_message_list(spark):
    def card(head, clock="3日 09:30", amount="1,200.00元", balance="50.00元", kind="消费"):
        return [head, clock, "类型", "交易", kind, "金额", amount, "时间", balance]

    cards = [
        (1, 1, card("提醒", "2日 08:00")), (2, 1, card("2020年7月1日", "5日 10:00")), (3, 1, card("2020年8月3日")), (4, 2, card("提醒", "4日 09:30")), (5, 2, card("提醒", "31日 11:00", "7.00元")), (6, 3, card("2020年9月1日", "30日 11:00", "7.00元")),
        (7, 3, card("提醒", amount="x")), (8, 3, card("提醒", kind="")), (9, 3, ["金额"]), (10, 4, card("提醒", "31日 12:00")),
    ]
    df = spark.createDataFrame([("c", *c) for c in cards] + [("d", 1, 1, card("提醒"))], "capture string, nth int, page int, texts array<string>")
    from ledgerloom.sources import captures

    got = {(r.capture, str(r.transaction_time), r.amount, r.dated) for r in captures.captured_rows(df).collect()}
    # the first card takes its page's last date; 9:30 was seen twice, dated first; 11:00 twice, the dated one counts; September has no 31st
    assert got == {("c", "2020-08-02 08:00:00", Decimal("1200.00"), False), ("c", "2020-07-05 10:00:00", Decimal("1200.00"), True), ("c", "2020-08-03 09:30:00", Decimal("1200.00"), True), ("c", "2020-09-30 11:00:00", Decimal("7.00"), True)}


def test_accounts_named_in_texts(spark):
    from ledgerloom.operators import records

    rows = spark.createDataFrame([(1, "招商银行(9001)"), (2, "余额&工商银行"), (3, None), (4, "行"), (5, "ABC bank"), (6, "abc bank")], "id int, said string")
    accounts = spark.createDataFrame([("招商银行", 1), ("工商银行", 2), ("商银", 3), ("行", 4), ("ABC", 5)], "account string, day int")
    want = {(1, "招商银行"), (1, "商银"), (1, "行"), (2, "工商银行"), (2, "商银"), (2, "行"), (4, "行"), (5, "ABC")}
    for few in (10, 4):
        found = [(r.id, r.account) for r in records.naming(rows, "id", "said", accounts, few).collect()]
        assert set(found) == want and len(found) == len(want)


def test_keywords_of_every_length_in_one_long_text(spark):
    import time

    from ledgerloom.operators.keywords import keyword_hits

    long = "x" * 40 + "y"
    found = ["a", "bc", "def", "𠮷野", "ghijk", long]
    lost = ["q", "zb", "feg", "ghijl", "x" * 40 + "z", "\ud842".encode("utf-16", "surrogatepass").decode("utf-16", "replace") + "bb"]
    text = "".join(f"{k} " for k in range(60_000)) + " ".join(found).upper()
    start = time.time()
    hits = keyword_hits(spark.createDataFrame([(1, text), (2, None), (3, "")], "row_id int, text string"), spark.createDataFrame(list(enumerate(found + lost)), "nth int, word string")).collect()
    assert sorted((r["row_id"], r["nth"]) for r in hits) == [(1, k) for k in range(len(found))] and time.time() - start < 30


def test_collisions_of_one_amount_need_no_join_of_rows(spark):
    import time

    from ledgerloom.operators import observations

    n = 40_000
    amount = "cast(if(id % 2 = 0, -5, 5) as decimal(18,2)) as amount"
    rows = spark.range(2 * n).selectExpr("'bank' as source", "'a' as source_account", "date'2024-01-01' as booking_date", amount, "cast(7 as decimal(18,2)) as balance", "'f' as source_file", "id as raw_row_number", "'p' as counterparty", "'d' as description")
    start = time.time()
    got = observations.balance_collisions(rows).collect()
    assert [(r["n_rows"], r["interleaved_reversal"], r["priority"]) for r in got] == [(n, True, "review")] * 2 and time.time() - start < 30


def test_items_without_a_key_have_no_version_and_are_spread(spark):
    at = datetime(2024, 3, 1)
    items = spark.range(4000).selectExpr("id as item", "if(id = 7, 'x', null) as k", "timestamp_ntz'2024-03-01 00:00:00' as at")
    versions = spark.createDataFrame([("x", at, 5), (None, at, 6)], "k string, at timestamp_ntz, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sessions.as_of(items, versions, "k", "at", ["n"]).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 4000 and {(r.item, r.n) for r in rows if r.n is not None} == {(7, 5)}
    assert max(Counter(r.part for r in rows).values()) < 2000


def test_words_are_shuffled_once(spark):
    words = spark.createDataFrame([("f", "h", 1, "Day", 10.0, 20.0, 10.0, 7.0), ("f", "h", 1, "Sum", 30.0, 40.0, 10.0, 7.0), ("f", "h", 1, "2024-01-02", 9.0, 19.0, 30.0, 7.0), ("f", "h", 1, "5.00", 31.0, 39.0, 30.0, 7.0)], "file string, file_hash string, page int, text string, x0 double, x1 double, top double, size double")
    recs = geometry.page_records(words, "p", ["Day", "Sum"], footer="^end$")
    plan = recs._jdf.queryExecution().executedPlan().toString()
    assert [(r.row_no, r.row) for r in recs.collect()] == [(10_001, {"Day": "2024-01-02", "Sum": "5.00"})]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
