"""Statement files in their encodings and formats, streams, and what is written."""

import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import exports, records
from ledgerloom.sources import statements as S
from ledgerloom.streaming import ingest

ALIPAY = "交易时间,交易分类,交易对方,对方账号,商品说明,收/支,金额,收/付款方式,交易状态,交易订单号,商家订单号,备注"


def _workbook(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_statement_files(spark, tmp_path):
    row = '2024-03-01 10:00:00,餐饮,"店, 甲",x,咖啡,支出,"1,035.50",招商银行(1234),交易成功,T1,M1,（空）'
    (tmp_path / "a.csv").write_bytes(f"说明\n\n{ALIPAY}\n{row}\n,,,\n".encode("gb18030"))
    (tmp_path / "a-copy.csv").write_bytes(f"说明\n\n{ALIPAY}\n{row}\n,,,\n".encode("gb18030"))
    (tmp_path / "b.csv").write_bytes(f"{ALIPAY}\n{row}\n2024-03-0110:00:01,x,乙,x,y,不计收支,2.00,,交易成功,T2\nsoon,x,乙,x,y,支出,2.00\n".encode("utf-16"))
    (tmp_path / "c.csv").write_bytes("﻿交易日期,交易时间,收入,支出,余额,交易对手,摘要\n2024-03-01,08:00:00,,20.00,80.00,丙,买\n2024-03-02,08:00:00,5.00,,85.00,丁,卖\n".encode())
    (tmp_path / "d.csv").write_bytes(b"x,y\n1,2\n")
    (tmp_path / "e.xlsx").write_bytes(b"PK no workbook")
    heads = ["交易时间", "交易类型", "交易对方", "商品", "收/支", "金额(元)", "支付方式", "当前状态", "交易单号", "商户单号", "备注"]
    _workbook(tmp_path / "f.xlsx", [["微信支付账单"], heads, ["2024/03/03 09:00:00", "商户消费", "戊", "", "收入", "¥3.20", "零钱", "已收钱", "W1"]])
    files = S.statement_files(spark, f"file://{tmp_path}")
    cells = S.statement_cells(files).cache()
    rows = S.raw_rows(S.records(cells), F.lit("me")).cache()
    got = {(r["source_file"].rsplit("/", 1)[1], r["raw_row_number"]): r for r in rows.collect()}
    assert set(got) == {("a-copy.csv", 4), ("b.csv", 2), ("b.csv", 3), ("b.csv", 4), ("c.csv", 2), ("c.csv", 3), ("f.xlsx", 3)}  # equal files once, blank rows not
    a = got["a-copy.csv", 4]
    assert (a["source"], a["amount"], a["direction"], a["merchant"], a["bank_card_suffix"], a["transaction_id"], a["original_row"]["备注"]) == ("alipay", Decimal("-1035.50"), "expense", "店, 甲", "1234", "T1", "")
    assert got["b.csv", 3]["direction"] == "neutral" and str(got["b.csv", 3]["transaction_time"]) == "2024-03-01 10:00:01" and got["b.csv", 4]["fault"] == "date"
    assert [(got["c.csv", n]["amount"], got["c.csv", n]["balance"]) for n in (2, 3)] == [(Decimal(-20), Decimal(80)), (Decimal(5), Decimal(85))]
    assert (got["f.xlsx", 3]["source"], got["f.xlsx", 3]["amount"], got["f.xlsx", 3]["merchant"]) == ("wechat", Decimal("3.20"), "戊")
    faults = {(r["file"].rsplit("/", 1)[1], r["row_no"], r["fault"]) for r in S.faults(cells, rows).collect()}
    assert {("b.csv", 4, "date"), ("d.csv", 0, "headings")} < faults and {f[0] for f in faults} == {"b.csv", "d.csv", "e.xlsx"}
    assert {r["source_file"].rsplit("/", 1)[1] for r in S.whole_files(rows).collect()} == {"a-copy.csv", "c.csv", "f.xlsx"}


def test_files_come_once_over_two_runs(spark, tmp_path):
    inbox, out = tmp_path / "in", f"file://{tmp_path}/out"
    inbox.mkdir()
    (inbox / "a.csv").write_text("x")
    run = lambda: ingest.run_once(ingest.new_files(spark, f"file://{inbox}").select("path", "file_hash"), out)
    run()
    (inbox / "b.csv").write_text("x")
    (inbox / "c.csv").write_text("y")
    run()
    assert sorted(r["path"][-5:] for r in spark.read.parquet(f"{out}/out").collect()) == ["a.csv", "c.csv"]


def test_appender_may_run_again(spark, tmp_path):
    append = ingest.appender(f"file://{tmp_path}/t", "k")
    batch = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    append(batch(1, 2, 2), 0)
    append(batch(2, 3), 1)
    append(batch(2, 3), 1)
    assert sorted(r["k"] for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [1, 2, 3]


def test_ledger_is_written_in_order(spark, tmp_path):
    rows = [("b", "2024-02-01 00:00:00", 5, "甲\n\"x\"", "bank", "餐", False), ("a", "2024-01-01 00:00:00", -3, "", "alipay", "", True)]
    df = spark.createDataFrame(rows, "row_id string, ts string, amount int, merchant string, source string, category string, review boolean").withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "amount": F.col("amount").cast("decimal(18,2)")})
    lines = exports.ledger_lines(exports.account_names(df, {"bank": "Assets:Bank"}), "2023-01-01")
    exports.write_lines(lines, f"file://{tmp_path}/l")
    text = [x for f in sorted((tmp_path / "l").glob("part-*")) for x in f.read_text().split("\n")[:-1]]
    assert text[:4] == ["2023-01-01 open Assets:Bank CNY", "2023-01-01 open Assets:Unclassified CNY", "2023-01-01 open Expenses:Unclassified CNY", "2023-01-01 open Income:餐 CNY"]
    assert text[4:8] == ['2024-01-01 ! "Unknown"', "  Assets:Unclassified  -3.00 CNY", "  Expenses:Unclassified  3.00 CNY", ""] and text[8] == '2024-02-01 * "甲x"'
    assert exports.unbalanced(lines).count() == 0
    with pytest.raises(ValueError):
        records.queue(df, [F.col("ts")], 0)


def test_lines_of_an_account_stay_in_one_file(spark):
    from ledgerloom.plans import source_queries

    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        source = "/root/testdata/sf0.001"
        rows = spark.read.parquet(f"{source}/events.parquet").where("round(value, 2) <> 0 and event_id % 41 <> 0").count()
        assert source_queries.bank_statements(spark, source).count() == rows
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_equal_files_of_two_owners_stay(spark, tmp_path):
    for name in ("k=1/a", "k=1/b", "k=2/a"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.csv").write_text("x")
    of = lambda **more: sorted(r["path"][-9:] for r in S.statement_files(spark, f"file://{tmp_path}", **more).collect())
    assert of() == ["k=1/a.csv"] and of(owner=F.regexp_extract("path", "k=([^/]+)/", 1)) == ["k=1/a.csv", "k=2/a.csv"]


def test_headings_of_a_bank_are_named_once_in_a_file(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("交易日期,交易时间,收入,支出,余额,交易对手,摘要\n2024-03-01,08:00:00,,20.00,80.00,丙,买\n".encode())
    (tmp_path / "b.csv").write_bytes(f"{ALIPAY}\n2024-03-01 10:00:00,x,乙,x,y,支出,2.00,,交易成功,T2\n".encode())
    recs = S.records(S.statement_cells(S.statement_files(spark, f"file://{tmp_path}")))
    got = {r["format"]: r["named"] for r in recs.collect()}
    assert got["alipay_official"] is None and got["bank"][S.COLUMNS["bank"]["out"]] == "支出" and got["bank"][S.COLUMNS["bank"]["signed"]] is None
    rows = lambda x: [(r["amount"], r["balance"], r["merchant"], r["transaction_time"]) for r in S.raw_rows(x, F.lit("me")).orderBy("amount").collect()]
    assert rows(recs) == rows(recs.drop("named")) and len(rows(recs)) == 2
