"""Accounts of entries, decisions on doubtful refunds and found files on small written cases."""

from pyspark.sql import functions as F

from ledgerloom.functions import accounts as A
from ledgerloom.operators import warnings
from ledgerloom.sources import discovery

RULES = [("Starbucks", "Expenses:Food:Coffee"), ("咖啡", "Expenses:Food:Other")]


def test_opposing_accounts_and_tags(spark):
    rows = [
        (1, "STARBUCKS 咖啡", None, "expense"), (2, None, None, None), (3, "公司", "年终奖 工资", "income"), (4, "x", "超市", ""), (5, "x", "退款", "transfer"), (6, "x", "打车", "transfer"), (7, "美团外卖 配送", "微信 WeChat", "expense"),
    ]
    df = spark.createDataFrame(rows, "id int, party string, about string, kind string")
    got = {r[0]: (r[1], r[2]) for r in df.select("id", A.opposing_account(F.col("party"), F.col("about"), F.col("kind"), RULES), A.account_tags(F.col("party"), F.col("about"))).collect()}
    assert got == {
        1: ("Expenses:Food:Coffee", []), 2: ("Income:Unknown", []), 3: ("Income:Salary:Gross", []), 4: ("Expenses:Unknown", []), 5: ("Income:Refund:Shopping", []), 6: ("Expenses:Unknown", []),
        7: ("Expenses:Unknown", ["wechat", "delivery", "delivery"]),
    }


def test_asset_accounts(spark):
    df = spark.createDataFrame([(1, "Bank", "招商银行"), (2, "bank", None), (3, "ALIPAY", "x"), (4, None, "x")], "id int, platform string, party string")
    got = dict(df.select("id", A.asset_account(F.col("platform"), F.col("party"), {"alipay": "W", "bank": "B"})).collect())
    assert got == {1: "Assets:Current:Bank:CMB", 2: "B", 3: "W", 4: A.CASH}


def test_an_escalated_warning_reopens_all_choices(spark):
    rows = [("a", "f", "confirmed", True, False, False), ("b", "f", "superseded", True, False, False), ("c", "f", "rejected", True, False, False), ("d", "g", "confirmed", False, False, False), ("e", "h", "confirmed", False, True, True)]
    relationships = spark.createDataFrame(rows, "relationship_id string, from_id string, status string, is_ambiguous boolean, is_partial boolean, acknowledged boolean")
    events = warnings.warning_events(relationships, spark.createDataFrame([("a", "escalate", "me"), ("d", "acknowledge", "me"), ("e", "restore", "me"), ("z", "restore", "me")], "relationship_id string, decision string, actor string"))
    assert {r.relationship_id: r.fault for r in events.collect()} == {"a": None, "d": "not in queue warning", "e": None, "z": "unknown relationship"}
    after = {r.relationship_id: (r.status, r.acknowledged) for r in warnings.after_warnings(relationships, events).collect()}
    assert after == {"a": ("pending", False), "b": ("pending", False), "c": ("rejected", False), "d": ("confirmed", False), "e": ("confirmed", False)}


def test_found_files(spark, tmp_path):
    for name in ("wallet/a.CSV", "wallet/b.zip", "wallet/手动修正-c.csv", "other/d", "deep/wallet/e.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = {r.path.rsplit("/", 1)[1]: (r.format, r.reason) for r in discovery.discover(spark, str(tmp_path), {("wallet", ".csv"): "w"}).collect()}
    why = discovery.REASONS
    assert [found[k] for k in ("a.CSV", "b.zip", "d", "e.csv")] == [("w", None), (None, why["packed"]), (None, why["other"]), ("w", None)]
    assert [v for k, v in found.items() if k.endswith("c.csv")] == [(None, why["by_hand"])]


def test_found_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from ledgerloom import catalog
    from ledgerloom.plans import account_queries

    monkeypatch.setattr(account_queries, "shared_folder", lambda spark: str(tmp_path))
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").repartition(8).write.parquet(str(tmp_path / "in" / "orders.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file of the input
    try:
        found = catalog.queries()["found_files"](spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(found) == 3 and len(list(tmp_path.glob("found-*/account=bank/*.txt"))) > 1
