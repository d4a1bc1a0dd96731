"""Registered queries that read statement files and streams; each writes its input into the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import texts as T
from ledgerloom.operators.durable import shared_folder
from ledgerloom.plans import bridge as B
from ledgerloom.plans.registry import Registry
from ledgerloom.plans.store import ctes, load
from ledgerloom.sources import statements
from ledgerloom.streaming import arrivals, ingest

query = Registry()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def _as_files(rows: DataFrame, account: str, order: str, heads: list[str], line: list, preamble: str) -> DataFrame:
    """Lines of a statement per account: two lines before the headings, the headings, the rows."""
    body = rows.select(account, (F.col(order) + 10).cast("long").alias("nth"), F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(c.cast("string"), F.lit("")), F.lit('"')) for c in line]).alias("line"))
    top = rows.select(account).distinct().select(account, F.posexplode(F.array(F.lit(preamble), F.lit(""), F.lit(",".join(heads)))).alias("nth", "line"))
    return body.unionByName(top.withColumn("nth", F.col("nth").cast("long") - 10))


def _read_back(spark: SparkSession, lines: DataFrame, account: str) -> DataFrame:
    path = _folder(spark)
    # by a hash, not by the column: where the lines are a union already spread by account, Spark leaves the column's shuffle out and headings part from rows
    lines.repartition(F.xxhash64(account)).sortWithinPartitions(account, "nth").select(account, "line").write.partitionBy(account).text(path)
    owner = lambda file: F.regexp_extract(file, f"{account}=([^/]+)/", 1)
    cells = statements.statement_cells(statements.statement_files(spark, path, owner=owner("path")))
    return statements.raw_rows(statements.records(cells), owner("file"))


_WAYS = {"expense": "支出", "income": "收入", "neutral": "不计收支"}


def _way():
    return T.first_of([(F.col("direction") == k, F.lit(v)) for k, v in _WAYS.items()], F.lit("?"))


_RAW = "transaction_time, booking_date, amount, direction, merchant, description, payment_method, bank_card_suffix, transaction_id, merchant_order_id, status"


def _wallet_statement(name: str, source: str, heads: list[str], line):
    @query(name, f"WITH {ctes('raws')} SELECT source_account, {_RAW.replace('bank_card_suffix', "nullif(regexp_extract(payment_method, '[0-9]{4}'), '') AS bank_card_suffix")} FROM raws WHERE source = '{source}'")
    def run(spark, d):
        rows = load(spark, d, "raws").where(F.col("source") == source)
        out = _read_back(spark, _as_files(rows, "source_account", "raw_row_number", heads, line(), "账单明细"), "source_account")
        return statements.whole_files(out).select("source_account", *_RAW.split(", "))


_c, _size = F.col, lambda: F.abs("amount")
_wallet_statement("alipay_statements", "alipay", ["交易时间", "交易分类", "交易对方", "对方账号", "商品说明", "收/支", "金额", "收/付款方式", "交易状态", "交易订单号", "商家订单号", "备注"], lambda: [
    F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss"), F.lit("x"), _c("merchant"), F.lit(""), _c("description"), _way(), _size(), _c("payment_method"), _c("status"), _c("transaction_id"), _c("merchant_order_id"), F.lit("")])
_wallet_statement("wechat_statements", "wechat", ["交易时间", "交易类型", "交易对方", "商品", "收/支", "金额(元)", "支付方式", "当前状态", "交易单号", "商户单号", "备注"], lambda: [
    F.date_format("transaction_time", "yyyy/MM/dd HH:mm:ss"), F.lit("商户消费"), _c("merchant"), _c("description"), _way(), F.concat(F.lit("¥"), _size()), _c("payment_method"), _c("status"), _c("transaction_id"), _c("merchant_order_id"), F.lit("")])


@query("bank_statements", f"WITH {B.STATEMENT} SELECT account::VARCHAR AS source_account, date_trunc('second', ts) AS transaction_time, amount, balance, kind AS merchant, CASE WHEN amount < 0 THEN 'expense' ELSE 'income' END AS direction FROM st WHERE amount <> 0 AND row_id % 41 <> 0")
def bank_statements(spark, d):
    """Every 41st row moves nothing, and is no transaction."""
    rows = B.statement(spark, d).withColumn("amount", F.when(F.col("row_id") % 41 == 0, 0).otherwise(F.col("amount")).cast("decimal(18,2)"))
    line = [F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.when(F.col("amount") >= 0, F.col("amount")), F.when(F.col("amount") < 0, -F.col("amount")), F.col("balance"), F.col("kind"), F.lit("")]
    heads = ["交易日期", "交易时间", "收入", "支出", "余额", "交易对手", "摘要"]
    out = _read_back(spark, _as_files(rows, "account", "row_id", heads, line, "x"), "account")
    return out.select("source_account", "transaction_time", "amount", "balance", "merchant", "direction")


@query("statement_faults", f"WITH {ctes('raws')} SELECT source_account, count(*) AS n_faults, count(*) FILTER (direction = 'neutral') AS n_direction FROM raws WHERE source = 'alipay' AND (direction = 'neutral' OR raw_row_number % 50 = 2) GROUP BY 1")
def statement_faults(spark, d):
    rows = load(spark, d, "raws").where("source = 'alipay'")
    stamp = F.when(F.col("raw_row_number") % 50 == 2, "soon").otherwise(F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss"))
    way = T.first_of([(F.col("direction") == "expense", F.lit("支出")), (F.col("direction") == "income", F.lit("收入"))], F.lit("?"))
    heads = ["交易时间", "交易分类", "交易对方", "商品说明", "金额", "收/支", "收付款方式", "交易状态"]
    line = [stamp, F.lit("x"), F.col("merchant"), F.col("description"), F.abs("amount"), way, F.col("payment_method"), F.col("status")]
    out = _read_back(spark, _as_files(rows, "source_account", "raw_row_number", heads, line, "x"), "source_account").where("fault is not null")
    return out.groupBy("source_account").agg(F.count("*").alias("n_faults"), F.count_if((F.col("fault") != "date") | (F.col("original_row")["收/支"] == "?")).alias("n_direction"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_weekly", "SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n_rows, sum(value::DECIMAL(18,2))::DECIMAL(18,2) AS total FROM events GROUP BY 1")
def stream_weekly(spark, d):
    folder = _folder(spark)
    rows = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.run_once(ingest.weekly(rows, F.col("value").cast("decimal(18,2)")), folder, "complete")
    return spark.read.parquet(f"{folder}/out")


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    folder = _folder(spark)
    ingest.run_once(ingest.first_seen(_events(spark, d).select("user_id", "event_type"), ["user_id", "event_type"]), folder)
    return spark.read.parquet(f"{folder}/out")


@query("stream_appended", "SELECT DISTINCT user_id % 10 AS k FROM events")
def stream_appended(spark, d):
    folder = _folder(spark)
    stream = _events(spark, d).select((F.col("user_id") % 10).alias("k"))
    ingest.run_once(stream, folder, each=ingest.appender(f"{folder}/table", "k"))
    return spark.read.parquet(f"{folder}/table").select("k")


@query("stream_pairs", "SELECT a.event_id AS left_raw_id, b.event_id AS right_raw_id, a.user_id::DECIMAL(18,2) AS amount FROM events a JOIN events b ON a.event_type = 'click' AND b.event_type = 'purchase' AND a.user_id = b.user_id AND abs(epoch(a.ts) - epoch(b.ts)) <= 7200")
def stream_pairs(spark, d):
    folder = _folder(spark)
    side = lambda kind: _events(spark, d).where(F.col("event_type") == kind).select(F.col("event_id").alias("raw_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("decimal(18,2)").alias("amount"))
    ingest.run_once(ingest.paired(side("click"), side("purchase"), 7200, "400 days"), folder)
    return spark.read.parquet(f"{folder}/out")


@query("stream_engine")
def stream_engine(spark, d):
    """The engine's results of rows that arrive in five batches: what the batch engine says of all of them at once."""
    from ledgerloom.plans.match_queries import _engine_rows

    folder = _folder(spark)
    rows = _engine_rows(spark, d)
    for part in range(5):  # a run for each delivery, going on from the checkpoint of the one before
        fifth = (F.pmod("seq", F.lit(1000)) * 5 / 1000).cast("int")
        rows.where(fifth == part).withColumn("seq", F.col("seq") + part * (1 << 40)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        ingest.run_once(arrivals.changes(stream, "4000 days"), folder)  # deliveries reach over all years
    return arrivals.latest(spark.read.parquet(f"{folder}/out"))
