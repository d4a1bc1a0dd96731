"""Statement files to raw ledger rows: cells of every file, its format by its headings, its rows by their headings' meanings.

Files are read by Spark and decoded in tasks, a file at a time; all else is column expressions over rows of cells.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.functions import lexicon as L
from ledgerloom.functions import texts as T

#: Encodings that are tried in turn, and rows among which the headings are looked for.
ENCODINGS, HEAD_ROWS = ("utf-8-sig", "gb18030", "utf-16"), 100
_CELLS = "file string, file_hash string, row_no int, cells array<string>, fault string"

#: What each column of a raw row is called in each format. For a bank's own CSV, a heading that holds one of the words.
COLUMNS = {
    "alipay_official": {"source": "alipay", "time": "交易时间", "amount": "金额", "way": "收/支", "party": "交易对方", "what": "商品说明", "method": "收/付款方式", "number": "交易订单号", "order": "商家订单号", "status": "交易状态"},
    "alipay_v3": {"source": "alipay", "time": "交易时间", "amount": "金额", "way": "收/支", "party": "交易对方", "what": "商品说明", "method": "收付款方式", "status": "交易状态"},
    "alipay_v2": {"source": "alipay", "time": "创建时间", "amount": "金额", "way": "收/支", "party": "对方账户", "what": "商品名称", "method": "收/付款方式", "number": "交易订单号", "order": "商户订单号", "status": "交易状态"},
    "alipay_v1": {"source": "alipay", "time": "交易创建时间", "amount": "金额（元）", "way": "收/支", "party": "交易对方", "what": "商品名称", "method": "交易方式", "number": "交易号", "order": "商家订单号", "status": "交易状态"},
    "wechat": {"source": "wechat", "time": "交易时间", "amount": "金额(元)", "way": "收/支", "party": "交易对方", "what": "商品", "method": "支付方式", "number": "交易单号", "order": "商户单号", "status": "当前状态"},
    "cqrcb": {"source": "bank", "day": "交易日期", "time": "交易时间", "signed": "交易发生额", "balance": "账户余额", "party": "对方户名", "party2": "对方账号", "what": "摘要", "card": "本方账号", "status": "数据性质"},
    "unionpay": {"source": "unionpay", "day": "交易日期", "time": "交易时间", "unsigned": "交易金额", "kind": "交易类型", "party": "交易对方", "party2": "对方账号", "what": "交易备注"},
    "bank": {
        "source": "bank", "day": "日期|记账日|Date", "time": "时间|Time", "in": "收入|贷方金额|转入金额|Credit", "out": "支出|借方金额|转出金额|Debit", "signed": "金额|Amount", "balance": "余额|Balance",
        "party": "交易对手|对方户名|对方账户|交易对方|Counterparty|对方名称", "what": "摘要|备注|用途|交易类型|Description|附言",
    },
}


def decoded(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("encoding is not supported")


def _sheet(data: bytes) -> Iterator[list[str]]:
    """Rows of a workbook's first sheet as texts; numbers come as they are stored."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
        shared = [text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
        for row in (e for e in ElementTree.fromstring(book.read(first)).iter() if local(e) == "row"):
            cells: list[str] = []
            for c in row:
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                cells += [""] * (at - 1 - len(cells))
                value = next((v.text or "" for v in c if local(v) == "v"), "")
                cells.append(shared[int(value)] if c.get("t") == "s" else text(c) if c.get("t") == "inlineStr" else value)
            yield cells


#: Rows of a file that are handed on at once.
CHUNK = 5000


def _rows_of(data: bytes) -> Iterator[list[str]]:
    return _sheet(data) if data[:2] == b"PK" else csv.reader(io.StringIO(decoded(data), newline=""))


def _file_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A file is read through once to see whether it can be, then handed on in chunks, so that no task holds all its cells."""
    names = ["file", "file_hash", "row_no", "cells", "fault"]
    for batch in batches:
        for f in batch.itertuples():
            try:
                for _ in _rows_of(f.content):
                    pass
            except (ValueError, KeyError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError) as e:
                yield pd.DataFrame([(f.path, f.file_hash, 0, [], str(e))], columns=names)
                continue
            rows = enumerate(_rows_of(f.content), 1)
            while part := [(f.path, f.file_hash, n, [c.strip() for c in cells], None) for n, cells in islice(rows, CHUNK)]:
                yield pd.DataFrame(part, columns=names)


def statement_files(spark: SparkSession, path: str, pattern: str = "*.{csv,CSV,txt,xlsx}", owner: Column | None = None) -> DataFrame:
    """(path, file_hash, content) of the statement files under a folder, each hash once: the least path of equal files. With owner (over path), once for each owner."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    hashed = files.select("path", F.sha2("content", 256).alias("file_hash"), "content")
    first = hashed.groupBy("file_hash", *([] if owner is None else [owner.alias("owner")])).agg(F.min("path").alias("path"))
    return hashed.join(first, ["file_hash", "path"], "left_semi").select("path", "file_hash", "content")


def statement_cells(files: DataFrame) -> DataFrame:
    """(file, file_hash, row_no, cells, fault): every row of every file, CSV in any of the encodings or XLSX; a file that can't be read is one row with a fault.

    A file is decoded whole in one task; statements are limited to some 50 MB.
    """
    return files.select("path", "file_hash", "content").mapInPandas(_file_cells, _CELLS)


def _holds(cells: Column, required: list[str]) -> Column:
    ok = F.lit(True)
    for words in required:
        ok = ok & F.arrays_overlap(cells, F.array(*map(F.lit, words.split("|"))))
    return ok


def headings(cells: DataFrame, formats: dict[str, list[str]] = L.FORMATS) -> DataFrame:
    """(file, format, head_row, heads): the first of the early rows that holds all headings of a format, formats in order; files without one are left out."""
    clean = F.transform("cells", T.strip_bom)
    found = T.first_of([(_holds(clean, heads), F.struct(F.lit(k).alias("nth"), F.lit(name).alias("format"))) for k, (name, heads) in enumerate(formats.items())], F.lit(None))
    rows = cells.where(F.col("row_no").between(1, HEAD_ROWS)).select("file", "row_no", clean.alias("heads"), found.alias("f")).where("f is not null")
    best = rows.groupBy("file").agg(F.min(F.struct("row_no", "f.nth", "f.format", "heads")).alias("b"))
    return best.select("file", F.col("b.format").alias("format"), F.col("b.row_no").alias("head_row"), F.col("b.heads").alias("heads"))


def records(cells: DataFrame, formats: dict[str, list[str]] = L.FORMATS) -> DataFrame:
    """(file, file_hash, format, row_no, heads, named, row): the rows after the headings, as heading to text; blank rows are left out, short ones padded, of equal headings the first counts.

    named has the heading of each of a bank's words, looked for once in a file and not in each of its rows.
    """
    words = sorted({w for w in COLUMNS["bank"].values() if w != COLUMNS["bank"]["source"]})
    found = F.map_from_arrays(F.array(*map(F.lit, words)), F.array(*[_named(w) for w in words]))
    heads = headings(cells, formats).withColumn("named", F.when(F.col("format") == "bank", found))
    rows = cells.join(heads, "file").where((F.col("row_no") > F.col("head_row")) & F.exists("cells", lambda c: c != ""))
    keep = F.filter(F.sequence(F.lit(1), F.size("heads")), lambda i: (F.get(F.col("heads"), i - 1) != "") & (F.array_position(F.col("heads"), F.get(F.col("heads"), i - 1)) == i))
    row = F.map_from_entries(F.transform(keep, lambda i: F.struct(F.get(F.col("heads"), i - 1).alias("key"), T.cell(F.get(F.col("cells"), i - 1)).alias("value"))))
    return rows.select("file", "file_hash", "format", "row_no", "heads", "named", row.alias("row"))


def _named(words: str) -> Column:
    """The first heading that holds one of the words."""
    return F.get(F.filter("heads", lambda h: T.has_any(h, words.split("|"))), F.lit(0))


def _value(columns: dict[str, dict[str, str]], fmt: str, what: str, named: bool) -> Column:
    """A record's text for one column of one format, or null. named: the records know the headings of a bank's words."""
    name = columns[fmt].get(what)
    if name is None:
        return F.lit(None).cast("string")
    if fmt == "bank":
        head = F.try_element_at("named", F.lit(name)) if named and name in COLUMNS["bank"].values() else _named(name)
        return F.nullif(F.try_element_at("row", head), F.lit(""))
    return F.nullif(F.try_element_at("row", F.lit(name)), F.lit(""))


def _of_format(columns: dict[str, dict[str, str]], make) -> Column:
    return T.first_of([(F.col("format") == f, make(f)) for f in columns], F.lit(None))


def raw_rows(recs: DataFrame, account: Column, columns: dict[str, dict[str, str]] = COLUMNS) -> DataFrame:
    """Raw ledger rows of records, with fault where a row can't be read: source, source_account, transaction_time, booking_date, amount, direction, merchant,
    counterparty, description, payment_method, bank_card_suffix, transaction_id, merchant_order_id, status, balance, source_file, source_file_hash, raw_row_number, original_row.
    """
    get = lambda what: _of_format(columns, lambda f: _value(columns, f, what, "named" in recs.columns))
    vals = recs.select("*", *[get(w).alias(f"v_{w}") for w in ("time", "day", "amount", "way", "signed", "unsigned", "in", "out", "balance", "party", "party2", "kind", "what", "method", "number", "order", "status", "card")])
    stated, way = T.signed_amount(F.col("v_amount"), F.col("v_way"))
    number = lambda c: F.regexp_replace(c, r"[¥￥$,\s]", "").try_cast(X.MONEY)
    split = F.coalesce(F.when(number(F.col("v_in")) != 0, F.abs(number(F.col("v_in")))), F.when(number(F.col("v_out")) != 0, -F.abs(number(F.col("v_out")))))
    amount = F.when(F.col("v_amount").isNotNull(), stated).when(F.col("v_unsigned").isNotNull(), T.unionpay_amount(number(F.col("v_unsigned")), F.coalesce("v_kind", F.lit("")))).otherwise(F.coalesce(split, number(F.col("v_signed")))).cast(X.MONEY)
    day, clock = X.parse_datetime(F.col("v_day")), F.when(F.col("v_time").rlike(r"^\d{1,2}:\d{2}"), F.col("v_time"))
    stamp = F.coalesce(T.strict_datetime(F.col("v_time")), X.parse_datetime(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), clock)).cast("timestamp_ntz"))
    stamp = F.when(F.col("v_time").isNotNull(), stamp)
    party = F.coalesce("v_party", "v_party2", F.lit(""))
    # a bank's own rows without any amount, such as notes, are no transactions
    idle = (F.col("format") == "bank") & (F.greatest(*[F.abs(number(F.col(f"v_{w}"))) for w in ("in", "out", "signed")]) == 0)
    out = vals.where(~F.coalesce(idle, F.lit(False))).withColumns({"amount": amount, "stamp": stamp, "booking": F.coalesce(stamp.cast("date"), day.cast("date"))})
    direction = F.when(F.col("v_amount").isNotNull(), way).when(F.col("amount") < 0, "expense").when(F.col("amount").isNotNull(), "income")
    fault = F.when(F.col("booking").isNull(), "date").when(F.col("amount").isNull(), "amount").when(direction.isNull(), "direction")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(
        _of_format(columns, lambda f: F.lit(columns[f]["source"])).alias("source"), account.alias("source_account"), F.col("stamp").alias("transaction_time"), F.col("booking").alias("booking_date"), "amount", direction.alias("direction"),
        party.alias("merchant"), party.alias("counterparty"), text("v_what").alias("description"), text("v_method").alias("payment_method"), F.coalesce(X.card_suffix(F.col("v_method")), X.card_suffix(F.col("v_card"))).alias("bank_card_suffix"),
        F.col("v_number").alias("transaction_id"), F.col("v_order").alias("merchant_order_id"), text("v_status").alias("status"), number(F.col("v_balance")).alias("balance"),
        F.col("file").alias("source_file"), F.col("file_hash").alias("source_file_hash"), F.col("row_no").alias("raw_row_number"), F.col("row").alias("original_row"), fault.alias("fault"),
    )


def faults(cells: DataFrame, rows: DataFrame, formats: dict[str, list[str]] = L.FORMATS) -> DataFrame:
    """(file, row_no, fault) of files that can't be read or have no known headings, and of rows with a fault."""
    unread = cells.where("fault is not null").select("file", "row_no", "fault")
    known = headings(cells, formats).select("file")
    strange = cells.where("fault is null").select("file").distinct().join(known, "file", "left_anti").select("file", F.lit(0).alias("row_no"), F.lit("headings").alias("fault"))
    return unread.union(strange).union(rows.where("fault is not null").select("source_file", "raw_row_number", "fault"))


def whole_files(rows: DataFrame) -> DataFrame:
    """Rows of files without any faulty row: one bad row rejects its file."""
    bad = rows.where("fault is not null").select("source_file").distinct()
    return rows.join(bad, "source_file", "left_anti").drop("fault")
