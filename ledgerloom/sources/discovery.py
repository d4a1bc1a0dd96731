"""Statement files in a tree of folders, with the format that folder and suffix stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.texts import first_of

# Formats by the last folder's name and the suffix, and why a file is passed over.
FORMATS = {
    ("微信", ".xlsx"): "wechat.xlsx",
    ("支付宝", ".csv"): "alipay.csv",
    ("招商银行", ".pdf"): "cmb.pdf",
    ("工商银行", ".pdf"): "icbc.pdf",
    ("重庆农村商业银行", ".pdf"): "cqrcb.pdf",
    ("重庆农村商业银行", ".csv"): "cqrcb.csv",
}
BY_HAND, PACKED = "手动修正-", ".zip"
REASONS = {"by_hand": "手工证据源由同目录规范化账单覆盖", "packed": "压缩包由同目录已解压账单覆盖", "other": "不是已支持的账单内容格式"}


def discover(spark: SparkSession, root: str, formats: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(path, folder, suffix, format, reason) of every file under root; format is null where reason says why the file is passed over.

    Only names are listed, no content is read. suffix is in lower case and empty where the name has none. Files whose names begin with _ or a dot are not data.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    files = found.select("path", F.try_element_at(parts, F.lit(-2)).alias("folder"), name.alias("name"), F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)).alias("suffix"))
    known = FORMATS if formats is None else formats
    by = first_of([((F.col("folder") == f) & (F.col("suffix") == s), F.lit(v)) for (f, s), v in known.items()], F.lit(None).cast("string"))
    files = files.withColumn("format", F.when(~F.col("name").startswith(BY_HAND), by))
    why = first_of([(F.col("name").startswith(BY_HAND), F.lit(REASONS["by_hand"])), (F.col("suffix") == PACKED, F.lit(REASONS["packed"]))], F.lit(REASONS["other"]))
    return files.select("path", "folder", "suffix", "format", F.when(F.col("format").isNull(), why).alias("reason"))
