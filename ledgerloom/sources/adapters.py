"""Statement formats as an extension point: an adapter says how a format's rows are found and read, and users add their own.

Files come through Spark's binary reader, which opens whatever store the cluster reads. Formats of pages are chosen by the user and never guessed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import lexicon as L
from ledgerloom.sources import statements


@dataclass(frozen=True)
class Adapter:
    """read makes raw rows, as statements.raw_rows gives them, of the files (path, file_hash, content) of the format and an account column."""

    format_id: str
    display_name: str
    extensions: tuple[str, ...]
    read: Callable[[DataFrame, Column], DataFrame]


def by_headings(format_id: str, display_name: str, extensions: tuple[str, ...], heads: list[str], columns: dict[str, str]) -> Adapter:
    """An adapter for files of rows under headings: heads are those a file must have, columns say what each means (see statements.COLUMNS)."""
    known = set().union(*statements.COLUMNS.values())
    if unknown := set(columns) - known:
        raise ValueError(f"unknown columns: {sorted(unknown)}")

    def read(files: DataFrame, account: Column) -> DataFrame:
        cells = statements.statement_cells(files)
        recs = statements.records(cells, {format_id: heads})
        rows = statements.raw_rows(recs, account, {format_id: columns})
        bad = statements.faults(cells, rows, {format_id: heads}).join(rows.select(F.col("source_file").alias("file"), F.col("raw_row_number").alias("row_no")), ["file", "row_no"], "left_anti")
        # files that can't be read, or lack the headings, are a row with a fault
        lost = bad.select(F.col("file").alias("source_file"), F.col("row_no").alias("raw_row_number"), "fault")
        return rows.unionByName(lost, allowMissingColumns=True)

    return Adapter(format_id, display_name, extensions, read)


class Registry:
    """Adapters by their id; ids are trimmed and in lower case, extensions too, with a dot."""

    def __init__(self) -> None:
        self._adapters: dict[str, Adapter] = {}

    def register(self, adapter: Adapter, replaces: bool = False) -> None:
        name = adapter.format_id.strip().lower()
        endings = tuple("." + e.strip().lower().lstrip(".") for e in adapter.extensions)
        if not name or not endings or "." in endings:
            raise ValueError("an adapter has an id and at least one extension")
        if name in self._adapters and not replaces:
            raise ValueError(f"{name} is registered already")
        self._adapters[name] = replace(adapter, format_id=name, extensions=endings)

    def get(self, format_id: str) -> Adapter:
        return self._adapters[format_id.strip().lower()]

    def formats(self, spark: SparkSession) -> DataFrame:
        """(format_id, display_name, extensions) of what is registered."""
        rows = [(a.format_id, a.display_name, list(a.extensions)) for _, a in sorted(self._adapters.items())]
        return spark.createDataFrame(rows, "format_id string, display_name string, extensions array<string>")

    def read(self, spark: SparkSession, path: str, format_id: str, account: Column) -> DataFrame:
        """Raw rows, with fault, of the statement files under path in the chosen format; files of other extensions are one row with a fault each. account is over source_file."""
        adapter = self.get(format_id)
        files = statements.statement_files(spark, path, "*")
        fits = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*adapter.extensions)
        rows = adapter.read(files.where(fits), F.lit(None).cast("string"))
        other = files.where(~fits).select(F.col("path").alias("source_file"), F.lit(0).alias("raw_row_number"), F.lit("extension").alias("fault"))
        return rows.unionByName(other, allowMissingColumns=True).withColumn("source_account", account)


def built_in() -> Registry:
    """The formats under headings that the library knows."""
    names = {"wechat": "WeChat bill", "cqrcb": "CQRCB statement", "unionpay": "UnionPay statement", "bank": "Bank statement"} | {f"alipay_{v}": f"Alipay bill ({v})" for v in ("official", "v1", "v2", "v3")}
    new = Registry()
    for name, heads in L.FORMATS.items():
        new.register(by_headings(name, names[name], ("csv", "txt", "xlsx"), heads, statements.COLUMNS[name]))
    return new


def of_pages(format_id: str, display_name: str, extensions: tuple[str, ...], words_of: Callable[[DataFrame], DataFrame], heads: list[str], columns: dict[str, str], **layout) -> Adapter:
    """An adapter for files of pages: words_of makes words (see geometry) of files, layout is page_records'."""
    from ledgerloom.sources import geometry

    def read(words_of: Callable, files: DataFrame, account: Column) -> DataFrame:
        words = words_of(files)
        rows = statements.raw_rows(geometry.page_records(words, format_id, heads, **layout), account, {format_id: columns})
        lost = geometry.page_faults(words, heads, layout.get("largest"), layout.get("gap", 3.0)).select(F.col("file").alias("source_file"), F.col("row_no").alias("raw_row_number"), "fault")
        return rows.unionByName(lost, allowMissingColumns=True)

    return Adapter(format_id, display_name, extensions, partial(read, words_of))
