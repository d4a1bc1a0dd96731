"""Statement rows from words and where they stand on a page, for formats that only come as pages.

A word is (file, file_hash, page, text, x0, x1, top, size), coordinates growing to the right and down; what reads words out of a
page file is the caller's. Lines are cut at gaps between tops, columns at the middles between headings, records at lines that begin
with a date; all in windows over one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import texts as T

#: A record's number in its file is its page times this and its place on the page.
PAGE = 10_000
DATE = r"^\d{4}[-/.]?\d{2}[-/.]?\d{2}$"


def text_lines(words: DataFrame, gap: float = 3.0) -> DataFrame:
    """words with line, from 1 on each page: a new one wherever a word's top is more than gap below the one before. Words without text or place are left out."""
    page = Window.partitionBy("file", "page").orderBy("top", "x0")
    there = words.where("text is not null and trim(text) <> '' and x0 is not null and x1 is not null and top is not null")
    cut = there.withColumn("cut", F.coalesce(F.col("top") - F.lag("top").over(page) > gap, F.lit(True)).cast("int"))
    return cut.withColumn("line", F.sum("cut").over(page.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def heading_bands(lined: DataFrame, heads: list[str]) -> DataFrame:
    """(file, page, head_line, head, first, lo, hi): a page's first line that holds all headings as words of their own, each heading with its column from lo to hi."""
    named = lined.where(F.col("text").isin(heads))
    full = named.groupBy("file", "page", "line").agg(F.count_distinct("text").alias("n")).where(F.col("n") == len(set(heads)))
    top = full.groupBy("file", "page").agg(F.min("line").alias("line"))
    across = Window.partitionBy("file", "page").orderBy("x0")
    one = named.join(top, ["file", "page", "line"]).groupBy("file", "page", "line", F.col("text").alias("head")).agg(F.min("x0").alias("x0"), F.min("x1").alias("x1"))
    lo = F.coalesce((F.lag("x1").over(across) + F.col("x0")) / 2, F.lit(float("-inf")))
    hi = F.coalesce((F.col("x1") + F.lead("x0").over(across)) / 2, F.lit(float("inf")))
    return one.select("file", "page", F.col("line").alias("head_line"), "head", F.lag("x0").over(across).isNull().alias("first"), lo.alias("lo"), hi.alias("hi"))


def _placed(lined: DataFrame, heads: list[str]) -> DataFrame:
    """Words below their page's headings with head, their column, and first, whether it is the page's first; the columns are those of heading_bands."""
    page, whole = Window.partitionBy("file", "page").orderBy("line", "x0"), Window.partitionBy("file", "page").orderBy("line", "x0").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line, names = Window.partitionBy("file", "page", "line"), sorted(set(heads))
    named = F.when(F.col("text").isin(names), F.col("text"))
    marked = lined.withColumn("full", F.size(F.collect_set(named).over(line)) == len(names))
    marked = marked.withColumn("head_line", F.min(F.when(F.col("full"), F.col("line"))).over(whole)).where("line >= head_line")
    at = F.collect_list(F.when((F.col("line") == F.col("head_line")) & named.isNotNull(), F.struct("text", "x0", "x1"))).over(whole)
    least = lambda h, c: F.array_min(F.transform(F.filter("at", lambda w: w["text"] == h), lambda w: w[c]))
    across = F.array_sort(F.array(*[F.struct(least(h, "x0").alias("x0"), least(h, "x1").alias("x1"), F.lit(h).alias("head")) for h in names]))
    here = lambda k: F.get("across", k)
    middle = lambda a, b, else_: F.coalesce((a["x1"] + b["x0"]) / 2, F.lit(else_))
    bands = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.struct(here(k)["head"].alias("head"), (k == 0).alias("first"), middle(here(k - 1), here(k), float("-inf")).alias("lo"), middle(here(k), here(k + 1), float("inf")).alias("hi")))
    # the columns are worked out at a page's first word and handed on to the others
    top = F.row_number().over(page) == 1
    banded = marked.withColumns({"top": top, "at": at}).withColumn("across", F.when(F.col("top"), across)).withColumn("bands", F.when(F.col("top"), bands)).drop("at", "across")
    banded = banded.withColumn("bands", F.first("bands", True).over(whole)).where("line > head_line")
    centre = (F.col("x0") + F.col("x1")) / 2
    own = banded.select("file", "file_hash", "page", "line", "text", "x0", F.explode(F.filter("bands", lambda b: (centre >= b["lo"]) & (centre < b["hi"]))).alias("b"))
    return own.select("file", "file_hash", "page", "line", "text", "x0", "b.head", "b.first")


def page_records(words: DataFrame, format: str, heads: list[str], largest: float | None = None, gap: float = 3.0, footer: str | None = None, begins: str = DATE) -> DataFrame:
    """(file, file_hash, format, row_no, heads, row) as statements.records gives them, so that raw_rows reads both.

    largest leaves out words of larger print; footer is a pattern for lines, without blanks, that end a page's table. A line whose first
    column fits `begins` starts a record; the lines below it go on with its cells, whose words are joined without blanks. Pages without all the
    headings give no rows (see page_faults). All is told by windows over a page, so words are shuffled once.
    """
    lined = text_lines(words if largest is None else words.where(F.col("size") <= largest), gap)
    placed = _placed(lined.select("file", "file_hash", "page", "line", "text", "x0", "x1"), heads)
    line, page = Window.partitionBy("file", "page", "line"), Window.partitionBy("file", "page").orderBy("line").rangeBetween(Window.unboundedPreceding, 0)
    joined = lambda c: F.array_join(F.transform(c, lambda w: w["text"]), "")
    # what holds for a line is told by one of its words
    lead = F.row_number().over(line.orderBy("x0")) == 1
    told = placed.withColumns({"lead": lead, "starts": F.bool_or(F.col("first") & F.col("text").rlike(begins)).over(line)})
    if footer:
        told = told.withColumn("said", F.array_sort(F.collect_list(F.struct("x0", "text")).over(line))).withColumn("ends", F.when(F.col("lead"), joined(F.col("said")).rlike(footer))).drop("said")
    ended = F.coalesce(F.bool_or("ends").over(page), F.lit(False)) if footer else F.lit(False)
    numbered = told.withColumns({"ended": ended, "record": F.sum(F.when(F.col("lead") & F.col("starts"), 1).otherwise(0)).over(page)})
    cells = numbered.where("not ended and record > 0").groupBy("file", "file_hash", "page", "record", "head").agg(F.array_sort(F.collect_list(F.struct("line", "x0", "text"))).alias("words"))
    rows = cells.groupBy("file", "file_hash", "page", "record").agg(F.map_from_entries(F.collect_list(F.struct("head", T.cell(joined("words"))))).alias("row"))
    number = (F.col("page") * PAGE + F.col("record")).cast("int")
    return rows.select("file", "file_hash", F.lit(format).alias("format"), number.alias("row_no"), F.array(*map(F.lit, heads)).alias("heads"), "row")


def page_faults(words: DataFrame, heads: list[str], largest: float | None = None, gap: float = 3.0) -> DataFrame:
    """(file, row_no, fault): pages on which no line holds all headings."""
    found = heading_bands(text_lines(words if largest is None else words.where(F.col("size") <= largest), gap), heads).select("file", "page").distinct()
    return words.select("file", "page").distinct().join(found, ["file", "page"], "left_anti").select("file", (F.col("page") * PAGE).cast("int").alias("row_no"), F.lit("headings").alias("fault"))


def chain_faults(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    """(source_file, raw_row_number, expected, balance): rows whose balance doesn't follow from the row before in their file."""
    number: Column = -F.col("raw_row_number") if newest_first else F.col("raw_row_number")
    before = rows.withColumn("expected", F.lag("balance").over(Window.partitionBy("source_file").orderBy(number)) + F.col("amount"))
    return before.where("expected <> balance").select("source_file", "raw_row_number", "expected", "balance")
