"""Which of many keywords a text holds, by an index of their first characters: the plan stays the same however long the table of keywords is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.durable import cut


#: Characters of a keyword that pick the places where it may stand, characters that are compared there, and bytes of keywords that are broadcast.
HEAD, COMPARED, BROADCAST = 4, 32, 8 << 20


def keyword_hits(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(row_id, nth): every keyword (nth, word; nths differ) that a text (row_id, text; ids differ) holds, letters' case aside.

    Every place of a text gives the characters that follow, at most COMPARED; a keyword is compared where its first HEAD characters stand, so
    texts are neither shuffled nor searched a second time, but for longer keywords. Blank and null keywords are in no text, null texts hold none.
    """
    said = texts.select("row_id", F.lower("text").alias("said")).where("said <> ''")
    words = cut(keywords.select("nth", F.lower("word").alias("word")).where("trim(word) <> ''"))
    sizes = {r["n"]: r for r in words.groupBy(F.least(F.char_length("word"), F.lit(HEAD)).alias("n")).agg(F.max(F.char_length("word")).alias("longest"), F.sum(F.octet_length("word") + 40).alias("bytes")).collect()}
    out = words.select(F.lit(None).cast(dict(texts.dtypes)["row_id"]).alias("row_id"), "nth").limit(0)
    for n, size in sorted(sizes.items()):
        longest = min(size["longest"], COMPARED)
        mine = words.where(F.least(F.char_length("word"), F.lit(HEAD)) == n).select("nth", "word", F.substring("word", 1, n).alias("g"))
        # a place is no second half of a character beyond the basic plane
        after = F.regexp_extract_all("said", F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{n - 1},{longest - 1}}}))"), F.lit(1))
        places = said.select("row_id", F.explode(F.array_distinct(after) if longest <= HEAD else after).alias("after")).withColumn("g", F.substring("after", 1, n))
        found = places.join(F.broadcast(mine) if size["bytes"] <= BROADCAST else mine, "g").where(F.startswith("after", F.substring("word", 1, COMPARED))).select("row_id", "nth", "word").distinct()
        if size["longest"] > COMPARED:
            long = F.char_length("word") > COMPARED
            found = found.where(~long).unionByName(found.where(long).join(said, "row_id").where(F.contains("said", "word")).select("row_id", "nth", "word"))
        out = out.unionByName(found.select("row_id", "nth"))
    return out


def first_keyword(texts: DataFrame, keywords: DataFrame, default: str) -> DataFrame:
    """(row_id, account) of each text: the account of the keyword (nth, word, account) with the least nth that it holds, else the default."""
    first = keyword_hits(texts, keywords).groupBy("row_id").agg(F.min("nth").alias("nth"))
    both = texts.select("row_id").join(first.join(keywords.select("nth", "account"), "nth"), "row_id", "left")
    return both.select("row_id", F.coalesce("account", F.lit(default)).alias("account"))
