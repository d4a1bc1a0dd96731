"""Benchmark decontamination with a distributed positional inverted index.

One pass cuts every document into words and stores the postings (term, document, position) of the benchmark's terms.
All else reads that index: corpus frequencies rank the terms of each benchmark window, the list of its rarest term,
shifted by the term's offset to the window's start, gives candidates, the next-rarest term's shifted list is intersected with
them, and the remaining lists confirm the survivors. Proximity matches read the same index. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, text_key

#: ASCII characters that are no part of a word; A-Z are lower-cased in the same pass, other characters are word characters.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A term that no text holds. It follows the last word of each document, so its position is the document's number of words.
END = ""
#: The index has a row per word of the corpus: small row groups, so that a task buffers little of it.
_WRITTEN = {"parquet.block.size": str(16 << 20)}


def words(text: Column) -> Column:
    """Maximal runs of word characters with A-Z lower-cased; null has none. Replacing and splitting is five times as fast as a regular expression."""
    plain = F.translate(F.coalesce(text, F.lit("")), _BETWEEN + _UPPER, " " * len(_BETWEEN) + _UPPER.lower())
    return F.array_remove(F.split(plain, " "), "")


def windows(benchmark: DataFrame, size: int = 13) -> DataFrame:
    """(item_id, win_id, win, n): the distinct windows of each item; an item shorter than size, but not empty, is one window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    at = items.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    win = at.select("item_id", F.slice("w", F.col("i"), F.col("n")).alias("win"), "n")
    return win.select("item_id", F.md5(F.array_join("win", " ")).alias("win_id"), "win", "n").distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, doc_id, th, pos) for the given distinct terms in all docs; th is text_key.

    With END among the terms, its one posting per row carries the number of words. Terms beyond the broadcast limit are met in a
    shuffle by term, whose hot keys AQE splits. Only terms and positions leave the row, never its words together.
    """
    rows = docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("th"), F.concat(words(F.col("text")), F.array(F.lit(END))).alias("w"))
    each = rows.select("doc_id", "th", F.posexplode("w").alias("pos", "term"))
    return each.join(checked_broadcast(terms), "term").select("term", "doc_id", "th", "pos")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """postings of the terms and of END as a stored table, with a non-null key beside doc_id to join on."""
    both = materialize(terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct(), "terms")
    stored = materialize(postings(docs, both), "postings", **_WRITTEN)
    return stored.withColumn("key", F.coalesce("doc_id", F.lit(0).cast("long")))


def ranked_terms(wins: DataFrame, idx: DataFrame) -> DataFrame:
    """(win_id, n, o, term, r) of the windows all of whose terms occur: offset o, rank r from the corpus' rarest term (1) on."""
    df = idx.groupBy("term").agg(F.count("*").alias("df"))
    each = wins.select("win_id", "n", F.posexplode("win").alias("o", "term")).join(df, "term")
    of = Window.partitionBy("win_id")
    each = each.select("*", F.row_number().over(of.orderBy("df", "term", "o")).alias("r"), F.count("*").over(of).alias("known"))
    return each.where("known = n").select("win_id", "n", "o", "term", "r")


def _confirmed(found: DataFrame, ranked: DataFrame, idx: DataFrame, first: int, last: int) -> DataFrame:
    """Of (win_id, n, key, th, start), those whose terms of rank first to last all stand at their offsets."""
    at = ["win_id", "n", "key", "th", "start"]
    terms = checked_broadcast(ranked.where(F.col("r").between(first, last)).select("win_id", "o", "term"))
    due = found.where(F.col("n") >= first).join(terms, "win_id").select(*at, "term", (F.col("start") + F.col("o")).alias("pos"))
    seen = due.join(idx.select("key", "th", "term", "pos"), ["key", "th", "term", "pos"], "left_semi")
    full = seen.groupBy(*at).agg(F.count("*").alias("c")).where(F.col("c") == F.least("n", F.lit(last)) - first + 1).select(*at)
    return full.unionByName(found.where(F.col("n") < first))


def phrase_matches(idx: DataFrame, wins: DataFrame) -> DataFrame:
    """(win_id, n, key, th, start) of every exact occurrence of the windows (win_id, win, n) in the indexed documents."""
    ranked = materialize(ranked_terms(wins, idx), "ranked-terms")
    rarest = checked_broadcast(ranked.where("r = 1").select("win_id", "n", "o", "term"))
    start = F.col("pos") - F.col("o")
    found = idx.join(rarest, "term").where(start >= 0).select("win_id", "n", "key", "th", start.alias("start")).distinct()
    second = ranked.where("r = 2").select("term").distinct()
    found = materialize(_confirmed(found, ranked, idx.join(checked_broadcast(second), "term", "left_semi"), 2, 2), "candidates")
    held = materialize(found.select("key", "th").distinct(), "candidate-documents")
    lists = idx.join(checked_broadcast(held), ["key", "th"], "left_semi")
    return _confirmed(found, ranked, lists, 3, 1 << 20)


def near_phrases(idx: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Proximity matches: (t1, t2, doc_id, p1, p2) where two indexed terms of pairs (t1, t2) stand at most `within` words apart.

    Lists join on document and on a block of `within` positions and its neighbours, so no list is crossed with another.
    Rows that repeat an id and its text count once.
    """
    lists = idx.select("term", "doc_id", "key", "th", "pos").distinct()
    left = lists.join(pairs, lists["term"] == pairs["t1"]).select("t1", "t2", "doc_id", "key", "th", F.col("pos").alias("p1"), F.explode(F.array(*[F.floor(F.col("pos") / within) + d for d in (-1, 0, 1)])).alias("cell"))
    right = lists.select(F.col("term").alias("t2"), "key", "th", F.col("pos").alias("p2"), F.floor(F.col("pos") / within).alias("cell"))
    return left.join(right, ["t2", "key", "th", "cell"]).where(F.abs(F.col("p1") - F.col("p2")).between(1, within)).select("t1", "t2", "doc_id", "p1", "p2")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per input row.

    A word is hit if any occurrence of any item's window covers it. contaminated: n_hit > 0 and
    20 * n_hit >= n_words. A null or wordless text has no words and no hits; null item texts have no
    windows; equal windows of several items count for each. Rows of one id and different texts are
    told apart by a hash of the text, repeated rows get equal results; a null id is an id. Empty tables give no
    rows (documents) or no hits (benchmark). Other columns of either table are not looked at.
    """
    return _judged(docs, benchmark, size).drop("th")


def _judged(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """contamination with th, the row's text_key, beside doc_id."""
    by_item = materialize(windows(benchmark, size), "windows")
    idx = index(docs, by_item.select(F.explode("win").alias("term")).distinct())
    found = materialize(phrase_matches(idx, by_item.select("win_id", "win", "n").distinct()), "occurrences")
    spans = found.groupBy("key", "th").agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("z")))).alias("s"))
    add = lambda st, x: F.struct(F.greatest(st["end"], x["z"]).alias("end"), (st["n"] + F.greatest(F.lit(0), x["z"] - F.greatest(x["a"], st["end"]))).alias("n"))
    hits = spans.select("key", "th", F.aggregate("s", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add)["n"].cast("long").alias("n_hit"))
    named = checked_broadcast(by_item.select("win_id", "item_id").distinct())
    items = found.select("key", "th", "win_id").distinct().join(named, "win_id").groupBy("key", "th").agg(F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    marks = hits.join(items, ["key", "th"])
    rows = idx.where(F.col("term") == END).select("doc_id", "key", "th", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(marks, ["key", "th"], "left").select(
        "doc_id", "th", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """docs without its contaminated rows, with its own columns. Clean rows that share a contaminated row's id, or lack one too, stay."""
    bad = _judged(docs, benchmark, size).where("contaminated").select("doc_id", "th").distinct()
    bad = checked_broadcast(materialize(bad, "contaminated"))
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (text_key(docs["doc_id"], docs["text"]) == bad["th"])
    return docs.join(bad, same, "left_anti")
