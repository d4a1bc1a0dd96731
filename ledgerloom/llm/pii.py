"""Personal data: pattern spans, and terms whose corpus co-occurrence gives a protected entity away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Every value is a protected entity
with information content IC = log(N / df). A term anywhere in the documents that hold it discloses
PMI = log(N * joint / (df_entity * df_term)) of it. Where PMI reaches ALPHA * IC over enough different
contexts, every occurrence of the term in those documents is generalised; from BETA * IC on it is removed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, small_batches

#: Kinds in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone", "term")
#: Shares of an entity's information from which a term is generalised, and removed.
ALPHA, BETA = 0.75, 0.95
#: Different contexts of the entity an association needs, so that copies of one text prove nothing; words of context on each side.
SUPPORT, AROUND = 3, 8

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part reaches back from its @ to the last match or a character that it can't have, so each @ is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (done := m.end())
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) sorted, over the whole text, in code points."""
    out = [(a, 0, z) for a, z in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := "".join(_DIGITS.findall(m[0]))) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


def _entities(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[dict], list[dict]]:
    """The mentions (entity, a hash of the words around it), and the distinct words of the whole text with their places; words that a span touches are left out."""
    covered, top = [], -1
    for a, _, z in spans:  # sorted by start: join what overlaps
        if a < top:
            covered[-1][1] = top = max(top, z)
        else:
            covered.append([a, z])
            top = z
    free, k = [], 0
    for m in _TERM.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or covered[k][0] >= m.end():
            free.append((m[0].lower(), m.start(), m.end()))
    starts, out, places = [f[1] for f in free], [], {}
    for start, kind, end in spans:
        value = text[start:end].lower() if kind == 0 else "".join(_DIGITS.findall(text[start:end])) if kind > 1 else text[start:end]
        at, to = bisect_left(starts, start), bisect_left(starts, end)
        ctx = " ".join(t for t, _, _ in [*free[max(0, at - AROUND) : at], *free[to : to + AROUND]])
        out.append({"entity": f"{KINDS[kind]}:{value}", "ctx": int.from_bytes(hashlib.blake2b(ctx.encode(), digest_size=8).digest(), "big", signed=True)})
    for t, a, z in free:
        places.setdefault(t, []).append({"start": a, "end": z})
    return out, [{"term": t, "at": at} for t, at in places.items()]


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_FOUND = f"base {_SPANS}, mentions array<struct<entity:string,ctx:long>>, words array<struct<term:string,at:array<struct<start:int,end:int>>>>"
_TYPES = (
    pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])),
    pa.list_(pa.struct([("entity", pa.string()), ("ctx", pa.int64())])),
    pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])),
)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        spans = [base_spans(t) for t in texts]
        both = [_entities(t, s) if s else ([], []) for t, s in zip(texts, spans, strict=True)]
        base = [[{"start": a, "kind": k, "end": z} for a, k, z in s] for s in spans]
        cols = [pa.array(base, _TYPES[0]), pa.array([m for m, _ in both], _TYPES[1]), pa.array([w for _, w in both], _TYPES[2])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "th", "base", "mentions", "words"])


def disclosing_terms(found: DataFrame, docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(entity, term, disclosure): terms that disclose at least alpha of an entity's information content.

    Document frequencies count all of docs; joint counts documents that hold the entity and, anywhere, the
    term. An entity with fewer contexts than support has no pair with enough, so its pairs are not made; nor
    are those whose term is so frequent that even with every document of the entity it discloses less than alpha.
    Counts combine before every shuffle, so a frequent entity or word is no single task's work.
    """
    said = found.where(F.size("mentions") > 0).select("doc_id", "th", F.explode("mentions").alias("m")).select("doc_id", "th", "m.entity", "m.ctx").distinct()
    n = docs.count()
    df = said.groupBy("entity").agg(F.count_distinct("ctx").alias("seen"), F.count_distinct("doc_id", "th").alias("df_entity")).where(F.col("seen") >= support)
    said = materialize(said.join(df, "entity").select("doc_id", "th", "entity", "ctx", "df_entity"), "supported-mentions")
    held = F.transform("words", lambda w: w["term"])
    has = found.where(F.size("words") > 0).select("doc_id", "th", held.alias("has")).join(said.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi")
    has = materialize(has.select("doc_id", "th", F.explode("has").alias("term")).distinct(), "entity-words")
    terms = materialize(has.select("term").distinct(), "entity-terms")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{3,}"), F.lit(0)))
    # counted before the join, which then makes no more rows than there are terms
    counted = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df_term")).join(terms, "term")
    counted = materialize(counted, "term-counts")
    # joint <= df_entity, so disclosure >= alpha needs log(n / df_term) >= alpha * log(n / df_entity)
    rare = F.log(F.lit(n) / F.coalesce("df_term", F.lit(1))) >= F.lit(alpha) * F.log(F.lit(n) / F.col("df_entity")) - 1e-9
    pairs = materialize(has.join(counted, "term", "left").join(said, ["doc_id", "th"]).where(rare).select("doc_id", "th", "entity", "term", "ctx"), "pairs")
    contexts = pairs.select("entity", "term", "ctx").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    joint = pairs.select("doc_id", "th", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("joint"))
    likely = contexts.join(joint, ["entity", "term"]).join(df.select("entity", "df_entity"), "entity")
    both = likely.join(counted, "term", "left").withColumn("df_term", F.greatest("joint", F.coalesce("df_term", F.lit(0))))
    pmi, ic = F.log(n * F.col("joint") / (F.col("df_entity") * F.col("df_term"))), F.log(F.lit(n) / F.col("df_entity"))
    return both.where(F.col("df_entity") < n).select("entity", "term", (pmi / ic).alias("disclosure")).where(F.col("disclosure") >= alpha)


def personal_data(docs: DataFrame, alpha: float = ALPHA, beta: float = BETA, support: int = SUPPORT) -> DataFrame:
    """doc_id, th, found array<struct<start, kind, end, action>>, base array; one row per input row.

    found holds all spans, sorted by start, then kind; action is mask for patterns, generalise or remove
    for terms. A null text is empty. th is the text's hash: rows of one id with different texts are
    told apart; repeated rows get equal results; rows without an id keep a null id. Empty tables give empty results.
    """
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    found = materialize(rows.mapInArrow(_found, f"doc_id long, th long, {_FOUND}"), "pattern-spans")
    reveal = materialize(disclosing_terms(found, docs, alpha, support), "disclosing-terms")
    held = found.where(F.size("mentions") > 0)
    by_text = held.select("doc_id", "th", F.explode(F.array_distinct(F.transform("mentions", lambda m: m["entity"]))).alias("entity")).distinct()
    top = by_text.join(reveal, "entity").groupBy("doc_id", "th", "term").agg(F.max("disclosure").alias("disclosure"))
    places = held.join(top.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi").select("doc_id", "th", F.explode("words").alias("w"))
    places = places.select("doc_id", "th", "w.term", F.explode("w.at").alias("x")).select("doc_id", "th", "term", "x.start", "x.end")
    action = F.when(F.col("disclosure") >= beta, "remove").otherwise("generalise")
    marks = places.join(top, ["doc_id", "th", "term"]).groupBy("doc_id", "th", "start", "end").agg(F.max(action).alias("action"))
    span = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "action")
    marks = marks.groupBy("doc_id", "th").agg(F.collect_list(span).alias("terms"))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit("mask").alias("action")))
    spans = F.sort_array(F.concat(base, F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,action:string>>"))))
    out = found.join(marks, ["doc_id", "th"], "left").select("doc_id", "th", spans.alias("found"), "base")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def _as_text(spans):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return personal_data(docs).select("doc_id", *(count(k) for k in range(4)), F.sha2(_as_text("base"), 256).alias("base_sha256"), _as_text("found").alias("spans"), count(4))


def _sanitised(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, found in batches:
        out = []
        for text, spans in zip(texts, found, strict=True):
            parts, done = [], 0
            for s in spans if spans is not None else ():
                if s["start"] >= done:
                    word = text[s["start"] : s["end"]]
                    general = "[NAME]" if word[:1].isupper() else "[WORD]"
                    parts += [text[done : s["start"]], {"mask": f"[{KINDS[s['kind']].upper()}]", "generalise": general, "remove": ""}[s["action"]]]
                done = max(done, s["end"])
            out.append(text if text is None else "".join(parts) + text[done:])
        yield pd.Series(out, dtype=object)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with its own columns, its texts masked, generalised or shortened at the found spans. Null texts stay null."""
    spans = personal_data(docs).where(F.size("found") > 0).select("doc_id", "th", "found").distinct()
    spans = checked_broadcast(materialize(spans, "spans"))
    same = docs["doc_id"].eqNullSafe(spans["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == spans["th"])
    clean = F.pandas_udf(_sanitised, "string")(docs["text"], spans["found"]).alias("text")
    return docs.join(spans, same, "left").select(*[clean if c == "text" else docs[f"`{c}`"] for c in docs.columns])
