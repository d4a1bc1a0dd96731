"""Registered queries over a kept ledger: it is created in the shared folder, changed by commits and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import warnings
from ledgerloom.operators.durable import cut, shared_folder
from ledgerloom.operators.kept import Ledger, canonical_changes, faultless, link_changes
from ledgerloom.plans.registry import Registry
from ledgerloom.plans.store import ctes, load

query = Registry()

_MONEY = "decimal(18,2)"
_FIELDS = ["booking_date", "amount", "merchant", "category", "notes"]
_TABLES = {
    "canonicals": (["canonical_id"], f"canonical_id string, booking_date date, amount {_MONEY}, merchant string, category string, notes string, deleted boolean"),
    "links": (["canonical_id", "raw_id"], "canonical_id string, raw_id string, confidence decimal(4,2), actor string"),
    "snapshots": (["snapshot_id"], f"snapshot_id string, source string, source_account string, balance {_MONEY}, balance_kind string, as_of date, created_by string, note string"),
    "events": (["canonical_id", "happened_at", "action"], "canonical_id string, happened_at timestamp_ntz, action string, actor string, before string, after string"),
}

def _n():
    return F.expr("cast(substring(canonical_id, 2) as bigint)")

_AT = "1999-01-0{} 00:00:00"


def _opened(spark, d) -> Ledger:
    """The canonical rows and their links in one commit (M-35), compacted, with later changes of both in its log."""
    kept = Ledger.create(spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}", _TABLES, buckets=8)
    rows, links = load(spark, d, "canonicals"), load(spark, d, "links")
    kept.commit({"canonicals": rows.withColumn("deleted", F.lit(False)), "links": links.withColumn("actor", F.lit("import"))})
    kept.compact("canonicals")
    kept.compact("links")
    return kept


def _change(kept, asked):
    made = cut(faultless(canonical_changes(kept.read("canonicals"), asked, _FIELDS)))
    return {"canonicals": made, "events": made}


def _asked(rows, action, day, **fields):
    put = {f: fields.get(f, F.lit(None)) for f in _FIELDS}
    kinds = {"booking_date": "date", "amount": _MONEY}
    return rows.select("canonical_id", F.lit(action).alias("action"), F.lit("u1").alias("actor"), F.lit(_AT.format(day)).cast("timestamp_ntz").alias("happened_at"), *[c.cast(kinds.get(f, "string")).alias(f) for f, c in put.items()])


def _edited(spark, d) -> Ledger:
    """Every tenth row has a new category, every 30th is then deleted, every 60th restored, and as many are made by hand."""
    kept = _opened(spark, d)
    rows = load(spark, d, "canonicals").select("canonical_id", "booking_date", "amount")
    kept.commit(_change(kept, _asked(rows.where(_n() % 10 == 0), "update", 1, category=F.lit("edited"))))
    kept.commit(_change(kept, _asked(rows.where(_n() % 30 == 0), "delete", 2)))
    kept.compact("canonicals")
    by_hand = rows.where(_n() % 60 == 0).select(F.concat(F.lit("H"), _n()).alias("canonical_id"), "booking_date", "amount")
    both = _asked(rows.where(_n() % 60 == 0), "restore", 3).unionByName(_asked(by_hand, "create", 3, booking_date=F.col("booking_date"), amount=-F.col("amount"), merchant=F.lit("hand"), category=F.lit(""), notes=F.lit("")))
    kept.commit(_change(kept, both))
    return kept


_EDITED = f"""WITH {ctes('canonicals')}, k AS (SELECT *, canonical_id[2:]::BIGINT AS n FROM canonicals)"""


@query("kept_canonicals", _EDITED + """ SELECT canonical_id, booking_date, amount, merchant, CASE WHEN n % 10 = 0 THEN 'edited' ELSE category END AS category, notes, n % 30 = 0 AND n % 60 <> 0 AS deleted FROM k
UNION ALL SELECT 'H' || n, booking_date, -amount, 'hand', '', '', false FROM k WHERE n % 60 = 0""")
def kept_canonicals(spark, d):
    return _edited(spark, d).read("canonicals")


@query("kept_events", _EDITED + """, e AS (SELECT 'C' || n AS canonical_id, 'update' AS action, 1 AS day, category AS was, 'edited' AS now FROM k WHERE n % 10 = 0 UNION ALL SELECT 'C' || n, 'delete', 2, 'edited', NULL FROM k WHERE n % 30 = 0
UNION ALL SELECT 'C' || n, 'restore', 3, NULL, NULL FROM k WHERE n % 60 = 0 UNION ALL SELECT 'H' || n, 'create', 3, NULL, '' FROM k WHERE n % 60 = 0)
SELECT canonical_id, action, DATE '1998-12-31' + day AS day, 'u1' AS actor, was, now FROM e""")
def kept_events(spark, d):
    of = lambda c: F.get_json_object(c, "$.category")
    return _edited(spark, d).read("events").select("canonical_id", "action", F.col("happened_at").cast("date").alias("day"), "actor", of("before").alias("was"), of("after").alias("now"))


@query("kept_links", f"WITH {ctes('links')} SELECT canonical_id, raw_id, confidence, 'import' AS actor FROM links WHERE raw_id[2:]::BIGINT % 4 <> 0 OR raw_id[1:1] <> 'W' UNION ALL SELECT canonical_id, raw_id, 1.00, 'u2' FROM links WHERE raw_id[2:]::BIGINT % 8 = 0 AND raw_id[1:1] = 'W'")
def kept_links(spark, d):
    kept, links = _opened(spark, d), load(spark, d, "links").where("startswith(raw_id, 'W')")
    n, canonicals, raws = F.expr("cast(substring(raw_id, 2) as bigint)"), load(spark, d, "canonicals"), load(spark, d, "raws")
    for action, part in (("unlink", 4), ("link", 8)):
        asked = links.where(n % part == 0).select("canonical_id", "raw_id", F.lit(action).alias("action"), F.lit("1.00").cast("decimal(4,2)").alias("confidence"), F.lit("u2").alias("actor"))
        kept.commit({"links": faultless(link_changes(kept.read("links"), canonicals, raws, asked)).withColumn("gone", F.col("action") == "unlink")})
    kept.compact("links")
    return kept.read("links")


@query("kept_link_faults", f"""WITH {ctes('links')}, a AS (SELECT canonical_id, raw_id, CASE WHEN raw_id[2:]::BIGINT % 2 = 0 THEN 'linked already' END AS fault FROM links WHERE raw_id[1:1] = 'W')
SELECT raw_id, fault FROM a UNION ALL SELECT raw_id || 'x', CASE WHEN raw_id[2:]::BIGINT % 2 = 0 THEN 'no raw row' ELSE 'not linked' END FROM a""")
def kept_link_faults(spark, d):
    kept, links = _opened(spark, d), load(spark, d, "links").where("startswith(raw_id, 'W')")
    action = F.when(F.expr("cast(substring(raw_id, 2) as bigint)") % 2 == 0, "link").otherwise("unlink")
    asked = links.select("canonical_id", "raw_id", action.alias("action"), "confidence", F.lit("u2").alias("actor"))
    asked = asked.unionByName(asked.withColumn("raw_id", F.concat("raw_id", F.lit("x"))))
    return link_changes(kept.read("links"), load(spark, d, "canonicals"), load(spark, d, "raws"), asked).select("raw_id", "fault")


def _upgraded(tables):
    """Format 2 splits a note into words and drops the flag of deletion; format 3 names the year."""
    return {"canonicals": tables["canonicals"].where("not deleted").select("canonical_id", "amount", "booking_date", F.split("notes", "").alias("marks"))}


_STEPS = {
    2: ({"canonicals": (["canonical_id"], f"canonical_id string, amount {_MONEY}, booking_date date, marks array<string>")}, _upgraded),
    3: ({"canonicals": (["canonical_id"], f"canonical_id string, amount {_MONEY}, year int, n_marks int")}, lambda t: {"canonicals": t["canonicals"].select("canonical_id", "amount", F.year("booking_date").alias("year"), F.size(F.array_remove("marks", "")).alias("n_marks"))}),
}


@query("kept_upgraded", _EDITED + " SELECT canonical_id, amount, year(booking_date)::INT AS year, length(notes)::INT AS n_marks FROM k WHERE n % 30 <> 0 OR n % 60 = 0 UNION ALL SELECT 'H' || n, -amount, year(booking_date)::INT, 0 FROM k WHERE n % 60 = 0")
def kept_upgraded(spark, d):
    kept = _edited(spark, d)
    kept.upgrade(_STEPS)
    return kept.read("canonicals")


@query("kept_delete_counts", f"WITH {ctes('canonicals', 'links', 'snapshots')} SELECT 'canonicals' AS \"table\", count(*) AS n_rows, 0::BIGINT AS n_left FROM canonicals UNION ALL SELECT 'links', count(*), 0 FROM links UNION ALL SELECT 'snapshots', count(*), 0 FROM snapshots UNION ALL SELECT 'events', 0, 0")
def kept_delete_counts(spark, d):
    kept = _opened(spark, d)
    kept.commit({"snapshots": _snapshots(spark, d)})
    counts = kept.delete_all()
    left = [kept.read(t).agg(F.lit(t).alias("table"), F.count("*").alias("n_left")) for t in _TABLES]
    return counts.join(left[0].union(left[1]).union(left[2]).union(left[3]), "table")


def _snapshots(spark, d):
    asked = load(spark, d, "snapshots").select(F.concat(F.lit("s"), "seq").alias("snapshot_id"), F.concat(F.lit(" "), F.upper("source")).alias("source"), "source_account", F.col("balance").cast("string").alias("balance"), F.upper("balance_kind").alias("balance_kind"), "as_of", F.lit("u1 ").alias("created_by"), F.lit(None).cast("string").alias("note"))
    return faultless(warnings.checked_snapshots(asked))


@query("kept_snapshots", f"WITH {ctes('snapshots')} SELECT 's' || seq AS snapshot_id, source, source_account, balance, balance_kind, as_of, 'u1' AS created_by, '' AS note FROM snapshots")
def kept_snapshots(spark, d):
    kept = _opened(spark, d)
    kept.commit({"snapshots": _snapshots(spark, d)})
    return kept.read("snapshots")
