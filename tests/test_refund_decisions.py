"""Batches of decisions on refunds: faults, room left by order, choices superseded, refunds excluded; and the report of exact refunds."""

from decimal import Decimal

from ledgerloom.operators import refund_decisions as D
from ledgerloom.operators import refunds


def test_a_batch(spark):
    rel = [("r1", "a", "x", 60, "pending"), ("r2", "a", "y", 60, "pending"), ("r3", "b", "x", 50, "pending"), ("r4", "c", "x", 40, "pending"), ("r5", "d", "z", 5, "pending"), ("r6", "e", "y", 5, "confirmed"), ("r7", "e", "x", 1, "pending"), ("r8", "f", "y", 9, "pending"), ("r9", "f", "x", 9, "pending"), ("s1", "g", "y", 1, "pending"), ("s2", "g", "x", 1, "pending")]
    relationships = spark.createDataFrame([(*r[:3], Decimal(r[3]), r[4]) for r in rel], "relationship_id string, from_id string, to_id string, amount decimal(18,2), status string")
    canonicals = spark.createDataFrame([("x", Decimal(-100)), ("y", Decimal(-100))], "canonical_id string, amount decimal(18,2)")
    asked = ["r1 confirm", "r3 confirm", "r4 confirm", "r5 confirm", "r6 reject", "r7 confirm", "r8 exclude", "r9 confirm", "s1 reject", "r0 confirm", "r2 what"]
    decisions = spark.createDataFrame([(a.split()[0], k, a.split()[1], "u") for k, a in enumerate(asked)], "relationship_id string, seq int, decision string, actor string")
    judged = D.judged(relationships, canonicals, decisions)
    assert {r.relationship_id: r.fault for r in judged.collect()} == {
        "r1": None, "r3": "beyond the original", "r4": None, "r5": "no original", "r6": "decided already", "r7": "refund linked already", "r8": None, "r9": "refund decided in this batch", "s1": None, "r0": "unknown relationship", "r2": "unknown decision",
    }
    events = D.refund_events(relationships, judged)
    assert {(r.relationship_id, r.after) for r in events.collect()} == {("r1", "confirmed"), ("r2", "superseded"), ("r4", "confirmed"), ("r8", "rejected"), ("r9", "rejected"), ("s1", "rejected")}
    after = {r.relationship_id: r.status for r in D.after_decisions(relationships, events).collect()}
    assert after["s2"] == after["r3"] == "pending" and after["r2"] == "superseded" and len(after) == len(rel)
    assert [r.canonical_id for r in D.excluded_refunds(judged).collect()] == ["f"]
    assert D.judged(relationships, canonicals, decisions.limit(0)).collect() == []


def test_report_of_exact_refunds(spark):
    rows = spark.createDataFrame([("o", Decimal(-10), False), ("r", Decimal(10), True), ("q", Decimal(7), True), ("c", Decimal(3), True)], "row_id string, amount decimal(18,2), is_refund boolean")
    pairs = spark.createDataFrame([("r", "o")], "refund_id string, original_id string")
    (got,) = refunds.exact_refund_report(rows, pairs, rows.where("row_id = 'c'")).collect()
    assert tuple(got) == (4, 1, 1, 1, Decimal(10))
