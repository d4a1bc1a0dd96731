"""The acceptance run: its report against counts made another way, and a second run that computes nothing."""

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import lone
from ledgerloom.operators.acceptance import accept
from ledgerloom.operators.durable import shared_folder
from ledgerloom.operators.stages import Stages, content_fingerprint
from ledgerloom.plans.store import load


def test_one_run(spark):
    folder = f"{shared_folder(spark)}/accepted-{uuid.uuid4().hex}"
    raws = load(spark, "/root/testdata/sf0.001", "raws").where("booking_date < date'1996-06-01'")
    first = Stages(spark, folder)
    got = accept(first, raws)
    report = {r.measure: r.value for r in got["report"].rows.collect()}
    assert first.computed.count("candidates") == 1 and len(first.computed) == len(set(first.computed)) == 14
    again = Stages(spark, folder)
    assert {r.measure: r.value for r in accept(again, raws.repartition(3))["report"].rows.collect()} == report and again.computed == []

    candidates = got["candidates"].rows.collect()
    found = {n: {(r.left_raw_id, r.right_raw_id) for r in got[n].rows.collect()} for n in ("exact_payment_match", "unique_statement_match", "ordered_statement_match", "pending_match_candidate")}
    assert {n: int(report[f"{n}_count"]) for n in found} == {n: len(s) for n, s in found.items()}
    # the passes by hand, over the candidates
    alone = lambda rows: [r for r in rows if sum(x.left_raw_id == r.left_raw_id for x in rows) == sum(x.right_raw_id == r.right_raw_id for x in rows) == 1]
    exact = {(r.left_raw_id, r.right_raw_id) for r in alone(candidates) if "bank_suffix_exact" in r.evidence and "datetime_" in r.evidence}
    taken = {i for p in exact for i in p}
    unique = {(r.left_raw_id, r.right_raw_id) for r in alone([r for r in candidates if not taken & {r.left_raw_id, r.right_raw_id}])}
    assert found["exact_payment_match"] == exact and found["unique_statement_match"] == unique
    taken = {i for n, s in found.items() if n != "pending_match_candidate" for p in s for i in p}
    assert found["pending_match_candidate"] == {(r.left_raw_id, r.right_raw_id) for r in candidates if not taken & {r.left_raw_id, r.right_raw_id}}
    # every raw row is in one canonical row or waits
    made, waiting = [i for r in got["canonical"].rows.collect() for i in r.raw_ids], {i for p in found["pending_match_candidate"] for i in p}
    assert len(made) == len(set(made)) and set(made) | waiting == {r.raw_id for r in raws.collect()}
    assert int(report["raw_count"]) == raws.count() and int(report["canonical_count"]) == got["canonical"].rows.count()
    assert int(report["safe_classification_count"]) == got["classes"].rows.where("confidence >= 0.88").count()


def test_a_changed_input_is_computed_anew(spark):
    folder = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert content_fingerprint(one) == content_fingerprint(one.orderBy(F.desc("k"))) != content_fingerprint(one.distinct())
    for rows, work in ((one, ["double"]), (one.repartition(2), []), (one.limit(2), ["double"])):
        s = Stages(spark, folder)
        assert s.run("double", lambda r: r.withColumn("k", F.col("k") * 2), s.given("in", rows)).rows.count() == rows.count() and s.computed == work
    s = Stages(spark, folder)
    s.run("double", lambda r: r, s.given("in", one), version="2")
    assert s.computed == ["double"]


def test_candidates_are_kept_as_rows(spark):
    one = "'expense' as direction, '星巴克' as merchant, '' as counterparty, '' as description, '招商银行' as payment_method, '9001' as bank_card_suffix, '' as status, cast(1 as decimal(18)) as balance, cast(null as long) as raw_row_number"
    side = lambda p, source: spark.range(30).selectExpr(f"concat('{p}', id) as raw_id", f"'{source}' as source", "timestamp_ntz'2024-01-01 10:00:00' as transaction_time", "date'2024-01-01' as booking_date", "cast(5 as decimal(18,2)) as amount", *one.split(", "))
    rows = lone.candidate_rows(side("W", "alipay"), side("B", "bank")).cache()
    # 900 candidates of 60 rows, all of which wait as bank rows without a place are in no order
    assert rows.count() == 60 and {r.n_rows for r in rows.collect()} == {60} and lone.candidates_of(rows).count() == 900
    assert lone.lone_of(rows).isEmpty() and lone.ordered_of(rows, side("W", "alipay"), side("B", "bank")).isEmpty()
    assert {(r.bank, r.degree) for r in lone.with_degrees_of(rows).collect()} == {(False, 30), (True, 30)}
