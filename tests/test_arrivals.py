"""The engine over a stream against the batch engine, with restarts, late rows and state that ends."""

import random
import uuid
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F
from test_matching import ROWS, _dense, _row

from ledgerloom.operators import engine
from ledgerloom.operators.durable import shared_folder
from ledgerloom.streaming import arrivals, ingest


def _streamed(spark, batches, late="400 days"):
    """Each batch arrives before a run of its own, which goes on from the checkpoint."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        ingest.run_once(arrivals.changes(spark.readStream.schema(ROWS).parquet(f"{folder}/in"), late), folder)
    found = spark.read.parquet(f"{folder}/out")
    return {r.row_id: (r.status, r.level, r.duplicate_of, r.kept) for r in arrivals.latest(found).collect()}, found


def test_five_deliveries_end_as_one(spark):
    rng = random.Random(6)
    rows = [(*r[:2], k, *r[3:]) for k, r in enumerate(_dense(rng, 250, ["a", "b"], 3, [500, 500, 560, 640, 10_000]))]
    got, found = _streamed(spark, [rows[k : k + 50] for k in range(0, 250, 50)])
    whole = engine.resolve(spark.createDataFrame(rows, ROWS)).collect()
    assert got == {r.row_id: (r.status, r.level, r.duplicate_of, r.kept) for r in whole}
    assert found.count() > len(rows)  # some rows lost to later ones


def test_a_late_row_meets_earlier_ones_until_their_state_ends(spark):
    first = [_row(1, "bank", "2024-03-01 10:00:20", "-35.00"), _row(2, "alipay", "2024-03-20 10:00:00", "-8.00")]
    late = [_row(3, "alipay", "2024-03-01 10:00:00", "-35.00")]
    got, _ = _streamed(spark, [first, late], "30 days")
    assert got["r1"] == ("DUPLICATE", "L1", "r3", False) and got["r3"][:2] == ("UNIQUE", "L1")
    # with a watermark of a day, the row of March 1st is gone when its partner comes, and the partner is too late to be taken
    got, _ = _streamed(spark, [first, [_row(4, "alipay", "2024-03-21 10:00:00", "-8.00")], late], "1 day")
    assert got["r1"][0] == "UNIQUE" and "r3" not in got


def test_the_registered_query_keeps_every_row(spark):
    from ledgerloom.plans.match_queries import _engine_rows
    from ledgerloom.plans.source_queries import stream_engine

    sf = "/root/testdata/sf0.001"
    fifth = (F.pmod("seq", F.lit(1000)) * 5 / 1000).cast("long")
    rows = _engine_rows(spark, sf).withColumn("seq", F.col("seq") + fifth * (1 << 40))
    result = lambda df: {(r.row_id, r.status, r.level, r.duplicate_of, r.kept) for r in df.collect()}
    assert result(stream_engine(spark, sf)) == result(engine.resolve(rows))


def test_rows_are_made_only_where_a_new_one_may_meet_them(monkeypatch):
    made = []
    whole = arrivals._row
    monkeypatch.setattr(arrivals, "_row", lambda x: made.append(x[0]) or whole(x))
    rows = pd.DataFrame([(f"r{k}", k, "bank", k * 600, 0, 500, True, "a", False, False, 1, 2, True, False) for k in range(2000)], columns=[*arrivals._FIELDS, "new"])
    new = pd.DataFrame([("n", 9000, "alipay", 6030, 0, 500, True, "a", False, False, 3, 2, True, True)], columns=rows.columns)
    out, left = arrivals._changes(arrivals._slim(pd.concat([rows, new], ignore_index=True)))
    assert sorted(made) == ["n", "r10"] and len(left) == 2000
    assert out == [("n", 9000, "UNIQUE", "L1", None, True), ("r10", 9000, "DUPLICATE", "L1", "n", False)]
