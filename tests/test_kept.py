"""The kept ledger: whole commits, pinned readers, compaction, conflicts, upgrades and deletion."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.durable import shared_folder
from ledgerloom.operators.kept import Conflict, Ledger, canonical_changes, faultless, link_changes

TABLES = {"a": (["k"], "k long, v string"), "b": (["k", "j"], "k long, j string, n int")}


@pytest.fixture
def kept(spark):
    return Ledger.create(spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}", TABLES, buckets=4)


def _rows(kept, table="a", version=None):
    return {tuple(r) for r in kept.read(table, version).collect()}


def _a(spark, *rows):
    return spark.createDataFrame(rows, "k long, v string, gone boolean")


def test_against_a_dict(spark, kept):
    rng, want, past = random.Random(4), {}, {}
    for step in range(7):
        keys = rng.sample(range(20), 6)
        rows = [(k, f"v{step}", rng.random() < 0.3) for k in keys]
        n = kept.commit({"a": _a(spark, *rows)})
        for k, v, gone in rows:
            want.pop(k, None) if gone else want.update({k: v})
        past[n] = set(want.items())
        if step % 3 == 2:
            n = kept.compact("a")
            past[n] = set(want.items())
            assert kept.manifest()["tables"]["a"]["log"] == []
    assert all(_rows(kept, version=n) == rows for n, rows in past.items()) and _rows(kept) == set(want.items())
    assert _rows(kept, "b") == set()


def test_a_commit_that_fails_midway_changes_nothing(spark, kept):
    kept.commit({"a": _a(spark, (1, "x", None)), "b": spark.createDataFrame([(1, "j", 2)], "k long, j string, n int")})
    at = kept.version()
    broken = spark.range(1).select(F.lit(1).cast("long").alias("k"), F.lit("j").alias("j"), F.raise_error(F.lit("killed")).cast("int").alias("n"))
    with pytest.raises(Exception, match="killed"):
        kept.commit({"a": _a(spark, (1, "y", None), (2, "z", None)), "b": broken})
    assert kept.version() == at and _rows(kept) == {(1, "x")} and _rows(kept, "b") == {(1, "j", 2)}


def test_a_manifest_cut_off_in_writing_is_no_version(spark, kept):
    kept.commit({"a": _a(spark, (1, "x", None))})
    at = kept.version()
    fs, path = kept._fs(f"{kept.path}/versions/{at + 1:010}.json")
    out = fs.create(path)
    out.write(bytearray(b'{"version'))
    out.close()
    assert kept.version() == at and _rows(kept) == {(1, "x")}
    assert kept.commit({"a": _a(spark, (2, "y", None))}) == at + 2 and _rows(kept) == {(1, "x"), (2, "y")}


def test_of_two_commits_on_one_version_one_is_refused(spark, kept):
    at = kept.version()
    kept.commit({"a": _a(spark, (1, "x", None))}, based_on=at)
    with pytest.raises(Conflict):
        kept.commit({"a": _a(spark, (1, "y", None))}, based_on=at)
    assert _rows(kept) == {(1, "x")}


def test_compaction_writes_only_the_buckets_it_touches(spark, kept):
    kept.commit({"a": _a(spark, *[(k, "x", None) for k in range(40)])})
    kept.compact("a")
    before = kept.manifest()["tables"]["a"]["state"]
    kept.commit({"a": _a(spark, (7, "new", None), (8, "", True))})
    kept.compact("a")
    after = kept.manifest()["tables"]["a"]["state"]
    assert len(before) == 4 and 0 < sum(before[b] != after[b] for b in before) <= 2
    assert _rows(kept) == {(k, "new" if k == 7 else "x") for k in range(40) if k != 8}
    kept.commit({"a": _a(spark, *[(k, "", True) for k in range(40)])})
    kept.compact("a")
    assert _rows(kept) == set() and kept.manifest()["tables"]["a"]["state"] == {}


def test_deletion_and_forgetting(spark, kept):
    kept.commit({"a": _a(spark, (1, "x", None))})
    at = kept.version()
    assert {tuple(r) for r in kept.delete_all().collect()} == {("a", 1), ("b", 0)}
    assert _rows(kept) == set() and _rows(kept, version=at) == {(1, "x")}
    folder = kept.manifest(at)["tables"]["a"]["log"][0]
    kept.commit({"a": _a(spark, (2, "y", None))})
    kept.forget(kept.version())
    fs, path = kept._fs(f"{kept.path}/{folder}")
    assert not fs.exists(path) and _rows(kept) == {(2, "y")}
    with pytest.raises(FileNotFoundError):
        kept.manifest(at)


def test_upgrades_are_chained(spark, kept):
    kept.commit({"a": _a(spark, (1, "x", None))})
    two = ({"a": (["k"], "k long, v string, w string")}, lambda t: {"a": t["a"].withColumn("w", F.upper("v"))})
    three = ({"a": (["k"], "k long, w string")}, lambda t: {"a": t["a"].select("k", F.concat("v", "w").alias("w"))})
    at = kept.version()
    with pytest.raises(ValueError, match="too old"):
        kept.upgrade({3: three})
    with pytest.raises(Exception, match="broken"):
        kept.upgrade({2: two, 3: (three[0], lambda t: {"a": t["a"].select("k", F.raise_error(F.lit("broken")).cast("string").alias("w"))})})
    assert kept.version() == at and kept.manifest()["format"] == 1
    n = kept.upgrade({2: two, 3: three})
    assert _rows(kept) == {(1, "xX")} and kept.upgrade({2: two, 3: three}) == n and _rows(kept, version=at) == {(1, "x")}
    with pytest.raises(ValueError, match="newer"):
        kept.upgrade({2: two})


def test_faults_of_changes(spark):
    some = spark.createDataFrame([("c1", 5, False), ("c2", 6, True)], "canonical_id string, n int, deleted boolean")
    shape = "canonical_id string, action string, actor string, happened_at string, n int"
    asked = [("c1", "create"), ("c2", "update"), ("c3", "update"), ("c4", "create"), ("c5", "what"), ("c6", "create"), ("c6", "create")]
    rows = spark.createDataFrame([(c, a, "u", "t", 9) for c, a in asked], shape)
    got = {(r.canonical_id, r.fault) for r in canonical_changes(some, rows, ["n"]).collect()}
    assert got == {("c1", "there already"), ("c2", "deleted"), ("c3", "not there"), ("c4", None), ("c5", "unknown action"), ("c6", "asked twice")}
    with pytest.raises(Conflict, match="1 x deleted"):
        faultless(canonical_changes(some, rows, ["n"]))
    more = spark.createDataFrame([(c, a, "u", "t", None) for c, a in (("c1", "restore"), ("c2", "delete"), ("c9", "delete"))], shape)
    assert {(r.canonical_id, r.fault) for r in canonical_changes(some, more, ["n"]).collect()} == {("c1", "not deleted"), ("c2", "deleted already"), ("c9", "not there")}
    good = canonical_changes(some, spark.createDataFrame([("c1", "delete", "u", "t", 7), ("c2", "restore", "u", "t", 7)], shape), ["n"]).collect()
    assert {(r.canonical_id, r.n, r.deleted, r.before, r.after) for r in good} == {("c1", 5, True, '{"n":5}', '{"deleted":true}'), ("c2", 6, False, '{"deleted":true}', '{"deleted":false}')}
    links = spark.createDataFrame([("c1", "r1")], "canonical_id string, raw_id string")
    raws = spark.createDataFrame([("r1",), ("r2",)], "raw_id string")
    asked = spark.createDataFrame([("c1", "r1", "link"), ("c1", "r2", "link"), ("c2", "r2", "unlink"), ("c9", "r2", "link"), ("c2", "r9", "link"), ("c2", "r1", None)], "canonical_id string, raw_id string, action string")
    got = {(r.canonical_id, r.raw_id): r.fault for r in link_changes(links, some, raws, asked).collect()}
    assert got == {("c1", "r1"): "linked already", ("c1", "r2"): None, ("c2", "r2"): "not linked", ("c9", "r2"): "no canonical row", ("c2", "r9"): "no raw row", ("c2", "r1"): "unknown action"}
