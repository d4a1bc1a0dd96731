"""Hot keys, gradients and host scores against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import common, quality_classifier, quality_rules, url_filters


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_rows_of_hot_and_other_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(hot)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(60), i) for i in range(300)] + [(None, 1)]
    many = {k: n for k, n in Counter(r[0] for r in rows if r[0] is not None).items() if n > 3}
    got = common.with_keys(spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame(list(many.items()), "k long, n long"), ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in many)
    none = common.with_keys(spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame([], "k long, n long"), ["k"])
    assert none.count() == 0


def test_classifier_gradient_against_finite_differences():
    rng = np.random.default_rng(3)
    grades = quality_classifier.GRADES
    y, lists = rng.integers(0, grades, 40), [sorted(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array(lists, pa.list_(pa.int32()))], ["grade", "idx"])
    # weights with few bits, which float32 holds exactly
    x = np.concatenate([rng.integers(-64, 64, 12) / 64, [-0.5], rng.normal(size=grades - 2) / 4])

    def at(v):
        out = next(quality_classifier._gradient(v)(iter([batch]))).to_pylist()[0]
        return out["loss"], np.frombuffer(out["grad"], np.float32)

    step = 2.0**-10
    for k, g in enumerate(at(x)[1]):
        e = np.eye(len(x))[k] * step
        assert abs((at(x + e)[0] - at(x - e)[0]) / (2 * step) - g) < 1e-3
    loss = 0.0
    cuts = np.concatenate([[-np.inf], quality_classifier._thresholds(x[1 - grades :]), [np.inf]])
    for grade, idx in zip(y, lists, strict=True):
        below = lambda t, f=x[idx].sum(): 1 / (1 + np.exp(-(t - f)))
        loss -= np.log(below(cuts[grade + 1]) - below(cuts[grade]))
    assert abs(loss - at(x)[0]) < 1e-6


def test_host_scores_against_power_iteration(spark):
    rng = random.Random(4)
    hosts = [f"h{i}" for i in range(30)]
    edges = {(a, b): rng.randint(1, 5) for a in hosts[:25] for b in rng.sample(hosts, 3) if a != b} | {(a, "h7"): 9 for a in hosts[8:25]}
    seeds = [("h1", "allow", 2), ("h2", "allow", 1), ("h7", "block", 3), ("h28", "block", 1)]
    got = {r["host"]: r for r in url_filters.propagate(spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, verdict string, weight long"), 1e-9).collect()}
    for side, column in (("allow", "trust"), ("block", "distrust")):
        flow = np.zeros((30, 30))
        for (a, b), n in edges.items():
            i, j = (hosts.index(a), hosts.index(b))[:: 1 if side == "allow" else -1]
            flow[i, j] += n
        jump = np.zeros(30)
        for h, s, w in seeds:
            jump[hosts.index(h)] += w * (s == side)
        jump /= jump.sum()
        sends = flow.sum(axis=1)
        flow = np.where(sends[:, None] > 0, flow / np.maximum(sends, 1)[:, None], jump[None, :])
        p = jump
        for _ in range(400):
            p = 0.85 * p @ flow + 0.15 * jump
        for k, h in enumerate(hosts):
            assert abs((got[h][column] if h in got else 0.0) - p[k]) < 1e-6, (side, h)


def test_rule_that_alone_speaks_against_a_row(spark):
    docs = spark.createDataFrame([(1, None), (2, "a few words"), (3, " ".join(f"word{i}" for i in range(20))), (4, " ".join("a b c d e f g h i j k".split())), (5, "# " * 40)], "doc_id long, text string")
    ledger = quality_rules.stored_ledger(docs)
    found = {r["doc_id"]: (r["kept"], r["only_failure"]) for r in quality_rules.apply_policy(ledger, quality_rules.V1).collect()}
    assert found == {1: (False, "few_words"), 2: (False, "few_words"), 3: (True, None), 4: (False, "short_words"), 5: (False, None)}
    cut = {r["rule"]: r["failed_only"] for r in quality_rules.ablations(ledger, quality_rules.V1).collect()}
    assert cut == {"few_words": 2, "repeated_windows": 0, "symbols": 0, "repeated_lines": 0, "short_words": 1}
