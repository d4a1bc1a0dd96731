"""Quality classifier: ordinal cumulative-link (proportional odds) regression on hashed text features.

One weight vector over hashed features gives a document's score f; ordered thresholds turn it into grade
probabilities, P(grade <= k) = sigmoid(theta_k - f). The expected grade ranks documents, the tail
probability P(grade >= k) selects them. The fit runs L-BFGS whose gradients are summed from Spark partitions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .fitting import minimise

#: Hashed features.
FEATURES = 1 << 18
#: Labelled documents the fit uses at most, chosen by a hash of the id: the fit's stated bound.
SAMPLE = 12_000
#: Partitions of the sample, each of which returns one gradient a round.
PARTS = 6
#: Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
#: A document stays if P(grade 2) reaches this.
KEEP_TAIL = 0.5
#: Words whose features a worker keeps.
KEPT_WORDS = 400_000

_EDGES = re.compile(r"^\W+|\W+$")
_RUNS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))


def _index(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) % FEATURES


class _Words(dict):
    def __missing__(self, word: str) -> tuple[int, str]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        core = _EDGES.sub("", word).lower()
        case = "A" if len(core) > 1 and word.isupper() else "a"
        shape = _RUNS[1].sub("0", _RUNS[0].sub(case, word))[:6]
        self[word] = out = (_index(f"w:{core}"), shape)
        return out


_WORDS = _Words()


def features(text: str | None) -> list[int]:
    """Sorted hashed features: words, how often each word shape occurs (on a log scale), distinct words and length."""
    words = (text or "").split()
    if not words:
        return [_index("empty")]
    n, seen = len(words), list(map(_WORDS.__getitem__, words))
    out = {i for i, _ in seen}
    for shape, c in Counter(s for _, s in seen).items():
        out.add(_index(f"s:{shape}:{max(-7, int(np.log2(c / n)))}"))
    out.add(_index(f"d:{int(10 * len(set(words)) / n)}:{min(8, n.bit_length())}"))
    out.add(_index(f"n:{min(15, n.bit_length())}"))
    return sorted(out)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def _cumulative(f: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= k) for k = -1 .. GRADES-1, a column each."""
    inner = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - f[:, None], -40, 40)))
    return np.hstack([np.zeros((len(f), 1)), inner, np.ones((len(f), 1))])


def _thresholds(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([x[:1], np.exp(x[1:])]))


def _gradient(x: np.ndarray):
    """A partition's loss and gradient at x: weights, then the first threshold and the logs of the gaps between them.

    Every round sends the weights to all executors anew, so they go as float32 and nothing else goes with them.
    """
    many, weights, gaps, thresholds = len(x) - GRADES + 1, x[: 1 - GRADES].astype(np.float32), np.exp(x[2 - GRADES :]), _thresholds(x[1 - GRADES :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, seen = 0.0, np.zeros(many + GRADES - 1), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            y = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            f = np.add.reduceat(weights[flat].astype(float), offsets[:-1])
            c = _cumulative(f, thresholds)
            rows = np.arange(len(y))
            high, low = c[rows, y + 1], c[rows, y]
            p = np.maximum(high - low, 1e-12)
            loss -= np.log(p).sum()
            dh, dl = high * (1 - high), low * (1 - low)
            grad[:many] += np.bincount(flat, np.repeat((dh - dl) / p, np.diff(offsets)), many)
            by = np.zeros(GRADES - 1)
            np.add.at(by, y[y < GRADES - 1], -(dh / p)[y < GRADES - 1])
            np.add.at(by, y[y > 0] - 1, (dl / p)[y > 0])
            grad[many] += by.sum()
            for k in range(1, GRADES - 1):
                grad[many + k] += by[k:].sum() * gaps[k - 1]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.astype(np.float32).tobytes()], pa.binary())], ["loss", "grad"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = 1.0, rounds: int = 30) -> Model | None:
    """The model fitted on at most `sample` labelled documents, or None where there are none.

    Rows of labels with a null id, quality or toxic are left out; of several labels of an id the worst counts.
    Each round is one Spark job over the sample's features; a partition returns one gradient.
    """
    small_batches(docs.sparkSession)
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    feats = F.pandas_udf(lambda texts: pd.Series([features(t) for t in texts]), "array<int>")
    # `sample` rows of two numbers: bounded by the parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("grade", feats("text").alias("idx"))
    rows = materialize(rows.repartition(PARTS), "graded")  # after the scan and its features, which run in all tasks
    # the features the sample has, at most FEATURES; the others' weights stay 0, so rounds go without them
    used = np.array(sorted(r[0] for r in rows.select(F.explode("idx")).distinct().collect()), np.int32)
    if not len(used):
        return None
    place = F.pandas_udf(lambda lists: pd.Series([np.searchsorted(used, x).astype(np.int32) for x in lists]), "array<int>")
    rows = materialize(rows.select("grade", place("idx").alias("idx")), "graded-compact")

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.mapInArrow(_gradient(x), "loss double, grad binary").collect()  # a row per partition, at most PARTS
        w = np.concatenate([x[: len(used)], np.zeros(GRADES - 1)])
        return sum(p.loss for p in parts) + penalty / 2 * w @ w, sum(np.frombuffer(p.grad, np.float32).astype(float) for p in parts) + penalty * w

    x = minimise(value, np.concatenate([np.zeros(len(used)), [-2.0], np.zeros(GRADES - 2)]), rounds)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = x[: len(used)]
    return Model(weights, _thresholds(x[len(used) :]))


def graded(docs: DataFrame, model: Model | None, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """doc_id, score, expected_grade, p_tail (P(grade is the highest)), kept; one row per input row.

    Whole texts are scored. A null or empty text has the one feature "empty" and is scored by it;
    repeated rows get equal results. Without a model nothing speaks against a document and all are kept.
    """
    scored = _scored(docs, model, ["doc_id"])
    return scored.select("doc_id", "score", "expected_grade", "p_tail", (F.col("p_tail") >= keep_tail).alias("kept"))


def _scored(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    small_batches(docs.sparkSession)
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias("score"), F.lit(GRADES - 1.0).alias("expected_grade"), F.lit(1.0).alias("p_tail"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights: 1 MB

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = sent.value.weights
        return pd.Series([float(w[features(t)].sum()) for t in texts], dtype="float64")

    below = [1 / (1 + F.exp(F.col("score") - float(t))) for t in model.thresholds]
    rows = docs.select(*columns, score("text").alias("score"))
    return rows.withColumns({"expected_grade": GRADES - 1 - sum(below[1:], below[0]), "p_tail": 1 - below[-1]})


def accepted(docs: DataFrame, model: Model | None, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """docs with its own columns, without the rows the classifier rejects."""
    columns = list(docs.columns)
    renamed = docs.toDF(*[f"_c{k}_{c}" for k, c in enumerate(columns)]).withColumn("text", F.col(f"`_c{columns.index('text')}_text`"))
    kept = _scored(renamed, model, [f"`{c}`" for c in renamed.columns if c != "text"]).where(F.col("p_tail") >= keep_tail)
    return kept.select(*[F.col(f"`_c{k}_{c}`").alias(c) for k, c in enumerate(columns)])
