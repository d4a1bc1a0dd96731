"""Toxicity by multiple-instance learning: documents carry labels, sentences get scores.

A document is a bag of sentences. A sentence is toxic with probability p = sigmoid(bias + sum of the weights of its
distinct hashed words), a document by a leaky noisy-or: 1 - (1 - leak) * product of (1 - p). The leak takes up labels
that no sentence explains, so that long clean documents don't add them up. Weights, bias and leak are fitted to document
labels alone by L-BFGS whose gradients are summed from Spark partitions; sentence scores then say where a document offends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .fitting import minimise

#: Hashed words.
FEATURES = 1 << 18
#: Labelled documents the fit uses at most, chosen by a hash of the id: the fit's stated bound.
SAMPLE = 12_000
#: Partitions of the sample, each of which returns one gradient a round.
PARTS = 6
#: Words of one sentence; a longer run without an end is several.
SENTENCE_WORDS = 64
#: A label is held out if the crc32 of its doc_id has no remainder by this.
FOLDS = 5
#: A sentence offends from this probability on.
OFFENDS = 0.5
#: The logit of the leak until the words' weights are fitted; free from the start, it would take up all labels before they have moved.
LEAK = -3.0
#: Times the weights are refitted with penalties divided by their size, which leaves the labels to few words.
SPARSER = 3
#: Words whose weights a worker keeps.
KEPT_WORDS = 400_000

_WORD = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_STOP = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


class _Numbers(dict):
    """Word -> its feature, or -1 for a word without letters or digits."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        core = _EDGES.sub("", word).lower()
        self[word] = out = xxhash.xxh64_intdigest(core) % FEATURES if core else -1
        return out


class _Stops(dict):
    def __missing__(self, word: str) -> bool:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = out = bool(_STOP.search(word))
        return out


_NUMBERS, _STOPS = _Numbers(), _Stops()


def sentences(text: str) -> Iterator[list[str]]:
    """The words of each sentence, which ends at a stop, a line end or after SENTENCE_WORDS words; sentences have a word at least."""
    for line in text.split("\n"):
        words, start = line.split(), 0
        for k, word in enumerate(words, 1):
            if k == len(words) or k - start == SENTENCE_WORDS or word[-1] in ".!?…。！？\"'”’»)]" and _STOPS[word]:
                yield words[start:k]
                start = k


def features(words: list[str]) -> list[int]:
    """The sentence's distinct hashed words, sorted; empty if none has a letter or digit."""
    return sorted({_NUMBERS[w] for w in words} - {-1})


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    leak: float

    @cached_property
    def _weight(self):
        return [*self.weights.tolist(), 0.0].__getitem__  # the last, at -1, is that of no feature

    def sentence_scores(self, text: str) -> np.ndarray:
        """Each sentence's probability to be toxic."""
        sums = [sum(map(self._weight, {_NUMBERS[w] for w in words})) for words in sentences(text)]
        return 1 / (1 + np.exp(-np.clip(self.bias + np.array(sums, float), -40, 40)))

    def document(self, each: np.ndarray) -> float:
        """The document's score from its sentences' probabilities; without sentences it is the leak."""
        return float(1 - (1 - self.leak) * np.prod(1 - each))


def _gradient(x: np.ndarray):
    """A partition's loss and gradient at x: weights, then the bias and the leak's logit."""
    weights, bias, leak = x[:-2].astype(np.float32), x[-2], x[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, seen = 0.0, np.zeros(len(weights) + 2), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            y = batch.column(0).to_numpy().astype(float)
            bags = batch.column(1)
            per_bag = np.diff(bags.offsets.to_numpy())
            lists = bags.flatten()
            per_sentence = np.diff(lists.offsets.to_numpy())
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(per_sentence)), per_sentence)
            z = bias + np.bincount(owner, weights[flat], len(per_sentence))
            p, p0 = 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 / (1 + np.exp(-leak))
            bag = np.repeat(np.arange(len(y)), per_bag)
            # the log of the probability that nothing in the bag is toxic; log(1 - p) = -log(1 + e^z)
            log_none = -np.logaddexp(0, leak) - np.bincount(bag, np.logaddexp(0, z), len(y))
            some = np.maximum(-np.expm1(log_none), 1e-12)
            loss += -(y * np.log(some) + (1 - y) * log_none).sum()
            scale = np.where(y > 0, -np.exp(log_none) / some, 1.0)  # of d loss / d z = scale * p
            by = scale[bag] * p
            grad[:-2] += np.bincount(flat, by[owner], len(weights))
            grad[-2] += by.sum()
            grad[-1] += (scale * p0).sum()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.astype(np.float32).tobytes()], pa.binary())], ["loss", "grad"])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of this id are kept from the fit: the crc32 of the id's text, that of a null id being empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = 0.3, rounds: int = 36) -> Model:
    """The model fitted on at most `sample` labelled documents that are not held out.

    Rows of labels with a null id or toxic are left out; of several labels of an id the worst counts; rows of docs that
    repeat an id count each. Words that toxic documents hold more often than chance begin with their log odds; then come at
    most `rounds` steps, three refits that make the weights sparse, and a last one with the leak, each step a few Spark jobs over the sample's features. Without labels, or with one kind
    alone, nothing can be told apart: the weights stay 0 and the leak is the share of toxic labels, 0 without any.
    """
    small_batches(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    bags = F.pandas_udf(lambda texts: pd.Series([[features(s) for s in sentences(t or "")] for t in texts]), "array<array<int>>")
    # `sample` rows of two numbers: bounded by the parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("y").cast("int").alias("y"), bags("text").alias("bag"))
    rows = materialize(rows.repartition(PARTS), "toxic-bags")
    seen = rows.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    weights = np.zeros(FEATURES, np.float32)
    if not seen["n"] or seen["toxic"] in (0, seen["n"]):
        return Model(weights, -40.0, float((seen["toxic"] or 0) > 0))
    # the features the sample has, at most FEATURES; the others' weights stay 0, so rounds go without them
    per_word = rows.select("y", F.explode(F.array_distinct(F.flatten("bag"))).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).orderBy("f").collect()
    used, with_word, toxic_with = (np.array([r[k] for r in per_word], np.int64) for k in range(3))
    place = F.pandas_udf(lambda bags: pd.Series([[np.searchsorted(used, s).astype(np.int32) for s in b] for b in bags]), "array<array<int>>")
    rows = materialize(rows.select("y", place("bag").alias("bag")), "toxic-compact")
    each = np.full(len(used), penalty)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.mapInArrow(_gradient(x), "loss double, grad binary").collect()  # a row per partition, at most PARTS
        w = x[:-2]
        grad = sum(np.frombuffer(p.grad, np.float32).astype(float) for p in parts)
        return sum(p.loss for p in parts) + (each * w * w).sum() / 2, grad + np.concatenate([each * w, [0.0, 0.0]])

    def fixed_leak(x: np.ndarray) -> tuple[float, np.ndarray]:
        v, g = value(np.append(x, LEAK))
        return v, g[:-1]

    share = seen["toxic"] / seen["n"]
    expected = with_word * share
    odds = np.log((toxic_with + 0.5) / (seen["toxic"] + 1)) - np.log((with_word - toxic_with + 0.5) / (seen["n"] - seen["toxic"] + 1))
    start = np.where(toxic_with - expected > 2 * np.sqrt(expected + 1), odds, 0.0)
    per_bag = rows.agg(F.avg(F.greatest(F.size("bag"), F.lit(1)))).first()[0]
    of_sentences = 1 - (1 - share) ** (1 / per_bag)  # the share of toxic ones, if all were alike
    x = minimise(fixed_leak, np.append(start, np.log(of_sentences / (1 - of_sentences))), rounds)
    for _ in range(SPARSER):
        each = penalty / (np.abs(x[:-1]) + 0.1)
        x = minimise(fixed_leak, x, rounds // 3)
    x = minimise(value, np.append(x, LEAK), rounds // 3)
    weights[used] = x[:-2]
    return Model(weights, float(x[-2]), float(1 / (1 + np.exp(-x[-1]))))


def scored(docs: DataFrame, model: Model, offends: float = OFFENDS) -> DataFrame:
    """doc_id, score, n_sentences, n_offending, worst (the number of the sentence with the highest probability, from 0; ties: the first) and worst_p; one row per input row.

    Whole texts are scored, of any length. A null text counts as empty: its score is the leak, worst and worst_p are null.
    Repeated rows get equal results; other columns are not read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights: 1 MB

    @F.pandas_udf("score double, n_sentences long, n_offending long, worst long, worst_p double")
    def found(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            each = sent.value.sentence_scores(text or "")
            score = sent.value.document(each)
            k = int(each.argmax()) if len(each) else None
            out.append((score, len(each), int((each >= offends).sum()), k, None if k is None else float(each[k])))
        return pd.DataFrame(out, columns=["score", "n_sentences", "n_offending", "worst", "worst_p"]).astype({"worst": "Int64"})

    return docs.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")


def offending_sentences(docs: DataFrame, model: Model, offends: float = OFFENDS) -> DataFrame:
    """(doc_id, sentence, words, p): every sentence with a probability of at least `offends`, with its number from 0 and its words joined by spaces. Repeated rows give repeated sentences."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for row, text in enumerate(batch.column(1)):
                each = sent.value.sentence_scores(text := text.as_py() or "")
                if (each >= offends).any():
                    hits = [(k, " ".join(words), float(p)) for k, (words, p) in enumerate(zip(sentences(text), each, strict=True)) if p >= offends]
                    ids += [row] * len(hits)
                    out += hits
            new = [pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *new], ["doc_id", "sentence", "words", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence long, words string, p double")
