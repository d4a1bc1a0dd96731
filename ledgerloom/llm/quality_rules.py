"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger row keeps the measurements and one failure bit
per rule. A policy is a mask: applying a version, comparing versions or removing one rule at a time is
bitwise work on the ledger, never a second look at the text. Built-in expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACES = r"[\x20\x09-\x0D]+"
#: Rule names by bit, lowest first. New rules are appended, so old ledgers stay readable.
RULES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words")


@dataclass(frozen=True)
class Policy:
    """A named set of rules a document must not fail."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", RULES)


def _measured(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    words = docs.select("doc_id", whole.alias("_t"), F.array_remove(F.split(whole, SPACES), "").alias("_w"))
    w = F.col("_w")
    hashes = words.select(
        "doc_id", "_t", F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(w[i + k] for k in range(5))))).alias("_h"),
    )
    h = F.col("_h")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ordered = hashes.select(
        "doc_id", "n_words", "word_chars",
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"), lines.alias("_l"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"),
    )
    s, ln = F.col("_s"), F.col("_l")
    twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    starts = ordered.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.size(ln).cast("long").alias("n_lines"), (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))).alias("_p"),
    )
    p = F.col("_p")
    covered = F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0).cast("long"), lambda n, k: n + F.coalesce(F.least(F.lit(5), F.get(p, k) - F.get(p, k - 1)), F.lit(5)))
    measured = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    # inline keeps a later filter on the ledger from being pushed down, where each use would measure the text again
    return starts.select("doc_id", F.inline(F.array(F.struct(*measured, F.when(F.size(p) > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words")))))


def _failures() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    return {
        "few_words": n < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * n,
        "symbols": 2 * c("n_symbols") > n,
        "repeated_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "short_words": 2 * c("word_chars") < 3 * n,
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measurements, and fail_bits (bit k: RULES[k] fails).

    Words are runs without ASCII white space; windows are five words, compared by 64-bit hash within
    one text. A null text has no words and no lines; an empty or blank one likewise. Repeated rows stay.
    Everything happens inside the row, so nothing is shuffled, whatever the text's length.
    """
    fails = _failures()
    bits = sum((F.when(fails[r], F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)), F.lit(0))
    return _measured(docs, text).withColumn("fail_bits", bits.cast("long"))


def stored_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """ledger written as a table and read back: texts are measured once, whatever policies and ablations follow."""
    return materialize(ledger(docs, text), "quality-ledger")


def apply_policy(rows: DataFrame, policy: Policy, base: Policy = BASE) -> DataFrame:
    """The ledger with base_failed, kept, the policy's version, and only_failure: the one rule without which the row would be kept,
    null where it is kept anyway or several rules fail."""
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    mask, only = base.mask | policy.mask, F.lit(None).cast("string")
    for k, rule in enumerate(RULES):
        only = F.when(F.col("fail_bits").bitwiseAND(F.lit(mask)) == 1 << k, rule).otherwise(only)
    return rows.withColumns({"base_failed": failed(base.mask), "kept": ~failed(mask), "policy": F.lit(policy.version), "only_failure": only})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: failed, failed_only (what dropping that rule alone would keep) and n_docs, in one aggregation."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    both = [F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules]
    counts = rows.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    return (
        counts.select("bits", "n", F.explode(F.array(*both)).alias("r")).groupBy("r.rule")
        .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_only"), F.sum("n").alias("n_docs"))
    )
