"""The registered queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_in_middle, jaccard_join, mixing, pii, quality_classifier, quality_rules, sharding, spelling, suffix_dedup, token_counts, toxicity, url_filters
from .common import read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file lies; it is read in place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, by the classifier fitted on the labels."""
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.graded(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements, failed rules as bits, version 1's verdict, and the rule that alone speaks against it, from a stored ledger."""
    rows = quality_rules.apply_policy(quality_rules.stored_ledger(read(spark, sf_dir, "documents")), quality_rules.V1)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "only_failure")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, base digest and all spans."""
    return pii.span_digest(read(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filters.url_verdicts(read(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and grown shard of every document."""
    return sharding.shard_rows(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of the sources."""
    return mixing.mix_order(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows hit."""
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that repeat."""
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents, some of which lose a letter on the way."""
    return spelling.variant_groups(spelling.word_counts(read(spark, sf_dir, "documents"), typo_every=31))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its worst sentence, by the model fitted on the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    rows = toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return rows.withColumns({"held_out": toxicity.held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, piece lengths and checksums of the output and of the text rebuilt from it."""
    rows = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    sums = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256)}
    return rows.withColumns(sums).drop("output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_quality_classifier, op3_quality_rules, op4_personal_data, op5_url_filters, op6_jaccard_join, op7_sharding, op8_mixing, op9_decontamination, op10_suffix_dedup, op11_spelling_variants, op12_toxicity, op13_fill_in_middle]
    return {f.__name__: f for f in found}


_OP3 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
k AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS k FROM g),
d AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM d, range(5) AS x(o) GROUP BY r),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (2 * n_symbols > n_words)::INT
             + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (2 * word_chars < 3 * n_words)::INT AS bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
       bits::BIGINT AS fail_bits,
       CASE bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'short_words' END AS only_failure
FROM b
"""

_OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS k FROM bi),
n AS (SELECT DISTINCT n FROM bw),
di AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n),
o AS (SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM di),
f AS (SELECT o.r, o.i, o.n, bw.item_id FROM o JOIN bw ON o.n = bw.n AND o.k = bw.k),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM f) GROUP BY r),
t AS (SELECT r, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM f GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(len(t.items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(t.items, ','), '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

_OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN range(4)] AS d FROM t),
c AS (SELECT *, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a+1:b], '') AS mid, array_to_string(u[b+1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _OP3, "op9_decontamination": _OP9, "op13_fill_in_middle": _OP13}
