"""Token counts per document by a map-side two-tier lookup.

A text is cut at single spaces into chunks that the tokenizer's own pre-tokenizer never joins.
Tier one is a broadcast hash table of chunk lengths taken from the vocabulary, which lists frequent
pre-tokens by construction and bounds the table. Tier two is a bounded cache in each Python worker,
filled by encoding the chunks the first tier misses. Nothing is shuffled.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Chunks one worker caches beyond the broadcast table.
CACHE_CHUNKS = 600_000
#: Longer chunks are encoded each time; they hardly ever come again.
CACHED_CHARS = 40
#: A word of Latin letters, then ASCII marks: two pre-tokens, the second perhaps empty.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:]*)\Z")
#: A space beside other white space (or at the end), which can join two chunks.
JOINED = re.compile(r" \s|\s | \Z")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def frequent_lengths(path: str, table_size: int = 50_000) -> dict[str, int]:
    """Chunk (after a space) -> tokens, for the vocabulary's first table_size entries that are whole chunks.

    The size is bounded by the vocabulary, whatever the corpus.
    """
    tok = _tokenizer(path)
    if tok.normalizer is not None or not re.search(r"ByteLevel\(add_prefix_space=False.*use_regex=True", str(tok.pre_tokenizer)):
        raise ValueError("only byte-level tokenizers that split by their own pattern, without normalising or a prefix space, are counted by chunks")
    texts = (tok.decode([i], skip_special_tokens=False) for i in range(min(table_size, tok.get_vocab_size())))
    chunks = sorted({t[1:] for t in texts if len(t) > 1 and t[0] == " " and not any(c.isspace() for c in t[1:]) and "�" not in t})
    found = tok.encode_batch([" " + c for c in chunks], add_special_tokens=False)
    return {c: len(e.ids) for c, e in zip(chunks, found, strict=True)}


class _Lengths(dict):
    """Tokens of a chunk that follows a space; misses are encoded and kept while there is room."""

    def __init__(self, tok, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tok, self.model, self.frequent, self.most, self.marks = tok, tok.model, frequent, len(frequent) + CACHE_CHUNKS, {}
        # the byte-level alphabet shows the bytes that don't print, in order, from U+0100 on
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.shown = {b: 256 + k for k, b in enumerate(hidden)}

    def _encoded(self, chunk: str) -> int:
        if not (plain := PLAIN.match(chunk)):
            return len(self.tok.encode(" " + chunk, add_special_tokens=False).ids)
        word, marks = plain.groups()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.shown)
        n = len(self.model.tokenize("\u0120" + word))
        if marks:
            if marks not in self.marks:
                self.marks[marks] = len(self.model.tokenize(marks))
            n += self.marks[marks]
        return n

    def __missing__(self, chunk: str) -> int:
        n = self._encoded(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[chunk] = n
        return n


def count_tokens(text: str, lengths: _Lengths) -> int:
    """Tokens of the text: a space between two non-spaces always starts a pre-token, so chunks add up."""
    first, *rest = text.split(" ")
    encode = lengths.tok.encode
    if not JOINED.search(text):
        return (len(encode(first, add_special_tokens=False).ids) if first else 0) + sum(map(lengths.__getitem__, rest))
    total, run = 0, first
    for chunk in rest:
        if run and not run[-1].isspace() and chunk and not chunk[0].isspace():
            total += len(encode(run, add_special_tokens=False).ids)
            run = " " + chunk
        else:
            run += " " + chunk
    return total + len(encode(run, add_special_tokens=False).ids)


_WORKER: dict[str, _Lengths] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512, table_size: int = 50_000) -> DataFrame:
    """docs' doc_id with n_bytes, n_tokens and over_limit (n_tokens > limit), one row per input row.

    A null or empty text has 0 bytes and 0 tokens. Whole texts are counted, of any length; special
    strings inside a text count as the library encodes them. Repeated rows stay, other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    frequent = spark.sparkContext.broadcast(frequent_lengths(tokenizer_path, table_size))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if tokenizer_path not in _WORKER:
            _WORKER[tokenizer_path] = _Lengths(_tokenizer(tokenizer_path), frequent.value)
        lengths = _WORKER[tokenizer_path]
        for texts in batches:
            yield pd.Series([count_tokens(t, lengths) if t else 0 for t in texts], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), n_tokens(whole).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
