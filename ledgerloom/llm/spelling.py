"""Spelling variants: every word's neighbours at edit distance one, found by a Levenshtein automaton walked over tries.

The counted words are sorted into ranges, and each range becomes a compact trie shard: nodes in level order, a byte a
label and four for the first child. Shards are broadcast in rounds of at most ROUND_BYTES, whatever the size of the
dictionary; in a round each word's distance-one automaton is intersected depth-first with every shard of it.

Of a word and its neighbour, either the first half or the second is the same. So there are tries of the words and of the
words reversed, and in both the automaton takes half the word without an error before it branches. A shard holds a range
of sorted words, so an automaton that doesn't begin like them dies within a few nodes.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Letters of the words of one shard at most (one longer word is a shard of its own), and bytes of the shards of one broadcast.
SHARD_LETTERS, ROUND_BYTES = 1 << 20, 32 << 20
#: Words of one task of a round.
TASK_WORDS = 8_000
#: Different words that a counting task holds before it hands them on, and bytes of a text split at once.
HELD_WORDS, PIECE = 200_000, 1 << 20

#: A-Z to a-z, a-z and U+00C0 to U+00FF as they are, all else to a space, over Latin-1 bytes.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters of the text in Latin-1, piece by piece; a run never falls into two pieces."""
    data = text.encode("latin-1", "replace").translate(_RUNS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(letters: int, typo_every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                salt = zlib.crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
                for runs in _runs(text.as_py() or ""):
                    for run, n in Counter(r for r in runs if len(r) >= letters).items():
                        if typo_every:
                            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), salt)
                            if not h % typo_every:
                                k = h % len(run)
                                run = run[:k] + run[k + 1 :]
                                if len(run) < letters:
                                    continue
                        held[run] += n
                    if len(held) >= HELD_WORDS:
                        yield out()
        if held:
            yield out()

    return run


def word_counts(docs: DataFrame, letters: int = 7, least: int = 2, typo_every: int | None = None) -> DataFrame:
    """(word, n): the lower-cased runs of letters (A-Z and U+00C0 to U+00FF) of at least `letters` code points that occur `least` times or more.

    Only A-Z are lower-cased. With typo_every, each run whose crc32 with its document's id is divisible by that number loses
    one letter, the one that the crc32 names: a planted test of the grouping. Null texts have no words, a null id counts
    as an empty one, repeated rows count each, and whole texts are read, of any length. Tasks count before the shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(_counted(letters, typo_every), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """A trie in level order: labels[i] is node i's letter, its children are first[i] to first[i + 1], node 0 is the root; the words end at `ends`, with counts n."""

    def __init__(self, labels: bytes, first: bytes, ends: bytes, n: bytes):
        self.labels, self.first, self.ends, self.n = labels, array("I", first), array("I", ends), array("q", n)

    @staticmethod
    def packed(words: list[bytes], counts: list[int]) -> dict[str, bytes]:
        """The four parts for sorted, distinct, non-empty words. Level d is made of the runs of words that share d + 1 letters."""
        flat, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        here, node = np.arange(len(words)), np.zeros(len(words), np.int64)  # the words that reach this level, and their nodes above
        labels, children, ends, n, nodes = [np.zeros(1, np.uint8)], [], [], [], 1
        above, depth = 1, 0  # nodes of the level above, all of which come just before `nodes`
        while len(here):
            letter = flat[starts[here] + depth]
            new = np.ones(len(here), bool)
            new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
            labels.append(letter[new])
            children.append(np.bincount(node[new] - (nodes - above), minlength=above))
            node = nodes + np.cumsum(new) - 1
            above = int(new.sum())
            nodes, depth = nodes + above, depth + 1
            done = sizes[here] == depth
            ends.append(node[done])
            n.append(np.array(counts, np.int64)[here[done]])
            here, node = here[~done], node[~done]
        first = 1 + np.concatenate([[0], np.cumsum(np.concatenate([*children, np.zeros(above, np.int64)]))])
        joined = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes()
        return {"labels": joined(labels, np.uint8), "first": first.astype(np.uint32).tobytes(), "ends": joined(ends, np.uint32), "n": joined(n, np.int64)}


def near_words(trie: Trie, word: bytes, free: int = 0) -> list[tuple[bytes, int]]:
    """The trie's words at edit distance exactly one from word that begin with its first `free` letters, with their counts.

    A state of the automaton is the position reached without an error (or none) and the set of positions reached with
    one. Without an error, any child may follow; after it, only children that go on with the word.
    """
    labels, first, ends, n = trie.labels, trie.first, trie.ends, trie.n
    m, found, node = len(word), [], 0
    for c in word[:free]:
        node = labels.find(c, first[node], first[node + 1])
        if node < 0:
            return found
    stack = [(node, free, (free + 1,) if free < m else (), word[:free])]  # node, position without error, positions with one, path
    while stack:
        node, exact, wrong, path = stack.pop()
        if m in wrong:
            k = bisect_left(ends, node)
            if k < len(ends) and ends[k] == node:
                found.append((path, n[k]))
        lo, hi = first[node], first[node + 1]
        if exact is None:
            for c in {word[j] for j in wrong if j < m}:
                child = labels.find(c, lo, hi)
                if child >= 0:
                    stack.append((child, None, tuple(j + 1 for j in wrong if j < m and word[j] == c), path + bytes((c,))))
            continue
        right = word[exact] if exact < m else -1
        for child in range(lo, hi):
            c = labels[child]
            after = {j + 1 for j in wrong if j < m and word[j] == c}
            after.add(exact)  # c is inserted
            if c == right:
                if exact + 1 < m:
                    after.add(exact + 2)  # the word's next letter is deleted
                stack.append((child, exact + 1, tuple(after), path + bytes((c,))))
            else:
                if exact < m:
                    after.add(exact + 1)  # c replaces the word's letter
                stack.append((child, None, tuple(after), path + bytes((c,))))
    return found


_SHARD = "labels binary, first binary, ends binary, n binary"
_PARTS = ["labels", "first", "ends", "n"]
_NEAR = "word string, n long, n_near long, best string, best_n long"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of the sorted words of a partition, of SHARD_LETTERS letters each."""
    words, counts, letters = [], [], 0
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if words and letters + len(word) > SHARD_LETTERS:
                yield pa.RecordBatch.from_pylist([Trie.packed(words, counts)])
                words, counts, letters = [], [], 0
            words.append(word.encode("latin-1"))
            counts.append(n)
            letters += len(word)
    if words:
        yield pa.RecordBatch.from_pylist([Trie.packed(words, counts)])


def _found(tries: list[tuple[bool, Trie]], word: bytes) -> list[tuple[bytes, int]]:
    """The word's neighbours: those that begin like it from the tries of words, the others from the tries of words reversed."""
    half = len(word) // 2
    head, turned, out = word[:half], word[::-1], []
    for backward, trie in tries:
        if backward:
            out += [(v[::-1], n) for v, n in near_words(trie, turned, len(word) - half) if not v[::-1].startswith(head)]
        else:
            out += near_words(trie, word, half)
    return out


def _intersected(sent):
    """Each word's neighbours in the shards of one broadcast: how many, and the best (largest n, then least in code-point order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [(backward, Trie(**parts)) for backward, parts in sent.value]
        for batch in batches:
            n_near, best = [], []
            for word in batch.column(0).to_pylist():
                found = _found(tries, word.encode("latin-1"))
                n_near.append(len(found))
                best.append(min(found, key=lambda x: (-x[1], x[0]), default=(None, None)))
            names = pa.array([w if w is None else w.decode("latin-1") for w, _ in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_near, pa.int64()), names, pa.array([k for _, k in best], pa.int64())], ["word", "n", "n_near", "best", "best_n"])

    return run


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) of words (word, n; distinct): the number of words at distance one and the best of them."""
    spark = words.sparkSession
    words = materialize(words.select("word", "n"), "words")
    sizes = words.agg(F.sum(F.char_length("word")).alias("letters"), F.count("*").alias("rows")).first()
    parts = -(-(sizes["letters"] or 0) // SHARD_LETTERS) or 1
    built = lambda rows: rows.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(_shards, _SHARD)
    both = built(words).withColumn("backward", F.lit(False)).union(built(words.withColumn("word", F.reverse("word"))).withColumn("backward", F.lit(True)))
    shards = materialize(both.withColumn("shard", F.monotonically_increasing_id()), "tries")
    size = sum((F.octet_length(c) for c in _PARTS), F.lit(0))
    rounds, held = [[]], 0
    for shard, size in shards.select("shard", size.cast("long")).orderBy("shard").collect():  # two numbers for each SHARD_LETTERS letters of the dictionary
        if rounds[-1] and held + size > ROUND_BYTES:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += size
    found = spark.createDataFrame([], _NEAR)
    asked = words.repartition(-(-sizes["rows"] // TASK_WORDS) or 1)
    for ids in filter(None, rounds):
        chosen = shards.where(F.col("shard").between(ids[0], ids[-1])).toLocalIterator()
        sent = spark.sparkContext.broadcast([(r.backward, {k: bytes(r[k]) for k in _PARTS}) for r in chosen])  # at most ROUND_BYTES and one shard
        found = found.unionByName(materialize(asked.mapInArrow(_intersected(sent), _NEAR), "near"))
        sent.unpersist()
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))).alias("b")
    by = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return by.select("word", "n", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def variant_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root for words (word, n; distinct, no nulls): a word's form is its best near word, if that is `ratio` times as frequent.

    root is the end of the chain of forms, the word itself where there is none. n grows `ratio` times along each link, so a
    chain has at most log(max n) links and doubling them ends after a few rounds. An empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("ratio under 2 would let forms go round in circles")
    near = neighbours(words)
    fits = F.col("best_n") >= ratio * F.col("n")
    rows = materialize(near.select("word", "n", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    ends = materialize(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        ends = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
