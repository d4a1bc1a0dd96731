"""Near-duplicate documents: all links of Jaccard similarity >= 0.8 on five-word shingles, with Bayesian pruning.

Texts with equal shingle sets form one class, named by the 128-bit hash of the set, whatever their ids; only one text of each
goes on. MinHash bands bring likely pairs together. A representative's home is the least representative it meets in its bands,
so a group of near copies has one home; pairs inside a home and the few across homes are compared.
MinHash values are compared a few at a time, and a pair is dropped once the posterior probability that it
reaches the threshold falls below a tolerance. The rest is verified exactly.

A large home is split into blocks, and each task compares two blocks. Pairs never become rows: a task
returns, per member, its number of links and the least member it is connected to.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, small_batches, text_key

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of rows: a pair at the threshold shares a band with probability 0.99995.
BANDS, ROWS = 25, 5
#: MinHash values compared before each look at the posterior, and the posterior below which a pair is dropped.
CHUNK, TOLERANCE = 25, 1e-6
#: Members of a block, and the shingles they may hold together.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Words whose hashes a worker keeps.
KEPT_WORDS = 1_000_000

_N = BANDS * ROWS
_SEEDS = np.random.default_rng(20_240_229).integers(1, 1 << 63, (2, _N), dtype=np.uint64)
_A, _B = _SEEDS[0] | np.uint64(1), _SEEDS[1]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of the lower-cased words; fewer words make one shingle."""
    words = (text or "").lower().split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    g = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        g = _mixed(g + h[k : k + n] * _MIX[k])
    return np.unique(g)


def minhash(s: np.ndarray) -> np.ndarray:
    sig = np.full(_N, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        sig = np.minimum(sig, ((s[at : at + 2048, None] * _A + _B) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return sig


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, least matches to go on): with a uniform prior, m of n matches leave a Beta(m+1, n-m+1) posterior."""
    out = []
    for n in range(CHUNK, _N + 1, CHUNK):
        tail, m = 0.0, 0
        while True:  # P(J >= t | m) = P(Binomial(n+1, t) <= m)
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


_SKETCH = "doc_id long, th long, n_sh long, s1 long, s2 long, bands array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _MIX[:ROWS]
    for batch in batches:
        sizes, ones, twos, bands = [], [], [], []
        for text in batch.column(2):
            s = shingles(text.as_py())
            sizes.append(len(s))
            key = xxhash.xxh128_intdigest(s.tobytes())
            ones.append(key >> 64)
            twos.append(key & 0xFFFFFFFFFFFFFFFF)
            rows = minhash(s).astype(np.uint64).reshape(BANDS, ROWS)
            bands.append(_mixed(_mixed(rows * powers).sum(axis=1, dtype=np.uint64)) if len(s) else None)
        longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        lists = pa.array([None if b is None else b.view(np.int64) for b in bands], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), longs(ones), longs(twos), lists], ["doc_id", "th", "n_sh", "s1", "s2", "bands"])


def _pairs(sigs: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs between two blocks (upper: within one, i < j) that their sizes and MinHash values leave possible."""
    small, large = np.minimum.outer(sizes, other_sizes), np.maximum.outer(sizes, other_sizes)
    left = small >= THRESHOLD * large - 1e-9
    i, j = np.nonzero(np.triu(left, 1) if upper else left)
    m = np.zeros(len(i), np.int64)
    for n, least in least_matches():
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            m[s] += (sigs[i[s], n - CHUNK : n] == other[j[s], n - CHUNK : n]).sum(axis=1)
        go = m >= least
        i, j, m = i[go], j[go], m[go]
    return i, j


def _verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether each pair's exact similarity reaches the threshold."""
    if not len(i):
        return np.zeros(0, bool)
    used = np.unique(np.concatenate([i, j]))
    sizes = np.array([len(s) for s in sets])
    if len(i) < 2 * len(used):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:  # many pairs: a product of incidence matrices, a slice of the shared shingles at a time
        flat = np.concatenate([sets[u] for u in used])
        _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(used)), sizes[used])
        keep = count[col] > 1
        new = np.cumsum(count > 1) - 1
        row, col = row[keep], new[col[keep]]
        common = np.zeros((len(used), len(used)), np.float32)
        for at in range(0, int(new[-1]) + 1, 8192):
            part = (col >= at) & (col < at + 8192)
            dense = np.zeros((len(used), 8192), np.float32)
            dense[row[part], col[part] - at] = 1
            common += dense @ dense.T
        where = np.searchsorted(used, [i, j])
        both = common[where[0], where[1]].astype(np.int64)
    return both >= THRESHOLD * (sizes[i] + sizes[j] - both) - 1e-9


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index connected to each of n, by repeated minimum over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_LINKS = "rep long, n_links long, low long"
#: A task is a home and two of its blocks, or ACROSS and two texts of different homes.
_TASK, ACROSS = ["home", "bi", "bj"], -1


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Links among one task's members: all pairs of two blocks, or of one with itself."""
    group = group.drop_duplicates(["rep", "side"]).sort_values("rep", ignore_index=True)
    sets = [shingles(t) for t in group.text]
    sigs, sizes = np.array([minhash(s) for s in sets]), np.array([len(s) for s in sets])
    sides = group.side.to_numpy()
    if group.bi.iloc[0] == group.bj.iloc[0]:  # the other block of a task may be empty, so the sides present don't tell
        i, j = _pairs(sigs, sizes, sigs, sizes, True)
    else:
        a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        i, j = _pairs(sigs[a], sizes[a], sigs[b], sizes[b], False)
        i, j = a[i], b[j]
    ok = _verified(sets, i, j)
    i, j = i[ok], j[ok]
    links = np.bincount(i, minlength=len(sets)) + np.bincount(j, minlength=len(sets))
    rep = group.rep.to_numpy()
    out = pd.DataFrame({"rep": rep, "n_links": links, "low": rep[_roots(len(rep), i, j)]})
    return out[out.n_links > 0]


def _each_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_compare for each run of equal keys of a sorted partition; the last run of a batch waits for the next batch."""
    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = (pdf[_TASK] != pdf[_TASK].shift()).any(axis=1).to_numpy()
        new[0] = bool(held) and not (held[-1][_TASK].iloc[-1] == pdf[_TASK].iloc[0]).all()
        cuts = np.flatnonzero(new)
        done = []
        for start, end in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            if start in cuts and held:
                done.append(_compare(pd.concat(held)))
                held = []
            if end > start:
                held.append(pdf.iloc[start:end])
        if done:
            yield pd.concat(done)
    if held:
        yield _compare(pd.concat(held))


def _homes(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(homes, buckets): (rep, home) for reps that share a band with another; buckets (rep, band, value)."""
    banded = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    least = banded.groupBy("band", "value").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "value", "low")
    buckets = materialize(banded.join(least, ["band", "value"]), "buckets")
    homes = buckets.groupBy("rep").agg(F.min("low").alias("home"))
    # once more through the homes: a member that missed the group's least meets it through the others
    with_home = buckets.join(homes, "rep")
    second = with_home.groupBy("band", "value").agg(F.min("home").alias("h2"))
    return materialize(with_home.join(second, ["band", "value"]).groupBy("rep").agg(F.min("h2").alias("home")), "homes"), buckets


def _across(homes: DataFrame, buckets: DataFrame) -> DataFrame:
    """(a, b): pairs that share a bucket but not a home."""
    placed = buckets.select("rep", "band", "value").join(homes, "rep")
    mixed = placed.groupBy("band", "value").agg(F.min("home").alias("x"), F.max("home").alias("y")).where("x < y").select("band", "value")
    placed = materialize(placed.join(mixed, ["band", "value"]), "mixed-buckets")
    a = placed.select("band", "value", F.col("rep").alias("a"), F.col("home").alias("ha"))
    b = placed.select("band", "value", F.col("rep").alias("b"), F.col("home").alias("hb"))
    return a.join(b, ["band", "value"]).where("a < b and ha <> hb").select("a", "b").distinct()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(rep, class_id) from edges (rep, low): the least node of each connected component, by min-label rounds with pointer jumping."""
    back = links.select(F.col("rep").alias("a"), F.col("low").alias("b"))
    edges = materialize(back.union(back.select("b", "a")).where("a <> b").distinct(), "edges")
    label = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        seen = edges.join(label, edges["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(seen, label["node"] == seen["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("m"))
        up = label.select(F.col("node").alias("m"), F.col("label").alias("top"))
        new = materialize(step.join(up, "m", "left").select("node", "was", F.least("m", F.coalesce("top", "m")).alias("label")), "labels")
        label = new.select("node", "label")
        if new.where("label < was").isEmpty():
            return label.select(F.col("node").alias("rep"), F.col("label").alias("class_id"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _with_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, th, class_hash, n_links, text_class, class_id) per row; class_hash is null without words."""
    small_batches(docs.sparkSession)
    key = F.coalesce("doc_id", F.lit(0).cast("long")).alias("key")
    slim = docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("th"), "text")
    sketches = materialize(slim.mapInArrow(_sketches, _SKETCH).select("doc_id", key, "th", "n_sh", "s1", "s2", "bands"), "sketches")
    # one row stands for each set, under a number: its text is compared, its bands and size are those of all
    reps = sketches.where("n_sh > 0").groupBy("s1", "s2").agg(
        F.min(F.struct("key", "th")).alias("row"), F.count("*").alias("rows"), F.min("doc_id").alias("text_class"), F.max("n_sh").alias("n_sh"), F.any_value("bands").alias("bands")
    )
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rep"), "*"), "shingle-sets")
    homes, buckets = _homes(reps.select("rep", "bands"))
    layout = homes.join(reps.select("rep", "n_sh"), "rep")
    blocks = layout.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_sh") / BLOCK_SHINGLES)).alias("nb"))
    layout = layout.join(blocks, "home").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")))
    # block k meets itself and every other block; the lower of the two is side 0
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o")
    inside = layout.select("rep", "home", "blk", others).select("rep", "home", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), F.when(F.col("blk") > F.col("o"), 1).otherwise(0).alias("side"))
    across = materialize(_across(homes, buckets), "across")
    sides = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.lit(0).alias("side")), F.struct(F.col("b").alias("rep"), F.lit(1).alias("side")))).alias("m")
    pair = across.select("a", "b", sides).select("m.rep", F.lit(ACROSS).cast("long").alias("home"), F.col("a").alias("bi"), F.col("b").alias("bj"), "m.side")
    tasks = inside.unionByName(pair).groupBy("rep").agg(F.collect_list(F.struct(*_TASK, "side")).alias("tasks"))
    tasks = materialize(tasks.join(reps.select("rep", "row"), "rep").select("rep", "row.key", "row.th", "tasks"), "tasks")
    texts = slim.select(key, "th", "text").join(checked_broadcast(tasks), ["key", "th"])
    cells = texts.select("rep", "text", F.explode("tasks").alias("t")).select("rep", "text", *[f"t.{c}" for c in (*_TASK, "side")])
    cells = cells.repartition(*_TASK).sortWithinPartitions(*_TASK)
    found = materialize(cells.mapInPandas(_each_group, _LINKS), "links")
    known = found.groupBy("rep").agg(F.sum("n_links").alias("n_links")).join(connected(found.select("rep", "low")).withColumnRenamed("class_id", "label"), "rep")
    # sets of one row and no link are their own class and need no join
    sets = reps.select("rep", "s1", "s2", "rows", "text_class").join(known, "rep", "left").where("rows > 1 or label is not null").withColumn("label", F.coalesce("label", "rep"))
    sets = materialize(sets, "classes")
    least = sets.groupBy("label").agg(F.min("text_class").alias("class_id"), F.min(F.struct("s1", "s2")).alias("least"))
    sets = sets.join(least, "label").select("s1", "s2", "n_links", "text_class", "class_id", "least")
    out = sketches.select("doc_id", "key", "th", "n_sh", "s1", "s2").join(sets, ["s1", "s2"], "left")
    own, name = F.col("least").isNull(), lambda c: F.lpad(F.hex(c), 16, "0")
    return out.select(
        "doc_id", "key", "th", F.when(F.col("n_sh") > 0, F.concat(name(F.coalesce("least.s1", "s1")), name(F.coalesce("least.s2", "s2")))).alias("class_hash"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(own, F.col("doc_id")).otherwise(F.col("text_class")).alias("text_class"),
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_class, class_id, n_links, class_hash; one row per input row.

    text_class: the least doc_id of the rows with the same shingle set. class_id: the least doc_id of the rows
    connected through links of similarity >= 0.8. n_links: how many other text classes this one is linked to.
    class_hash names the class even where several share a least id, as when an id repeats with different texts, or have none.
    Rows count by text, not by id: repeated rows share a class, an id's different texts are each in their own, and a row without
    an id is in its text's class. Texts without words (null, empty, blank) have no shingles and stand alone,
    with class_id doc_id and no class_hash. An empty table gives an empty result.
    """
    return _with_classes(docs).select("doc_id", "text_class", "class_id", "n_links", "class_hash")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with its own columns and one row of each class of near duplicates: the least doc_id's (an id before none, ties by text hash).

    Rows without words all stay. Of rows that repeat the surviving id and text, the one whose columns have the least hash stays.
    """
    groups = materialize(_with_classes(docs).where("class_hash is not null").select("doc_id", "key", "th", "class_hash"), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "key", "th"))
    best = groups.groupBy("class_hash").agg(first.alias("best"), F.count("*").alias("n")).where("n > 1").select("class_hash", "best")
    judged = groups.join(best, "class_hash").select("doc_id", "th", ((F.col("key") == F.col("best.key")) & (F.col("th") == F.col("best.th"))).alias("stays"))
    judged = materialize(judged.groupBy("doc_id", "th", "stays").agg(F.count("*").alias("n")).where("not stays or n > 1"), "copies")
    here = lambda side: docs["doc_id"].eqNullSafe(side["doc_id"]) & (text_key(docs["doc_id"], docs["text"]) == side["th"])
    left = checked_broadcast(judged)
    kept = docs.join(left, here(left), "left_anti")
    twice = judged.where("stays")
    if twice.isEmpty():
        return kept
    again = checked_broadcast(twice.select("doc_id", "th"))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    one = docs.join(again, here(again)).groupBy(again["th"]).agg(F.min_by(row, F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])).alias("row"))
    return kept.unionByName(one.select("row.*"))
