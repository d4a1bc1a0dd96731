"""Exact removal of repeated byte strings by prefix doubling over sampled suffix positions.

Ranking every byte position would shuffle several times the corpus, so the first sort takes a sample that
misses nothing: of all suffixes starting inside a 200-byte window, the one whose first K bytes have
the least hash. Equal windows choose equal suffixes, so each window is owned by one sampled suffix at a
fixed offset. Spark then ranks at growing lengths and keeps only what is still shared:

1. sampled suffixes by their first K bytes; a suffix alone with its rank owns no repeated window;
2. survivors by everything their windows cover, up to 336 bytes; equal ones are repeated whole;
3. what is left splits into cells of 16 windows at fixed offsets, ranked by the 185 bytes all windows of
   a cell hold; a cell alone with its rank holds no repeated window, equal cells are repeated whole;
4. the rest splits into single windows, ranked by all 200 bytes.

Ranks are named by hashes: 64 bits in the first round, which only filters, 128 bits after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, small_batches, with_keys

#: Bytes of the strings that count, and of the prefix that picks and first ranks a suffix.
LENGTH, PREFIX = 200, 64
#: Windows of one cell of the third round.
CELL = 16
#: Bytes of a text handled at once; longer texts go in overlapping pieces.
PIECE = 1 << 20
_POS = np.uint64((1 << 28) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """Polynomial hashes modulo 2^64 of any substring of one piece, from prefix sums; bytes are first spread over 64 bits."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        if base not in self._powers:
            inverse, n = pow(base, -1, 1 << 64), PIECE + 2 * LENGTH
            with np.errstate(over="ignore"):
                self._powers[base] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (base, inverse))
        up, self.down = self._powers[base]
        spread = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(spread[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _pieces(n: int, step: int) -> Iterator[tuple[int, int]]:
    """Byte ranges so that each window of LENGTH bytes lies whole in exactly one as a start below step."""
    for at in range(0, max(0, n - LENGTH + 1), step):
        yield at, min(n, at + step + LENGTH - 1)


def owners(data: np.ndarray, step: int = PIECE) -> dict[str, np.ndarray]:
    """The sampled suffixes of one text: lo, hi (first and last window they own), at (its own start), fp (rank of the prefix), s1, s2 (of all they cover)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("lo", "hi", "at", "fp", "s1", "s2")}
    reach = LENGTH - PREFIX + 1
    for at, end in _pieces(len(data), step):
        piece = data[at:end]
        one, two = (_Hasher(piece, b) for b in _BASES)
        grams = np.arange(len(piece) - PREFIX + 1)
        prefix = _mixed(one.of(grams, grams + PREFIX))
        least = (prefix & ~_POS) | grams.astype(np.uint64)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := reach - width:
            least = np.minimum(least[:-rest], least[rest:])
        owner = (least & _POS).astype(np.int64)
        cut = np.flatnonzero(np.diff(owner)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(owner) - 1]])
        shape = (owner[lo] - lo) * 1024 + (hi - lo)
        out["lo"].append(lo + at)
        out["hi"].append(hi + at)
        out["at"].append(owner[lo] + at)
        out["fp"].append(prefix[owner[lo]])
        for k, h in (("s1", one), ("s2", two)):
            out[k].append(_mixed(h.of(lo, hi + LENGTH) + shape.astype(np.uint64)))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


_OWNED = "doc_id long, th long, lo int, hi int, at int, fp long, s1 long, s2 long"


def _owner_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ths, texts = (batch.column(k) for k in range(3))
        parts = [owners(_bytes(t.as_py())) for t in texts]
        row = np.repeat(np.arange(len(parts)), [len(p["lo"]) for p in parts])
        joined = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in ("lo", "hi", "at", "fp", "s1", "s2")}
        cols = [ids.take(pa.array(row)), ths.take(pa.array(row)), *(pa.array(joined[k].astype(np.int32)) for k in ("lo", "hi", "at")), *(pa.array(joined[k].astype(np.uint64).view(np.int64)) for k in ("fp", "s1", "s2"))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "lo", "hi", "at", "fp", "s1", "s2"])


_CELLS = "doc_id long, th long, solo boolean, lo int, hi int, core long, s1 long, s2 long"
_WINDOWS = "doc_id long, th long, solo boolean, p int, w1 long, w2 long"


def _framed(out: list[dict], schema: str) -> pd.DataFrame:
    """One frame from per-document columns; doc_id and th are single values."""
    kinds = {n: {"long": "int64", "int": "int32", "boolean": "bool"}[k] for n, k in (x.split() for x in schema.split(", "))}
    sizes = [len(x["solo"]) for x in out]
    return pd.DataFrame({n: np.concatenate([np.broadcast_to(x[n], k) for x, k in zip(out, sizes, strict=True)]) if out else [] for n in kinds}).astype(kinds)


def _cell_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, th, text, spans in zip(pdf.doc_id, pdf.th, pdf.text, pdf.spans, strict=True):
            data = _bytes(text)
            lo, hi, own, solo = (np.array([s[k] for s in spans]) for k in ("lo", "hi", "at", "solo"))
            first, last = (lo - own) // CELL, (hi - own) // CELL
            n = last - first + 1
            k = np.repeat(np.arange(len(n)), n)
            edge = own[k] + CELL * (first[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n))
            a, z = np.maximum(lo[k], edge), np.minimum(hi[k], edge + CELL - 1)
            for at, end in _pieces(len(data), PIECE):
                if (here := (a >= at) & (a < at + PIECE)).any():
                    one, two = (_Hasher(data[at : min(len(data), end + CELL)], b) for b in _BASES)
                    x, y, e = a[here] - at, z[here] - at, edge[here] - at
                    shape = ((x - e) * CELL + (y - x)).astype(np.uint64)
                    core = _mixed(one.of(e + CELL - 1, e + LENGTH) + (edge - own[k])[here].astype(np.uint64))
                    out.append({"doc_id": doc, "th": th, "solo": solo[k][here], "lo": a[here], "hi": z[here], "core": core.view(np.int64), **{c: _mixed(h.of(x, y + LENGTH) + shape).view(np.int64) for c, h in (("s1", one), ("s2", two))}})
        yield _framed(out, _CELLS)


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, th, text, spans in zip(pdf.doc_id, pdf.th, pdf.text, pdf.spans, strict=True):
            data = _bytes(text)
            p = np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans])
            solo = np.repeat([s["solo"] for s in spans], [s["hi"] - s["lo"] + 1 for s in spans])
            for at, end in _pieces(len(data), PIECE):
                if (here := (p >= at) & (p < at + PIECE)).any():
                    one, two = (_Hasher(data[at:end], b).of(p[here] - at, p[here] - at + LENGTH).view(np.int64) for b in _BASES)
                    out.append({"doc_id": doc, "th": th, "solo": solo[here], "p": p[here], "w1": one, "w2": two})
        yield _framed(out, _WINDOWS)


def _classes(rows: DataFrame, rank: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """(classes, open): rows grouped by rank and s1, s2 with count c and one row r of each; and the ranks held by
    several classes (their number is n), of which one has a single row that is still undecided."""
    r = F.min(F.struct("doc_id", "th", "lo", "hi", *more)).alias("r")
    classes = materialize(rows.groupBy(rank, "s1", "s2").agg(F.count("*").alias("c"), F.bool_or("solo").alias("solo"), r), "suffix-classes")
    undecided = F.bool_or((F.col("c") == 1) & F.col("solo"))
    return classes, classes.groupBy(rank).agg(F.count("*").alias("n"), undecided.alias("u")).where("n > 1 and u").select(rank, "n")


def _with_spans(rows: DataFrame, classes: DataFrame, undecided: DataFrame, rank: str, *more: str) -> DataFrame:
    """The texts that hold one row of each class of an undecided rank, with those rows as spans."""
    span = F.struct("r.lo", "r.hi", *[f"r.{m}" for m in more], ((F.col("c") == 1) & F.col("solo")).alias("solo"))
    todo = with_keys(classes, undecided, [rank]).groupBy("r.doc_id", "r.th").agg(F.collect_list(span).alias("spans"))
    todo = checked_broadcast(materialize(todo, "suffix-open"))
    texts = rows.alias("d").join(todo.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.th") == F.col("t.th")))
    return texts.select("d.doc_id", "d.th", "d.text", "t.spans")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, th, lo, hi) over rows (doc_id, th, text): runs of starts whose windows also start anywhere else."""
    owned = materialize(rows.mapInArrow(_owner_rows, _OWNED), "suffixes")
    shared = owned.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1")
    left = materialize(with_keys(owned, shared, ["fp"], "c").withColumn("solo", F.lit(True)), "suffixes-shared")
    classes, undecided = _classes(left, "fp", "at")
    whole = with_keys(left, classes.where("c > 1"), ["fp", "s1", "s2"], "c").select("doc_id", "th", "lo", "hi")
    # of rows equal in id and text, which share their classes, one text speaks for all
    texts = _with_spans(rows, classes, undecided, "fp", "at")
    cells = materialize(texts.mapInPandas(_cell_rows, _CELLS), "cells")
    classes, undecided = _classes(cells, "core")
    equal = with_keys(cells.where("solo"), classes.where("c > 1"), ["core", "s1", "s2"], "c").select("doc_id", "th", "lo", "hi")
    texts = _with_spans(rows, classes, undecided, "core")
    single = materialize(texts.mapInPandas(_window_rows, _WINDOWS), "windows")
    twice = single.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1")
    parts = with_keys(single.where("solo"), twice, ["w1", "w2"], "c").select("doc_id", "th", F.col("p").alias("lo"), F.col("p").alias("hi"))
    return whole.unionByName(equal).unionByName(parts)


def _cut(text, found) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes of the whole, removed runs)."""
    data = (text or "").encode()
    found = [] if found is None else [(int(s["lo"]), int(s["hi"])) for s in found]
    return b"".join(data[a:b] for a, b in zip([0, *(h for _, h in found)], [*(lo for lo, _ in found), len(data)], strict=True)), len(data), len(found)


def _digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        cuts = [_cut(*x) for x in zip(texts, spans, strict=True)]
        yield pd.DataFrame([(n, n - len(kept), runs, hashlib.sha256(kept).hexdigest()) for kept, n, runs in cuts], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _remaining(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, spans in batches:
        yield pd.Series([_cut(*x)[0].decode(errors="ignore") for x in zip(texts, spans, strict=True)], dtype=object)


def _merged(windows: DataFrame) -> DataFrame:
    """(doc_id, th, spans): per document the sorted, disjoint byte ranges that its repeated windows cover."""
    by = windows.distinct().groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("lo", F.expr(f"hi + {LENGTH} AS hi")))).alias("s"))
    ends = F.transform("s", lambda x, k: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), k.alias("k")))
    # inputs are sorted by lo, and by hi as well because windows have one length
    opens = F.filter(ends, lambda x: (x["k"] == 0) | (F.get(F.col("s"), x["k"] - 1)["hi"] < x["lo"]))
    closes = F.filter(ends, lambda x: (x["k"] == F.size("s") - 1) | (F.get(F.col("s"), x["k"] + 1)["lo"] > x["hi"]))
    return by.select("doc_id", "th", F.zip_with(opens, closes, lambda o, c: F.struct(o["lo"].alias("lo"), c["hi"].alias("hi"))).alias("spans"))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining text); one row per input row.

    A byte goes if a 200-byte string over it also starts anywhere else, in the same text or another;
    strings are judged on the input. Null counts as empty; texts under 200 bytes stay whole; of
    repeated rows everything that is long enough goes; rows without an id count as one id. kept drops
    the bytes of a character cut in two.
    """
    small_batches(docs.sparkSession)
    # an id that no table uses stands for null, which pandas would turn into floats
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", key.alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    spans = _merged(repeated_windows(rows.where(F.octet_length("text") >= LENGTH).select(F.col("k").alias("doc_id"), "th", "text")))
    spans = checked_broadcast(materialize(spans.withColumnsRenamed({"doc_id": "k"}), "repeats"))
    both = rows.join(spans, ["k", "th"], "left")
    digest = F.pandas_udf(_digests, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    kept = [F.pandas_udf(_remaining, "string")("text", "spans").alias("kept")] if with_text else []
    return both.select("doc_id", digest("text", "spans").alias("d"), *kept).select("doc_id", "d.n_bytes", "d.n_removed", "d.n_spans", "d.kept_sha256", *(["kept"] if with_text else []))
