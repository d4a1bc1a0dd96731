"""Fill-in-middle: a text becomes prefix, middle and suffix, cut between units, with the middle moved to the end.

While a text's units are counted, a sparse index keeps the byte and code-point offset of every EVERY-th unit. A cut finds
the last checkpoint before it by binary search and rescans at most EVERY units from there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Units between two checkpoints, and bytes of a text counted at once.
EVERY, PIECE = 256, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


class Checkpoints:
    """Units of a UTF-8 text: white space and the word after it; white space at the end is a unit of its own. n is their number."""

    def __init__(self, data: bytes, every: int = EVERY, piece: int = PIECE):
        self.data, self.units, self.bytes, self.chars = data, [0], [0], [0]
        words = chars = 0
        for at in range(0, len(data), piece):
            here = np.frombuffer(data, np.uint8, min(piece, len(data) - at), at)
            space = _SPACE[here]
            after = np.append(space[1:], at + piece >= len(data) or _SPACE[data[at + piece]])
            ends = np.flatnonzero(~space & after) + 1
            leads = (here & 0xC0) != 0x80
            kept = ends[every - 1 - words % every :: every]
            if len(kept):
                self.units += range(words - words % every + every, words + len(ends) + 1, every)
                self.bytes += (kept + at).tolist()
                self.chars += (chars + np.cumsum(leads)[kept - 1]).tolist()
            words, chars = words + len(ends), chars + int(leads.sum())
        self.n, self.n_chars = words + bool(data and _SPACE[data[-1]]), chars

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) after the first `unit` units."""
        if unit >= self.n:
            return len(self.data), self.n_chars
        k = bisect_right(self.units, unit) - 1
        end = start = self.bytes[k]
        for _ in range(unit - self.units[k]):
            end = _UNIT.match(self.data, end).end()
        return end, self.chars[k] + len(self.data[start:end].decode())


def _rows(seed: int, rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # outputs are as long as the texts
                part = batch.slice(k, 64)
                rows = [_transformed(doc, text.as_py() or "", seed, rate, spm) for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                new = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *new], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _transformed(doc, text: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output)."""
    index = Checkpoints(text.encode())
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    one, two, three, four = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= rate:
        return index.n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = map(index.cut, sorted((one % (index.n + 1), two % (index.n + 1))))
    prefix, middle, suffix = text[:a_chars], text[a_chars:b_chars], text[b_chars:]
    if four % 100 < spm:
        return index.n, "spm", a_chars, b_chars - a_chars, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return index.n, "psm", a_chars, b_chars - a_chars, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output; one row per input row, whole texts of any length.

    The hash of seed and doc_id draws the two cuts and the form: of 100 texts `rate` are transformed, of 100 of these `spm` with
    the suffix first. Texts that are null, empty or hold a marker stay plain, with null lengths. A null id counts as an
    empty one; rows of one id share their draws; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_rows(seed, rate, spm), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle made output from: markers part it into pieces, which hold none themselves."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
