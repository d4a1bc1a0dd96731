"""Small groups handed to Python in one pass over sorted partitions, without a call of its own for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tasks for each core where rows make many more: few enough bytes to be put together, so Spark would leave such rows to a task or two. Those of Python cost more to begin.
TASKS, PYTHON_TASKS = 16, 4


def in_tasks(rows: DataFrame, *keys: str, tasks: int = TASKS) -> DataFrame:
    """rows spread by keys over a number of tasks that Spark doesn't lower by their bytes."""
    return rows.repartition(tasks * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def map_groups(rows: DataFrame, keys: list[str], order: list[str], settle: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """settle(group) for each group of equal keys (which are not null, but for texts), given as rows in order; its tuples are rows of schema.

    One group at a time is held in memory, so groups are to be bounded by the caller.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        now, out = None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                if held and key != now:
                    out += settle(held)
                    held = []
                now = key
                held.append(r)
            yield pd.DataFrame(out, columns=names, dtype=object)
            out = []
        if held:
            yield pd.DataFrame(list(settle(held)), columns=names, dtype=object)

    # by a hash, not by the keys: Spark leaves out a shuffle by keys after a union or join already spread by them, whose partitions may still be cut
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


#: Rows of whole cells that are handed over at once.
CHUNK = 40_000


def map_cells(rows: DataFrame, each: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str, chunk: int = CHUNK, order: Iterable = (), many: bool = False) -> DataFrame:
    """each over tables of whole cells (column cell), of about chunk rows, each cell in order; many: it makes many rows of few."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            held.append(batch)
            last = batch["cell"][-1] if batch.num_rows else None
            if sum(b.num_rows for b in held) < chunk or last is None or held[0]["cell"][0] == last:
                continue
            rows = pa.Table.from_batches(held)
            whole = int(np.flatnonzero(rows["cell"].to_numpy() != last.as_py())[-1]) + 1
            yield from each(rows.slice(0, whole))
            held = [b for b in rows.slice(whole).to_batches() if b.num_rows]
        if any(b.num_rows for b in held):
            yield from each(pa.Table.from_batches(held))

    dealt = in_tasks(rows, "cell", tasks=PYTHON_TASKS) if many else rows.repartition("cell")
    return dealt.sortWithinPartitions("cell", *order).mapInArrow(run, schema)


def spans(low: np.ndarray, high: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row, place) of every place from low to high of each row, by runs of rows of about `most` places; row counts within rows."""
    n = np.maximum(high - low, 0)
    upto = np.cumsum(n)
    cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + most, most), "right")) if len(n) else []
    for a, b in zip([0, *cuts], [*cuts, len(n)], strict=True):
        if total := int(n[a:b].sum()):
            row = np.repeat(np.arange(b - a), n[a:b])
            yield np.arange(a, b), row, np.arange(total) - np.repeat(upto[a:b] - n[a:b] - low[a:b] - (upto[a] - n[a]), n[a:b])
