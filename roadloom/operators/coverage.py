"""Overlapping and gapped intervals: continuous periods of each entity, and the gaps between them.

One global range sort by (entity, start) and two reads of it, so that an entity with a third of all intervals is spread
over many tasks. First read: every partition sums itself up - its first and last entity, and of the last entity the largest
end and the start of its last period. The summaries, one short row per partition, are combined in order of the partitions
into what each partition has to carry in. Second read: every partition walks its rows once with that carried state, labels
each interval with the start of its period and writes a gap wherever a new period begins. What a period gathered in
several partitions is put together by one aggregation over (entity, period start).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.session import cut_lineage, map_batches

_LOWEST = np.iinfo(np.int64).min


def _lowest(dtype: np.dtype) -> int | float:
    return _LOWEST if dtype == np.int64 else -np.inf


class _Walk:
    """State of one pass over rows sorted by (key, start): the current key, its largest end and its period's start."""

    def __init__(self, key: str | None = None, top: int | float | None = None, begun: int | float | None = None):
        self.key, self.top, self.begun = key, top, begun

    def step(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: is it the first of its key, the largest end before it (of its key), the start of its period."""
        n = len(keys)
        new_key = np.empty(n, bool)
        new_key[0] = keys[0] != self.key
        new_key[1:] = keys[1:] != keys[:-1]
        before, begun = np.empty(n, starts.dtype), np.empty(n, starts.dtype)
        lowest = _lowest(starts.dtype)
        cuts = np.flatnonzero(new_key)
        bounds = np.unique(np.concatenate([[0], cuts, [n]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            carried = not new_key[a]
            top, mark = (self.top, self.begun) if carried else (lowest, lowest)
            running = np.maximum.accumulate(np.concatenate([np.array([top], ends.dtype), ends[a:b]]))
            before[a:b] = running[:-1]
            opens = starts[a:b] > running[:-1]
            if not carried:
                opens[0] = True
            begun[a:b] = np.maximum.accumulate(np.where(opens, starts[a:b], np.array(mark, starts.dtype)))
            self.key, self.top, self.begun = keys[b - 1], running[-1].item(), begun[b - 1].item()
        return new_key, before, begun


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch["key"].to_numpy(object), batch["s"].to_numpy(), batch["e"].to_numpy()


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    walk, first = _Walk(), None
    for batch in batches:
        if len(batch):
            arrays = _arrays(batch)
            first = arrays[0][0] if first is None else first
            walk.step(*arrays)
    if first is not None:
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first_key": [first], "last_key": [walk.key], "last_max": [walk.top], "last_start": [walk.begun]})


def combine_summaries(summaries: list[tuple]) -> dict[int, tuple]:
    """Carry-in of every partition that goes on with the key of the one before: (key, largest end, start of the period)."""
    carried: dict[int, tuple] = {}
    key, top, begun = None, None, None
    for part, first, last, last_max, last_start in sorted(summaries):
        if first == key:
            carried[part] = (key, top, begun)
        if first == last == key:
            begun = last_start if last_start > top else begun
            top = max(top, last_max)
        else:
            key, top, begun = last, last_max, last_start
    return carried


def continuous_periods(df: DataFrame, key: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """(``key``, ``kind``, ``start_us``, ``end_us``): the periods of each key and the gaps between successive ones.

    Intervals that overlap, nest or share an end instant form one period; an interval of no length is one too. Rows with
    a null key, start or end, and backward ones (end before start), do not count. Duplicates change nothing. An empty
    table gives an empty table. Starts and ends are whole numbers, or doubles where ``start`` is one: these are compared as
    they are, without rounding, infinite ends too; NaN is none. Only the three named columns are read, so extra columns of any name do no harm.
    """
    spark = df.sparkSession
    number = "double" if dict(df.select(F.col(start).alias("s")).dtypes)["s"] == "double" else "bigint"
    summary = f"part int, first_key string, last_key string, last_max {number}, last_start {number}"
    piece = f"key string, kind string, start_us {number}, end_us {number}"
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(start).cast(number).alias("s"), F.col(end).cast(number).alias("e"))
    if number == "double":
        rows = rows.where("not isnan(s) and not isnan(e)")
    rows = rows.where("key is not null and s <= e").groupBy("key", "s").agg(F.max("e").alias("e"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(rows.repartitionByRange(n, "key", "s").sortWithinPartitions("key", "s"))
    carried = combine_summaries([tuple(r) for r in map_batches(ordered, _summarise, summary).collect()])

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _Walk(*carried.get(TaskContext.get().partitionId(), ()))
        for batch in batches:
            if not len(batch):
                continue
            keys, starts, ends = _arrays(batch)
            new_key, before, begun = walk.step(keys, starts, ends)
            gap = ~new_key & (starts > before)
            yield pd.DataFrame({"key": keys[gap], "kind": "gap", "start_us": before[gap], "end_us": starts[gap]})
            pieces = pd.DataFrame({"key": keys, "kind": "period", "start_us": begun, "end_us": ends})
            yield pieces.groupby(["key", "kind", "start_us"], as_index=False, sort=False)["end_us"].max()

    pieces = map_batches(ordered, rescan, piece)
    out = pieces.groupBy("key", "kind", "start_us").agg(F.max("end_us").alias("end_us"))
    return out.select(F.col("key").alias(key), "kind", "start_us", "end_us")
