"""Weighted quantiles from mergeable summaries.

A summary holds some of the values in order, each with its weight and with bounds of its rank: the weight of all smaller
values is at least ``low`` and that of all values up to it at most ``high``. Summaries of parts are merged exactly, and
pruned to a size, which widens the gaps between ranks by the total over the size. Tasks make summaries of their rows, two
of one level becoming one of the next; theirs are merged by two rounds of aggregation, FAN at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Summaries that are merged at a time, and rounds of merging; what is left then, one for each FAN ** LEVELS tasks, the
#: driver merges.
FAN, LEVELS = 64, 2
#: Values that a task holds of a feature before it makes a summary of them.
HELD = 1 << 17


@dataclass
class Summary:
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(value: np.ndarray, weight: np.ndarray) -> Summary:
        """The exact summary of some values; those that are missing or have no weight are left out."""
        there = ~np.isnan(value) & (weight > 0)
        distinct, place = np.unique(value[there], return_inverse=True)
        own = np.bincount(place, weight[there], len(distinct)) if len(distinct) else np.zeros(0)
        upto = np.cumsum(own)
        return Summary(distinct, upto - own, upto, own)

    @property
    def total(self) -> float:
        return float(self.high[-1]) if len(self.high) else 0.0

    def _bounds(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What this summary says of any values: least weight below, most weight up to, and own weight."""
        if not len(self.value):
            return (np.zeros(len(value)),) * 3
        after = np.searchsorted(self.value, value, "right")
        before = np.searchsorted(self.value, value, "left")
        held = after > before
        at = np.minimum(before, len(self.value) - 1)
        below = np.where(before > 0, self.low[before - 1] + self.weight[before - 1], 0.0)
        above = np.where(before < len(self.value), self.high[at] - self.weight[at], self.total)
        return np.where(held, self.low[at], below), np.where(held, self.high[at], above), np.where(held, self.weight[at], 0.0)

    def merged(self, other: Summary) -> Summary:
        value = np.union1d(self.value, other.value)
        mine, theirs = self._bounds(value), other._bounds(value)
        return Summary(value, *(a + b for a, b in zip(mine, theirs, strict=True)))

    def nearest(self, ranks: np.ndarray) -> np.ndarray:
        """For each rank the place of the value whose middle rank is nearest (of two the first)."""
        middle = (self.low + self.high) / 2
        at = np.clip(np.searchsorted(middle, ranks), 1, max(1, len(middle) - 1))
        if len(middle) < 2:
            return np.zeros(len(ranks), np.int64)
        return np.where(ranks - middle[at - 1] <= middle[at] - ranks, at - 1, at)

    def pruned(self, size: int) -> Summary:
        """At most about ``size`` values: the ends, and those nearest to evenly spaced ranks."""
        if len(self.value) <= size:
            return self
        at = np.unique(np.concatenate([[0, len(self.value) - 1], self.nearest(np.linspace(0, self.total, size - 1))]))
        return Summary(self.value[at], self.low[at], self.high[at], self.weight[at])

    def packed(self) -> bytes:
        return np.concatenate([self.value, self.low, self.high, self.weight]).astype("<f8").tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Summary:
        return Summary(*np.frombuffer(data, "<f8").reshape(4, -1))


def summaries(rows: DataFrame, columns: list[str], weights: Callable[[pa.RecordBatch], np.ndarray], eps: float) -> list[Summary]:
    """A summary of each column, with ranks within ``eps`` of the total; ``weights`` gives those of a batch's rows.

    What reaches the driver is a summary a column for each FAN ** LEVELS tasks, of a size that ``eps`` sets.
    """
    size = math.ceil((LEVELS + 3) / eps)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[list[Summary | None]] = [[] for _ in columns]
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in columns]
        count = 0

        def flush() -> None:
            for own, parts in zip(levels, held, strict=True):
                if not parts:
                    continue
                fresh = Summary.of(*(np.concatenate(x) for x in zip(*parts, strict=True))).pruned(8 * size)
                parts.clear()
                k = 0
                while k < len(own) and (equal := own[k]) is not None:  # as in a binary counter
                    fresh, own[k] = equal.merged(fresh).pruned(8 * size), None
                    k += 1
                own[k:] = [fresh, *own[k + 1 :]]

        for batch in batches:
            w = weights(batch)
            for k, c in enumerate(columns):
                held[k].append((batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False), w))
            count += batch.num_rows
            if count >= HELD:
                flush()
                count = 0
        flush()
        part = TaskContext.get().partitionId()
        whole = [reduce(Summary.merged, [s for s in own if s is not None], Summary(*(np.zeros(0),) * 4)).pruned(size) for own in levels]
        found = [(k, part, s.packed()) for k, s in enumerate(whole) if len(s.value)]
        yield pa.record_batch([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], names=["feature", "part", "summary"])

    def merge(table: pa.Table) -> pa.Table:
        whole = Summary.unpacked(table.column("summary")[0].as_py())
        for data in table.column("summary")[1:]:
            whole = whole.merged(Summary.unpacked(data.as_py()))
        return pa.table([table.column("feature")[:1], table.column("part")[:1], pa.array([whole.pruned(size).packed()], pa.binary())], names=["feature", "part", "summary"])

    schema = "feature int, part int, summary binary"
    level = rows.mapInArrow(make, schema)
    for _ in range(LEVELS):
        level = level.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("feature", "part").applyInArrow(merge, schema)
    out = [Summary(*(np.zeros(0),) * 4) for _ in columns]
    for r in level.collect():  # a row a column and FAN ** LEVELS tasks
        s = Summary.unpacked(r["summary"])
        out[r["feature"]] = out[r["feature"]].merged(s) if len(out[r["feature"]].value) else s
    return out


def cuts(summary: Summary, bins: int) -> list[float]:
    """Values at the ranks k / bins of the total; all but the largest if there are no more than ``bins`` values."""
    if len(summary.value) <= bins:
        return summary.value[:-1].tolist()
    at = summary.nearest(np.arange(1, bins) * summary.total / bins)
    return np.unique(summary.value[at]).tolist()
