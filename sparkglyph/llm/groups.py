"""Groups of rows handed to a function one after another, from sorted Arrow batches.

Made for very many small groups: rows are dealt by key, sorted within their
partition, and cut where the key changes; a group may run over several batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def cut(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups: all groups that end in a batch, together with what was carried."""
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if carried and v[0] != carried[-1].column(k)[-1].as_py():
                change[0] = True
        at = np.flatnonzero(change)
        if not len(at):
            carried.append(batch)
            continue
        last = int(at[-1])
        whole = [*carried, *([batch.slice(0, last)] if last else [])]
        carried = [batch.slice(last)]
        if whole:
            yield pa.Table.from_batches(whole)
    if carried:
        yield pa.Table.from_batches(carried)


def bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where the groups of a table of whole groups begin, and its length."""
    change = np.ones(len(table), bool)
    if len(table):
        change[1:] = False
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(table))


def dealt(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows with equal keys side by side in one partition, sorted by ``within``."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *within)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j
