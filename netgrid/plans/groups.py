"""Groups of rows in one pass: dealt by key, sorted, and handed to Arrow functions many groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows that a task collects before it works on the whole groups among them.
ROWS = 100_000


def group_starts(b: pa.RecordBatch, n: int) -> np.ndarray:
    """First rows of the runs of equal values of the first ``n`` columns."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True

    def mark(c: pa.Array) -> None:
        if pa.types.is_struct(c.type):
            for part in c.flatten():
                mark(part)
        else:
            codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]

    for c in b.columns[:n]:
        mark(c)
    return np.flatnonzero(new)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_groups(df: DataFrame, by: list[str], order: list[str], run: Callable, schema: StructType, most: int = ROWS, whole: bool = True, weigh: Callable[[pa.RecordBatch], int] | None = None) -> DataFrame:
    """``run(batch, starts, complete)`` over the rows of ``df``, whose columns ``by`` come first, group after group, sorted by ``order`` within.

    ``starts`` are the first rows of the groups in the batch, ``complete`` tells
    for each whether it is whole. A task holds some ``most`` rows and the
    largest group; with ``whole`` false a group larger than ``most`` comes in
    parts, so that no group's size bounds a task. ``run`` returns a batch.
    ``weigh`` tells for how many rows a batch counts, where these hold lists.
    """
    n = len(by)
    weight = weigh or (lambda b: b.num_rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit, cut = [], 0, most, None

        def parts(b: pa.RecordBatch, starts: np.ndarray, last: bool) -> pa.RecordBatch:
            complete = np.ones(len(starts), bool)
            if cut is not None and len(group_starts(pa.Table.from_batches([cut, b.slice(0, 1)]).combine_chunks().to_batches()[0], n)) == 1:
                complete[0] = False
            complete[-1] &= last
            return run(b, starts, complete)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += weight(b)
            if rows < limit:
                continue
            b = _one(held)
            starts = group_starts(b, n)
            if len(starts) > 1:
                yield parts(b.slice(0, int(starts[-1])), starts[:-1], True)
                cut, held = None, [b.slice(int(starts[-1]))]
                rows = weight(held[0])
            elif whole:
                held = [b]
            else:
                yield parts(b, starts, False)
                cut, held, rows = b.slice(b.num_rows - 1), [], 0
            limit = max(most, 2 * rows)
        if held:
            b = _one(held)
            yield parts(b, group_starts(b, n), True)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(task, schema)


def least_members(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by the edges: roots are hooked to lesser ones and trees made flat, again and again."""
    p = np.arange(n)
    while True:
        u, v = p[u], p[v]
        differ = u != v
        if not differ.any():
            return p
        u, v = u[differ], v[differ]
        np.minimum.at(p, np.maximum(u, v), np.minimum(u, v))
        while True:
            q = p[p]
            if np.array_equal(p, q):
                break
            p = q
