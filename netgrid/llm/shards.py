"""Deal rows to shards by ranges of an integer key, the same on every run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts that one job brings to the driver, and shards of a table, at most; beyond that shards grow with the table.
CELLS = 1 << 17
MOST_SHARDS = 1 << 16


def range_bounds(df: DataFrame, key: str, weight: Column, target: float) -> tuple[list[int], list[float]]:
    """Lower bounds of ranges (beyond the first) of about ``target`` weight, and each range's weight.

    Keys are counted by their leading bits, and all ranges that are too heavy
    by more bits in one job together, so the number of jobs does not grow with
    the table. The bounds depend on the rows alone. Rows of one key are never
    parted: keys are meant to be unique, and a shard is as large as its most
    frequent key at least.
    """
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), weight.cast("double").alias("w"))
    least, most, total = src.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if least is None:
        return [], [0.0]
    target = max(target, total / MOST_SHARDS)
    bits = next(b for b in range(65) if (most >> b) - (least >> b) < CELLS)
    done: list[tuple[int, float]] = []
    rows = src
    while True:
        t = rows.groupBy(F.shiftright("k", bits).alias("b")).agg(F.sum("w").alias("w")).toArrow()
        heavy = []
        for b, w in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            if w > target and bits:
                heavy.append(b)
            else:
                done.append((b << bits, w))
        if not heavy:
            break
        few = F.broadcast(df.sparkSession.createDataFrame([(b,) for b in heavy], "b long"))  # at most total / target
        rows = src.withColumn("b", F.shiftright("k", bits)).join(few, "b", "left_semi")
        bits = max(0, bits - max(1, (CELLS // len(heavy)).bit_length() - 1))
    bounds, sums = [], [0.0]
    for at, w in sorted(done):
        if sums[-1] and sums[-1] + w > target:
            bounds.append(at)
            sums.append(0.0)
        sums[-1] += w
    return bounds, sums


def shard_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key: a binary search in one array of constants."""
    if not bounds:
        return F.lit(0)
    held = F.lit(np.array(bounds, dtype=np.int64))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= key, at + s).otherwise(at))


def dealt(df: DataFrame, key: str, bounds: list[int], then: list[str]) -> DataFrame:
    """Column ``shard`` added; rows of a shard share a partition, sorted by shard and ``then``."""
    out = df.withColumn("shard", shard_of(F.col(key), bounds))
    return out.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", *then)
