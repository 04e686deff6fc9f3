"""Undo and redo over long logs, many tasks for one job.

The operations of a job are a timeline with a cursor: undo and redo move it,
at most to the ends, and an operation cuts off what is beyond the cursor and
goes there. So two numbers, the cursor k and the length n, are all that a range
of the log needs from what was before; and of a range it is enough to know a
short word of undos, redos and operations that does the same to every k and n.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from netgrid.plans.order import fold
from netgrid.plans.storage import materialise

UNDO, REDO, PUSH = 0, 1, 2


class Word:
    """Runs ``[kind, length]`` of steps, shortened as steps are added by what holds for every cursor and length:

    - u^a r^b u^c is u^(a - b + c) where b is neither above a nor above c; the same with u and r changed;
    - a redo right after an operation does nothing, and as many redos as undos after it undo these;
    - where the undos after j operations never reach below them, the next operation leaves as many as are not undone;
    - j operations, a > j undos and an operation are a - j undos and an operation.
    """

    def __init__(self):
        self.runs: list[list[int]] = []

    def add(self, kind: int, length: int = 1) -> None:
        if not length:
            return
        if kind == PUSH:
            self._push(length)
        else:
            self._move(kind, length)

    def _move(self, kind: int, length: int) -> None:
        runs = self.runs
        if runs and runs[-1][0] == kind:
            length += runs.pop()[1]
        while True:
            if kind == REDO and runs:
                if runs[-1][0] == PUSH:
                    return
                if runs[-1][1] <= length and len(runs) > 1 and runs[-2][0] == PUSH:  # all undos since an operation
                    runs.pop()
                    return
            # the run before is no longer than its neighbours
            if len(runs) > 1 and runs[-1][0] != PUSH and runs[-2][0] == kind and runs[-1][1] <= min(runs[-2][1], length):
                middle = runs.pop()[1]
                length += runs.pop()[1] - middle
                continue
            runs.append([kind, length])
            return

    def _push(self, length: int) -> None:
        runs = self.runs
        while True:
            at = len(runs)
            while at and runs[at - 1][0] != PUSH:
                at -= 1
            if not at:
                break
            moves, held = runs[at:], runs[at - 1][1]
            if not moves:
                runs[-1][1] += length
                return
            if moves[0][1] <= held:  # the runs fall, so the first undos reach the lowest
                left = held - sum(n if kind == UNDO else -n for kind, n in moves)
                del runs[at - 1 :]
                if left:
                    runs.append([PUSH, left + length])
                    return
            elif len(moves) == 1:
                del runs[at - 1 :]
                self._move(UNDO, moves[0][1] - held)
            else:
                break
        runs.append([PUSH, length])

    def apply(self, k: int, n: int) -> tuple[int, int]:
        for kind, length in self.runs:
            if kind == UNDO:
                k = max(k - length, 0)
            elif kind == REDO:
                k = min(k + length, n)
            else:
                k += length
                n = k
        return k, n


def _kinds(ops: pa.Array) -> list[int]:
    return [UNDO if o == "undo" else REDO if o == "redo" else PUSH for o in ops.to_pylist()]


def _words(parts: DataFrame, job: str) -> DataFrame:
    """``(job, _part, word)`` for the first and the last job of each range, the only ones that other ranges can hold too."""
    schema = StructType([parts.schema[job], StructField("_part", LongType()), StructField("word", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, word, first = [], None, None, True

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[job, "_part", "word"])

        types = None
        for b in batches:
            types = types or [b.column(0).type, pa.int64(), pa.string()]
            for j, part, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _kinds(b.column(2)), strict=True):
                if key != (j, part):
                    if key is not None and (first or key[1] != part):
                        done.append((*key, json.dumps(word.runs)))
                    first = key is None or key[1] != part
                    key, word = (j, part), Word()
                word.add(kind)
            if len(done) > 256:
                yield batch(done)
                done = []
        if key is not None:
            done.append((*key, json.dumps(word.runs)))
        if done:
            yield batch(done)

    return parts.select(job, "_part", "op").mapInArrow(run, schema)


def _starts(words: DataFrame, job: str) -> DataFrame:
    """``(job, _part, k, n)``: cursor and length where a job goes on in a further range; at most one row a range."""

    def step(state: list, part: int, word: str) -> tuple | None:
        out = (part, *state[1]) if state[0] else None
        w = Word()
        w.runs = json.loads(word)
        state[0], state[1] = True, w.apply(*state[1])
        return out

    fields = [StructField(c, LongType()) for c in ("_at", "k", "n")]
    return fold(words, job, "_part", ["_part", "word"], fields, lambda: [False, (0, 0)], step).withColumnRenamed("_at", "_part")


def live_operations(log: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """The rows of operations that undo and redo leave standing: a new one clears the redo stack; an undo or redo of nothing does nothing.

    The log is dealt by ranges of (job, order), whatever the share of one job.
    Each range becomes a short word; one number pair a range is carried along;
    then every range gives its operations their places on the timeline. An
    operation stands when no later one went to its place or below, and the last cursor is
    not before it. The order tells the rows of a job apart; rows with a null job are one job.
    """
    parts = materialise(log.repartitionByRange(job, order).withColumn("_part", F.spark_partition_id().cast("long")), "ranges")
    dealt = parts.select(job, "_part", "op", order).repartition("_part").sortWithinPartitions("_part", job, order)
    words = materialise(_words(dealt, job), "words")
    # words of jobs that end in the range where they begin lead nowhere
    starts = materialise(_starts(words, job), "starts")
    told = dealt.join(F.broadcast(starts), dealt[job].eqNullSafe(starts[job]) & (dealt["_part"] == starts["_part"]), "left")
    told = told.select(dealt[job], dealt["_part"], dealt["op"], dealt[order], starts["k"], starts["n"]).sortWithinPartitions("_part", job, order)
    schema = StructType([log.schema[job], StructField("_part", LongType()), log.schema[order], StructField("place", LongType()), StructField("cursor", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, k, n = None, 0, 0
        for b in batches:
            place, cursor = [], []
            for j, part, kind, k0, n0 in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _kinds(b.column(2)), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if key != (j, part):
                    key, k, n = (j, part), k0 or 0, n0 or 0
                if kind == UNDO:
                    k = max(k - 1, 0)
                elif kind == REDO:
                    k = min(k + 1, n)
                else:
                    k += 1
                    n = k
                place.append(k if kind == PUSH else None)
                cursor.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(place, pa.int64()), pa.array(cursor, pa.int64())], names=schema.names)

    at = materialise(told.mapInArrow(run, schema), "places")
    ranges = at.groupBy(job, "_part").agg(F.min("place").alias("low"), F.max_by("cursor", order).alias("cursor"))
    later = Window.partitionBy(job).orderBy(F.desc("_part"))
    ranges = ranges.select(job, "_part", F.min("low").over(later.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.first("cursor").over(later).alias("last"))
    own = Window.partitionBy(job, "_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    ops = at.withColumn("next", F.min("place").over(own)).where("place IS NOT NULL").alias("a").join(ranges.alias("b"), F.col(f"a.{job}").eqNullSafe(F.col(f"b.{job}")) & (F.col("a._part") == F.col("b._part")))
    stand = (F.col("place") <= F.col("last")) & (F.col("next").isNull() | (F.col("place") < F.col("next"))) & (F.col("below").isNull() | (F.col("place") < F.col("below")))
    left = ops.where(stand).select(F.col(f"a.{job}").alias("_job"), F.col("a._part").alias("_at"), F.col(order).alias("_order"))
    return parts.join(left, parts[job].eqNullSafe(F.col("_job")) & (parts["_part"] == F.col("_at")) & (parts[order] == F.col("_order")), "left_semi").drop("_part")
