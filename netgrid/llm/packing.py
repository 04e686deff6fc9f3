"""Packing of documents into sequences of a fixed number of tokens.

The configuration linear program over the histogram of lengths: a configuration
is a multiset of lengths that fits one sequence. Multiplicative weights price
the lengths, a knapsack dynamic program finds the best configuration for the
prices, and the fractional solution is rounded down; best fit, grouped by free
space, places what is left. All of it works on at most ``capacity`` counts.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netgrid.llm.memory import released, small_batches
from netgrid.llm.tokens import encoder, slices
from netgrid.plans.storage import materialise

Group = tuple[int, tuple[int, ...]]  # how many sequences hold these lengths


def best_configuration(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Length index -> copies: the knapsack of greatest price; copies beyond ``most`` are dropped.

    value[c] is the best price within c tokens; one pass over c, all lengths at once.
    """
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sizes, worth = lengths[order], prices[order]
    for c in range(int(sizes[0]), capacity + 1):
        n = np.searchsorted(sizes, c, side="right")
        got = worth[:n] + value[c - sizes[:n]]
        k = int(got.argmax())
        if got[k] > value[c - 1]:
            value[c], choice[c] = got[k], order[k]
        else:
            value[c] = value[c - 1]
    out: Counter[int] = Counter()
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
            continue
        out[int(choice[c])] += 1
        c -= int(lengths[choice[c]])
    return {i: min(n, int(most[i])) for i, n in out.items()}


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, epsilon: float) -> dict[tuple, float]:
    """Configurations and how often each is used, nearly covering every length's demand."""
    weights = np.ones(len(lengths))
    covered = np.zeros(len(lengths))
    used: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        found = best_configuration(lengths, weights / demand, demand, capacity)
        idx, n = np.array(list(found)), np.array(list(found.values()))
        step = float((demand[idx] / n).min())
        share = step * n / demand[idx]
        used[tuple(sorted((int(lengths[i]), k) for i, k in found.items()))] += step
        covered[idx] += share
        weights[idx] *= np.exp(-epsilon * share)
    scale = 1 / max(covered.max(), 1e-12)
    return {k: v * scale for k, v in used.items()}


def solve(histogram: dict[int, int], capacity: int, rounds: int = 250, epsilon: float = 0.3, passes: int = 2) -> list[Group]:
    """Groups of equal sequences that place every piece of the histogram once."""
    left = Counter({k: n for k, n in histogram.items() if n > 0})
    out: list[Group] = []
    if left.get(capacity):
        out.append((left.pop(capacity), (capacity,)))
    for _ in range(passes):
        if sum(left.values()) < 4 * len(left) or not left:
            break
        lengths = np.array(sorted(left))
        demand = np.array([left[int(x)] for x in lengths], dtype=float)
        plan = fractional(lengths, demand, capacity, rounds, epsilon)
        # fullest first; rounded down, and never more than is left
        for config, amount in sorted(plan.items(), key=lambda x: (-sum(a * b for a, b in x[0]), -x[1])):
            n = min(int(amount), *(left[a] // b for a, b in config))
            if n and sum(a * b for a, b in config) >= capacity - max(2, capacity // 200):
                out.append((n, tuple(a for a, b in sorted(config, reverse=True) for _ in range(b))))
                for a, b in config:
                    left[a] -= n * b
        left = +left
    return out + best_fit(left, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best fit decreasing on groups: all pieces of a length go to the fullest sequences that can take them."""
    free: dict[int, list[Group]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            space = min((s for s, g in free.items() if g and s >= length), default=None)
            if space is None:
                each = capacity // length
                if n >= each:
                    free[capacity - each * length].append((n // each, (length,) * each))
                    n %= each
                else:
                    free[capacity - n * length].append((1, (length,) * n))
                    n = 0
                continue
            count, held = free[space].pop()
            take = min(n, count)
            if take < count:
                free[space].append((count - take, held))
            free[space - length].append((take, (*held, length)))
            n -= take
    return [g for groups in free.values() for g in groups]


def intervals(groups: list[Group]) -> dict[int, np.ndarray]:
    """For every length: rows (first rank, first sequence, offset), by rank; ranks are dealt in group order."""
    cursor: Counter[int] = Counter()
    out, sequence = defaultdict(list), 0
    for count, held in groups:
        offset = 0
        for length in held:
            out[length].append((cursor[length], sequence, offset))
            cursor[length] += count
            offset += length
        sequence += count
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", token_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: the first is the shorter one, the others are full.

    ``(doc_id, piece, start, length, ids_crc32[, ids], shard, nth)``; nth counts the pieces of that length in the shard (a task).
    """
    leading = tokenizer.startswith("byte_")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * token_ids + ", shard int, nth long"

    def run(batches):
        e, shard, seen = encoder(tokenizer, leading), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for lo, hi in slices(b.num_rows):
                ids = b.column(0).slice(lo, hi - lo).to_pylist()
                rows = []
                for doc, data in zip(ids, e.encode(b.column(1).slice(lo, hi - lo).to_pylist()), strict=True):
                    data += end
                    n = len(data) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        own = (np.frombuffer(data[4 * x : 4 * y], "<u4").astype(np.int64),) if token_ids else ()
                        rows.append((doc, k, x, y - x, zlib.crc32(data[4 * x : 4 * y]), *own, shard, seen[y - x]))
                        seen[y - x] += 1
                if rows:
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * token_ids, pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")]
                    )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, token_ids: bool = False, **columns) -> DataFrame:
    """Every document's pieces and their places: ``sequence_id`` and ``offset``, gapless from 0.

    A null or empty text is a piece of one token, the end id. Repeated rows are
    packed once each; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    pieces = materialise(cut_documents(docs, tokenizer, end_id, capacity, token_ids=token_ids, **columns), "pieces")
    counts = materialise(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    plan = docs.sparkSession.sparkContext.broadcast(intervals(solve(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["shard", "length"])
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * token_ids]

    def place(batches):
        for b in batches:
            length = np.asarray(b.column(3))
            rank = np.asarray(b.column(b.num_columns - 2)) + np.asarray(b.column(b.num_columns - 1))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                at, rows = np.flatnonzero(length == x), plan.value[int(x)]
                i = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = rows[i, 1] + rank[at] - rows[i, 0], rows[i, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * token_ids + ", sequence_id long, offset long"
    return ranked.select(*keep, "nth", "base").mapInArrow(released(place), schema)
