"""Smoothing and simplification that leave junctions where they are, with a report.

A vertex that another line of the network has too is pinned, as are the ends of
lines: it is neither moved nor dropped, so the degrees of junctions stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.operators.lines import line_length, topology_report
from netgrid.operators.nodes import shared_points
from netgrid.plans.groups import by_groups
from netgrid.plans.storage import materialise

POINTS = "array<struct<x:double,y:double>>"
PINNED = "array<struct<x:double,y:double,pin:boolean>>"


def pinned(lines: DataFrame, keys: list[str], most: int = 500_000) -> DataFrame:
    """Lines whose vertices tell in ``pin`` whether they are an end or stand in another line too; lines without vertices are left out.

    Networks of up to ``most`` vertices are settled in one pass; in larger ones vertices are grouped by their places.
    """
    some = lines.where(F.size("coords") > 0).select(*keys, "line_id", F.col("coords").cast(POINTS).alias("coords"))
    large = some.groupBy(*keys).agg(F.sum(F.size("coords")).alias("n")).where(F.col("n") > most).select(*keys)
    large = materialise(large, "networks")
    if large.isEmpty():
        return _pinned_within(some, keys, most)
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
    apart = large.select(*[F.col(k).alias("_" + k) for k in keys])
    return _pinned_within(some.join(apart, same, "left_anti"), keys, most).unionByName(_pinned_large(some.join(apart, same, "left_semi"), keys))


def _pinned_within(lines: DataFrame, keys: list[str], most: int) -> DataFrame:
    n = len(keys)
    schema = lines.select(*keys, "line_id", F.lit(None).cast(PINNED).alias("coords")).schema

    def run(b: pa.RecordBatch, starts: np.ndarray, complete: np.ndarray) -> pa.RecordBatch:
        size = np.asarray(b.column(n + 1).value_lengths())
        cut = np.r_[0, np.cumsum(size)]
        flat = b.column(n + 1).flatten()
        line = np.repeat(np.arange(b.num_rows), size)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, b.num_rows]))[line]
        x, y = flat.field("x"), flat.field("y")
        there = np.asarray(x.is_valid()) & np.asarray(y.is_valid())
        at = [c.fill_null(0.0).to_numpy(zero_copy_only=False)[there] for c in (x, y)]
        pin = np.zeros(len(line), bool)
        pin[there] = shared_points(group[there], *at, line[there])
        pin[cut[:-1]] = pin[cut[1:] - 1] = True
        points = pa.StructArray.from_arrays([x, y, pa.array(pin)], names=["x", "y", "pin"])
        return pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.ListArray.from_arrays(pa.array(cut, pa.int32()), points)], names=schema.names)

    return by_groups(lines, keys, [], run, schema, most, weigh=lambda b: len(b.column(n + 1).flatten()))


def _pinned_large(lines: DataFrame, keys: list[str]) -> DataFrame:
    v = lines.select(*keys, "line_id", F.size("coords").alias("n"), F.posexplode("coords").alias("i", "p")).select(*keys, "line_id", "n", "i", "p.x", "p.y")
    shared = v.groupBy(*keys, "x", "y").agg(F.min("line_id").alias("_a"), F.max("line_id").alias("_b")).where("_a <> _b").select(*keys, "x", "y", F.lit(True).alias("shared"))
    told = v.join(shared, [*keys, "x", "y"], "left")
    pin = F.col("shared").isNotNull() | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    rows = told.groupBy(*keys, "line_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", pin.alias("pin")))).alias("c"))
    return rows.select(*keys, "line_id", F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["pin"].alias("pin"))).cast(PINNED).alias("coords"))


def smooth_lines(lines: DataFrame, keys: list[str], offset: float = 0.25) -> DataFrame:
    """One pass of corner cutting: a free vertex becomes two points, ``offset`` of the way to its neighbours."""
    c = F.col("coords")
    toward = lambda p, q: F.struct((p["x"] + offset * (q["x"] - p["x"])).alias("x"), (p["y"] + offset * (q["y"] - p["y"])).alias("y"))
    keep = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    cut = F.transform(c, lambda p, i: F.when(p["pin"], F.array(keep(p))).otherwise(F.array(toward(p, F.get(c, i - 1)), toward(p, F.get(c, i + 1)))))
    return pinned(lines, keys).select(*keys, "line_id", F.flatten(cut).alias("coords"))


def kept_vertices(x: np.ndarray, y: np.ndarray, pin: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices that stay: pinned ones, and between them those that the farthest-point rule keeps."""
    keep = pin.copy()
    at = np.flatnonzero(pin)
    stack = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py, n = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], np.hypot(dx, dy)
        d = np.abs(px * dy - py * dx) / n if n else np.hypot(px, py)
        i = int(d.argmax())
        if d[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def simplify_lines(lines: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Lines without the free vertices that lie within ``tolerance`` of the line through what is kept; a tolerance <= 0 changes nothing."""
    if tolerance <= 0:
        return lines.select(*keys, "line_id", "coords")
    rows = pinned(lines, keys)
    out = rows.select(*keys, "line_id", F.transform("coords", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coords"))
    names, schema = out.columns, out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coords = b.column(b.num_columns - 1)
            cut = np.r_[0, np.cumsum(np.asarray(coords.value_lengths()))]
            flat = coords.flatten()
            x, y, pin = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "pin"))
            keep = np.concatenate([kept_vertices(x[lo:hi], y[lo:hi], pin[lo:hi], tolerance) for lo, hi in zip(cut[:-1], cut[1:], strict=True)] or [np.zeros(0, bool)])
            ends = np.r_[0, np.cumsum(keep)][cut]
            points = pa.StructArray.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["x", "y"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points)], names=names)

    return rows.mapInArrow(run, schema)


def line_topology(lines: DataFrame, keys: list[str], snap: float = 2.5) -> DataFrame:
    """``topology_report`` of lines of many vertices: their ends are the nodes, their whole lengths count."""
    p, q = F.get("coords", F.lit(0)), F.get("coords", F.size("coords") - 1)
    ends = {"x0": p["x"], "y0": p["y"], "x1": q["x"], "y1": q["y"]}
    segments = lines.where(F.size("coords") > 1).select(*keys, "line_id", *[v.alias(c) for c, v in ends.items()], line_length(F.col("coords")).alias("length"))
    return topology_report(segments, keys, snap)


def reshape_report(lines: DataFrame, keys: list[str], operation: str, amount: float) -> DataFrame:
    """Vertices, lengths, dangles, junctions and scores of every network before and after ``smooth`` (amount: offset) or ``simplify`` (tolerance)."""
    if operation not in ("smooth", "simplify"):
        raise ValueError(f"unknown operation {operation!r}")
    after = materialise((smooth_lines if operation == "smooth" else simplify_lines)(lines, keys, amount), "reshaped")
    names = ["n_lines", "n_dangles", "n_junctions", "n_components", "score"]

    def told(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(*keys).agg(F.sum(F.size("coords")).alias(f"{name}_vertices"), F.round(F.sum(line_length(F.col("coords"))), 1).alias(f"{name}_length"))
        return n.join(line_topology(df, keys).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in names]), keys, "left")

    return told(lines, "before").join(told(after, "after"), keys, "left")
