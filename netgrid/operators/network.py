"""Skeleton degrees, dead ends, cuts, projections and label-free scores of line networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgrid.operators.cells import distance_within, rasterize_lines
from netgrid.operators.cover import cell_at, cells_along
from netgrid.operators.evaluate import f_beta, ratio
from netgrid.operators.lines import endpoints
from netgrid.plans.groups import by_groups


def pixel_degree(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``degree`` (set neighbours of eight) of every set cell, and whether it is a node (degree not 2)."""
    near = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x])
    at = cells.select(*keys, "r", "c").distinct()
    told = at.select(*keys, "r", "c", F.inline(near)).select(*keys, (F.col("r") + F.col("dy")).alias("r"), (F.col("c") + F.col("dx")).alias("c"))
    n = told.groupBy(*keys, "r", "c").agg(F.count("*").alias("degree"))
    return at.join(n, [*keys, "r", "c"], "left").na.fill(0, ["degree"]).withColumn("is_node", F.col("degree") != 2)


def to_metres(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Local equirectangular metres from degrees."""
    return (x - lon0) * 111320.0 * F.cos(F.radians(lat0)), (y - lat0) * 110540.0


def to_degrees(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return x / (111320.0 * F.cos(F.radians(lat0))) + lon0, y / 110540.0 + lat0


def utm_zone(lon: Column, lat: Column) -> Column:
    """Code of the UTM zone of a place."""
    return F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6).cast("int") + 1


def root_of_squares(dx: Column, dy: Column) -> Column:
    """Distance as SQL takes it; ``hypot`` rounds otherwise, which settles near ties the other way."""
    return F.sqrt(dx * dx + dy * dy)


def point_to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Distance of a point to a segment, and the place of its foot (0 to 1)."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n > 0, ((px - x0) * dx + (py - y0) * dy) / F.nullif(n, F.lit(0.0))).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return root_of_squares(px - x0 - t * dx, py - y0 - t * dy), t


def near_segments(points: DataFrame, segments: DataFrame, keys: list[str], radius: float, cell: float = 100.0, carry: list[str] = ()) -> DataFrame:
    """Points ``(x, y)`` with the segments within a radius, their columns named s..., and those of ``carry``: an equi-join on the cells along the segments."""
    c = F.col
    s = segments.select(*keys, c("line_id").alias("other_id"), *[c(v).alias("s" + v) for v in ("x0", "y0", "x1", "y1", *carry)])
    s = s.select("*", F.explode(cells_along(c("sx0"), c("sy0"), c("sx1"), c("sy1"), radius, cell)).alias("_cell"))
    d, t = point_to_segment(c("x"), c("y"), c("sx0"), c("sy0"), c("sx1"), c("sy1"))
    at = points.withColumn("_cell", cell_at(c("x"), c("y"), cell))
    return at.join(s, [*keys, "_cell"]).drop("_cell").withColumns({"d": d, "t": t}).where(c("d") <= radius)


def dead_ends(segments: DataFrame, keys: list[str], join: float = 2.5) -> DataFrame:
    """Ends that touch no other line anywhere within ``join``."""
    ends = endpoints(segments, keys)
    touched = near_segments(ends, segments, keys, join).where("line_id <> other_id").select(*keys, "line_id", "end").distinct()
    return ends.join(touched, [*keys, "line_id", "end"], "left_anti")


def snap_ends(human: DataFrame, segments: DataFrame, keys: list[str], snap: float = 3.0) -> DataFrame:
    """Each human end with the nearest other line: the end of that line when the foot is near it, else a cut.

    All ends are snapped against the original lines; ties go to the least line id.
    """
    near = near_segments(endpoints(human, keys), segments, keys, snap).where("line_id <> other_id")
    length = F.hypot(F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0"))
    best = near.groupBy(*keys, "line_id", "end").agg(F.min_by(F.struct("other_id", "sx0", "sy0", "sx1", "sy1", "t", "d", length.alias("length")), F.struct("d", "other_id")).alias("b"))
    b = best.select(*keys, "line_id", "end", "b.*")
    fx, fy = F.col("sx0") + F.col("t") * (F.col("sx1") - F.col("sx0")), F.col("sy0") + F.col("t") * (F.col("sy1") - F.col("sy0"))
    start, stop = F.col("t") * F.col("length") <= snap, (1 - F.col("t")) * F.col("length") <= snap
    return b.select(
        *keys, "line_id", "end", "other_id", F.when(start, F.col("sx0")).when(stop, F.col("sx1")).otherwise(fx).alias("x"), F.when(start, F.col("sy0")).when(stop, F.col("sy1")).otherwise(fy).alias("y"),
        F.when(~start & ~stop, F.col("t") * F.col("length")).alias("cut_at"),
    )


def split_at(segments: DataFrame, cuts: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Segments split at distances; cuts nearer than ``least`` to an end or to the cut before are left out; pieces are numbered from 1."""
    c = cuts.groupBy(*keys, "line_id").agg(F.array_sort(F.collect_list("at")).alias("cuts"))
    s = segments.join(c, [*keys, "line_id"], "left").withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda x: (x >= least) & (x <= F.col("length") - least))
    kept = thinned(inner, least)
    marks = F.concat(F.array(F.lit(0.0)), kept, F.array(F.col("length")))
    p = s.withColumn("marks", marks).select("*", F.explode(F.sequence(F.lit(1), F.size("marks") - 1)).alias("piece"))
    at = lambda a, b, m: F.col(a) + (F.col(b) - F.col(a)) * F.coalesce(m / F.nullif(F.col("length"), F.lit(0.0)), F.lit(0.0))
    lo, hi = F.element_at("marks", F.col("piece")), F.element_at("marks", F.col("piece") + 1)
    return p.select(*keys, "line_id", "piece", at("x0", "x1", lo).alias("x0"), at("y0", "y1", lo).alias("y0"), at("x0", "x1", hi).alias("x1"), at("y0", "y1", hi).alias("y1"))


def thinned(values: Column, least: float) -> Column:
    """Sorted values without those nearer than ``least`` to the last one kept."""
    start = F.struct(F.lit(-1e18).alias("last"), F.array().cast("array<double>").alias("kept"))

    def step(acc, x):
        far = x - acc["last"] >= least
        return F.struct(F.when(far, x).otherwise(acc["last"]).alias("last"), F.when(far, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(values, start, step, lambda a: a["kept"])


def replay(log: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """Human features that no later delete or replace of the same id takes away. ``log``: op, id, target (an id or null)."""
    made = log.where("op IN ('add', 'replace')").select(job, order, "id")
    gone = log.where("op IN ('delete', 'replace') AND target IS NOT NULL").groupBy(job, F.col("target").alias("id")).agg(F.max(order).alias("gone"))
    return made.join(gone, [job, "id"], "left").where(F.col("gone").isNull() | (F.col("gone") < F.col(order))).drop("gone")


def rank_suggestions(suggestions: DataFrame, limit: int = 60) -> DataFrame:
    """Gaps before missed lines, best first."""
    return suggestions.orderBy(F.desc(F.col("kind") == "gap"), F.desc("score"), "line_id").limit(limit)


def expected_scores(segments: DataFrame, cells: DataFrame, keys: list[str], size: float, half_width: float = 3.5, value: str = "conf") -> DataFrame:
    """Scores without labels: the band around the network against the confidence map."""
    band = distance_within(rasterize_lines(segments, keys, size), keys, half_width).select(*keys, "r", "c")
    hit = band.join(cells.select(*keys, "r", "c", value), [*keys, "r", "c"], "left").groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("inside"), F.count("*").alias("n"))
    out = hit.join(cells.groupBy(*keys).agg(F.sum(value).alias("total")), keys)
    out = out.withColumns({"precision": ratio(F.col("inside"), F.col("n")), "recall": ratio(F.col("inside"), F.col("total"))})
    return out.select(*keys, "precision", "recall", f_beta(F.col("precision"), F.col("recall"), 1.0).alias("f1"))


def to_blocks(cells: DataFrame, keys: list[str], side: int = 256, value: str = "v") -> DataFrame:
    """Sparse cells as dense blocks: ``(keys, br, bc, data)``, row by row."""
    at = cells.withColumns({"br": F.floor(F.col("r") / side).cast("int"), "bc": F.floor(F.col("c") / side).cast("int")})
    at = at.withColumn("k", (F.col("r") % side * side + F.col("c") % side).cast("int"))
    rows = at.select(*keys, "br", "bc", "k", F.col(value).cast("float").alias("v"))
    schema = rows.select(*keys, "br", "bc", F.array("v").alias("data")).schema
    n = len(keys) + 2

    def run(b: pa.RecordBatch, starts: np.ndarray, complete: np.ndarray) -> pa.RecordBatch:
        data = np.zeros((len(starts), side * side), np.float32)
        g = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, b.num_rows]))
        data[g, b.column(n).to_numpy()] = b.column(n + 1).fill_null(0).to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * side * side, pa.int32()), pa.array(data.ravel()))
        return pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(starts)) for i in range(n)], lists], names=schema.names)

    return by_groups(rows, [*keys, "br", "bc"], [], run, schema, max(1, 8_000_000 // (side * side)))


def to_cells(blocks: DataFrame, keys: list[str], side: int = 256, value: str = "v") -> DataFrame:
    """Cells above 0 of dense blocks."""
    e = blocks.select(*keys, "br", "bc", F.posexplode("data").alias("k", value)).where(F.col(value) != 0)
    return e.select(*keys, (F.col("br") * side + F.floor(F.col("k") / side)).alias("r"), (F.col("bc") * side + F.col("k") % side).cast("long").alias("c"), value)


def _keep(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices that the Douglas-Peucker rule keeps."""
    keep = np.zeros(len(x), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        n = np.hypot(dx, dy)
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        d = np.abs(px * dy - py * dx) / n if n else np.hypot(px, py)
        i = int(d.argmax())
        if d[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines with fewer vertices, no farther than ``tolerance`` from the original; short lines and tolerances <= 0 change nothing."""
    if tolerance <= 0:
        return lines

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(coords: pd.Series) -> pd.Series:
        out = []
        for c in coords:
            if c is None or len(c) < 3:
                out.append(c)
                continue
            x, y = np.array([p["x"] for p in c]), np.array([p["y"] for p in c])
            out.append([c[i] for i in np.flatnonzero(_keep(x, y, tolerance))])
        return pd.Series(out)

    return lines.withColumn("coords", run("coords"))
