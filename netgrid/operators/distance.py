"""Exact Euclidean distances to the background, and the widths of labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netgrid.operators.cells import run_width
from netgrid.operators.vectorise import thin
from netgrid.plans.storage import materialise


def lower_envelope(sites: np.ndarray, heights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over sites of (x - site)^2 + height, for ascending sites and ascending places x (Felzenszwalb and Huttenlocher, 2012).

    The envelope's parabolas are kept on a stack with the places from which on each is lowest.
    """
    if not len(sites):
        return np.full(len(at), np.inf)
    kept, begin = [0], [-np.inf]
    s, h = sites.astype(float).tolist(), heights.tolist()
    for i in range(1, len(s)):
        while True:
            j = kept[-1]
            cross = (h[i] + s[i] * s[i] - h[j] - s[j] * s[j]) / (2 * (s[i] - s[j]))
            if cross > begin[-1]:
                break
            kept.pop()
            begin.pop()
        kept.append(i)
        begin.append(cross)
    low = np.array(kept)[np.searchsorted(begin, at, side="left") - 1]
    return (at - sites[low]) ** 2 + heights[low]


def squared_distances(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """``(keys, r, c, d2)``: for every set cell the squared distance to the nearest clear cell of the raster; null where there is none.

    Rows first: the distance within its row follows from the run that a cell
    lies in. Then columns: what lies past the clear cell that ends a run of
    the column is never nearer than that cell, so each run is settled alone,
    by the lower envelope of one parabola a cell and one at each clear end. A
    task holds the set cells of one column at a time. Cells outside the raster
    are left out; outside counts neither as set nor as clear.
    """
    at = cells.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    at = at.where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))
    row = Window.partitionBy(*keys, "r").orderBy("c")
    at = at.withColumn("g", F.col("c") - F.row_number().over(row))
    run = Window.partitionBy(*keys, "r", "g")
    at = at.withColumns({"c0": F.min("c").over(run), "c1": F.max("c").over(run)})
    left, right = F.when(F.col("c0") > 0, F.col("c") - F.col("c0") + 1), F.when(F.col("c1") < width - 1, F.col("c1") - F.col("c") + 1)
    near = F.least(left, right).cast("double")  # nulls are passed over
    column = Window.partitionBy(*keys, "c").orderBy("r")
    rows = at.select(*keys, "r", "c", (near * near).alias("h"), (F.col("r") - F.coalesce(F.lag("r").over(column), F.lit(-2)) > 1).alias("starts"))
    names = [*keys, "r", "c", "d2"]
    schema = rows.select(*keys, "r", "c", F.col("h").alias("d2")).schema

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        n = len(keys)
        r, h = b.column(n).to_numpy(), b.column(n + 2).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(b.column(n + 3).to_numpy(zero_copy_only=False))
        out = np.empty(len(r))
        for lo, hi in zip(first, [*first[1:], len(r)], strict=True):
            ends = [v for v in (r[lo] - 1, r[hi - 1] + 1) if 0 <= v < height]
            ok = np.isfinite(h[lo:hi])
            sites, heights = np.r_[r[lo:hi][ok], ends], np.r_[h[lo:hi][ok], np.zeros(len(ends))]
            order = np.argsort(sites, kind="stable")
            out[lo:hi] = lower_envelope(sites[order], heights[order], r[lo:hi])
        return pa.RecordBatch.from_arrays([*b.columns[: n + 2], pa.array(out, mask=~np.isfinite(out))], names=names)

    def run_by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for b in batches:
            starts = np.flatnonzero(b.column(len(keys) + 3).to_numpy(zero_copy_only=False))
            if len(starts):
                held.append(b.slice(0, int(starts[-1])))
                if sum(x.num_rows for x in held):
                    yield settle(whole())
                held = []
                b = b.slice(int(starts[-1]))
            held.append(b)
        if sum(x.num_rows for x in held):
            yield settle(whole())

    return rows.mapInArrow(run_by_run, schema)


def label_width(mask: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """``(keys, edt, area_per_skeleton, run_mode)``: three estimates of the line width of every mask.

    Twice the mean distance to the background at skeleton cells (those without
    any background do not count), set cells per skeleton cell, and the most
    frequent run length. A raster without set cells has no row.
    """
    at = [*keys, "r", "c"]
    mask = materialise(mask.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct(), "mask")
    skeleton = thin(mask, keys).select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    # the skeleton has a row a cell, but its files pack so well that it would be taken for a small table and sent through the driver
    d = squared_distances(mask, keys, height, width).join(skeleton.hint("merge"), at, "left_semi")
    mean = d.groupBy(*keys).agg((2 * F.avg(F.sqrt("d2"))).alias("edt"), F.count("*").alias("n"))
    area = mask.groupBy(*keys).agg(F.count("*").alias("area"))
    out = area.join(mean, keys, "left").join(run_width(mask, keys), keys, "left")
    return out.select(*keys, F.coalesce("edt", F.lit(0.0)).alias("edt"), F.coalesce(F.col("area") / F.col("n"), F.lit(0.0)).alias("area_per_skeleton"), F.coalesce(F.col("width"), F.lit(0)).alias("run_mode"))
