"""Cells dealt to square blocks, with a border of their neighbours' cells, and worked on as arrays of many blocks at a time.

A block's rows are bounded by its area, so no raster's size bounds a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from netgrid.plans.groups import by_groups, least_members

SIDE = 256
#: Places of the arrays that are worked on at once; one block may have more.
AREA = 8_000_000
NONE = -(1 << 60)  # the place of a row that only names its block


def dealt(cells: DataFrame, keys: list[str], side: int, halo: int) -> DataFrame:
    """``(keys, _br, _bc, r, c)``: every cell for its own block and for those that it borders on within ``halo``; rows may repeat."""

    def blocks(x: str) -> Column:
        return F.floor(F.col(x) / side) if not halo else F.explode(F.sequence(F.floor((F.col(x) - halo) / side), F.floor((F.col(x) + halo) / side)))

    at = cells.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    return at.select("*", blocks("r").alias("_br")).select("*", blocks("c").alias("_bc")).select(*keys, "_br", "_bc", "r", "c")


class Canvas:
    """Blocks in one flat array: ``at`` are the places of the cells ``(r, c)``, ``g`` their groups, ``w`` the row lengths there.

    Each group takes the rectangle from its ``lo`` to its ``hi`` (r, c), or around its cells, and ``pad`` places more on all sides.
    """

    def __init__(self, r: np.ndarray, c: np.ndarray, starts: np.ndarray, pad: int, box: tuple | None = None):
        n = np.diff(np.r_[starts, len(r)])
        lo_r, lo_c, hi_r, hi_c = box or (np.minimum.reduceat(r, starts), np.minimum.reduceat(c, starts), np.maximum.reduceat(r, starts), np.maximum.reduceat(c, starts))
        self.r0, self.c0, self.wide = lo_r - pad, lo_c - pad, hi_c - lo_c + 1 + 2 * pad
        ends = np.cumsum((hi_r - lo_r + 1 + 2 * pad) * self.wide)
        self.size, self.base = int(ends[-1]), np.r_[0, ends[:-1]]
        self.g = np.repeat(np.arange(len(starts)), n)
        self.w = self.wide[self.g]
        self.at = self.base[self.g] + (r - self.r0[self.g]) * self.w + (c - self.c0[self.g])

    def cells(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, row and column of places."""
        g = np.searchsorted(self.base, at, side="right") - 1
        y, x = np.divmod(at - self.base[g], self.wide[g])
        return g, y + self.r0[g], x + self.c0[g]


def _pieces(starts: np.ndarray, n: int, areas: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches ``(first row, end, starts in it)`` of whole groups whose areas come to AREA or so."""
    part = np.cumsum(areas) // AREA
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(first, [*first[1:], len(starts)], strict=True):
        lo, hi = int(starts[a]), int(starts[b]) if b < len(starts) else n
        yield lo, hi, starts[a:b] - lo


def by_blocks(cells: DataFrame, keys: list[str], run: Callable, fields: list[StructField], pad: int, area: int = 0, more: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, fields)`` of dealt cells; ``run(r, c, starts, br, bc)`` gives the number of the group of each output row and the fields' values.

    ``area``: the places a block takes, where not those of its cells and ``pad`` around them. ``run`` also gets the columns ``more``.
    """
    schema = StructType([*[cells.schema[k] for k in keys], *fields])
    names, types, n = schema.names, [to_arrow_type(f.dataType) for f in fields], len(keys)

    def work(b: pa.RecordBatch, starts: np.ndarray, complete: np.ndarray) -> pa.RecordBatch:
        br, bc = (b.column(n + i).to_numpy()[starts] for i in (0, 1))
        r, c = (pc.fill_null(b.column(n + i), NONE).to_numpy() for i in (2, 3))
        rest = [b.column(x).to_numpy(zero_copy_only=False) for x in more]
        reach = lambda v: np.maximum.reduceat(v, starts) - np.minimum.reduceat(v, starts) + 1 + 2 * pad
        areas = np.full(len(starts), area) if area else reach(r) * reach(c)
        rows, values, g0 = [], [], 0
        for lo, hi, own in _pieces(starts, len(r), areas):
            g, *got = run(r[lo:hi], c[lo:hi], own, br[g0 : g0 + len(own)], bc[g0 : g0 + len(own)], *[x[lo:hi] for x in rest])
            rows.append(starts[g0 + g])
            values.append(got)
            g0 += len(own)
        take = pa.array(np.concatenate(rows))
        cols = [b.column(i).take(take) for i in range(n)]
        for i, t in enumerate(types):
            got = [v[i] for v in values]
            cols.append(pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x in got]).cast(t))
        return pa.RecordBatch.from_arrays(cols, names=names)

    return by_groups(cells, [*keys, "_br", "_bc"], ["r", "c"], work, schema)


def offsets(radius: float, shape: str = "disk") -> list[tuple[int, int]]:
    k = int(radius)
    inside = (lambda y, x: y * y + x * x <= radius * radius) if shape == "disk" else (lambda y, x: abs(y) + abs(x) <= radius)
    return [(y, x) for y in range(-k, k + 1) for x in range(-k, k + 1) if inside(y, x)]


AT = [StructField("r", LongType()), StructField("c", LongType())]


def as_given(out: DataFrame, cells: DataFrame, keys: list[str], rest: tuple[str, ...] = ()) -> DataFrame:
    """Rows and columns in the types of ``cells``."""
    kind = dict(cells.dtypes)
    return out.select(*keys, *[F.col(v).cast(kind[v]).alias(v) for v in ("r", "c")], *rest)


def grown(cells: DataFrame, keys: list[str], near: list[tuple[int, int]], height: int | None = None, width: int | None = None, side: int = SIDE) -> DataFrame:
    """``(keys, r, c, d2)``: the cells at the offsets ``near`` of set ones, within the raster if given, with the least squared distance."""
    pad = max((max(abs(y), abs(x)) for y, x in near), default=0)
    steps = sorted(((y * y + x * x, y, x) for y, x in near), reverse=True)

    def run(r, c, starts, br, bc):
        v = Canvas(r, c, starts, pad)
        d = np.full(v.size, -1, np.int64 if pad > 20_000 else np.int32)
        for d2, y, x in steps:
            d[v.at + y * v.w + x] = d2
        at = np.flatnonzero(d >= 0)
        g, r, c = v.cells(at)
        own = (r // side == br[g]) & (c // side == bc[g])
        if height is not None:
            own &= (r >= 0) & (r < height) & (c >= 0) & (c < width)
        return g[own], r[own], c[own], d[at[own]]

    return by_blocks(dealt(cells, keys, max(side, pad), pad), keys, run, [*AT, StructField("d2", LongType())], pad) if side >= pad else grown(cells, keys, near, height, width, pad)


def met(a: DataFrame, b: DataFrame, keys: list[str], near: dict[str, list[tuple[int, int]]], side: int = SIDE) -> DataFrame:
    """``(keys, n0, n1, name0, name1, ...)``: how many different cells ``a`` and ``b`` have, and of ``near``, offsets by name, how many of these have one of the other there.

    Cells are counted inside blocks, so no grown cell leaves its task. A key
    without cells has no row; cells without a place are left out.
    """
    pad = max((max(abs(y), abs(x)) for of in near.values() for y, x in of), default=0)
    side = max(side, pad)
    steps = [sorted(of, key=lambda o: o[0] * o[0] + o[1] * o[1]) for of in near.values()]
    names = [f"{n}{i}" for n in ("n", *near) for i in (0, 1)]

    def run(r, c, starts, br, bc, second):
        v = Canvas(r, c, starts, pad)
        masks = [np.zeros(v.size, bool) for _ in range(2)]
        for m, of in zip(masks, (~second, second), strict=True):
            m[v.at[of]] = True
        counts = []
        for m, other in zip(masks, reversed(masks), strict=True):
            at = np.flatnonzero(m)
            g, r, c = v.cells(at)
            own = (r // side == br[g]) & (c // side == bc[g])
            at, g = at[own], g[own]
            total = np.bincount(g, minlength=len(starts))
            found = []
            for offsets_ in steps:
                p, w, k = at, v.wide[g], g
                for y, x in offsets_:
                    left = ~other[p + y * w + x]
                    p, w, k = p[left], w[left], k[left]
                found.append(total - np.bincount(k, minlength=len(starts)))
            counts.append([total, *found])
        some = np.flatnonzero(counts[0][0] + counts[1][0])
        return some, *[x[some] for pair in zip(*counts, strict=True) for x in pair]

    both = dealt(a, keys, side, pad).withColumn("_second", F.lit(False)).unionByName(dealt(b, keys, side, pad).withColumn("_second", F.lit(True)))
    out = by_blocks(both, keys, run, [StructField(n, LongType()) for n in names], pad, more=("_second",))
    return out.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def worn(cells: DataFrame, keys: list[str], radius: int, height: int, width: int, first: int = 0, side: int = SIDE) -> DataFrame:
    """``(keys, r, c)``: cells of the raster whose whole disk is set, after growing by the disk of radius ``first``; outside counts as set."""
    near, wide, pad = offsets(radius), offsets(first), radius + first
    if side < pad:
        return worn(cells, keys, radius, height, width, first, pad)

    def run(r, c, starts, br, bc):
        v = Canvas(r, c, starts, pad)
        m = np.zeros(v.size, bool)
        for y, x in wide:
            m[v.at + y * v.w + x] = True
        at = np.flatnonzero(m)
        g, r, c = v.cells(at)
        within = lambda r, c: (r >= 0) & (r < height) & (c >= 0) & (c < width)
        own = (r // side == br[g]) & (c // side == bc[g]) & within(r, c)
        at, g, r, c = at[own], g[own], r[own], c[own]
        ok = np.ones(len(at), bool)
        for y, x in near:
            ok &= m[at + y * v.wide[g] + x] | ~within(r + y, c + x)
        return g[ok], r[ok], c[ok]

    return by_blocks(dealt(cells, keys, side, pad), keys, run, AT, pad)


def _labels(at: np.ndarray, w: np.ndarray, size: int, conn: int) -> np.ndarray:
    """For the set places of an array, ascending: the number of the first run of each one's component. Rows must have a clear place between them."""
    run = np.cumsum(np.r_[True, np.diff(at) > 1][: len(at)]) - 1
    of = np.full(size, -1, np.int32)
    of[at] = run
    ends = []
    for x in (-1, 0, 1) if conn == 8 else (0,):
        above = of[at - w + x]
        hit = above >= 0
        ends.append((run[hit], above[hit]))
    n = int(run[-1]) + 1 if len(run) else 0
    return least_members(n, np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends]))[run]


PARTS = [*AT, StructField("lr", LongType()), StructField("lc", LongType()), StructField("n", LongType()), StructField("open", BooleanType()), StructField("own", BooleanType())]


def _told(v: Canvas, at: np.ndarray, w: np.ndarray, br, bc, conn: int, side: int):
    """Of components in blocks: each cell with its component's first own cell, its number of own cells, and whether it leaves the block."""
    label = _labels(at, w, v.size, conn)
    g, r, c = v.cells(at)
    own = (r // side == br[g]) & (c // side == bc[g])
    n = int(label.max()) + 1 if len(label) else 0
    count = np.bincount(label[own], minlength=n)
    leaves = np.bincount(label[~own], minlength=n) > 0
    first = np.full(n, len(at))
    np.minimum.at(first, label[own], np.flatnonzero(own))
    i = first[label].clip(max=max(len(at) - 1, 0))
    kept = count[label] > 0
    return g, r, c, r[i], c[i], count[label], leaves[label], own, kept


def set_parts(cells: DataFrame, keys: list[str], conn: int, side: int = SIDE) -> DataFrame:
    """``(keys, PARTS)``: the components of set cells inside each block; of those that leave it (``open``) with the cells of others' that they touch."""

    def run(r, c, starts, br, bc):
        v = Canvas(r, c, starts, 1)
        fresh = np.r_[True, v.at[1:] != v.at[:-1]]
        *out, own, kept = _told(v, v.at[fresh], v.w[fresh], br, bc, conn, side)
        kept &= own | out[-1]
        return [x[kept] for x in (*out, own)]

    return by_blocks(dealt(cells, keys, side, 1), keys, run, PARTS, 1)


def clear_parts(cells: DataFrame, keys: list[str], most: int, height: int, width: int, side: int = SIDE) -> DataFrame:
    """The set cells (without ``n``), and as ``set_parts`` the 4-connected components of clear cells of the raster, those that stay inside a block only below ``most`` cells."""
    count = lambda n: -(-n // side)
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(count(n) - 1).cast("long"))
    none = F.lit(None).cast("long")
    if count(height) * count(width) == 1:
        inside = (F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)
        row = lambda br, bc, r, c: F.struct(br.cast("long").alias("_br"), bc.cast("long").alias("_bc"), r.cast("long").alias("r"), c.cast("long").alias("c"))
        zero, r, c = F.lit(0), F.col("r"), F.col("c")
        at = cells.select(*keys, F.inline(F.when(inside, F.array(row(zero, zero, r, c))).otherwise(F.array(row(F.floor(r / side), F.floor(c / side), r, c), row(zero, zero, none, none)))))
    else:
        blocks = cells.select(*keys).distinct().select(*keys, F.explode(numbers(height)).alias("_br"))
        blocks = blocks.select("*", F.explode(numbers(width)).alias("_bc"))
        at = dealt(cells, keys, side, 1).unionByName(blocks.select("*", none.alias("r"), none.alias("c")))

    def run(r, c, starts, br, bc):
        fresh = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])]
        fresh[starts] = True
        lo_r, lo_c = np.clip(br * side - 1, 0, height), np.clip(bc * side - 1, 0, width)
        hi_r, hi_c = np.clip((br + 1) * side, -1, height - 1), np.clip((bc + 1) * side, -1, width - 1)
        off = (hi_r < lo_r) | (hi_c < lo_c)  # a block beside the raster
        v = Canvas(r, c, starts, 1, tuple(np.where(off, z, x) for z, x in ((0, lo_r), (0, lo_c), (-1, hi_r), (-1, hi_c))))
        g = v.g
        inside = (r >= lo_r[g]) & (r <= hi_r[g]) & (c >= lo_c[g]) & (c <= hi_c[g]) & ~off[g]
        m = np.zeros(v.size, bool)
        area = (hi_r - lo_r + 1) * (hi_c - lo_c + 1)
        area[off] = 0
        k = np.repeat(np.arange(len(starts)), area)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(area) - area, area)
        span = (hi_c - lo_c + 1)[k]
        places = v.base[k] + (nth // np.maximum(span, 1) + 1) * v.wide[k] + nth % np.maximum(span, 1) + 1
        m[places] = True
        m[v.at[inside]] = False
        at = np.flatnonzero(m)
        w = v.wide[np.searchsorted(v.base, at, side="right") - 1]
        *out, own, kept = _told(v, at, w, br, bc, 4, side)
        kept &= np.where(out[-1], (out[-2] < most) | ~own | _ring(out[1], out[2], side), own & (out[-2] < most))
        clear = [x[kept] for x in (*out, own)]
        given = fresh & (r != NONE) & (r // side == br[g]) & (c // side == bc[g])
        k = int(given.sum())
        none = pa.nulls(k, pa.int64())
        join = lambda a, b: pa.concat_arrays([pa.array(a), b])
        return (np.r_[clear[0], g[given]], np.r_[clear[1], r[given]], np.r_[clear[2], c[given]], join(clear[3], none), join(clear[4], none), join(clear[5], none), np.r_[clear[6], np.zeros(k, bool)], np.r_[clear[7], np.ones(k, bool)])

    return by_blocks(at, keys, run, PARTS, 1, (min(side, height) + 4) * (min(side, width) + 4))


def _ring(r: np.ndarray, c: np.ndarray, side: int) -> np.ndarray:
    return (r % side == 0) | (r % side == side - 1) | (c % side == 0) | (c % side == side - 1)
