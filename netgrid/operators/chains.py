"""Order along chains of cells of any length: runs inside blocks, ranked among each other by pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from netgrid.plans.groups import by_groups
from netgrid.plans.storage import materialise

BLOCK = 256

Cell = tuple[int, int]


def _walk(near: dict[Cell, tuple[Cell, Cell]]) -> list[tuple[list[Cell], Cell, Cell, bool]]:
    """Runs ``(path, cell before, cell after, ring)`` of cells with two neighbours; cells outside ``near`` end a run."""

    def along(before: Cell, at: Cell) -> tuple[list[Cell], Cell]:
        path = []
        while at in near:
            path.append(at)
            seen.add(at)
            a, b = near[at]
            before, at = at, (b if a == before else a)
            if at == path[0]:
                break
        return path, at

    seen: set[Cell] = set()
    out = []
    for cell in sorted(near):
        outer = [n for n in near[cell] if n not in near]
        if outer and cell not in seen:
            path, after = along(outer[0], cell)
            out.append((path, outer[0], after, False))
    for cell in sorted(near):  # what is left are rings; each is met at its least cell
        if cell not in seen:
            path, _ = along(max(near[cell]), cell)
            out.append((path, path[-1], path[1], True))
    return out


def _runs(near: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The runs of each block of ``block`` by ``block`` cells, with the place of the least cell and its two neighbours along the chain."""
    two = near.where(F.size("near") == 2)
    at = [F.col("near")[i][v].alias(f"{v}{i}") for i in (0, 1) for v in ("r", "c")]
    cells = two.select(*keys, F.floor(F.col("r") / block).alias("_br"), F.floor(F.col("c") / block).alias("_bc"), "r", "c", *at)
    names = ["ar", "ac", "br", "bc", "mr", "mc", "pr", "pc", "nr", "nc"]
    own = [StructField("path", ArrayType(LongType())), *[StructField(n, LongType()) for n in names], StructField("mi", IntegerType()), StructField("ring", BooleanType())]
    schema = StructType([*[near.schema[k] for k in keys], *own])
    types, n = [to_arrow_type(f.dataType) for f in own], len(keys)

    def walk(b: pa.RecordBatch, starts: np.ndarray, complete: np.ndarray) -> pa.RecordBatch:
        told = list(zip(*(b.column(n + 2 + i).to_pylist() for i in range(6)), strict=True))
        rows, group = [], []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(told)], strict=True):
            for path, before, after, ring in _walk({(r, c): ((p, q), (x, y)) for r, c, p, q, x, y in told[lo:hi]}):
                i = path.index(min(path))
                prev, following = (path[i - 1] if i else before), (path[i + 1] if i + 1 < len(path) else after)
                rows.append(([v for p in path for v in p], *before, *after, *path[i], *prev, *following, i, ring))
                group.append(lo)
        cols = zip(*rows, strict=True) if rows else [[]] * len(own)
        return pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(group, pa.int64())) for i in range(n)], *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=schema.names)

    return by_groups(cells, [*keys, "_br", "_bc"], [], walk, schema)


def _jumped_within(t: DataFrame, keys: list[str], most: int) -> DataFrame:
    """What ``_jumped`` gives, and ``done``, for keys of up to ``most`` darts; the rows of others as they are."""
    n = len(keys)
    schema = t.withColumn("done", F.lit(True)).schema

    def run(b: pa.RecordBatch, starts: np.ndarray, complete: np.ndarray) -> pa.RecordBatch:
        done = np.repeat(complete, np.diff(np.r_[starts, b.num_rows]))
        ids = b.column(n).to_numpy()
        order = np.argsort(ids, kind="stable")
        link = b.column(n + 1).fill_null(0).to_numpy()
        at = order[np.searchsorted(ids, link, sorter=order).clip(max=len(ids) - 1)]
        to = np.where((ids[at] == link) & b.column(n + 1).is_valid().to_numpy(zero_copy_only=False) & done, at, -1)
        dist, end = b.column(n + 2).to_numpy().copy(), np.arange(len(ids))
        by = np.lexsort([x.to_numpy() for x in reversed(b.column(n + 3).flatten())])
        least = np.empty(len(ids), np.int64)
        least[by] = np.arange(len(ids))
        for _ in range(len(ids).bit_length() + 1):
            o = np.flatnonzero(to >= 0)
            j = to[o]
            dist[o], least[o], end[o], to[o] = dist[o] + dist[j], np.minimum(least[o], least[j]), end[j], to[j]
        link = pa.array(np.where(done, ids[to], link), mask=np.where(done, to < 0, b.column(n + 1).is_null().to_numpy(zero_copy_only=False)))
        return pa.RecordBatch.from_arrays([*b.columns[: n + 1], link, pa.array(dist), b.column(n + 3).take(pa.array(by[least])), b.column(n + 4).take(pa.array(end)), pa.array(done)], names=schema.names)

    return by_groups(t, keys, [], run, schema, most, whole=False)


def _jumped(darts: DataFrame, keys: list[str], most: int = 200_000) -> DataFrame:
    """For darts ``(keys, id, link, n, m, e)``: cells from each to its chain's end (``dist``), that end, the least ``m``; ``link`` is left on rings.

    Pointer jumping: each round doubles the reach, so the rounds grow with the
    logarithm of the number of runs in a chain. It ends when no dart has a
    link, or when those that have one are as many as before and none found a
    lesser ``m``: these go in circles and have seen all of them. Keys of up to
    ``most`` darts are settled in one pass before.
    """
    held = [*keys, "id", "link", "dist", "m", "e"]
    t = darts.select(*keys, "id", "link", F.col("n").alias("dist"), "m", "e")
    t = materialise(_jumped_within(t, keys, most), "darts")
    settled, t = t.where("done").drop("done"), t.where("NOT done").drop("done")
    if t.isEmpty():
        return settled
    real = t.select(*keys, F.col("id").alias("link"), F.lit(True).alias("real"))
    t = t.join(real, [*keys, "link"], "left").withColumn("link", F.when(F.col("real"), F.col("link"))).select(*held)
    open_, seen = materialise(t, "darts"), None
    while True:
        state = tuple(open_.where("link IS NOT NULL").agg(F.count("*"), F.sum(F.xxhash64("id", "m").cast("decimal(38,0)"))).first())
        if not state[0] or state == seen:
            return settled.unionByName(open_)
        seen = state
        to = open_.select(*keys, F.col("id").alias("link"), F.col("link").alias("l2"), F.col("dist").alias("d2"), F.col("m").alias("m2"), F.col("e").alias("e2"))
        on = open_.where("link IS NOT NULL").join(to, [*keys, "link"])
        on = on.select(*keys, "id", F.col("l2").alias("link"), (F.col("dist") + F.col("d2")).alias("dist"), F.least("m", "m2").alias("m"), F.col("e2").alias("e"))
        open_ = materialise(open_.where("link IS NULL").unionByName(on), "darts")


def _cells(path: str = "path") -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(path) / 2 - 1).cast("int")), lambda i: F.struct(F.get(path, 2 * i).alias("r"), F.get(path, 2 * i + 1).alias("c")))


def _piece(k: Column, cells: Column) -> Column:
    return F.struct(k.cast("long").alias("k"), cells.alias("cells"))


def chain_pieces(near: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``(keys, line_id, k, cells)``: every chain of cells with two neighbours in pieces; ``k`` is the place of a piece's first cell.

    ``near``: one row a cell, with its neighbours (``array<struct<r, c>>``,
    sorted), as a neighbour relation that goes both ways. An open chain has the
    end cells next to it and starts at the lesser; a ring starts at its least
    cell, goes on to the lesser neighbour and returns. No piece is longer than
    the cells of a block, however long the line; an empty table gives no rows.
    """
    whole = materialise(_runs(near, keys, block), "runs").withColumns({"n": (F.size("path") / 2).cast("long"), "cells": _cells()})
    cell = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    line = lambda a, b: F.xxhash64(*keys, a["r"], a["c"], b["r"], b["c"])
    first, last, before, after = F.col("cells")[0], F.element_at("cells", -1), cell("ar", "ac"), cell("br", "bc")
    inside = whole.where("ring").select(*keys, line(first, F.col("cells")[1]).alias("line_id"), F.lit(0).cast("long").alias("k"), F.concat("cells", F.array(first)).alias("cells"))

    run = whole.where("NOT ring").withColumns({"on": line(before, first), "back": line(after, last)})
    end = lambda o, c: F.struct(o.alias("outer"), c.alias("inner"))
    least = lambda r, c: F.struct(F.col("mr"), F.col("mc"), F.col(r).alias("r"), F.col(c).alias("c"))
    dart = lambda i, link, m, e: F.struct(F.col(i).alias("id"), link.alias("link"), F.col("n").alias("n"), m.alias("m"), e.alias("e"))
    darts = run.select(*keys, F.inline(F.array(dart("on", line(last, after), least("nr", "nc"), end(after, last)), dart("back", line(first, before), least("pr", "pc"), end(before, first)))))
    darts = materialise(darts, "darts")
    t = _jumped(darts, keys)

    def told(name: str) -> DataFrame:
        return t.select(*keys, F.col("id").alias(name), F.struct("link", "dist", "m", "e").alias(f"{name}_t"))

    both = materialise(run.join(told("on"), [*keys, "on"]).join(told("back"), [*keys, "back"]), "runs")

    # open chains: the lesser end is the start; what lies behind a run, seen from the other way, lies before it
    flip = F.col("on_t.e") < F.col("back_t.e")
    start, stop = F.least("on_t.e", "back_t.e"), F.greatest("on_t.e", "back_t.e")
    offset = F.when(flip, F.col("on_t.dist")).otherwise(F.col("back_t.dist")) - F.col("n")
    total = F.col("on_t.dist") + F.col("back_t.dist") - F.col("n")
    way = both.where("on_t.link IS NULL").select(*keys, start.alias("start"), stop.alias("stop"), offset.alias("offset"), total.alias("total"), "n", F.when(flip, F.reverse("cells")).otherwise(F.col("cells")).alias("cells"))
    head, tail = F.when(F.col("offset") == 0, F.array("start.outer")), F.when(F.col("offset") + F.col("n") == F.col("total"), F.array("stop.outer"))
    none = F.array().cast(ArrayType(StructType([StructField("r", LongType()), StructField("c", LongType())])))
    straight = way.select(
        *keys, line(F.col("start.outer"), F.col("start.inner")).alias("line_id"), F.when(F.col("offset") == 0, F.lit(0)).otherwise(F.col("offset") + 1).cast("long").alias("k"),
        F.concat(F.coalesce(head, none), "cells", F.coalesce(tail, none)).alias("cells"),
    )

    # rings over several blocks: of the two ways the one with the lesser second cell; cut before the run of the least cell
    ahead = F.col("on_t.m") < F.col("back_t.m")
    m = F.least("on_t.m", "back_t.m")
    ring = both.where("on_t.link IS NOT NULL").select(
        *keys, m.alias("m"), "n", F.when(ahead, F.col("on")).otherwise(F.col("back")).alias("id"),
        F.when(ahead, F.col("cells")).otherwise(F.reverse("cells")).alias("cells"),
        F.when(ahead, F.col("mi")).otherwise(F.col("n") - 1 - F.col("mi")).cast("int").alias("mi"),
        (F.when(ahead, least("nr", "nc")).otherwise(least("pr", "pc")) == m).alias("first"),
    )
    ring = ring.join(darts.select(*keys, "id", "link", "e"), [*keys, "id"])
    cut = ring.where("first").select(*keys, F.col("id").alias("link"), F.lit(True).alias("cut"))
    ring = materialise(ring.join(cut, [*keys, "link"], "left").withColumn("link", F.when(F.col("cut").isNull(), F.col("link"))).drop("cut"), "rings")
    dist = _jumped(ring.select(*keys, "id", "link", "n", "m", "e"), keys).select(*keys, "id", "dist")
    ring = ring.join(dist, [*keys, "id"])
    length = ring.where("first").select(*keys, "m", F.col("dist").alias("total"), F.col("mi").alias("shift"))
    ring = ring.join(length, [*keys, "m"])
    at = F.col("total") - F.col("dist") - F.col("shift")
    own = F.array(
        _piece(F.lit(0), F.slice("cells", F.col("mi") + 1, F.size("cells"))), _piece(F.col("total") - F.col("mi"), F.slice("cells", F.lit(1), F.col("mi"))),
        _piece(F.col("total"), F.slice("cells", F.col("mi") + 1, F.lit(1))),
    )
    ring = ring.select(*keys, F.xxhash64(*keys, "m.mr", "m.mc", "m.r", "m.c").alias("line_id"), F.inline(F.when(F.col("first"), own).otherwise(F.array(_piece(at, F.col("cells"))))))
    return inside.unionByName(straight).unionByName(ring.where("size(cells) > 0"))
