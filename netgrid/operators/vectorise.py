"""From masks to centrelines: thinning, tracing, vectorising, and scores of networks against truth."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from netgrid.operators.blocks import AT, Canvas, by_blocks, dealt, met, offsets
from netgrid.operators.cells import clean_mask, rasterize_lines, touched_cells
from netgrid.operators.chains import BLOCK, chain_pieces
from netgrid.operators.evaluate import ratio
from netgrid.operators.lines import explode_segments, line_length, sample_along
from netgrid.operators.network import simplify
from netgrid.plans.storage import materialise

_NEAR = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x]


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """Whether a cell goes in each half of a round, by its eight neighbours as bits, clockwise from above."""
    p = (np.arange(256)[:, None] >> np.arange(8)) & 1
    n, turns = p.sum(axis=1), ((p == 0) & (np.roll(p, -1, axis=1) == 1)).sum(axis=1)
    up, right, down, left = p[:, 0], p[:, 2], p[:, 4], p[:, 6]
    edge = (n >= 2) & (n <= 6) & (turns == 1)
    return edge & (up * right * down == 0) & (right * down * left == 0), edge & (up * right * left == 0) & (up * down * left == 0)


_RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
_RULES = _rules()


def _thinned(at: np.ndarray, w: np.ndarray, size: int, rounds: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``rounds`` rounds (None: all) of Zhang and Suen's parallel thinning (1984) of the set places ``at`` of an array, in rows of length ``w``: what stays, and what the last round took."""
    m = np.zeros(size, np.uint8)
    m[at] = 1
    last = at[:0]
    for _ in count() if rounds is None else range(rounds):
        gone = []
        for rule in _RULES:
            code = np.zeros(len(at), np.uint8)
            for i, (y, x) in enumerate(_RING):
                code |= m[at + y * w + x] << i
            drop = rule[code]
            gone.append(at[drop])
            m[at[drop]] = 0
            at, w = at[~drop], w[~drop]
        last = np.concatenate(gone)
        if not len(last):
            break
    return at, last


def thin(cells: DataFrame, keys: list[str], side: int = 256, rounds: int = 8) -> DataFrame:
    """The one-cell-wide skeleton of set cells.

    Blocks of ``side`` cells with a border of two cells a round are thinned
    ``rounds`` rounds at a time, which is what the whole raster would give. A
    change moves on by two cells a round, so only blocks next to one that its
    last round changed are dealt again; it ends when no block has changed in
    the last round. A block without cells in its border is thinned to the end
    at once, as nothing comes near it later. A block's rows are bounded by its area.
    """
    halo = 2 * rounds
    if halo > side:
        raise ValueError("a block must be as wide as its border")
    fields = [*AT, *[StructField(n, LongType()) for n in ("_br", "_bc")], StructField("changed", BooleanType())]

    def run(r, c, starts, br, bc):
        v = Canvas(r, c, starts, 1)
        fresh = np.r_[True, v.at[1:] != v.at[:-1]]
        left, last = _thinned(v.at[fresh], v.w[fresh], v.size, rounds)
        alone = np.bincount(v.g[(r // side != br[v.g]) | (c // side != bc[v.g])], minlength=len(starts)) == 0
        changed = np.zeros(len(starts), bool)
        changed[v.cells(last)[0]] = True
        more = (alone & changed)[v.cells(left)[0]]
        if more.any():
            at = left[more]
            left = np.concatenate([left[~more], _thinned(at, v.wide[v.cells(at)[0]], v.size, None)[0]])

        def own(at):
            g, y, x = v.cells(at)
            k = (y // side == br[g]) & (x // side == bc[g])
            return g[k], y[k], x[k]

        g, y, x = own(left)
        changed = np.zeros(len(starts), bool)
        changed[own(last)[0]] = True
        changed &= ~alone
        empty = changed.copy()
        empty[g] = False
        lost = np.flatnonzero(empty)  # a block that vanished still tells of its change
        none = pa.nulls(len(lost), pa.int64())
        g = np.r_[g, lost]
        return g, pa.concat_arrays([pa.array(y), none]), pa.concat_arrays([pa.array(x), none]), br[g], bc[g], changed[g]

    near = F.array(*[F.struct(F.lit(y).alias("_y"), F.lit(x).alias("_x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    hot, at = None, cells
    while True:
        blocks = dealt(at, keys, side, halo)
        if hot is not None:
            blocks = blocks.join(hot, [*keys, "_br", "_bc"], "left_semi")
            own = dealt(at, keys, side, 0).select(*keys, "r", "c", "_br", "_bc")
            rest = own.join(hot, [*keys, "_br", "_bc"], "left_anti").withColumn("changed", F.lit(False))
        out = by_blocks(blocks, keys, run, fields, 1)
        out = materialise(out if hot is None else out.unionByName(rest), "cells")
        at = out.where("r IS NOT NULL").select(*keys, "r", "c")
        changed = out.where("changed").select(*keys, "_br", "_bc").distinct()
        if changed.isEmpty():
            return at
        spread = changed.select(*keys, "_br", "_bc", F.inline(near)).select(*keys, (F.col("_br") + F.col("_y")).alias("_br"), (F.col("_bc") + F.col("_x")).alias("_bc"))
        hot = materialise(spread.distinct(), "blocks")


def _neighbours(cells: DataFrame, keys: list[str], side: int = 256) -> DataFrame:
    """``(keys, r, c, near)``: every cell with its set neighbours of eight, sorted, looked up inside blocks."""
    point = StructType([StructField("r", LongType()), StructField("c", LongType())])
    dy, dx = np.array(_NEAR).T

    def run(r, c, starts, br, bc):
        v = Canvas(r, c, starts, 1)
        m = np.zeros(v.size, bool)
        m[v.at] = True
        at = np.flatnonzero(m)
        g, y, x = v.cells(at)
        own = (y // side == br[g]) & (x // side == bc[g])
        at, g, y, x = at[own], g[own], y[own], x[own]
        hit = m[at[:, None] + dy * v.wide[g][:, None] + dx]
        i, k = np.nonzero(hit)
        ends = pa.array(np.r_[0, np.cumsum(hit.sum(axis=1))], pa.int32())
        return g, y, x, pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(y[i] + dy[k]), pa.array(x[i] + dx[k])], names=["r", "c"]))

    return by_blocks(dealt(cells, keys, side, 1), keys, run, [*AT, StructField("near", ArrayType(point))], 1)


def trace_pieces(skeleton: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``(keys, line_id, k, cells)``: the lines of ``trace`` in pieces that no line's length makes longer than a block's cells.

    ``k`` is the place of a piece's first cell in its line.
    """
    px = materialise(_neighbours(skeleton, keys), "pixels")
    node = px.where(F.size("near") != 2)
    edge = node.select(*keys, "r", "c", F.inline("near").alias("nr", "nc")).where("r < nr or r = nr and c < nc")
    edge = edge.join(node.select(*keys, F.col("r").alias("nr"), F.col("c").alias("nc")), [*keys, "nr", "nc"])
    cells = F.array(F.struct("r", "c"), F.struct(F.col("nr").alias("r"), F.col("nc").alias("c")))
    direct = edge.select(*keys, F.xxhash64(*keys, "r", "c", "nr", "nc").alias("line_id"), F.lit(0).cast("long").alias("k"), cells.alias("cells"))
    return chain_pieces(px, keys, block).unionByName(direct)


def trace_vertices(skeleton: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``(keys, line_id, k, r, c)``: one row a vertex, ``k`` its place in the line from 0; for lines too long for one row."""
    piece = trace_pieces(skeleton, keys, block).select(*keys, "line_id", F.col("k").alias("k0"), F.posexplode("cells").alias("i", "p"))
    return piece.select(*keys, "line_id", (F.col("k0") + F.col("i")).alias("k"), "p.r", "p.c")


def trace(skeleton: DataFrame, keys: list[str], size: float = 1.0, block: int = BLOCK) -> DataFrame:
    """``(keys, line_id, coords)``: the skeleton as lines through cell centres, split where a cell has not two neighbours.

    Chains are walked inside blocks; the runs found there are ranked along
    their chains (``operators/chains.py``). A line starts at its lesser end.
    Neighbouring nodes make a line of two vertices, a ring is one closed line.
    """
    lines = trace_pieces(skeleton, keys, block).groupBy(*keys, "line_id").agg(F.array_sort(F.collect_list(F.struct("k", "cells"))).alias("p"))
    centre = lambda p: F.struct(((p["c"] + 0.5) * size).alias("x"), ((p["r"] + 0.5) * size).alias("y"))
    return lines.select(*keys, "line_id", F.transform(F.flatten("p.cells"), centre).alias("coords"))


def centrelines(
    mask: DataFrame, keys: list[str], height: int, width: int, size: float = 1.0, radius: int = 2, holes: int = 200, small: int = 400, tolerance: float = 2.0, min_length: float = 25.0,
    skeleton: DataFrame | None = None,
) -> DataFrame:
    """``(keys, line_id, coords, length_m)``: the lines of a mask, cleaned, thinned (or ``skeleton``, if that is known), traced, simplified, short ones dropped."""
    if skeleton is None:
        skeleton = thin(clean_mask(mask, keys, height, width, radius, holes, small), keys)
    line = simplify(trace(skeleton, keys, size), tolerance).withColumn("length_m", line_length(F.col("coords")))
    return materialise(line.where(F.col("length_m") >= min_length), "lines")


def vectorize(
    mask: DataFrame, conf: DataFrame, keys: list[str], height: int, width: int, size: float = 1.0, radius: int = 2, holes: int = 200, small: int = 400,
    tolerance: float = 2.0, min_length: float = 25.0, value: str = "conf", skeleton: DataFrame | None = None,
) -> DataFrame:
    """The centrelines of a mask, with length and mean confidence."""
    line = centrelines(mask, keys, height, width, size, radius, holes, small, tolerance, min_length, skeleton)
    c = sample_along(line, conf, keys, size, height, width, value)
    out = line.join(c, [*keys, "line_id"])
    return out.withColumns({"length_m": F.round("length_m", 2), "confidence": F.round("confidence", 4), "confidence_pct": F.round(F.col("confidence") * 100, 1)})


def vectorize_stats(mask: DataFrame, skeleton: DataFrame, lines: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Sizes of the steps for every raster that has a set cell; lines without confidence count as certain."""
    m = mask.select(*keys, "r", "c").distinct().groupBy(*keys).agg(F.count("*").alias("mask_px"))
    s = skeleton.groupBy(*keys).agg(F.count("*").alias("skeleton_px"))
    n = lines.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.round(F.sum("length_m"), 1).alias("total_length_m"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.count(F.when(F.col("confidence") < 0.5, 1)).alias("n_low_confidence"),
    )
    out = m.join(s, keys, "left").join(n, keys, "left").withColumn("mask_fraction", F.round(F.col("mask_px") / (height * width), 6))
    return out.na.fill(0, ["skeleton_px", "n_lines", "n_low_confidence"]).na.fill(0.0, ["total_length_m"])


def score_network(segments: DataFrame, skeleton: DataFrame, keys: list[str], size: float, height: int, width: int, tolerance: float = 5.0) -> DataFrame:
    """Completeness, correctness and quality of a network against a truth skeleton, within ``tolerance``.

    Networks or truths without the other have zeros.
    """
    at = [*keys, "r", "c"]
    inside = (F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)
    net = rasterize_lines(segments, keys, size).where(inside)
    truth = skeleton.select(*at).distinct()

    both = met(net, truth, keys, {"near": offsets(tolerance / size)})
    both = both.select(*keys, F.col("n1").alias("truth_px"), F.col("near1").alias("matched_truth"), F.col("n0").alias("network_px"), F.col("near0").alias("matched"))
    all_ = F.col("truth_px") + F.col("network_px") - F.col("matched")
    scores = {"completeness": ratio(F.col("matched_truth"), F.col("truth_px")), "correctness": ratio(F.col("matched"), F.col("network_px")), "quality": ratio(F.col("matched_truth"), all_)}
    return both.select(*keys, *[F.round(v, 4).alias(k) for k, v in scores.items()], "truth_px", "network_px")


def edit_gain(segments: DataFrame, skeleton: DataFrame, keys: list[str], size: float, height: int, width: int, tolerance: float = 5.0) -> DataFrame:
    """What the edits were worth: the whole network's scores less those of its lines of ``source`` model (null: model)."""
    parts = F.when(F.coalesce("source", F.lit("model")) == "model", F.array(F.lit("all"), F.lit("model"))).otherwise(F.array(F.lit("all")))
    two = F.explode(F.array(F.lit("all"), F.lit("model"))).alias("part")
    s = score_network(segments.select("*", F.explode(parts).alias("part")), skeleton.select("*", two), [*keys, "part"], size, height, width, tolerance)
    names = ("completeness", "correctness", "quality")
    of = lambda part, name: F.max(F.when(F.col("part") == part, F.col(name)))
    both = s.groupBy(*keys).agg(*[of(p, n).alias(f"{p}_{n}") for p in ("all", "model") for n in names]).na.fill(0.0)
    return both.select(*keys, *[F.round(F.col(f"all_{n}") - F.col(f"model_{n}"), 4).alias(f"gain_{n}") for n in names])


def axis_order_check(segments: DataFrame, raster: DataFrame, keys: list[str], size: float, height: int, width: int) -> DataFrame:
    """IoU of the lines drawn in (row, column) and in (x, y) order with a shipped raster; the right order must win."""
    inside = (F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)
    right = touched_cells(segments, keys, size)
    right = right.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(r).alias("r"), F.col(c).alias("c")) for k, r, c in ((0, "r", "c"), (1, "c", "r"))])))
    every = right.where(inside).unionByName(raster.select(*keys, F.lit(2).alias("k"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")))
    # the columns of a row are bits of words of 64, so a task holds few groups
    bit = F.expr("shiftleft(1L, CAST(pmod(c, 64) AS INT))")
    word = every.groupBy(*keys, "r", F.floor(F.col("c") / 64).alias("w")).agg(*[F.bit_or(F.when(F.col("k") == k, bit).otherwise(F.lit(0).cast("long"))).alias(x) for k, x in enumerate("abs")])
    n = lambda v: F.sum(F.bit_count(v).cast("long"))
    iou = lambda x: ratio(n(F.col(x).bitwiseAND(F.col("s"))), n(F.col(x).bitwiseOR(F.col("s"))))
    out = word.groupBy(*keys).agg(F.round(iou("a"), 6).alias("iou"), F.round(iou("b"), 6).alias("iou_swapped"))
    return out.withColumn("right_order", F.col("iou") > F.col("iou_swapped"))


def segments_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The straight pieces of traced lines, as ``(keys, line_id, seg_no, x0, y0, x1, y1)``."""
    return explode_segments(lines.select(*keys, "line_id", "coords"), [*keys, "line_id"])
