"""Operators on sparse cells ``(keys, r, c[, v])``; a cell without a row is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgrid.operators.blocks import SIDE, as_given, clear_parts, grown, offsets, set_parts, worn
from netgrid.operators.evaluate import ratio
from netgrid.plans.components import connected_components
from netgrid.plans.storage import materialise

COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def threshold(cells: DataFrame, t: float, op: str = ">=", value: str = "conf") -> DataFrame:
    """Set cells; callers differ in > and >=."""
    return cells.where(COMPARE[op](F.col(value), F.lit(float(t))))


def erode(cells: DataFrame, keys: list[str], radius: int, height: int, width: int) -> DataFrame:
    """Cells whose whole disk is set; outside the raster counts as set."""
    return as_given(worn(cells, keys, radius, height, width), cells, keys)


def close(cells: DataFrame, keys: list[str], radius: int, height: int, width: int) -> DataFrame:
    """Dilation, then erosion, by a disk; radius 0 changes nothing."""
    if radius <= 0:
        return cells.select(*keys, "r", "c").distinct()
    return as_given(worn(cells, keys, radius, height, width, radius), cells, keys)


def _whole(parts: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """``(keys, r, c, label, n)``: the blocks' own cells, ``label`` and ``n`` being those of the whole component; parts are joined through the cells that two blocks see."""
    parts = materialise(parts, "parts").withColumn("label", F.xxhash64(*keys, "lr", "lc"))
    names = [*keys, "r", "c", "label", "n"]
    own, open_ = parts.where("own AND NOT open").select(*names), parts.where("open")
    if open_.isEmpty():
        return own
    edge = F.expr(f"NOT own OR r % {side} IN (0, {side - 1}) OR c % {side} IN (0, {side - 1})")
    met = open_.where(edge).groupBy(*keys, "r", "c").agg(F.collect_set("label").alias("s")).where(F.size("s") > 1)  # four at most
    joined = connected_components(met.select(*keys, F.array_min("s").alias("u"), F.explode("s").alias("v")), keys=keys).withColumnRenamed("node", "label")
    each = open_.select(*keys, "label", "n").distinct().join(joined, "label", "left").withColumn("component", F.coalesce("component", "label"))
    each = materialise(each, "parts")
    total = each.groupBy(*keys, "component").agg(F.sum("n").alias("n"))
    of = each.drop("n").join(total, [*keys, "component"])
    rest = open_.where("own").drop("n").join(of, [*keys, "label"]).drop("label").withColumnRenamed("component", "label")
    return own.unionByName(rest.select(*names))


def label_components(cells: DataFrame, keys: list[str], conn: int = 8) -> DataFrame:
    """``label`` of each set cell's connected component: a hash of one of its cells.

    Components are found inside blocks; only those that reach over a border are joined.
    """
    return as_given(_whole(set_parts(cells, keys, conn), keys), cells, keys, ("label",))


def drop_small(cells: DataFrame, keys: list[str], min_px: int) -> DataFrame:
    """Only 8-connected components of at least ``min_px`` cells."""
    return as_given(_whole(set_parts(cells, keys, 8), keys).where(F.col("n") >= min_px), cells, keys)


def fill_holes(cells: DataFrame, keys: list[str], min_px: int, height: int, width: int) -> DataFrame:
    """Clear 4-connected components of fewer than ``min_px`` cells become set; 0 is off."""
    if min_px <= 0:
        return cells.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct()
    whole = _whole(clear_parts(cells, keys, min_px, height, width), keys)
    return whole.where(F.col("n").isNull() | (F.col("n") < min_px)).select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))


def clean_mask(cells: DataFrame, keys: list[str], height: int, width: int, radius: int = 2, holes: int = 200, small: int = 400) -> DataFrame:
    """Close, fill small holes, drop small components, in that order."""
    return drop_small(fill_holes(close(cells, keys, radius, height, width), keys, holes, height, width), keys, small)


def distance_within(cells: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Least squared distance to a set cell, for the cells within ``radius`` of one."""
    return as_given(grown(cells, keys, offsets(radius)), cells, keys, (F.col("d2").cast("int").alias("d2"),))


def rasterize_lines(segments: DataFrame, keys: list[str], size: float) -> DataFrame:
    """All cells that straight segments touch."""
    return touched_cells(segments, keys, size).distinct()


def touched_cells(segments: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Cells that straight segments touch, some repeated: the crossings of grid lines cut a segment into pieces, each inside one cell."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def cuts(a: Column, b: Column, d: Column) -> Column:
        lo, hi = F.ceil(F.least(a, b) / size).cast("int"), F.floor(F.greatest(a, b) / size).cast("int")
        return F.when((d != 0) & (hi >= lo), F.transform(F.sequence(lo, hi), lambda i: (i * size - a) / d + 0.0)).otherwise(F.array().cast("array<double>"))

    t = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts(F.col("x0"), F.col("x1"), dx), cuts(F.col("y0"), F.col("y1"), dy))))
    t = F.filter(t, lambda x: (x >= 0) & (x <= 1))
    mid = segments.withColumn("t", t).select(*keys, "x0", "y0", dx.alias("dx"), dy.alias("dy"), F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: (F.element_at("t", i) + F.element_at("t", i + 1)) / 2)).alias("m"))
    return mid.select(*keys, F.floor((F.col("y0") + F.col("m") * F.col("dy")) / size).alias("r"), F.floor((F.col("x0") + F.col("m") * F.col("dx")) / size).alias("c"))


def run_width(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent length of horizontal and vertical runs; the least on ties."""
    at = cells.select(*keys, "r", "c").distinct()

    def runs(row: str, col: str) -> DataFrame:
        g = at.withColumn("g", F.col(col) - F.row_number().over(Window.partitionBy(*keys, row).orderBy(col)))
        return g.groupBy(*keys, row, "g").agg(F.count("*").alias("length")).select(*keys, "length")

    n = runs("r", "c").unionByName(runs("c", "r")).groupBy(*keys, "length").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("width"))


def max_instance(claims: DataFrame, keys: list[str], top_k: int | None = None) -> DataFrame:
    """Greatest score per cell over the instances, of the ``top_k`` best ones if given; and how many instances were used."""
    if top_k is not None:
        inst = claims.select(*keys, "instance", "score").distinct()
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "instance")
        best = inst.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_k)
        claims = claims.join(best.select(*keys, "instance"), [*keys, "instance"], "left_semi")
    used = claims.groupBy(*keys).agg(F.count_distinct("instance").alias("n_instances"))
    return claims.groupBy(*keys, "r", "c").agg(F.max("score").alias("v")).join(used, keys)


def coverage(cells: DataFrame, keys: list[str], total: int, value: str = "v") -> DataFrame:
    """Share of all cells above 0."""
    return cells.groupBy(*keys).agg((F.count(F.when(F.col(value) > 0, 1)) / F.lit(total)).alias("coverage"))


def resample(cells: DataFrame, keys: list[str], k: int, value: str = "v") -> DataFrame:
    """Means of k by k blocks, cells without a row counting as 0."""
    at = [F.floor(F.col(x) / k).alias(x) for x in ("r", "c")]
    return cells.groupBy(*keys, *at).agg((F.sum(value) / F.lit(k * k)).alias(value))


def cell_iou(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection over union of two masks; two empty ones have no row (1.0 by definition)."""
    at = [*keys, "r", "c"]
    both = a.select(*at).distinct().unionByName(b.select(*at).distinct()).groupBy(*at).agg(F.count("*").alias("n"))
    return both.groupBy(*keys).agg(ratio(F.count(F.when(F.col("n") == 2, 1)), F.count("*")).alias("iou"))
