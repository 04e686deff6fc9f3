"""Tiles on a grid, contiguous blocks of them, overlapping chips and their stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgrid.plans.components import connected_components
from netgrid.plans.order import ranked

# fixed values: the grid's origin and pitch, in metres
ORIGIN_E, ORIGIN_N, PITCH, TILE, KEYS = -713.563825994729996, 771.024778023362160, 100, 1500.0, 15


def decode_tile(df: DataFrame, name: str = "name") -> DataFrame:
    """``key_e, key_n, ok`` from eight digits before an underscore; other names are not ok."""
    digits = F.regexp_extract(name, r"^([0-9]{8})_", 1)
    ok = digits != ""
    return df.withColumns(
        {"key_e": F.when(ok, digits.substr(1, 4).cast("int")), "key_n": F.when(ok, digits.substr(5, 4).cast("int")), "ok": F.coalesce(ok, F.lit(False))}
    )


def tile_bounds(df: DataFrame) -> DataFrame:
    """The bounds of a tile, whose key names its top left corner."""
    x, y = F.col("key_e") * PITCH + ORIGIN_E, F.col("key_n") * PITCH + ORIGIN_N
    return df.withColumns({"minx": x, "miny": y - TILE, "maxx": x + TILE, "maxy": y})


def tile_neighbours(tiles: DataFrame) -> DataFrame:
    """``(tile_id, side, neighbour_id)`` for existing neighbours to the east, west, north and south."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(e).alias("de"), F.lit(n).alias("dn")) for s, e, n in (("E", KEYS, 0), ("W", -KEYS, 0), ("N", 0, KEYS), ("S", 0, -KEYS))])
    want = tiles.select("tile_id", "key_e", "key_n", F.inline(sides)).select(
        "tile_id", "side", (F.col("key_e") + F.col("de")).alias("key_e"), (F.col("key_n") + F.col("dn")).alias("key_n")
    )
    return want.join(tiles.select("key_e", "key_n", F.col("tile_id").alias("neighbour_id")), ["key_e", "key_n"]).select("tile_id", "side", "neighbour_id")


def block_members(tiles: DataFrame, rows: int, cols: int, exclude: DataFrame | None = None) -> DataFrame:
    """``(anchor_e, anchor_n, dr, dc, tile_id)`` of every anchor whose whole block of tiles exists."""
    if exclude is not None:
        tiles = tiles.join(exclude.select("tile_id"), "tile_id", "left_anti")
    spots = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(rows) for c in range(cols)])
    # a tile serves the anchors that lie west and north of it
    part = tiles.select("*", F.inline(spots)).withColumns(
        {"anchor_e": F.col("key_e") - KEYS * F.col("dc"), "anchor_n": F.col("key_n") + KEYS * F.col("dr")}
    )
    whole = part.groupBy("anchor_e", "anchor_n").agg(F.count("*").alias("n")).where(F.col("n") == rows * cols)
    return part.join(whole.select("anchor_e", "anchor_n"), ["anchor_e", "anchor_n"], "left_semi")


def contiguous_blocks(tiles: DataFrame, rows: int, cols: int, exclude: DataFrame | None = None) -> DataFrame:
    """Whole blocks with their rank in scan order (north first, then west) and tiles in raster order."""
    members = block_members(tiles, rows, cols, exclude)
    blocks = members.groupBy("anchor_e", "anchor_n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dr", "dc", "tile_id"))), lambda x: x["tile_id"]).alias("tiles")
    )
    return ranked(blocks, [F.desc("anchor_n"), F.col("anchor_e")]).withColumn("rank", (F.col("rank") + 1).cast("int"))


def largest_connected_group(tiles: DataFrame) -> DataFrame:
    """The tiles of the largest group of side-by-side tiles, in order; equal sizes: the group of the least tile."""
    pairs = tile_neighbours(tiles).select(F.col("tile_id").alias("u"), F.col("neighbour_id").alias("v"))
    parts = tiles.join(connected_components(pairs).withColumnRenamed("node", "tile_id"), "tile_id", "left").withColumn("component", F.coalesce("component", "tile_id"))
    top = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    ordered = parts.join(F.broadcast(top), "component")  # one row
    pos = ranked(ordered.select("tile_id", "key_e", "key_n", "n"), [F.desc("key_n"), F.col("key_e")], "pos")
    return pos.withColumn("pos", (F.col("pos") + 1).cast("int"))


def tile_quality(cells: DataFrame, key: str, label: Column, least_band: Column, factor: int = 1, most_band: Column | None = None) -> DataFrame:
    """Shares of road (label > 127) and blank (least band >= 248) cells, after averaging ``factor`` by ``factor`` cells.

    With ``most_band`` black cells (greatest band <= 5) are blank too.
    """
    most = F.lit(255.0) if most_band is None else most_band
    c = cells.select(key, "r", "c", label.alias("label"), least_band.alias("band"), most.alias("most"))
    if factor > 1:
        at = [F.floor(F.col(x) / factor).alias(x) for x in ("r", "c")]
        c = c.groupBy(key, *at).agg(F.avg("label").alias("label"), F.avg("band").alias("band"), F.avg("most").alias("most"))
    share = lambda x: F.avg(F.when(x, 1.0).otherwise(0.0))
    return c.groupBy(key).agg(share(F.col("label") > 127).alias("road_fraction"), share((F.col("band") >= 248) | (F.col("most") <= 5)).alias("blank_fraction"))


def _first_blocks(tiles: DataFrame, size: int, limit: int) -> DataFrame:
    """The first ``limit`` blocks in scan order; only these are ranked."""
    some = block_members(tiles, size, size).groupBy("anchor_e", "anchor_n").agg(F.collect_list("tile_id").alias("tiles"))
    some = some.orderBy(F.desc("anchor_n"), "anchor_e").limit(limit)
    return some.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("anchor_n"), "anchor_e")))


def rank_blocks(tiles: DataFrame, quality: DataFrame, size: int = 2, min_road: float = 0.004, limit: int = 400) -> DataFrame:
    """The first ``limit`` blocks whose tiles are all usable and dense enough, densest first; ties in scan order."""
    anchors = _first_blocks(tiles, size, limit)
    each = anchors.select("anchor_e", "anchor_n", "rank", F.explode("tiles").alias("tile_id")).join(quality.where("error = ''"), "tile_id")
    stats = each.groupBy("anchor_e", "anchor_n", "rank").agg(
        F.count("*").alias("n"), F.avg("road_fraction").alias("mean_road"), F.max("blank_fraction").alias("max_blank")
    )
    good = stats.where((F.col("n") == size * size) & (F.col("mean_road") >= min_road))
    # at most ``limit`` rows; rounded, as means of equal tiles differ in their last digits
    place = F.row_number().over(Window.orderBy(F.desc(F.round("mean_road", 9)), "rank"))
    return good.select("anchor_e", "anchor_n", "rank", "mean_road", "max_blank", place.alias("place"))


def best_block(tiles: DataFrame, quality: DataFrame, size: int = 2, max_blank: float = 0.15, min_road: float = 0.004, limit: int = 220) -> DataFrame:
    """The densest block that is not too blank; when none is, the first one in scan order."""
    ranked = rank_blocks(tiles, quality, size, min_road, limit).where(F.col("max_blank") <= max_blank)
    first = _first_blocks(tiles, size, 1).select("anchor_e", "anchor_n", F.lit(None).cast("double").alias("mean_road"))
    both = ranked.select("anchor_e", "anchor_n", "mean_road", F.col("place").alias("o")).unionByName(first.withColumn("o", F.lit(2147483647)))
    return both.orderBy("o").limit(1).drop("o")


def first_passing_block(ranked: DataFrame, max_blank: float = 0.12, attempts: int = 5) -> DataFrame:
    """Of the first ``attempts`` ranked blocks the first whose worst tile is clear enough; no row if none is."""
    return ranked.where((F.col("place") <= attempts) & (F.col("max_blank") <= max_blank)).orderBy("place").limit(1)


def offsets(total: Column, size: Column, overlap: Column) -> Column:
    """Chip offsets along an axis: a fixed step, the last chip moved back inside; one at 0 for a small axis."""
    step = size - overlap
    n = F.greatest(F.ceil((total - size) / step).cast("int") + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.least(i * step, total - size), F.lit(0)).cast("int")))


def plan_chips(rasters: DataFrame, size: int, overlap: int) -> DataFrame:
    """Overlapping chips that cover every raster; size > 0 and 0 <= overlap < size."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap within it")
    s, o = F.lit(size), F.lit(overlap)
    out = rasters.select("*", F.posexplode(offsets(F.col("height"), s, o)).alias("row", "row_off"))
    out = out.select("*", F.posexplode(offsets(F.col("width"), s, o)).alias("col", "col_off"))
    return out.withColumns(
        {"chip_id": F.format_string("chip_%05d_%05d", "row", "col"), "w": F.least(s, F.col("width")), "h": F.least(s, F.col("height"))}
    )


def chip_bounds(chips: DataFrame) -> DataFrame:
    """Map bounds of chips from the raster's origin (top left) and pixel size."""
    x, y, px = F.col("x0"), F.col("y0"), F.col("px")
    return chips.withColumns(
        {"minx": x + F.col("col_off") * px, "maxx": x + (F.col("col_off") + F.col("w")) * px, "maxy": y - F.col("row_off") * px, "miny": y - (F.col("row_off") + F.col("h")) * px}
    )


def cells_to_chips(cells: DataFrame, chips: DataFrame, key: str, size: int) -> DataFrame:
    """Every cell with each chip that covers it: an equi-join on size-aligned blocks, then the exact test.

    A chip of at most ``size`` touches at most four blocks, so the chips are spread over blocks, not the cells.
    """
    block = lambda x: F.floor(x / size)
    spread = chips.select("*", F.explode(F.sequence(block(F.col("row_off")), block(F.col("row_off") + F.col("h") - 1))).alias("br")).select(
        "*", F.explode(F.sequence(block(F.col("col_off")), block(F.col("col_off") + F.col("w") - 1))).alias("bc")
    )
    at = cells.withColumns({"br": block(F.col("r")), "bc": block(F.col("c"))})
    inside = "r >= row_off AND r < row_off + h AND c >= col_off AND c < col_off + w"
    return at.join(spread, [key, "br", "bc"]).where(inside).drop("br", "bc")


def taper(offset: Column, n: Column, overlap: Column) -> Column:
    """Cosine ramp over the overlap at both ends of an axis of n cells; 1 inside and without overlap."""
    k = F.least(overlap, F.floor(n / 2).cast("int"))
    j = F.least(offset + 1, n - offset)
    return F.when((k > 0) & (j <= k), 0.5 * (1 - F.cos(F.pi() * j / (k + 1)))).otherwise(1.0)


def taper_weight(cells: DataFrame, overlap: int) -> DataFrame:
    """``weight`` of a cell at ``(i, j)`` of a chip of ``h`` by ``w`` cells."""
    o = F.lit(overlap)
    return cells.withColumn("weight", taper(F.col("i"), F.col("h"), o) * taper(F.col("j"), F.col("w"), o))


def stitch(chip_cells: DataFrame, keys: list[str], overlap: int, threshold: float | None = None) -> DataFrame:
    """Blend chips: weighted mean per cell, 0 where no weight falls; with a threshold also ``mask`` (>=: 255)."""
    out = taper_weight(chip_cells, overlap).groupBy(*keys, "r", "c").agg(F.sum(F.col("v") * F.col("weight")).alias("s"), F.sum("weight").alias("t"))
    out = out.select(*keys, "r", "c", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(0.0).alias("v"))
    return out if threshold is None else out.withColumn("mask", F.when(F.col("v") >= threshold, 255).otherwise(0))


def merge_tiles(cells: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles side by side in one raster; where they overlap the first tile in order wins. ``tiles``: tile_id, row_off, col_off, tile_order."""
    at = cells.join(tiles, "tile_id").withColumns({"r": F.col("r") + F.col("row_off"), "c": F.col("c") + F.col("col_off")})
    return at.groupBy(*keys, "r", "c").agg(F.min_by("v", "tile_order").alias("v"))


def chips_in_window(chips: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Chips that overlap a pixel window (touching edges do not count). ``windows``: keys, wr, wc, wh, ww."""
    hit = "col_off < wc + ww AND col_off + w > wc AND row_off < wr + wh AND row_off + h > wr"
    return chips.join(windows, keys).where(hit)


def window_from_bbox(df: DataFrame) -> DataFrame:
    """Pixel window of a map box, clamped to the raster, at least one pixel each way; fractions are cut toward zero."""
    cut = lambda x: x.cast("long")  # noqa: E731  the cast truncates
    within = lambda x, top: F.least(F.greatest(x, F.lit(0)), top)
    left = within(cut((F.col("minx") - F.col("x0")) / F.col("px")), F.col("width") - 1)
    right = within(cut((F.col("maxx") - F.col("x0")) / F.col("px")), F.col("width"))
    top = within(cut((F.col("y0") - F.col("maxy")) / F.col("px")), F.col("height") - 1)
    bottom = within(cut((F.col("y0") - F.col("miny")) / F.col("px")), F.col("height"))
    return df.withColumns({"wc": left, "wr": top, "ww": F.greatest(right - left, F.lit(1)), "wh": F.greatest(bottom - top, F.lit(1))})


def named_window(df: DataFrame, area: str = "area") -> DataFrame:
    """Windows by words: top, bottom, left, right, center or whole; null for other words."""
    words = F.split(F.lower(F.trim(F.col(area))), r"[\s_-]+")
    known = F.array(*map(F.lit, ("top", "bottom", "left", "right", "center", "whole")))
    ok = (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(known, w))
    has = lambda w: F.array_contains(words, w)
    ends = lambda low, high: (
        F.when(has(low), 0.0).when(has(high), 0.55).when(has("center"), 0.28).otherwise(0.0),
        F.when(has(low), 0.45).when(has(high), 1.0).when(has("center"), 0.72).otherwise(1.0),
    )
    (y0, y1), (x0, x1) = ends("top", "bottom"), ends("left", "right")
    px = lambda part, total: F.when(ok, F.floor(part * F.col(total)).cast("long"))
    return df.withColumns({"wr": px(y0, "height"), "wc": px(x0, "width"), "wr1": px(y1, "height"), "wc1": px(x1, "width")})


def chip_stats(cells: DataFrame, keys: list[str], grey: Column) -> DataFrame:
    """Mean, population deviation, and shares of dark (< 60) and bright (> 190) cells."""
    c = cells.select(*keys, grey.alias("g"))
    share = lambda x: F.round(F.avg(F.when(x, 1.0).otherwise(0.0)), 4)
    return c.groupBy(*keys).agg(
        F.round(F.avg("g"), 2).alias("mean"), F.round(F.stddev_pop("g"), 2).alias("std"), share(F.col("g") < 60).alias("dark"), share(F.col("g") > 190).alias("bright")
    )


def kept_windows(windows: DataFrame, cells: DataFrame, keys: list[str], crop: int, blank: Column, max_blank: float = 0.30) -> DataFrame:
    """Windows of ``tile_windows`` of which no more than ``max_blank`` is blank, with that share as ``blank``; cells without a row are not blank."""
    at = cells.where(blank).select(*keys, F.floor(F.col("r") / crop).alias("i"), F.floor(F.col("c") / crop).alias("j"))
    n = at.groupBy(*keys, "i", "j").agg(F.count("*").alias("_n"))
    out = windows.join(n, [*keys, "i", "j"], "left").withColumn("blank", F.coalesce("_n", F.lit(0)) / float(crop * crop))
    return out.where(F.col("blank") <= max_blank).drop("_n")


def tile_windows(rasters: DataFrame, crop: int) -> DataFrame:
    """Full crop windows side by side; ``kept_windows`` drops blank ones."""
    steps = lambda n: F.when(F.col(n) >= crop, F.sequence(F.lit(0), F.floor(F.col(n) / crop).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return rasters.select("*", F.explode(steps("height")).alias("i")).select("*", F.explode(steps("width")).alias("j")).withColumns(
        {"row_off": F.col("i") * crop, "col_off": F.col("j") * crop}
    )


def refresh(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
