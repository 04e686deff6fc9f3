"""Queries of the grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import grid

BLOCKS = """WITH m AS (
  SELECT t.*, dr, dc, key_e - 15 * dc AS anchor_e, key_n + 15 * dr AS anchor_n
  FROM fx_tiles t, (VALUES (0,0),(0,1),(1,0),(1,1)) s(dr, dc)),
b AS (SELECT anchor_e, anchor_n, list(tile_id ORDER BY dr, dc) AS tiles, avg(road_fraction) AS mean_road,
             max(blank_fraction) AS max_blank, sum(CASE WHEN tile_id % 13 = 0 THEN 1 ELSE 0 END) AS bad
      FROM m GROUP BY anchor_e, anchor_n HAVING count(*) = 4),
s AS (SELECT *, row_number() OVER (ORDER BY anchor_n DESC, anchor_e) AS rank FROM b),
k AS (SELECT *, row_number() OVER (ORDER BY round(mean_road, 9) DESC, rank) AS place FROM s WHERE rank <= 400 AND bad = 0 AND mean_road >= 0.004)
"""


def _quality(t):
    return t.fx_tiles.select("tile_id", "road_fraction", "blank_fraction", F.when(F.col("tile_id") % 13 == 0, "unreadable").otherwise("").alias("error"))


@query("b1_decode_tile", """SELECT p_partkey, CASE WHEN ok THEN CAST(substr(name, 1, 4) AS INTEGER) END AS key_e,
  CASE WHEN ok THEN CAST(substr(name, 5, 4) AS INTEGER) END AS key_n, ok
  FROM (SELECT *, regexp_matches(name, '^[0-9]{8}_') AS ok FROM (SELECT p_partkey,
    CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE lpad(CAST(p_partkey * 37 % 100000000 AS VARCHAR), 8, '0') || '_15' END AS name FROM part))""")
def _(t):
    name = F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.concat(F.lpad((F.col("p_partkey") * 37 % 100000000).cast("string"), 8, "0"), F.lit("_15")))
    return grid.decode_tile(t.part.select("p_partkey", name.alias("name"))).drop("name")


@query("b2_tile_bounds", """SELECT tile_id, round(key_e * 100 - 713.563825994729996, 4) AS minx, round(key_n * 100 + 771.024778023362160 - 1500.0, 4) AS miny,
  round(key_e * 100 - 713.563825994729996 + 1500.0, 4) AS maxx, round(key_n * 100 + 771.024778023362160, 4) AS maxy FROM (SELECT tile_id, CAST(key_e AS DOUBLE) AS key_e, CAST(key_n AS DOUBLE) AS key_n FROM fx_tiles)""")
def _(t):
    return grid.tile_bounds(t.fx_tiles).select("tile_id", *[F.round(c, 4).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query("b3_tile_neighbours", """SELECT a.tile_id, side, b.tile_id AS neighbour_id FROM fx_tiles a
  CROSS JOIN (VALUES ('E', 15, 0), ('W', -15, 0), ('N', 0, 15), ('S', 0, -15)) s(side, de, dn)
  JOIN fx_tiles b ON b.key_e = a.key_e + de AND b.key_n = a.key_n + dn""")
def _(t):
    return grid.tile_neighbours(t.fx_tiles)


@query("b4_contiguous_blocks", BLOCKS + "SELECT anchor_e, anchor_n, CAST(rank AS INTEGER) AS rank, array_to_string(tiles, ',') AS tiles FROM s")
def _(t):
    return grid.contiguous_blocks(t.fx_tiles, 2, 2).withColumn("tiles", F.array_join(F.transform("tiles", lambda x: x.cast("string")), ","))


@query("b5_largest_connected_group", """WITH RECURSIVE tl AS (SELECT tile_id, key_e, key_n FROM fx_tiles WHERE tile_id % 3 <> 0),
  e AS (SELECT a.tile_id AS u, b.tile_id AS v FROM tl a JOIN tl b ON (abs(a.key_e - b.key_e) = 15 AND a.key_n = b.key_n) OR (abs(a.key_n - b.key_n) = 15 AND a.key_e = b.key_e)),
  r AS (SELECT tile_id AS node, tile_id AS root FROM tl UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v),
  c AS (SELECT node, min(root) AS component FROM r GROUP BY node),
  g AS (SELECT component, count(*) AS n FROM c GROUP BY component ORDER BY n DESC, component LIMIT 1)
  SELECT tile_id, key_e, key_n, n, CAST(row_number() OVER (ORDER BY key_n DESC, key_e) AS INTEGER) AS pos
  FROM tl JOIN c ON c.node = tile_id JOIN g USING (component)""")
def _(t):
    return grid.largest_connected_group(t.fx_tiles.where("tile_id % 3 <> 0"))


@query("b6_tile_quality", """SELECT raster_id, round(avg(CASE WHEN label > 127 THEN 1.0 ELSE 0.0 END), 6) AS road_fraction,
  round(avg(CASE WHEN band >= 248 THEN 1.0 ELSE 0.0 END), 6) AS blank_fraction
  FROM (SELECT raster_id, floor(r / 2.0) AS r, floor(c / 2.0) AS c, avg(truth * 255.0) AS label, avg(255.0 - conf * 10) AS band FROM fx_cells GROUP BY 1, 2, 3) GROUP BY raster_id""")
def _(t):
    q = grid.tile_quality(t.fx_cells, "raster_id", F.col("truth") * 255.0, 255.0 - F.col("conf") * 10, 2)
    return q.select("raster_id", F.round("road_fraction", 6).alias("road_fraction"), F.round("blank_fraction", 6).alias("blank_fraction"))


@query("b7_rank_blocks", BLOCKS + "SELECT anchor_e, anchor_n, CAST(rank AS INTEGER) AS rank, round(mean_road, 6) AS mean_road, max_blank, CAST(place AS INTEGER) AS place FROM k")
def _(t):
    return grid.rank_blocks(t.fx_tiles, _quality(t)).withColumn("mean_road", F.round("mean_road", 6))


@query("b8_best_block", BLOCKS + "SELECT anchor_e, anchor_n, round(mean_road, 6) AS mean_road FROM k WHERE rank <= 220 AND max_blank <= 0.15 ORDER BY round(mean_road, 9) DESC, rank LIMIT 1")
def _(t):
    return grid.best_block(t.fx_tiles, _quality(t)).withColumn("mean_road", F.round("mean_road", 6))


@query("b9_first_passing_block", BLOCKS + "SELECT anchor_e, anchor_n, CAST(place AS INTEGER) AS place FROM k WHERE place <= 5 AND max_blank <= 0.12 ORDER BY place LIMIT 1")
def _(t):
    return grid.first_passing_block(grid.rank_blocks(t.fx_tiles, _quality(t))).select("anchor_e", "anchor_n", "place")


RASTERS = "SELECT s_suppkey AS raster_id, CAST(100 + s_suppkey % 400 AS INTEGER) AS width, CAST(80 + (s_suppkey * 7) % 300 AS INTEGER) AS height FROM supplier"
AXIS = """WITH rs AS (""" + RASTERS + """),
  ax AS (SELECT raster_id, 'w' AS axis, width AS total FROM rs UNION ALL SELECT raster_id, 'h', height FROM rs),
  o AS (SELECT DISTINCT raster_id, axis, total, greatest(least(i * 96, total - 128), 0) AS off FROM ax, range(0, 40) g(i) WHERE i <= greatest(ceil((total - 128) / 96.0), 0)),
  p AS (SELECT *, row_number() OVER (PARTITION BY raster_id, axis ORDER BY off) - 1 AS pos FROM o),
  ch AS (SELECT a.raster_id, printf('chip_%05d_%05d', b.pos, a.pos) AS chip_id, a.off AS col_off, b.off AS row_off, least(128, a.total) AS w, least(128, b.total) AS h, a.total AS width, b.total AS height
         FROM p a JOIN p b ON a.raster_id = b.raster_id AND a.axis = 'w' AND b.axis = 'h')
"""


def _rasters(t):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("raster_id"), (100 + k % 400).cast("int").alias("width"), (80 + k * 7 % 300).cast("int").alias("height"))


@query("b10_plan_chips", AXIS + "SELECT raster_id, chip_id, CAST(col_off AS INTEGER) AS col_off, CAST(row_off AS INTEGER) AS row_off, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM ch")
def _(t):
    return grid.plan_chips(_rasters(t), 128, 32).select("raster_id", "chip_id", "col_off", "row_off", "w", "h")


@query("b11_chip_bounds", AXIS + """SELECT raster_id, chip_id, CAST(1000.0 * raster_id + col_off * 0.5 AS DOUBLE) AS minx, CAST(1000.0 * raster_id + (col_off + w) * 0.5 AS DOUBLE) AS maxx,
  CAST(5000.0 - row_off * 0.5 AS DOUBLE) AS maxy, CAST(5000.0 - (row_off + h) * 0.5 AS DOUBLE) AS miny FROM ch""")
def _(t):
    r = _rasters(t).withColumns({"x0": F.col("raster_id") * 1000.0, "y0": F.lit(5000.0), "px": F.lit(0.5)})
    return grid.chip_bounds(grid.plan_chips(r, 128, 32)).select("raster_id", "chip_id", "minx", "maxx", "maxy", "miny")


@query("b12_cells_to_chips", """SELECT raster_id, r, c, chip_id, r - ro AS i, c - co AS j FROM fx_cells
  JOIN (SELECT printf('chip_%05d_%05d', a, b) AS chip_id, a * 12 AS ro, b * 12 AS co FROM range(0, 5) x(a), range(0, 5) y(b)) k
  ON r >= ro AND r < ro + 16 AND c >= co AND c < co + 16""")
def _(t):
    cells = t.fx_cells
    r = cells.select("raster_id").distinct().withColumns({"width": F.lit(64), "height": F.lit(64)})
    chips = grid.plan_chips(r, 16, 4).select("raster_id", "chip_id", "row_off", "col_off", "w", "h")
    return grid.cells_to_chips(cells, chips, "raster_id", 16).select("raster_id", "r", "c", "chip_id", (F.col("r") - F.col("row_off")).alias("i"), (F.col("c") - F.col("col_off")).alias("j"))


TAPER = "(CASE WHEN least({x} + 1, 8 - {x}) <= 2 THEN 0.5 * (1 - cos(pi() * least({x} + 1, 8 - {x}) / 3)) ELSE 1.0 END)"
CHIPCELLS = """WITH cc AS (SELECT mosaic_id, chip_id, CAST(floor(k / 8.0) AS BIGINT) AS i, k % 8 AS j, row_off + CAST(floor(k / 8.0) AS BIGINT) AS r, col_off + k % 8 AS c,
  CAST(embedding[k + 1] AS DOUBLE) AS v FROM fx_chips JOIN embeddings ON vec_id = chip_id, range(0, 64) g(k))"""


def _chip_cells(t):
    c = t.fx_chips.join(t.embeddings.select(F.col("vec_id").alias("chip_id"), "embedding"), "chip_id")
    c = c.select("*", F.posexplode("embedding").alias("k", "x")).withColumns({"i": F.floor(F.col("k") / 8), "j": (F.col("k") % 8).cast("long")})
    return c.select("mosaic_id", "chip_id", "i", "j", "w", "h", (F.col("row_off") + F.col("i")).alias("r"), (F.col("col_off") + F.col("j")).alias("c"), F.col("x").cast("double").alias("v")).where("k < 64")


@query("b13_taper_weight", CHIPCELLS + f"SELECT chip_id, i, j, round({TAPER.format(x='i')} * {TAPER.format(x='j')}, 8) AS weight FROM cc")
def _(t):
    return grid.taper_weight(_chip_cells(t), 2).select("chip_id", "i", "j", F.round("weight", 8).alias("weight"))


@query("b14_stitch", CHIPCELLS + f"""SELECT mosaic_id, r, c, round(sum(v * wt) / sum(wt), 5) + 0.0 AS v, CASE WHEN sum(v * wt) / sum(wt) >= 0.05 THEN 255 ELSE 0 END AS mask
  FROM (SELECT *, {TAPER.format(x='i')} * {TAPER.format(x='j')} AS wt FROM cc) GROUP BY mosaic_id, r, c""")
def _(t):
    return grid.stitch(_chip_cells(t), ["mosaic_id"], 2, 0.05).withColumn("v", F.round("v", 5) + 0.0)


@query("b15_merge_tiles", CHIPCELLS + "SELECT mosaic_id, r, c, arg_min(v, chip_id) AS v FROM cc GROUP BY mosaic_id, r, c")
def _(t):
    tiles = t.fx_chips.select(F.col("chip_id").alias("tile_id"), "mosaic_id", "row_off", "col_off", F.col("chip_id").alias("tile_order"))
    cells = _chip_cells(t).select(F.col("chip_id").alias("tile_id"), F.col("i").alias("r"), F.col("j").alias("c"), "v")
    return grid.merge_tiles(cells, tiles, ["mosaic_id"])


WIN = "SELECT DISTINCT mosaic_id, mosaic_id % 20 AS wr, (mosaic_id * 3) % 20 AS wc, 6 AS wh, 9 AS ww FROM fx_chips"


@query("b16_chips_in_window", f"""SELECT k.mosaic_id, chip_id FROM fx_chips k JOIN ({WIN}) v ON k.mosaic_id = v.mosaic_id
  WHERE col_off < wc + ww AND col_off + w > wc AND row_off < wr + wh AND row_off + h > wr""")
def _(t):
    m = F.col("mosaic_id")
    win = t.fx_chips.select("mosaic_id").distinct().select("mosaic_id", (m % 20).alias("wr"), (m * 3 % 20).alias("wc"), F.lit(6).alias("wh"), F.lit(9).alias("ww"))
    return grid.chips_in_window(t.fx_chips, win, ["mosaic_id"]).select("mosaic_id", "chip_id")


@query("b17_window_from_bbox", """WITH b AS (SELECT line_id, least(x0, x1) AS a, greatest(x0, x1) AS b, 2500.0 - greatest(y0, y1) AS c, 2500.0 - least(y0, y1) AS d FROM fx_lines),
  p AS (SELECT line_id, least(greatest(CAST(trunc(a / 7.0) AS BIGINT), 0), 299) AS wc, least(greatest(CAST(trunc(b / 7.0) AS BIGINT), 0), 300) AS e,
               least(greatest(CAST(trunc(c / 7.0) AS BIGINT), 0), 199) AS wr, least(greatest(CAST(trunc(d / 7.0) AS BIGINT), 0), 200) AS f FROM b)
  SELECT line_id, wc, wr, greatest(e - wc, 1) AS ww, greatest(f - wr, 1) AS wh FROM p""")
def _(t):
    box = t.fx_lines.select("line_id", F.least("x0", "x1").alias("minx"), F.greatest("x0", "x1").alias("maxx"), F.least("y0", "y1").alias("miny"), F.greatest("y0", "y1").alias("maxy"))
    box = box.withColumns({"x0": F.lit(0.0), "y0": F.lit(2500.0), "px": F.lit(7.0), "width": F.lit(300).cast("long"), "height": F.lit(200).cast("long")})
    return grid.window_from_bbox(box).select("line_id", "wc", "wr", "ww", "wh")


@query("b18_named_window", """WITH a AS (SELECT p_partkey, 1000 + p_size AS width, 700 + p_size AS height, CASE p_partkey % 6 WHEN 0 THEN 'top left' WHEN 1 THEN 'bottom' WHEN 2 THEN 'center' WHEN 3 THEN 'whole' WHEN 4 THEN 'Right' ELSE 'somewhere' END AS area FROM part),
  f AS (SELECT *, p_partkey % 6 AS k FROM a),
  g AS (SELECT *, CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 0.55 WHEN 2 THEN 0.28 ELSE 0.0 END AS y0, CASE k WHEN 0 THEN 0.45 WHEN 1 THEN 1.0 WHEN 2 THEN 0.72 ELSE 1.0 END AS y1,
        CASE k WHEN 0 THEN 0.0 WHEN 2 THEN 0.28 WHEN 4 THEN 0.55 ELSE 0.0 END AS x0, CASE k WHEN 0 THEN 0.45 WHEN 2 THEN 0.72 ELSE 1.0 END AS x1 FROM f)
  SELECT p_partkey, CASE WHEN k < 5 THEN CAST(floor(CAST(y0 AS DOUBLE) * height) AS BIGINT) END AS wr, CASE WHEN k < 5 THEN CAST(floor(CAST(x0 AS DOUBLE) * width) AS BIGINT) END AS wc,
         CASE WHEN k < 5 THEN CAST(floor(CAST(y1 AS DOUBLE) * height) AS BIGINT) END AS wr1, CASE WHEN k < 5 THEN CAST(floor(CAST(x1 AS DOUBLE) * width) AS BIGINT) END AS wc1 FROM g""")
def _(t):
    area = F.element_at(F.array(*map(F.lit, ("top left", "bottom", "center", "whole", "Right", "somewhere"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return grid.named_window(t.part.select("p_partkey", (1000 + F.col("p_size")).alias("width"), (700 + F.col("p_size")).alias("height"), area.alias("area"))).select("p_partkey", "wr", "wc", "wr1", "wc1")


@query("b19_chip_stats", """SELECT raster_id, round(avg(g), 2) AS mean, round(stddev_pop(g), 2) AS std, round(avg(CASE WHEN g < 60 THEN 1.0 ELSE 0.0 END), 4) AS dark,
  round(avg(CASE WHEN g > 190 THEN 1.0 ELSE 0.0 END), 4) AS bright FROM (SELECT raster_id, conf * 255 AS g FROM fx_cells) GROUP BY raster_id""")
def _(t):
    return grid.chip_stats(t.fx_cells, ["raster_id"], F.col("conf") * 255)


@query("b20_tile_windows", "WITH rs AS (" + RASTERS + """) SELECT raster_id, CAST(i * 90 AS INTEGER) AS row_off, CAST(j * 90 AS INTEGER) AS col_off FROM rs, range(0, 6) a(i), range(0, 6) b(j)
  WHERE (i + 1) * 90 <= height AND (j + 1) * 90 <= width""")
def _(t):
    return grid.tile_windows(_rasters(t), 90).select("raster_id", "row_off", "col_off")


@query("b21_affected_chips", "SELECT mosaic_id, chip_id, CASE WHEN chip_id % 25 IN (6, 7, 11, 12) THEN 1 ELSE 0 END AS version FROM fx_chips")
def _(t):
    old = t.fx_chips.select("mosaic_id", "chip_id", F.lit(0).alias("version"))
    win = t.fx_chips.select("mosaic_id").distinct().select("mosaic_id", F.lit(8).alias("wr"), F.lit(8).alias("wc"), F.lit(6).alias("wh"), F.lit(6).alias("ww"))
    hit = grid.chips_in_window(t.fx_chips, win, ["mosaic_id"]).select("mosaic_id", "chip_id", F.lit(1).alias("version"))
    return grid.refresh(old, hit, ["mosaic_id", "chip_id"])
