"""Queries of greedy selection, label widths and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import curate, distance, projection
from netgrid.queries_vector import TRUTH, thin_sql


@query("c11_label_width", f"""WITH {TRUTH}, {thin_sql("y")}, n AS (SELECT raster_id, count(*) AS area FROM y GROUP BY 1),
  grid AS (SELECT raster_id, r, c FROM n CROSS JOIN range(0, 64) a(r) CROSS JOIN range(0, 64) b(c)), clear AS MATERIALIZED (SELECT * FROM grid ANTI JOIN y USING (raster_id, r, c)),
  d AS (SELECT s.raster_id, s.r, s.c, min((s.r - k.r) * (s.r - k.r) + (s.c - k.c) * (s.c - k.c)) AS d2 FROM sk s JOIN clear k ON k.raster_id = s.raster_id GROUP BY 1, 2, 3),
  e AS (SELECT raster_id, 2 * avg(sqrt(d2)) AS edt, count(*) AS m FROM d GROUP BY 1),
  h AS (SELECT raster_id, r AS k, c - row_number() OVER (PARTITION BY raster_id, r ORDER BY c) AS g FROM y), v AS (SELECT raster_id, c AS k, r - row_number() OVER (PARTITION BY raster_id, c ORDER BY r) AS g FROM y),
  w AS (SELECT raster_id, n AS width, count(*) AS f FROM (SELECT raster_id, count(*) AS n FROM h GROUP BY raster_id, k, g UNION ALL SELECT raster_id, count(*) FROM v GROUP BY raster_id, k, g) GROUP BY 1, 2),
  u AS (SELECT raster_id, width FROM w QUALIFY row_number() OVER (PARTITION BY raster_id ORDER BY f DESC, width) = 1)
  SELECT raster_id, round(edt, 6) AS edt, round(area / m, 6) AS area_per_skeleton, width AS run_mode FROM n JOIN e USING (raster_id) JOIN u USING (raster_id)""")
def _(t):
    mask = t.fx_cells.where("truth = 1").select("raster_id", "r", "c")
    w = distance.label_width(mask, ["raster_id"], 64, 64)
    return w.select("raster_id", F.round("edt", 6).alias("edt"), F.round("area_per_skeleton", 6).alias("area_per_skeleton"), "run_mode")


@query("h8_greedy_pick", """WITH RECURSIVE c AS (SELECT split, idx, idx // 3 % 40 AS site, row_number() OVER (PARTITION BY split ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY split) AS total FROM fx_files),
  p AS (
    SELECT DISTINCT split, 0 AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS sites FROM c
    UNION ALL
    SELECT split, k + 1, list_append(used, pos), list_append(sites, site) FROM (
      SELECT p.split, k, used, sites, pos, site, row_number() OVER (PARTITION BY p.split ORDER BY abs(pos - CASE WHEN k = 23 THEN total - 1 ELSE round_even(k * ((total - 1) / 23.0), 0) END), pos DESC) AS nth
      FROM p JOIN c ON c.split = p.split WHERE k < 24 AND NOT list_contains(used, pos) AND len(list_filter(sites, lambda s: s = site)) < 2) WHERE nth = 1),
  f AS (SELECT split, unnest(used) AS pos FROM (SELECT split, used FROM p QUALIFY row_number() OVER (PARTITION BY split ORDER BY k DESC) = 1))
  SELECT c.split, c.idx, c.site FROM f JOIN c ON c.split = f.split AND c.pos = f.pos""")
def _(t):
    items = t.fx_files.select("split", "idx", (F.floor(F.col("idx") / 3) % 40).cast("long").alias("site"))
    sets = items.select("split").distinct().withColumns({"n": F.lit(24), "cap": F.lit(2)})
    return curate.greedy_pick(items, sets, "split")


@query("h9_select_regions_greedy")
def _(t):
    items = t.fx_files.select("idx", "split", "sha", F.floor(F.col("idx") / 3).alias("site"))
    return curate.select_regions(items, 80, 12, 20, 6, 5, 4, greedy=True)


def _sum(table: list[list], sign: str, of: str) -> str:
    return "".join(f" {sign} {f!r} * {of.replace('#', str(2 * k))}" for k, f in enumerate(projection.terms(table), 1))


E, R = repr(projection.E), repr(projection.SCALE * projection.RADIUS)


# networks stand in other zones, north and south; the first vertex there and back
@query("d6_utm", f"""WITH g AS (SELECT line_id, region_id, x0 / 1000 + region_id % 59 * 6.0 - 178 AS ax, y0 / 100 - 11.5 + region_id % 2 * 40 AS ay, x1 / 1000 + region_id % 59 * 6.0 - 178 AS bx, y1 / 100 - 11.5 + region_id % 2 * 40 AS by_ FROM fx_lines),
  m AS (SELECT region_id, avg((ax + bx) / 2) AS lon, avg((ay + by_) / 2) AS lat FROM g GROUP BY 1),
  z AS (SELECT region_id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(CAST(floor((lon + 180) / 6) AS INTEGER) + 1, 60) AS epsg FROM m),
  a AS (SELECT g.*, epsg, radians(ax - ((epsg % 100) * 6.0 - 183.0)) AS lam, tan(radians(ay)) AS t FROM g JOIN z USING (region_id)),
  b AS (SELECT *, sinh({E} * atanh({E} * t / sqrt(1 + t * t))) AS s FROM a), c AS (SELECT *, t * sqrt(1 + s * s) - s * sqrt(1 + t * t) AS tc FROM b),
  d AS (SELECT *, atan2(tc, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tc * tc + cos(lam) * cos(lam))) AS eta FROM c),
  e AS (SELECT *, xi{_sum(projection.FORWARD, "+", "sin(# * xi) * cosh(# * eta)")} AS u, eta{_sum(projection.FORWARD, "+", "cos(# * xi) * sinh(# * eta)")} AS w FROM d)
  SELECT line_id, epsg, round(500000 + {R} * w, 3) + 0.0 AS x, round(CASE WHEN epsg > 32700 THEN 10000000 ELSE 0 END + {R} * u, 3) + 0.0 AS y, round(ax, 8) + 0.0 AS lon, round(ay, 8) + 0.0 AS lat,
    round(6378137 * radians(ax), 3) + 0.0 AS web_x, round(6378137 * asinh(tan(radians(ay))), 3) + 0.0 AS web_y FROM e""")
def _(t):
    lon = lambda v: F.col(v) / 1000 + F.col("region_id") % 59 * 6.0 - 178
    lat = lambda v: F.col(v) / 100 - 11.5 + F.col("region_id") % 2 * 40
    p = lambda k: F.struct(lon(f"x{k}").alias("x"), lat(f"y{k}").alias("y"))
    lines = t.fx_lines.select("region_id", "line_id", F.array(p(0), p(1)).alias("coords"))
    out = lines.join(projection.frames(lines, ["region_id"]), "region_id")
    out = out.withColumn("flat", projection.to_frame(F.col("coords"), F.col("epsg")))
    out = out.withColumns({"back": projection.from_frame(F.col("flat"), F.col("epsg")), "web": projection.to_frame(F.col("coords"), F.lit(3857))})
    at = lambda c, v, k: F.round(F.get(c, F.lit(0))[v], k) + 0.0
    return out.select(
        "line_id", "epsg", at("flat", "x", 3).alias("x"), at("flat", "y", 3).alias("y"), at("back", "x", 8).alias("lon"), at("back", "y", 8).alias("lat"), at("web", "x", 3).alias("web_x"), at("web", "y", 3).alias("web_y"),
    )
