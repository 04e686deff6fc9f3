"""Queries of reshaped lines, live tables and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import grid, ledger, shapes
from netgrid.plans.storage import fresh_path
from netgrid.queries_curate import BEST, _best
from netgrid.queries_polylines import bent, vertices_sql
from netgrid.queries_vector import KEY
from netgrid.sources import live
from netgrid.streaming import trace

VERTICES = f"""v AS MATERIALIZED ({vertices_sql("(SELECT *, source AS status FROM fx_lines)")}),
  sv AS (SELECT region_id, x, y FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT line_id) > 1),
  pv AS (SELECT v.*, sv.x IS NOT NULL OR k IN (0, 3) AS pin FROM v LEFT JOIN sv ON sv.region_id = v.region_id AND sv.x = v.x AND sv.y = v.y)"""


def _lines(t):
    return bent(t.fx_lines)


def _told(df):
    total = lambda v: F.round(F.aggregate("coords", F.lit(0.0), lambda s, p: s + p[v]), 3) + 0.0
    return df.select("region_id", "line_id", F.size("coords").alias("n_vertices"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query("d12_smooth_lines", f"""WITH {VERTICES}, n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pv WINDOW w AS (PARTITION BY region_id, line_id ORDER BY k)),
  o AS (SELECT region_id, line_id, x, y FROM n WHERE pin UNION ALL SELECT region_id, line_id, x + 0.25 * (px - x), y + 0.25 * (py - y) FROM n WHERE NOT pin UNION ALL SELECT region_id, line_id, x + 0.25 * (nx - x), y + 0.25 * (ny - y) FROM n WHERE NOT pin)
  SELECT region_id, line_id, CAST(count(*) AS INTEGER) AS n_vertices, round(sum(x), 3) + 0.0 AS sum_x, round(sum(y), 3) + 0.0 AS sum_y FROM o GROUP BY 1, 2""")
def _(t):
    return _told(shapes.smooth_lines(_lines(t), KEY))


# of two free vertices the farther one from the straight way is tested first, then the other against what is left
DIST = "abs((x{0} - x{1}) * (y{2} - y{1}) - (y{0} - y{1}) * (x{2} - x{1})) / sqrt(pow(x{2} - x{1}, 2) + pow(y{2} - y{1}, 2))"


@query("d12_simplify_lines", f"""WITH {VERTICES}, w AS (SELECT region_id, line_id, {", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {n}{k}" for k in range(4) for n, c in (("x", "x"), ("y", "y"), ("p", "CAST(pin AS INTEGER)")))} FROM pv GROUP BY 1, 2),
  d AS (SELECT *, {DIST.format(1, 0, 3)} AS a, {DIST.format(2, 0, 3)} AS b, {DIST.format(1, 0, 2)} AS a2, {DIST.format(2, 1, 3)} AS b1 FROM w),
  f AS (SELECT *, CASE WHEN p1 = 1 OR p2 = 1 THEN p1 = 1 OR a2 > 2 WHEN greatest(a, b) <= 2 THEN FALSE WHEN a >= b THEN TRUE ELSE a2 > 2 END AS k1,
    CASE WHEN p1 = 1 OR p2 = 1 THEN p2 = 1 OR b1 > 2 WHEN greatest(a, b) <= 2 THEN FALSE WHEN b > a THEN TRUE ELSE b1 > 2 END AS k2 FROM d)
  SELECT region_id, line_id, 2 + CAST(k1 AS INTEGER) + CAST(k2 AS INTEGER) AS n_vertices, round(x0 + x3 + CASE WHEN k1 THEN x1 ELSE 0 END + CASE WHEN k2 THEN x2 ELSE 0 END, 3) + 0.0 AS sum_x,
    round(y0 + y3 + CASE WHEN k1 THEN y1 ELSE 0 END + CASE WHEN k2 THEN y2 ELSE 0 END, 3) + 0.0 AS sum_y FROM f""")
def _(t):
    return _told(shapes.simplify_lines(_lines(t), KEY, 2.0))


@query("d12_reshape_report")
def _(t):
    return shapes.reshape_report(_lines(t), KEY, "smooth", 0.25)


@query("b21_refresh_live", "SELECT mosaic_id, chip_id, CASE WHEN chip_id % 25 IN (6, 7, 11, 12) THEN 1 ELSE 0 END AS version FROM fx_chips")
def _(t):
    old = t.fx_chips.select("mosaic_id", "chip_id", F.lit(0).alias("version"))
    spark, path, schema = old.sparkSession, fresh_path(old.sparkSession, "live"), "chip_id long, version int, mosaic_id long"
    live.write_live(old, path, "mosaic_id")
    win = t.fx_chips.select("mosaic_id").distinct().select("mosaic_id", F.lit(8).alias("wr"), F.lit(8).alias("wc"), F.lit(6).alias("wh"), F.lit(6).alias("ww"))
    hit = grid.chips_in_window(t.fx_chips, win, ["mosaic_id"]).select("mosaic_id", "chip_id", F.lit(1).alias("version"))
    live.refresh_chips(spark, path, schema, hit, ["mosaic_id", "chip_id"])
    return live.read_live(spark, path, schema).select("mosaic_id", "chip_id", "version")


@query("i3_make_live", "SELECT raster_id, r, c, conf FROM fx_cells WHERE raster_id % 2 = 1 OR conf > 0.5")
def _(t):
    rows = t.fx_cells.select("r", "c", F.col("conf").cast("double").alias("conf"), "raster_id")
    spark, path, schema = rows.sparkSession, fresh_path(rows.sparkSession, "live"), "r long, c long, conf double, raster_id long"
    live.write_live(rows, path)
    tried = rows.where("raster_id % 2 = 0")
    variants = tried.where("conf > 0.5").withColumn("variant_id", F.lit("half")).unionByName(tried.withColumn("variant_id", F.lit("all")))
    live.make_live(spark, path, schema, variants, "half")
    return live.read_live(spark, path, schema).select("raster_id", "r", "c", "conf")


@query("i17_restore_live", BEST + ", t AS (SELECT task_id, max(step) AS step FROM b WHERE is_best GROUP BY task_id) SELECT l.task_id, l.prec, l.rec FROM fx_ledger l SEMI JOIN t ON l.task_id = t.task_id AND l.step = t.step")
def _(t):
    rows = t.fx_ledger.select("step", "prec", "rec", "task_id")
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "live")
    live.write_live(rows.drop("step"), path, "task_id")
    live.restore_live(path, rows, _best(t))
    return live.read_live(spark, path, "prec double, rec double, task_id long").select("task_id", "prec", "rec")


@query("j4_sessions", """WITH e AS (SELECT *, coalesce("at" - lag("at") OVER (PARTITION BY job_id ORDER BY "at") >= INTERVAL '10 minutes', TRUE) AS new FROM fx_trace),
  s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT job_id, min("at") AS start, max("at") + INTERVAL '10 minutes' AS "end", count(*) AS n FROM s GROUP BY job_id, k""")
def _(t):
    s = trace.sessions(t.fx_trace, "10 minutes")
    return s.select("job_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")
