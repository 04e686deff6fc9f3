"""Queries of the network operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import network

NEAR = """WITH e AS (SELECT region_id, line_id, 0 AS "end", x0 AS x, y0 AS y FROM fx_lines UNION ALL SELECT region_id, line_id, 1, x1, y1 FROM fx_lines),
  p AS (SELECT e.*, s.line_id AS other_id, s.x0, s.y0, s.x1 - s.x0 AS dx, s.y1 - s.y0 AS dy FROM e JOIN fx_lines s ON s.region_id = e.region_id AND s.line_id <> e.line_id
        AND x BETWEEN least(s.x0, s.x1) - 5 AND greatest(s.x0, s.x1) + 5 AND y BETWEEN least(s.y0, s.y1) - 5 AND greatest(s.y0, s.y1) + 5),
  q AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN dx * dx + dy * dy > 0 THEN ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy) ELSE 0.0 END)) AS t FROM p),
  d AS (SELECT *, sqrt(pow(x - x0 - t * dx, 2) + pow(y - y0 - t * dy, 2)) AS d, sqrt(dx * dx + dy * dy) AS len FROM q)"""


@query("d1_pixel_degree", """WITH y AS (SELECT raster_id, r, c FROM fx_cells WHERE truth = 1), n AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy <> 0 OR dx <> 0)
  SELECT y.raster_id, y.r, y.c, count(z.r) AS degree, count(z.r) <> 2 AS is_node FROM y CROSS JOIN n LEFT JOIN y z ON z.raster_id = y.raster_id AND z.r = y.r + dy AND z.c = y.c + dx GROUP BY 1, 2, 3""")
def _(t):
    return network.pixel_degree(t.fx_cells.where("truth = 1"), ["raster_id"])


@query("d6_project", "SELECT line_id, round((x0 / 1000 - 1.0) * 111320.0 * cos(radians(CAST(0.5 AS DOUBLE))), 4) AS x, round((y0 / 1000 - 0.5) * 110540.0, 4) AS y, CASE WHEN y0 / 1000 - 1 >= 0 THEN 32600 ELSE 32700 END + CAST(floor((x0 / 10 + 180) / 6) AS INTEGER) + 1 AS zone FROM fx_lines")
def _(t):
    x, y = network.to_metres(F.col("x0") / 1000, F.col("y0") / 1000, F.lit(1.0), F.lit(0.5))
    return t.fx_lines.select("line_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), network.utm_zone(F.col("x0") / 10, F.col("y0") / 1000 - 1).alias("zone"))


@query("e4_dead_ends", NEAR + ' SELECT e.region_id, e.line_id, e."end", e.x, e.y FROM e ANTI JOIN (SELECT DISTINCT region_id, line_id, "end" FROM d WHERE d <= 2.5) k ON e.region_id = k.region_id AND e.line_id = k.line_id AND e."end" = k."end"')
def _(t):
    return network.dead_ends(t.fx_lines, ["region_id"])


@query("f3_replay", """WITH l AS (SELECT user_id AS job_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'replace' ELSE 'delete' END AS op, event_id % 40 AS id, CASE WHEN event_id % 3 > 0 THEN (event_id * 7) % 40 END AS target FROM events)
  SELECT job_id, seq, id FROM l WHERE op <> 'delete' AND NOT EXISTS (SELECT 1 FROM l k WHERE k.job_id = l.job_id AND k.target = l.id AND k.seq >= l.seq)""")
def _(t):
    k = F.col("event_id") % 3
    log = t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(k == 0, "add").when(k == 1, "replace").otherwise("delete").alias("op"), (F.col("event_id") % 40).alias("id"), F.when(k > 0, F.col("event_id") * 7 % 40).alias("target"))
    return network.replay(log).select("job_id", "seq", "id")


@query("f4_snap_ends", NEAR + """, b AS (SELECT *, row_number() OVER (PARTITION BY region_id, line_id, "end" ORDER BY d, other_id) AS k FROM d WHERE d <= 3.0 AND line_id % 4 = 0)
  SELECT region_id, line_id, "end", other_id, round(CASE WHEN t * len <= 3 THEN x0 WHEN (1 - t) * len <= 3 THEN x0 + dx ELSE x0 + t * dx END, 4) AS x,
    round(CASE WHEN t * len <= 3 THEN y0 WHEN (1 - t) * len <= 3 THEN y0 + dy ELSE y0 + t * dy END, 4) AS y, round(CASE WHEN t * len > 3 AND (1 - t) * len > 3 THEN t * len END, 4) AS cut_at FROM b WHERE k = 1""")
def _(t):
    s = network.snap_ends(t.fx_lines.where("line_id % 4 = 0"), t.fx_lines, ["region_id"])
    return s.withColumns({c: F.round(c, 4) for c in ("x", "y", "cut_at")})


@query("f5_split_at", """WITH c AS (SELECT line_id, unnest([0.2, 30.0 + line_id % 9, 30.2 + line_id % 9, 60.0]) AS a FROM fx_lines WHERE line_id % 3 = 0),
  l AS (SELECT line_id, x0, y0, x1, y1, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM fx_lines),
  m AS (SELECT line_id, 0.0 AS a FROM l UNION ALL SELECT line_id, len FROM l UNION ALL SELECT c.line_id, a FROM c JOIN l USING (line_id) WHERE a IN (30.0 + c.line_id % 9, 60.0) AND a <= len - 0.5),
  p AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY a) AS piece, a AS lo, lead(a) OVER (PARTITION BY line_id ORDER BY a) AS hi FROM m)
  SELECT line_id, CAST(piece AS INTEGER) AS piece, round(x0 + (x1 - x0) * lo / len, 4) + 0.0 AS x0, round(y0 + (y1 - y0) * hi / len, 4) + 0.0 AS y1 FROM p JOIN l USING (line_id) WHERE hi IS NOT NULL""")
def _(t):
    k = (F.col("line_id") % 9).cast("double")
    cuts = t.fx_lines.where("line_id % 3 = 0").select("region_id", "line_id", F.explode(F.array(F.lit(0.2), 30.0 + k, 30.2 + k, F.lit(60.0))).alias("at"))
    return network.split_at(t.fx_lines.drop("source"), cuts, ["region_id"]).select("line_id", "piece", (F.round("x0", 4) + 0.0).alias("x0"), (F.round("y1", 4) + 0.0).alias("y1"))


@query("f11_rank_suggestions", "SELECT line_id, kind, score FROM (SELECT line_id, CASE WHEN line_id % 50 = 0 THEN 'gap' ELSE 'missed' END AS kind, (line_id * 31) % 997 AS score FROM fx_lines) ORDER BY kind = 'gap' DESC, score DESC, line_id LIMIT 60")
def _(t):
    s = t.fx_lines.select("line_id", F.when(F.col("line_id") % 50 == 0, "gap").otherwise("missed").alias("kind"), (F.col("line_id") * 31 % 997).alias("score"))
    return network.rank_suggestions(s)


@query("a11_blocks_and_cells", "SELECT raster_id, r, c, CAST(conf AS FLOAT) AS v FROM fx_cells WHERE conf > 0")
def _(t):
    b = network.to_blocks(t.fx_cells.withColumn("v", F.col("conf")), ["raster_id"], 32)
    return network.to_cells(b, ["raster_id"], 32)
