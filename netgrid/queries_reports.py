"""Queries of the full reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import grid, reports
from netgrid.queries_lines import TOPO
from netgrid.queries_vector import thin_sql
from netgrid.sources import tables


@query("e2_network_report", f"""WITH RECURSIVE nets AS (SELECT DISTINCT region_id FROM fx_lines UNION ALL SELECT -1),
  topo AS ({TOPO})
  SELECT region_id, n_lines IS NOT NULL AND FALSE AS geographic, coalesce(n_lines, 0) AS n_lines, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_dangles, 0) AS n_dangles, coalesce(n_junctions, 0) AS n_junctions, coalesce(n_components, 0) AS n_components,
    coalesce(total_length, 0.0) AS total_length, coalesce(largest_share, 0.0) AS largest_share, coalesce(short_fragments, 0) AS short_fragments, coalesce(isolated_length, 0.0) AS isolated_length, coalesce(dangle_ratio, 0.0) AS dangle_ratio,
    coalesce(score, 0.0) AS score, coalesce(verdict, 'empty') AS verdict, CASE WHEN n_lines IS NULL THEN 1 ELSE greatest(1, (n_components > 1)::INT + (dangle_ratio > 0.5)::INT + (short_fragments > 0)::INT) END AS n_notes
  FROM nets LEFT JOIN topo USING (region_id)""")
def _(t):
    p = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    lines = t.fx_lines.select("region_id", "line_id", F.array(p(0), p(1)).alias("coords"))
    nets = lines.select("region_id").unionByName(lines.sparkSession.createDataFrame([(-1,)], "region_id long"))
    return reports.network_report(lines, nets, ["region_id"]).withColumn("n_notes", F.size("notes")).drop("notes")


# the two masks of a raster are thinned as one relation, under twice its number and one more
@query("g5_tile_report", f"""WITH y AS (SELECT raster_id * 2 AS raster_id, r, c FROM fx_cells WHERE truth = 1 UNION ALL SELECT raster_id * 2 + 1, r, c FROM fx_cells WHERE conf > 0.5), {thin_sql("y")},
  dia AS (SELECT dy, dx FROM range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE abs(dy) + abs(dx) <= 3), disk AS (SELECT dy, dx FROM range(-5, 6) a(dy), range(-5, 6) b(dx) WHERE dy * dy + dx * dx <= 25),
  wide AS MATERIALIZED (SELECT DISTINCT raster_id, r + dy AS r, c + dx AS c FROM y, dia), near AS MATERIALIZED (SELECT DISTINCT raster_id, r + dy AS r, c + dx AS c FROM sk, disk),
  m AS (SELECT y.raster_id, count(*) AS n, count(w.r) AS relaxed FROM y LEFT JOIN wide w ON w.raster_id = xor(y.raster_id, 1) AND w.r = y.r AND w.c = y.c GROUP BY 1),
  b AS (SELECT p.raster_id, count(*) AS tp FROM y p JOIN y q ON q.raster_id = p.raster_id - 1 AND q.r = p.r AND q.c = p.c WHERE p.raster_id % 2 = 1 GROUP BY 1),
  s AS (SELECT sk.raster_id, count(*) AS n, count(w.r) AS matched FROM sk LEFT JOIN near w ON w.raster_id = xor(sk.raster_id, 1) AND w.r = sk.r AND w.c = sk.c GROUP BY 1),
  t AS (SELECT raster_id // 2 AS tile, coalesce(max(CASE WHEN raster_id % 2 = 1 THEN n END), 0) AS p, coalesce(max(CASE WHEN raster_id % 2 = 0 THEN n END), 0) AS t, coalesce(max(CASE WHEN raster_id % 2 = 1 THEN relaxed END), 0) AS rp, coalesce(max(CASE WHEN raster_id % 2 = 0 THEN relaxed END), 0) AS rt FROM m GROUP BY 1),
  u AS (SELECT raster_id // 2 AS tile, coalesce(max(CASE WHEN raster_id % 2 = 1 THEN n END), 0) AS sp, coalesce(max(CASE WHEN raster_id % 2 = 0 THEN n END), 0) AS st, coalesce(max(CASE WHEN raster_id % 2 = 1 THEN matched END), 0) AS mp, coalesce(max(CASE WHEN raster_id % 2 = 0 THEN matched END), 0) AS mt FROM s GROUP BY 1),
  e AS (SELECT tile % 5 AS part, t.tile, coalesce(tp, 0) AS tp, p, t.t, rp, rt, sp, st, mp, mt, 1 AS n FROM t JOIN u USING (tile) LEFT JOIN (SELECT raster_id // 2 AS tile, tp FROM b) b USING (tile)),
  f AS (SELECT * FROM e UNION ALL SELECT part, NULL, sum(tp), sum(p), sum(t), sum(rp), sum(rt), sum(sp), sum(st), sum(mp), sum(mt), count(*) FROM e GROUP BY part),
  g AS (SELECT *, coalesce(tp / nullif(p, 0), 0) AS pr, coalesce(tp / nullif(t, 0), 0) AS re, coalesce(rp / nullif(p, 0), 0) AS a, coalesce(rt / nullif(t, 0), 0) AS d, coalesce(mp / nullif(sp, 0), 0) AS co, coalesce(mt / nullif(st, 0), 0) AS cm FROM f)
  SELECT part, tile AS raster_id, CAST(n AS BIGINT) AS n_tiles, round(coalesce(tp / nullif(p + t - tp, 0), 0), 4) AS iou, round(pr, 4) AS precision, round(re, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4) AS f1, round(coalesce(2 * a * d / nullif(a + d, 0), 0), 4) AS relaxed_f1,
    round(co, 4) AS correctness, round(cm, 4) AS completeness, round(coalesce(2 * co * cm / nullif(co + cm, 0), 0), 4) AS centreline_f1, CASE WHEN tile IS NOT NULL THEN round(tp / greatest(p + t - tp, 1), 4) END AS tile_iou, CASE WHEN tile IS NOT NULL THEN round(mt / greatest(st, 1), 4) END AS tile_completeness FROM g""")
def _(t):
    c = t.fx_cells.withColumn("part", F.col("raster_id") % 5)
    return reports.tile_report(c.where("conf > 0.5"), c.where("truth = 1"), ["part"], "raster_id", 64, 64, clean=None)


@query("b6_blank_variants", """SELECT raster_id, round(avg(CASE WHEN label > 127 THEN 1.0 ELSE 0.0 END), 6) AS road_fraction, round(avg(CASE WHEN band >= 248 OR most <= 5 THEN 1.0 ELSE 0.0 END), 6) AS blank_fraction
  FROM (SELECT raster_id, floor(r / 2.0) AS r, floor(c / 2.0) AS c, avg(truth * 255.0) AS label, avg(255.0 - conf * 10) AS band, avg(conf * 20) AS most FROM fx_cells GROUP BY 1, 2, 3) GROUP BY raster_id""")
def _(t):
    q = grid.tile_quality(t.fx_cells, "raster_id", F.col("truth") * 255.0, 255.0 - F.col("conf") * 10, 2, F.col("conf") * 20)
    return q.select("raster_id", *[F.round(c, 6).alias(c) for c in ("road_fraction", "blank_fraction")])


@query("b20_kept_windows", """WITH w AS (SELECT raster_id, i, j FROM (SELECT DISTINCT raster_id FROM fx_cells), range(0, 4) a(i), range(0, 4) b(j)),
  n AS (SELECT raster_id, r // 16 AS i, c // 16 AS j, count(*) AS n FROM fx_cells WHERE conf >= 0.3 GROUP BY 1, 2, 3)
  SELECT raster_id, CAST(i * 16 AS INTEGER) AS row_off, CAST(j * 16 AS INTEGER) AS col_off, round(coalesce(n, 0) / 256.0, 6) AS blank FROM w LEFT JOIN n USING (raster_id, i, j) WHERE coalesce(n, 0) / 256.0 <= 0.1""")
def _(t):
    rasters = t.fx_cells.select("raster_id").distinct().withColumns({"height": F.lit(64), "width": F.lit(64)})
    w = grid.kept_windows(grid.tile_windows(rasters, 16), t.fx_cells, ["raster_id"], 16, F.col("conf") >= 0.3, 0.1)
    return w.select("raster_id", "row_off", "col_off", F.round("blank", 6).alias("blank"))


@query("a12_copy_origin", """SELECT tile_id, CASE WHEN tile_id % 5 = 0 THEN 'no match' WHEN tile_id % 7 = 0 THEN 'failed' WHEN tile_id % 3 = 0 THEN 'already' ELSE 'done' END AS status,
  CASE WHEN tile_id % 5 <> 0 AND tile_id % 7 <> 0 AND tile_id % 3 <> 0 THEN CAST(key_e * 100 AS DOUBLE) ELSE 0.0 END AS x0, CASE WHEN tile_id % 5 <> 0 AND tile_id % 7 <> 0 AND tile_id % 3 <> 0 THEN CAST(key_n * 100 AS DOUBLE) ELSE 0.0 END AS y0 FROM fx_tiles""")
def _(t):
    zero = {c: F.lit(0.0) for c in ("x0", "y0")}
    lab = t.fx_tiles.select("tile_id", F.lit(10).alias("width"), F.lit(10).alias("height"), F.when(F.col("tile_id") % 3 == 0, "EPSG:26986").alias("crs")).withColumns(zero)
    img = t.fx_tiles.where("tile_id % 5 <> 0").select(
        "tile_id", F.when(F.col("tile_id") % 7 == 0, 11).otherwise(10).alias("width"), F.lit(10).alias("height"), F.lit("EPSG:26986").alias("crs"),
        (F.col("key_e") * 100).cast("double").alias("x0"), (F.col("key_n") * 100).cast("double").alias("y0"),
    )
    return tables.copy_grid(lab, img, "tile_id").select("tile_id", "status", "x0", "y0")


@query("a7_list_jobs", """WITH j AS (SELECT user_id AS job_id, arg_max(event_type, event_id) AS stage, arg_max(ts, event_id) AS last, count(*) AS n_stages, bool_or(event_type = 'purchase') AS has_network, bool_or(event_type = 'signup') AS has_mask,
    max(CASE WHEN event_type = 'click' THEN event_id END) AS score FROM events GROUP BY 1)
  SELECT job_id, stage, n_stages, has_network, has_mask, score, row_number() OVER (ORDER BY last DESC, job_id DESC) AS rank FROM j""")
def _(t):
    log = t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("ts").alias("at"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("score"))
    return tables.list_jobs(log, {"network": "purchase", "mask": "signup"}, ["score"]).select("job_id", "stage", "n_stages", "has_network", "has_mask", "score", "rank")
