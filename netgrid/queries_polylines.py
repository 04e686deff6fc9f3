"""Queries of linear referencing and of the edited network over lines of four vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import edits, polylines
from netgrid.queries_vector import KEY, ROLE, share_sql

# the vertices between the ends of a line bend away from the straight way
BENDS = [(0, 0.0, 0.0), (1, 2.0, -1.0), (2, -1.0, 2.0), (3, 0.0, 0.0)]


def vertices_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT region_id, line_id, status, {k} AS k, x0 + (x1 - x0) * {k} / 3 + {dx} AS x, y0 + (y1 - y0) * {k} / 3 + {dy} AS y FROM {source}" for k, dx, dy in BENDS)


def measures_sql(vertices: str) -> str:
    """Segments with measures of a relation of vertices."""
    w = "OVER (PARTITION BY region_id, line_id ORDER BY k)"
    return f"""SELECT *, m1 - step AS m0, max(m1) OVER (PARTITION BY region_id, line_id) AS length FROM (SELECT *, sum(step) {w} AS m1 FROM (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS step FROM (
      SELECT region_id, line_id, status, k, x AS x0, y AS y0, lead(x) {w} AS x1, lead(y) {w} AS y1,
        first_value(x) {w} AS fx, first_value(y) {w} AS fy, last_value(x) OVER (PARTITION BY region_id, line_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lx,
        last_value(y) OVER (PARTITION BY region_id, line_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ly FROM {vertices}) WHERE x1 IS NOT NULL))"""


SNAPS = f"""{ROLE}, pv AS MATERIALIZED ({vertices_sql("bl")}), pg AS MATERIALIZED ({measures_sql("pv")}),
  dv AS ({vertices_sql("(SELECT *, 'deleted' AS status FROM dl)")}), dg AS MATERIALIZED ({measures_sql("dv")}),
  fe AS (SELECT region_id, line_id, CASE WHEN k = 0 THEN 0 ELSE 1 END AS e, x, y FROM pv WHERE status = 'human' AND k IN (0, 3)),
  fp AS (SELECT fe.*, s.line_id AS other_id, s.k, s.x0, s.y0, s.x1 - s.x0 AS dx, s.y1 - s.y0 AS dy, s.m0, s.m1, s.fx, s.fy, s.lx, s.ly FROM fe JOIN pg s ON s.region_id = fe.region_id AND s.line_id <> fe.line_id
    AND x BETWEEN least(s.x0, s.x1) - 3 AND greatest(s.x0, s.x1) + 3 AND y BETWEEN least(s.y0, s.y1) - 3 AND greatest(s.y0, s.y1) + 3),
  fq AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN dx * dx + dy * dy > 0 THEN ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy) ELSE 0.0 END)) AS t FROM fp),
  fd AS (SELECT *, sqrt(pow(x - x0 - t * dx, 2) + pow(y - y0 - t * dy, 2)) AS d, x0 + t * dx AS ox, y0 + t * dy AS oy FROM fq),
  fs AS (SELECT *, CASE WHEN sqrt(pow(fx - ox, 2) + pow(fy - oy, 2)) <= 3 THEN 0 WHEN sqrt(pow(lx - ox, 2) + pow(ly - oy, 2)) <= 3 THEN 1 END AS own FROM
    (SELECT *, row_number() OVER (PARTITION BY region_id, line_id, e ORDER BY d, other_id, k) AS nth FROM fd WHERE d <= 3.0) WHERE nth = 1),
  fw AS MATERIALIZED (SELECT region_id, line_id, e, other_id, CASE own WHEN 0 THEN fx WHEN 1 THEN lx ELSE ox END AS sx, CASE own WHEN 0 THEN fy WHEN 1 THEN ly ELSE oy END AS sy,
    CASE WHEN own IS NULL THEN m0 + t * (m1 - m0) END AS cut FROM fs)"""
PIECES = f"""{SNAPS}, qv AS MATERIALIZED (SELECT v.region_id, v.line_id, v.status, v.k, coalesce(w.sx, v.x) AS x, coalesce(w.sy, v.y) AS y FROM pv v
    LEFT JOIN fw w ON v.status = 'human' AND w.region_id = v.region_id AND w.line_id = v.line_id AND v.k = 3 * w.e), qg AS MATERIALIZED ({measures_sql("qv")}),
  fn AS (SELECT region_id, line_id, count(*) AS n FROM fw GROUP BY 1, 2),
  fc AS (SELECT f.region_id, f.line_id, list_sort(list(w.cut)) AS cuts FROM (SELECT DISTINCT region_id, line_id, length FROM qg) f JOIN fw w ON w.region_id = f.region_id AND w.other_id = f.line_id
    WHERE w.cut >= 0.5 AND w.cut <= f.length - 0.5 GROUP BY 1, 2),
  fk AS (SELECT region_id, line_id, list_reduce(list_prepend([-1e18], list_transform(cuts, lambda z: [z])), lambda a, z: CASE WHEN z[1] - a[-1] >= 0.5 THEN list_concat(a, z) ELSE a END)[2:] AS kept FROM fc),
  fm AS (SELECT g.*, list_concat(list_concat([0.0], coalesce(kept, [])), [length]) AS marks FROM qg g LEFT JOIN fk ON fk.region_id = g.region_id AND fk.line_id = g.line_id),
  fx AS (SELECT *, unnest(range(1, len(marks))) AS piece FROM fm),
  fy AS (SELECT *, greatest(m0, marks[piece]) AS lo, least(m1, marks[piece + 1]) AS hi FROM fx WHERE marks[piece] < m1 AND marks[piece + 1] > m0),
  pc AS MATERIALIZED (SELECT region_id, (line_id * 1000 + piece) * 10 + k AS line_id, line_id AS own, piece, k, status, lo, hi,
    x0 + (x1 - x0) * (lo - m0) / step AS x0, y0 + (y1 - y0) * (lo - m0) / step AS y0, x0 + (x1 - x0) * (hi - m0) / step AS x1, y0 + (y1 - y0) * (hi - m0) / step AS y1 FROM fy)"""
MERGED = f"""{PIECES}, pm AS (SELECT * FROM pc WHERE status = 'model'), ph AS (SELECT * FROM pc WHERE status = 'human'), {share_sql("sd", "pm", "dg", 4)}, {share_sql("su", "pm", "ph", 4)},
  sh AS (SELECT pm.region_id, own, piece, sum(sd.share * (hi - lo)) / sum(hi - lo) AS d, sum(su.share * (hi - lo)) / sum(hi - lo) AS h FROM pm
    JOIN sd ON sd.region_id = pm.region_id AND sd.line_id = pm.line_id JOIN su ON su.region_id = pm.region_id AND su.line_id = pm.line_id GROUP BY 1, 2, 3),
  pp AS (SELECT region_id, own, piece, any_value(status) AS status, count(*) + 1 AS n, sum(hi - lo) AS len, arg_min(x0, k) AS ax, arg_min(y0, k) AS ay, arg_max(x1, k) AS bx, arg_max(y1, k) AS ey FROM pc GROUP BY 1, 2, 3),
  mg AS MATERIALIZED (SELECT pp.*, d, h, CASE WHEN piece = 1 THEN coalesce(fn.n, 0) ELSE 0 END AS snapped, CASE WHEN d >= 0.6 THEN 'deleted' WHEN h >= 0.7 THEN 'superseded' ELSE status END AS state
    FROM pp LEFT JOIN sh USING (region_id, own, piece) LEFT JOIN fn ON fn.region_id = pp.region_id AND fn.line_id = pp.own)"""


def bent(df, keep=("region_id", "line_id")):
    third = lambda v, k, d: F.col(f"{v}0") + (F.col(f"{v}1") - F.col(f"{v}0")) * k / 3 + d
    coords = F.array(*[F.struct(third("x", k, dx).alias("x"), third("y", k, dy).alias("y")) for k, dx, dy in BENDS])
    return df.select(*keep, coords.alias("coords"))


def _roles(t):
    s = t.fx_lines
    k = F.col("line_id")
    moved = {"x0": F.col("x0") + 1.25 + k % 5, "y0": F.col("y0") + 0.5, "x1": F.col("x1") + 0.75, "y1": F.col("y1") + k % 4}
    return bent(s.where("line_id % 3 <> 0")), bent(s.where("line_id % 3 = 0").withColumns(moved)), bent(s.where("line_id % 17 = 0"))


@query("f4_snap_polylines", f'WITH {SNAPS} SELECT region_id, line_id, e AS "end", other_id, round(sx, 4) + 0.0 AS x, round(sy, 4) + 0.0 AS y, round(cut, 4) AS cut_at FROM fw')
def _(t):
    model, human, _ = _roles(t)
    s = polylines.snap_line_ends(human, polylines.measured(model.unionByName(human), KEY), KEY)
    return s.withColumns({"x": F.round("x", 4) + 0.0, "y": F.round("y", 4) + 0.0, "cut_at": F.round("cut_at", 4)})


@query("f5_split_polylines", f"""WITH {SNAPS}, c AS (SELECT line_id, unnest([0.2, 30.0 + line_id % 9, 30.2 + line_id % 9, 60.0]) AS a FROM fx_lines WHERE line_id % 3 = 0),
  m AS (SELECT line_id, 0.0 AS a FROM fx_lines UNION ALL SELECT line_id, length FROM pg WHERE k = 0 AND status = 'model' UNION ALL SELECT line_id, length FROM pg WHERE k = 0 AND status = 'human'
    UNION ALL SELECT line_id, a FROM c JOIN (SELECT line_id, length FROM pg WHERE k = 0) USING (line_id) WHERE a IN (30.0 + line_id % 9, 60.0) AND a <= length - 0.5),
  p AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY a) AS piece, a AS lo, lead(a) OVER (PARTITION BY line_id ORDER BY a) AS hi FROM m),
  g AS (SELECT p.*, pg.k, pg.x0 + (pg.x1 - pg.x0) * (greatest(lo, m0) - m0) / step AS ax, pg.y0 + (pg.y1 - pg.y0) * (least(hi, m1) - m0) / step AS ey FROM p JOIN pg ON pg.line_id = p.line_id AND lo < m1 AND hi > m0 WHERE hi IS NOT NULL)
  SELECT line_id, CAST(piece AS INTEGER) AS piece, round(any_value(lo), 4) + 0.0 AS m0, round(any_value(hi), 4) AS m1, CAST(count(*) + 1 AS INTEGER) AS n_vertices, round(sum(ax), 3) + 0.0 AS sum_x, round(sum(ey), 3) + 0.0 AS sum_y FROM g GROUP BY line_id, piece""")
def _(t):
    model, human, _ = _roles(t)
    k = (F.col("line_id") % 9).cast("double")
    cuts = t.fx_lines.where("line_id % 3 = 0").select("region_id", "line_id", F.explode(F.array(F.lit(0.2), 30.0 + k, 30.2 + k, F.lit(60.0))).alias("at"))
    p = polylines.split_lines(model.unionByName(human), cuts, KEY)
    total = lambda of, v: F.round(F.aggregate(of, F.lit(0.0), lambda s, x: s + x[v]), 3) + 0.0
    n = F.size("coords")
    return p.select(
        "line_id", "piece", (F.round("m0", 4) + 0.0).alias("m0"), F.round("m1", 4).alias("m1"), n.cast("int").alias("n_vertices"),
        total(F.slice("coords", 1, n - 1), "x").alias("sum_x"), total(F.slice("coords", 2, n - 1), "y").alias("sum_y"),
    )


@query("f6_share_polylines", f"""WITH {SNAPS}, am AS (SELECT region_id, line_id * 10 + k AS line_id, line_id AS own, step, x0, y0, x1, y1 FROM pg WHERE status = 'model'), zh AS (SELECT * FROM pg WHERE status = 'human'), {share_sql("sh", "am", "zh", 4)}
  SELECT region_id, own AS line_id, round(sum(share * step) / sum(step), 6) AS share FROM am JOIN sh USING (region_id, line_id) GROUP BY 1, 2""")
def _(t):
    model, human, _ = _roles(t)
    return polylines.line_shares(polylines.measured(model, KEY), polylines.measured(human, KEY), KEY).withColumn("share", F.round("share", 6))


def _merged(t):
    return polylines.merge_lines(*_roles(t), KEY)


@query("f7_merge_polylines", f"""WITH {MERGED} SELECT region_id, own AS line_id, CAST(piece AS INTEGER) AS piece, state AS status, CAST(n AS INTEGER) AS n_vertices, round(len, 3) AS length,
    round(ax, 4) + 0.0 AS x0, round(ay, 4) + 0.0 AS y0, round(bx, 4) + 0.0 AS x1, round(ey, 4) + 0.0 AS y1, CAST(snapped AS INTEGER) AS n_snapped FROM mg""")
def _(t):
    p, q = F.get("coords", F.lit(0)), F.get("coords", F.size("coords") - 1)
    at = {"x0": p["x"], "y0": p["y"], "x1": q["x"], "y1": q["y"]}
    return _merged(t).select(
        "region_id", "line_id", "piece", "status", F.size("coords").alias("n_vertices"), F.round("length", 3).alias("length"), *[(F.round(v, 4) + 0.0).alias(n) for n, v in at.items()], F.col("n_snapped").cast("int").alias("n_snapped"),
    )


@query("f8_polyline_stats", f"""WITH {MERGED},
  s AS (SELECT region_id, count(CASE WHEN state = 'model' THEN 1 END) AS n_model, count(CASE WHEN state = 'human' THEN 1 END) AS n_human, count(CASE WHEN state = 'deleted' THEN 1 END) AS n_deleted, count(CASE WHEN state = 'superseded' THEN 1 END) AS n_superseded,
    CAST(sum(snapped) AS BIGINT) AS n_snapped_ends, coalesce(sum(CASE WHEN state = 'model' THEN len END), 0.0) AS m, coalesce(sum(CASE WHEN state = 'human' THEN len END), 0.0) AS h FROM mg GROUP BY 1)
  SELECT region_id, n_model, n_human, n_deleted, n_superseded, n_snapped_ends, n_model + n_human AS n_features, round(m, 1) AS model_length_m, round(h, 1) AS human_length_m, round(m + h, 1) AS total_length_m, round((m + h) / 1000, 3) AS total_length_km,
    round(CASE WHEN m + h > 0 THEN h / (m + h) ELSE 0.0 END, 4) AS human_share FROM s""")
def _(t):
    return edits.network_stats(_merged(t), KEY)
