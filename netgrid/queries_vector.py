"""Queries of the vectorising, merging, suggestion and candidate operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import cells, curate, edits, network, vectorise
from netgrid.operators.lines import share_along
from netgrid.plans.storage import fresh_path
from netgrid.queries_grid import CHIPCELLS, TAPER
from netgrid.sources import tables
from netgrid.streaming import trace

KEY = ["region_id"]
OFFSETS = "o AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy <> 0 OR dx <> 0)"


def thin_sql(source: str, rounds: int = 8) -> str:
    """Zhang and Suen's thinning of the relation ``source`` (raster_id, r, c), unrolled; the result is ``sk``."""
    out, at = [OFFSETS], source
    bit = lambda y, x: f"max(CASE WHEN o.dy = {y} AND o.dx = {x} AND z.r IS NOT NULL THEN 1 ELSE 0 END)"
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    p = ", ".join(f"{bit(y, x)} AS p{i}" for i, (y, x) in enumerate(ring))
    count, turns = " + ".join(f"p{i}" for i in range(8)), " + ".join(f"(1 - p{i}) * p{(i + 1) % 8}" for i in range(8))
    for k in range(2 * rounds):
        ends = "p0 * p2 * p4 = 0 AND p2 * p4 * p6 = 0" if k % 2 == 0 else "p0 * p2 * p6 = 0 AND p0 * p4 * p6 = 0"
        out.append(f"n{k} AS MATERIALIZED (SELECT y.raster_id, y.r, y.c, {p} FROM {at} y CROSS JOIN o LEFT JOIN {at} z ON z.raster_id = y.raster_id AND z.r = y.r + o.dy AND z.c = y.c + o.dx GROUP BY 1, 2, 3)")
        out.append(f"t{k} AS MATERIALIZED (SELECT raster_id, r, c FROM n{k} WHERE NOT ({count} BETWEEN 2 AND 6 AND {turns} = 1 AND {ends}))")
        at = f"t{k}"
    return ", ".join(out) + f", sk AS (SELECT * FROM {at})"


def burnt_sql(size: float, name: str = "nt", lines: str = "fx_lines", keys: str = "region_id") -> str:
    """All cells that the lines touch, within 64 rows and columns."""
    s = f"{float(size)}"
    return f"""bs AS (SELECT {keys}, line_id, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM {lines}),
      bt AS (SELECT {keys}, line_id, x0, y0, dx, dy, unnest([0.0, 1.0]) AS t FROM bs
        UNION ALL SELECT {keys}, line_id, x0, y0, dx, dy, (i * {s} - x0) / dx FROM bs, range(-20, 80) g(i) WHERE dx <> 0 AND i * {s} BETWEEN least(x0, x0 + dx) AND greatest(x0, x0 + dx)
        UNION ALL SELECT {keys}, line_id, x0, y0, dx, dy, (i * {s} - y0) / dy FROM bs, range(-20, 80) g(i) WHERE dy <> 0 AND i * {s} BETWEEN least(y0, y0 + dy) AND greatest(y0, y0 + dy)),
      bm AS (SELECT *, (t + lead(t) OVER (PARTITION BY {keys}, line_id ORDER BY t)) / 2 AS mid FROM (SELECT DISTINCT * FROM bt)),
      {name}_all AS MATERIALIZED (SELECT DISTINCT {keys}, CAST(floor((y0 + mid * dy) / {s}) AS BIGINT) AS r, CAST(floor((x0 + mid * dx) / {s}) AS BIGINT) AS c FROM bm WHERE mid IS NOT NULL),
      {name} AS (SELECT * FROM {name}_all WHERE r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63)"""


def share_sql(name: str, a: str, zone: str, buf: float, keys: str = "region_id") -> str:
    """``name`` (keys, line_id, share): the share of each line of ``a`` inside the buffers of ``zone``, by intervals."""
    b = f"{float(buf)}"
    between = lambda p, d, lo, hi: (
        f"CASE WHEN {d} = 0 THEN CASE WHEN {p} BETWEEN {lo} AND {hi} THEN -1e18 ELSE 1e18 END ELSE least(({lo} - {p}) / nullif({d}, 0), ({hi} - {p}) / nullif({d}, 0)) END",
        f"CASE WHEN {d} = 0 THEN CASE WHEN {p} BETWEEN {lo} AND {hi} THEN 1e18 ELSE -1e18 END ELSE greatest(({lo} - {p}) / nullif({d}, 0), ({hi} - {p}) / nullif({d}, 0)) END",
    )
    s, c = between("pa", "da", "0", "n"), between("pc", "dc", f"-{b}", b)
    on = " AND ".join(f"a.{k} = z.{k}" for k in keys.split(", "))
    of = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name}_p AS (SELECT {of}, a.line_id, a.x0 AS px, a.y0 AS py, a.x1 - a.x0 AS dx, a.y1 - a.y0 AS dy, z.x0 AS zx, z.y0 AS zy, z.x1 - z.x0 AS ux, z.y1 - z.y0 AS uy
        FROM {a} a JOIN (SELECT DISTINCT {keys}, x0, y0, x1, y1 FROM {zone}) z ON {on} AND least(a.x0, a.x1) <= greatest(z.x0, z.x1) + {b} AND greatest(a.x0, a.x1) >= least(z.x0, z.x1) - {b}
          AND least(a.y0, a.y1) <= greatest(z.y0, z.y1) + {b} AND greatest(a.y0, a.y1) >= least(z.y0, z.y1) - {b}),
      {name}_q AS (SELECT *, dx * dx + dy * dy AS aa, (px - zx) * dx + (py - zy) * dy AS b0, (px - zx) * (px - zx) + (py - zy) * (py - zy) - {b} * {b} AS c0,
          (px - zx - ux) * dx + (py - zy - uy) * dy AS b1, (px - zx - ux) * (px - zx - ux) + (py - zy - uy) * (py - zy - uy) - {b} * {b} AS c1, nullif(sqrt(ux * ux + uy * uy), 0) AS n FROM {name}_p),
      {name}_r AS (SELECT *, ((px - zx) * ux + (py - zy) * uy) / n AS pa, (dx * ux + dy * uy) / n AS da, ((px - zx) * uy - (py - zy) * ux) / n AS pc, (dx * uy - dy * ux) / n AS dc,
          CASE WHEN aa > 0 AND b0 * b0 - aa * c0 >= 0 THEN sqrt(b0 * b0 - aa * c0) END AS w0, CASE WHEN aa > 0 AND b1 * b1 - aa * c1 >= 0 THEN sqrt(b1 * b1 - aa * c1) END AS w1 FROM {name}_q),
      {name}_s AS (SELECT *, greatest({s[0]}, {c[0]}) AS low, least({s[1]}, {c[1]}) AS high FROM {name}_r),
      {name}_t AS (SELECT {keys}, line_id, least((-b0 - w0) / aa, (-b1 - w1) / aa, CASE WHEN n > 0 AND low <= high THEN low END) AS t0, greatest((-b0 + w0) / aa, (-b1 + w1) / aa, CASE WHEN n > 0 AND low <= high THEN high END) AS t1 FROM {name}_s),
      {name}_u AS (SELECT {keys}, line_id, greatest(t0, 0.0) AS t0, least(t1, 1.0) AS t1 FROM {name}_t WHERE t0 IS NOT NULL AND greatest(t0, 0.0) < least(t1, 1.0)),
      {name}_v AS (SELECT *, coalesce(max(t1) OVER (PARTITION BY {keys}, line_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS seen FROM {name}_u),
      {name}_w AS (SELECT {keys}, line_id, sum(greatest(t1 - greatest(t0, seen), 0.0)) AS share FROM {name}_v GROUP BY {keys}, line_id),
      {name} AS (SELECT {of}, a.line_id, coalesce(z.share, 0.0) AS share FROM {a} a LEFT JOIN {name}_w z ON {on} AND a.line_id = z.line_id)"""


COARSE = "y AS (SELECT DISTINCT raster_id, CAST(floor(r / 2.0) AS BIGINT) AS r, CAST(floor(c / 2.0) AS BIGINT) AS c FROM fx_cells)"
TRUTH = "y AS (SELECT raster_id, r, c FROM fx_cells WHERE truth = 1)"


def _coarse(t):
    return t.fx_cells.select("raster_id", F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")).distinct()


def _truth(t):
    return t.fx_cells.where("truth = 1").select((F.col("raster_id") - 1).alias("region_id"), "r", "c")


def _conf(t):
    return t.fx_cells.select((F.col("raster_id") - 1).alias("region_id"), "r", "c", "conf")


# ---- thinning, tracing, vectorising ----


@query("c8_thin", f"WITH {COARSE}, {thin_sql('y')} SELECT raster_id, r, c FROM sk")
def _(t):
    return vectorise.thin(_coarse(t), ["raster_id"])


TRACED = f"""WITH RECURSIVE {COARSE}, {thin_sql('y')},
  e AS MATERIALIZED (SELECT a.raster_id, a.r, a.c, b.r AS r2, b.c AS c2, sqrt(o.dy * o.dy + o.dx * o.dx) AS len FROM sk a CROSS JOIN o JOIN sk b ON b.raster_id = a.raster_id AND b.r = a.r + o.dy AND b.c = a.c + o.dx),
  g AS MATERIALIZED (SELECT raster_id, r, c, count(*) AS d FROM e GROUP BY 1, 2, 3),
  w AS MATERIALIZED (SELECT e.raster_id, e.r * 100 + e.c AS u, e.r2 * 100 + e.c2 AS v, h.d AS d2 FROM e JOIN g ON g.raster_id = e.raster_id AND g.r = e.r AND g.c = e.c JOIN g h ON h.raster_id = e.raster_id AND h.r = e.r2 AND h.c = e.c2 WHERE g.d = 2),
  q AS (SELECT DISTINCT raster_id, u AS node, u AS root FROM w UNION SELECT q.raster_id, w.v, q.root FROM q JOIN w ON w.raster_id = q.raster_id AND w.u = q.node AND w.d2 = 2 WHERE q.root < w.v),
  k AS (SELECT raster_id, node, min(root) AS root FROM q GROUP BY 1, 2),
  x AS (SELECT k.raster_id, k.root FROM k JOIN w ON w.raster_id = k.raster_id AND w.u = k.node GROUP BY 1, 2 HAVING max(CASE WHEN w.d2 <> 2 THEN 1 ELSE 0 END) = 0),
  rings AS (SELECT raster_id, count(*) AS n FROM x GROUP BY 1),
  tot AS (SELECT raster_id, count(*) / 2 AS edges, sum(len) / 2 AS length FROM e GROUP BY 1),
  ends AS (SELECT raster_id, sum(CASE WHEN d <> 2 THEN d ELSE 0 END) / 2 AS n FROM g GROUP BY 1)"""


@query("d2_trace", TRACED + """
  SELECT tot.raster_id, CAST(ends.n + coalesce(rings.n, 0) AS BIGINT) AS n_lines, CAST(edges AS BIGINT) AS n_edges, round(length, 6) AS length FROM tot JOIN ends USING (raster_id) LEFT JOIN rings USING (raster_id)""")
def _(t):
    lines = vectorise.trace(vectorise.thin(_coarse(t), ["raster_id"]), ["raster_id"])
    return lines.groupBy("raster_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.size("coords") - 1).alias("n_edges"), F.round(F.sum(vectorise.line_length(F.col("coords"))), 6).alias("length")
    )


@query("d2_trace_vertices", TRACED + """
  SELECT tot.raster_id, CAST(ends.n + coalesce(rings.n, 0) AS BIGINT) AS n_lines, CAST(edges + ends.n + coalesce(rings.n, 0) AS BIGINT) AS n_vertices, round(length, 6) AS length FROM tot JOIN ends USING (raster_id) LEFT JOIN rings USING (raster_id)""")
def _(t):
    v = vectorise.trace_vertices(vectorise.thin(_coarse(t), ["raster_id"]), ["raster_id"], 16)
    w = Window.partitionBy("raster_id", "line_id").orderBy("k")
    step = F.sqrt(F.pow(F.col("r") - F.lag("r").over(w), 2) + F.pow(F.col("c") - F.lag("c").over(w), 2))
    v = v.withColumn("step", step)
    return v.groupBy("raster_id").agg(F.count(F.when(F.col("k") == 0, 1)).alias("n_lines"), F.count("*").alias("n_vertices"), F.round(F.sum("step"), 6).alias("length"))


@query("d3_simplify", """SELECT line_id, CASE WHEN sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) > 0 AND abs(y1 - y0) * 3 / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) > 2.0 THEN 3
  WHEN x1 = x0 AND y1 = y0 THEN 3 ELSE 2 END AS n FROM fx_lines""")
def _(t):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    mid = F.struct(((F.col("x0") + F.col("x1")) / 2 + 3).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return network.simplify(t.fx_lines.select("line_id", F.array(p("x0", "y0"), mid, p("x1", "y1")).alias("coords")), 2.0).select("line_id", F.size("coords").alias("n"))


def _vectorized(t, skeleton=None):
    mask = t.fx_cells.select("raster_id", "r", "c")
    return vectorise.vectorize(mask, t.fx_cells, ["raster_id"], 64, 64, 1.0, 1, 4, 6, 1.0, 6.0, skeleton=skeleton)


@query("d8_vectorize")
def _(t):
    return _vectorized(t).select("raster_id", "line_id", F.size("coords").alias("n_vertices"), "length_m", "confidence", "confidence_pct")


@query("d9_vectorize_stats")
def _(t):
    mask = t.fx_cells.select("raster_id", "r", "c")
    skeleton = vectorise.thin(cells.clean_mask(mask, ["raster_id"], 64, 64, 1, 4, 6), ["raster_id"])
    return vectorise.vectorize_stats(mask, skeleton, _vectorized(t, skeleton), ["raster_id"], 64, 64)


# ---- scores of networks ----

NEAR2 = "o2 AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4)"


def score_sql(net: str, skeleton: str, name: str, keys: str = "region_id") -> str:
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    near = lambda x: f"(SELECT DISTINCT {keys}, r + dy AS r, c + dx AS c FROM {x}, o2)"
    return f"""{name}_a AS (SELECT {of('s')}, count(*) AS truth_px, count(n.r) AS mt FROM {skeleton} s LEFT JOIN {near(net)} n ON {on('s', 'n')} AND s.r = n.r AND s.c = n.c GROUP BY {of('s')}),
      {name}_b AS (SELECT {of('s')}, count(*) AS network_px, count(n.r) AS mp FROM {net} s LEFT JOIN {near(skeleton)} n ON {on('s', 'n')} AND s.r = n.r AND s.c = n.c GROUP BY {of('s')}),
      {name}_c AS (SELECT {", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys.split(", "))}, coalesce(truth_px, 0) AS truth_px, coalesce(mt, 0) AS mt, coalesce(network_px, 0) AS network_px, coalesce(mp, 0) AS mp FROM {name}_a a FULL JOIN {name}_b b ON {on('a', 'b')}),
      {name} AS (SELECT {keys}, CASE WHEN truth_px > 0 THEN round(mt / truth_px, 4) ELSE 0.0 END AS completeness, CASE WHEN network_px > 0 THEN round(mp / network_px, 4) ELSE 0.0 END AS correctness,
        CASE WHEN truth_px + network_px - mp > 0 THEN round(mt / (truth_px + network_px - mp), 4) ELSE 0.0 END AS quality, truth_px, network_px FROM {name}_c)"""


TRUTH_SK = f"{TRUTH}, {thin_sql('y', 4)}, ts AS (SELECT raster_id - 1 AS region_id, r, c FROM sk)"


@query("g6_score_network", f"WITH {TRUTH_SK}, {NEAR2}, {burnt_sql(40)}, {score_sql('nt', 'ts', 's')} SELECT region_id, completeness, correctness, quality, truth_px, network_px FROM s")
def _(t):
    return vectorise.score_network(t.fx_lines, vectorise.thin(_truth(t), KEY), KEY, 40.0, 64, 64, 80.0)


@query("g7_edit_gain", f"""WITH {TRUTH_SK}, {NEAR2}, lp AS (SELECT *, 'all' AS part FROM fx_lines UNION ALL SELECT *, 'model' FROM fx_lines WHERE source = 'model'),
  tp AS (SELECT *, unnest(['all', 'model']) AS part FROM ts), {burnt_sql(40, lines='lp', keys='region_id, part')}, {score_sql('nt', 'tp', 's', 'region_id, part')}
  SELECT a.region_id, round(a.completeness - coalesce(m.completeness, 0), 4) AS gain_completeness, round(a.correctness - coalesce(m.correctness, 0), 4) AS gain_correctness, round(a.quality - coalesce(m.quality, 0), 4) AS gain_quality
  FROM s a LEFT JOIN s m ON m.region_id = a.region_id AND m.part = 'model' WHERE a.part = 'all'""")
def _(t):
    g = vectorise.edit_gain(t.fx_lines, vectorise.thin(_truth(t), KEY), KEY, 40.0, 64, 64, 80.0)
    return g.select("region_id", *[(F.col(c) + 0.0).alias(c) for c in g.columns[1:]])


@query("c16_axis_order_check", f"""WITH {burnt_sql(40)}, sh AS (SELECT DISTINCT raster_id - 1 AS region_id, r, c FROM fx_cells WHERE conf >= 0.5),
  x AS (SELECT region_id, r, c, max(a) AS a, max(b) AS b, max(s) AS s FROM (SELECT region_id, r, c, 1 AS a, NULL AS b, NULL AS s FROM nt UNION ALL SELECT region_id, c, r, NULL, 1, NULL FROM nt UNION ALL SELECT region_id, r, c, NULL, NULL, 1 FROM sh) GROUP BY 1, 2, 3),
  i AS (SELECT region_id, round(coalesce(count(CASE WHEN a = 1 AND s = 1 THEN 1 END) / nullif(count(CASE WHEN a = 1 OR s = 1 THEN 1 END), 0), 0.0), 6) AS iou,
    round(coalesce(count(CASE WHEN b = 1 AND s = 1 THEN 1 END) / nullif(count(CASE WHEN b = 1 OR s = 1 THEN 1 END), 0), 0.0), 6) AS iou_swapped FROM x GROUP BY 1)
  SELECT *, iou > iou_swapped AS right_order FROM i""")
def _(t):
    ship = t.fx_cells.where("conf >= 0.5").select((F.col("raster_id") - 1).alias("region_id"), "r", "c")
    return vectorise.axis_order_check(t.fx_lines, ship, KEY, 40.0, 64, 64)


EXPECTED = f"""{burnt_sql(40)}, o3 AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy * dy + dx * dx <= 1), cf AS (SELECT raster_id - 1 AS region_id, r, c, conf FROM fx_cells),
  bd AS (SELECT DISTINCT region_id, r + dy AS r, c + dx AS c FROM nt_all, o3), bh AS (SELECT bd.region_id, coalesce(sum(conf), 0.0) AS inside, count(*) AS n FROM bd LEFT JOIN cf ON cf.region_id = bd.region_id AND cf.r = bd.r AND cf.c = bd.c GROUP BY 1),
  bt2 AS (SELECT region_id, sum(conf) AS total FROM cf GROUP BY 1), ex AS (SELECT region_id, CASE WHEN n > 0 THEN inside / n ELSE 0.0 END AS p, CASE WHEN total > 0 THEN inside / total ELSE 0.0 END AS r FROM bh JOIN bt2 USING (region_id))"""


@query("g9_expected_scores", f"WITH {EXPECTED} SELECT region_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM ex")
def _(t):
    s = network.expected_scores(t.fx_lines, _conf(t), KEY, 40.0, 1.0)
    return s.select("region_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# ---- the edited network ----

PARTS = "am AS (SELECT * FROM fx_lines WHERE source = 'model'), zh AS (SELECT * FROM fx_lines WHERE source = 'human')"


@query("f6_share_along", f"WITH {PARTS}, {share_sql('sh', 'am', 'zh', 4)} SELECT region_id, line_id, round(share, 6) AS share FROM sh")
def _(t):
    s = t.fx_lines
    return share_along(s.where("source = 'model'"), s.where("source = 'human'"), KEY).withColumn("share", F.round("share", 6))


# model: two of three lines; human: one of three, moved a little; deleted: one of seventeen
ROLE = """ml AS (SELECT region_id, line_id, x0, y0, x1, y1 FROM fx_lines WHERE line_id % 3 <> 0), dl AS (SELECT region_id, line_id, x0, y0, x1, y1 FROM fx_lines WHERE line_id % 17 = 0),
  hl AS (SELECT region_id, line_id, x0 + 1.25 + line_id % 5 AS x0, y0 + 0.5 AS y0, x1 + 0.75 AS x1, y1 + line_id % 4 AS y1 FROM fx_lines WHERE line_id % 3 = 0),
  bl AS (SELECT *, 'model' AS status FROM ml UNION ALL SELECT *, 'human' FROM hl)"""
MERGED = f"""{ROLE}, fe AS (SELECT region_id, line_id, 0 AS e, x0 AS x, y0 AS y FROM hl UNION ALL SELECT region_id, line_id, 1, x1, y1 FROM hl),
  fp AS (SELECT fe.*, s.line_id AS other_id, s.x0, s.y0, s.x1, s.y1, s.x1 - s.x0 AS dx, s.y1 - s.y0 AS dy FROM fe JOIN bl s ON s.region_id = fe.region_id AND s.line_id <> fe.line_id
    AND x BETWEEN least(s.x0, s.x1) - 3 AND greatest(s.x0, s.x1) + 3 AND y BETWEEN least(s.y0, s.y1) - 3 AND greatest(s.y0, s.y1) + 3),
  fq AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN dx * dx + dy * dy > 0 THEN ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy) ELSE 0.0 END)) AS t FROM fp),
  fd AS (SELECT *, sqrt(pow(x - x0 - t * dx, 2) + pow(y - y0 - t * dy, 2)) AS d, sqrt(dx * dx + dy * dy) AS len FROM fq),
  fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id, line_id, e ORDER BY d, other_id) AS k FROM fd WHERE d <= 3.0) WHERE k = 1),
  fw AS MATERIALIZED (SELECT region_id, line_id, e, other_id, CASE WHEN t * len <= 3 THEN x0 WHEN (1 - t) * len <= 3 THEN x1 ELSE x0 + t * dx END AS sx, CASE WHEN t * len <= 3 THEN y0 WHEN (1 - t) * len <= 3 THEN y1 ELSE y0 + t * dy END AS sy,
    CASE WHEN t * len > 3 AND (1 - t) * len > 3 THEN t * len END AS cut FROM fs),
  fl AS MATERIALIZED (SELECT b.region_id, b.line_id, b.status, coalesce(p.sx, b.x0) AS x0, coalesce(p.sy, b.y0) AS y0, coalesce(q.sx, b.x1) AS x1, coalesce(q.sy, b.y1) AS y1, CASE WHEN p.line_id IS NULL THEN 0 ELSE 1 END + CASE WHEN q.line_id IS NULL THEN 0 ELSE 1 END AS snapped
    FROM bl b LEFT JOIN fw p ON b.status = 'human' AND p.region_id = b.region_id AND p.line_id = b.line_id AND p.e = 0 LEFT JOIN fw q ON b.status = 'human' AND q.region_id = b.region_id AND q.line_id = b.line_id AND q.e = 1),
  fc AS (SELECT f.region_id, f.line_id, f.len, list_sort(list(w.cut)) AS cuts FROM (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM fl) f JOIN fw w ON w.region_id = f.region_id AND w.other_id = f.line_id
    WHERE w.cut >= 0.5 AND w.cut <= f.len - 0.5 GROUP BY 1, 2, 3),
  fk AS (SELECT region_id, line_id, list_reduce(list_prepend([-1e18], list_transform(cuts, lambda z: [z])), lambda a, z: CASE WHEN z[1] - a[-1] >= 0.5 THEN list_concat(a, z) ELSE a END)[2:] AS kept FROM fc),
  fm AS (SELECT f.*, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len, list_concat(list_concat([0.0], coalesce(kept, [])), [sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))]) AS marks FROM fl f LEFT JOIN fk ON fk.region_id = f.region_id AND fk.line_id = f.line_id),
  fx AS (SELECT *, unnest(range(1, len(marks))) AS piece FROM fm),
  pc AS MATERIALIZED (SELECT region_id, line_id * 1000 + piece AS line_id, line_id AS own, piece, status, CASE WHEN piece = 1 THEN snapped ELSE 0 END AS snapped,
    x0 + (x1 - x0) * coalesce(marks[piece] / nullif(len, 0), 0) AS x0, y0 + (y1 - y0) * coalesce(marks[piece] / nullif(len, 0), 0) AS y0, x0 + (x1 - x0) * coalesce(marks[piece + 1] / nullif(len, 0), 0) AS x1, y0 + (y1 - y0) * coalesce(marks[piece + 1] / nullif(len, 0), 0) AS y1 FROM fx),
  pm AS (SELECT * FROM pc WHERE status = 'model'), ph AS (SELECT * FROM pc WHERE status = 'human'), {share_sql('sd', 'pm', 'dl', 4)}, {share_sql('su', 'pm', 'ph', 4)},
  mg AS MATERIALIZED (SELECT pc.*, CASE WHEN sd.share >= 0.6 THEN 'deleted' WHEN su.share >= 0.7 THEN 'superseded' ELSE pc.status END AS state FROM pc LEFT JOIN sd ON sd.region_id = pc.region_id AND sd.line_id = pc.line_id AND pc.status = 'model' LEFT JOIN su ON su.region_id = pc.region_id AND su.line_id = pc.line_id AND pc.status = 'model')"""


def _merged(t):
    s = t.fx_lines.drop("source")
    k = F.col("line_id")
    moved = {"x0": F.col("x0") + 1.25 + k % 5, "y0": F.col("y0") + 0.5, "x1": F.col("x1") + 0.75, "y1": F.col("y1") + k % 4}
    return edits.merge_network(s.where("line_id % 3 <> 0"), s.where("line_id % 3 = 0").withColumns(moved), s.where("line_id % 17 = 0"), KEY)


@query("f7_merge_network", f"WITH {MERGED} SELECT region_id, own AS line_id, CAST(piece AS INTEGER) AS piece, state AS status, round(x0, 4) + 0.0 AS x0, round(y1, 4) + 0.0 AS y1 FROM mg")
def _(t):
    return _merged(t).select("region_id", "line_id", "piece", "status", (F.round("x0", 4) + 0.0).alias("x0"), (F.round("y1", 4) + 0.0).alias("y1"))


@query("f8_network_stats", f"""WITH {MERGED}, ln AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM mg),
  s AS (SELECT region_id, count(CASE WHEN state = 'model' THEN 1 END) AS n_model, count(CASE WHEN state = 'human' THEN 1 END) AS n_human, count(CASE WHEN state = 'deleted' THEN 1 END) AS n_deleted, count(CASE WHEN state = 'superseded' THEN 1 END) AS n_superseded,
    CAST(sum(snapped) AS BIGINT) AS n_snapped_ends, coalesce(sum(CASE WHEN state = 'model' THEN len END), 0.0) AS m, coalesce(sum(CASE WHEN state = 'human' THEN len END), 0.0) AS h FROM ln GROUP BY 1)
  SELECT region_id, n_model, n_human, n_deleted, n_superseded, n_snapped_ends, n_model + n_human AS n_features, round(m, 1) AS model_length_m, round(h, 1) AS human_length_m, round(m + h, 1) AS total_length_m, round((m + h) / 1000, 3) AS total_length_km,
    round(CASE WHEN m + h > 0 THEN h / (m + h) ELSE 0.0 END, 4) AS human_share FROM s""")
def _(t):
    return edits.network_stats(_merged(t), KEY)


GAPS = """e AS (SELECT region_id, line_id, 0 AS e, x0 AS x, y0 AS y, x1 AS bx, y1 AS by FROM fx_lines UNION ALL SELECT region_id, line_id, 1, x1, y1, x0, y0 FROM fx_lines),
  p AS (SELECT e.region_id, e.line_id, e.e, x, y, s.x0, s.y0, s.x1 - s.x0 AS dx, s.y1 - s.y0 AS dy FROM e JOIN fx_lines s ON s.region_id = e.region_id AND s.line_id <> e.line_id
    AND x BETWEEN least(s.x0, s.x1) - 5 AND greatest(s.x0, s.x1) + 5 AND y BETWEEN least(s.y0, s.y1) - 5 AND greatest(s.y0, s.y1) + 5),
  q AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN dx * dx + dy * dy > 0 THEN ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy) ELSE 0.0 END)) AS t FROM p),
  tch AS (SELECT DISTINCT region_id, line_id, e FROM q WHERE sqrt(pow(x - x0 - t * dx, 2) + pow(y - y0 - t * dy, 2)) <= 2.5),
  de AS MATERIALIZED (SELECT e.* FROM e ANTI JOIN tch k ON e.region_id = k.region_id AND e.line_id = k.line_id AND e.e = k.e),
  pr AS (SELECT a.region_id, a.line_id AS la, a.e AS ea, b.line_id AS lb, b.e AS eb, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, a.bx AS abx, a.by AS aby, b.bx AS bbx, b.by AS bby, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d
    FROM de a JOIN de b ON a.region_id = b.region_id AND a.line_id < b.line_id WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) > 2.5 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 150),
  al AS (SELECT *, greatest(coalesce(((x0 - abx) * (x1 - x0) + (y0 - aby) * (y1 - y0)) / nullif(sqrt(pow(x0 - abx, 2) + pow(y0 - aby, 2)) * d, 0), -1), coalesce(((x1 - bbx) * (x0 - x1) + (y1 - bby) * (y0 - y1)) / nullif(sqrt(pow(x1 - bbx, 2) + pow(y1 - bby, 2)) * d, 0), -1)) AS align FROM pr),
  lk AS MATERIALIZED (SELECT *, la || ':' || ea || ':' || lb || ':' || eb AS line_id FROM al WHERE align >= cos(radians(40.0))),
  md AS (SELECT region_id, line_id, x0 + (x1 - x0) * (8 / d) AS x0, y0 + (y1 - y0) * (8 / d) AS y0, x0 + (x1 - x0) * (1 - 8 / d) AS x1, y0 + (y1 - y0) * (1 - 8 / d) AS y1 FROM lk WHERE 8 / d < 0.5),
  ds AS (SELECT * FROM fx_lines WHERE line_id % 13 = 0)"""


@query("f9_suggest_gaps", f"""WITH {GAPS}, {share_sql('sa', 'md', 'fx_lines', 4)}, {share_sql('sb', 'lk', 'ds', 4)},
  ok AS (SELECT * FROM lk WHERE (region_id, line_id) NOT IN (SELECT (region_id, line_id) FROM sa WHERE share >= 0.5) AND (region_id, line_id) NOT IN (SELECT (region_id, line_id) FROM sb WHERE share >= 0.5)),
  vt AS (SELECT region_id, line_id, CAST(trunc(unnest([y0, y1]) / 40) AS BIGINT) AS r, CAST(trunc(unnest([x0, x1]) / 40) AS BIGINT) AS c FROM ok),
  sc AS (SELECT vt.region_id, line_id, avg(coalesce(conf, 0.0)) AS cf FROM vt LEFT JOIN fx_cells k ON k.raster_id = vt.region_id + 1 AND k.r = vt.r AND k.c = vt.c WHERE vt.r BETWEEN 0 AND 63 AND vt.c BETWEEN 0 AND 63 GROUP BY 1, 2)
  SELECT ok.region_id, la AS a, lb AS b, x0, y0, x1, y1, round(align + coalesce(cf, 0.0), 6) AS score FROM ok LEFT JOIN sc ON sc.region_id = ok.region_id AND sc.line_id = ok.line_id""")
def _(t):
    s = edits.suggest_gaps(t.fx_lines, _conf(t), t.fx_lines.where("line_id % 13 = 0"), KEY, 40.0, 64, 64, max_gap=150.0)
    return s.drop("confidence").withColumn("score", F.round("score", 6))


@query("f10_suggest_missed")
def _(t):
    s = edits.suggest_missed(_conf(t), t.fx_lines.where("line_id % 2 = 0"), t.fx_lines.where("line_id % 13 = 0"), KEY, 40.0, 64, 64, 0.25, 4, 6, 1, 160.0)
    return s.select("region_id", "line_id", "length_m", "confidence", "joined", F.round("score", 6).alias("score"))


@query("f12_suggestion_precision", f"""WITH sg AS (SELECT region_id, line_id, x0 + line_id % 7 AS x0, y0 + line_id % 4 AS y0, x1 + line_id % 7 AS x1, y1 + line_id % 4 AS y1, CASE WHEN line_id % 5 = 0 THEN 'gap' ELSE 'missed' END AS kind, (line_id * 31) % 997 AS score FROM fx_lines WHERE source = 'model'),
  {PARTS}, {share_sql('sh', 'sg', 'zh', 5)}, k AS (SELECT kind, CASE WHEN share >= 0.6 THEN 1 ELSE 0 END AS ok, row_number() OVER (PARTITION BY kind ORDER BY score DESC, sg.region_id, sg.line_id) AS n FROM sg JOIN sh ON sh.region_id = sg.region_id AND sh.line_id = sg.line_id)
  SELECT kind, count(*) AS n, round(avg(ok), 4) AS precision, round(avg(CASE WHEN n <= 20 THEN ok END), 4) AS precision_top FROM k GROUP BY kind""")
def _(t):
    k = F.col("line_id")
    s = t.fx_lines.where("source = 'model'").select(
        "region_id", "line_id", *[(F.col(c) + k % m).alias(c) for c, m in (("x0", 7), ("y0", 4), ("x1", 7), ("y1", 4))], F.when(k % 5 == 0, "gap").otherwise("missed").alias("kind"), (k * 31 % 997).alias("score")
    )
    return edits.suggestion_precision(s, t.fx_lines.where("source = 'human'"), KEY)


# ---- repairs ----


@query("d12_repair_snap", """WITH e AS (SELECT region_id, line_id, 0 AS e, x0 AS x, y0 AS y FROM fx_lines UNION ALL SELECT region_id, line_id, 1, x1, y1 FROM fx_lines),
  n AS (SELECT *, avg(x) OVER (PARTITION BY region_id, floor((x + 50) / 100), floor((y + 50) / 100)) AS mx, avg(y) OVER (PARTITION BY region_id, floor((x + 50) / 100), floor((y + 50) / 100)) AS my FROM e)
  SELECT region_id, line_id, round(max(CASE WHEN e = 0 THEN mx END), 4) AS x0, round(max(CASE WHEN e = 1 THEN my END), 4) AS y1 FROM n GROUP BY 1, 2""")
def _(t):
    s = edits.repair(t.fx_lines, KEY, "snap", 5.0)
    return s.select("region_id", "line_id", F.round("x0", 4).alias("x0"), F.round("y1", 4).alias("y1"))


@query("d12_repair_extend", """SELECT region_id, line_id, round(x0 - 5 * coalesce((x1 - x0) / nullif(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 0), 0), 4) + 0.0 AS x0, round(y1 + 5 * coalesce((y1 - y0) / nullif(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 0), 0), 4) + 0.0 AS y1 FROM fx_lines""")
def _(t):
    s = edits.repair(t.fx_lines, KEY, "extend", 5.0)
    return s.select("region_id", "line_id", (F.round("x0", 4) + 0.0).alias("x0"), (F.round("y1", 4) + 0.0).alias("y1"))


@query("d12_repair_report")
def _(t):
    return edits.repair_report(t.fx_lines, KEY, "rmdangle", 150.0)


# ---- candidates and the measure ----

LADDER = [("c1", 0.3), ("c2", 0.4), ("c3", 0.5), ("c4", 0.6), ("c5", 0.7)]
LADDER_SQL = "v AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', CAST({x} AS DOUBLE))" for i, x in LADDER) + ") u(variant_id, threshold))"


def _ladder(t):
    return t.fx_cells.sparkSession.createDataFrame(LADDER, "variant_id string, threshold double")


@query("i2_try_thresholds", f"""WITH {LADDER_SQL}, k AS (SELECT raster_id, variant_id, threshold, count(CASE WHEN conf > threshold AND truth = 1 THEN 1 END) AS tp, count(CASE WHEN conf > threshold THEN 1 END) AS p, count(CASE WHEN truth = 1 THEN 1 END) AS n FROM fx_cells, v GROUP BY 1, 2, 3),
  s AS (SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS pr, CASE WHEN n > 0 THEN tp / n ELSE 0.0 END AS rc FROM k), f AS (SELECT *, round(CASE WHEN 0.25 * pr + rc > 0 THEN 1.25 * pr * rc / (0.25 * pr + rc) ELSE 0.0 END, 4) AS score FROM s)
  SELECT raster_id, variant_id, threshold, round(pr, 4) AS precision, round(rc, 4) AS recall, score, CAST(row_number() OVER (PARTITION BY raster_id ORDER BY score DESC, variant_id) AS INTEGER) AS rank FROM f""")
def _(t):
    return edits.try_thresholds(t.fx_cells, _ladder(t), ["raster_id"], "precision")


@query("i2_try_candidates")
def _(t):
    return edits.try_candidates(_conf(t), vectorise.thin(_truth(t), KEY), _ladder(t), KEY, 1.0, 64, 64, "balanced", 1, 4, 6, 1.0, 6.0)


@query("i3_apply_candidate", "SELECT raster_id, r, c, CASE WHEN raster_id % 2 = 0 THEN 0.0 ELSE conf END AS conf FROM fx_cells WHERE raster_id % 2 = 1 OR conf > 0.5")
def _(t):
    live = t.fx_cells.select("raster_id", "r", "c", "conf")
    made = live.where("raster_id % 2 = 0").withColumn("conf", F.lit(0.0).cast(dict(live.dtypes)["conf"]))
    c = t.fx_cells.where("raster_id % 2 = 0")
    rows = [c.where(F.col("conf") > x).select("raster_id", "r", "c").withColumns({"conf": F.lit(0.0).cast(dict(made.dtypes)["conf"]), "variant_id": F.lit(i)}) for i, x in LADDER[1:3]]
    return edits.apply_candidate(live, rows[0].unionByName(rows[1]), "c3")


@query("i18_measure", f"""WITH {TRUTH_SK}, {NEAR2}, {EXPECTED}, tk AS (SELECT * FROM ts WHERE region_id % 2 = 0), nk AS (SELECT * FROM nt), {score_sql('nk', 'tk', 's')}, rg AS (SELECT DISTINCT region_id FROM ts),
  ln AS (SELECT region_id, count(*) AS n, round(sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) / 1000, 3) AS km FROM fx_lines GROUP BY 1), td AS (SELECT DISTINCT region_id FROM tk),
  m AS (SELECT rg.region_id, coalesce(n, 0) AS n_features, coalesce(km, 0.0) AS km, CASE WHEN n IS NULL THEN 'empty' WHEN td.region_id IS NOT NULL THEN 'ground truth' WHEN ex.p IS NOT NULL THEN 'expected' END AS basis, s.correctness, s.completeness, ex.p, ex.r
    FROM rg LEFT JOIN ln USING (region_id) LEFT JOIN td USING (region_id) LEFT JOIN s USING (region_id) LEFT JOIN ex USING (region_id)),
  z AS (SELECT region_id, n_features, km, basis, round(CASE basis WHEN 'empty' THEN 0.0 WHEN 'ground truth' THEN correctness ELSE p END, 4) AS precision, round(CASE basis WHEN 'empty' THEN 0.0 WHEN 'ground truth' THEN completeness ELSE r END, 4) AS recall FROM m WHERE basis IS NOT NULL)
  SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 4) AS score FROM z""")
def _(t):
    truth = vectorise.thin(_truth(t), KEY)
    # half a cell on each side of the line, so that the band is that of the expected scores above
    return edits.measure(t.fx_lines, truth, truth.where("region_id % 2 = 0"), _conf(t), KEY, 40.0, 64, 64, tolerance=80.0, half_width=1.0).drop("topology")


# ---- selection of regions ----


@query("h9_select_regions", """WITH f AS (SELECT idx, split, sha, CAST(floor(idx / 3.0) AS BIGINT) AS site FROM fx_files),
  g AS (SELECT sha, min(CASE WHEN split = 'train' THEN idx END) AS first, max(CASE WHEN split <> 'train' THEN 1 ELSE 0 END) AS held FROM f GROUP BY sha),
  pick AS (SELECT idx, site, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS total FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY idx) AS k FROM f WHERE split = 'test') WHERE k <= 1),
  it AS (SELECT idx, site FROM pick WHERE total <= 20 OR floor((pos + 1) * 20.0 / total) > floor(pos * 20.0 / total)),
  pool AS (SELECT f.idx, f.site FROM f JOIN g USING (sha) WHERE f.split = 'train' AND held = 0 AND idx = first AND f.site NOT IN (SELECT site FROM it)),
  pv AS (SELECT idx, site, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS total FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY idx) AS k FROM pool) WHERE k <= 4),
  prov AS (SELECT idx, site, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS n FROM pv WHERE total <= 80 OR floor((pos + 1) * 80.0 / total) > floor(pos * 80.0 / total)),
  st AS (SELECT CAST(round_even((n - 2) * i / 7.0, 0) AS BIGINT) AS s FROM (SELECT max(n) AS n FROM prov), range(1, 7) r(i)),
  vl AS (SELECT DISTINCT prov.idx, prov.site FROM prov JOIN st ON prov.pos BETWEEN s AND s + 1),
  wn AS (SELECT s, min(idx) - 5 AS lo, max(idx) + 5 AS hi FROM st JOIN prov ON prov.pos BETWEEN s AND s + 1 GROUP BY s),
  pt AS (SELECT idx, site FROM pool WHERE site NOT IN (SELECT site FROM vl) AND NOT EXISTS (SELECT 1 FROM wn WHERE pool.idx BETWEEN lo AND hi)),
  pk AS (SELECT idx, site, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS total, 80 - (SELECT count(*) FROM vl) AS n FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY idx) AS k FROM pt) WHERE k <= 4)
  SELECT idx, 'id_test' AS part FROM it UNION ALL SELECT idx, 'ft_val' FROM vl UNION ALL SELECT idx, 'ft_train' FROM pk WHERE total <= n OR floor((pos + 1) * CAST(n AS DOUBLE) / total) > floor(pos * CAST(n AS DOUBLE) / total)""")
def _(t):
    f = t.fx_files.withColumn("site", F.floor(F.col("idx") / 3))
    return curate.select_regions(f, n_ft=80, n_val=12, n_test=20, margin=5)


@query("h14_sample_windows", """WITH c AS (SELECT raster_id, r, c, truth FROM fx_cells), d AS (SELECT raster_id, i AS draw, k AS try FROM (SELECT DISTINCT raster_id FROM c), range(0, 4) a(i), range(0, 12) b(k)),
  h AS (SELECT *, ('0x' || md5(raster_id || ':' || draw || ':' || try || ':r')[1:8])::UBIGINT % 48 AS r0, ('0x' || md5(raster_id || ':' || draw || ':' || try || ':c')[1:8])::UBIGINT % 48 AS c0, ('0x' || md5(raster_id || ':' || draw || ':road')[1:8])::UBIGINT % 1000 < 850 AS want FROM d),
  s AS (SELECT h.raster_id, draw, try, r0, c0, want, count(CASE WHEN truth = 1 THEN 1 END) AS road, count(*) FILTER (c.r IS NOT NULL) AS nfull FROM h LEFT JOIN c ON c.raster_id = h.raster_id AND c.r BETWEEN r0 AND r0 + 15 AND c.c BETWEEN c0 AND c0 + 15 GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY raster_id, draw ORDER BY NOT (1 - nfull / 256.0 <= 0.85 AND (NOT want OR road > 0)), CASE WHEN 1 - nfull / 256.0 <= 0.85 AND (NOT want OR road > 0) THEN try ELSE -try END) AS n FROM s)
  SELECT raster_id, CAST(draw AS INTEGER) AS draw, CAST(r0 AS INTEGER) AS r0, CAST(c0 AS INTEGER) AS c0, road > 0 AS has_road FROM k WHERE n = 1""")
def _(t):
    return curate.sample_windows(t.fx_cells, ["raster_id"], draws=4, crop=16, height=64, width=64, max_blank=0.85)


# ---- sources and streams ----


def _path(t, name):
    return fresh_path(t.fx_files.sparkSession, name)


@query("a2_a3_features", "SELECT CAST(line_id AS VARCHAR) AS feature_id, x0, y1, source FROM fx_lines")
def _(t):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = t.fx_lines.select(F.col("line_id").cast("string").alias("feature_id"), "source", F.array(p("x0", "y0"), p("x1", "y1")).alias("coords"))
    path = _path(t, "features")
    tables.write_features(lines, path, lines.groupBy("source").agg(F.count("*").alias("n")))
    f = tables.read_features(lines.sparkSession, path, lines=True)
    return f.select("feature_id", F.col("coords")[0]["x"].alias("x0"), F.col("coords")[1]["y"].alias("y1"), F.get_json_object("properties", "$.source").alias("source"))


@query("a6_read_graph", "SELECT region_id, nr, nc, mr, mc FROM fx_graph")
def _(t):
    path = _path(t, "graph")
    tables.write_graph(t.fx_graph, path)
    return tables.read_graph(t.fx_graph.sparkSession, path)


@query("a7_read_job_logs", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS stage, count(*) AS n_stages FROM events WHERE event_id % 10 <> 3 GROUP BY user_id")
def _(t):
    # every tenth line is broken off
    row = F.to_json(F.struct(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("ts").cast("string").alias("at")))
    path = _path(t, "logs")
    t.events.select(F.when(F.col("event_id") % 10 == 3, F.substring(row, 1, 20)).otherwise(row).alias("value")).write.text(path)
    log = tables.read_job_logs(t.events.sparkSession, path, "job_id bigint, seq bigint, stage string, at string")
    return tables.latest_stage(log).drop("at")


@query("a8_chips_round_trip", "SELECT chip_id, mosaic_id, row_off, col_off, h, w FROM fx_chips")
def _(t):
    path = _path(t, "chips")
    tables.write_chips(t.fx_chips, path)
    return tables.read_chips(t.fx_chips.sparkSession, path).withColumn("mosaic_id", F.col("mosaic_id").cast("bigint"))


@query("a9_read_manifest", "SELECT idx, path, split AS set FROM fx_files WHERE split = 'val'")
def _(t):
    path = _path(t, "manifest")
    tables.write_manifest(t.fx_files.select("idx", "path", F.col("split").alias("set")), path)
    return tables.read_manifest(t.fx_files.sparkSession, path, "idx bigint, path string", "val")


@query("j5_stream_chips", CHIPCELLS + f"""SELECT mosaic_id, r, c, round(sum(v * wt) / sum(wt), 5) + 0.0 AS v FROM (SELECT *, {TAPER.format(x='i')} * {TAPER.format(x='j')} AS wt FROM cc) GROUP BY mosaic_id, r, c""")
def _(t):
    chips = t.fx_chips.join(t.embeddings.select(F.col("vec_id").alias("chip_id"), F.col("embedding").alias("data")), "chip_id").withColumn("version", F.lit(1))
    return trace.stream_chips(chips.unionByName(chips), ["mosaic_id"], 8, 2).withColumn("v", F.round("v", 5) + 0.0)


@query("j1_rebuilt_networks")
def _(t):
    model = t.fx_lines.select((F.col("region_id") + 1).alias("job_id"), "line_id", "x0", "y0", "x1", "y1")
    return trace.rebuilt(t.fx_edits, model).groupBy("job_id", "status").agg(F.count("*").alias("n"))
