"""Queries of the cell and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import cells, evaluate

SIX = lambda df, *names: df.withColumns({n: F.round(n, 6) for n in names})
SCORES = """round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END, 6) AS iou, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"""
SWEEP = """WITH t AS (SELECT unnest([CAST(0.05 AS DOUBLE), 0.25, 0.45, 0.65, 0.85]) AS threshold),
  s AS (SELECT raster_id, threshold, count(CASE WHEN conf >= threshold AND truth = 1 THEN 1 END) AS tp, count(CASE WHEN conf >= threshold AND truth = 0 THEN 1 END) AS fp,
        count(CASE WHEN conf < threshold AND truth = 1 THEN 1 END) AS fn FROM fx_cells, t GROUP BY raster_id, threshold)"""
T = [0.05, 0.25, 0.45, 0.65, 0.85]
MASK = "m AS (SELECT raster_id, r, c FROM fx_cells WHERE conf >= 0.9), y AS (SELECT raster_id, r, c FROM fx_cells WHERE truth = 1)"
DISK = "d AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4)"


def _pred(t):
    return cells.threshold(t.fx_cells, 0.9).select("raster_id", "r", "c")


def _truth(t):
    return t.fx_cells.where("truth = 1").select("raster_id", "r", "c")


@query("g3_sweep", SWEEP + f" SELECT raster_id, threshold, tp, fp, fn, {SCORES} FROM s")
def _(t):
    return SIX(evaluate.sweep(t.fx_cells, ["raster_id"], T), "iou", "precision", "recall", "f1")


@query("g4_sweep_best", SWEEP + f""", k AS (SELECT raster_id, threshold, tp, fp, fn, {SCORES} FROM s)
  SELECT raster_id, threshold, tp, fp, fn, iou, precision, recall, f1 FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY 2.0 * tp / greatest(2 * tp + fp + fn, 1) DESC, threshold) AS k FROM k) WHERE k = 1""")
def _(t):
    s = evaluate.sweep(t.fx_cells, ["raster_id"], T)
    best = evaluate.best_threshold(s.withColumn("key", F.lit(2.0) * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))), ["raster_id"], "key").drop("key")
    return SIX(best, "iou", "precision", "recall", "f1")


@query("g1_confusion", f"""WITH {MASK}, i AS (SELECT DISTINCT raster_id, r, c FROM fx_cells WHERE (r + c) % 5 = 0),
  p AS (SELECT * FROM m WHERE (r + c) % 5 <> 0), u AS (SELECT * FROM y WHERE (r + c) % 5 <> 0),
  k AS (SELECT coalesce(p.raster_id, u.raster_id) AS raster_id, count(CASE WHEN p.r IS NOT NULL AND u.r IS NOT NULL THEN 1 END) AS tp,
    count(CASE WHEN u.r IS NULL THEN 1 END) AS fp, count(CASE WHEN p.r IS NULL THEN 1 END) AS fn FROM p FULL JOIN u ON p.raster_id = u.raster_id AND p.r = u.r AND p.c = u.c GROUP BY 1)
  SELECT raster_id, tp, fp, fn, {SCORES} FROM k""")
def _(t):
    ignore = t.fx_cells.where("(r + c) % 5 = 0")
    return SIX(evaluate.confusion(_pred(t), _truth(t), ["raster_id"], ignore), "iou", "precision", "recall", "f1")


@query("g2_relaxed_scores", f"""WITH {MASK}, {DISK},
  md AS (SELECT DISTINCT raster_id, r + dy AS r, c + dx AS c FROM m, d), yd AS (SELECT DISTINCT raster_id, r + dy AS r, c + dx AS c FROM y, d),
  a AS (SELECT m.raster_id, count(yd.r) / count(*) AS p FROM m LEFT JOIN yd USING (raster_id, r, c) GROUP BY m.raster_id),
  b AS (SELECT y.raster_id, count(md.r) / count(*) AS q FROM y LEFT JOIN md USING (raster_id, r, c) GROUP BY y.raster_id),
  j AS (SELECT coalesce(a.raster_id, b.raster_id) AS raster_id, coalesce(p, 0.0) AS p, coalesce(q, 0.0) AS q FROM a FULL JOIN b ON a.raster_id = b.raster_id)
  SELECT raster_id, round(p, 6) AS relaxed_precision, round(q, 6) AS relaxed_recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS relaxed_f1 FROM j""")
def _(t):
    out = evaluate.relaxed_scores(_pred(t), _truth(t), ["raster_id"], 2)
    return SIX(out, "relaxed_precision", "relaxed_recall", "relaxed_f1")


@query("g5_evaluate_tiles", f"""WITH k AS (SELECT raster_id % 5 AS set_id, raster_id, count(CASE WHEN conf >= 0.9 AND truth = 1 THEN 1 END) AS tp, count(CASE WHEN conf >= 0.9 AND truth = 0 THEN 1 END) AS fp,
  count(CASE WHEN conf < 0.9 AND truth = 1 THEN 1 END) AS fn FROM fx_cells GROUP BY raster_id),
  s AS (SELECT set_id, raster_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k GROUP BY GROUPING SETS ((set_id, raster_id), (set_id)))
  SELECT set_id, raster_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {SCORES} FROM s""")
def _(t):
    s = evaluate.sweep(t.fx_cells, ["raster_id"], [0.9]).select((F.col("raster_id") % 5).alias("set_id"), "raster_id", "tp", "fp", "fn")
    return SIX(evaluate.evaluate_tiles(s, ["set_id"], "raster_id"), "iou", "precision", "recall", "f1")


@query("g8_f_beta", """SELECT task_id, step, round(CASE WHEN b * b * prec + rec = 0 THEN 0.0 ELSE (1 + b * b) * prec * rec / (b * b * prec + rec) END, 6) AS score
  FROM (SELECT *, CASE step % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 2.0 END AS b FROM fx_ledger)""")
def _(t):
    name = F.when(F.col("step") % 3 == 0, "balanced").when(F.col("step") % 3 == 1, "precision").otherwise("recall")
    return t.fx_ledger.select("task_id", "step", F.round(evaluate.f_beta(F.col("prec"), F.col("rec"), evaluate.beta_of(name)), 6).alias("score"))


@query("g10_judge_agreement", """WITH k AS (SELECT task_id, step AS variant, prec AS judge, rec AS truth FROM fx_ledger),
  r AS (SELECT *, rank() OVER (PARTITION BY task_id ORDER BY judge) + (count(*) OVER (PARTITION BY task_id, judge) - 1) / 2.0 AS rj,
        rank() OVER (PARTITION BY task_id ORDER BY truth) + (count(*) OVER (PARTITION BY task_id, truth) - 1) / 2.0 AS rt FROM k)
  SELECT task_id, round(corr(rj, rt), 6) + 0.0 AS spearman, arg_max(variant, judge * 1000 + variant * 0.000001) = arg_max(variant, truth * 1000 + variant * 0.000001) AS same_winner FROM r GROUP BY task_id HAVING count(*) > 2""")
def _(t):
    s = t.fx_ledger.select("task_id", F.col("step").alias("variant"), F.col("prec").alias("judge"), F.col("rec").alias("truth"))
    many = s.groupBy("task_id").count().where("count > 2")
    return evaluate.judge_agreement(s.join(many, "task_id", "left_semi"), ["task_id"]).withColumn("spearman", F.round("spearman", 6) + 0.0)


@query("g11_degrade", "SELECT raster_id, r, c FROM fx_cells WHERE truth = 1 AND (CAST(floor(r / 8.0) AS BIGINT) * 7919 + CAST(floor(c / 8.0) AS BIGINT) * 104729) % 100 >= 40")
def _(t):
    return evaluate.degrade(_truth(t), "erase", 0.4)


@query("g12_compare_models", """WITH k AS (SELECT raster_id % 4 AS set_id, m, count(CASE WHEN conf >= h AND truth = 1 THEN 1 END) AS tp, count(CASE WHEN (conf >= h AND truth = 0) OR (conf < h AND truth = 1) THEN 1 END) AS miss
    FROM fx_cells, (VALUES ('low', 0.3), ('high', 0.9)) v(m, h) GROUP BY 1, 2)
  SELECT set_id, round(max(CASE WHEN m = 'low' THEN tp / (tp + miss) END), 6) AS low, round(max(CASE WHEN m = 'high' THEN tp / (tp + miss) END), 6) AS high FROM k GROUP BY set_id""")
def _(t):
    s = evaluate.sweep(t.fx_cells, ["raster_id"], [0.3, 0.9]).select((F.col("raster_id") % 4).alias("set_id"), F.when(F.col("threshold") < 0.5, "low").otherwise("high").alias("m"), "tp", "fp", "fn")
    return SIX(evaluate.compare_models(s, "set_id", "m", ["low", "high"]), "low", "high")


@query("g13_stage_report", """SELECT job_id, seq, carried, best FROM (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 3 = 1 THEN value END AS score,
  last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER w AS carried, max(CASE WHEN event_id % 3 = 1 THEN value END) OVER w AS best FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE score IS NOT NULL""")
def _(t):
    k = F.col("event_id") % 3
    e = t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(k == 0, F.col("value")).alias("threshold"), F.when(k == 1, F.col("value")).alias("score"))
    return evaluate.stage_report(e, "job_id", "seq").select("job_id", "seq", "carried", "best")


@query("c1_threshold", "SELECT raster_id, r, c FROM fx_cells WHERE conf > 0.5")
def _(t):
    return cells.threshold(t.fx_cells, 0.5, ">").select("raster_id", "r", "c")


@query("c2_dilate", f"WITH {MASK}, {DISK} SELECT DISTINCT raster_id, r + dy AS r, c + dx AS c FROM m, d WHERE r + dy BETWEEN 0 AND 63 AND c + dx BETWEEN 0 AND 63")
def _(t):
    return evaluate.dilate(_pred(t), ["raster_id"], 2, "disk", 64, 64)


@query("c2_dilate_diamond", f"WITH {MASK}, d AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE abs(dy) + abs(dx) <= 2) SELECT DISTINCT raster_id, r + dy AS r, c + dx AS c FROM m, d WHERE r + dy BETWEEN 0 AND 63 AND c + dx BETWEEN 0 AND 63")
def _(t):
    return evaluate.dilate(_pred(t), ["raster_id"], 2, "diamond", 64, 64)


@query("c3_close", f"""WITH {MASK}, {DISK}, g AS (SELECT DISTINCT raster_id, r + dy AS r, c + dx AS c FROM m, d WHERE r + dy BETWEEN 0 AND 63 AND c + dx BETWEEN 0 AND 63),
  n AS (SELECT raster_id, r - dy AS r, c - dx AS c, count(*) AS n FROM g, d GROUP BY 1, 2, 3),
  i AS (SELECT a.r AS r, b.c AS c, count(*) AS want FROM range(0, 64) a(r), range(0, 64) b(c), d WHERE a.r + dy BETWEEN 0 AND 63 AND b.c + dx BETWEEN 0 AND 63 GROUP BY 1, 2)
  SELECT raster_id, n.r, n.c FROM n JOIN i ON n.r = i.r AND n.c = i.c WHERE n = want""")
def _(t):
    return cells.close(_pred(t), ["raster_id"], 2, 64, 64)


@query("c9_distance_within", f"WITH {MASK}, d AS (SELECT dy, dx FROM range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx <= 3.5 * 3.5) SELECT raster_id, r + dy AS r, c + dx AS c, CAST(min(dy * dy + dx * dx) AS INTEGER) AS d2 FROM m, d GROUP BY 1, 2, 3")
def _(t):
    return cells.distance_within(_pred(t), ["raster_id"], 3.5)


@query("c10_rasterize_lines", """WITH s AS (SELECT line_id, x0 + 3.1 AS x0, y0 + 2.3 AS y0, x1 + 1.7 - (x0 + 3.1) AS dx, y1 + 5.9 - (y0 + 2.3) AS dy FROM fx_lines),
  t AS (SELECT line_id, x0, y0, dx, dy, 0.0 AS t FROM s UNION ALL SELECT line_id, x0, y0, dx, dy, 1.0 FROM s
    UNION ALL SELECT line_id, x0, y0, dx, dy, (i * 10.0 - x0) / dx FROM s, range(-20, 280) g(i) WHERE dx <> 0 AND i * 10.0 BETWEEN least(x0, x0 + dx) AND greatest(x0, x0 + dx)
    UNION ALL SELECT line_id, x0, y0, dx, dy, (i * 10.0 - y0) / dy FROM s, range(-20, 280) g(i) WHERE dy <> 0 AND i * 10.0 BETWEEN least(y0, y0 + dy) AND greatest(y0, y0 + dy)),
  m AS (SELECT *, (t + lead(t) OVER (PARTITION BY line_id ORDER BY t)) / 2 AS mid FROM (SELECT DISTINCT * FROM t))
  SELECT DISTINCT line_id, CAST(floor((y0 + mid * dy) / 10.0) AS BIGINT) AS r, CAST(floor((x0 + mid * dx) / 10.0) AS BIGINT) AS c FROM m WHERE mid IS NOT NULL""")
def _(t):
    s = t.fx_lines.select("line_id", (F.col("x0") + 3.1).alias("x0"), (F.col("y0") + 2.3).alias("y0"), (F.col("x1") + 1.7).alias("x1"), (F.col("y1") + 5.9).alias("y1"))
    return cells.rasterize_lines(s, ["line_id"], 10.0)


@query("c11_run_width", f"""WITH {MASK}, h AS (SELECT raster_id, r AS k, c - row_number() OVER (PARTITION BY raster_id, r ORDER BY c) AS g FROM y),
  v AS (SELECT raster_id, c AS k, r - row_number() OVER (PARTITION BY raster_id, c ORDER BY r) AS g FROM y),
  n AS (SELECT raster_id, n AS width, count(*) AS f FROM (SELECT raster_id, count(*) AS n FROM h GROUP BY raster_id, k, g UNION ALL SELECT raster_id, count(*) FROM v GROUP BY raster_id, k, g) GROUP BY 1, 2)
  SELECT raster_id, width FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY f DESC, width) AS k FROM n) WHERE k = 1""")
def _(t):
    return cells.run_width(_truth(t), ["raster_id"])


@query("c12_max_instance", """WITH k AS (SELECT l_suppkey AS raster_id, l_linenumber AS instance, l_partkey % 64 AS r, l_orderkey % 64 AS c, l_linenumber / 10.0 AS score FROM lineitem),
  b AS (SELECT raster_id, instance FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY score DESC, instance) AS n FROM (SELECT DISTINCT raster_id, instance, score FROM k)) WHERE n <= 3)
  SELECT raster_id, r, c, max(score) AS v, CAST(3 AS BIGINT) AS n_instances FROM k SEMI JOIN b USING (raster_id, instance) GROUP BY raster_id, r, c""")
def _(t):
    k = t.lineitem.select(F.col("l_suppkey").alias("raster_id"), F.col("l_linenumber").alias("instance"), (F.col("l_partkey") % 64).alias("r"), (F.col("l_orderkey") % 64).alias("c"), (F.col("l_linenumber") / 10.0).alias("score"))
    return cells.max_instance(k, ["raster_id"], 3)


@query("c13_coverage", "SELECT raster_id, round(count(CASE WHEN conf > 0 THEN 1 END) / 4096.0, 6) AS coverage FROM fx_cells GROUP BY raster_id")
def _(t):
    return SIX(cells.coverage(t.fx_cells, ["raster_id"], 4096, "conf"), "coverage")


@query("c14_resample", "SELECT raster_id, CAST(floor(r / 4.0) AS BIGINT) AS r, CAST(floor(c / 4.0) AS BIGINT) AS c, round(sum(conf) / 16, 6) AS conf FROM fx_cells GROUP BY 1, 2, 3")
def _(t):
    return SIX(cells.resample(t.fx_cells, ["raster_id"], 4, "conf"), "conf")


@query("c15_cell_iou", f"WITH {MASK} SELECT raster_id, round(count(CASE WHEN n = 2 THEN 1 END) / count(*), 6) AS iou FROM (SELECT raster_id, r, c, count(*) AS n FROM (SELECT * FROM m UNION ALL SELECT * FROM y) GROUP BY 1, 2, 3) GROUP BY raster_id")
def _(t):
    return SIX(cells.cell_iou(_pred(t), _truth(t), ["raster_id"]), "iou")


CC8 = """o AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
  e AS MATERIALIZED (SELECT a.raster_id, a.r * 64 + a.c AS u, b.r * 64 + b.c AS v FROM y a CROSS JOIN o JOIN y b ON b.raster_id = a.raster_id AND b.r = a.r + dy AND b.c = a.c + dx),
  q AS (SELECT raster_id, u AS node, u AS root FROM e WHERE u = v UNION SELECT q.raster_id, e.v, q.root FROM q JOIN e ON e.raster_id = q.raster_id AND e.u = q.node WHERE q.root < e.v),
  k AS MATERIALIZED (SELECT raster_id, node, min(root) AS root FROM q GROUP BY 1, 2), z AS (SELECT raster_id, root, count(*) AS n FROM k GROUP BY 1, 2)"""


@query("c4_label_components", f"WITH RECURSIVE y AS (SELECT raster_id, r, c FROM fx_cells WHERE truth = 1), {CC8} SELECT raster_id, n, count(*) AS components FROM z GROUP BY 1, 2")
def _(t):
    lab = cells.label_components(_truth(t), ["raster_id"], 8)
    return lab.groupBy("raster_id", "label").agg(F.count("*").alias("n")).groupBy("raster_id", "n").agg(F.count("*").alias("components"))


@query("c6_drop_small", f"WITH RECURSIVE y AS (SELECT raster_id, r, c FROM fx_cells WHERE truth = 1), {CC8} SELECT raster_id, node // 64 AS r, node % 64 AS c FROM k JOIN z USING (raster_id, root) WHERE n >= 5")
def _(t):
    return cells.drop_small(_truth(t), ["raster_id"], 5)


# clear cells of the raster, in pieces of four neighbours, by numbers of cells
HOLES = """cl AS MATERIALIZED (SELECT i.raster_id, g.v FROM (SELECT DISTINCT raster_id FROM y) i, range(0, 4096) g(v) WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.raster_id = i.raster_id AND y.r = g.v // 64 AND y.c = g.v % 64)),
  ce AS MATERIALIZED (SELECT a.raster_id, a.v AS u, b.v FROM cl a JOIN cl b ON b.raster_id = a.raster_id AND (b.v = a.v + 64 OR b.v = a.v - 64 OR (b.v = a.v + 1 AND b.v % 64 <> 0) OR (b.v = a.v - 1 AND a.v % 64 <> 0))),
  cq AS (SELECT raster_id, v AS node, v AS other, 1 AS depth FROM cl UNION SELECT cq.raster_id, cq.node, ce.v, cq.depth + 1 FROM cq JOIN ce ON ce.raster_id = cq.raster_id AND ce.u = cq.other WHERE cq.depth < 6),
  ch AS (SELECT raster_id, node FROM (SELECT raster_id, node, count(DISTINCT other) AS n FROM cq GROUP BY 1, 2) WHERE n < 6)"""


@query("c5_fill_holes", f"WITH RECURSIVE y AS (SELECT DISTINCT raster_id, r // 2 * 2 + dy AS r, c // 2 * 2 + dx AS c FROM fx_cells, range(0, 2) a(dy), range(0, 2) b(dx)), {HOLES} SELECT raster_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM y UNION SELECT raster_id, node // 64, node % 64 FROM ch")
def _(t):
    # pairs of rows and columns alike, so that there are holes of four cells
    at = t.fx_cells.select("raster_id", (F.floor(F.col("r") / 2) * 2).alias("r"), (F.floor(F.col("c") / 2) * 2).alias("c"))
    four = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in (0, 1) for x in (0, 1)])
    mask = at.select("raster_id", "r", "c", F.inline(four)).select("raster_id", (F.col("r") + F.col("dy")).alias("r"), (F.col("c") + F.col("dx")).alias("c"))
    return cells.fill_holes(mask, ["raster_id"], 6, 64, 64)


@query("c7_clean_mask")
def _(t):
    return cells.clean_mask(_truth(t), ["raster_id"], 64, 64, 1, 6, 4)
