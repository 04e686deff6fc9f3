"""Queries of the dataset and ledger operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import curate, ledger
from netgrid.streaming.trace import ordered_ledger, stream_ledger

BEST = """WITH RECURSIVE s AS (SELECT task_id, step, prec, rec, version, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS score FROM fx_ledger),
  f AS (SELECT task_id, step, score AS best, version AS ver, true AS is_best FROM s WHERE step = 1
    UNION ALL SELECT s.task_id, s.step, CASE WHEN s.version = f.ver AND s.score > f.best + 0.003 THEN s.score ELSE f.best END, CASE WHEN s.version = f.ver AND s.score > f.best + 0.003 THEN s.version ELSE f.ver END,
      s.version = f.ver AND s.score > f.best + 0.003 FROM f JOIN s ON s.task_id = f.task_id AND s.step = f.step + 1),
  b AS (SELECT s.*, is_best FROM s JOIN f USING (task_id, step)),
  p AS (SELECT *, step > 2 AND max(CASE WHEN is_best THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY step ROWS 1 PRECEDING) = 0 AS plateau FROM b)
"""


def _best(t):
    return ledger.plateau(ledger.running_best(ledger.with_score(t.fx_ledger, F.lit("balanced"))))


@query("h1_exact_duplicates", "SELECT sha, array_to_string(list(idx ORDER BY idx), ',') AS ids FROM (SELECT DISTINCT sha, idx FROM fx_files WHERE split = 'train') GROUP BY sha HAVING count(*) > 1")
def _(t):
    return curate.exact_duplicates(t.fx_files.where("split = 'train'")).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("h2_official_split", """SELECT idx, CASE WHEN idx BETWEEN 0 AND 2374 THEN 'train' WHEN idx BETWEEN 2375 AND 2713 THEN 'val' WHEN idx BETWEEN 2714 AND 3337 THEN 'in_domain_test' END AS split,
  printf('shard_%02d/gs_%04d', CAST(floor(idx / 100.0) AS BIGINT), idx) AS path FROM (SELECT p_partkey * 3 AS idx FROM part)""")
def _(t):
    i = (F.col("p_partkey") * 3).alias("idx")
    return t.part.select(i).select("idx", curate.official_split(F.col("idx")).alias("split"), curate.shard_path(F.col("idx")).alias("path"))


@query("h3_range_lookup", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'a' WHEN p_size BETWEEN 15 AND 30 THEN 'b' END AS city FROM part")
def _(t):
    return t.part.select("p_partkey", curate.range_lookup(F.col("p_size"), ((1, 10, "a"), (15, 30, "b"))).alias("city"))


@query("h4_graph_edges", """SELECT DISTINCT region_id, CASE WHEN swap THEN mr ELSE nr END AS r, CASE WHEN swap THEN mc ELSE nc END AS c, CASE WHEN swap THEN nr ELSE mr END AS r2, CASE WHEN swap THEN nc ELSE mc END AS c2
  FROM (SELECT *, nr > mr OR (nr = mr AND nc > mc) AS swap FROM fx_graph WHERE nr <> mr OR nc <> mc)""")
def _(t):
    return curate.graph_edges(t.fx_graph)


PRINTS = """WITH o AS (SELECT DISTINCT region_id, nr, nc, mr - nr AS dr, mc - nc AS dc FROM fx_graph),
  n AS (SELECT region_id, nr, nc, string_agg(dr || ',' || dc, ';' ORDER BY dr, dc) AS key FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 3),
  p AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY region_id, key) AS k FROM n) WHERE k = 1)
"""


@query("h5_junction_fingerprints", PRINTS + "SELECT region_id, nr, nc, key FROM p")
def _(t):
    return curate.junction_fingerprints(t.fx_graph)


@query("h6_link_regions", PRINTS + """, v AS (SELECT a.region_id AS a, b.region_id AS b, b.nr - a.nr AS dr, b.nc - a.nc AS dc, count(*) AS votes FROM p a JOIN p b ON a.key = b.key AND a.region_id < b.region_id
    WHERE a.key IN (SELECT key FROM p GROUP BY key HAVING count(DISTINCT region_id) <= 50) GROUP BY 1, 2, 3, 4)
  SELECT a, b, dr, dc, votes FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY votes DESC, dr, dc) AS k FROM v WHERE votes >= 1) WHERE k = 1""")
def _(t):
    return curate.link_regions(curate.junction_fingerprints(t.fx_graph), min_votes=1)


@query("h7_site_groups", "SELECT idx, min(idx) OVER (PARTITION BY sha) AS site FROM fx_files")
def _(t):
    return curate.site_groups(t.fx_files.select("idx"), curate.duplicate_links(t.fx_files))


@query("h8_spread_pick", """WITH s AS (SELECT idx, sha, row_number() OVER (PARTITION BY sha ORDER BY idx) AS k FROM fx_files), q AS (SELECT idx, sha AS site, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS total FROM s WHERE k <= 1)
  SELECT idx, site FROM q WHERE floor((pos + 1) * 40.0 / total) > floor(pos * 40.0 / total)""")
def _(t):
    return curate.spread_pick(t.fx_files.select("idx", F.col("sha").alias("site")), 40, 1)


@query("h10_leakage_report", "SELECT f.idx, f.sha, also_in FROM fx_files f JOIN (SELECT sha, string_agg(DISTINCT split, ',' ORDER BY split) AS also_in FROM fx_files WHERE split <> 'train' GROUP BY sha) USING (sha) WHERE f.split = 'train'")
def _(t):
    return curate.leakage_report(t.fx_files)


@query("h10_sites_across_splits", "SELECT sha AS site, count(DISTINCT split) AS n_splits, count(*) AS n FROM fx_files GROUP BY sha HAVING count(DISTINCT split) > 1")
def _(t):
    return curate.sites_across_splits(t.fx_files.withColumnRenamed("sha", "site"))


@query("h11_stride_sample", """WITH p AS (SELECT tile_id, road_fraction, row_number() OVER (ORDER BY road_fraction, tile_id) - 1 AS pos, count(*) OVER () AS total FROM fx_tiles WHERE road_fraction BETWEEN 0.02 AND 0.18)
  SELECT tile_id, road_fraction, CAST(pos AS INTEGER) AS pos FROM p WHERE pos IN (SELECT least(CAST(floor(i * (SELECT max(total) FROM p) / 25.0) AS BIGINT), (SELECT max(total) FROM p) - 1) FROM range(0, 25) g(i))""")
def _(t):
    return curate.stride_sample(t.fx_tiles, 25).select("tile_id", "road_fraction", "pos")


@query("h12_split_exact", "SELECT idx, row_number() OVER (ORDER BY md5('0:' || CAST(idx AS VARCHAR)), idx) <= (SELECT greatest(1, CAST(floor(count(*) * CAST(0.15 AS DOUBLE)) AS BIGINT)) FROM fx_files) AS held FROM fx_files")
def _(t):
    return curate.split_exact(t.fx_files.select("idx"), 0.15, "idx")


@query("h13_mix_weights", "SELECT idx, split, round((CASE split WHEN 'train' THEN 0.3 ELSE 0.7 END) / count(*) OVER (PARTITION BY split), 8) AS weight FROM fx_files WHERE split <> 'test'")
def _(t):
    return curate.mix_weights(t.fx_files.select("idx", "split"), "split", {"train": 0.3, "val": 0.7}).withColumn("weight", F.round("weight", 8))


@query("h15_region_manifest", """SELECT tile_id AS id, CASE WHEN tile_id % 3 = 0 THEN 'val' ELSE 'train' END AS set, CASE WHEN tile_id % 2 = 0 AND tile_id % 3 = 0 THEN -1.0 ELSE road_fraction END AS road_fraction FROM fx_tiles""")
def _(t):
    sel = t.fx_tiles.select(F.col("tile_id").alias("id"), F.when(F.col("tile_id") % 3 == 0, "val").otherwise("train").alias("set"))
    old = t.fx_tiles.where("tile_id % 2 = 0").select(F.col("tile_id").alias("id"), F.lit("val").alias("set"), F.lit(-1.0).alias("road_fraction"))
    return curate.region_manifest(sel, t.fx_tiles.select(F.col("tile_id").alias("id"), "road_fraction"), old).select("id", "set", "road_fraction")


@query("i1_normalise_variants", """WITH v AS (SELECT p_partkey % 40 AS k, min(p_partkey) AS variant_id FROM part GROUP BY 1),
  w AS (SELECT variant_id, k, CASE k % 4 WHEN 0 THEN 'threshold=' || printf('%.4f', (k % 10) / 10.0) WHEN 1 THEN 'close_radius=' || printf('%.4f', round_even(k / 2.0, 0)) || ';threshold=0.5000' WHEN 2 THEN 'threshold=0.5000' END AS s FROM v),
  e AS (SELECT variant_id, k, CASE WHEN k % 4 = 3 THEN 'unknown: thresh' WHEN k % 4 = 1 AND round_even(k / 2.0, 0) > 10 THEN 'out of range: close_radius' END AS error, s FROM w),
  r AS (SELECT *, CASE WHEN error IS NULL THEN s END AS settings, row_number() OVER (PARTITION BY CASE WHEN error IS NULL THEN s END ORDER BY variant_id) AS n FROM e)
  SELECT variant_id, settings, error FROM r WHERE error IS NOT NULL OR n = 1""")
def _(t):
    k = F.col("k")
    v = t.part.groupBy((F.col("p_partkey") % 40).alias("k")).agg(F.min("p_partkey").alias("variant_id"))
    s = F.when(k % 4 == 0, F.create_map(F.lit("thr"), ((k % 10) / 10).cast("string"))).when(k % 4 == 1, F.create_map(F.lit("close_radius"), (k / 2).cast("string"))).when(k % 4 == 3, F.create_map(F.lit("thresh"), F.lit("0.4"))).otherwise(F.create_map().cast("map<string,string>"))
    return ledger.normalise_variants(v.select("variant_id", s.alias("settings")))


@query("i4_running_best", BEST + "SELECT task_id, step, round(score, 6) AS score, is_best FROM b")
def _(t):
    return _best(t).select("task_id", "step", F.round("score", 6).alias("score"), "is_best")


@query("i5_plateau", BEST + "SELECT task_id, step, plateau FROM p")
def _(t):
    return _best(t).select("task_id", "step", "plateau")


@query("i6_i10_task_state", BEST + """, l AS (SELECT task_id, arg_max(score, step) AS ls, arg_max(prec, step) AS lp, arg_max(rec, step) AS lr, arg_max(plateau, step) AS pl, count(*) AS n,
    max(CASE WHEN is_best THEN step END) AS best_step, arg_max(score, CASE WHEN is_best THEN step END) AS bs FROM p GROUP BY task_id),
  x AS (SELECT *, ls < bs - 0.003 AS worse, lp >= 0.5 AND lr >= 0.4 AS met FROM l)
  SELECT task_id, n, best_step, worse, met, concat_ws(',', CASE WHEN worse THEN 'worse_than_best' END, CASE WHEN NOT met THEN 'targets' END, CASE WHEN NOT pl THEN 'no_plateau' END) AS unmet,
    CASE WHEN met AND NOT worse THEN 'complete' WHEN pl THEN 'best_effort' ELSE 'incomplete' END AS verdict FROM x""")
def _(t):
    return ledger.task_state(_best(t), 0.5, 0.4)


@query("i7_budget_use", "SELECT user_id AS job_id, event_type AS tool, count(CASE WHEN value > 20 THEN 1 END) AS used, greatest(CASE event_type WHEN 'click' THEN 8 ELSE 4 END - count(CASE WHEN value > 20 THEN 1 END), 0) AS \"left\" FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def _(t):
    c = t.events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("tool"), (F.col("value") > 20).alias("ok"))
    return ledger.budget_use(c, {"click": 8, "view": 4})


@query("i7_repeat_calls", "SELECT job_id, call_id, tool, nth, nth > CASE WHEN tool = 'click' THEN 1 ELSE 2 END AS refused FROM (SELECT *, count(*) OVER (PARTITION BY job_id, tool ORDER BY call_id ROWS UNBOUNDED PRECEDING) AS nth FROM fx_trace WHERE type = 'tool_call')")
def _(t):
    c = t.fx_trace.where("type = 'tool_call'")
    return ledger.repeat_calls(c, ["job_id", "tool"], "call_id", F.when(F.col("tool") == "click", 1).otherwise(2)).select("job_id", "call_id", "tool", "nth", "refused")


@query("i8_rescore", "WITH s AS (SELECT *, CASE WHEN 0.25 * prec + rec = 0 THEN 0.0 ELSE 1.25 * prec * rec / (0.25 * prec + rec) END AS score FROM fx_ledger), l AS (SELECT task_id, arg_max(version, step) AS v FROM s GROUP BY task_id) SELECT task_id, step, round(score, 6) AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.task_id ORDER BY round(score, 9) DESC, step) AS k FROM s JOIN l ON s.task_id = l.task_id AND version = v) WHERE k = 1")
def _(t):
    s = ledger.with_score(t.fx_ledger, F.lit("precision"))
    last = s.groupBy("task_id").agg(F.max_by("version", "step").alias("version"))
    best = s.join(last, ["task_id", "version"]).groupBy("task_id").agg(F.max_by(F.struct("step", "score"), F.struct(F.round("score", 9), -F.col("step"))).alias("b"))
    return best.select("task_id", "b.step", F.round("b.score", 6).alias("score"))


@query("i9_order_violations", """WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2), n(stage, need) AS (VALUES ('click', 'signup'), ('purchase', 'click'))
  SELECT e.user_id AS job_id, event_id AS seq, e.event_type AS stage, need FROM events e JOIN n ON stage = e.event_type LEFT JOIN f ON f.user_id = e.user_id AND f.event_type = need WHERE first IS NULL OR first > event_id""")
def _(t):
    e = t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"))
    return ledger.order_violations(e, {"click": "signup", "purchase": "click"}).select("job_id", "seq", "stage", "need")


@query("i11_content_version")
def _(t):
    return ledger.content_version(t.fx_cells, ["raster_id"])


@query("i12_unsupported_numbers", """WITH r AS (SELECT user_id, printf('%.2f', (event_id % 97) / 100.0) AS tok FROM events), k AS (SELECT user_id, printf('%.2f', (event_id % 50) / 100.0) AS tok FROM events)
  SELECT DISTINCT user_id, CAST(2 AS INTEGER) AS digits, tok AS token FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = r.user_id AND k.tok = r.tok)""")
def _(t):
    r = t.events.select("user_id", F.concat(F.lit("score "), F.format_string("%.2f", (F.col("event_id") % 97) / 100), F.lit(" now")).alias("text"))
    return ledger.unsupported_numbers(r, t.events.select("user_id", ((F.col("event_id") % 50) / 100).alias("value")), "user_id")


@query("i13_parse_reviews", """SELECT event_id, CAST(event_id % 7 AS DOUBLE) AS completeness, CAST(-1.0 AS DOUBLE) AS correctness, CAST(CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE 0.5 END AS DOUBLE) AS overall, event_type AS verdict, event_type AS problems FROM events""")
def _(t):
    e = F.col("event_id")
    text = F.concat(F.lit('sure: {"completeness": '), (e % 7).cast("string"), F.lit(', "overall": '), F.when(e % 3 == 0, '"bad"').otherwise("0.5"), F.lit(', "verdict": "'), F.col("event_type"), F.lit('", "problems": "'), F.col("event_type"), F.lit('"} end'))
    return ledger.parse_reviews(t.events.select("event_id", text.alias("text"))).withColumn("problems", F.array_join("problems", "|")).drop("text")


@query("i14_state_as_of", """WITH c AS (SELECT user_id AS job_id, event_type AS path, arg_min(value, event_id) AS content, arg_min(event_id % 5 = 0, event_id) AS absent FROM events WHERE event_id >= 5000 AND event_id % 2 = 0 GROUP BY 1, 2),
  l AS (SELECT user_id AS job_id, event_type AS path, arg_max(value, event_id) AS content FROM events GROUP BY 1, 2)
  SELECT job_id, path, content FROM c WHERE NOT absent UNION ALL SELECT l.job_id, l.path, l.content FROM l ANTI JOIN c ON l.job_id = c.job_id AND l.path = c.path""")
def _(t):
    e = t.events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("path"), F.col("event_id").alias("cid"), F.col("value").alias("content"), (F.col("event_id") % 5 == 0).alias("absent"))
    live = e.groupBy("job_id", "path").agg(F.max_by("content", "cid").alias("content"))
    return ledger.state_as_of(e.where("cid % 2 = 0"), live, 5000, ["job_id", "path"])


@query("i15_trace_after_rewind", """WITH r AS (SELECT user_id, event_id AS at, event_id - 700 AS back FROM events WHERE event_type = 'purchase' AND event_id % 11 = 0)
  SELECT user_id AS job_id, event_id AS "offset" FROM events e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = e.user_id AND r.at >= e.event_id AND r.back <= e.event_id)""")
def _(t):
    e = t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("offset"))
    r = t.events.where("event_type = 'purchase' AND event_id % 11 = 0").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("at"), (F.col("event_id") - 700).alias("to"))
    return ledger.after_rewind(e, r)


@query("i16_best_epoch", """WITH d AS (SELECT l_orderkey % 20 AS epoch, l_returnflag AS domain, sum(l_linenumber) AS tp, sum(l_partkey % 7) AS fp, sum(l_suppkey % 5) AS fn FROM lineitem GROUP BY 1, 2),
  s AS (SELECT epoch, avg(tp / greatest(tp + fp + fn, 1)) AS score FROM d GROUP BY epoch)
  SELECT epoch, round(score, 6) AS score, coalesce(score > max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM s""")
def _(t):
    log = t.lineitem.select((F.col("l_orderkey") % 20).alias("epoch"), F.col("l_returnflag").alias("domain"), F.col("l_linenumber").alias("tp"), (F.col("l_partkey") % 7).alias("fp"), (F.col("l_suppkey") % 5).alias("fn"))
    return ledger.best_epoch(log).withColumn("score", F.round("score", 6))


@query("i17_restore_best", BEST + ", t AS (SELECT task_id, max(step) AS step FROM b WHERE is_best GROUP BY task_id) SELECT l.task_id, l.step, l.prec, l.rec FROM fx_ledger l SEMI JOIN t ON l.task_id = t.task_id AND l.step = t.step")
def _(t):
    return ledger.restore_best(t.fx_ledger.select("task_id", "step", "prec", "rec"), _best(t))


@query("j3_stream_ledger", BEST + "SELECT task_id, step, round(score, 6) AS score, is_best FROM b")
def _(t):
    m = ledger.with_score(t.fx_ledger, F.lit("balanced")).select("task_id", "step", "score", "version")
    return stream_ledger(m).withColumn("score", F.round("score", 6))


@query("j3_ordered_ledger", BEST + """, pl AS (SELECT task_id, step, score, is_best, row_number() OVER w AS n, max(CAST(is_best AS INTEGER)) OVER (PARTITION BY task_id ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS late FROM b WINDOW w AS (PARTITION BY task_id ORDER BY step))
  SELECT task_id, step, round(score, 6) AS score, is_best, n > 2 AND late = 0 AS plateau FROM pl""")
def _(t):
    m = ledger.with_score(t.fx_ledger, F.lit("balanced")).withColumn("at", F.timestamp_seconds(F.col("step") * 60))
    return ordered_ledger(m).withColumn("score", F.round("score", 6)).drop("at")
