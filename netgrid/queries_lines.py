"""Queries of the source, line, network and edit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from netgrid.catalog import query
from netgrid.operators import history, lines
from netgrid.sources import tables

LEN = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
TOPO = """WITH RECURSIVE n AS (SELECT *, floor((x0 + 50) / 100) * 1000 + floor((y0 + 50) / 100) AS a, floor((x1 + 50) / 100) * 1000 + floor((y1 + 50) / 100) AS b, """ + LEN + """ AS len FROM fx_lines),
  pts AS (SELECT region_id, line_id, a AS node FROM n UNION SELECT region_id, line_id, b FROM n),
  dg AS (SELECT region_id, node, count(*) AS d FROM pts GROUP BY 1, 2),
  e AS (SELECT DISTINCT region_id, a AS u, b AS v FROM n UNION SELECT region_id, b, a FROM n),
  r AS (SELECT region_id, node, node AS root FROM dg UNION SELECT r.region_id, e.v, r.root FROM r JOIN e ON e.region_id = r.region_id AND e.u = r.node WHERE r.root < e.v),
  c AS (SELECT region_id, node, min(root) AS comp FROM r GROUP BY 1, 2),
  k AS (SELECT n.region_id, comp, sum(len) AS len, count(*) AS n FROM n JOIN c ON n.region_id = c.region_id AND n.a = c.node GROUP BY 1, 2),
  s AS (SELECT region_id, count(*) AS n_components, sum(n) AS n_lines, sum(len) AS total, max(len) / sum(len) AS share, count(CASE WHEN n = 1 AND len < 40 THEN 1 END) AS short_fragments, sum(CASE WHEN n = 1 THEN len ELSE 0 END) AS iso FROM k GROUP BY 1),
  q AS (SELECT region_id, count(*) AS n_nodes, count(CASE WHEN d = 1 THEN 1 END) AS n_dangles, count(CASE WHEN d >= 3 THEN 1 END) AS n_junctions FROM dg GROUP BY 1),
  z AS (SELECT *, n_dangles / n_nodes AS ratio FROM s JOIN q USING (region_id)),
  y AS (SELECT *, greatest(0.0, least(1.0, 0.65 * share + 0.35 * (1 - greatest(0.0, (ratio - 0.33) / 0.67)) - 0.15 * least(1.0, 3.0 * short_fragments / n_lines))) AS sc FROM z)
  SELECT region_id, CAST(n_lines AS BIGINT) AS n_lines, n_nodes, n_dangles, n_junctions, n_components, round(total, 1) AS total_length, round(share, 4) AS largest_share, short_fragments, round(iso, 1) AS isolated_length,
    round(ratio, 4) AS dangle_ratio, round(sc, 4) AS score, CASE WHEN sc >= 0.75 THEN 'coherent' WHEN sc >= 0.5 THEN 'fragmented' WHEN sc >= 0.25 THEN 'poor' ELSE 'incoherent' END AS verdict FROM y"""


def _coords(t):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    mid = F.struct(((F.col("x0") + F.col("x1")) / 2 + 3).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return t.fx_lines.withColumn("coords", F.array(p("x0", "y0"), mid, p("x1", "y1")))


@query("a1_list_links", r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)
  SELECT page_id, name, CAST(min(pos) AS INTEGER) AS pos FROM h GROUP BY page_id, name""")
def _(t):
    return tables.list_links(t.pages, 'href="([^"]*)"')


@query("a5_file_index", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS length FROM documents")
def _(t):
    return tables.file_index(t.documents.select("doc_id", F.encode("text", "utf-8").alias("content")), ["doc_id"])


@query("a4_pair_tiles", "SELECT a.tile_id, a.road_fraction AS image, b.blank_fraction AS label FROM fx_tiles a JOIN fx_tiles b USING (tile_id) WHERE a.tile_id % 2 = 0 AND tile_id % 3 = 0")
def _(t):
    a = t.fx_tiles.where("tile_id % 2 = 0").select("tile_id", F.col("road_fraction").alias("image"))
    return tables.pair_tiles(a, t.fx_tiles.select("tile_id", F.col("blank_fraction").alias("label")), "tile_id", t.fx_tiles.where("tile_id % 3 = 0").select("tile_id"))


@query("a9_manifest_counts", "SELECT split AS set, count(*) AS n FROM fx_files GROUP BY split")
def _(t):
    return tables.manifest_counts(t.fx_files.withColumnRenamed("split", "set"))


@query("a10_refresh_cache", "SELECT tile_id, CASE WHEN tile_id % 4 = 0 AND tile_id % 12 <> 0 THEN 'kept' ELSE 'new' END AS state FROM fx_tiles")
def _(t):
    cache = t.part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("tile_id"), F.lit("kept").alias("state"), F.when(F.col("p_partkey") % 12 == 0, "bad").otherwise("").alias("error"))
    fresh = lambda work: work.select("tile_id", F.lit("new").alias("state"), F.lit("").alias("error"))
    return tables.refresh_cache(t.fx_tiles.select("tile_id"), cache, fresh, "tile_id").drop("error")


@query("a12_copy_grid", """SELECT tile_id, CASE WHEN tile_id % 5 = 0 THEN 'no match' WHEN tile_id % 7 = 0 THEN 'failed' WHEN tile_id % 3 = 0 THEN 'already' ELSE 'done' END AS status FROM fx_tiles""")
def _(t):
    lab = t.fx_tiles.select("tile_id", F.lit(10).alias("width"), F.lit(10).alias("height"), F.when(F.col("tile_id") % 3 == 0, "EPSG:26986").alias("crs"))
    img = t.fx_tiles.where("tile_id % 5 <> 0").select("tile_id", F.when(F.col("tile_id") % 7 == 0, 11).otherwise(10).alias("width"), F.lit(10).alias("height"), F.lit("EPSG:26986").alias("crs"))
    return tables.copy_grid(lab, img, "tile_id").select("tile_id", "status")


@query("a13_validate_rasters", "SELECT tile_id, tile_id % 3 <> 0 AND key_e > 1100 AS ok, CASE WHEN tile_id % 3 = 0 THEN 'no coordinate reference system' WHEN key_e <= 1100 THEN 'empty raster' END AS reason FROM fx_tiles")
def _(t):
    r = t.fx_tiles.select("tile_id", F.when(F.col("tile_id") % 3 != 0, "EPSG:26986").alias("crs"), F.when(F.col("key_e") > 1100, 5).otherwise(0).alias("width"), F.lit(5).alias("height"))
    return tables.validate_rasters(r).select("tile_id", "ok", "reason")


@query("d4_line_length", f"SELECT line_id, round(sqrt(pow((x0 + x1) / 2 + 3 - x0, 2) + pow((y0 + y1) / 2 - y0, 2)) + sqrt(pow(x1 - (x0 + x1) / 2 - 3, 2) + pow(y1 - (y0 + y1) / 2, 2)), 4) AS length FROM fx_lines")
def _(t):
    return _coords(t).select("line_id", F.round(lines.line_length(F.col("coords")), 4).alias("length"))


@query("d5_is_geographic", "SELECT k AS net, min(x) >= -180 AND max(x) <= 180 AND min(y) >= -90 AND max(y) <= 90 AND max(x) - min(x) < 10 AND max(y) - min(y) < 10 AND max(abs(x)) > 0.01 AS geographic FROM (SELECT line_id % 2 AS k, CASE WHEN line_id % 2 = 0 THEN x0 ELSE x0 / 1000 END AS x, CASE WHEN line_id % 2 = 0 THEN y0 ELSE y0 / 1000 END AS y FROM fx_lines) GROUP BY k")
def _(t):
    k = F.col("line_id") % 2
    return lines.is_geographic(t.fx_lines.select(k.alias("net"), F.when(k == 0, F.col("x0")).otherwise(F.col("x0") / 1000).alias("x"), F.when(k == 0, F.col("y0")).otherwise(F.col("y0") / 1000).alias("y")), ["net"])


@query("d7_sample_along", """WITH v AS (SELECT region_id, line_id, unnest([x0, (x0 + x1) / 2 + 3, x1]) AS x, unnest([y0, (y0 + y1) / 2, y1]) AS y FROM fx_lines),
  p AS (SELECT region_id, line_id, CAST(trunc(y / 40) AS BIGINT) AS r, CAST(trunc(x / 40) AS BIGINT) AS c FROM v), q AS (SELECT * FROM p WHERE r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63),
  m AS (SELECT q.line_id, avg(coalesce(conf, 0.0)) AS m FROM q LEFT JOIN fx_cells k ON k.raster_id = region_id + 1 AND k.r = q.r AND k.c = q.c GROUP BY q.line_id)
  SELECT region_id, l.line_id, round(coalesce(m, 0.0), 6) AS confidence FROM fx_lines l LEFT JOIN m ON m.line_id = l.line_id""")
def _(t):
    cells = t.fx_cells.select((F.col("raster_id") - 1).alias("region_id"), "r", "c", "conf")
    return lines.sample_along(_coords(t), cells, ["region_id"], 40.0, 64, 64).withColumn("confidence", F.round("confidence", 6))


@query("d10_low_confidence", "SELECT line_id, confidence, (x0 + x1) / 2 + 3 AS x, (y0 + y1) / 2 AS y FROM (SELECT *, (line_id * 37) % 1009 / 1009.0 AS confidence FROM fx_lines) ORDER BY confidence, line_id LIMIT 10")
def _(t):
    return lines.low_confidence(_coords(t).withColumn("confidence", (F.col("line_id") * 37) % 1009 / 1009.0), 10)


@query("d11_explode_segments", "SELECT line_id, CAST(0 AS INTEGER) AS seg_no, x0, y0, (x0 + x1) / 2 + 3 AS x1, (y0 + y1) / 2 AS y1 FROM fx_lines UNION ALL SELECT line_id, 1, (x0 + x1) / 2 + 3, (y0 + y1) / 2, x1, y1 FROM fx_lines")
def _(t):
    return lines.explode_segments(_coords(t), ["line_id"])


@query("e2_topology_report", TOPO)
def _(t):
    return lines.topology_report(t.fx_lines, ["region_id"])


@query("e5_quality_band", "SELECT p_partkey, CASE WHEN v > 0.55 THEN 'good' WHEN v > 0.35 THEN 'usable' WHEN v > 0.15 THEN 'poor' ELSE 'failed' END AS band FROM (SELECT p_partkey, (p_partkey % 97) / 97.0 AS v FROM part)")
def _(t):
    return t.part.select("p_partkey", lines.quality_band((F.col("p_partkey") % 97) / 97.0).alias("band"))


@query("f1_validate_lines", "SELECT line_id, CASE WHEN line_id % 4 = 0 THEN 'fewer than two vertices' WHEN line_id % 4 = 1 AND (x0 > 180 OR y0 > 90 OR x1 > 180 OR y1 > 90 OR x1 < -180 OR y1 < -90) THEN 'coordinate out of range' WHEN line_id % 4 = 2 THEN 'no two distinct vertices' END AS reason FROM fx_lines")
def _(t):
    p = lambda x, y, s=1.0: F.struct((F.col(x) * s).alias("x"), (F.col(y) * s).alias("y"))
    k = F.col("line_id") % 4
    c = F.when(k == 0, F.array(p("x0", "y0"))).when(k == 1, F.array(p("x0", "y0"), p("x1", "y1"))).when(k == 2, F.array(p("x0", "y0", 0.01), p("x0", "y0", 0.01))).otherwise(F.array(p("x0", "y0", 0.01), p("x1", "y1", 0.01)))
    return lines.validate_lines(t.fx_lines.select("line_id", c.alias("coords"))).select("line_id", "reason")


LIVE = """WITH RECURSIVE o AS (SELECT job_id, seq, op, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM fx_edits),
  f AS (SELECT job_id, n, CASE WHEN op = 'undo' THEN CAST([] AS BIGINT[]) ELSE [seq] END AS done FROM o WHERE n = 1
    UNION ALL SELECT o.job_id, o.n, CASE WHEN op = 'undo' THEN list_slice(done, 1, len(done) - 1) ELSE list_append(done, o.seq) END FROM f JOIN o ON o.job_id = f.job_id AND o.n = f.n + 1),
  l AS (SELECT job_id, unnest(arg_max(done, n)) AS seq FROM f GROUP BY job_id)"""


@query("f2_live_operations", LIVE + " SELECT job_id, seq, op FROM fx_edits JOIN l USING (job_id, seq)")
def _(t):
    return lines.live_operations(t.fx_edits.select("job_id", "seq", "op"))


@query("f2_live_by_ranges", LIVE + " SELECT job_id, seq, op FROM fx_edits JOIN l USING (job_id, seq)")
def _(t):
    return history.live_operations(t.fx_edits.select("job_id", "seq", "op"))


@query("f13_edit_activity", LIVE + """, k AS (SELECT job_id, seq, op, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM fx_edits JOIN l USING (job_id, seq))
  SELECT job_id, count(CASE WHEN op = 'add' THEN 1 END) AS added, count(CASE WHEN op = 'delete' THEN 1 END) AS deleted, count(CASE WHEN op = 'replace' THEN 1 END) AS replaced, count(CASE WHEN op = 'dismiss' THEN 1 END) AS dismissed,
    string_agg(seq || ':' || op, ',' ORDER BY seq DESC) FILTER (n <= 8) AS recent FROM k GROUP BY job_id""")
def _(t):
    return lines.edit_activity(lines.live_operations(t.fx_edits.select("job_id", "seq", "op")))


@query("j2_pair_calls", "SELECT job_id, call_id, min(CASE WHEN type = 'tool_call' THEN \"at\" END) AS called, min(CASE WHEN type = 'tool_result' THEN \"at\" END) AS answered FROM fx_trace GROUP BY job_id, call_id HAVING min(CASE WHEN type = 'tool_call' THEN \"at\" END) IS NOT NULL")
def _(t):
    from netgrid.streaming.trace import pair_calls

    return pair_calls(t.fx_trace).select("job_id", "call_id", "called", "answered")


@query("j4_activity_windows", "SELECT job_id, time_bucket(INTERVAL '1 hour', \"at\") AS start, count(*) AS n, count(CASE WHEN type = 'tool_call' THEN 1 END) AS calls FROM fx_trace GROUP BY 1, 2")
def _(t):
    from netgrid.streaming.trace import activity_windows

    return activity_windows(t.fx_trace, "1 hour").select("job_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "calls")
