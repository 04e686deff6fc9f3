"""Fixture relations over the given tables; the SQL runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_tiles": """
        SELECT p_partkey AS tile_id, 1000 + 15 * (p_partkey % 100) AS key_e,
               1000 + 15 * CAST(floor(p_partkey / 100.0) AS BIGINT) AS key_n,
               CAST(p_size AS DOUBLE) / 250.0 AS road_fraction,
               CAST(p_partkey % 10 AS DOUBLE) / 50.0 AS blank_fraction
        FROM part WHERE p_size % 7 <> 0""",
    "fx_cells": """
        SELECT l_suppkey AS raster_id, l_partkey % 64 AS r, l_orderkey % 64 AS c,
               max(l_discount) * 10.0 AS conf, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS truth
        FROM lineitem GROUP BY l_suppkey, l_partkey % 64, l_orderkey % 64""",
    "fx_lines": """
        SELECT o_orderkey AS line_id, CAST(floor(o_custkey / 625.0) AS BIGINT) * 7 + o_orderkey % 7 AS region_id,
               CAST((o_custkey % 25) * 100 AS DOUBLE) AS x0,
               CAST((CAST(floor(o_custkey / 25.0) AS BIGINT) % 25) * 100 AS DOUBLE) AS y0,
               CAST((o_custkey % 25) * 100 + CASE o_orderkey % 4 WHEN 0 THEN 100 WHEN 2 THEN -100 ELSE 0 END AS DOUBLE)
                 + CAST(o_orderkey % 5 AS DOUBLE) / 2 AS x1,
               CAST((CAST(floor(o_custkey / 25.0) AS BIGINT) % 25) * 100
                 + CASE o_orderkey % 4 WHEN 1 THEN 100 WHEN 3 THEN -100 ELSE 0 END AS DOUBLE) AS y1,
               CASE o_orderstatus WHEN 'P' THEN 'human' ELSE 'model' END AS source
        FROM orders""",
    "fx_edits": """
        SELECT user_id AS job_id, event_id AS seq, ts,
               CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'delete'
                    WHEN 'signup' THEN 'replace' WHEN 'view' THEN 'dismiss' ELSE 'undo' END AS op,
               CAST((event_id % 25) * 100 AS DOUBLE) AS x0, CAST(((event_id * 7) % 25) * 100 AS DOUBLE) AS y0,
               CAST((event_id % 25) * 100 + 60 + event_id % 3 AS DOUBLE) AS x1,
               CAST(((event_id * 7) % 25) * 100 + 2 AS DOUBLE) AS y1
        FROM events""",
    "fx_ledger": """
        SELECT user_id AS task_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS step,
               CAST((event_id * 37) % 101 AS DOUBLE) / 101.0 AS prec,
               CAST((event_id * 53) % 101 AS DOUBLE) / 101.0 AS rec, event_id % 3 AS version
        FROM events""",
    "fx_trace": """
        SELECT user_id AS job_id, CAST(floor(event_id / 2.0) AS BIGINT) AS call_id, ts AS at,
               CASE WHEN event_id % 2 = 0 THEN 'tool_call' ELSE 'tool_result' END AS type, event_type AS tool
        FROM events""",
    "fx_files": """
        SELECT doc_id AS idx, concat(source, '/', CAST(doc_id AS VARCHAR(20)), '_sat.png') AS path,
               {sha} AS sha,
               CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split
        FROM documents""",
    "fx_chips": """
        SELECT vec_id AS chip_id, CAST(floor(vec_id / 25.0) AS BIGINT) AS mosaic_id,
               6 * CAST(floor((vec_id % 25) / 5.0) AS BIGINT) AS row_off, 6 * (vec_id % 5) AS col_off, 8 AS w, 8 AS h
        FROM embeddings""",
    "fx_graph": """
        SELECT DISTINCT region_id, nr, nc, mr, mc FROM (
          SELECT region_id, CAST(y0 AS BIGINT) AS nr, CAST(x0 AS BIGINT) AS nc, CAST(y1 AS BIGINT) AS mr,
                 CAST(floor(x1) AS BIGINT) AS mc FROM fx_lines
          UNION ALL
          SELECT region_id, CAST(y1 AS BIGINT), CAST(floor(x1) AS BIGINT), CAST(y0 AS BIGINT), CAST(x0 AS BIGINT)
          FROM fx_lines) g""",
}
USES = {"fx_tiles": "part", "fx_cells": "lineitem", "fx_lines": "orders", "fx_edits": "events", "fx_ledger": "events", "fx_trace": "events", "fx_files": "documents", "fx_chips": "embeddings", "fx_graph": "orders"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture relation, or a given table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, source = VIEWS[name].format(sha="sha2(text, 256)"), USES[name]
    if name == "fx_graph":
        return spark.sql(sql.replace("fx_lines", "{fx_lines}"), fx_lines=fixture(spark, sf_dir, "fx_lines"))
    return spark.sql(sql.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: fixture(spark, sf_dir, source)})


def with_fixtures(sql: str) -> str:
    """Oracle SQL with the fixture relations it names as common table expressions."""
    needed = [n for n in VIEWS if n in sql]
    if "fx_graph" in needed and "fx_lines" not in needed:
        needed.insert(0, "fx_lines")
    ctes = ", ".join(f"{n} AS ({VIEWS[n].format(sha='sha256(text)')})" for n in sorted(needed, key=lambda n: n == "fx_graph"))
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[4:]}"
    return f"WITH {ctes} {body}"
