"""Reshaped lines keep their junctions; live tables are replaced raster by raster; sessions on a stream."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netgrid.operators import shapes
from netgrid.sources import live
from netgrid.streaming import trace

LINE = "net long, line_id long, coords array<struct<x:double,y:double>>"


def df(spark, lines):
    return spark.createDataFrame([(1, i, [tuple(map(float, p)) for p in c]) for i, c in lines], LINE)


def coords(rows):
    return {r.line_id: [(p.x, p.y) for p in r.coords] for r in rows.collect()}


# two streets cross in a vertex inside both; a lane ends on a vertex inside the first
CROSS = [(1, [(0, 0), (30, 4), (60, 0), (90, 3), (120, 0)]), (2, [(60, -50), (64, -25), (60, 0), (55, 25), (60, 50)]), (3, [(30, 4), (33, 40), (30, 80)])]


def test_smoothing_cuts_free_corners_only(spark):
    got = coords(shapes.smooth_lines(df(spark, [*CROSS, (4, [(0, 9), (1, 9)]), (5, [(7, 7)])]), ["net"]))
    assert got[3] == [(30, 4), (32.25, 31), (32.25, 50), (30, 80)] and got[4] == [(0, 9), (1, 9)] and got[5] == [(7, 7)]
    assert got[1] == [(0, 0), (30, 4), (60, 0), (82.5, 2.25), (97.5, 2.25), (120, 0)]
    assert (60, 0) in got[2] and (64, -25) not in got[2]


def plain(c, pin, tolerance):
    """The farthest-point rule, by recursion, between pinned vertices."""
    def part(a, b):
        (x0, y0), (x1, y1) = c[a], c[b]
        n = math.hypot(x1 - x0, y1 - y0)
        far = [(abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) / n if n else math.hypot(x - x0, y - y0), -i) for i, (x, y) in enumerate(c) if a < i < b]
        if not far or max(far)[0] <= tolerance:
            return []
        i = -max(far)[1]
        return [*part(a, i), i, *part(i, b)]

    at = [i for i, p in enumerate(pin) if p]
    return sorted({*at, *(i for a, b in zip(at, at[1:]) for i in part(a, b))})


def test_pins_of_large_networks_are_those_of_small_ones(spark):
    rows = df(spark, [*CROSS, (4, [(0, 9), (1, 9), (5, 5), (5, 5), (0, 9)]), (5, [(7, 7)]), (6, [])])
    rows = rows.unionByName(rows.withColumn("net", F.col("net") + 1).where("line_id <> 1"))
    got = [sorted((r.net, r.line_id, [tuple(p) for p in r.coords]) for r in shapes.pinned(rows, ["net"], most).collect()) for most in (500_000, 13, 1)]
    assert got[0] == got[1] == got[2] and any(p[2] for r in got[0] for p in r[2][1:-1])


def test_simplification_keeps_pinned_vertices(spark):
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(2, 40)
        c = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(n)]
        pin = [i in (0, n - 1) or rng.random() < 0.1 for i in range(n)]
        got = shapes.kept_vertices(*map(np.array, zip(*c)), np.array(pin), 1.5)
        assert np.flatnonzero(got).tolist() == plain(c, pin, 1.5)
    got = coords(shapes.simplify_lines(df(spark, CROSS), ["net"], 10.0))
    assert got == {1: [(0, 0), (30, 4), (60, 0), (120, 0)], 2: [(60, -50), (60, 0), (60, 50)], 3: [(30, 4), (30, 80)]}
    assert coords(shapes.simplify_lines(df(spark, CROSS), ["net"], 0.0)) == {i: [tuple(map(float, p)) for p in c] for i, c in CROSS}
    assert shapes.simplify_lines(df(spark, []), ["net"], 1.0).count() == 0


@pytest.mark.parametrize("operation,amount", [("smooth", 0.25), ("simplify", 10.0)])
def test_report_shows_unchanged_junctions(spark, operation, amount):
    r = shapes.reshape_report(df(spark, CROSS), ["net"], operation, amount).first()
    assert (r.before_n_lines, r.before_n_dangles, r.before_n_junctions) == (r.after_n_lines, r.after_n_dangles, r.after_n_junctions)
    assert r.before_vertices == 13 and r.after_vertices == (17 if operation == "smooth" else 9) and r.after_length < r.before_length
    with pytest.raises(ValueError, match="unknown"):
        shapes.reshape_report(df(spark, CROSS), ["net"], "paint", 1.0)


# ---- live tables ----

CELLS = "r long, c long, conf double, raster_id long"


def cells(spark, rows):
    return spark.createDataFrame([(*map(int, x[:2]), float(x[2]), x[3]) for x in rows], CELLS)


def rows(spark, path):
    return sorted((r.raster_id, r.r, r.c, r.conf) for r in live.read_live(spark, path, CELLS).collect())


def test_write_replace_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/cells"
    live.write_live(cells(spark, [(0, 0, 0.1, 1), (0, 1, 0.2, 1), (5, 5, 0.3, 2), (6, 6, 0.4, 3)]), path)
    one = cells(spark, [(9, 9, 0.9, 1)])
    for _ in range(2):  # a job that is tried again changes nothing more
        live.write_live(one, path)
        assert rows(spark, path) == [(1, 9, 9, 0.9), (2, 5, 5, 0.3), (3, 6, 6, 0.4)]
    live.write_live(live.read_live(spark, path, CELLS).where("raster_id = 2").withColumn("conf", F.lit(0.5)), path)  # from the table itself
    live.write_live(one.limit(0), path, keys=spark.createDataFrame([(3,), (4,)], "raster_id long"))
    assert rows(spark, path) == [(1, 9, 9, 0.9), (2, 5, 5, 0.5)]


def test_failed_write_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/cells"
    live.write_live(cells(spark, [(0, 0, 0.1, 1), (5, 5, 0.3, 2)]), path)
    bad = cells(spark, [(1, 1, 0.7, 1), (2, 2, 0.0, 2)]).withColumn("conf", F.when(F.col("conf") > 0, F.col("conf")).otherwise(F.raise_error(F.lit("broken")).cast("double")))
    with pytest.raises(Exception, match="broken"):
        live.write_live(bad, path)
    assert rows(spark, path) == [(1, 0, 0, 0.1), (2, 5, 5, 0.3)]


def test_candidates_and_best_maps_go_live(spark, tmp_path):
    path = f"file://{tmp_path}/cells"
    live.write_live(cells(spark, [(0, 0, 0.1, 1), (5, 5, 0.3, 2), (7, 7, 0.3, 3)]), path)
    tried = cells(spark, [(1, 1, 0.8, 1)]).withColumn("variant_id", F.lit("a")).unionByName(cells(spark, [(1, 2, 0.6, 1), (3, 3, 0.6, 2)]).withColumn("variant_id", F.lit("b")))
    with pytest.raises(ValueError, match="'a', 'b'"):
        live.make_live(spark, path, CELLS, tried, "c")
    live.make_live(spark, path, CELLS, tried, "a")  # it has no cells on raster 2
    assert rows(spark, path) == [(1, 1, 1, 0.8), (3, 7, 7, 0.3)]
    versions = cells(spark, [(1, 1, 0.8, 1), (8, 8, 0.8, 3)]).withColumn("step", F.col("r"))
    none = spark.createDataFrame([(1, 1, False), (3, 8, False)], "raster_id long, step long, is_best boolean")
    with pytest.raises(ValueError, match="nothing was measured"):
        live.restore_live(path, versions, none, "raster_id")
    live.restore_live(path, versions, none.withColumn("is_best", F.col("raster_id") == 3), "raster_id")
    assert rows(spark, path) == [(1, 1, 1, 0.8), (3, 8, 8, 0.8)]


def test_sessions_on_a_stream(spark, tmp_path):
    t0, rng = dt.datetime(2024, 1, 1), random.Random(4)
    at, rows_ = t0, []
    for i in range(80):
        at += dt.timedelta(minutes=rng.choice([1, 2, 3, 25]))
        rows_.append((i % 3, at, "tool_call"))
    ev = spark.createDataFrame(rows_, "job_id long, at timestamp, type string")
    src, out = f"{tmp_path}/in", "session_rows"
    for k, part in enumerate(ev.randomSplit([0.5, 0.5], 3)):
        ev.orderBy("at").limit(40 if k == 0 else 80).subtract(ev.orderBy("at").limit(0 if k == 0 else 40)).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = trace.sessions(s, "10 minutes", "2 hours").writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: {(r.job_id, r.start, r.end, r.n) for r in d.collect()}
    got, want = key(spark.table(out)), key(trace.sessions(ev, "10 minutes"))
    assert got and got <= want
    by = {}
    for j, a, _ in sorted(rows_):
        if by.setdefault(j, []) and a - by[j][-1][-1] < dt.timedelta(minutes=10):
            by[j][-1].append(a)
        else:
            by[j].append([a])
    assert {(j, s[0], s[-1] + dt.timedelta(minutes=10), len(s)) for j, v in by.items() for s in v} == want


def test_folders_do_not_grow_with_rasters(spark, tmp_path):
    path = str(tmp_path / "many")
    many = spark.range(1500).select(F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("c"), F.lit(0.5).alias("conf"), F.col("id").alias("raster_id"))
    live.write_live(many, path)
    live.write_live(many.where("raster_id % 3 = 0").withColumn("conf", F.lit(0.25)), path, keys=spark.createDataFrame([(7,)], "raster_id long"))
    rows = {x.raster_id: x.conf for x in live.read_live(spark, path, CELLS).collect()}
    assert rows == {i: 0.25 if i % 3 == 0 else 0.5 for i in range(1500) if i != 7}
    assert len([p for p in (tmp_path / "many").iterdir() if p.is_dir()]) <= 256
