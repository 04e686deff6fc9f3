"""Thinning, tracing, merging and the other operators of drawn networks, on drawn masks and brute force."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from netgrid import queries_vector  # noqa: F401  registers
from netgrid.catalog import QUERIES
from netgrid.operators import cells, edits, vectorise
from netgrid.sources import tables
from netgrid.streaming import trace

SEG = "net long, line_id long, x0 double, y0 double, x1 double, y1 double"


def cells_of(spark, masks):
    rows = [(k, int(r), int(c)) for k, m in masks.items() for r, c in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "net long, r long, c long")


def masks():
    road = np.zeros((90, 120), bool)
    road[20:27, 5:110] = True
    road[5:80, 50:55] = True
    for i in range(40):
        road[30 + i, 60 + i] = True
    ring = np.zeros((60, 60), bool)
    y, x = np.mgrid[:60, :60]
    ring[(np.hypot(y - 30, x - 30) > 14) & (np.hypot(y - 30, x - 30) < 19)] = True
    rng = np.random.default_rng(3)
    return {1: road, 2: ring, 3: rng.random((50, 50)) < 0.45}


def naive_thin(mask):
    """Cell by cell, as the algorithm is published."""
    on = {(int(r), int(c)) for r, c in zip(*np.nonzero(mask))}
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = len(on)
        for last in (False, True):
            gone = set()
            for r, c in on:
                p = [(r + a, c + b) in on for a, b in ring]
                turns = sum(not p[i] and p[(i + 1) % 8] for i in range(8))
                up, right, down, left = p[0], p[2], p[4], p[6]
                ok = not (up and right and left) and not (up and down and left) if last else not (up and right and down) and not (right and down and left)
                if 2 <= sum(p) <= 6 and turns == 1 and ok:
                    gone.add((r, c))
            on -= gone
        if len(on) == before:
            return on


@pytest.mark.parametrize("side,rounds", [(16, 1), (32, 4), (256, 8)])
def test_thin_equals_cell_by_cell(spark, side, rounds):
    m = masks()
    got = {}
    for r in vectorise.thin(cells_of(spark, m), ["net"], side, rounds).collect():
        got.setdefault(r.net, set()).add((r.r, r.c))
    for k, mask in m.items():
        assert got[k] == naive_thin(mask)


def pixel_edges(on):
    return {frozenset((p, (p[0] + a, p[1] + b))) for p in on for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (p[0] + a, p[1] + b) in on}


def test_trace_uses_every_edge_once(spark):
    m = {k: naive_thin(v) for k, v in masks().items()}
    m[4] = {(5, 5), (9, 9), (9, 10)}  # a lone cell and two neighbours
    rows = [(k, r, c) for k, on in m.items() for r, c in on]
    lines = vectorise.trace(spark.createDataFrame(rows, "net long, r long, c long"), ["net"]).collect()
    for k, on in m.items():
        degree = {p: sum(p in e for e in pixel_edges(on)) for p in on}
        used = []
        for line in (x for x in lines if x.net == k):
            path = [(int(p.y - 0.5), int(p.x - 0.5)) for p in line.coords]
            used += [frozenset(e) for e in zip(path, path[1:])]
            assert all(degree[p] == 2 for p in path[1:-1])
            assert path[0] == path[-1] or degree[path[0]] != 2 and degree[path[-1]] != 2
        assert len(used) == len(set(used)) and set(used) == pixel_edges(on)
    assert len({x.line_id for x in lines}) == len(lines)


def test_ring_is_one_closed_line(spark):
    on = {(r, c) for r in range(3, 9) for c in range(3, 12) if r in (3, 8) or c in (3, 11)} - {(3, 3), (3, 11), (8, 3), (8, 11)}
    lines = vectorise.trace(spark.createDataFrame([(1, r, c) for r, c in on], "net long, r long, c long"), ["net"]).collect()
    assert len(lines) == 1 and lines[0].coords[0] == lines[0].coords[-1] and len(lines[0].coords) == len(on) + 1


def test_vectorize_a_cross(spark):
    m = np.zeros((120, 200), bool)
    m[57:64, :] = True
    m[:, 98:103] = True
    mask = cells_of(spark, {1: m})
    conf = mask.withColumn("conf", F.lit(0.9))
    lines = vectorise.vectorize(mask, conf, ["net"], 120, 200)
    got = lines.collect()
    assert len(got) == 4 and all(40 < x.length_m < 110 and x.confidence == 0.9 and x.confidence_pct == 90.0 for x in got)
    stats = vectorise.vectorize_stats(mask, vectorise.thin(mask, ["net"]), lines, ["net"], 120, 200).first()
    assert stats.mask_px == m.sum() and stats.n_lines == 4 and stats.n_low_confidence == 0
    assert vectorise.vectorize(mask.limit(0), conf, ["net"], 120, 200).count() == 0


def test_three_fifths_of_a_bent_road_are_found(spark):
    """A road along two sides of a field; the network has the first side and the corner, an edit adds the rest."""
    m = np.zeros((210, 330), bool)
    m[40:45, 20:300] = True
    m[40:190, 295:300] = True
    skeleton = vectorise.thin(cells_of(spark, {1: m, 2: m}), ["net"])
    seg = spark.createDataFrame([(1, 1, 20.0, 42.5, 280.0, 42.5, "model"), (1, 2, 280.0, 42.5, 297.5, 42.5, "human"), (1, 3, 297.5, 42.5, 297.5, 188.0, "human"), (2, 1, 20.0, 150.5, 270.0, 150.5, "model")], SEG + ", source string")
    n = skeleton.where("net = 1").count()
    s = {r.net: r for r in vectorise.score_network(seg.where("source = 'model'"), skeleton, ["net"], 1.0, 210, 330).collect()}
    assert abs(s[1].completeness - 264 / n) < 0.03 and s[1].correctness == 1.0
    assert s[2].completeness == s[2].correctness == s[2].quality == 0.0
    g = {r.net: r for r in vectorise.edit_gain(seg, skeleton, ["net"], 1.0, 210, 330).collect()}
    assert abs(g[1].gain_completeness - (1 - 264 / n)) < 0.04 and g[2].gain_completeness == 0
    swap = vectorise.axis_order_check(seg.where("net = 1"), cells_of(spark, {1: m}), ["net"], 1.0, 210, 330).first()
    assert swap.right_order and swap.iou > 3 * swap.iou_swapped


def net(spark, *lines):
    return spark.createDataFrame([(1, i, *map(float, x)) for i, x in lines], SEG)


STREETS = ((1, (0, 0, 400, 0)), (2, (200, -200, 200, 0)), (3, (0, 300, 400, 300)))


def status(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.status, []).append((r.line_id, r.piece))
    return {k: sorted(v) for k, v in out.items()}


def test_merge_deletes_snaps_and_splits(spark):
    none = net(spark, (9, (0, 0, 1, 1))).limit(0)
    model = net(spark, *STREETS)
    got = status(edits.merge_network(model, none, net(spark, (8, (0, 302, 400, 302))), ["net"]))
    assert got == {"model": [(1, 1), (2, 1)], "deleted": [(3, 1)]}
    got = status(edits.merge_network(model, none, net(spark, (8, (0, 0, 400, 0))), ["net"]))
    assert got["deleted"] == [(1, 1)] and (2, 1) in got["model"]
    new = edits.merge_network(model, net(spark, (9, (300, 150, 300, 1))), none, ["net"])
    got = status(new)
    assert got == {"model": [(1, 1), (1, 2), (2, 1), (3, 1)], "human": [(9, 1)]}
    ends = {(r.line_id, r.piece): r for r in new.collect()}
    assert (ends[1, 1].x1, ends[1, 1].y1) == (ends[1, 2].x0, ends[1, 2].y0) == (ends[9, 1].x1, ends[9, 1].y1) == (300.0, 0.0)
    s = edits.network_stats(new, ["net"], spark.createDataFrame([(1, 3, False)], "net long, n_ops long, can_redo boolean")).first()
    assert (s.n_model, s.n_human, s.n_snapped_ends, s.n_features, s.can_undo, s.can_redo) == (4, 1, 1, 5, True, False)
    assert s.human_length_m == 150.0 and s.total_length_m == 1150.0
    got = status(edits.merge_network(model, net(spark, (9, (0, 301, 400, 301))), none, ["net"]))
    assert got["superseded"] == [(3, 1)] and got["human"] == [(9, 1)]


def test_gap_between_two_stubs(spark):
    seg = net(spark, (1, (0, 0, 100, 0)), (2, (120, 2, 220, 2)), (3, (60, 40, 60, 90)))
    conf = spark.createDataFrame([(1, 0, 100, 0.5), (1, 2, 120, 0.7)], "net long, r long, c long, conf double")
    none = seg.limit(0)
    got = edits.suggest_gaps(seg, conf, none, ["net"], 1.0, 400, 400).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)] and math.isclose(got[0].score, 20 / math.hypot(20, 2) + 0.6, rel_tol=1e-6)
    assert edits.suggest_gaps(seg, conf, net(spark, (7, (95, 1, 125, 1))), ["net"], 1.0, 400, 400).count() == 0


def test_missed_road(spark):
    m = np.zeros((200, 200), bool)
    m[97:104, 20:180] = True
    m[20:27, 20:180] = True
    conf = cells_of(spark, {1: m}).withColumn("conf", F.lit(0.4))
    drawn = net(spark, (1, (20, 23.5, 180, 23.5)), (2, (178, 60, 178, 190)))
    got = edits.suggest_missed(conf, drawn, drawn.limit(0), ["net"], 1.0, 200, 200).collect()
    assert len(got) == 1 and got[0].joined == 1 and abs(got[0].coords[0].y - 100.5) < 2
    assert math.isclose(got[0].score, got[0].confidence * math.log1p(got[0].length_m) * 2, rel_tol=1e-9)


def test_repairs(spark):
    seg = net(spark, (1, (0, 0, 100, 0)), (2, (102, 0, 200, 0)), (3, (100, 1, 100, 4)), (4, (500, 500, 500, 501)))
    snap = {r.line_id: r for r in edits.repair(seg, ["net"], "snap", 3.0).collect()}
    assert snap[1].x1 == snap[2].x0 == snap[3].x0
    left = {r.line_id for r in edits.repair(seg, ["net"], "rmdangle", 5.0).collect()}
    assert left == {1, 2}
    assert {r.line_id for r in edits.repair(seg, ["net"], "prune", 5.0).collect()} == {1, 2}
    longer = {r.line_id: r for r in edits.repair(seg, ["net"], "extend", 5.0).collect()}
    assert (longer[1].x0, longer[1].x1, longer[4].y1) == (-5.0, 105.0, 506.0)
    report = edits.repair_report(seg, ["net"], "prune", 5.0).first()
    assert report.before_n_lines == 4 and report.after_n_lines == 2 and report.improved
    with pytest.raises(ValueError):
        edits.repair(seg, ["net"], "paint")


def test_candidates(spark):
    m = np.zeros((120, 160), bool)
    m[57:64, :] = True
    noise = np.zeros_like(m)
    noise[10:17, 20:150] = True
    conf = cells_of(spark, {1: m}).withColumn("conf", F.lit(0.8)).unionByName(cells_of(spark, {1: noise}).withColumn("conf", F.lit(0.35)))
    truth = vectorise.thin(cells_of(spark, {1: m}), ["net"])
    v = spark.createDataFrame([("low", 0.3), ("high", 0.6)], "variant_id string, threshold double")
    got = edits.try_candidates(conf, truth, v, ["net"], 1.0, 120, 160).orderBy("rank").collect()
    assert [r.variant_id for r in got] == ["high", "low"] and got[0].score > 0.9 > got[1].score
    free = edits.try_candidates(conf, None, v, ["net"], 1.0, 120, 160).orderBy("rank").collect()
    assert free[0].variant_id == "high"
    live = conf.select(F.col("net").alias("raster_id"), "r", "c", "conf")
    with pytest.raises(ValueError, match="low"):
        edits.apply_candidate(live, live.withColumn("variant_id", F.lit("low")), "nosuch")


def test_whole_ladder(spark, tmp_path):
    # raster 1: a road, a faint stripe beside it and a dot; raster 2: a dot; raster 3: a wrong stripe, without truth
    drawn = [(1, r, c, 0.065, "R") for r in range(30, 34) for c in range(64)] + [(1, r, c, 0.035, "N") for r in range(5, 9) for c in range(64)]
    drawn += [(1, 50, 50, 0.1, "N"), (2, 9, 9, 0.1, "N")] + [(3, r, c, 0.055, "N") for r in range(20, 24) for c in range(64)]
    lineitem = spark.createDataFrame(drawn, "l_suppkey long, l_partkey long, l_orderkey long, l_discount double, l_returnflag string")
    lineitem.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.region_id, r.variant_id): r for r in QUERIES["i2_try_candidates"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [(k, v) for k in (0, 1, 2) for v in ("c1", "c2", "c3", "c4", "c5")]
    assert [got[0, v].threshold for v in ("c1", "c2", "c3", "c4", "c5")] == [0.3, 0.4, 0.5, 0.6, 0.7]
    assert [got[0, v].rank for v in ("c2", "c3", "c4", "c1", "c5")] == [1, 2, 3, 4, 5]
    assert got[0, "c2"].score == got[0, "c3"].score == got[0, "c4"].score > 0.9 > got[0, "c1"].score > got[0, "c5"].score == 0.0
    assert all((got[k, v].precision, got[k, v].recall, got[k, v].score) == (0.0, 0.0, 0.0) for k, v in got if k)


def test_candidates_without_lines(spark):
    conf = spark.createDataFrame([(1, 10, c, 0.5) for c in range(60)] + [(2, 10, 10, 0.9)], "net long, r long, c long, conf double")
    v = spark.createDataFrame([("low", 0.3), ("high", 0.6)], "variant_id string, threshold double")
    free = {(r.net, r.variant_id): r for r in edits.try_candidates(conf, None, v, ["net"], 1.0, 64, 64, radius=0, holes=0, small=1, min_length=6.0).collect()}
    assert sorted(free) == [(1, "high"), (1, "low"), (2, "high"), (2, "low")]
    assert free[1, "low"].score > 0 and free[1, "low"].rank == 1 and free[1, "high"].score == free[2, "high"].score == free[2, "low"].score == 0.0


def test_measure_bases(spark):
    seg = net(spark, (1, (0, 10.5, 50, 10.5))).unionByName(net(spark, (1, (0, 10.5, 50, 10.5))).withColumn("net", F.lit(2).cast("long")))
    nets = spark.createDataFrame([(1,), (2,), (3,)], "net long")
    road = spark.createDataFrame([(1, 10, c) for c in range(50)], "net long, r long, c long")
    conf = spark.createDataFrame([(k, 10, c, 0.5) for k in (1, 2, 3) for c in range(50)], "net long, r long, c long, conf double")
    got = {r.net: r for r in edits.measure(seg, nets, road, conf, ["net"], 1.0, 60, 60).collect()}
    assert (got[1].basis, got[1].score, got[2].basis, got[3].basis, got[3].score) == ("ground truth", 1.0, "expected", "empty", 0.0)
    assert 0 < got[2].precision < 0.2 and got[2].recall == 1.0


def test_stream_of_chips_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, k, 1, datetime(2024, 1, 1, 0, 0, k), 6 * (k // 3), 6 * (k % 3), [rng.random() for _ in range(64)]) for k in range(9)]
    schema = "net long, chip_id long, version int, at timestamp, row_off long, col_off long, data array<double>"
    df = spark.createDataFrame(rows, schema)
    for i in range(3):
        df.where(F.col("chip_id") % 3 == i).unionByName(df.where("chip_id = 4")).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = trace.stream_chips(src, ["net"], 8, 2).writeStream.outputMode("complete").format("memory").queryName("mosaic").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.r, r.c): round(r.v, 9) for r in trace.stream_chips(df, ["net"], 8, 2).collect()}
    assert {(r.r, r.c): round(r.v, 9) for r in spark.table("mosaic").collect()} == want and len(want) == 400


def test_stream_of_edits_equals_batch(spark, tmp_path):
    ops = [(j, s, op, float(x), 0.0, float(x), 50.0) for j in (1, 2) for s, (op, x) in enumerate([("add", 10), ("add", 90), ("undo", 0), ("delete", 40), ("add", 70)])]
    log = spark.createDataFrame(ops, "job_id long, seq long, op string, x0 double, y0 double, x1 double, y1 double")
    model = spark.createDataFrame([(j, 1, 0.0, 0.0, 100.0, 0.0) for j in (1, 2)] + [(j, 2, 40.0, 0.0, 40.0, 50.0) for j in (1, 2)], "job_id long, line_id long, x0 double, y0 double, x1 double, y1 double")
    for i in range(3):
        log.where(F.col("seq") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    seen = {}

    def emit(network, batch_id):
        for r in network.collect():
            seen.setdefault((batch_id, r.job_id), set()).add((r.line_id, r.piece, r.status))

    src = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = trace.stream_edits(src, f"{tmp_path}/log", model, emit).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    want = {}
    for r in trace.rebuilt(log, model).collect():
        want.setdefault(r.job_id, set()).add((r.line_id, r.piece, r.status))
    last = max(b for b, _ in seen)
    assert {j: v for (b, j), v in seen.items() if b == last} == want
    assert any(s == "deleted" for _, _, s in want[1]) and any(s == "human" for _, _, s in want[1])


def test_feature_and_log_sources(spark, tmp_path):
    lines = spark.createDataFrame([("a", [(0.0, 1.0), (2.0, 3.0)], 5), ("b", [(4.0, 5.0), (6.0, 7.0)], 6)], "feature_id string, coords array<struct<x:double,y:double>>, n int")
    tables.write_features(lines, f"{tmp_path}/f", lines.selectExpr("count(*) as n"))
    got = {r.feature_id: [tuple(p) for p in r.coords] for r in tables.read_features(spark, f"{tmp_path}/f", lines=True).collect()}
    assert got == {"a": [(0.0, 1.0), (2.0, 3.0)], "b": [(4.0, 5.0), (6.0, 7.0)]}
    tables.write_features(lines.limit(0), f"{tmp_path}/e")
    assert tables.read_features(spark, f"{tmp_path}/e", lines=True).count() == 0
    (tmp_path / "log.json").write_text('{"job_id":1,"seq":1,"stage":"tile","at":"x"}\n{"job_id":1,"se\n{"job_id":1,"seq":2,"stage":"stitch","at":"y"}\n')
    log = tables.read_job_logs(spark, str(tmp_path / "log.json"), "job_id long, seq long, stage string, at string")
    assert [(r.stage, r.n_stages) for r in tables.latest_stage(log).collect()] == [("stitch", 2)]


def test_order_check_counts_cells_like_sets(spark):
    rng = random.Random(11)
    seg = [(net, i, *[rng.uniform(-20, 150) for _ in range(4)]) for net in (1, 2) for i in range(5)]
    ship = {(net, rng.randrange(-3, 140), rng.randrange(-3, 140)) for net in (1, 2) for _ in range(4000)}
    lines = spark.createDataFrame(seg, "net long, line_id long, x0 double, y0 double, x1 double, y1 double")
    drawn = {tuple(r) for r in cells.rasterize_lines(lines, ["net"], 1.0).collect()}
    got = vectorise.axis_order_check(lines, spark.createDataFrame([*ship, *list(ship)[:50]], "net long, r int, c int"), ["net"], 1.0, 130, 100)
    assert "bit_or" in got._jdf.queryExecution().toString()  # one row a word of 64 columns, not a cell
    for net, iou, swapped, _ in got.collect():
        s = {(r, c) for k, r, c in ship if k == net}
        for value, turn in ((iou, False), (swapped, True)):
            d = {(c, r) if turn else (r, c) for k, r, c in drawn if k == net}
            d = {(r, c) for r, c in d if 0 <= r < 130 and 0 <= c < 100}
            assert value == pytest.approx(len(d & s) / len(d | s), abs=1e-6)
