import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql.types import LongType, StructField

from netgrid.operators import cells, curate, edits, evaluate, grid, ledger, lines
from netgrid.plans import order
from netgrid.plans.components import connected_components, merged_components
from netgrid.sources import tables
from netgrid.streaming import trace

SEG = "net long, line_id long, x0 double, y0 double, x1 double, y1 double"
quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def brute_components(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(top)}


@quick
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


def report(spark, rows):
    return lines.topology_report(spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], SEG), ["net"]).first()


def test_topology_scenarios(spark):
    assert report(spark, [(0, 0, 2, 0), (3, 0, 10, 0)]).n_components == 1  # ends in different grid cells, within the tolerance
    assert report(spark, [(0, 0, 10, 0), (40, 0, 80, 0)]).n_components == 2
    r = report(spark, [(0, 0, 100, 0), (100, 0, 200, 0), (100, 0, 100, 100)])
    assert (r.n_junctions, r.n_dangles) == (1, 3)
    r = report(spark, [(0, 0, 1000, 0), (1000, 0, 2000, 0), (5000, 0, 5010, 0)])
    assert r.n_components == 2 and r.largest_share > 0.99
    assert report(spark, [(0, 0, 1000, 0), (3000, 0, 3005, 0), (6000, 0, 6004, 0)]).short_fragments == 2


def test_topology_of_large_networks_is_that_of_small_ones(spark):
    rng = random.Random(8)
    rows = [(net, i, *[rng.choice([0, 10, 20, 30]) + rng.uniform(-1, 1) for _ in range(4)]) for net in (1, 2, 3) for i in range(4 * net)]
    df = spark.createDataFrame([*rows, (2, 90, None, 1.0, 5.0, 5.0), (3, 91, 70.0, 70.0, 70.0, 90.0), (4, 92, None, None, None, 1.0)], SEG)
    got = [sorted(map(tuple, lines.topology_report(df, ["net"], most=most).collect())) for most in (200_000, 6, 1)]
    assert len(got[0]) == 3 and got[0] == got[1] == got[2]


def test_close_points_in_groups():
    from netgrid.operators.nodes import clusters

    rng = random.Random(5)
    p = [(rng.randrange(3), rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(150)]
    near = [(a, b) for a in range(150) for b in range(a) if p[a][0] == p[b][0] and math.dist(p[a][1:], p[b][1:]) <= 1.5]
    g, x, y = map(np.array, zip(*p))
    want = brute_components(near)
    assert clusters(g, x, y, 1.5).tolist() == [want.get(i, i) for i in range(150)]


def test_clusters_are_transitive(spark):
    chain = [(1, 0, 2.0 * i, 0.0, 2.0 * i, 50.0 + 100 * i) for i in range(6)]
    pts = lines.endpoints(spark.createDataFrame([(n, i, x, y, a, b) for i, (n, _, x, y, a, b) in enumerate(chain)], SEG), ["net"]).where("y = 0")
    assert lines.cluster_endpoints(pts, ["net"], 2.5).select("node").distinct().count() == 1


def distance(px, py, a):
    x0, y0, x1, y1 = a
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0, min(1, ((px - x0) * dx + (py - y0) * dy) / n))
    return math.hypot(px - x0 - t * dx, py - y0 - t * dy)


def test_share_along_against_sampling(spark):
    rng = random.Random(3)
    seg = [(1, i, *[rng.uniform(0, 60) for _ in range(4)]) for i in range(25)]
    zone = [(1, 100 + i, *[rng.uniform(0, 60) for _ in range(4)]) for i in range(6)] + [(1, 200, 10.0, 10.0, 10.0, 10.0), (1, 201, 0.0, 5.0, 50.0, 5.0)]
    seg.append((1, 99, 0.0, 5.0, 25.0, 5.0))
    got = {r.line_id: r.share for r in lines.share_along(spark.createDataFrame(seg, SEG), spark.createDataFrame(zone, SEG), ["net"], 4.0, 20.0).collect()}
    for _, i, x0, y0, x1, y1 in seg:
        t = [(k + 0.5) / 2000 for k in range(2000)]
        want = sum(any(distance(x0 + u * (x1 - x0), y0 + u * (y1 - y0), z[2:]) <= 4 for z in zone) for u in t) / 2000
        assert abs(got[i] - want) < 0.005


def test_merge(spark):
    df = lambda r: spark.createDataFrame(r, SEG)
    model = df([(1, 1, 0.0, 0.0, 400.0, 0.0), (1, 2, 200.0, -200.0, 200.0, 0.0), (1, 3, 0.0, 300.0, 400.0, 300.0)])
    got = {r.line_id: r.status for r in edits.merge_network(model, df([(1, 9, 0.0, 302.0, 400.0, 302.0)]), df([(1, 8, 0.0, 2.0, 400.0, 2.0)]), ["net"]).collect()}
    assert got == {1: "deleted", 2: "model", 3: "superseded", 9: "human"}


def test_undo_and_redo(spark):
    ops = "add add undo redo undo add undo undo undo redo redo redo".split()
    log = spark.createDataFrame([(1, i, o) for i, o in enumerate(ops[:6])] + [(2, i, o) for i, o in enumerate(ops)], "job_id long, seq long, op string")
    got = {}
    for r in lines.live_operations(log).collect():
        got.setdefault(r.job_id, []).append(r.seq)
    assert sorted(got[1]) == [0, 5] and sorted(got[2]) == [0, 5]


@pytest.mark.parametrize("total", [3000, 1500, 700, 128, 40])
def test_chips_cover_every_cell(spark, total):
    chips = grid.plan_chips(spark.createDataFrame([(1, total, 64)], "raster_id long, width int, height int"), 128, 32).collect()
    seen = set()
    for r in chips:
        assert 0 <= r.col_off and r.col_off + r.w <= max(total, 128)
        seen |= set(range(r.col_off, r.col_off + r.w))
    assert set(range(total)) <= seen
    with pytest.raises(ValueError):
        grid.plan_chips(spark.createDataFrame([(1, 5, 5)], "raster_id long, width int, height int"), 16, 16)


def test_stitching_true_chips_gives_the_original(spark):
    rng = random.Random(1)
    src = [(1, r, c, rng.random()) for r in range(20) for c in range(30)]
    cell = spark.createDataFrame(src, "raster_id long, r int, c int, v double")
    chips = grid.plan_chips(spark.createDataFrame([(1, 30, 20)], "raster_id long, width int, height int"), 12, 4).drop("width", "height")
    each = grid.cells_to_chips(cell, chips, "raster_id", 12).selectExpr("*", "r - row_off AS i", "c - col_off AS j")
    got = {(x.r, x.c): x.v for x in grid.stitch(each, ["raster_id"], 4).collect()}
    assert len(got) == 600 and all(abs(got[r, c] - v) < 1e-9 for _, r, c, v in src)


@quick
@given(st.sets(st.tuples(st.integers(0, 11), st.integers(0, 140)), max_size=60), st.sampled_from([4, 8]))
def test_labels(spark, mask, conn):
    near = [(0, 1), (1, 0), (1, 1), (1, -1)] if conn == 8 else [(0, 1), (1, 0)]
    edges = [((r, c), (r + a, c + b)) for r, c in mask for a, b in near if (r + a, c + b) in mask] + [(m, m) for m in mask]
    want = brute_components(edges)
    got = cells.label_components(spark.createDataFrame([(1, *m) for m in mask], "k long, r int, c int"), ["k"], conn).collect()
    by = {}
    for x in got:
        by.setdefault(x.label, set()).add((x.r, x.c))
    true = {}
    for m, root in want.items():
        true.setdefault(root, set()).add(m)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, true.values()))


def test_fill_and_clean(spark):
    ring = [(1, r, c) for r in range(3, 9) for c in range(3, 9) if not (5 <= r <= 6 and 5 <= c <= 6)] + [(1, 15, 15)]
    m = spark.createDataFrame(ring, "k long, r int, c int")
    assert cells.fill_holes(m, ["k"], 5, 20, 20).count() == 37
    assert cells.fill_holes(m, ["k"], 4, 20, 20).count() == 33
    assert cells.clean_mask(m, ["k"], 20, 20, 0, 5, 10).count() == 36


def test_confusion_of_empty_masks(spark):
    e = spark.createDataFrame([], "k long, r int, c int")
    one = spark.createDataFrame([(1, 0, 0)], "k long, r int, c int")
    assert evaluate.confusion(e, e, ["k"]).count() == 0
    r = evaluate.confusion(one, e, ["k"]).first()
    assert (r.tp, r.fp, r.fn, r.iou, r.recall) == (0, 1, 0, 0.0, 0.0)


def test_keep_best_ignores_other_maps(spark):
    m = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.8, 1), (1, 3, 0.9, 2), (1, 4, 0.802, 1), (1, 5, 0.81, 1)], "task_id long, step int, score double, version long")
    assert [r.step for r in ledger.running_best(m).where("is_best").orderBy("step").collect()] == [1, 2, 5]


def test_splits(spark):
    items = spark.createDataFrame([(i,) for i in range(135)], "idx long")
    a = curate.split_exact(items, 0.15, "idx", "7")
    assert a.where("held").count() == 20 and a.count() == 135
    assert a.where("held").exceptAll(curate.split_exact(items, 0.15, "idx", "7").where("held")).count() == 0


def test_geojson(spark, tmp_path):
    p = tmp_path / "a.geojson"
    p.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"k":1},"geometry":{"type":"LineString","coordinates":[[0,0],[1,2]]}},'
                 '{"type":"Feature","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[100,0]],[[5,5]],[[500,500],[600,500]]]}}]}')  # fmt: skip
    got = tables.read_features(spark, str(p))
    assert sorted(r.feature_id for r in got.collect()) == ["m-0", "m-1", "m-1.2"]
    tables.write_features(got, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def run_stream(spark, tmp_path, df, schema, build, name):
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
    out = build(spark.readStream.schema(schema).parquet(str(tmp_path / name)))
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_ledger_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    m = spark.createDataFrame([(t, s, rng.random(), rng.randrange(2)) for t in range(5) for s in range(1, 9)], "task_id long, step int, score double, version long")
    got = run_stream(spark, tmp_path, m, m.schema, trace.stream_ledger, "ledger_rows")
    key = lambda rows: sorted((r.task_id, r.step, r.is_best) for r in rows)
    assert key(got.collect()) == key(ledger.running_best(m).collect())


def test_stream_windows_match_batch_up_to_the_watermark(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 3, t0 + dt.timedelta(minutes=7 * i), "tool_call" if i % 2 else "tool_result") for i in range(60)]
    ev = spark.createDataFrame(rows, "job_id long, at timestamp, type string")
    got = run_stream(spark, tmp_path, ev, ev.schema, lambda s: trace.activity_windows(s, "1 hour"), "window_rows")
    key = lambda d: {(r.job_id, r.start, r.n, r.calls) for r in d.collect()}
    assert key(got) and key(got) <= key(trace.activity_windows(ev, "1 hour"))


def test_ranks_and_folds(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long, k long")
    want = {i: n for n, (v, i) in enumerate(sorted((v, i) for i, v, _ in rows))}
    assert {r.id: r.place for r in order.ranked(df, ["v", "id"], "place").collect()} == want
    assert order.ranked(df.limit(0), ["v", "id"]).count() == 0

    def step(state, i, v):
        state.append(v)
        return (i, sum(state)) if v % 2 else None

    fields = [StructField("id", LongType()), StructField("total", LongType())]
    got = order.fold(df, "k", "id", ["id", "v"], fields, list, step, lambda s: [(-1, sum(s))]).collect()
    seen, want = {}, set()
    for i, v, k in rows:
        seen[k] = seen.get(k, 0) + v
        if v % 2:
            want.add((k, i, seen[k]))
    assert {tuple(r) for r in got} == want | {(k, -1, n) for k, n in seen.items()} and len(got) == len(want) + len(seen)


def test_version_counts_repeated_rows(spark):
    one = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.7)], "k long, r long, c long, conf double")
    version = lambda df: ledger.content_version(df, ["k"]).first().version
    assert version(one) == version(one.orderBy("conf", ascending=False))
    assert len({version(one), version(one.unionByName(one)), version(one.unionByName(one).unionByName(one)), version(one.limit(1))}) == 4
    twice = one.unionByName(one)
    assert version(twice) != version(twice.unionByName(spark.createDataFrame([(1, 5, 5, 0.1)] * 2, one.schema)))


def test_sweep_with_nulls(spark):
    df = spark.createDataFrame([(1, 0.3, 1), (1, 0.5, 0), (1, None, 1), (1, 0.9, 1)], "k long, conf double, truth long")
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluate.sweep(df, ["k"], [0.95, 0.3, 0.5]).collect()}
    assert got == {0.3: (2, 1, 1), 0.5: (1, 1, 2), 0.95: (0, 0, 3)}


def test_merged_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    df = lambda e: spark.createDataFrame(e, "u long, v long")
    parts = connected_components(df(edges[:120]))
    parts = merged_components(merged_components(parts, df(edges[120:200]), "u", "v"), df(edges[200:]), "u", "v")
    whole = connected_components(df(edges))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, merged_components(parts, df(edges).limit(0), "u", "v").collect())) == sorted(map(tuple, parts.collect()))
