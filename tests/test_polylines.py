"""Linear referencing against plain Python over lists of vertices."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netgrid.operators import edits, polylines
from netgrid.operators.cover import WIDE, cells_along
from netgrid.operators.network import near_segments

LINE = "net long, line_id long, coords array<struct<x:double,y:double>>"
SEG = "net long, line_id long, x0 double, y0 double, x1 double, y1 double"


def df(spark, lines):
    return spark.createDataFrame([(1, i, [tuple(map(float, p)) for p in c]) for i, c in lines], LINE)


def steps(c):
    return [math.dist(p, q) for p, q in zip(c, c[1:])]


def at(c, m):
    for p, q, d in zip(c, c[1:], steps(c)):
        if m <= d and d > 0:
            return p[0] + (q[0] - p[0]) * m / d, p[1] + (q[1] - p[1]) * m / d
        m -= d
    return c[-1]


def gap(p, c):
    """Distance of a point to a line of many vertices, and the measure of its foot."""
    best, m = (math.inf, 0.0), 0.0
    for (x0, y0), (x1, y1), d in zip(c, c[1:], steps(c)):
        t = max(0, min(1, ((p[0] - x0) * (x1 - x0) + (p[1] - y0) * (y1 - y0)) / d**2)) if d else 0
        best = min(best, (math.hypot(p[0] - x0 - t * (x1 - x0), p[1] - y0 - t * (y1 - y0)), m + t * d))
        m += d
    return best


def random_lines(rng, n, size=60.0):
    return [(i, [(rng.uniform(0, size), rng.uniform(0, size)) for _ in range(rng.randint(2, 7))]) for i in range(n)]


def test_measures(spark):
    lines = random_lines(random.Random(1), 20) + [(30, [(0, 0), (0, 0), (3, 4), (3, 4)]), (31, [(1, 1)]), (32, [])]
    got = {}
    for r in polylines.measured(df(spark, lines), ["net"]).collect():
        got.setdefault(r.line_id, []).append(r)
    assert set(got) == {i for i, c in lines if len(c) > 1}
    for i, c in lines:
        m = 0.0
        for r, d in zip(sorted(got.get(i, []), key=lambda r: r.seg_no), steps(c)):
            assert math.isclose(r.m0, m, abs_tol=1e-9) and math.isclose(r.m1, m + d, abs_tol=1e-9)
            assert math.isclose(r.length, sum(steps(c))) and (r.first.x, r.first.y) == c[0] and (r.last.x, r.last.y) == c[-1]
            m += d


def test_shares_are_of_whole_lines(spark):
    rng = random.Random(2)
    lines, zone = random_lines(rng, 25), random_lines(rng, 5)
    lines.append((90, [(5, 5), (5, 5)]))
    got = {r.line_id: r.share for r in polylines.line_shares(polylines.measured(df(spark, lines), ["net"]), polylines.measured(df(spark, zone), ["net"]), ["net"], 3.0).collect()}
    assert got.pop(90) == 0.0
    for i, c in lines[:-1]:
        total = sum(steps(c))
        want = sum(any(gap(at(c, (k + 0.5) * total / 2000), z)[0] <= 3 for _, z in zone) for k in range(2000)) / 2000
        assert abs(got[i] - want) < 0.01


def test_stretches_do_not_overlap(spark):
    rng = random.Random(3)
    seg, zone = polylines.measured(df(spark, random_lines(rng, 20)), ["net"]), polylines.measured(df(spark, random_lines(rng, 6)), ["net"])
    by = {}
    for r in polylines.along(seg, zone, ["net"], 3.0).collect():
        by.setdefault(r.line_id, []).append((r.m0, r.m1))
    assert by and all(a[1] < b[0] for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:]))


def test_pieces_keep_inner_vertices(spark):
    rng = random.Random(4)
    lines = random_lines(rng, 30) + [(40, [(0, 0), (3, 4), (3, 4), (6, 8)]), (41, [(2, 2), (2, 2)])]
    cuts = {i: [rng.uniform(-1, sum(steps(c)) + 1) for _ in range(rng.randint(0, 5))] for i, c in lines}
    cuts[40] = [5.0, 5.2, 9.8]
    rows = spark.createDataFrame([(1, i, m) for i, v in cuts.items() for m in v], "net long, line_id long, at double")
    got = {}
    for r in polylines.split_lines(df(spark, lines), rows, ["net"]).collect():
        got.setdefault(r.line_id, []).append((r.piece, [(p.x, p.y) for p in r.coords], r.m0, r.m1))
    for i, c in lines:
        total, last, marks = sum(steps(c)), -1e18, [0.0]
        for m in sorted(cuts[i]):
            if 0.5 <= m <= total - 0.5 and m - last >= 0.5:
                marks.append(m)
                last = m
        marks.append(total)
        pieces = sorted(got[i])
        assert [p[0] for p in pieces] == list(range(1, len(marks)))
        vertices = [sum(steps(c)[:k]) for k in range(len(c))]
        for (_, coords, m0, m1), lo, hi in zip(pieces, marks, marks[1:]):
            assert math.isclose(m0, lo, abs_tol=1e-9) and math.isclose(m1, hi, abs_tol=1e-9)
            if i < 40:
                want = [at(c, lo)] + [p for p, m in zip(c, vertices) if lo < m < hi] + [at(c, hi)]
                assert len(coords) == len(want) and all(math.dist(p, q) < 1e-6 for p, q in zip(coords, want))
    assert [p[1] for p in sorted(got[40])] == [[(0, 0), (3, 4)], [(3, 4), (3, 4), (6, 8)]]
    assert got[41] == [(1, [(2, 2), (2, 2)], 0.0, 0.0)]


def test_ends_snap_to_the_nearest_line(spark):
    rng = random.Random(5)
    others = [(i, c) for i, c in random_lines(rng, 12)]
    human = [(100 + i, [(x, y), (x + 20, y + 30), (x + 5, y + 60)]) for i, (x, y) in enumerate((rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(40))]
    rows = polylines.snap_line_ends(df(spark, human), polylines.measured(df(spark, others + human), ["net"]), ["net"], 3.0).collect()
    got = {(r.line_id, r.end): r for r in rows}
    for i, c in human:
        for e, p in ((0, c[0]), (1, c[-1])):
            best = min((*gap(p, o), k) for k, o in others + human if k != i)
            if best[0] > 3:
                assert (i, e) not in got
                continue
            r, o = got[i, e], dict(others + human)[best[2]]
            assert r.other_id == best[2]
            foot = at(o, best[1])
            own = next((q for q in (o[0], o[-1]) if math.dist(q, foot) <= 3), None)
            assert math.dist((r.x, r.y), own or foot) < 1e-6 and (r.cut_at is None) == (own is not None)
            assert own or math.isclose(r.cut_at, best[1], abs_tol=1e-6)
    assert any(r.cut_at is not None for r in rows) and any(r.cut_at is None for r in rows)


def test_near_ties_fall_as_in_sql(spark, tmp_path):
    # lines of 60 copies of sf0.1, whose distances differ in the last place
    from netgrid.catalog import ORACLES, QUERIES
    from netgrid import queries_polylines  # noqa: F401  registers

    duckdb = pytest.importorskip("duckdb")
    rows = [(1804995, 185325), (1858818, 185326), (1878285, 185300), (4247667, 428750), (4259175, 428775), (4276878, 428751)]
    spark.createDataFrame([(*r, "F") for r in rows], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in QUERIES["f4_snap_polylines"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == set(con.execute(ORACLES["f4_snap_polylines"]).fetchall())
    assert {(r[1], r[3]) for r in got if r[2] == 1} >= {(1858818, 1804995), (4276878, 4247667)}


def status(rows):
    out = {}
    for r in rows:
        out.setdefault(r.status, []).append((r.line_id, r.piece))
    return {k: sorted(v) for k, v in out.items()}


# a bent street, a lane that meets it at a bend, and one apart from both
STREETS = [(1, [(0, 0), (150, 20), (300, -10), (500, 0)]), (2, [(150, -180), (140, -80), (150, 20)]), (3, [(0, 250), (250, 262), (500, 250)])]


def test_a_bend_alone_is_not_deleted(spark):
    """A third of a line runs along what was deleted: by segments it would lose that third, as a line it stays."""
    none = df(spark, []).select("*")
    gone = df(spark, [(8, [(0, 0), (150, 20)])])
    got = edits_of(spark, STREETS, [], gone)
    assert got == {"model": [(1, 1), (2, 1), (3, 1)]}
    gone = df(spark, [(8, [(0, 1), (150, 21), (300, -9), (330, -8)])])
    assert edits_of(spark, STREETS, [], gone)["deleted"] == [(1, 1)]
    assert edits_of(spark, STREETS, [], none) == {"model": [(1, 1), (2, 1), (3, 1)]}


def edits_of(spark, model, human, gone=None):
    gone = df(spark, []) if gone is None else gone
    return status(polylines.merge_lines(df(spark, model), df(spark, human), gone, ["net"]).collect())


def test_drawn_line_splits_what_it_lands_on(spark):
    new = polylines.merge_lines(df(spark, STREETS), df(spark, [(9, [(250, 150), (260, 90), (225, 6.5)])]), df(spark, []), ["net"])
    rows = {(r.line_id, r.piece): r for r in new.collect()}
    assert status(rows.values()) == {"model": [(1, 1), (1, 2), (2, 1), (3, 1)], "human": [(9, 1)]}
    a, b, h = ([(p.x, p.y) for p in rows[k].coords] for k in ((1, 1), (1, 2), (9, 1)))
    assert a[-1] == b[0] and math.dist(a[-1], h[-1]) < 1e-9 and a[:2] == [(0.0, 0.0), (150.0, 20.0)] and b[1:] == [(300.0, -10.0), (500.0, 0.0)] and h[1] == (260.0, 90.0)
    assert math.isclose(rows[1, 1].length + rows[1, 2].length, sum(steps(STREETS[0][1])), rel_tol=1e-9)
    s = edits.network_stats(new, ["net"]).first()
    assert (s.n_model, s.n_human, s.n_snapped_ends) == (4, 1, 1) and math.isclose(s.human_length_m, round(sum(steps(h)), 1))


def test_redrawn_line_supersedes(spark):
    got = edits_of(spark, STREETS, [(9, [(0, 251), (250, 263), (500, 251)])])
    assert got["superseded"] == [(3, 1)] and got["human"] == [(9, 1)]


def test_straight_segments_are_lines_too(spark):
    seg = spark.createDataFrame([(1, 1, 0.0, 0.0, 400.0, 0.0), (1, 2, 0.0, 90.0, 400.0, 90.0)], SEG)
    got = status(polylines.merge_lines(seg, seg.limit(0), seg.where("line_id = 2").withColumn("line_id", F.lit(7)), ["net"]).collect())
    assert got == {"model": [(1, 1)], "deleted": [(2, 1)]}


@pytest.mark.parametrize("pad", [0.0, 4.0, 150.0])
def test_cover_grows_with_length(spark, pad):
    """A diagonal of 100 km takes thousands of cells, not the million of its box; every near point lies in one of them."""
    rng = random.Random(6)
    seg = [(1, 0, 0.0, 0.0, 1e5, 1e5), (1, 1, -5.0, 7.0, -5.0, 7.0)] + [(1, i, *[rng.uniform(-900, 900) for _ in range(4)]) for i in range(2, 60)]
    c = F.col
    rows = {r.line_id: r.c for r in spark.createDataFrame(seg, SEG).select("line_id", cells_along(c("x0"), c("y0"), c("x1"), c("y1"), pad, 100.0).alias("c")).collect()}
    assert all(len(v) == len(set(v)) for v in rows.values())
    assert len(rows[0]) <= 1000 * (6 if pad < 100 else 16)
    for _, i, x0, y0, x1, y1 in seg[1:]:
        for _ in range(40):
            t, a, d = rng.random(), rng.uniform(0, 2 * math.pi), rng.uniform(0, pad)
            x, y = x0 + t * (x1 - x0) + d * math.cos(a), y0 + t * (y1 - y0) + d * math.sin(a)
            assert math.floor(x / 100) * WIDE + math.floor(y / 100) in rows[i]


def test_near_segments_is_linear_in_length(spark):
    seg = spark.createDataFrame([(1, 5, 0.0, 0.0, 1e5, 1e5)], SEG)
    at_ = spark.createDataFrame([(1, float(k), k + 2.0) for k in range(0, 100000, 5000)] + [(1, 50.0, 900.0)], "net long, x double, y double")
    got = near_segments(at_, seg, ["net"], 3.0)
    assert got.count() == 20 and all(math.isclose(r.d, math.sqrt(2), rel_tol=1e-6) for r in got.collect())


def test_measures_are_not_shuffled(spark):
    """A line's measures come from its own row, in parts where it is long."""
    rng = random.Random(8)
    lines = [(i, [(rng.uniform(0, 99), rng.uniform(0, 99)) for _ in range(n)]) for i, n in enumerate((64, 65, 66, 129, 500))]
    got = polylines.measured(df(spark, lines), ["net"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.line_id, r.seg_no): (r.m0, r.m1, r.x0, r.y1) for r in got.collect()}
    assert len(rows) == sum(len(c) - 1 for _, c in lines)
    for i, c in lines:
        m = 0.0
        for k, d in enumerate(steps(c)):
            m0, m1, x, y = rows[i, k]
            assert math.isclose(m0, m, abs_tol=1e-9) and math.isclose(m1, m + d, rel_tol=1e-12) and (x, y) == (c[k][0], c[k + 1][1])
            m += d
