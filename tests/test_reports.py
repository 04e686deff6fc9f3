"""Reports against the same network in another frame, and against masks counted by hand."""

import math

import numpy as np
import pytest

from netgrid.operators import reports
from netgrid.operators.vectorise import thin

LINE = "net long, line_id long, coords array<struct<x:double,y:double>>, crs string"
STREETS = [(1, [(0, 0), (150, 20), (300, 0)]), (2, [(300, 0), (420, 90), (420, 300)]), (3, [(0, 900), (20, 905)]), (4, [(299, 1), (500, -200)])]


def df(spark, nets):
    return spark.createDataFrame([(n, i, [tuple(map(float, p)) for p in c], crs) for n, crs, lines in nets for i, c in lines], LINE)


@pytest.mark.parametrize("declared", [None, "urn:ogc:def:crs:EPSG::4326"])
def test_degrees_equal_metres(spark, declared):
    lat0 = 42.3
    deg = [(i, [(-71.0 + x / (111320 * math.cos(math.radians(lat0))), lat0 + y / 110540) for x, y in c]) for i, c in STREETS]
    lines = df(spark, [(1, None if declared is None else "EPSG:26986", STREETS), (2, declared, deg)])
    nets = spark.createDataFrame([(1,), (2,), (3,)], "net long")
    got = {r.net: r for r in reports.network_report(lines, nets, ["net"], "crs" if declared else None).collect()}
    assert not got[1].geographic and got[2].geographic
    for c in ("n_lines", "n_nodes", "n_dangles", "n_junctions", "n_components", "short_fragments", "verdict", "dangle_ratio"):
        assert got[1][c] == got[2][c], c
    assert abs(got[1].total_length - got[2].total_length) < 1 and abs(got[1].score - got[2].score) < 1e-3
    length = sum(math.dist(p, q) for _, c in STREETS for p, q in zip(c, c[1:]))
    assert abs(got[1].total_length - length) < 0.06 and (got[1].n_lines, got[1].n_components, got[1].n_junctions, got[1].short_fragments) == (4, 2, 1, 1)
    assert len(got[1].notes) == 3 and "2 separate parts" in got[1].notes[0]
    assert (got[3].verdict, got[3].n_lines, got[3].score, got[3].notes) == ("empty", 0, 0.0, ["no lines"])


def test_whole_network_has_nothing_to_note(spark):
    ring = [(1, [(0, 0), (100, 0)]), (2, [(100, 0), (100, 100)]), (3, [(100, 100), (0, 0)])]
    (r,) = reports.network_report(df(spark, [(1, None, ring)]), df(spark, [(1, None, ring)]), ["net"]).collect()
    assert (r.verdict, r.notes, r.score) == ("coherent", ["nothing found"], 1.0)


def test_tiles_are_summed_before_they_are_divided(spark):
    rng = np.random.default_rng(7)
    masks = {}
    for k in range(3):
        truth = np.zeros((40, 50), bool)
        truth[18:23, :] = True
        pred = np.roll(truth, k, axis=0) & (rng.random(truth.shape) < (1.0, 0.9, 0.5)[k])
        masks[k] = pred, truth
    masks[3] = np.zeros((40, 50), bool), np.ones((40, 50), bool)
    cells = lambda which: spark.createDataFrame([(1, k, int(r), int(c)) for k, m in masks.items() for r, c in np.argwhere(m[which])], "part long, tile long, r long, c long")
    got = {r.tile: r for r in reports.tile_report(cells(0), cells(1), ["part"], "tile", 40, 50, clean=None).collect()}

    def skeletons(which):
        out = {k: np.zeros((40, 50), bool) for k in masks}
        for r in thin(cells(which), ["part", "tile"]).collect():
            out[r.tile][r.r, r.c] = True
        return out

    def grown(m, inside):
        out = np.zeros_like(m)
        for r, c in np.argwhere(m):
            for y in range(-5, 6):
                for x in range(-5, 6):
                    if inside(y, x) and 0 <= r + y < 40 and 0 <= c + x < 50:
                        out[r + y, c + x] = True
        return out

    lines, total = (skeletons(0), skeletons(1)), np.zeros(9)
    for k, (p, t) in masks.items():
        sp, st = lines[0][k], lines[1][k]
        dia, disk = (lambda y, x: abs(y) + abs(x) <= 3), (lambda y, x: y * y + x * x <= 25)
        n = [(p & t).sum(), p.sum(), t.sum(), (p & grown(t, dia)).sum(), (t & grown(p, dia)).sum(), sp.sum(), (sp & grown(st, disk)).sum(), st.sum(), (st & grown(sp, disk)).sum()]
        total += n
        assert abs(got[k].tile_iou - n[0] / max(n[1] + n[2] - n[0], 1)) < 1e-4 and abs(got[k].tile_completeness - n[8] / max(n[7], 1)) < 1e-4
    f1 = lambda a, b: 2 * a * b / (a + b)
    r, n = got[None], total
    assert r.n_tiles == 4 and r.tile_iou is None
    want = {"iou": n[0] / (n[1] + n[2] - n[0]), "precision": n[0] / n[1], "recall": n[0] / n[2], "relaxed_f1": f1(n[3] / n[1], n[4] / n[2]), "correctness": n[6] / n[5], "completeness": n[8] / n[7]}
    assert all(abs(r[c] - v) < 1e-4 for c, v in want.items())
    cleaned = {r.tile: r for r in reports.tile_report(cells(0), cells(1), ["part"], "tile", 40, 50).collect()}
    assert cleaned[0].completeness == 1.0 and cleaned[3].completeness == 0.0
