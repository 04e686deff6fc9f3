"""Greedy selection against a plain loop over every place, and distances against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netgrid.operators import curate
from netgrid.operators.distance import label_width, lower_envelope, squared_distances
from netgrid.operators.vectorise import thin


def plain(items, n, cap):
    """``items``: (idx, site); tries all places in the order of their distance."""
    items = sorted(items, key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    used, full, out = set(), Counter(), []
    for target in np.linspace(0, len(items) - 1, n) if items and n > 0 else ():
        t = round(float(target))
        for place in sorted(range(len(items)), key=lambda p: (abs(p - t), -p)):
            if place not in used and full[items[place][1]] < cap:
                used.add(place)
                full[items[place][1]] += 1
                out.append(items[place])
                break
    return sorted(out, key=str)


def cases():
    rng = random.Random(11)
    for k in range(200):
        size, sites = rng.choice([0, 1, 2, 7, 30, 80]), rng.choice([1, 3, 20, 1000])
        hot = rng.random() < 0.3
        items = [(i * 3, 0 if hot and rng.random() < 0.6 else rng.randrange(sites)) for i in range(size)]
        yield k, items, rng.choice([1, 2, 5, 12, 60]), rng.choice([1, 2, 4])


def test_places_equal_the_plain_loop():
    for _, items, n, cap in cases():
        got = curate.picked_places(list(range(len(items))), [s for _, s in items], len(items), n, cap)
        assert sorted((items[i] for i in got), key=str) == plain(items, n, cap)


def test_greedy_pick_equals_the_plain_loop(spark):
    """All 200 selections in one job, each cut down to what its targets can reach."""
    all_ = list(cases())
    rows = [(k, i, s) for k, items, _, _ in all_ for i, s in items]
    sets = spark.createDataFrame([(k, n, cap) for k, _, n, cap in all_], "set long, n int, cap int")
    got = {}
    for r in curate.greedy_pick(spark.createDataFrame(rows, "set long, idx long, site long"), sets, "set").collect():
        got.setdefault(r.set, []).append((r.idx, r.site))
    for k, items, n, cap in all_:
        assert sorted(got.get(k, []), key=str) == plain(items, n, cap)


def test_long_selection_is_cut_down(spark):
    """A hot site with most rows; far fewer rows than there are reach the task, with the plain loop's picks."""
    rng = random.Random(12)
    items = [(i, 0 if rng.random() < 0.9 else rng.randrange(1, 40)) for i in range(6000)]
    df = spark.createDataFrame(items, "idx long, site long")
    assert sorted(((r.idx, r.site) for r in curate.greedy_spread(df, 25, 3).collect()), key=str) == plain(items, 25, 3)
    assert curate.greedy_spread(df.limit(0), 5, 1).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None), (3, 4)], "idx long, site long")
    assert sorted((r.idx for r in curate.greedy_spread(nulls, 3, 1).collect())) == [1, 3]


def test_selected_regions_do_not_leak(spark):
    rows = [(i, "test" if i % 5 == 0 else "val" if i % 5 == 1 else "train", f"s{i if i % 37 else 3}", i // 4) for i in range(600)]
    items = spark.createDataFrame(rows, "idx long, split string, sha string, site long")
    parts = {}
    for r in curate.select_regions(items, 60, 12, 20, 3, 5, 2, greedy=True).collect():
        parts.setdefault(r.part, []).append(r.idx)
    assert plain([(i, s) for i, sp, _, s in rows if sp == "test"], 20, 1) == sorted(((i, i // 4) for i in parts["id_test"]), key=str)
    sites = {k: {i // 4 for i in v} for k, v in parts.items()}
    assert not sites["ft_train"] & (sites["ft_val"] | sites["id_test"]) and not sites["ft_val"] & sites["id_test"]
    assert len(parts["ft_val"]) == 12 and max(Counter(i // 4 for i in parts["ft_train"]).values()) <= 2


# ---- distances ----


def cells_of(spark, masks):
    return spark.createDataFrame([(k, int(r), int(c)) for k, m in masks.items() for r, c in np.argwhere(m)], "net long, r long, c long")


def all_pairs(m):
    """Squared distance of every set cell to the nearest clear one."""
    clear = np.argwhere(~m)
    return {(int(r), int(c)): (int(((clear - (r, c)) ** 2).sum(1).min()) if len(clear) else None) for r, c in np.argwhere(m)}


def test_lower_envelope():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sites = np.sort(rng.choice(40, int(rng.integers(1, 12)), replace=False))
        heights = rng.integers(0, 50, len(sites)).astype(float) ** 2
        at = np.arange(-5, 45)
        assert lower_envelope(sites, heights, at).tolist() == ((at[:, None] - sites) ** 2 + heights).min(1).tolist()


def test_distances_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    masks = {k: rng.random((23, 31)) < p for k, p in enumerate((0.02, 0.3, 0.7, 0.95, 0.995, 1.0))}
    masks[10] = np.zeros((23, 31), bool)
    masks[10][5:16, :] = True  # a band from edge to edge
    masks[11] = ~np.zeros((23, 31), bool)
    masks[11][0, 0] = False
    masks[12] = np.zeros((23, 31), bool)
    masks[12][:, 30] = True
    got = {}
    for r in squared_distances(cells_of(spark, masks).unionByName(spark.createDataFrame([(0, -1, 3), (0, 99, 3)], "net long, r long, c long")), ["net"], 23, 31).collect():
        got.setdefault(r.net, {})[r.r, r.c] = None if r.d2 is None else int(r.d2)
    for k, m in masks.items():
        assert got.get(k, {}) == all_pairs(m), k


@pytest.mark.parametrize("wide", [3, 7])
def test_widths_of_straight_roads(spark, wide):
    m = np.zeros((80, 120), bool)
    m[30 : 30 + wide, :] = True
    n = np.zeros_like(m)
    n[:, 50 : 50 + wide] = True
    rows = {r.net: r for r in label_width(cells_of(spark, {1: m, 2: n}), ["net"], 80, 120).collect()}
    for k, mask in ((1, m), (2, n)):
        skeleton = [(r.r, r.c) for r in thin(cells_of(spark, {k: mask}), ["net"]).collect()]
        d = all_pairs(mask)
        assert abs(rows[k].edt - 2 * np.mean([d[x] ** 0.5 for x in skeleton])) < 1e-9
        assert abs(rows[k].area_per_skeleton - mask.sum() / len(skeleton)) < 1e-9 and rows[k].run_mode == wide
        assert wide <= rows[k].edt <= wide + 1.5
    assert label_width(cells_of(spark, {1: m}).where(F.col("r") < 0), ["net"], 80, 120).count() == 0
