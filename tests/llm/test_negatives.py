import math

import numpy as np
import pytest

from netgrid.llm import negatives
from netgrid.llm.negatives import Tile, Vectors, hard_negatives, quantised

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def expected(rows):
    """All pairs in Python integers."""
    good = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])]
    one = {}
    for i, v, label in sorted(((i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in good), key=lambda r: (r[0], r[2])):
        one.setdefault(i, (v, label))
    out = []
    for a, (v, label) in one.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, k) for i, (w, k) in one.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(n, i) for n, i, k in scored if k != label and 80 * -s <= 100 * -n <= 100 * -s]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fits[:5], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives(df).select(NAMES).collect())


def rows_of(n, dim, clusters, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dim))
    out = []
    for i in range(n):
        v = centre[i % clusters] + rng.normal(size=dim) * 0.6
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(0, 4))))
    return out


@pytest.mark.parametrize("dim", [64, 5])
def test_all_pairs(spark, monkeypatch, dim):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 16 * dim * 2)  # several blocks of anchors and of rows
    monkeypatch.setattr(negatives, "TILE_ROWS", 8)
    rows = rows_of(420, dim, 6, dim)
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert got == expected(rows) and got


def test_ties_and_odd_rows(spark):
    base = rows_of(230, 8, 3, 1)
    same = [(1000 + i, base[0][1], i % 3) for i in range(60)]  # a group of equal vectors
    odd = [
        (None, base[0][1], 1), (2001, None, 1), (2002, base[0][1], None), (2003, [None, *base[0][1][1:]], 1), (2004, [float("nan")] * 8, 1),
        (2005, [float("inf")] * 8, 1), (2006, [0.0] * 8, 2), (2007, base[0][1][:3], 2), (2008, [], 0), base[0], (base[5][0], base[6][1], 3),
    ]
    rows = base + same + odd
    df = spark.createDataFrame([(*r, "x", 7, 1) for r in rows], SCHEMA + ", vector string, width int, part int")
    full = [(i, v if v is None else [*v, *[0.0] * (8 - len(v))], k) for i, v, k in rows]
    assert mined(df) == expected(full)


def test_long_vectors(spark):
    rows = [(i, [float(np.float32(x * 4e5)) for x in v], k) for i, v, k in rows_of(130, 4, 3, 2)]
    rows.append((131, [1e30, 0.0, 0.0, 0.0], 1))  # beyond the norm: takes no part
    assert mined(spark.createDataFrame(rows, SCHEMA)) == expected(rows[:-1])


def test_empty(spark):
    got = hard_negatives(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == NAMES


def test_bounds_enclose_and_drop(spark):
    t = quantised(spark.createDataFrame(rows_of(300, 64, 10, 3), SCHEMA)).toArrow()
    v = Vectors(t, ["vec_id"])
    exact = v.q.astype(np.int64) @ v.q.astype(np.int64).T
    last = None
    for s in negatives.SEGMENTS:
        m, d = v.summary(s)
        mid, reach = m @ m.T, d @ d.T
        assert (mid + reach >= exact - 1e-6).all() and (mid - reach <= exact + 1e-6).all()
        assert last is None or (reach <= last + 1e-6).all()  # more segments, closer bounds
        last = reach
    lowest = np.sort(exact, axis=1)[:, -6].astype(float)
    tile = Tile(v, v, slice(0, 300), slice(0, 300), np.ones((300, 300), bool))
    tile.narrow(lowest, np.full(300, np.inf))
    assert tile.mask[exact >= lowest[:, None]].all() and tile.mask.mean() < 0.5
