"""Projections: there and back, published distances, and scale along both directions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netgrid.operators import polylines, projection

LINE = "net long, line_id long, coords array<struct<x:double,y:double>>"


def df(spark, lines):
    return spark.createDataFrame([(n, i, [tuple(map(float, p)) for p in c]) for n, i, c in lines], LINE)


def test_there_and_back(spark):
    rng = random.Random(1)
    lines = []
    for i in range(400):
        zone, lat = rng.randint(1, 60), rng.uniform(-80, 84)
        lines.append((i, zone, [(zone * 6 - 183 + rng.uniform(-5, 5), lat), (zone * 6 - 183.0, lat)]))
    rows = df(spark, lines).withColumn("epsg", (F.when(F.get("coords", F.lit(0))["y"] >= 0, 32600).otherwise(32700) + F.col("line_id")).cast("int"))
    for code, limit in ((F.col("epsg"), 1e-3), (F.lit(3857), 1e-3), (F.lit(4326), 1e-12)):
        back = rows.withColumn("b", projection.from_frame(projection.to_frame(F.col("coords"), code), code)).collect()
        for r in back:
            for p, q in zip(r.coords, r.b):
                assert math.hypot((p.x - q.x) * 111320 * math.cos(math.radians(p.y)), (p.y - q.y) * 110540) < limit


def utm_of(lon, lat):
    """The first terms of another expansion (in powers of the longitude), good to a few millimetres within a degree."""
    a, f, k = projection.MAJOR, projection.FLATTENING, projection.SCALE
    e2 = f * (2 - f)
    phi, lam = math.radians(lat), math.radians(lon - ((int((lon + 180) // 6) + 1) * 6 - 183))
    nu, t, c = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, e2 / (1 - e2) * math.cos(phi) ** 2
    x = lam * math.cos(phi)
    steps = 20000  # the meridian's length by Simpson's rule
    g = lambda p: a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    h = phi / steps
    m = h / 3 * (g(0) + g(phi) + 4 * sum(g(h * i) for i in range(1, steps, 2)) + 2 * sum(g(h * i) for i in range(2, steps, 2)))
    east = k * nu * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e2 / (1 - e2)) * x**5 / 120)
    north = k * (m + nu * math.tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t) * x**6 / 720))
    return 500000 + east, north + (0 if lat >= 0 else 10000000)


def test_equals_another_expansion(spark):
    rng = random.Random(2)
    points = [(rng.randint(1, 60) * 6 - 183 + rng.uniform(-1, 1), rng.uniform(-70, 70)) for _ in range(30)] + [(3.0, 45.0), (3.0, 0.0)]
    lines = df(spark, [(i, 1, [p]) for i, p in enumerate(points)])
    rows = lines.join(projection.frames(lines, ["net"]), "net").select("net", projection.to_frame(F.col("coords"), F.col("epsg"))[0].alias("p")).collect()
    for r in rows:
        east, north = utm_of(*points[r.net])
        assert abs(r.p.x - east) < 0.005 and abs(r.p.y - north) < 0.005
    at = {r.net: r.p for r in rows}
    assert abs(at[30].y - 0.9996 * 4984944.378) < 1e-3 and (at[31].x, at[31].y) == (500000.0, 0.0)


def test_frames_and_errors(spark):
    lines = df(spark, [(1, 1, [(-71.0, 42.0), (-71.2, 42.1)]), (2, 1, [(151.2, -33.9)]), (3, 1, []), (4, 1, [(180.0, 10.0)])])
    assert {r.net: r.epsg for r in projection.frames(lines, ["net"]).collect()} == {1: 32619, 2: 32756, 3: 32631, 4: 32660}
    for code in (2154, 32600, 32661, None):
        with pytest.raises(Exception, match="no such frame"):
            lines.select(projection.to_frame(F.col("coords"), F.lit(code).cast("int"))).collect()


def test_merging_in_degrees(spark):
    """A street in two far networks: a redrawn copy 2 m off supersedes it, a crossing line cuts it where it meets it."""
    step = 1 / 111320
    for lon, lat, code in ((-71.05, 42.36, 32619), (18.42, -33.92, 32734)):
        e = step / math.cos(math.radians(lat))
        at = lambda x, y: (lon + x * e, lat + y * step)  # noqa: B023, E731
        model = df(spark, [(1, 1, [at(0, 0), at(200, 10), at(400, 0)]), (1, 2, [at(0, 300), at(400, 300)])])
        human = df(spark, [(1, 9, [at(0, 302), at(400, 302)]), (1, 10, [at(100, 150), at(110, 60), at(100, 6)])])
        rows = polylines.merge_geographic(model, human, model.limit(0), ["net"]).collect()
        got = sorted((r.line_id, r.piece, r.status) for r in rows)
        assert got == [(1, 1, "model"), (1, 2, "model"), (2, 1, "superseded"), (9, 1, "human"), (10, 1, "human")]
        assert {r.epsg for r in rows} == {code} and sum(r.n_snapped for r in rows) >= 1
        one = next(r for r in rows if (r.line_id, r.piece) == (1, 2))
        assert abs(one.coords[-1].x - at(400, 0)[0]) < 1e-8 and abs(one.coords[-1].y - at(400, 0)[1]) < 1e-8
