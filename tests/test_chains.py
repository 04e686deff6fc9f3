"""Chains of cells across blocks: equal to one plain walk, rings over many blocks, no long rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netgrid.operators import vectorise


def near_of(on, p):
    return sorted((p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (p[0] + a, p[1] + b) in on)


def plain_lines(on):
    """Lines by one walk over the whole set of cells."""
    near = {p: near_of(on, p) for p in on}
    nodes, out, seen = {p for p in on if len(near[p]) != 2}, [], set()

    def walk(a, b):
        path = [a, b]
        while path[-1] not in nodes and path[-1] != path[0]:
            x, y = near[path[-1]]
            path.append(y if x == path[-2] else x)
        return path

    for a in sorted(nodes):
        for b in near[a]:
            if b in nodes:
                out += [[a, b]] * (a < b)
                continue
            path = walk(a, b)
            seen.update(path)
            out += [path] * ((path[0], path[1]) < (path[-1], path[-2]))
    for p in sorted(on - nodes - seen):
        if p not in seen:
            path = walk(p, near[p][0])
            seen.update(path)
            out.append(path)
    return sorted(out)


def box(r0, c0, r1, c1):
    """A ring without corners, so that every cell has two neighbours."""
    edge = {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if r in (r0, r1) or c in (c0, c1)}
    return edge - {(r0, c0), (r0, c1), (r1, c0), (r1, c1)}


def skeletons():
    rng = random.Random(3)
    out = {1: box(-3, 2, 17, 29), 2: box(1, 1, 4, 4) | box(10, 10, 13, 30), 3: {(5, 5)} | {(9, c) for c in range(40)}, 4: {(0, 0), (0, 1), (1, 0)}}
    for k in range(5, 9):
        on, p = set(), (0, 0)
        for _ in range(150):  # lanes that turn, cross and end
            if rng.random() < 0.05:
                p = (rng.randrange(40), rng.randrange(40))
            p = (p[0] + rng.choice([-1, 0, 0, 1]), p[1] + rng.choice([-1, 0, 1, 1])) if rng.random() < 0.3 else (p[0], p[1] + 1)
            on.add((p[0] % 40, p[1] % 40))
        out[k] = on
    out[9] = {(r, c) for r in range(30) for c in range(30) if rng.random() < 0.25}
    out[10] = box(2, 2, 30, 30) | {(r, 16) for r in range(-4, 2)}  # a loop tied to one node
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_lines_equal_a_plain_walk(spark, block):
    m = skeletons()
    df = spark.createDataFrame([(k, *p) for k, on in m.items() for p in on], "net long, r long, c long")
    got = {}
    for x in vectorise.trace(df, ["net"], 1.0, block).collect():
        got.setdefault(x.net, []).append([(int(np.floor(p.y)), int(np.floor(p.x))) for p in x.coords])
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_lines(on) for k, on in m.items()}


def test_vertices_of_a_ring_over_many_blocks(spark):
    side = 2001
    at = spark.range(1, side).select(F.explode(F.array(*[F.struct(r.alias("r"), c.alias("c")) for r, c in ((F.lit(0), F.col("id")), (F.lit(side), F.col("id")), (F.col("id"), F.lit(0)), (F.col("id"), F.lit(side)))])).alias("p"))
    df = at.select(F.lit("a").alias("net"), F.col("p.r").cast("long").alias("r"), F.col("p.c").cast("long").alias("c"))
    assert df.count() == 4 * (side - 1)
    pieces = vectorise.trace_pieces(df, ["net"], 64)
    assert pieces.agg(F.max(F.size("cells"))).first()[0] <= 2 * 64
    v = vectorise.trace_vertices(df, ["net"], 64).orderBy("k").collect()
    assert [x.k for x in v] == list(range(4 * (side - 1) + 1)) and len({x.line_id for x in v}) == 1
    assert (v[0].r, v[0].c) == (v[-1].r, v[-1].c) == (0, 1) and (v[1].r, v[1].c) == (0, 2)
    assert all(max(abs(a.r - b.r), abs(a.c - b.c)) == 1 for a, b in zip(v, v[1:]))


def test_no_cells(spark):
    none = spark.createDataFrame([], StructType.fromDDL("net long, r long, c long"))
    assert vectorise.trace(none, ["net"]).count() == 0 == vectorise.trace_vertices(none, ["net"]).count()
