"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.plans.groups import by_groups, least_members
from netgrid.plans.storage import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # repeated edges are dropped by the small star that follows
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _within_keys(edges: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``(node, component, done)``: the components of each key's edges; a key of more than ``most`` edges gives one star a part, not done."""
    schema = edges.select(F.col("u").alias("node"), F.col("u").alias("component"), F.lit(True).alias("done")).schema

    def run(b: pa.RecordBatch, starts: np.ndarray, complete: np.ndarray) -> pa.RecordBatch:
        u, v = (b.column(len(keys) + i).to_numpy() for i in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, z = at[: len(u)], at[len(u) :]
        done = np.ones(len(nodes), bool)
        for e in (a, z):
            done[e] = np.repeat(complete, np.diff(np.r_[starts, len(u)]))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least_members(len(nodes), a, z)]), pa.array(done)], names=["node", "component", "done"])

    return by_groups(edges, keys, [], run, schema, most, whole=False)


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", keys: list[str] | None = None, most: int = 400_000) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = least member.

    With ``keys``, columns of the edges that no component spans, over nodes of
    type bigint, all keys of up to ``most`` edges are settled in one pass; parts
    of larger ones become stars, which go through the rounds.

    Large-star and small-star rounds (Kiveris et al., 2014) halve the depth of
    the trees, so the rounds grow with the logarithm of the longest path. Every
    round is written to the shared folder. Only the count of edges and a sum
    come back to the driver. Null ends and loops are ignored.
    """
    if keys:
        e = edges.select(*keys, F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
        e = materialise(_within_keys(e, keys, most), "cc")
        settled, rest = e.where("done").select("node", "component"), e.where("NOT done")
        return settled if rest.isEmpty() else settled.unionByName(connected_components(rest, "node", "component"))
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = materialise(e, "cc")
    seen = None
    while True:
        e = materialise(_small_star(_large_star(e)), "cc")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def merged_components(parts: DataFrame, edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """``parts`` (node, component) after more edges: only the components that these touch are gone through again."""
    of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias("_" + side))
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).join(of("u"), "u", "left").join(of("v"), "v", "left")
    ends = materialise(ends.select("u", "v", F.coalesce("_u", "u").alias("p"), F.coalesce("_v", "v").alias("q")), "cc")
    top = materialise(connected_components(ends, "p", "q"), "cc").select(F.col("node").alias("component"), F.col("component").alias("_top"))
    new = ends.select(F.col("u").alias("node"), F.col("p").alias("component")).unionByName(ends.select(F.col("v").alias("node"), F.col("q").alias("component")))
    all_parts = parts.unionByName(new.where("node = component")).distinct()
    return materialise(all_parts.join(top, "component", "left").select("node", F.coalesce("_top", "component").alias("component")), "cc")
