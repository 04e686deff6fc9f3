"""Duplicates, leakage-safe splits and samples of a dataset."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgrid.plans.components import connected_components
from netgrid.plans.order import ranked
from netgrid.plans.storage import materialise


def exact_duplicates(files: DataFrame) -> DataFrame:
    """``(sha, ids)`` of contents that more than one file has."""
    return files.groupBy("sha").agg(F.sort_array(F.collect_set("idx")).alias("ids")).where(F.size("ids") > 1)


# fixed values: index ranges of the official parts
PARTS = ((0, 2374, "train"), (2375, 2713, "val"), (2714, 3337, "in_domain_test"))


def range_lookup(value: Column, ranges: tuple[tuple[int, int, str], ...]) -> Column:
    """The name of the range (ends included) that holds the value; null outside all."""
    out = F.lit(None).cast("string")
    for lo, hi, name in ranges:
        out = F.when(value.between(lo, hi), name).otherwise(out)
    return out


def official_split(index: Column) -> Column:
    return range_lookup(index, PARTS)


def shard_path(index: Column) -> Column:
    """Shards of a hundred, ids of four digits."""
    return F.format_string("shard_%02d/gs_%04d", F.floor(index / 100), index)


def graph_edges(graph: DataFrame, region: str = "region_id") -> DataFrame:
    """Unique undirected edges of a directed adjacency ``(region, nr, nc, mr, mc)``; loops are left out."""
    a, b = F.struct(F.col("nr").alias("r"), F.col("nc").alias("c")), F.struct(F.col("mr").alias("r"), F.col("mc").alias("c"))
    return graph.select(region, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct().select(region, "a.r", "a.c", F.col("b.r").alias("r2"), F.col("b.c").alias("c2"))


def junction_fingerprints(graph: DataFrame, region: str = "region_id") -> DataFrame:
    """Nodes of three or more neighbours and their sorted offsets (rounded half to even); keys repeated in a region are left out."""
    off = F.struct(F.rint(F.col("mr") - F.col("nr")).cast("int").alias("dr"), F.rint(F.col("mc") - F.col("nc")).cast("int").alias("dc"))
    nodes = graph.groupBy(region, "nr", "nc").agg(F.array_sort(F.collect_set(off)).alias("offs")).where(F.size("offs") >= 3)
    text = F.array_join(F.transform("offs", lambda x: F.concat_ws(",", x["dr"], x["dc"])), ";")
    keyed = nodes.select(region, "nr", "nc", text.alias("key"))
    once = keyed.groupBy(region, "key").agg(F.count("*").alias("n")).where("n = 1").select(region, "key")
    return keyed.join(once, [region, "key"], "left_semi").select(region, "nr", "nc", "key")


def link_regions(prints: DataFrame, region: str = "region_id", min_votes: int = 2, max_key_regions: int = 50) -> DataFrame:
    """Pairs of regions whose shared keys agree on an offset: the offset of most votes (least on ties)."""
    few = prints.groupBy("key").agg(F.count_distinct(region).alias("n")).where(F.col("n") <= max_key_regions).select("key")
    p = prints.join(few, "key", "left_semi")
    a = p.select("key", F.col(region).alias("a"), F.col("nr").alias("ar"), F.col("nc").alias("ac"))
    b = p.select("key", F.col(region).alias("b"), F.col("nr").alias("br"), F.col("nc").alias("bc"))
    votes = a.join(b, "key").where("a < b").groupBy("a", "b", F.rint(F.col("br") - F.col("ar")).cast("long").alias("dr"), F.rint(F.col("bc") - F.col("ac")).cast("long").alias("dc")).agg(F.count("*").alias("votes"))
    best = votes.where(F.col("votes") >= min_votes).groupBy("a", "b").agg(F.min_by(F.struct("dr", "dc", "votes"), F.struct(-F.col("votes"), "dr", "dc")).alias("x"))
    return best.select("a", "b", "x.*")


def site_groups(items: DataFrame, links: DataFrame, id_col: str = "idx") -> DataFrame:
    """``site`` of every item: the least id that links lead to."""
    cc = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return items.join(cc.withColumnRenamed("node", id_col), id_col, "left").withColumn("site", F.coalesce("component", id_col)).drop("component")


def duplicate_links(files: DataFrame) -> DataFrame:
    """Each file with the first of equal content."""
    first = files.groupBy("sha").agg(F.min("idx").alias("a"))
    return files.join(first, "sha").where("idx <> a").select("a", F.col("idx").alias("b"))


def spread_pick(items: DataFrame, n: int, cap: int, order: str = "idx", site: str = "site") -> DataFrame:
    """About n items evenly spread over the order, at most ``cap`` a site."""
    some = items.withColumn("k", F.row_number().over(Window.partitionBy(site).orderBy(order))).where(F.col("k") <= cap).drop("k")
    total = some.count()
    if total <= n:
        return some
    return ranked(some, [order], "pos").where(F.floor((F.col("pos") + 1) * n / total) > F.floor(F.col("pos") * n / total)).drop("pos")


def leakage_report(files: DataFrame, held: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Train items whose content is also held out, with the parts that hold it."""
    h = files.where(F.col("split").isin(*held)).groupBy("sha").agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("also_in"))
    return files.where("split = 'train'").join(h, "sha").select("idx", "sha", "also_in")


def sites_across_splits(items: DataFrame, site: str = "site") -> DataFrame:
    return items.groupBy(site).agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


def stride_sample(tiles: DataFrame, n: int, low: float = 0.02, high: float = 0.18, density: str = "road_fraction", key: str = "tile_id") -> DataFrame:
    """n tiles at even steps of density within bounds; all of them when there are fewer."""
    ok = tiles.where(F.col(density).between(low, high))
    total = ok.count()
    if not total:
        raise ValueError("no tile has a density within the bounds")
    pos = ranked(ok, [density, key], "pos").withColumn("pos", F.col("pos").cast("int"))
    if total < n:
        return pos
    targets = tiles.sparkSession.range(n).select(F.least(F.floor(F.col("id") * total / n), F.lit(total - 1)).cast("int").alias("pos"))
    return pos.join(targets, "pos")


def split_exact(items: DataFrame, share: float, key: str, seed: str = "0") -> DataFrame:
    """``held``: exactly max(1, floor(n * share)) rows by a hash order of the key."""
    k = max(1, int(items.count() * share))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return ranked(items.withColumn("_h", order), ["_h", key], "_pos").withColumn("held", F.col("_pos") < k).drop("_h", "_pos")


def mix_weights(items: DataFrame, domain: str, shares: dict[str, float]) -> DataFrame:
    """Weights that give every domain its share: share over its number of items."""
    n = items.groupBy(domain).agg(F.count("*").alias("n"))
    s = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col(domain))
    return items.join(F.broadcast(n.where(F.col(domain).isin(*shares))), domain).withColumn("weight", s / F.col("n")).drop("n")


def region_manifest(selection: DataFrame, stats: DataFrame, old: DataFrame) -> DataFrame:
    """Selected regions with their statistics; the old ones are kept where id and set are unchanged."""
    prev = old.select("id", "set", F.col("road_fraction").alias("old"))
    return selection.join(stats, "id", "left").join(prev, ["id", "set"], "left").withColumn("road_fraction", F.coalesce("old", "road_fraction")).drop("old")


def select_regions(
    items: DataFrame, n_ft: int = 220, n_val: int = 30, n_test: int = 60, blocks: int = 6, margin: int = 15, cap: int = 4, greedy: bool = False
) -> DataFrame:
    """``(idx, part)``: regions for testing, validation and training without leakage. ``items``: idx, split, sha, site.

    1. ``id_test``: test items, one a site, spread over the index.
    2. The pool: train items whose content is not held out, the first of equal ones, of sites without a chosen test item.
    3. ``ft_val``: runs of picks of the pool; their sites, and indices within ``margin`` of a run, are withheld from
    4. ``ft_train``: the rest, at most ``cap`` a site.

    Picks are spread by even strides, or (``greedy``) each target takes the nearest item left.
    """
    pick = greedy_spread if greedy else spread_pick
    test = materialise(pick(items.where("split = 'test'").select("idx", "site"), n_test, 1), "test")
    same = items.groupBy("sha").agg(F.min(F.when(F.col("split") == "train", F.col("idx"))).alias("first"), F.max((F.col("split") != "train").cast("int")).alias("held"))
    pool = items.where("split = 'train'").join(same, "sha").where("held = 0 and idx = first").join(test.select("site").distinct(), "site", "left_anti")
    pool = materialise(pool.select("idx", "site"), "pool")
    # at most ``n_ft`` picks, so their order is a small matter
    prov = pick(pool, n_ft, cap).withColumn("pos", F.row_number().over(Window.orderBy("idx")) - 1)
    prov = materialise(prov, "picks")
    each, n = max(1, n_val // blocks), prov.count()
    starts = [round((n - each) * i / (blocks + 1)) for i in range(1, blocks + 1)]
    at = prov.sparkSession.createDataFrame([(s,) for s in starts], "start long")
    runs = materialise(prov.join(F.broadcast(at), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + each)), "runs")
    val = runs.select("idx", "site").distinct()
    windows = runs.groupBy("start").agg((F.min("idx") - margin).alias("lo"), (F.max("idx") + margin).alias("hi"))
    train = pool.join(val.select("site").distinct(), "site", "left_anti").join(F.broadcast(windows), F.col("idx").between(F.col("lo"), F.col("hi")), "left_anti")
    train = pick(train.select("idx", "site"), n_ft - val.count(), cap)
    of = lambda df, part: df.select("idx", F.lit(part).alias("part"))
    return of(test, "id_test").unionByName(of(val, "ft_val")).unionByName(of(train, "ft_train"))


def sample_windows(
    cells: DataFrame, keys: list[str], draws: int, crop: int, height: int, width: int, road_bias: float = 0.85, max_blank: float = 0.30, tries: int = 12, truth: str = "truth"
) -> DataFrame:
    """``(keys, draw, r0, c0, has_road)``: a random window for each draw of each raster, cells without a row being blank.

    Numbers come from hashes of raster, draw and try. Of the tries the first
    window that is not too blank and has road, where the draw wants road, is
    taken; if none is, the last one.
    """
    number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], *parts)), 1, 8), 16, 10).cast("long")
    each = cells.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    each = each.withColumns({
        "r0": (number("draw", "try", F.lit("r")) % (height - crop)).cast("int"), "c0": (number("draw", "try", F.lit("c")) % (width - crop)).cast("int"),
        "want": number("draw", F.lit("road")) % 1000 < int(1000 * road_bias),
    })
    # a window covers at most two by two blocks of its size
    block = lambda x: F.explode(F.sequence(F.floor(F.col(x) / crop), F.floor((F.col(x) + crop - 1) / crop)))
    spread = each.select("*", block("r0").alias("_br")).select("*", block("c0").alias("_bc"))
    own = cells.select(*keys, "r", "c", truth).withColumns({"_br": F.floor(F.col("r") / crop), "_bc": F.floor(F.col("c") / crop)})
    inside = F.col("r").between(F.col("r0"), F.col("r0") + crop - 1) & F.col("c").between(F.col("c0"), F.col("c0") + crop - 1)
    got = spread.join(own, [*keys, "_br", "_bc"]).where(inside).groupBy(*keys, "draw", "try").agg(F.count("*").alias("full"), F.count(F.when(F.col(truth) == 1, 1)).alias("road"))
    all_ = each.join(got, [*keys, "draw", "try"], "left").na.fill(0, ["full", "road"])
    ok = (1 - F.col("full") / (crop * crop) <= max_blank) & (~F.col("want") | (F.col("road") > 0))
    order = F.struct((~ok).cast("int"), F.when(ok, F.col("try")).otherwise(-F.col("try")))
    best = all_.groupBy(*keys, "draw").agg(F.min_by(F.struct("r0", "c0", (F.col("road") > 0).alias("has_road")), order).alias("w"))
    return best.select(*keys, "draw", "w.*")


class Free:
    """Places 0 to n - 1 with the nearest free one at or after, and at or before, each: two forests of pointers that are shortened when used."""

    def __init__(self, n: int):
        self.n = n
        self.after, self.before = list(range(n + 1)), list(range(n + 1))  # n: none after; of places from 1: 0: none before

    @staticmethod
    def _root(of: list[int], i: int) -> int:
        root = i
        while of[root] != root:
            root = of[root]
        while of[i] != root:
            of[i], i = root, of[i]
        return root

    def at_or_after(self, i: int) -> int | None:
        found = self._root(self.after, i)
        return found if found < self.n else None

    def at_or_before(self, i: int) -> int | None:
        found = self._root(self.before, i + 1)
        return found - 1 if found else None

    def take(self, i: int) -> None:
        self.after[i] = i + 1
        self.before[i + 1] = i


def picked_places(places: list[int], sites: list[int], total: int, n: int, cap: int) -> list[int]:
    """Numbers of the items picked by n even targets among ``total`` places, in turn.

    Each target takes the nearest free place, the one above on ties, whose site
    has fewer than ``cap`` picks. When a site is full its other places are
    taken off, so every place is looked at once.
    """
    free, count, members, picks = Free(len(places)), {}, {}, []
    if not places or n <= 0 or cap < 1:
        return picks
    for i, s in enumerate(sites):
        members.setdefault(s, []).append(i)
    for target in np.linspace(0, total - 1, n):
        t = round(float(target))
        up, down = free.at_or_after(bisect_left(places, t)), free.at_or_before(bisect_right(places, t) - 1)
        if up is None and down is None:
            break
        hit = down if up is None or (down is not None and t - places[down] < places[up] - t) else up
        picks.append(hit)
        free.take(hit)
        s = sites[hit]
        count[s] = count.get(s, 0) + 1
        if count[s] == cap:
            for i in members[s]:
                if free.at_or_after(i) == i:
                    free.take(i)
    return sorted(picks)


def greedy_pick(items: DataFrame, sets: DataFrame, key: str, order: str = "idx", site: str = "site") -> DataFrame:
    """``(key, order, site)``: for each selection ``(key, n, cap)`` of ``sets``, n of its items spread evenly over the order, at most ``cap`` a site.

    Targets stand at even steps; each takes the nearest unused item, the upper
    one on ties, whose site is not full. Every pick depends on those before it,
    so a selection is settled by one task, over items that are cut down
    without loss: of a stretch between two targets a site needs its ``cap``
    first and last items, as at most ``cap`` - 1 of them can be used while it is not
    full, and of these the 2 n + 1 first and last are enough, as at most n are
    used and at most n belong to full sites. That is 4 n + 2 items a target,
    whatever the number of items. Null sites are one site; equal orders are told apart by the site.
    """
    n, cap = sets.agg(F.max("n"), F.max("cap")).first()
    if n is None:
        return items.select(key, order, site).limit(0)
    pos = ranked(items.select(key, order, site), [key, order, site], "_pos")
    whole = pos.groupBy(key).agg(F.min("_pos").alias("_first"), F.count("*").alias("_total"))
    at = pos.join(whole, key).join(sets.select(key, "n", "cap"), key).withColumn("_pos", F.col("_pos") - F.col("_first")).drop("_first")
    step = F.when(F.col("n") > 1, (F.col("_total") - 1) / (F.col("n") - 1.0)).otherwise(F.col("_total").cast("double"))
    at = at.withColumn("_stretch", F.floor(F.col("_pos") / F.greatest(step, F.lit(1e-9))))

    def ends(df: DataFrame, by: list[str], most: int) -> DataFrame:
        """The first and the last rows of each group; two more than needed, as targets are rounded to places."""
        some = [df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(o))).where(F.col("_k") <= most + 2).drop("_k") for o in (F.asc("_pos"), F.desc("_pos"))]
        return some[0].unionByName(some[1]).dropDuplicates([key, "_pos"])

    at = ends(ends(materialise(at, "places"), [key, site, "_stretch"], int(cap)), [key, "_stretch"], 2 * int(n) + 1)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_pos")
        codes = t.column(site).combine_chunks().dictionary_encode().indices.fill_null(-1).to_pylist()
        picks = picked_places(t.column("_pos").to_pylist(), codes, *(t.column(c)[0].as_py() for c in ("_total", "n", "cap")))
        return t.take(pa.array(picks, pa.int64())).select([key, order, site])

    return at.groupBy(key).applyInArrow(run, items.select(key, order, site).schema)


def greedy_spread(items: DataFrame, n: int, cap: int, order: str = "idx", site: str = "site") -> DataFrame:
    """``greedy_pick`` for one selection."""
    one = items.select(order, site).withColumn("_set", F.lit(0))
    sets = items.sparkSession.createDataFrame([(0, n, cap)], "_set int, n int, cap int")
    return greedy_pick(one, sets, "_set", order, site).drop("_set")
