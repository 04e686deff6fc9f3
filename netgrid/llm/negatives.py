"""Hard negatives by segment summaries.

A vector is cut into segments, and of each its mean and its deviation (the
length of what is left after the mean) are kept. For two vectors the product
of a segment's means, times its size, plus or minus the product of its
deviations encloses the segment's part of their inner product. Pairs whose
bounds miss what is sought are dropped; the others are looked at again with
twice as many segments, and what outlasts them all is scored exactly.

Anchors and rows are dealt to blocks of bounded size, and every block of
anchors meets every block of rows once; blocks hand on their best few alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgrid.llm.memory import released, small_batches
from netgrid.plans.storage import materialise

SCALE = 256
#: Vectors from this length on take no part: 100 times a product of two others always fits 64 bits.
MOST_NORM = 3e8
BLOCK_BYTES = 32 << 20  # of vectors, at most, in a block
LEAST_BLOCK = 4096
TILE_ANCHORS, TILE_ROWS = 128, 4096
SEGMENTS = (1, 2, 4, 8, 16)
DENSE = 0.05  # from this share of pairs on, bounds and scores are made for the whole tile
PAIRS = 1 << 16  # pairs that are scored at a time

CLEAN = "vec_id long, label int, width int, vector binary"
NEAR = "anchor_id long, positive_id long, positive_score long"
FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, width, vector)``: components floor(256 x) as little-endian integers of ``width`` bytes; unusable rows are left out."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    sized = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < MOST_NORM))
    rows = vectors.where(usable & sized).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dim = 1 << (dim - 1).bit_length() if dim else 0  # missing components are zeros

    def run(batches):
        for b in batches:
            lists = b.column(2)
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            q = np.zeros((len(size), dim))
            q[at] = np.floor(SCALE * np.asarray(lists.flatten(), dtype=np.float64))
            fits = (q * q).sum(axis=1) < MOST_NORM**2
            q = q[fits].astype(np.int64)
            top = int(np.abs(q).max(initial=0))
            width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
            data = np.ascontiguousarray(q.astype(f"<i{width}"))
            flat = [data[i].tobytes() for i in range(len(data))]
            keep = pa.array(np.flatnonzero(fits))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(np.full(len(flat), width, np.int32)), pa.array(flat, pa.binary())], names=["vec_id", "label", "width", "vector"])

    return rows.mapInArrow(released(run), CLEAN)


class Vectors:
    """A block of vectors with the summaries of their segments, made level by level when they are first asked for."""

    def __init__(self, t: pa.Table, columns: list[str]):
        self.columns = {c: t.column(c).to_numpy() for c in columns}
        width, data = t.column("width").to_numpy(), t.column("vector").to_pylist()
        kind = int(width.max(initial=2))
        dim = len(data[0]) // int(width[0]) if data else 0
        self.q = np.zeros((len(data), dim), dtype=f"i{kind}")
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            self.q[at] = np.frombuffer(b"".join(data[i] for i in at), dtype=f"<i{w}").reshape(len(at), dim)
        self._summary: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0)

    def __len__(self) -> int:
        return len(self.q)

    def summary(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Means, times the root of the segment's size, and deviations; a column for each segment."""
        if segments not in self._summary:
            n, dim = self.q.shape
            mean, dev = np.empty((n, segments)), np.empty((n, segments))
            for lo in range(0, n, TILE_ROWS):
                x = self.q[lo : lo + TILE_ROWS].astype(np.float64).reshape(-1, segments, dim // segments)
                m = x.mean(axis=2)
                mean[lo : lo + TILE_ROWS] = m * np.sqrt(dim / segments)
                dev[lo : lo + TILE_ROWS] = np.sqrt(((x - m[:, :, None]) ** 2).sum(axis=2))
            self._summary[segments] = mean, dev
        return self._summary[segments]


class Tile:
    """Some anchors against some rows of a block: a mask of pairs, narrowed by bounds, then scored."""

    def __init__(self, anchors: Vectors, rows: Vectors, a: slice, r: slice, mask: np.ndarray):
        self.anchors, self.rows, self.a, self.r, self.mask = anchors, rows, a, r, mask
        self.slack = 1e-9 * (1 + anchors.norm * rows.norm)  # of the bounds' floating point

    def _dense(self) -> bool:
        return np.count_nonzero(self.mask) > DENSE * self.mask.size

    def narrow(self, lowest: np.ndarray, highest: np.ndarray) -> None:
        """Drop pairs whose score is surely below ``lowest`` or above ``highest`` of the anchor."""
        lowest, highest = lowest - self.slack, highest + self.slack
        for s in SEGMENTS:
            if s > self.rows.q.shape[1] or not self.mask.any():
                return
            (am, ad), (rm, rd) = self.anchors.summary(s), self.rows.summary(s)
            am, ad, rm, rd = am[self.a], ad[self.a], rm[self.r], rd[self.r]
            if self._dense():
                mid, reach = am @ rm.T, ad @ rd.T
                self.mask &= (mid + reach >= lowest[:, None]) & (mid - reach <= highest[:, None])
                continue
            i, j = np.nonzero(self.mask)
            for lo in range(0, len(i), PAIRS):
                x, y = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
                mid, reach = np.einsum("ij,ij->i", am[x], rm[y]), np.einsum("ij,ij->i", ad[x], rd[y])
                out = (mid + reach < lowest[x]) | (mid - reach > highest[x])
                self.mask[x[out], y[out]] = False

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row (numbers within the block) and exact score of every pair left."""
        i, j = np.nonzero(self.mask)
        x, y = self.anchors.q[self.a], self.rows.q[self.r]
        if self._dense() and self.anchors.norm * self.rows.norm < 2.0**53:
            s = np.rint((x.astype(np.float64) @ y.astype(np.float64).T)[i, j]).astype(np.int64)
        else:
            s = np.empty(len(i), np.int64)
            for lo in range(0, len(i), PAIRS):
                k = slice(lo, lo + PAIRS)
                s[k] = np.einsum("ij,ij->i", x[i[k]].astype(np.int64), y[j[k]].astype(np.int64))
        return i + self.a.start, j + self.r.start, s


class Best:
    """The best ``k`` (score down, id up) of each of n lists; ``least`` is the score that a newcomer must reach."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.lists = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, lists: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(lists):
            return
        lists, ids, scores = (np.concatenate(x) for x in ((self.lists, lists), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, lists))
        lists, ids, scores = lists[order], ids[order], scores[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        keep = place < self.k
        self.lists, self.ids, self.scores = lists[keep], ids[keep], scores[keep]
        last = place[keep] == self.k - 1
        self.least[self.lists[last]] = self.scores[last]


def tiles(anchors: Vectors, rows: Vectors):
    for lo in range(0, len(anchors), TILE_ANCHORS):
        for at in range(0, len(rows), TILE_ROWS):
            yield slice(lo, min(lo + TILE_ANCHORS, len(anchors))), slice(at, min(at + TILE_ROWS, len(rows)))


def nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each anchor of a block the best k other rows of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best, anchors = Best(right.num_rows, k), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            rows, block = Vectors(left, ["vec_id"]), Vectors(right, ["vec_id"])
            anchors, ids = block.columns["vec_id"], rows.columns["vec_id"]
            for a, r in tiles(block, rows):
                tile = Tile(block, rows, a, r, anchors[a, None] != ids[None, r])
                tile.narrow(best.least[a], np.full(a.stop - a.start, np.inf))
                i, j, s = tile.scores()
                good = s >= best.least[i]
                best.add(i[good], ids[j[good]], s[good])
        return pa.table([pa.array(anchors[best.lists] if len(best.lists) else best.lists), pa.array(best.ids), pa.array(best.scores)], names=[x.split()[0] for x in NEAR.split(", ")])

    return run


def between(k: int, low: int, high: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each anchor and each of its positives the best k rows of other labels in the window below the positive."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 5
        if left.num_rows and right.num_rows:
            rows, block = Vectors(left, ["vec_id", "label"]), Vectors(right, ["vec_id", "label"])
            n = len(block)
            score, name = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64)
            real = np.zeros((n, most), bool)
            for i, (s, p) in enumerate(zip(right.column("scores").to_pylist(), right.column("positives").to_pylist(), strict=True)):
                score[i, : len(s)], name[i, : len(p)], real[i, : len(s)] = s, p, True
            ids, labels = rows.columns["vec_id"], rows.columns["label"]
            best = Best(n * most, k)
            floor = np.where(real, low * score / 100, np.inf)
            ceiling = np.where(real, high * score / 100, -np.inf)
            for a, r in tiles(block, rows):
                tile = Tile(block, rows, a, r, block.columns["label"][a, None] != labels[None, r])
                needed = np.maximum(floor[a], best.least.reshape(n, most)[a]).min(axis=1)
                tile.narrow(needed, ceiling[a].max(axis=1))
                i, j, s = tile.scores()
                for p in range(most):
                    good = real[i, p] & (low * score[i, p] <= 100 * s) & (100 * s <= high * score[i, p])
                    best.add(i[good] * most + p, ids[j[good]], s[good])
            i, p = best.lists // most, best.lists % most
            out = [block.columns["vec_id"][i], name[i, p], score[i, p], best.ids, best.scores]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` has vec_id, embedding and label; ``anchor`` tells which rows
    are anchors (default: ids divisible by 100). Components are floor(256 x),
    scores integer inner products, ties go to the smaller id. An anchor's
    positives are its best other rows of the same label; for each of them the
    best rows of other labels with ``low`` * positive score <= 100 * score <=
    ``high`` * positive score are returned, ranked from 1. An anchor without
    such rows has none.

    Rows with a null id, label, vector or component, or a non-finite
    component, take no part, nor do vectors longer than 3e8 once scaled, whose
    scores could leave 64 bits. Of rows that share an id the one with the
    least label, then vector, counts. Shorter vectors end in zeros; empty
    vectors score 0. Extra columns are ignored; an empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    clean = quantised(vectors)
    one = clean.groupBy("vec_id").agg(F.min(F.struct("label", "width", "vector")).alias("row")).select("vec_id", "row.*")
    rows = materialise(one, "vectors")
    is_anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    total, found, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.length("vector"))).first()
    most = max(1, BLOCK_BYTES // max(1, width or 1))
    # blocks of bounded size, and as many as keep the session's cores busy where there are few rows
    parts = max(-(-total // most), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_BLOCK)), 1)
    chunks = max(-(-found // most), 1)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    deal = lambda n, seed, name: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int").alias(name)
    anchors = rows.where(is_anchor).select("*", deal(chunks, 2, "chunk"))
    dealt = rows.select("*", deal(parts, 1, "part"))

    left = dealt.select("*", every(chunks, "chunk"))
    near = left.groupBy("label", "part", "chunk").cogroup(anchors.select("*", every(parts, "part")).groupBy("label", "part", "chunk")).applyInArrow(nearest(positives), NEAR)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))  # a few an anchor
    sought = materialise(anchors.join(lists, "vec_id").select("vec_id", "label", "width", "vector", "chunk", F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("scores")), "positives")

    right = sought.select("*", every(parts, "part")).groupBy("part", "chunk")
    parts_found = left.groupBy("part", "chunk").cogroup(right).applyInArrow(between(negatives, low, high, positives), FOUND)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranks = parts_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranks.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
