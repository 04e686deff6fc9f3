"""Merkle manifest of a dataset, with a proof for every row.

Where a leaf stands in its source's tree is told by bitmaps instead of a sort:
the ids of a source are kept as compressed bitmaps of 4,096 ids each, merged
from those of all tasks; running popcounts over bitmaps and within them answer
rank queries. Ranks then place digests into keyed arrays of 256 slots, each of
which makes two levels of the tree; as many rounds follow as the largest
source needs. Proofs go down the same way, a path for 256 leaves at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgrid.llm.memory import released, small_batches
from netgrid.plans.order import ranked, running
from netgrid.plans.storage import materialise

FAN = 16
LEVELS = 2  # of the tree in one keyed array
SLOTS = FAN**LEVELS
BITS = 12  # of an id within its bitmap
SPAN = 1 << BITS
ARRAY = SPAN // 16  # fewer ids than these are kept as an array of their low bits
MANY = 16 * SPAN  # rows of one bitmap that a task takes
MOST_SALTS = 64
FLUSH = 1 << 20  # ids that a task holds before it hands bitmaps on
EXTRA = np.dtype([("low", "<u2"), ("more", "<i8")])

CONTAINER = "source string, chunk long, bits binary, extra binary"
PLACED = "source string, rank long, n long, doc_id long, leaf binary, bad binary, tie_start long, row long"
BLOCKS = "source string, block long, n long, node binary, hashes binary, ids array<long>, bad array<binary>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: bytes) -> bytes:
    """Lower-case hex SHA-256 as bytes."""
    return hashlib.sha256(text).hexdigest().encode()


# ---------------------------------------------------------------- leaves


def field(c: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """``(source, doc_id, leaf, bad)``: ``bad`` is the digest of the tampered row, null where nothing is tampered with."""
    key, text = F.col("doc_id"), F.col("text").cast("string")
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sha = lambda t: F.unhex(F.sha2(F.concat(*head, field(t)), 256))
    tampered = F.crc32(key.cast("string").cast("binary")) % 5 == 0
    return docs.select(
        F.col("source").cast("string").alias("source"), key.cast("long").alias("doc_id"), sha(text).alias("leaf"),
        F.when(tampered, sha(F.translate(text, upper, upper.lower()))).alias("bad"),
    )


# ---------------------------------------------------------------- bitmaps


def pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """A bitmap and the further copies of ids in it, from the rows at each of its places."""
    low = np.flatnonzero(counts)
    bits = np.packbits(counts > 0, bitorder="little") if len(low) >= ARRAY else low.astype("<u2")
    again = low[counts[low] > 1]
    extra = np.zeros(len(again), EXTRA)
    extra["low"], extra["more"] = again, counts[again] - 1
    return bits.tobytes(), extra.tobytes()


def unpack(bits: bytes) -> np.ndarray:
    """The low bits of a bitmap's ids, ascending."""
    if len(bits) == SPAN // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    return np.frombuffer(bits, "<u2").astype(np.int64)


class Ranks:
    """Rank queries on one bitmap: a popcount for each word of 64 bits, summed up, and that of the word's lower bits."""

    def __init__(self, bits: bytes, extra: bytes):
        self.words = self.low = None
        if len(bits) == SPAN // 8:
            self.words = np.frombuffer(bits, "<u8")
            self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        else:
            self.low = np.frombuffer(bits, "<u2")
        e = np.frombuffer(extra, EXTRA)
        self.again = e["low"]
        self.more = np.concatenate([[0], np.cumsum(e["more"])])

    def __call__(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows below each id, and how many rows of repeated ids are among them (-1 for ids that stand once)."""
        if self.words is None:
            below = np.searchsorted(self.low, low.astype(np.uint16))
        else:
            at = low >> 6
            mask = (np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1)
            below = self.before[at] + np.bitwise_count(self.words[at] & mask)
        k = np.searchsorted(self.again, low.astype(np.uint16))
        tied = np.zeros(len(low), bool)
        tied[k < len(self.again)] = self.again[k[k < len(self.again)]] == low[k < len(self.again)]
        return below + self.more[k], np.where(tied, self.more[k] + k, -1)


def bitmaps(rows: DataFrame) -> DataFrame:
    """Bitmaps of the ids of each source, with ``n`` rows, ``ties`` (rows of repeated ids) and ``distinct`` ids; null ids have one of their own."""

    def partial(batches):
        held, size = defaultdict(list), 0

        def flush():
            out = [], [], [], []
            for (source, chunk), lows in held.items():
                bits, extra = pack(np.bincount(np.concatenate(lows), minlength=SPAN))
                for x, v in zip(out, (source, chunk, bits, extra), strict=True):
                    x.append(v)
            held.clear()
            for i in range(0, len(out[0]), 128):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 128], t) for x, t in zip(out, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["source", "chunk", "bits", "extra"])

        for b in batches:
            coded = b.column(0).dictionary_encode()
            names = [*coded.dictionary.to_pylist(), None]
            which = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            none = b.column(1).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for w in np.unique(which):
                mine = ids[(which == w) & ~none]
                chunk = mine >> BITS
                order = np.argsort(chunk, kind="stable")
                cuts = np.flatnonzero(np.diff(chunk[order])) + 1
                for part in np.split(order, cuts):
                    if len(part):
                        held[names[w], int(chunk[part[0]])].append(mine[part] & (SPAN - 1))
                if nulls := int(((which == w) & none).sum()):
                    held[names[w], None].append(np.zeros(nulls, np.int64))
            size += b.num_rows
            if size > FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    def merge(batches):
        key, counts, out = None, np.zeros(SPAN, np.int64), []

        def end():
            bits, extra = pack(counts)
            e = np.frombuffer(extra, EXTRA)["more"]
            out.append((*key, bits, extra, int(counts.sum()), int(e.sum()) + len(e)))
            counts[:] = 0

        def batch():
            types = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=["source", "chunk", "bits", "extra", "n", "ties"])

        for b in batches:
            for source, chunk, bits, extra in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key is not None and key != (source, chunk):
                    end()
                    if len(out) >= 128:
                        yield batch()
                key = source, chunk
                counts[unpack(bits)] += 1
                e = np.frombuffer(extra, EXTRA)
                counts[e["low"]] += e["more"]
        if key is not None:
            end()
            yield batch()

    parts = rows.select("source", "doc_id").mapInArrow(released(partial), CONTAINER)
    dealt = parts.repartition("source", "chunk").sortWithinPartitions("source", "chunk")
    return dealt.mapInArrow(released(merge), CONTAINER + ", n long, ties long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def placed(rows: DataFrame) -> DataFrame:
    """``rank`` of every leaf in its source, from 0 by ascending id (null first, equal ids by leaf), and ``n``, the source's leaves."""
    order = [F.col("source").asc_nulls_first(), F.col("chunk").asc_nulls_first()]
    maps = materialise(running(materialise(bitmaps(rows), "bitmaps"), order, {"before": "n", "ties_before": "ties"}), "bitmaps")
    ties, most = maps.agg(F.sum("ties"), F.max("n")).first()
    sources = maps.groupBy(F.col("source").alias("_source")).agg(F.min("before").alias("first"), F.sum("n").alias("total"))
    maps = maps.join(sources, _same("source", "_source")).withColumn("start", F.col("before") - F.col("first"))
    # without repeated ids no bitmap has more than 4,096 rows, so there is one part
    parts = min(MOST_SALTS, -(-(most or 0) // MANY)) or 1
    nothing = lambda *kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds]
    one = maps.select(
        "source", "chunk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "bits", "extra", "start", "total",
        "ties_before", *nothing(("doc_id", "long"), ("leaf", "binary"), ("bad", "binary"), ("row", "long")),
    )
    two = rows.select(
        "source", F.shiftright("doc_id", BITS).alias("chunk"), F.pmod("row", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"),
        *nothing(("bits", "binary"), ("extra", "binary"), ("start", "long"), ("total", "long"), ("ties_before", "long")), "doc_id", "leaf", "bad", "row",
    )
    key = ["source", "chunk", "part"]
    dealt = one.unionByName(two).repartition(*key).sortWithinPartitions(*key, "kind")

    def run(batches):
        ranks, start, total, ties_before = None, 0, 0, 0
        for b in batches:
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            heads = np.flatnonzero(col["kind"].to_numpy(zero_copy_only=False) == 0)
            low = col["doc_id"].fill_null(0).to_numpy(zero_copy_only=False) & (SPAN - 1)
            rank, n, tie = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, hi in zip([-1, *heads], [*heads, b.num_rows], strict=True):
                if lo >= 0:
                    bits, extra, start, total, ties_before = (col[c][int(lo)].as_py() for c in ("bits", "extra", "start", "total", "ties_before"))
                    ranks = Ranks(bits, extra)
                if hi > lo + 1:
                    below, among = ranks(low[lo + 1 : hi])
                    rank[lo + 1 : hi], n[lo + 1 : hi] = below + start, total
                    tie[lo + 1 : hi] = np.where(among >= 0, among + ties_before, -1)
            keep = pa.array(np.setdiff1d(np.arange(b.num_rows), heads))
            arrays = [col["source"], pa.array(rank), pa.array(n), col["doc_id"], col["leaf"], col["bad"], pa.array(tie, mask=tie < 0), col["row"]]
            yield pa.RecordBatch.from_arrays([a.take(keep) for a in arrays], names=[x.split()[0] for x in PLACED.split(", ")])

    out = dealt.mapInArrow(released(run), PLACED)
    if not ties:
        return out
    out = materialise(out, "placed")
    tied = ranked(out.where("tie_start is not null"), [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "row"], "_k")
    return out.where("tie_start is null").unionByName(tied.withColumn("rank", F.col("rank") + F.col("_k") - F.col("tie_start")).drop("_k"))


# ---------------------------------------------------------------- trees


def levels_of(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """The nodes of a block and the levels above them: up to one node where the block is a whole tree, else LEVELS of them."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= LEVELS:
        below = out[-1]
        out.append([digest(b"".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def split(hashes: bytes) -> list[bytes]:
    return [hashes[i : i + 32].hex().encode() for i in range(0, len(hashes), 32)]


def siblings(levels: list[list[bytes]], slot: int) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level that has one above: the siblings to the left and to the right of the node on the way up from ``slot``."""
    out = []
    for nodes in levels[:-1]:
        first = slot - slot % FAN
        out.append((nodes[first:slot], nodes[slot + 1 : first + FAN]))
        slot //= FAN
    return out


def write_path(steps: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """A byte each for the siblings left and right, then their digests."""
    return b"".join(bytes((len(a), len(b))) + bytes.fromhex(b"".join(a + b).decode()) for a, b in steps)


def read_path(path: bytes) -> list[tuple[bytes, bytes]]:
    """For each level: the hex digests to the left and to the right, joined."""
    out, at = [], 0
    while at < len(path):
        a, b = path[at], path[at + 1]
        mid, end = at + 2 + 32 * a, at + 2 + 32 * (a + b)
        out.append((path[at + 2 : mid].hex().encode(), path[mid:end].hex().encode()))
        at = end
    return out


def fold_up(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in steps:
        node = digest(left + node + right)
    return node


def blocks_of(nodes: DataFrame) -> DataFrame:
    """Keyed arrays of 256 slots, each with the node that they make; ``nodes`` has (source, rank, n, leaf, doc_id, bad)."""

    def run(t: pa.Table) -> pa.Table:
        rank, n = t.column("rank").to_numpy(), t.column("n")[0].as_py()
        slots = np.argsort(rank % SLOTS)  # at most 256
        hashes, ids, bad = ([v[i] for i in slots] for v in (t.column(c).to_pylist() for c in ("leaf", "doc_id", "bad")))
        node = levels_of([h.hex().encode() for h in hashes], n <= SLOTS)[-1][0]
        row = [t.column("source")[:1].to_pylist(), [int(rank[0]) // SLOTS], [n], [bytes.fromhex(node.decode())], [b"".join(hashes)], [ids], [bad]]
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        return pa.table([pa.array(v, k) for v, k in zip(row, types, strict=True)], names=["source", "block", "n", "node", "hashes", "ids", "bad"])

    keyed = nodes.select("source", F.floor(F.col("rank") / SLOTS).alias("block"), "rank", "n", "leaf", "doc_id", "bad")
    return keyed.groupBy("source", "block").applyInArrow(run, BLOCKS)


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of all trees, lowest first, and ``(source, hash)`` of their roots."""
    tables, roots = [], None
    while True:
        blocks = materialise(blocks_of(nodes), "merkle")
        tables.append(blocks)
        done = blocks.where(F.col("n") <= SLOTS).select("source", F.col("node").alias("hash"))
        roots = done if roots is None else roots.unionByName(done)
        most = blocks.agg(F.max("n")).first()[0]
        if most is None or most <= SLOTS:
            return tables, roots
        nodes = blocks.where(F.col("n") > SLOTS).select(
            "source", F.col("block").alias("rank"), F.ceil(F.col("n") / SLOTS).alias("n"), F.col("node").alias("leaf"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("bad")
        )


def _with_paths(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest blocks with the ``path`` from each to its tree's root and on along the path of ``tops`` (source, path, subroot)."""

    def run(batches):
        for b in batches:
            for source, block, n, hashes, path, subroot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                levels = levels_of(split(hashes), n <= SLOTS)
                made = [write_path(siblings(levels, i)) + path for i in range(len(levels[0]))]
                k = len(made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source] * k, pa.string()), pa.array(range(block * SLOTS, block * SLOTS + k), pa.int64()), pa.array(made, pa.binary()), pa.array([subroot] * k, pa.binary())],
                    names=["source", "rank", "path", "subroot"],
                )

    tops = tops.withColumnRenamed("source", "_source")
    paths = None
    for i, blocks in reversed(list(enumerate(tables))):
        found = blocks.where(F.col("n") <= SLOTS).join(tops, _same("source", "_source")).drop("_source")
        if paths is not None:
            upper = paths.withColumnRenamed("source", "_source")
            found = found.unionByName(blocks.where(F.col("n") > SLOTS).join(upper, _same("source", "_source") & (F.col("block") == F.col("rank"))).drop("_source", "rank"))
        if not i:
            return found
        paths = materialise(found.select("source", "block", "n", "hashes", "path", "subroot").mapInArrow(released(run), "source string, rank long, path binary, subroot binary"), "paths")


def _proofs(blocks: DataFrame, root: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for n, hashes, ids, bad, path, subroot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                leaves = split(hashes)
                levels = levels_of(leaves, n <= SLOTS)
                upper = read_path(path)
                tail = b"".join(left + right for left, right in upper)
                proofs, folded = [], []
                for slot, leaf in enumerate(leaves):
                    own = [(b"".join(x), b"".join(y)) for x, y in siblings(levels, slot)]
                    proofs.append(digest(b"".join(x + y for x, y in own) + tail).decode())
                    start = leaf if bad[slot] is None else bad[slot].hex().encode()
                    folded.append(fold_up(start, own + upper).decode())
                k = len(leaves)
                cols = [ids, [x.decode() for x in leaves], [subroot.hex()] * k, [root] * k, proofs, folded, [x == root for x in folded]]
                types = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return blocks.select("n", "hashes", "ids", "bad", "path", "subroot").mapInArrow(released(run), RESULT)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row of ``docs``.

    ``docs`` has doc_id (an integer), source, lang, n_chars and text; other
    columns are ignored. Nulls in any of these are leaves of their own kind
    (``-``); an empty text has length 0. A null id comes before all others and
    is not tampered with. Rows of equal id in a source stand in the order of
    their leaf digests, so repeated rows are leaves next to each other. An
    empty table has no rows and no root.

    A text is read once, for its digests; after that about 100 bytes a row are
    moved twice. No task holds more than 4,096 distinct ids or 256 leaves at
    a time, whatever the size of a source. Rows of one repeated id are spread
    over up to 64 tasks, and ranked among each other by a range sort.
    """
    small_batches(docs.sparkSession)
    rows = materialise(leaves_of(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    tables, subroots = grow(placed(rows))
    subroots = materialise(subroots, "subroots")
    order = materialise(ranked(subroots, [F.col("source").asc_nulls_first()]), "sources")
    count = order.count()
    tops = order.select(F.lit("").alias("source"), "rank", F.lit(count).cast("long").alias("n"), F.col("hash").alias("leaf"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("bad"))
    upper, roots = grow(tops)
    root = roots.first()
    root = root["hash"].hex() if root else ""
    # a path for every source, from the blocks of the tree over sources
    start = docs.sparkSession.createDataFrame([("", b"", b"")], "source string, path binary, subroot binary")
    slots = _slot_paths(_with_paths(upper, start))
    paths = order.join(slots, "rank").select("source", "path", F.col("hash").alias("subroot"))
    return _proofs(_with_paths(tables, paths), root)


def _slot_paths(blocks: DataFrame) -> DataFrame:
    """``(rank, path)`` of every slot of blocks with paths."""

    def run(batches):
        for b in batches:
            for block, n, hashes, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                levels = levels_of(split(hashes), n <= SLOTS)
                made = [write_path(siblings(levels, i)) + path for i in range(len(levels[0]))]
                yield pa.RecordBatch.from_arrays([pa.array(range(block * SLOTS, block * SLOTS + len(made)), pa.int64()), pa.array(made, pa.binary())], names=["rank", "path"])

    return blocks.select("block", "n", "hashes", "path").mapInArrow(released(run), "rank long, path binary")
