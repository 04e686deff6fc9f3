"""N-gram Jaccard join: which documents share at least a given part of their word shingles.

1. Every text becomes the set of its distinct k-word shingles (64-bit hashes).
   Equal sets collapse into a class, named by its least id.
2. A class is dealt to groups by some of its hashes, taken in one order for all
   sets: rare hashes before common ones, lowest first. Two sets that link have
   their first shared hash, in that order, among the hashes of both (see
   ``Prefix``), so a linked pair meets in a group. Groups with the same members
   are walked once.
3. In each group a signature tree finds the pairs that may link
   (``signature_tree``); a large group is cut into blocks, each member in one
   of them, and pairs of whole blocks are walked apart.
4. Pairs are verified against the whole sets. A group of many members or with
   many more candidate pairs than members first offers a chain or a spanning
   forest of them. When those are verified, only pairs across different
   components remain to be tried: the next round offers a forest of these, and
   the last one all that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgrid.llm import signature_tree as tree
from netgrid.llm.hashing import chunks, shingles, word_hashes
from netgrid.llm.memory import released, small_batches
from netgrid.plans.components import connected_components, merged_components
from netgrid.plans.order import ranked
from netgrid.plans.storage import materialise

#: A group of more members than this is cut into blocks of so many, or of so many times TOKENS shingles.
BLOCK = 2048
TOKENS = 2048
#: Tasks that share the pairs of blocks of a group, and the most blocks of one that a task holds; past SPREAD * HELD blocks more tasks share them.
SPREAD, HELD = 8, 64
#: A group of more members first offers only the chain of its bitmaps.
SMALL = 64
#: The zone of cells that offer their chain.
CHAIN = -1
#: A hash among the lowest of more texts than this counts as common.
COMMON = 64
#: At most so many common hashes are named; the least frequency rises to keep to it.
MOST_COMMON = 1_000_000
#: Bits of the filter of ids whose whole sets are wanted, the same for every number of ids.
FILTER = 1 << 24
SURE = 2.0**-56
#: Bits a token of the bitmaps of the later rounds, which few sets reach.
WIDE = 8


def prefix_size(num: int, den: int) -> int:
    """K with (1 - num/den) ** K < 2**-56: how many of the lowest hashes of a union may all miss the overlap."""
    return max(1, math.ceil(56 / math.log2(den / max(den - num, 1)))) if num < den else 1


def least_rare(num: int, den: int, most: int = 512) -> np.ndarray:
    """For s = 1, 2, ...: the least k with P(Binomial(s, 1 - num/den) >= k) < 2**-56; past any count where there is none.

    Of the s lowest hashes of a union each is unshared with that chance at most.
    """
    q = 1 - num / den
    out, p = np.empty(most, dtype=np.int64), np.ones(1)
    for s in range(1, most + 1):
        p = np.append(p * (1 - q), 0) + np.append(0, p * q)
        tail = np.cumsum(p[::-1])[::-1]
        ok = np.flatnonzero(tail < SURE)
        out[s - 1] = ok[0] if len(ok) else most + 1
    return out


@dataclass
class Prefix:
    """Chooses the hashes of a set by which it is dealt to groups.

    With n hashes, of which a link shares ceil(t n) at least, the first n - ceil(t n) + 1
    in any common order hold a shared one. Rare hashes come first in the order.
    A scan by lowest hash ends earlier where the rare ones passed are so many
    that all of them are unshared with a chance below 2**-56, whichever hashes
    are common. Where a set has too few rare hashes, all of them and the lowest
    common ones are taken.
    """

    common: np.ndarray  # sorted
    num: int
    den: int

    def __post_init__(self):
        self.low = prefix_size(self.num, self.den)
        self.enough = least_rare(self.num, self.den)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        exact = n - -(-self.num * n // self.den) + 1
        for m in (min(n, 4 * self.low), n):
            head = s[:m]
            rare = np.ones(m, dtype=bool)
            if len(self.common):
                rare = self.common[np.minimum(np.searchsorted(self.common, head), len(self.common) - 1)] != head
            count = np.cumsum(rare)
            need = np.full(m, exact)
            need[: len(self.enough)] = np.minimum(exact, self.enough[:m])
            ends = np.flatnonzero(count >= need)
            if len(ends):
                return head[: ends[0] + 1][rare[: ends[0] + 1]]
        return np.concatenate([s[rare], s[~rare][: min(exact - int(count[-1]), self.low)]])


def _sets(texts: list[str | None], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and shingle set of each text. Words end at ASCII white space; A-Z is lower-cased."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    for lo, hi in chunks(data):
        h, owner = word_hashes(data[lo:hi])
        at = np.searchsorted(owner, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield lo + i, shingles(h[at[i] : at[i + 1]], k)


def _digest(s: np.ndarray) -> tuple[bytes, int]:
    d = xxhash.xxh128_digest(s.tobytes())
    return d, int.from_bytes(d[:4], "little", signed=True)


def describe(docs: DataFrame, id_col: str, text_col: str, k: int, low: int) -> DataFrame:
    """``(id, tag, n, digest, tokens, bits)``: set size, digest of the set, its lowest hashes and its bitmap.

    ``tag`` tells apart different sets of a repeated id.
    """

    def run(batches):
        for b in batches:
            n, tag, digest, tokens, bits = [], [], [], [], []
            for _, s in _sets(b.column(1).to_pylist(), k):
                d, t = _digest(s)
                n.append(len(s))
                digest.append(d)
                tag.append(t)
                tokens.append(s[:low].view(np.int64))
                bits.append(tree.bitmap(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(tag, pa.int32()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["id", "tag", "n", "digest", "tokens", "bits"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(released(run), "id long, tag int, n long, digest binary, tokens array<long>, bits binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _keys(docs: DataFrame, id_col: str, text_col: str, k: int, prefix: Prefix) -> DataFrame:
    """``(token, id, tag, n)``: the hashes by which each row's set is dealt to groups."""
    sent = docs.sparkSession.sparkContext.broadcast(prefix)

    def run(batches):
        for b in batches:
            take = [np.zeros(0, np.uint64)]
            tag, n, count = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, s in _sets(b.column(1).to_pylist(), k):
                if len(s):
                    own = sent.value(s)
                    take.append(own)
                    tag[i] = _digest(s)[1]
                    n[i], count[i] = len(s), len(own)
            each = np.repeat(np.arange(b.num_rows), count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(take).view(np.int64)), b.column(0).take(pa.array(each)), pa.array(tag[each]), pa.array(n[each])], names=["token", "id", "tag", "n"]
            )

    return _texts(docs, id_col, text_col).mapInArrow(released(run), "token long, id long, tag int, n long")


def _whole(k: DataFrame, zone: int, x) -> DataFrame:
    return k.select("token", F.lit(zone).alias("zone"), x.alias("x"), "id", "tag", "n", "component")


def _placed(k: DataFrame, num: int, den: int) -> DataFrame:
    """The keys of large groups, each once, with the block ``at`` that it goes to.

    A block has members of one band of size. A component with many members in a
    band has blocks of its own, which need not be walked together.
    """
    step = -math.log(num / den) if 0 < num < den else 1.0
    k = k.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int"))
    part = k.groupBy("token", "band", "component").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    own = F.col("m") >= BLOCK // 2
    part = part.withColumns({"own": own, "of": F.when(own, F.col("component")).otherwise(0)})
    by = ["token", "band", "own", "of"]
    blocks = F.ceil(F.greatest(F.sum("m") / F.lit(float(BLOCK)), F.sum("size") / F.lit(float(BLOCK * TOKENS)))).cast("int")
    part = part.join(part.groupBy(*by).agg(blocks.alias("blocks")), by).select(*by, "component", "blocks")
    salt = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("salt")
    return k.drop("blocks", "salt").join(part, ["token", "band", "component"]).withColumn("at", F.struct("band", "own", "of", salt))


def _packed(placed: DataFrame) -> DataFrame:
    """``(token, at, lo, hi, members)``: a row for each block, with its range of sizes and its members' bitmaps."""
    members = F.collect_list(F.struct("id", "n", "component", "bits"))
    return placed.groupBy("token", "at").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), members.alias("members"))


def _met(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """``(token, same, p, q)``: the members of all pairs of blocks of a group, each with itself too, that may hold a link of different components.

    A block is sent to a fixed number of tasks, in groups of over SPREAD * HELD blocks to one for every HELD blocks.
    """
    n = F.count("*")
    tasks = F.greatest(F.least(n, F.lit(SPREAD)), F.ceil(n / F.lit(HELD))).cast("int")
    b = blocks.join(blocks.groupBy("token").agg(tasks.alias("tasks")), "token")
    p = b.select("token", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), *[F.col(c).alias("p_" + c) for c in ("at", "lo", "hi", "members")])
    q = b.select("token", F.pmod(F.xxhash64("at"), F.col("tasks")).cast("int").alias("task"), *[F.col(c).alias("q_" + c) for c in ("at", "lo", "hi", "members")])
    c = F.col
    apart = ~(c("p_at.own") & c("q_at.own") & (c("p_at.of") == c("q_at.of")))
    sizes = (c("p_hi") * den >= c("q_lo") * num) & (c("q_hi") * den >= c("p_lo") * num)
    pairs = p.join(q, ["token", "task"]).where((c("p_at") <= c("q_at")) & sizes & apart)
    return pairs.select("token", (c("p_at") == c("q_at")).alias("same"), "p_members", "q_members")


def _candidates(ids, sizes, part, maps, num: int, den: int, offer: str, side=None) -> tuple[np.ndarray, np.ndarray, bool]:
    """The pairs that a cell offers, of different sides where there are two, and whether it has more."""
    across = offer != "first"
    a, b, most = tree.candidates(sizes, maps, num, den, part if across else None)
    ok = ids[a] != ids[b]
    if side is not None:
        ok &= side[a] != side[b]
    if across:
        ok &= part[a] != part[b]
    a, b, most = a[ok], b[ok], most[ok]
    if offer == "best" or (offer == "first" and len(a) > 2 * len(ids)):
        node = np.unique(part, return_inverse=True)[1]
        kept = tree.forest(node[a], node[b], most / (sizes[a] + sizes[b] - most), len(ids))
        return a[kept], b[kept], len(kept) < len(a)
    return a, b, False


def _offered(ids: np.ndarray, a: np.ndarray, b: np.ndarray, token: int, more: bool) -> Iterator[tuple[int, int | None, int]]:
    if more:
        yield int(ids[0]), None, token
    for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
        yield min(x, y), max(x, y), token


def _batch(out: list[tuple]) -> pa.RecordBatch:
    x, y, z = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.int64())], names=["a", "b", "token"])


def _walk_blocks(pairs: DataFrame, num: int, den: int, offer: str) -> DataFrame:
    """``_walk`` for pairs of blocks of large groups."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(1)[i].as_py()
                sides = [batch.column(c).slice(i, 1).flatten() for c in ((2,) if same else (2, 3))]
                ids, sizes, part = (np.concatenate([np.asarray(x.field(f)) for x in sides]) for f in range(3))
                if (part == part[0]).all():
                    continue
                maps = [np.frombuffer(v, dtype=np.uint64) for x in sides for v in x.field(3).to_pylist()]
                side = None if same else np.repeat([0, 1], [len(x) for x in sides])
                a, b, more = _candidates(ids, sizes, part, maps, num, den, offer, side)
                if out := list(_offered(ids, a, b, batch.column(0)[i].as_py(), more)):
                    yield _batch(out)

    return pairs.mapInArrow(released(run), "a long, b long, token long")


def _walk(cells: DataFrame, num: int, den: int, offer: str) -> DataFrame:
    """``(a, b, token)``: candidate pairs of every cell; a row without b says that the cell has more of them.

    offer: "first": cells of zone CHAIN offer their chain, others with many
    candidates a spanning forest. The others leave out pairs inside one
    ``component``: "best" offers a spanning forest of the components, likeliest
    pairs first, "all" offers all pairs.
    """
    across = offer != "first"
    columns = ["token", "zone", "x", "id", "n", "component", "bits"]
    dealt = cells.select(*columns).repartition("token", "zone", "x").sortWithinPartitions("token", "zone", "x", "id")

    def solve(t: dict[str, np.ndarray], bits: list[bytes]) -> Iterator[tuple[int, int | None, int]]:
        ids, sizes, part, more = t["id"], t["n"], t["component"], False
        if len(ids) < 2 or (across and (part == part[0]).all()):
            return
        maps = [np.frombuffer(x, dtype=np.uint64) for x in bits]
        if int(t["zone"][0]) == CHAIN:
            a, b = tree.chain(sizes, maps, num, den)
        else:
            a, b, more = _candidates(ids, sizes, part, maps, num, den, offer)
        yield from _offered(ids, a, b, int(t["token"][0]), more)

    def run(batches):
        held = None
        for b in _with_end(batches):
            t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            t = t.combine_chunks()
            cols = {c: np.asarray(t.column(c)) for c in columns[:-1]}
            runs = tree.groups(np.stack([cols[c] for c in columns[:3]], axis=1))
            held = None
            if b is not None:
                held = t.slice(runs[-1][0])
                runs = runs[:-1]
            out: list[tuple] = []
            bits = t.column("bits")
            for lo, hi in runs:
                out += solve({c: v[lo:hi] for c, v in cols.items()}, bits.slice(lo, hi - lo).to_pylist())
            if out:
                yield _batch(out)

    return dealt.mapInArrow(released(run), "a long, b long, token long")


def _with_end(batches):
    yield from batches
    yield None


def _slot(column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER))


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER bits with the slots of all ids set, made up in Spark: words of 64 bits come to the driver."""
    slots = ids.select(_slot(column).alias("s")).select(F.shiftright("s", 6).alias("word"), (F.col("s") % 64).cast("int").alias("bit"))
    rows = slots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    words = np.zeros(FILTER // 64, dtype=np.int64)
    words[np.asarray(rows.column(0))] = np.asarray(rows.column(1))
    return words.view(np.uint64)


def _picked(ids: DataFrame, column: str, docs: DataFrame, id_col: str, text_col: str, k: int, columns, schema: str) -> DataFrame:
    """``columns(ids, sets)`` of the documents whose ids are wanted, and of a few others, read from their texts.

    Texts outside a filter of fixed size are not moved; the join that follows drops those that pass it by chance.
    """
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(ids, column))

    def run(batches):
        wanted = sent.value
        for b in batches:
            slot = np.asarray(b.column(2))
            pick = pa.array(np.flatnonzero(wanted[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)))
            own, texts = b.column(0).take(pick), b.column(1).take(pick)
            for lo in range(0, len(own), 256):
                sets = [s for _, s in _sets(texts.slice(lo, 256).to_pylist(), k)]
                yield columns(own.slice(lo, 256), sets)

    return _texts(docs, id_col, text_col).withColumn("slot", _slot("id")).mapInArrow(released(run), schema)


def _sets_of(pairs: DataFrame, side: str, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(side, s + side)``: the whole sets of the documents on one side of the pairs."""

    def columns(ids, sets):
        return pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=[side, "s" + side])

    return _picked(pairs, side, docs, id_col, text_col, k, columns, f"{side} long, s{side} binary")


def _bits_of(keys: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(id, tag, bits)``: wide bitmaps of the documents of some groups."""

    def columns(ids, sets):
        tags = [_digest(s)[1] for s in sets]
        bits = [tree.bitmap(s, WIDE) if len(s) else b"" for s in sets]
        return pa.RecordBatch.from_arrays([ids, pa.array(tags, pa.int32()), pa.array(bits, pa.binary())], names=["id", "tag", "bits"])

    return _picked(keys, "id", docs, id_col, text_col, k, columns, "id long, tag int, bits binary")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Those of the distinct ``(a, b)`` whose whole sets link, with the sizes of overlap and union."""
    both = pairs.join(_sets_of(pairs, "a", docs, id_col, text_col, k), "a").join(_sets_of(pairs, "b", docs, id_col, text_col, k), "b")

    def check(batches):
        for b in batches:
            a, c = b.column(0), b.column(1)
            inter, union = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                m = len(np.intersect1d(s, t, assume_unique=True))
                inter.append(m)
                union.append(len(s) + len(t) - m)
            keep = pa.array([m * den >= num * u for m, u in zip(inter, union, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a, c, pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "overlap", "union_size"]).filter(keep)

    return both.select("a", "b", "sa", "sb").mapInArrow(released(check), "a long, b long, overlap long, union_size long")


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Membership and links of the documents whose shingle sets have Jaccard similarity >= num / den.

    Returns ``(members, links)``. members: ``doc_id, n_shingles, class_id,
    component_id`` for every row with an id; class = least id with the same set;
    component = least id reachable by links. links: verified pairs of class
    representatives ``(a, b, overlap, union_size)``, enough to connect every
    component (not all pairs within it). Null or blank text has an empty set:
    it is its own class and component. Rows with a null id are left out; a
    repeated id counts once for each different text, and is itself one node.
    """
    small_batches(docs.sparkSession)
    low = prefix_size(num, den)
    s = materialise(describe(docs, id_col, text_col, k, low), "sets")
    classes = s.where("n > 0").groupBy("digest").agg(F.min("id").alias("class_id"))
    member = materialise(
        s.where("n > 0").select("id", "tag", "n", "digest").join(classes, "digest").select("id", "tag", "n", "class_id").unionByName(
            s.where("n = 0").select("id", "tag", "n", F.col("id").alias("class_id"))
        ),
        "classes",
    )
    parts, links = _links(s, member, docs, id_col, text_col, k, num, den)
    # texts of a repeated id that fall into different classes join these
    several = member.groupBy("id").agg(F.count_distinct("class_id").alias("c")).where("c > 1").select("id")
    extra = materialise(member.join(several, "id", "left_semi").select("id", "class_id").where("id <> class_id").distinct(), "repeated")
    if not extra.isEmpty():
        parts = merged_components(parts, extra, "id", "class_id")
    members = member.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    return members, links


def _dealt(s, member, docs, id_col, text_col, k_words, num, den) -> DataFrame:
    """The keys of all groups of two sets or more, once for groups with the same members, with the size ``c`` of the group."""
    often = s.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > COMMON)
    least = max(COMMON, s.count() * prefix_size(num, den) // MOST_COMMON)
    common = np.sort(np.asarray(often.where(F.col("c") > least).select("token").toArrow().column(0), dtype=np.int64).view(np.uint64))
    own = member.where("n > 0 and id = class_id").select("id", "tag").distinct()
    keys = _keys(docs, id_col, text_col, k_words, Prefix(common, num, den)).join(own, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag", "token"])
    keys = materialise(keys, "keys")
    of = keys.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id", "tag")).alias("members"), F.min("id").alias("first")).where("c >= 2")
    once = of.groupBy("c", "members", "first").agg(F.min("token").alias("token")).select("token", "c")
    blocks = F.ceil(F.col("c") / F.lit(float(BLOCK))).cast("int")
    return keys.join(once, "token").withColumns({"component": F.col("id"), "blocks": blocks, "salt": F.pmod(F.xxhash64("id"), blocks).cast("int")})


def _links(s, member, docs, id_col, text_col, k_words, num, den) -> tuple[DataFrame, DataFrame]:
    """``(parts, links)``: the component of every class that has a link, and the verified pairs."""
    k = materialise(_dealt(s, member, docs, id_col, text_col, k_words, num, den), "groups")
    bits = s.where("n > 0").select("id", "tag", "bits")
    repeats = not member.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    if repeats:
        bits = bits.dropDuplicates(["id", "tag"])
    small, large = k.where(F.col("c") <= SMALL), k.where(F.col("c") > SMALL)
    cells = _whole(small, 0, F.lit(0)).unionByName(_whole(large, CHAIN, F.col("salt")))
    found = materialise(_walk(cells.join(bits, ["id", "tag"]), num, den, "first"), "candidates")
    tried = materialise(found.where("b is not null").select("a", "b").distinct(), "pairs")
    links = materialise(verified(tried, docs, id_col, text_col, k_words, num, den), "links")
    parts = connected_components(links, "a", "b")
    todo = found.where("b is null").select("token").unionByName(large.select("token")).distinct()
    for offer in ("best", "all"):
        if todo.isEmpty():
            break
        now = k.drop("component").join(todo, "token", "left_semi").join(parts.withColumnRenamed("node", "id"), "id", "left")
        now = materialise(now.withColumn("component", F.coalesce("component", "id")), "groups")
        several = now.groupBy("token").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q")
        # read several times below; a later round has no other groups
        k = now = materialise(now.join(several.select("token"), "token", "left_semi"), "several")
        bits = _bits_of(now, docs, id_col, text_col, k_words)
        if repeats:
            bits = bits.dropDuplicates(["id", "tag"])
        bits = materialise(bits, "bitmaps")
        whole, large = now.where(F.col("c") <= BLOCK), now.where(F.col("c") > BLOCK)
        found = _walk(_whole(whole, 0, F.lit(0)).join(bits, ["id", "tag"]), num, den, offer)
        if not large.isEmpty():
            blocks = materialise(_packed(_placed(large, num, den).join(bits, ["id", "tag"])), "blocks")
            found = found.unionByName(_walk_blocks(_met(blocks, num, den), num, den, offer))
        found = materialise(found, "candidates")
        new = materialise(found.where("b is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        more = materialise(verified(new, docs, id_col, text_col, k_words, num, den), "links")
        parts = merged_components(parts, more, "a", "b")
        links = links.unionByName(more)
        tried, todo = tried.unionByName(new), found.where("b is null").select("token").distinct()
    return parts, links


def one_of_each(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Of every group of near copies the document with the least id, with its columns.

    Rows without an id stay, as do blank texts. Where ids repeat, rows are told
    apart by id and text: of equal ones one stays, and different texts of one id are documents of their own.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    if repeated.isEmpty():
        members, _ = jaccard_join(docs, k=k, num=num, den=den)
        losers = materialise(members.where("doc_id <> component_id").select("doc_id"), "losers")
        return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
    row = "_row_of_id_and_text"
    own = ranked(docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]), ["doc_id", "text"], row)
    own = materialise(own, "rows")
    members, _ = jaccard_join(own, id_col=row, k=k, num=num, den=den)
    losers = materialise(members.where("doc_id <> component_id").select(F.col("doc_id").alias(row)), "losers")
    left = own.join(losers, row, "left_anti").select(*docs.columns)
    return left.unionByName(docs.where("doc_id is null"))
