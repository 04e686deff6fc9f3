"""Removal of every byte covered by a string of 100 bytes that also starts earlier.

Equal strings have the same anchor (of their 32-byte parts the one of least
hash, the leftmost among equals) at the same place. Neighbouring strings with
one anchor make a segment, about one for every 35 bytes. Anchors that occur once are done
with; segments that are equal as wholes are settled by their first occurrence;
of segments that share an anchor but differ, the first occurrences' suffixes are
sorted within the anchor's group (``suffix_sort``), which tells the strings
that they have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.llm.hashing import _BYTES, U, _power, mix
from netgrid.llm.memory import released, small_batches
from netgrid.llm.suffix_sort import equal_suffixes
from netgrid.llm.syncmers import sliding_min
from netgrid.plans.order import ranked
from netgrid.plans.storage import materialise

LENGTH, ANCHOR = 100, 32
PIECE = 1 << 20  # windows whose anchors are found at a time
PLACE = 22  # bits of a place within a piece
FILTER = 26  # bits of a slot in the filters of fixed size (8 MB each)
#: Groups of more segments are settled string by string; at most MOST_HOT anchors are so frequent.
LARGE = 20_000
MOST_HOT = 1 << 20


# ---------------------------------------------------------------- segments of texts


def segments(joined: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of ``(text, start, windows, anchor, whole, place)``: the segments of texts that lie end to end.

    ``start`` counts from the text's start; ``anchor`` and ``whole`` are 64-bit
    hashes of the anchor and of all of the segment's bytes; ``place`` is where
    the anchor begins in the segment.
    """
    total = int(offsets[-1])
    ok = np.zeros(total + 1, np.int32)
    np.add.at(ok, offsets[:-1], 1)
    np.add.at(ok, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), -1)
    ok = np.cumsum(ok[:-1]) > 0
    for lo in range(0, total, PIECE):
        hi = min(lo + PIECE + LENGTH - 1, total)
        n = hi - lo
        if n < LENGTH:
            return
        power, inverse = _power(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[joined[lo:hi]] * power[:n], out=sums[1:])
        grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
        ranked_ = (grams >> U(PLACE) << U(PLACE)) | np.arange(len(grams), dtype=np.uint64)
        least = (sliding_min(ranked_, LENGTH - ANCHOR + 1) & U((1 << PLACE) - 1)).astype(np.int64)
        at = np.flatnonzero(ok[lo : lo + len(least)])
        if not len(at):
            continue
        where = least[at]
        new = np.r_[True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(new)
        start, where, count = at[first], where[first], np.diff(np.r_[first, len(at)])
        end = start + count + LENGTH - 1
        whole = mix((sums[end] - sums[start]) * inverse[start] + count.astype(np.uint64))
        text = np.searchsorted(offsets, start + lo, side="right") - 1
        yield text, start + lo - offsets[text], count, grams[where].view(np.int64), whole.view(np.int64), where - start


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, end to end, and where each begins (one more than texts)."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and offsets.size else np.zeros(1, np.int64)
    joined = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and data.size else np.zeros(0, np.uint8)
    return joined, offsets - offsets[0]


def slot(at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of a place in the corpus."""
    return mix(at.view(np.uint64) * U(0x9E3779B97F4A7C15) + start.astype(np.uint64)).view(np.int64)


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of 2^26 bits with the slots of all mixed 64-bit hashes set, made up in Spark: words of 64 bits come to the driver."""
    s = hashes.select(F.shiftrightunsigned(F.col("h"), 64 - FILTER).alias("s"))
    rows = s.select(F.shiftright("s", 6).alias("word"), (F.col("s") % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER - 6), dtype=np.int64)
    out[np.asarray(rows.column(0))] = np.asarray(rows.column(1))
    return out.view(np.uint64)


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    s = h.view(np.uint64) >> U(64 - FILTER)
    return (words[(s >> U(6)).astype(np.int64)] >> (s & U(63)) & U(1)).astype(bool)


def among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def anchor_counts(texts: DataFrame) -> DataFrame:
    """``(h, n)``: the anchors that occur more than once."""

    def run(batches):
        for b in batches:
            found = [x[3] for x in segments(*layout(b.column(0)))]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return texts.select("text").mapInArrow(released(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def occurrences(texts: DataFrame, anchors: np.ndarray, hot: np.ndarray) -> DataFrame:
    """``(h, whole, at, s, e, hot)``: the segments whose anchors pass a filter, from byte s to byte e of text ``at``."""
    sent = texts.sparkSession.sparkContext.broadcast((anchors, hot))

    def run(batches):
        words, often = sent.value
        for b in batches:
            ids = b.column(0).to_numpy()
            for text, start, count, h, whole, _ in segments(*layout(b.column(1))):
                k = np.flatnonzero(passes(words, h))
                if len(k):
                    cols = [h[k], whole[k], ids[text[k]], start[k].astype(np.int32), (start[k] + count[k] + LENGTH - 1).astype(np.int32), among(often, h[k])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "whole", "at", "s", "e", "hot"])

    return texts.select("at", "text").mapInArrow(released(run), "h long, whole long, at long, s int, e int, hot boolean")


def segment_bytes(texts: DataFrame, places: np.ndarray, hot: np.ndarray) -> DataFrame:
    """``(h, at, s, place, data, hot)``: the bytes of the segments whose places pass a filter."""
    sent = texts.sparkSession.sparkContext.broadcast((places, hot))

    def run(batches):
        words, often = sent.value
        for b in batches:
            ids = b.column(0).to_numpy()
            joined, offsets = layout(b.column(1))
            for text, start, count, h, _, place in segments(joined, offsets):
                k = np.flatnonzero(passes(words, slot(ids[text], start)))
                if not len(k):
                    continue
                lo = offsets[text[k]] + start[k]
                size = count[k] + LENGTH - 1
                cut = np.r_[0, np.cumsum(size)]
                flat = joined[np.repeat(lo - cut[:-1], size) + np.arange(cut[-1])]
                data = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(flat)])
                cols = [pa.array(h[k]), pa.array(ids[text[k]]), pa.array(start[k].astype(np.int32)), pa.array(place[k].astype(np.int32)), data, pa.array(among(often, h[k]))]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "at", "s", "place", "data", "hot"])

    return texts.select("at", "text").mapInArrow(released(run), "h long, at long, s int, place int, data binary, hot boolean")


# ---------------------------------------------------------------- groups of an anchor


def whole_groups(batches, key: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by ``key``, cut between its values."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1])
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(cuts):
            last = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks().to_batches()[0]
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def settled(found: DataFrame) -> DataFrame:
    """``(at, s, e, slot)``: later occurrences of equal segments, and (with their ``slot``) the first ones of segments that differ under one anchor."""

    def run(batches):
        for b in whole_groups(batches, "h"):
            h, whole, at, s, e = (b.column(i).to_numpy() for i in range(5))
            new = np.r_[True, h[1:] != h[:-1]]
            first = new | np.r_[True, whole[1:] != whole[:-1]]
            group = np.cumsum(new) - 1
            mixed = first & (np.bincount(group[first])[group] > 1)
            out = ~first | mixed
            yield pa.RecordBatch.from_arrays([pa.array(at[out]), pa.array(s[out]), pa.array(e[out]), pa.array(slot(at, s)[out], mask=~mixed[out])], names=["at", "s", "e", "slot"])

    dealt = found.select("h", "whole", "at", "s", "e").repartition("h").sortWithinPartitions("h", "whole", "at", "s")
    return dealt.mapInArrow(released(run), "at long, s int, e int, slot long")


def intervals(which: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows j of segments: the segment, its first window and the one after its last."""
    order = np.lexsort((j, which))
    which, j = which[order], j[order]
    new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (j[1:] != j[:-1] + 1)]) if len(j) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(j)] - 1 if len(new) else new
    return which[new], j[new], j[last] + 1


def windows_of(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """For every window of the segments of a batch: the segment, its number there and where it starts in the joined bytes, which come last."""
    data, offsets = layout(b.column(b.schema.get_field_index("data")))
    count = np.diff(offsets) - LENGTH + 1
    which = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, j, offsets[which] + j, data


def later_strings(found: DataFrame) -> DataFrame:
    """``(at, s, e)``: what is covered by strings that start earlier in another segment of the same anchor."""

    def run(batches):
        for b in whole_groups(batches, "h"):
            h, at, s, place = (b.column(i).to_numpy() for i in range(4))
            which, j, starts, data = windows_of(b)
            # equal strings have their anchor at the same place
            group = (np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1)[which] * LENGTH + place[which] - j
            order = np.argsort(group, kind="stable")
            got, leaf = equal_suffixes(data, starts[order], group[order], LENGTH)
            got = order[got]
            p = s[which[got]] + j[got]
            order = np.lexsort((p, at[which[got]], leaf))
            later = got[order[np.r_[False, leaf[order][1:] == leaf[order][:-1]]]] if len(got) else got
            seg, lo, hi = intervals(which[later], j[later])
            yield pa.RecordBatch.from_arrays([pa.array(at[seg]), pa.array((s[seg] + lo).astype(np.int32)), pa.array((s[seg] + hi + LENGTH - 1).astype(np.int32))], names=["at", "s", "e"])

    dealt = found.select("h", "at", "s", "place", "data").repartition("h").sortWithinPartitions("h", "at", "s")
    return dealt.mapInArrow(released(run), "at long, s int, e int")


def strings(found: DataFrame) -> DataFrame:
    """``(h, whole, at, s, e)`` of every string of the segments: two hashes of it and its place."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                at, s = part.column(0).to_numpy(), part.column(1).to_numpy()
                which, j, starts, data = windows_of(part)
                power, inverse = _power(len(data) + 1)
                hashes = []
                for add in (0, 1):
                    sums = np.zeros(len(data) + 1, dtype=np.uint64)
                    np.cumsum(mix(_BYTES + U(add))[data] * power[: len(data)], out=sums[1:])
                    hashes.append(mix((sums[starts + LENGTH] - sums[starts]) * inverse[starts]).view(np.int64))
                p = (s[which] + j).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), pa.array(at[which]), pa.array(p), pa.array(p + np.int32(LENGTH))], names=["h", "whole", "at", "s", "e"])

    return found.select("at", "s", "data").mapInArrow(released(run), "h long, whole long, at long, s int, e int")


def firsts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows ``(h, whole, at, s, e)``: those that are not the first of their (h, whole), and the first ones.

    The first places of keys with many rows, of which there are few, are sent to all tasks; others are joined.
    """
    key = ["h", "whole"]
    first = materialise(found.groupBy(*key).agg(F.min(F.struct("at", "s")).alias("first"), F.count("*").alias("n")), "firsts")
    total = first.agg(F.sum("n")).first()[0] or 0
    bound = max(LARGE, total >> 16)
    often = F.broadcast(first.where(F.col("n") > bound).select(*key, F.col("first").alias("f1")))  # at most 65,536 rows
    rest = first.where(F.col("n").between(2, bound)).select(*key, F.col("first").alias("f2"))
    one = found.join(often, key, "left")
    later = one.where("f1 is not null").where(F.struct("at", "s") > F.col("f1")).select("at", "s", "e")
    other = one.where("f1 is null").drop("f1").join(rest, key).where(F.struct("at", "s") > F.col("f2")).select("at", "s", "e")
    return later.unionByName(other), first.select(*key, "first.at", "first.s")


# ---------------------------------------------------------------- all of it


def _ordered(docs: DataFrame) -> DataFrame:
    """``(at, doc_id, text)``: ``at`` tells the order of texts; it is the id where ids are there and different."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    most, nulls = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    if (most or 1) == 1 and not nulls:
        return rows.select(F.col("doc_id").alias("at"), "doc_id", "text")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    order = ranked(rows.select("row", "doc_id", F.xxhash64("text").alias("h")), [F.col("doc_id").asc_nulls_first(), "h", "row"], "at")
    return materialise(rows.join(order.select("row", "at"), "row").select("at", "doc_id", "text"), "texts")


def covered(texts: DataFrame) -> DataFrame:
    """``(at, s, e)``: stretches of bytes, many of them overlapping, that earlier strings cover."""
    repeated = materialise(anchor_counts(texts), "anchors")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    # at most total / LARGE and at most MOST_HOT of them
    hot = np.sort(np.asarray(repeated.where(F.col("n") > max(LARGE, total // MOST_HOT)).select("h").toArrow().column(0)))
    found = materialise(occurrences(texts, filter_of(repeated), hot), "segments")
    made = materialise(settled(found.where("not hot")), "settled")
    out = made.where("slot is null").select("at", "s", "e")
    places = made.where("slot is not null").select(F.col("slot").alias("h"))
    if len(hot):
        later, first = firsts(found.where("hot"))
        out = out.unionByName(later)

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(slot(b.column(0).to_numpy(), b.column(1).to_numpy()))], names=["h"])

        places = places.unionByName(first.select("at", "s").mapInArrow(released(run), "h long"))
    data = materialise(segment_bytes(texts, filter_of(places), hot), "suffixes")
    out = out.unionByName(later_strings(data.where("not hot")))
    if len(hot):
        later, _ = firsts(materialise(strings(data.where("hot")), "strings"))
        out = out.unionByName(later)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row of ``docs`` (doc_id, text).

    A byte is removed when a string of 100 bytes that covers it also starts
    earlier: in a text of smaller id, or earlier in the same text. Strings are
    bytes of UTF-8 and are judged on the input. A null text is empty; texts
    below 100 bytes keep everything. A null id comes before all others; texts
    of equal ids are ordered by a hash of the text, so of equal rows one is kept
    and the others lose everything from 100 bytes on. Extra columns are
    ignored; an empty table gives no rows. ``kept`` is binary, as a cut may
    fall within a character.

    Texts are read three times for hashes of segments; only segments whose
    anchors occur again are moved, then their bytes where they differ, and
    each text once with its stretches. A task holds a batch of texts or the
    segments of one anchor, 20,000 or a millionth of all; more frequent
    anchors are settled string by string, by two 64-bit hashes each.
    """
    small_batches(docs.sparkSession)
    texts = _ordered(docs)
    spans = covered(texts).groupBy("at").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # bounded by the text's length

    def run(batches):
        for b in batches:
            out = [], [], [], [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                cut = b.column(2)[i]
                removed = np.zeros(len(text) + 1, np.int32)
                if cut.is_valid:
                    flat = cut.values.flatten()
                    np.add.at(removed, flat[0].to_numpy(), 1)
                    np.add.at(removed, flat[1].to_numpy(), -1)
                gone = np.cumsum(removed[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                starts = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                for x, v in zip(out, (len(text), len(text) - len(kept), starts, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    x.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.join(spans, "at", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
