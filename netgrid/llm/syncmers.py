"""Document fingerprints of closed syncmers.

A k-mer of characters is a closed syncmer when the least hash of its s-mers is
that of its first or of its last one. The choice looks at the k-mer alone, so
equal passages yield the same anchors wherever they stand. A fingerprint keeps
all anchors with their places, about two for every eleven characters; two
fingerprints are compared by the anchors they share whose places agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.llm.hashing import mix
from netgrid.llm.memory import released, small_batches
from netgrid.llm.shards import range_bounds, shard_of

K, S = 16, 6
FLUSH = 1 << 23  # characters of fingerprints given on at once
PLACES = 1 << 16  # places are kept as parts of the text's length
SHIFT = 0.1  # places agree when they differ from the usual shift by no more than this part of a text
_STEP = np.uint64(0x9E3779B97F4A7C15)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values, by doubling."""
    out, done, parts = None, 0, h
    size = 1
    while True:
        if k & size:
            if out is None:
                out, done = parts, size
            else:
                n = len(parts) - done
                out = out[:n] * np.uint64(pow(int(_STEP), size, 1 << 64)) + parts[done : done + n] if n > 0 else parts[:0]
                done += size
        size *= 2
        if size > k:
            return out[: max(len(h) - k + 1, 0)]
        half = size // 2
        n = len(parts) - half
        if n <= 0:
            return h[:0]
        parts = parts[:n] * np.uint64(pow(int(_STEP), half, 1 << 64)) + parts[half:]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _whole(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One anchor for all of a text; none for an empty one."""
    h = np.array([len(chars) + 1], dtype=np.uint64)[: len(chars)]
    for c in mix(chars.astype(np.uint64) + np.uint64(1)):
        h = mix(h * _STEP + c)
    return h, np.zeros(len(h), np.int64)


def syncmers(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers; a text without any is one anchor, an empty one none."""
    n = len(chars)
    if n < K:
        return _whole(chars)
    letters = mix(chars.astype(np.uint64) + np.uint64(1))
    small = rolling(letters, S)
    small ^= small >> np.uint64(29)
    small = (small * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    w = K - S + 1
    low = sliding_min(small, w)
    at = np.flatnonzero((small[: len(low)] == low) | (small[w - 1 :] == low))
    return (mix(rolling(letters, K)[at]), at) if len(at) else _whole(chars)


def fingerprint(text: str | np.ndarray) -> str:
    """All anchors: hash (12 hex digits) and place (4) each, in order of both; equal texts, equal strings."""
    chars = characters(text) if isinstance(text, str) else text
    h, at = syncmers(chars)
    place = (at * (PLACES - 1) // max(len(chars), 1)).astype(np.uint64)
    return np.sort((h >> np.uint64(16) << np.uint64(16)) | place).astype(">u8").tobytes().hex()


def anchors(print_: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of a fingerprint; the n-th of equal anchors has a key of its own."""
    x = np.frombuffer(bytes.fromhex(print_), ">u8").astype(np.uint64)
    h = x >> np.uint64(16)
    n = np.arange(len(h)) - np.searchsorted(h, h)
    return np.where(n > 0, mix(h * _STEP + n.astype(np.uint64)), h), (x & np.uint64(PLACES - 1)) / (PLACES - 1)


def likeness(one: str, two: str) -> float:
    """Of the anchors of both together, the share in both at agreeing places; 1 for equal prints, else below 1."""
    if one == two:
        return 1.0
    (a, at), (b, bt) = anchors(one), anchors(two)
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    moved = at[i] - bt[j]
    agree = np.abs(moved - np.median(moved)) <= SHIFT
    return min(int(agree.sum()) / (len(a) + len(b) - len(both)), 0.999999)


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` of every row; null text counts as empty, whose fingerprint is empty."""

    def run(batches):
        for b in batches:
            prints, size, done, chars = [], [], 0, 0
            for k, x in enumerate(b.column(1).to_pylist(), 1):
                prints.append(fingerprint(x or ""))
                size.append(len(x or ""))
                chars += len(prints[-1])
                if k == b.num_rows or chars > FLUSH:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, k - done), pa.array(size, pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "n_chars", "fingerprint"])
                    prints, size, done, chars = [], [], k, 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(released(run), "doc_id long, n_chars long, fingerprint string")


def compare_with_edits(docs: DataFrame, shard_chars: float = 16e6) -> DataFrame:
    """Each document against its edited text and against the next document by ascending id (the first after the last).

    Rows go once to shards by ranges of the id; the first row of a shard also
    goes to the shard before it, so no text is looked up elsewhere. Rows with a
    null id are left out; equal ids follow each other by text. A single document
    is its own next one.
    """
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    bounds, _ = range_bounds(src, "doc_id", F.length("text") + 16, shard_chars)
    n = len(bounds) + 1
    # one row a shard: its least id
    firsts = src.groupBy(shard_of(F.col("doc_id"), bounds).alias("shard")).agg(F.min("doc_id").alias("first_id"))
    shard = shard_of(F.col("doc_id"), bounds)
    rows = src.withColumn("shard", shard).join(F.broadcast(firsts), "shard")
    also = F.when(F.col("doc_id") == F.col("first_id"), F.array(F.col("shard"), F.pmod(F.col("shard") - 1, F.lit(n)) + n)).otherwise(F.array("shard"))
    dealt = (
        rows.select("doc_id", "text", F.explode(also).alias("to"))
        .select("doc_id", "text", F.pmod("to", F.lit(n)).alias("shard"), (F.col("to") >= n).cast("int").alias("guest"))
        .repartitionById(n, F.col("shard"))
        .sortWithinPartitions("shard", "guest", "doc_id", "text")
        .select("doc_id", "text", "guest", "shard")
    )
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # (id, text, fingerprint) of the row before
        ended = None  # the shard whose guest has come

        def compare(one, text, print_):
            new = edited(one[1], text)
            own = fingerprint(new)
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            return one[0], len(one[1]), sha, one[2], own, likeness(one[2], own), likeness(one[2], print_)

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            out, chars = [], 0
            for k, (i, text, guest, shard) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True), 1):
                if not (guest and ended == shard):  # else a repeated first id: the least text came first
                    print_ = fingerprint(text)
                    if held is not None:
                        out.append(compare(held, text, print_))
                        chars += len(out[-1][3]) + len(out[-1][4])
                    held, ended = (None, shard) if guest else ((i, text, print_), ended)
                if out and (chars > FLUSH or k == b.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, chars = [], 0

    return dealt.mapInArrow(released(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
