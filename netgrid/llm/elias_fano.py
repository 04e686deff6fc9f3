"""Token-id files: one concatenated id array a shard, with Elias-Fano coded document boundaries.

File: ids (16 or 32 bits, little-endian), then the footer: a JSON header, the
Elias-Fano codes of the boundaries and of the document ids, and their select
samples; last the footer's length and the magic word.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.llm.files import committed, opened
from netgrid.llm.memory import released, small_batches
from netgrid.llm.shards import dealt, range_bounds
from netgrid.llm.tokens import encoder, slices
from netgrid.plans.storage import fresh_path, materialise

MAGIC = b"EFIDS001"
EVERY = 256  # one select sample for so many values


@dataclass
class EliasFano:
    """A non-decreasing sequence of n integers below u in about n * (2 + log2(u / n)) bits."""

    n: int
    low_bits: int
    low: np.ndarray  # packed low bits
    high: np.ndarray  # packed unary high parts
    samples: np.ndarray  # bit positions of every EVERY-th one

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) + 1 if len(values) else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(high[-1]) + 1 if n else 0, dtype=np.uint8)
        ones[high] = 1
        low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(ones, bitorder="little"), high[::EVERY].astype(np.uint64))

    def _low(self, lo: int, hi: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(hi - lo, dtype=np.uint64)
        a, b = lo * self.low_bits, hi * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a]
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, lo: int, hi: int | None = None) -> np.ndarray:
        """Values lo to hi - 1 (default: that at lo): from the sample before, over the ones that follow."""
        hi = lo + 1 if hi is None else hi
        if hi <= lo:
            return np.zeros(0, dtype=np.uint64)
        block = lo // EVERY
        start = int(self.samples[block])
        later = -(-hi // EVERY)
        stop = int(self.samples[later]) if later < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :]
        skip = lo - block * EVERY
        ones = np.flatnonzero(bits)[skip : skip + hi - lo] + start
        return ((ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(lo, hi)

    def dump(self) -> tuple[dict, bytes]:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u8").tobytes()]
        return {"n": self.n, "low_bits": self.low_bits, "bytes": [len(p) for p in parts]}, b"".join(parts)

    @classmethod
    def load(cls, head: dict, data: bytes) -> EliasFano:
        a, b, _ = head["bytes"]
        low, high = np.frombuffer(data[:a], np.uint8), np.frombuffer(data[a : a + b], np.uint8)
        return cls(head["n"], head["low_bits"], low, high, np.frombuffer(data[a + b :], "<u8"))


def finish(out, doc_ids: list[int], lengths: list[int], width: int) -> int:
    """Write the footer behind the ids; its tokens."""
    ends = np.cumsum(lengths, dtype=np.uint64) if lengths else np.zeros(0, np.uint64)
    ids = np.asarray(doc_ids, dtype=np.int64)
    base = int(ids[0]) if len(ids) else 0
    heads, data = zip(*(EliasFano.encode(v).dump() for v in (ends, (ids - base).astype(np.uint64))), strict=True)
    header = json.dumps({"width": width, "base": base, "ends": heads[0], "ids": heads[1]}).encode()
    footer = struct.pack("<I", len(header)) + header + data[0] + data[1]
    out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
    return int(ends[-1]) if len(ends) else 0


class IdFile:
    """Reads documents of a file in any order without loading its ids."""

    def __init__(self, uri: str):
        self.file = opened(uri)
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        footer = self.file.read_at(length, size - 16 - length)
        (k,) = struct.unpack("<I", footer[:4])
        head, data = json.loads(footer[4 : 4 + k]), footer[4 + k :]
        cut = sum(head["ends"]["bytes"])
        self.width, self.base = head["width"], head["base"]
        self.ends, self.ids = EliasFano.load(head["ends"], data[:cut]), EliasFano.load(head["ids"], data[cut:])

    def __len__(self) -> int:
        return self.ends.n

    def documents(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of documents lo to hi - 1, their boundaries (one more than documents) and their tokens."""
        first = self.ends.select(lo - 1) if lo else np.zeros(1, np.uint64)
        cuts = np.concatenate([first, self.ends.select(lo, hi)]).astype(np.int64)
        raw = self.file.read_at(int(cuts[-1] - cuts[0]) * self.width, int(cuts[0]) * self.width)
        return self.ids.select(lo, hi).astype(np.int64) + self.base, cuts, np.frombuffer(raw, f"<u{self.width}")


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_chars: float = 16e6
) -> DataFrame:
    """Tokenise whole texts and write them in ascending id order; returns the manifest, written once all shards are.

    A null text is empty and still gets the end id. Rows with a null id are
    left out. Equal ids keep a fixed order (by text). An empty table gives an
    empty manifest. Extra columns are ignored.
    """
    src = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    small_batches(docs.sparkSession)
    bounds, _ = range_bounds(src, "id", F.length("text") + 16, shard_chars)
    rows = dealt(src, "id", bounds, ["id", "text"]) if bounds else src.withColumn("shard", F.lit(0)).coalesce(1).sortWithinPartitions("id", "text")
    leading = tokenizer.startswith("byte_")

    def run(batches):
        e, held = encoder(tokenizer, leading), None
        width = 2 if e.vocab_size <= 1 << 16 else 4
        end = np.array([end_id], dtype="<u4").tobytes()
        made = []

        def start(shard):
            uri = f"{folder}/part-{shard:06d}.ids"
            context = committed(uri)
            return {"shard": shard, "uri": uri, "context": context, "out": context.__enter__(), "ids": [], "lengths": []}

        def stop(h):
            tokens = finish(h["out"], h["ids"], h["lengths"], width)
            h["context"].__exit__(None, None, None)
            made.append((h["shard"], h["uri"], len(h["ids"]), tokens))

        for b in batches:
            ids, shards = np.asarray(b.column(0)), np.asarray(b.column(2))
            for lo, hi in slices(b.num_rows):
                coded = e.encode(b.column(1).slice(lo, hi - lo).to_pylist())
                for i, data in enumerate(coded, lo):
                    if held is None or held["shard"] != shards[i]:
                        if held:
                            stop(held)
                        held = start(int(shards[i]))
                    data += end
                    held["ids"].append(int(ids[i]))
                    held["lengths"].append(len(data) // 4)
                    held["out"].write(np.frombuffer(data, "<u4").astype(f"<u{width}").tobytes())
        if held:
            stop(held)
        if made:
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names=["shard", "uri", "documents", "tokens"])

    return materialise(rows.select("id", "text", "shard").mapInArrow(released(run), "shard int, uri string, documents long, tokens long"), "manifest")


def read_ids(manifest: DataFrame, crc: bool = True, token_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens[, ids_crc32][, ids])`` from the files that a manifest lists.

    The manifest has one row a shard of bounded size; its token counts add up to each shard's start.
    """
    spark = manifest.sparkSession
    parts = sorted(manifest.select("shard", "uri", "tokens").collect())
    starts = np.cumsum([0, *(p["tokens"] for p in parts)])
    rows = [(p["uri"], int(s)) for p, s in zip(parts, starts, strict=False)]
    files = spark.createDataFrame(rows, "uri string, start long").repartition(max(1, len(rows)))
    schema = "doc_id long, start long, n_tokens long" + ", ids_crc32 long" * crc + ", ids array<long>" * token_ids

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = IdFile(uri)
                for lo, hi in slices(len(f), 2048):
                    ids, cuts, tokens = f.documents(lo, hi)
                    own = cuts - cuts[0]
                    wide = tokens.astype("<u4")
                    out = [pa.array(ids), pa.array(cuts[:-1] + start), pa.array(np.diff(cuts))]
                    if crc:
                        out.append(pa.array([zlib.crc32(wide[x:y].tobytes()) for x, y in zip(own[:-1], own[1:], strict=True)], pa.int64()))
                    if token_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(wide.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

    return files.mapInArrow(released(run), schema)


def token_id_files(docs: DataFrame, tokenizer: str, end_id: int, **options) -> tuple[DataFrame, DataFrame]:
    """Write and read back; ``(documents read, manifest)``."""
    manifest = write_ids(docs, fresh_path(docs.sparkSession, "ids"), tokenizer, end_id, **options)
    return read_ids(manifest), manifest
