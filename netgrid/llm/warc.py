"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of the page id, so a shard holds the same
records on every run. A shard's files roll at a compressed size; each record is
a gzip member of its own with regenerated headers and digests. A file is
written under a temporary name and renamed when whole; the manifest is written
when all shards are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.llm.files import committed, opened
from netgrid.llm.memory import released, small_batches
from netgrid.llm.shards import dealt, range_bounds
from netgrid.plans.storage import fresh_path, materialise

DATE = "2024-01-01T00:00:00Z"  # a fixed date keeps the files equal from run to run
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Up to so many revisits are sent to every task, so that payloads are moved once only; beyond that they are joined by a shuffle.
MOST_SENT = 200_000


def warc_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def safe(value: str) -> str:
    """A header value without line breaks."""
    return re.sub(r"[\r\n\x00]+", " ", value)


def record(page_id: int, url: str, payload: bytes, sha1_hex: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the headers of its response and leaves the payload out."""
    http = HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", record_id(f"page:{page_id}:{sha1_hex}")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", safe(url)),
        ("WARC-Page-ID", str(page_id)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()),
        ("WARC-Block-Digest", warc_sha1(block)),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        head += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(f"page:{refers_to}:{sha1_hex}")),
            ("WARC-Refers-To-Page-ID", str(refers_to)),
            ("WARC-Refers-To-Target-URI", safe(refers_url or "")),
            ("WARC-Refers-To-Date", DATE),
        ]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name, so equal data give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest, z, out = b"", None, []
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            if z is not None:
                raise ValueError("the archive ends within a record")
            return
        z = z or zlib.decompressobj(31)
        out.append(z.decompress(data))
        if z.eof:
            yield b"".join(out)
            rest, z, out = z.unused_data, None, []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record, with its digests checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    if "warc-block-digest" in h and warc_sha1(block) != h["warc-block-digest"]:
        raise ValueError(f"block digest of {h['warc-record-id']} differs")
    if h["warc-type"] == "response" and warc_sha1(block.partition(b"\r\n\r\n")[2]) != h["warc-payload-digest"]:
        raise ValueError(f"payload digest of {h['warc-record-id']} differs")
    return h, block


def with_revisits(pages: DataFrame, least: int, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, html, sha1, size, ref_id, ref_url)``: ref_* name the response that a revisit repeats, else null.

    Among equal payloads of at least ``least`` bytes the largest page id is the
    response. A repeated row of that id (equal id and payload) stays a response.
    """
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).where("page_id is not null")
    raw = F.encode("html", "utf-8")
    p = p.withColumns({"size": F.octet_length("html").cast("long"), "sha1": F.sha1(raw)})
    groups = (
        p.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("ref")).where("n > 1")
    )
    refs = groups.select("sha1", "size", F.col("ref.page_id").alias("ref_id"), F.col("ref.url").alias("ref_url"))
    # only ids and digests are joined; the payloads are not moved for it
    other = p.where(F.col("size") >= least).select("page_id", "sha1", "size").join(refs, ["sha1", "size"]).where("page_id <> ref_id")
    other = materialise(other.dropDuplicates(["page_id", "sha1"]).select("page_id", "sha1", "ref_id", "ref_url"), "revisits")
    if other.count() <= MOST_SENT:
        other = F.broadcast(other)
    return p.join(other, ["page_id", "sha1"], "left")


def write_warc(
    pages: DataFrame, folder: str, least: int = 1000, roll_bytes: int = 64 << 20, shard_bytes: float = 16e6, level: int = 6, **columns
) -> DataFrame:
    """Write a record for every page with an id, in page-id order; returns the manifest ``(shard, uri, records, bytes)``.

    Null html is an empty payload; null url an empty target. Rows with equal ids
    are all written, in order of digest and url. Extra columns are ignored. No
    pages: an empty manifest and no file.
    """
    small_batches(pages.sparkSession)
    src = with_revisits(pages, least, **columns)
    key = columns.get("id_col", "page_id")
    bounds, _ = range_bounds(pages, key, F.coalesce(F.octet_length(columns.get("html_col", "html")), F.lit(0)) + 200, shard_bytes)
    rows = dealt(src, "page_id", bounds, ["page_id", "sha1", "url"])

    def run(batches):
        made, now = [], None

        def start(shard, part):
            uri = f"{folder}/shard-{shard:06d}-{part:05d}.warc.gz"
            context = committed(uri)
            n = {"shard": shard, "part": part, "uri": uri, "context": context, "out": context.__enter__(), "records": 0, "bytes": 0}
            info = f"software: netgrid\r\nformat: WARC/1.1\r\nshard: {shard}\r\npart: {part}\r\n".encode()
            head = (
                f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(f'info:{shard}:{part}')}\r\nWARC-Date: {DATE}\r\n"
                f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            )
            put(n, head.encode() + info + b"\r\n\r\n")
            return n

        def put(n, data):
            z = member(data, level)
            n["out"].write(z)
            n["bytes"] += len(z)

        def stop(n):
            n["context"].__exit__(None, None, None)
            made.append((n["shard"], n["uri"], n["records"], n["bytes"]))

        for b in batches:
            for page_id, url, html, sha1, ref_id, ref_url, shard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now["shard"] != shard or now["bytes"] >= roll_bytes:
                    part = now["part"] + 1 if now and now["shard"] == shard else 0
                    if now:
                        stop(now)
                    now = start(shard, part)
                put(now, record(page_id, url, html.encode("utf-8", "surrogatepass"), sha1, ref_id, ref_url))
                now["records"] += 1
        if now:
            stop(now)
        if made:
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names=["shard", "uri", "records", "bytes"])

    ordered = rows.select("page_id", "url", "html", "sha1", "ref_id", "ref_url", "shard")
    return materialise(ordered.mapInArrow(released(run), "shard int, uri string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])`` of the archives listed, digests checked."""
    uris = manifest.select("uri").repartition(max(1, manifest.count()), "uri")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                with opened(uri) as f:
                    for data in members(f):
                        h, block = parse(data)
                        if h["warc-type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        refers = h.get("warc-refers-to-page-id")
                        own = (block.partition(b"\r\n\r\n")[2],) if payload else ()
                        rows.append((int(h["warc-page-id"]), h["warc-target-uri"], int(h["warc-payload-length"]), digest, h["warc-type"], refers and int(refers), *own))
                        if len(rows) == 1000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    return uris.mapInArrow(released(run), schema)


def warc_round_trip(pages: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Write and read back; ``(records, manifest)``."""
    manifest = write_warc(pages, fresh_path(pages.sparkSession, "warc"), **options)
    return read_warc(manifest), manifest
