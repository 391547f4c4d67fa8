"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of some whole records, followed by the
seek table of the seekable format: a skippable frame with every frame's compressed and plain
size.  An index maps each record to its bundle, frame and offset in the frame, so one record
costs one ranged read and the decompression of one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, Scratch, Slice, parts, ship, write_bytes

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "bundle string, page_id long, frame int, at int"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str, place: str) -> str:
    """An id from a record's content and its place in the archive, so rows that repeat or have no page_id differ too."""
    return f"<{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{digest}|{place}'.encode()).digest()[:16], version=5).urn}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str) -> bytes:
    """One record: a response with its payload, or a revisit that names the response by its page and payload digest."""
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, place)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]-._~")))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    head.append(("WARC-Payload-Length", str(len(payload))))
    if refers_to is not None:
        head += [("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = HTTP + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record starts)."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    return head, data[start : start + size], start + size + 4


def bundle_bytes(frames: list[tuple[bytes, int]]) -> bytes:
    """Compressed frames (with their plain sizes) and the seek table."""
    table = b"".join(struct.pack("<II", len(z), n) for z, n in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(z for z, _ in frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(file: Slice) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame."""
    count, _, magic = struct.unpack("<IBI", file.read(file.size - 9, 9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    rows, at, out = file.read(file.size - 9 - 8 * count, 8 * count), 0, []
    for k in range(count):
        size, plain = struct.unpack_from("<II", rows, 8 * k)
        out.append((at, size, plain))
        at += size
    return out


def read_record(bundle: str, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    file = Slice(bundle)
    try:
        offset, size, plain = seek_table(file)[frame]
        head, block, _ = parse_record(zstandard.decompress(file.read(offset, size), max_output_size=plain), at)
        return head, block
    finally:
        file.close()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Write a record for each row to bundles in ``folder``; returns the index (bundle, page_id, frame, at).

    Payload: the text in UTF-8, nothing for null.  Of rows with equal payloads of ``least`` bytes
    or more the one with the smallest id becomes a response, the others revisits of it; rows that
    repeat that smallest id are responses too, and where all ids are null all are responses.
    A very long payload makes a frame of its own size.  Other columns are ignored, whatever their
    names; an empty table writes no bundle.  Tasks write under names that
    depend on partition and position only, by rename, so a retried task replaces its own files.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "warc-digests")
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first")
    groups = scratch.write(groups, "groups")
    found = groups.count()
    if found <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(groups), "digest", "left")
    else:
        # rows that can't match, short and null ones with few digests among them, stay where they are
        short = F.octet_length("payload") < least
        rows = rows.where(~short).join(groups, "digest", "left").unionByName(rows.where(short).withColumn("first", F.lit(None).cast("long")))
    rows = rows.select("page_id", "url", "payload", "digest", F.when((F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=3)
        bundle, frames, frame, index, size, n = f"{folder}/part-{part:06d}-0.warc.zst", [], bytearray(), [], 0, 0

        def close() -> pa.RecordBatch:
            write_bytes(bundle, bundle_bytes(frames))
            out = pa.RecordBatch.from_arrays([pa.array([bundle] * len(index)), pa.array([x[0] for x in index], pa.int64()), pa.array([x[1] for x in index], pa.int32()), pa.array([x[2] for x in index], pa.int32())], ["bundle", "page_id", "frame", "at"])
            frames.clear()
            index.clear()
            return out

        def cut() -> int:
            z = pack.compress(bytes(frame))
            frames.append((z, len(frame)))
            frame.clear()
            return len(z)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, data, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                index.append((page_id, len(frames), len(frame)))
                frame += record_bytes(page_id, url, data, digest, refers_to, f"{part}/{n}/{len(frames)}/{len(frame)}")
                if len(frame) >= FRAME_BYTES:
                    size += cut()
                if size >= BUNDLE_BYTES:
                    yield close()
                    n, size = n + 1, 0
                    bundle = f"{folder}/part-{part:06d}-{n}.warc.zst"
        if frame:
            cut()
        if frames:
            yield close()

    return rows.mapInArrow(write, INDEX)


def read_warc(bundles: DataFrame) -> DataFrame:
    """The records of the bundles named in column ``bundle``, checked against their digests."""
    ship(bundles.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                file = Slice(bundle)
                for offset, size, plain in seek_table(file):
                    data, at, rows = zstandard.decompress(file.read(offset, size), max_output_size=plain), 0, []
                    while at < len(data):
                        head, block, at = parse_record(data, at)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        length = int(head["WARC-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            content = block[block.index(b"\r\n\r\n") + 4 :]
                            if len(content) != length or hashlib.sha256(content).hexdigest() != digest:
                                raise ValueError(f"{bundle}: {head['WARC-Record-ID']} is damaged")
                        rows.append((None if page is None else int(page), length, digest, head["WARC-Type"], None if refers is None else int(refers)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                file.close()

    spread = bundles.select("bundle").distinct()
    return spread.repartition(parts(bundles.sparkSession)).mapInArrow(read, RECORD)


#: What the archives give back, over ``pages``.
SQL = """
WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN MIN(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
