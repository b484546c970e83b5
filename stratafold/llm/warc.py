"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames of about ``FRAME_BYTES`` of records each, a skippable frame that maps record
identifiers to (frame, offset in the frame, length), and the seek table of the public seekable format in a last skippable frame. One record is
read by its bundle's footer, its index entry and a single frame. Any Zstandard reader sees the plain WARC stream.

Bundles are rows of a table in the shared folder, so that Spark's commit protocol decides which attempt of a task counts; ``export`` writes
them as files. Equal payloads are found by length and SHA-1: the smallest page id of a digest is a partial aggregate, and the verdicts are joined
back by page id, so that a payload that a third of all pages share meets in no task.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import batch, settle, sized

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Magic numbers of the Zstandard seekable format and the revisit profile of WARC 1.1.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BundleWriter:
    """Gathers records into frames; ``close`` gives the bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.frame, self.sizes, self.index = io.BytesIO(), bytearray(), [], []

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id, len(self.sizes), len(self.frame), len(record)))
        self.frame += record
        if len(self.frame) >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.frame:
            packed = self.compressor.compress(bytes(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.frame.clear()

    def size(self) -> int:
        return self.out.tell() + len(self.frame)

    def close(self) -> bytes:
        self._flush()
        index = self.compressor.compress(json.dumps(self.index, separators=(",", ":")).encode())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        sizes = [*self.sizes, (8 + len(index), 0)]
        table = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        return self.out.getvalue()


class Bundle:
    """Random access to a bundle: ``content`` is sliced, never decompressed as a whole."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        frames, flags, magic = struct.unpack("<IBI", self.content[-9:])
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        width = 12 if flags & 0x80 else 8
        table = self.content[-9 - frames * width : -9]
        self.frames, at = [], 0
        for k in range(frames):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, plain))
            at += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return self.decompressor.decompress(self.content[at : at + packed], max_output_size=plain)

    def index(self) -> list[tuple[str, int, int, int]]:
        at, packed, _ = self.frames[-1]
        return json.loads(self.decompressor.decompress(self.content[at + 8 : at + packed]))

    def record(self, record_id: str) -> bytes:
        """One record, from one frame."""
        _, k, at, size = next(x for x in self.index() if x[0] == record_id)
        return self.frame(k)[at : at + size]


def _name(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def record(page: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A WARC 1.1 record of an HTTP response, or of a revisit to ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(page)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_name(refers_to)}>"] if revisit else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(frame: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP head, payload) of the records in a frame."""
    at = 0
    while at < len(frame):
        body = frame.index(b"\r\n\r\n", at) + 4
        headers = dict(x.split(": ", 1) for x in frame[at : body - 4].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        http = frame.index(b"\r\n\r\n", body) + 4
        yield headers, frame[body:http], frame[http : body + size]
        at = body + size + 4


def _write(batches: Iterator[pa.RecordBatch], frame_bytes: int, bundle_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema([("bundle", pa.string()), ("records", pa.int64()), ("content", pa.binary())])
    writer, k = BundleWriter(frame_bytes), 0

    def close() -> pa.RecordBatch:
        return batch({"bundle": [f"{TaskContext.get().partitionId():06d}-{k:05d}"], "records": [len(writer.index)], "content": [writer.close()]}, schema)

    for b in sized(batches, "html"):
        for page, url, html, digest, first, revisit in zip(*(b[n].to_pylist() for n in ("page_id", "url", "html", "digest", "first", "revisit")), strict=True):
            payload = html.encode()
            code = base64.b32encode(bytes.fromhex(digest)).decode()
            writer.add(_name(page), record(page, url, payload, code, len(payload), first, revisit))
            if writer.size() >= bundle_bytes:
                yield close()
                writer, k = BundleWriter(frame_bytes), k + 1
    if writer.index:
        yield close()


def write(pages: DataFrame, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(bundle, records, content): the archives of ``pages`` (page_id, url, html), in the shared folder.

    Among records of equal payloads of ``min_bytes`` or more that with the smallest page id is a response and the others revisit it; smaller
    ones are responses. A null html is the empty payload. Rows that repeat the response's page id and payload are responses too. A null page id
    is larger than all others.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    keys = rows.select("page_id", "digest", "size").distinct()
    firsts = keys.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"))
    verdicts = keys.join(firsts, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    joined = rows.join(verdicts.withColumn("revisit", F.lit(True)), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    # a revisit needs no payload
    thin = joined.select("page_id", "url", "html", "digest", "first", F.coalesce("revisit", F.lit(False)).alias("revisit"))
    return settle(thin.mapInArrow(partial(_write, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes), "bundle string, records long, content binary"), "warc")


_OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _page(urn: str | None) -> int | None:
    return int(x) if urn and (x := urn.strip("<>").rpartition(":")[2]) else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b["content"]:
            bundle, rows = Bundle(content.as_py()), []
            for k in range(len(bundle.frames) - 1):
                for headers, http, payload in records(bundle.frame(k)):
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"record {headers['WARC-Record-ID']} does not match its digest")
                    rows.append((_page(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To"))))
            yield batch(dict(zip(_OUT.names, zip(*rows, strict=True), strict=True)), _OUT)


def read(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in ``bundles``; a response's payload is held against its digest."""
    return bundles.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _save(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    os.makedirs(folder, exist_ok=True)
    for b in batches:
        for name, content in zip(b["bundle"].to_pylist(), b["content"].to_pylist(), strict=True):
            path = f"{folder}/{name}.warc.zst"
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(content)
            os.replace(f.name, path)
            yield pa.record_batch({"path": [path]})


def export(bundles: DataFrame, folder: str) -> list[str]:
    """Write bundles as .warc.zst files to ``folder``, which must be mounted on every executor; a repeated task writes the same file again."""
    return [r["path"] for r in bundles.mapInArrow(partial(_save, folder=folder), "path string").toLocalIterator()]
