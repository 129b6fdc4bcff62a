"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each of whole WARC records of about
``frame_bytes`` (a larger record has a frame of its own), and two skippable frames at its end: the
record index, and the seek table of the Zstandard seekable format with its footer. The record index
maps record ids to a frame and to offset and length inside it. Any Zstandard tool can unpack a
bundle; through the index, a record costs one seek and one frame.

Payloads are compared by SHA-1 and length. Of equal payloads of at least ``least_bytes`` the page of
the smallest id is written as a response, the others as revisits of it without their payload.
First pages are found on digests alone; the pages themselves are shuffled once, by digest, where a
digest of very many pages is split by Spark's skew join. Each task streams its pages into a bundle of its own
name in the shared folder; only bundles that a finished task names count.

Defined results: a null payload is written as an empty one; a null url as an empty target; null ids
come after all others and are never revisited unless a payload has only null ids, and then all of
them are responses; rows that repeat the smallest id of a payload are responses too; an empty table
gives no bundle and no record; other columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import pieces
from ripplemap.plans.session import scratch, stored

# The skippable frame and footer of the Zstandard seekable format, and this index.
SKIPPABLE, SEEKABLE, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ENTRY = np.dtype(
    [("id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("length", "<u8")]
)
FRAME_BYTES = 1 << 20
LEVEL = 3
NULL = "null"


def _name(page: int | None) -> str:
    return f"urn:page:{NULL if page is None else page}"


def _page(name: str) -> int | None:
    last = name.strip("<>").rpartition(":")[2]
    return None if last == NULL else int(last)


def record(
    page: int | None, url: str, payload: bytes, digest: str, first: int | None, revisit: bool
) -> bytes:
    """One WARC record; a revisit has no payload, but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_name(page)}>"),
        ("WARC-Date", DATE),
        # A line end in a url would end the field.
        ("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "%20" for c in url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_name(first)}>")]
    fields += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not at a record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start, length = end + 4, int(fields["Content-Length"])
        block = data[start : start + length]
        yield fields, block[block.index(b"\r\n\r\n") + 4 :]
        at = start + length + 4


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Bundle:
    """Writes records; a frame is closed when it is large enough."""

    def __init__(self, out, frame_bytes: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[bytes] = []
        self.size = 0
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple] = []

    def add(self, page: int | None, whole: bytes) -> None:
        if self.waiting and self.size + len(whole) > self.frame_bytes:
            self._close_frame()
        self.index.append((page or 0, page is None, len(self.sizes), self.size, len(whole)))
        self.waiting.append(whole)
        self.size += len(whole)

    def _close_frame(self) -> None:
        if self.waiting:
            frame = self.press.compress(b"".join(self.waiting))
            self.out.write(frame)
            self.sizes.append((len(frame), self.size))
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self._close_frame()
        index = np.array(self.index, ENTRY).tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        # The index is a frame of the seek table too, without content.
        sizes = [*self.sizes, (len(index) + 8, 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes)
        footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class Reader:
    """Random access to a bundle by frame and by record id."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        sizes = np.frombuffer(self.file.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(n, 2)
        self.sizes = sizes[:-1]
        self.offsets = np.cumsum([0, *sizes[:, 0]], dtype=np.int64)
        raw = self.file.read_at(int(sizes[-1, 0]) - 8, int(self.offsets[-2]) + 8)
        self.index = np.frombuffer(raw, ENTRY)
        self.unpress = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        raw = self.file.read_at(int(self.sizes[k, 0]), int(self.offsets[k]))
        return self.unpress.decompress(raw, max_output_size=int(self.sizes[k, 1]))

    def find(self, page: int) -> list[tuple[dict[str, str], bytes]]:
        """The records of one id, each from its frame alone."""
        own = self.index[(self.index["id"] == page) & (self.index["null"] == 0)]
        return [
            next(parse(self.frame(int(e["frame"]))[int(e["offset"]) :][: int(e["length"])]))
            for e in own
        ]


def _write_task(batches, folder: str, frame_bytes: int) -> Iterator[pa.RecordBatch]:
    bundle = name = None
    for batch in pieces(batches, 8 << 20):
        payloads = batch.column("text").cast(pa.binary()).to_pylist()
        others = (batch.column(c).to_pylist() for c in ("key", "url", "first", "several"))
        for payload, page, url, first, several in zip(payloads, *others, strict=True):
            if bundle is None:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.zst"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                bundle = Bundle(out, frame_bytes)
            revisit = bool(several) and first is not None and page != first
            payload = payload or b""
            whole = record(page, url or "", payload, digest_of(payload), first, revisit)
            bundle.add(page, whole)
    if bundle is not None:
        bundle.close()
        columns = [pa.array([f"{folder}/{name}"]), pa.array([len(bundle.index)], pa.int64())]
        yield pa.record_batch(columns, names=["file", "records"])


def write(
    pages: DataFrame,
    folder: str | None = None,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Write the bundles; the manifest has ``file`` and ``records`` of each."""
    folder = folder or scratch(pages.sparkSession, "warc")
    full = F.coalesce("text", F.lit("")).cast("binary")
    own = pages.select(
        pages[key].cast("long").alias("key"), pages[url].alias("url"), pages[payload].alias("text")
    ).withColumn("digest", F.sha1(full))
    firsts = own.where(F.octet_length(full) >= least_bytes).groupBy("digest")
    firsts = firsts.agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("digest", "first", F.lit(True).alias("several"))
    ready = own.join(firsts, "digest", "left").select("key", "url", "text", "first", "several")
    made = ready.mapInArrow(
        lambda batches: _write_task(batches, folder, frame_bytes), "file string, records long"
    )
    return stored(made, "warc_manifest")


def _read_task(batches) -> Iterator[pa.RecordBatch]:
    names = ["key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for uri in batch.column("file").to_pylist():
            reader = Reader(uri)
            for k in range(len(reader.sizes)):
                rows = [
                    (
                        _page(f["WARC-Record-ID"]),
                        f["WARC-Target-URI"],
                        f["WARC-Type"],
                        int(f["X-Payload-Length"]),
                        f["WARC-Payload-Digest"].removeprefix("sha1:"),
                        _page(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None,
                        payload if f["WARC-Type"] == "response" else None,
                    )
                    for f, payload in parse(reader.frame(k))
                ]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds, strict=True)]
                yield pa.record_batch(columns, names=names)


def read(manifest: DataFrame) -> DataFrame:
    """All records of the bundles; the payload of a revisit is null."""
    files = manifest.select("file").repartition(manifest.count() or 1)
    return files.mapInArrow(
        _read_task,
        "key long, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, payload binary",
    )
