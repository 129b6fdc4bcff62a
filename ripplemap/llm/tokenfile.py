"""Token ids in binary files: a shared Zstandard dictionary, one frame a document, an offset index.

A file holds::

    magic, dictionary length, bytes an id, dictionary
    one Zstandard frame for each document, in order
    index: for each document its key, whether the key is null, its frame's length and its ids
    footer: length of the index, SHA-256 of the dictionary, documents, ids, magic

The dictionary is trained once, on the serialized ids of a bounded sample of documents
(``Dictionary.rows``); it decides on sizes only. Each reader checks its hash. A document is read
through the index: one seek, one frame.

Files are in ascending order of keys, and so are the documents in a file. Each is written by one task
in a stream to the shared folder under a name of its own; only those that a finished task names in
the manifest count, so that lost executors and repeated tasks leave no trace.

Defined results: a null text is encoded as an empty one and has the end id only; null keys come
first; rows of one key follow each other in any order, and may lie in several files; an empty table gives no file and no row; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import bounded_sample, pieces, texts
from ripplemap.llm.encoder import encoder
from ripplemap.llm.ordered import before, cuts, in_ranges, range_of, tie
from ripplemap.plans.session import scratch, stored

MAGIC = b"TOKIDS01"
HEAD = struct.Struct("<8sIB")
FOOT = struct.Struct("<Q32sQQ8s")
ENTRY = np.dtype([("key", "<i8"), ("null", "u1"), ("length", "<u4"), ("ids", "<u4")])
ROWS_PER_FILE = 20_000
LEVEL = 3


def dictionary(docs: DataFrame, definition: str, end: int, rows: int, size: int) -> bytes:
    """A dictionary trained on the ids of at most ``rows`` documents; empty if there are too few."""
    some = bounded_sample(docs, rows).where(F.octet_length("text") < 1 << 16).collect()
    samples = encoder(definition).encode([r["text"] for r in some], end)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b""


def _zdict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _head(trained: bytes, width: int) -> bytes:
    return HEAD.pack(MAGIC, len(trained), width) + trained


def _tail(trained: bytes, entries: np.ndarray) -> bytes:
    raw, digest = entries.tobytes(), hashlib.sha256(trained).digest()
    return raw + FOOT.pack(len(raw), digest, len(entries), int(entries["ids"].sum()), MAGIC)


def write(
    docs: DataFrame,
    tokenizer_file: str,
    end: int,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    rows_per_file: int = ROWS_PER_FILE,
    dictionary_rows: int = 1000,
    dictionary_size: int = 1 << 16,
) -> DataFrame:
    """Write the files; the manifest has ``file``, ``part``, ``documents`` and ``ids`` of each."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token_files")
    own = texts(docs, key, text, tie())
    definition = Path(tokenizer_file).read_text(encoding="utf8")
    trained = dictionary(own, definition, end, dictionary_rows, dictionary_size)
    shared = spark.sparkContext.broadcast((definition, trained))
    bounds = cuts(own.select("key", "tie"), rows_per_file)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, trained = shared.value
        tokens = encoder(definition)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(trained))
        for batch in pieces(batches, 4 << 20):
            raw = tokens.encode([t or "" for t in batch.column("text").to_pylist()], end)
            keys = batch.column("key")
            columns = [
                pa.array(range_of(keys, batch.column("tie"), bounds)),
                keys,
                pa.array([len(r) // tokens.kind.itemsize for r in raw], pa.int64()),
                pa.array(map(press.compress, raw), pa.binary()),
            ]
            yield pa.record_batch(columns, names=["part", "key", "ids", "frame"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, trained = shared.value
        store, root = fs.FileSystem.from_uri(folder)
        out = part = None
        index: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                part = batch.column("part")[0].as_py()
                store.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
                out = store.open_output_stream(f"{root}/{name}")
                out.write(_head(trained, encoder(definition).kind.itemsize))
            frames = batch.column("frame")
            entries = np.zeros(batch.num_rows, ENTRY)
            keys = batch.column("key")
            entries["key"] = keys.fill_null(0).to_numpy(zero_copy_only=False)
            entries["null"] = keys.is_null().to_numpy(zero_copy_only=False)
            entries["ids"] = batch.column("ids").to_numpy()
            whole = frames.to_pylist()
            entries["length"] = [len(f) for f in whole]
            out.write(b"".join(whole))
            index.append(entries)
        if out is not None:
            entries = np.concatenate(index)
            out.write(_tail(trained, entries))
            out.close()
            columns = [[name], [part], [len(entries)], [int(entries["ids"].sum())]]
            yield pa.record_batch(
                [pa.array(columns[0]), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["file", "part", "documents", "ids"],
            )

    frames = own.mapInArrow(encode, "part int, key long, ids long, frame binary")
    done = in_ranges(frames, bounds, "part", "key", "ids", "frame").mapInArrow(
        put, "file string, part long, documents long, ids long"
    )
    return stored(done, "token_manifest").withColumn(
        "file", F.concat(F.lit(f"{folder}/"), F.col("file"))
    )


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        magic, length, width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        trained = self.file.read_at(length, HEAD.size)
        n, digest, documents, self.total, end = FOOT.unpack(
            self.file.read_at(FOOT.size, size - FOOT.size)
        )
        if magic != MAGIC or end != MAGIC or hashlib.sha256(trained).digest() != digest:
            raise ValueError(f"{uri} is damaged")
        self.index = np.frombuffer(self.file.read_at(n, size - FOOT.size - n), ENTRY)
        self.kind = np.dtype(f"<u{width}")
        self.offsets = HEAD.size + length + np.cumsum([0, *self.index["length"]], dtype=np.int64)
        self.unpress = zstandard.ZstdDecompressor(dict_data=_zdict(trained))
        self.first = 0
        assert documents == len(self.index)

    def document(self, place: int) -> np.ndarray:
        """Ids of the document at that place, from its own frame alone."""
        frame = self.file.read_at(int(self.index["length"][place]), int(self.offsets[place]))
        return np.frombuffer(self.unpress.decompress(frame), self.kind)

    def documents(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Ids of neighbouring documents, from one read."""
        low = int(self.offsets[start])
        block = memoryview(self.file.read_at(int(self.offsets[stop]) - low, low))
        for a, b in zip(self.offsets[start:stop] - low, self.offsets[start + 1 : stop + 1] - low):
            yield np.frombuffer(self.unpress.decompress(block[a:b]), self.kind)


def read(manifest: DataFrame, block: int = 1000) -> DataFrame:
    """``key``, ``start`` (ids of all documents before it), ``n_tokens`` and ``crc`` (of the ids as
    32-bit numbers) of each document, from the files."""
    starts = {p: s for p, (s,) in before(manifest, "ids").items()}  # one number a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, part in zip(*(batch.column(c).to_pylist() for c in ("file", "part")), strict=True):
                file, start = TokenFile(uri), starts[part]
                for low in range(0, len(file.index), block):
                    high = min(low + block, len(file.index))
                    own = file.index[low:high]
                    ids = [x.astype("<u4") for x in file.documents(low, high)]
                    n = np.array([len(x) for x in ids], np.int64)
                    yield pa.record_batch(
                        [
                            pa.array(own["key"], mask=own["null"].astype(bool)),
                            pa.array(start + np.cumsum(n) - n),
                            pa.array(n),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        ],
                        names=["key", "start", "n_tokens", "crc"],
                    )
                    start += int(n.sum())

    files = manifest.select("file", "part").repartition(manifest.count() or 1)
    return files.mapInArrow(run, "key long, start long, n_tokens long, crc long")
