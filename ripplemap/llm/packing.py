"""Packing of tokenised documents into sequences of one length: shortest pack first.

Documents are cut into whole sequences and a rest; equal lengths are equal, so that a histogram of at
most ``length`` numbers describes them all. ``Plan`` works on that histogram alone: lengths are placed
longest first, each copy into the shortest pack so far, for all packs of one fill at once. Packs that
were filled alike are a run of numbers with a count, a packing pattern; a placement says which ranks
of a length went to which run. What room is left is closed by taking the emptiest packs apart: their
pieces are laid end to end, cut where needed, over the gaps of the others, and the last few ids go
to sequences whose lengths are powers of two. So only a few documents are cut, and nothing is padded.

A piece finds its place by its rank among the pieces of its length: the count of that length in
earlier tasks, from one row a task and length, plus its number in its own task. The plan is the only
thing that is broadcast; its size depends on ``length``, not on the documents.

Defined results: a null text is an empty one, which has the end id only; null keys are kept; repeated
rows are documents of their own; an empty table gives no piece; other columns play no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemap.llm.common import pieces, texts
from ripplemap.llm.encoder import encoder
from ripplemap.plans.session import stored

# Cut documents are sent to all tasks up to this many (about 50 MB), else joined by a shuffle.
SENT_ROWS = 1_000_000


class Packed(NamedTuple):
    """``pieces``: part, row, key, start, length, doc_tokens, crc, sequence_id, offset.
    ``coded``: part, row, ids (serialized)."""

    pieces: DataFrame
    coded: DataFrame
    kind: np.dtype


class Plan:
    """Where each rank of each length goes; made from counts by length."""

    def __init__(self, counts: dict[int, int], length: int):
        self.length = length
        self.packs = 0
        self.runs: dict[int, list[tuple[int, int]]] = {}  # by fill: first pack, packs
        self.fills: list[int] = []
        self.made: list[tuple[int, int, int, int, int]] = []
        self.of_length: dict[int, tuple[int, int]] = {}
        for own in sorted(counts, reverse=True):
            begin = len(self.made)
            self._place(own, counts[own])
            self.of_length[own] = begin, len(self.made)
        # Columns: first rank, copies a pack, first pack, offset.
        self.table = np.array(self.made, np.int64).reshape(-1, 5)
        self._close_gaps()

    def _add(self, fill: int, first: int, packs: int) -> None:
        if not packs:
            return
        if fill not in self.runs:
            self.runs[fill] = []
            heapq.heappush(self.fills, fill)
        own = self.runs[fill]
        if own and sum(own[-1]) == first:
            first, packs = own[-1][0], own.pop()[1] + packs
        own.append((first, packs))

    def _put(self, rank: int, own: int, copies: int, first: int, packs: int, fill: int) -> int:
        """Place so many copies on each of these packs; the next rank."""
        if packs:
            self.made.append((rank, copies, first, fill, packs))
            self._add(fill + copies * own, first, packs)
        return rank + copies * packs

    def _place(self, own: int, count: int) -> None:
        rank = 0
        while rank < count:
            if not self.fills or self.fills[0] + own > self.length:
                each = self.length // own
                for copies, packs in ((each, (count - rank) // each), ((count - rank) % each, 1)):
                    if copies and packs:
                        first, self.packs = self.packs, self.packs + packs
                        rank = self._put(rank, own, copies, first, packs, 0)
                return
            fill = heapq.heappop(self.fills)
            runs = self.runs.pop(fill)
            packs = sum(n for _, n in runs)
            # As many rounds as end before another fill becomes the shortest.
            following = self.fills[0] if self.fills else self.length
            rounds = min(max(1, -(-(following - fill) // own)), (self.length - fill) // own)
            rounds, more = min(rounds, (count - rank) // packs), 0
            if not rounds:
                rounds, more = 0, count - rank
            for first, n in runs:
                if rounds:
                    rank = self._put(rank, own, rounds, first, n, fill)
                else:
                    some = min(more, n)
                    rank = self._put(rank, own, 1, first, some, fill)
                    self._add(fill, first + some, n - some)
                    more -= some

    def _close_gaps(self) -> None:
        room = sum(n * (self.length - fill) for fill, runs in self.runs.items() for _, n in runs)
        apart = -(-room // self.length)  # a pack taken apart gives its ids and needs no filling
        loose, kept = [], []
        for fill in sorted(self.runs):
            for first, n in self.runs[fill]:
                some = min(apart, n)
                apart -= some
                loose += [(first, some, fill)] * (some > 0)
                if n > some and fill < self.length:
                    kept.append((first + some, n - some, fill))
        loose.sort()
        self.loose = np.array(loose, np.int64).reshape(-1, 3)
        self.loose_base = np.concatenate([[0], np.cumsum(self.loose[:, 1] * self.loose[:, 2])])
        self.fewer = np.concatenate([[0], np.cumsum(self.loose[:, 1])])
        number = self.packs - int(self.fewer[-1])
        gaps = [(self.number(first), n, fill, self.length - fill) for first, n, fill in kept]
        left = int(self.loose_base[-1]) - sum(n * size for _, n, _, size in gaps)
        for power in range(left.bit_length() - 1, -1, -1):
            if left >> power & 1:
                gaps.append((number, 1, 0, 1 << power))
                number += 1
        self.sequences = number
        self.gaps = np.array(gaps, np.int64).reshape(-1, 4)
        self.gap_base = np.concatenate([[0], np.cumsum(self.gaps[:, 1] * self.gaps[:, 3])])

    def number(self, pack):
        """The sequence of a pack that is kept."""
        return pack - self.fewer[np.searchsorted(self.loose[:, 0], pack, "right")]

    def place(self, own: int, rank: int) -> list[tuple[int, int, int]]:
        """``length``, ``sequence`` and ``offset`` of each part of the piece of that rank."""
        begin, end = self.of_length[own]
        at = begin + int(np.searchsorted(self.table[begin:end, 0], rank, "right")) - 1
        first_rank, copies, first, fill, _ = self.table[at].tolist()
        nth, copy = divmod(rank - first_rank, copies)
        pack, offset = first + nth, fill + copy * own
        run = int(np.searchsorted(self.loose[:, 0], pack, "right")) - 1
        if run < 0 or pack >= self.loose[run, 0] + self.loose[run, 1]:
            return [(own, int(self.number(pack)), offset)]
        low, _, size = self.loose[run].tolist()
        at, out = int(self.loose_base[run]) + (pack - low) * size + offset, []
        while own:
            gap = int(np.searchsorted(self.gap_base, at, "right")) - 1
            first, _, fill, size = self.gaps[gap].tolist()
            nth, used = divmod(at - int(self.gap_base[gap]), size)
            some = min(own, size - used)
            out.append((some, first + nth, fill + used))
            at, own = at + some, own - some
        return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


PIECES = "array<struct<start: long, length: long, nth: long, crc: long>>"


def coded(docs: DataFrame, definition: str, end: int, length: int) -> DataFrame:
    """One row a document: its ids, and pieces of at most ``length`` with their number among those
    of equal length in this task."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "nth", "crc")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, row = encoder(shared.value), TaskContext.get().partitionId(), 0
        seen = np.zeros(length + 1, np.int64)
        for batch in pieces(batches, 4 << 20):
            raw = tokens.encode([t or "" for t in batch.column("text").to_pylist()], end)
            starts, lengths, nths, crcs, ends, sizes = [], [], [], [], [0], []
            for own in raw:
                ids = np.frombuffer(own, tokens.kind)
                sizes.append(len(ids))
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    starts.append(start)
                    lengths.append(len(piece))
                    nths.append(int(seen[len(piece)]))
                    crcs.append(_crc(piece))
                    seen[len(piece)] += 1
                ends.append(len(starts))
            inner = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (starts, lengths, nths, crcs)],
                ["start", "length", "nth", "crc"],
            )
            columns = [
                pa.array(np.full(len(raw), part, np.int32)),
                pa.array(np.arange(row, row + len(raw))),
                batch.column("key"),
                pa.array(sizes, pa.int64()),
                pa.array(raw, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner).cast(kinds),
            ]
            row += len(raw)
            yield pa.record_batch(columns, names=["part", "row", "key", "doc_tokens", "ids", "pieces"])

    schema = f"part int, row long, key long, doc_tokens long, ids binary, pieces {PIECES}"
    return docs.mapInArrow(run, schema)


def ranked(cut: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The pieces with ``rank`` among all of their length, and the histogram of lengths."""
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    counts = stored(counts, "lengths_by_task")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    with_rank = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return with_rank, histogram


def _placed(pieces_: DataFrame, plan: Plan) -> DataFrame:
    shared = pieces_.sparkSession.sparkContext.broadcast(plan)
    kept = ["part", "row", "key", "doc_tokens", "start", "length", "crc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            rows = batch.select([*kept, "rank"]).to_pydict()
            out = {c: [] for c in [*kept, "sequence_id", "offset"]}
            for part, row, key, total, start, own, crc, rank in zip(*rows.values(), strict=True):
                places = plan.place(own, rank)
                for size, sequence, offset in places:
                    whole = crc if len(places) == 1 else None
                    values = (part, row, key, total, start, size, whole, sequence, offset)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                    start += size
            yield pa.record_batch(
                [pa.array(v, pa.int32() if c == "part" else pa.int64()) for c, v in out.items()],
                names=list(out),
            )

    return pieces_.select(*kept, "rank").mapInArrow(
        run,
        "part int, row long, key long, doc_tokens long, start long, length long, crc long, "
        "sequence_id long, offset long",
    )


def _with_crc(cut: DataFrame, ids: DataFrame, kind: np.dtype) -> DataFrame:
    """Pieces that the plan cut, with the checksum of their own ids."""
    lists = cut.groupBy("part", "row").agg(F.collect_list(F.struct(*cut.columns)).alias("own"))
    lists = stored(lists, "cut_documents")  # a document has one rest, cut into few pieces
    small = lists.count() <= SENT_ROWS
    joined = ids.join(F.broadcast(lists) if small else lists, ["part", "row"]).select(
        F.explode("own").alias("p"), "ids"
    )
    names, width = cut.columns, kind.itemsize
    part_of = F.expr(f"substring(ids, cast(p.start * {width} + 1 as int), cast(p.length * {width} as int))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [_crc(np.frombuffer(x, kind)) for x in batch.column("ids").to_pylist()]
            at = batch.schema.get_field_index("crc")
            full = batch.set_column(at, "crc", pa.array(crcs, pa.int64()))
            yield full.select(names)

    flat = joined.select("p.*", part_of.alias("ids"))
    return flat.mapInArrow(run, cut.schema)


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    end: int,
    length: int = 2048,
    key: str = "doc_id",
    text: str = "text",
) -> Packed:
    """Every id of every document, and then ``end``, in exactly one place of a sequence."""
    definition = Path(tokenizer_file).read_text(encoding="utf8")
    kind = encoder(definition).kind
    made = stored(coded(texts(docs, key, text), definition, end, length), "token_ids")
    cut = made.select("part", "row", "key", "doc_tokens", F.inline("pieces"))
    with_rank, histogram = ranked(cut)
    placed = stored(_placed(with_rank, Plan(histogram, length)), "packed_pieces")
    whole = placed.where(F.col("crc").isNotNull())
    ids = made.select("part", "row", "ids")
    some = _with_crc(placed.where(F.col("crc").isNull()), ids, kind)
    return Packed(whole.unionByName(some), ids, kind)


def sequences(packed: Packed) -> DataFrame:
    """``sequence_id``, ``ids`` and ``starts`` (where documents or parts of them begin) of each
    sequence; a group has at most one sequence's ids."""
    kind, width = packed.kind, packed.kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("own").to_pylist():
                own.sort(key=lambda p: p["offset"])
                out.append((
                    np.frombuffer(b"".join(p["ids"] for p in own), kind).astype(np.int32).tolist(),
                    [p["offset"] for p in own],
                ))
            columns = [batch.column("sequence_id")]
            columns += [pa.array([x[k] for x in out], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.int64()))]
            yield pa.record_batch(columns, names=["sequence_id", "ids", "starts"])

    own = F.expr(f"substring(ids, cast(start * {width} + 1 as int), cast(length * {width} as int))")
    rows = packed.pieces.join(packed.coded, ["part", "row"]).select(
        "sequence_id", F.struct("offset", own.alias("ids")).alias("p")
    )
    grouped = rows.groupBy("sequence_id").agg(F.collect_list("p").alias("own"))
    return grouped.mapInArrow(run, "sequence_id long, ids array<int>, starts array<long>")
