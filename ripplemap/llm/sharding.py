"""Contiguous shards of near equal bytes, by global prefix sums.

Documents are ordered by id (null ids first; rows of one id by checksum,
and then by a hash of their place in the input). The bytes of
contiguous id ranges are summed; with the sums before each range, a running total inside it gives
every document's place among all bytes. A document goes to the shard in which its middle byte falls
when all bytes are cut at equal targets. So shards are contiguous, and each differs from the target
by at most the size of its largest document.

Defined results: a null text has no bytes and the checksum 0; empty texts and null ids are placed
like others; repeated rows are placed each, in any order among themselves; an empty table gives an
empty result; a shard may be empty where documents are fewer than shards; other columns play no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import texts
from ripplemap.llm.ordered import before, cuts, in_ranges, range_of, tie
from ripplemap.plans.session import stored

ROWS_PER_RANGE = 250_000
OVERHEAD = 8  # bytes that a document counts beside its text


def shards(
    docs: DataFrame,
    n_shards: int,
    key: str = "doc_id",
    text: str = "text",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``key``, ``size``, ``crc`` (of the text), ``shard`` and ``slot`` (its place there)."""
    full = F.coalesce("text", F.lit(""))
    crc = F.crc32(full.cast("binary"))
    slim = texts(docs, key, text).select(
        "key",
        (F.shiftleft(crc, 31) + F.pmod(tie(), F.lit(1 << 31))).alias("tie"),
        (F.octet_length(full) + F.lit(OVERHEAD)).cast("long").alias("size"),
        crc.alias("crc"),
    )
    slim = stored(slim, "sizes")
    bounds = cuts(slim.select("key", "tie"), rows_per_range)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = pa.array(range_of(b.column("key"), b.column("tie"), bounds))
            yield b.append_column("part", part)

    dealt = stored(slim.mapInArrow(deal, "key long, tie long, size long, crc long, part int"), "ranges")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    earlier = before(totals, "bytes", "n")
    total = max(1, earlier[-1][0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = n = None
        for b in batches:
            if not b.num_rows:
                continue
            if at is None:
                at, n = earlier[b.column("part")[0].as_py()]
            size = b.column("size").to_numpy()
            middle = at + np.cumsum(size) - size // 2
            # Whole numbers throughout, also where bytes times shards pass 64 bits.
            targets = np.array([total * k // n_shards for k in range(1, n_shards)], np.int64)
            shard = np.searchsorted(targets, middle, "right")
            index = n + np.arange(b.num_rows)
            at, n = at + int(size.sum()), n + b.num_rows
            yield pa.record_batch(
                [*(b.column(c) for c in ("key", "size", "crc")), pa.array(shard), pa.array(index)],
                names=["key", "size", "crc", "shard", "index"],
            )

    ordered = in_ranges(dealt, bounds, "part", "key", "tie")
    schema = "key long, size long, crc long, shard long, index long"
    placed = stored(ordered.mapInArrow(place, schema), "places")
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "key", "size", "crc", F.col("shard").cast("int").alias("shard"),
        (F.col("index") - F.col("first")).alias("slot"),
    )
