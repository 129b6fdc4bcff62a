"""Global running totals over rows in the order of a key, from totals of contiguous ranges.

Ranges are cut by the key and then by ``tie``, a hash of the row's place in the input, so that no key is
too common to be cut, nor any row too often repeated. Only keys are read to cut ranges.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL = -(2**63)


class Bounds(NamedTuple):
    """First keys and ties of all ranges but the first."""

    keys: np.ndarray
    ties: np.ndarray

    @property
    def ranges(self) -> int:
        return len(self.keys) + 1


def tie() -> Column:
    return F.xxhash64(F.monotonically_increasing_id()).alias("tie")


def cuts(rows: DataFrame, rows_per_range: int) -> Bounds:
    """Bounds that cut ``rows`` (columns ``key`` and ``tie``) into ranges of about that many rows.

    Spark samples and deals the two numbers of each row; one row a range comes to the driver.
    """
    n = math.ceil(rows.count() / rows_per_range)
    if n < 2:
        return Bounds(np.zeros(0, np.int64), np.zeros(0, np.int64))
    own = rows.select(F.coalesce("key", F.lit(NULL)).alias("key"), "tie")
    dealt = own.repartitionByRange(n, "key", "tie").groupBy(F.spark_partition_id().alias("part"))
    first = dealt.agg(F.min(F.struct("key", "tie")).alias("f")).select("f.*").collect()
    first = sorted((r["key"], r["tie"]) for r in first)[1:]
    return Bounds(*(np.array([f[k] for f in first], np.int64) for k in (0, 1)))


def range_of(keys: pa.Array, ties: pa.Array, bounds: Bounds) -> np.ndarray:
    """The range of each row; null keys come first."""
    own = keys.fill_null(NULL).to_numpy(zero_copy_only=False)
    low, high = (np.searchsorted(bounds.keys, own, side) for side in ("left", "right"))
    out, tie_of = low.copy(), ties.to_numpy()
    at = np.flatnonzero(high > low)  # rows of a key at which some range begins
    for key in np.unique(own[at]):
        rows = at[own[at] == key]
        a, b = low[rows[0]], high[rows[0]]
        out[rows] = a + np.searchsorted(bounds.ties[a:b], tie_of[rows], "right")
    return out.astype(np.int32)


def in_ranges(rows: DataFrame, bounds: Bounds, *order: str) -> DataFrame:
    """Rows with a column ``part``, one partition a range, each sorted by ``order``."""
    return rows.repartitionById(bounds.ranges, F.col("part")).sortWithinPartitions(*order)


def before(totals: DataFrame, *columns: str) -> dict[int, tuple[int, ...]]:
    """For each ``part``, the sums of ``columns`` over all parts before it; one row a part."""
    sums, out = [0] * len(columns), {}
    for row in totals.orderBy("part").collect():
        out[row["part"]] = tuple(sums)
        sums = [s + (row[c] or 0) for s, c in zip(sums, columns, strict=True)]
    out[-1] = tuple(sums)
    return out
