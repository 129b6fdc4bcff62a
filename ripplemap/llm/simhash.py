"""SimHash near-duplicates through vantage-point trees.

1. Fingerprints: one bit vector of 64 bits a document, from its whole text.
2. Shards: a tree of vantage points is fitted to a bounded sample of the different fingerprints. It
   halves them again and again: those within a node's radius of its vantage point, and the others.
   Every fingerprint has its home in one leaf, a shard of about a million. A fingerprint within ``max_bits`` of a border
   on the inner side is also sent to the outer side as a guest, so that each pair of close
   fingerprints meets in the shard of one of them. The triangle inequality makes this exact for any
   tree, so the sample decides on balance only.
3. Search: each shard builds its own tree over its homes and looks up homes and guests, following a
   branch only if the triangle bounds allow a match there. What it finds is reduced at once to a
   forest of links, no more than one a fingerprint; equal texts never meet as pairs.
4. Components: the links of all shards are contracted as a Spark job by alternating stars.

Defined results: a null or empty text has the fingerprint zero and links like any other; rows that
share a fingerprint are one group; null ids never name a group that has another id, and a group of
null ids alone is named null; repeated rows are returned each; an empty table gives an empty result;
other columns play no part, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import pieces, texts
from ripplemap.plans.session import stored

BITS = 64
SEED = 42
SHARD_SIZE = 1 << 20
# Below that size, shards are made for the sake of more tasks only, and no more than this many.
EARLY_SIZE, EARLY_SHARDS = 32_768, 8
SAMPLE, SAMPLE_OF_NODE = 20_000, 64
# Marked rows are looked up in a bitmap of so many 64-bit cells, which every task gets.
CELLS = 1 << 18
LEAF = 128
BLOCK = 1 << 20


# Fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: bytes, width: int) -> int:
    """Majority of the bits of the hashes of all ``width``-word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and the same white space as GAP
    if not words:
        return 0
    windows = zip(*(itertools.islice(words, k, None) for k in range(min(width, len(words)))))
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, windows), itertools.repeat(SEED))
    counts, total = np.zeros(BITS, np.int64), 0
    while part := list(itertools.islice(hashes, 1 << 16)):
        bits = np.unpackbits(
            np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, more: dict = {}
) -> DataFrame:
    """``key``, ``fp`` (the fingerprint's bits as a signed long) and ``more`` longs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 16 << 20):
            whole = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", width) for t in whole), np.uint64, len(whole))
            kept = [batch.column(c) for c in ("key", *more)]
            yield pa.record_batch([*kept, pa.array(fps.view(np.int64))], names=["key", *more, "fp"])

    own = texts(docs, key, text, *(c.alias(name) for name, c in more.items()))
    more = tuple(more)
    return own.mapInArrow(run, ", ".join(f"{c} long" for c in ("key", *more, "fp")))


# Vantage-point tree ---------------------------------------------------------------------------


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(own: np.ndarray, reach: int, rng) -> tuple[np.uint64, int]:
    """Of some points and radii near the median, those with the fewest fingerprints at the border."""
    best = None
    for point in own[rng.integers(len(own), size=8)]:
        d = np.sort(distance(own, point).astype(np.int64))
        low, high = d[int(0.4 * len(d))], d[int(0.6 * len(d))]
        for radius in range(int(low), int(high) + 1):
            border = np.searchsorted(d, [radius - reach, radius + reach], "right")
            uneven = abs(2 * np.searchsorted(d, radius, "right") / len(d) - 1)
            cost = (border[1] - border[0]) / len(d) + uneven / 4
            if best is None or cost < best[0]:
                best = cost, point, radius
    return best[1:]


def fit_tree(
    sample: np.ndarray, depth: int, reach: int = 3, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete tree; node k has the children 2k+1 and 2k+2."""
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 2**63, 2**depth - 1, np.uint64)
    radii = np.full(2**depth - 1, BITS // 2, np.int64)
    members = {0: sample}
    for node in range(len(points)):
        own = members.pop(node, sample[:0])
        if len(own):
            points[node], radii[node] = _split(own, reach, rng)
            inner = distance(own, points[node]) <= radii[node]
            members[2 * node + 1], members[2 * node + 2] = own[inner], own[~inner]
    return points, radii


def sides(d: np.ndarray, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether points within ``reach`` can lie inside a radius, and whether they can outside."""
    return d - reach <= radius, d + reach > radius


def route(fps: np.ndarray, tree, reach: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """``(shard, places in fps, home)`` for every shard that each fingerprint goes to."""
    points, radii = tree
    depth = (len(points) + 1).bit_length() - 1
    level = [(0, np.arange(len(fps)), True)]
    for _ in range(depth):
        below = []
        for node, at, home in level:
            d = distance(fps[at], points[node]).astype(np.int64)
            near, far = sides(d, int(radii[node]), reach)
            if home:
                inner = d <= radii[node]
                below += [(2 * node + 1, at[inner], True), (2 * node + 2, at[~inner], True)]
                below.append((2 * node + 2, at[inner & far], False))
            else:
                below += [(2 * node + 1, at[near], False), (2 * node + 2, at[far], False)]
        level = [x for x in below if len(x[1])]
    for node, at, home in level:
        yield node - len(points), at, home


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is linked to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def close_pairs(fps: np.ndarray, homes: int, reach: int, seed: int) -> Iterator[tuple]:
    """Arrays of pairs ``(place, place of a home)`` within ``reach``; the homes come first.

    Every pair that has a home is found at least once. A branch is followed only where the
    triangle inequality allows a match.
    """
    rng = np.random.default_rng(seed)
    todo = [(np.arange(homes), np.arange(homes, len(fps)))]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        d_own = distance(fps[own], fps[own[rng.integers(len(own))]]).astype(np.int64)
        radius = int(np.median(d_own))
        inner = d_own <= radius
        if len(own) <= LEAF or inner.all():
            asked = np.concatenate([own, guests])
            step = max(1, BLOCK // len(own))
            for k in range(0, len(asked), step):
                hit = distance(fps[asked[k : k + step], None], fps[None, own]) <= reach
                x, y = np.nonzero(hit)
                yield asked[k + x], own[y]
            continue
        point = fps[own[np.argmin(d_own)]]
        near, far = sides(distance(fps[guests], point).astype(np.int64), radius, reach)
        border = own[inner & (d_own + reach > radius)]
        todo.append((own[inner], guests[near]))
        todo.append((own[~inner], np.concatenate([guests[far], border])))


def forest(fps: np.ndarray, homes: int, reach: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the close pairs connect, at most one a fingerprint."""
    n = len(fps)
    a = b = np.zeros(0, np.int64)
    kept, waiting = [], 0
    for x, y in itertools.chain(close_pairs(fps, homes, reach, seed), [(a, b)]):
        kept.append((x, y))
        waiting += len(x)
        if waiting > 4 * BLOCK:
            label = components(n, *map(np.concatenate, zip(*kept)))
            linked = np.flatnonzero(label != np.arange(n))
            kept, waiting = [(linked, label[linked])], len(linked)
    label = components(n, *map(np.concatenate, zip(*kept)))
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def tree_depth(n: int, shard_size: int) -> int:
    """Each level sends about a quarter of the fingerprints on as guests, and more of the guests, so
    shards are as large as a task can search and few are made before that."""
    early = min(EARLY_SHARDS, n / min(EARLY_SIZE, shard_size))
    return max(0, int(np.ceil(np.log2(max(1, n / shard_size, early)))))


def links(different: DataFrame, reach: int, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``a`` and ``b``: a forest over the different fingerprints ``fp`` that lie within ``reach``."""
    n = different.count()
    depth = tree_depth(n, shard_size)
    some = max(SAMPLE, SAMPLE_OF_NODE << depth) if depth else 0
    rows = different.orderBy(F.xxhash64("fp"), "fp").limit(some).collect()
    tree = fit_tree(np.array([r["fp"] for r in rows], np.int64).view(np.uint64), depth, reach)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for shard, at, home in route(fps.view(np.uint64), tree, reach):
                own = fps[at]
                yield pa.record_batch(
                    [pa.array(np.full(len(own), shard)), pa.array(own), pa.array(np.full(len(own), home))],
                    names=["shard", "fp", "home"],
                )

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["home", "fp"], ascending=[False, True])
        fps = shard["fp"].to_numpy(np.int64)
        a, b = forest(fps.view(np.uint64), int(shard["home"].sum()), reach, int(shard["shard"].iloc[0]))
        return pd.DataFrame({"a": fps[a], "b": fps[b]})

    dealt = different.mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


# Components -----------------------------------------------------------------------------------


def stars(edges: DataFrame) -> DataFrame:
    """``a`` and the smallest ``b`` that it is connected to; only for ``a`` that have a smaller one.

    Alternates two contractions until nothing changes: every node links its larger neighbours to
    its smallest one, then its smaller ones. Each round is written to the shared folder.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("a"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()

    big = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(edges.where("a <> b").select(*big).distinct(), "links")
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(smallest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        large = stored(large.where("a <> b").select(*big).distinct(), "large_stars")
        small = large.join(smallest(large), "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            small.select("a", F.col("low").alias("b"))
        )
        edges = stored(small.where("a <> b").select(*big).distinct(), "small_stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges


def _roots(groups: DataFrame, max_bits: int, shard_size: int) -> DataFrame:
    """``groups`` (one row for each ``fp``) with ``root``, one fingerprint of each component."""
    root = stars(links(groups.select("fp"), max_bits, shard_size))
    root = root.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return groups.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 3,
    max_bits: int = 3,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (the smallest key it can reach) of every row."""
    found = stored(fingerprints(docs, key, text, width), "fingerprints")
    groups = stored(found.groupBy("fp").agg(F.min("key").alias("first")), "groups")
    rooted = _roots(groups, max_bits, shard_size)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = stored(rooted.join(named, "root").select("fp", "component_id"), "components")
    return found.join(of_fp, "fp").select("key", "fp", "component_id")


def one_of_each(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 3,
    max_bits: int = 3,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """``docs`` without near copies: exactly one row of each component stays.

    It is the one with the smallest key, null keys last; of several rows with that key, one chosen by
    a hash of the whole row. Whole rows are told apart by two hashes, so that rows which share a key,
    or have none, are documents of their own. The texts of rows that a bitmap of fixed size (16 million
    bits) shows to be unmarked are not shuffled: most of them, up to some ten million marked rows.
    """
    own = [docs[c] for c in docs.columns]
    hashes = {"one": F.xxhash64(*own), "two": F.xxhash64(F.lit("two"), *own)}
    ident = ["one", "two"]
    found = fingerprints(docs, key, text, width, hashes)
    rows = found.groupBy("fp", "key", *ident).agg(F.count("*").alias("copies"))
    rows = stored(rows, "row_fingerprints")
    first = F.struct(F.col("key").isNull().alias("no_key"), "key", *ident, "copies")
    groups = stored(rows.groupBy("fp").agg(F.min(first).alias("first")), "row_groups")
    stay = _roots(groups, max_bits, shard_size).groupBy("root").agg(F.min("first").alias("first"))
    stay = stored(stay.select("first.one", "first.two", "first.copies"), "kept_rows")
    gone = rows.select(*ident).join(stay, ident, "left_anti").select(*ident, F.lit(0).alias("copies"))
    # Marked are those that go or are repeated.
    marks = stored(gone.union(stay.where("copies > 1").select(*ident, F.lit(2))), "marked_rows")
    cell = F.pmod("one", F.lit(CELLS)).alias("cell")
    bit = F.pmod("two", F.lit(64)).cast("int")
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    cells = marks.select(cell, set_bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    named = docs.select(F.struct(*own).alias("row"), *(c.alias(n) for n, c in hashes.items()))
    looked = named.select("*", cell).join(F.broadcast(stored(cells, "marked_cells")), "cell", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(set_bit), F.lit(0)) != 0
    marked = looked.where(may).join(marks, ident, "left")
    kept = looked.where(~may).select("row").union(marked.where(F.col("copies").isNull()).select("row"))
    if not marks.where("copies > 1").isEmpty():
        kept = kept.union(marked.where("copies > 1").dropDuplicates(ident).select("row"))
    return kept.select("row.*")
