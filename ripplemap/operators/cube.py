"""Who lies within how many hops of whom: closures of all nodes, and of asked ones.

A closure is a table of distances, each stored once; a question for ``hops`` reads ``d <= hops``.

All nodes: one walk goes downstream on edges that carry the profiles which see them as bits of one
number, so that a pair costs one row however many profiles there are. Evaluation is semi-naive: only
pairs that are new in some profile travel on, and what was found before is subtracted in the
aggregation that makes a hop distinct. The upstream cube is the same table read from its other end.

Asked nodes: requests travel on the frontier as rows of their own, each as far as it asked, over links
of the directions and levels asked for; nothing else is built.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions.constants import MAX_HOPS
from ripplemap.functions.urn import compact, expanded
from ripplemap.operators.catalog import profile_mask
from ripplemap.operators.skew import ROWS_PER_SHARD, crowded_keys, repeat_rows, shard_key, split_rows

Keep = Callable[[DataFrame, str], DataFrame]
ANY = "*"
REQUEST = ["profile", "root_urn", "dir", "column"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def mask_links(edges: DataFrame, profiles: list[str]) -> DataFrame:
    """Each edge once: (src, dst, mask) on compact keys."""
    if "mask" in edges.columns:  # of ``catalog.masked_edges``
        rows = edges.select("src", "dst", "mask")
    else:
        rows = edges.select(
            compact(F.col("up_urn")).alias("src"), compact(F.col("down_urn")).alias("dst"),
            profile_mask(profiles).alias("mask"),
        )
    return rows.where("mask IS NOT NULL").groupBy("src", "dst").agg(F.bit_or("mask").alias("mask"))


def mask_column_links(column_edges: DataFrame, profiles: list[str]) -> DataFrame:
    """Each column edge once: (src, src_col, dst, dst_col, mask)."""
    own = [F.col("up_col").alias("src_col"), F.col("down_col").alias("dst_col")]
    if "mask" in column_edges.columns:
        rows = column_edges.select("src", "dst", *own, "mask")
    else:
        rows = column_edges.select(
            compact(F.col("up_urn")).alias("src"), compact(F.col("down_urn")).alias("dst"), *own,
            profile_mask(profiles).alias("mask"),
        )
    keys = ["src", "src_col", "dst", "dst_col"]
    return rows.where("mask IS NOT NULL").groupBy(*keys).agg(F.bit_or("mask").alias("mask"))


def link_hubs(links: DataFrame, keys: list[str], rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Nodes with more links than a task should hold."""
    return crowded_keys(links, keys, rows_per_shard)


def _hops(
    links: DataFrame, node: list[str], max_hops: int | None, keep: Keep, hubs: DataFrame | None
) -> DataFrame:
    """All pairs (root…, at…, d, mask) of nodes of a graph, each profile's bit at its least ``d``.

    ``node`` names the parts of a node ("" or "", "_col"). Without ``max_hops`` the walk ends when a
    hop finds nothing new.
    """
    roots, ats = [f"root{c}" for c in node], [f"at{c}" for c in node]
    sources, ends = [f"src{c}" for c in node], [f"dst{c}" for c in node]
    pair = [*roots, *ats]
    home = reduce(lambda a, b: a & b, [F.col(r) == F.col(a) for r, a in zip(roots, ats, strict=True)])
    named = {**dict(zip(sources, roots)), **dict(zip(ends, ats))}
    level = links.withColumnsRenamed(named).where(~home).select(*pair, "mask")
    levels = [level.withColumn("d", F.lit(1))]
    sharded = split_rows(links, hubs, ["src"], "dst")
    while max_hops is None or len(levels) < max_hops:
        front = levels[-1].withColumnsRenamed(dict(zip(ats, sources))).withColumnRenamed("mask", "own")
        step = (
            repeat_rows(front, hubs, ["src"])
            .join(sharded, [*sources, *shard_key(hubs)])
            .select(*roots, *[F.col(e).alias(a) for e, a in zip(ends, ats)],
                    F.col("own").bitwiseAND(F.col("mask")).alias("mask"))
            .where((F.col("mask") != 0) & ~home)
        )
        none = F.lit(0).cast("long")
        both = step.select(*pair, F.col("mask").alias("new"), none.alias("old")).unionByName(
            _union(levels).select(*pair, none.alias("new"), F.col("mask").alias("old"))
        )
        told = both.groupBy(*pair).agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        fresh = F.col("new").bitwiseAND(F.bitwise_not("old"))
        level = told.where(fresh != 0).select(*pair, fresh.alias("mask"))
        level = keep(level.withColumn("d", F.lit(len(levels) + 1)), f"level_{len(levels) + 1}")
        if max_hops is None and level.isEmpty():
            break
        levels.append(level)
    return _union(levels)


def _nearest(pairs: DataFrame, keys: list[str], max_hops: int) -> DataFrame:
    """Pairs that several columns connect: each profile's bit at its least ``d`` only."""
    seen, told = F.lit(0).cast("long"), []
    for k in range(1, max_hops + 1):
        told.append(F.struct(F.lit(k).alias("d"), F.col(f"m{k}").bitwiseAND(F.bitwise_not(seen)).alias("mask")))
        seen = seen.bitwiseOR(F.col(f"m{k}"))
    at = [
        F.bit_or(F.when(F.col("d") == k, F.col("mask")).otherwise(F.lit(0).cast("long"))).alias(f"m{k}")
        for k in range(1, max_hops + 1)
    ]
    return pairs.groupBy(*keys).agg(*at).select(*keys, F.inline(F.array(*told))).where("mask <> 0")


def distances(
    edges: DataFrame, column_edges: DataFrame, profiles: list[str], max_hops: int = MAX_HOPS,
    keep: Keep = lambda df, name: df, hubs: DataFrame | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """(dir, column, root, at, d, mask) of all nodes, on compact keys; a node is not its own.

    ``column`` is '*' at table level; else the walk starts at that column of the root and follows
    column edges at every depth. ``columns`` asks for some of them.
    """
    links = keep(mask_links(edges, profiles), "links")
    table = _hops(links, [""], max_hops, keep, hubs)
    fields = keep(mask_column_links(column_edges, profiles), "column_links")
    scoped = keep(_hops(fields, ["", "_col"], max_hops, keep, hubs), "column_pairs")
    scoped = scoped.where("root <> at")
    ends = {
        "down": scoped.select("root", F.col("root_col").alias("column"), "at", "d", "mask"),
        "up": scoped.select(F.col("at").alias("root"), F.col("at_col").alias("column"),
                            F.col("root").alias("at"), "d", "mask"),
    }
    plain = {
        "down": table.select("root", "at", "d", "mask"),
        "up": table.select(F.col("at").alias("root"), F.col("root").alias("at"), "d", "mask"),
    }
    out = []
    for way in ("down", "up"):
        own = ends[way] if columns is None else ends[way].where(F.col("column").isin(*columns))
        near = _nearest(own, ["column", "root", "at"], max_hops)
        for part in (plain[way].withColumn("column", F.lit(ANY)), near):
            out.append(part.select(F.lit(way).alias("dir"), "column", "root", "at", "d", "mask"))
    return _union(out)


def _seen(profiles: list[str]) -> Column:
    """A row for each profile with a bit in ``mask``."""
    seen = [
        F.when(F.col("mask").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(p))
        for k, p in enumerate(profiles)
    ]
    return F.explode(F.array_compact(F.array(*seen))).alias("profile")


def by_profile(found: DataFrame, profiles: list[str]) -> DataFrame:
    """(profile, dir, column, root, at, d): a row for each profile that sees a pair."""
    return found.select(_seen(profiles), "dir", "column", "root", "at", "d")


def cube_rows(found: DataFrame, profiles: list[str]) -> DataFrame:
    """The cube as it is stored: (profile, dir, column, root_urn, urn, d), each pair once."""
    return by_profile(found, profiles).select(
        "profile", "dir", "column", expanded(F.col("root")).alias("root_urn"),
        expanded(F.col("at")).alias("urn"), "d",
    )


def cube_sizes(found: DataFrame, profiles: list[str], max_hops: int = MAX_HOPS) -> DataFrame:
    """Size and extremes (n, first_urn, last_urn) of each (profile, root_urn, dir, column, hops)."""
    counts, told, urn = [], [], expanded(F.col("at"))
    for k in range(1, max_hops + 1):
        near = F.col("d") <= k
        counts += [
            F.count_if(near).alias(f"n{k}"),
            F.min(F.when(near, urn)).alias(f"first{k}"),
            F.max(F.when(near, urn)).alias(f"last{k}"),
        ]
        told.append(F.struct(
            F.lit(k).alias("hops"), F.col(f"n{k}").alias("n"), F.col(f"first{k}").alias("first_urn"),
            F.col(f"last{k}").alias("last_urn"),
        ))
    grouped = by_profile(found, profiles).groupBy("profile", "root", "dir", "column").agg(*counts)
    return grouped.select(
        "profile", expanded(F.col("root")).alias("root_urn"), "dir", "column", F.inline(F.array(*told))
    ).where("n > 0")


# --- asked closures ---------------------------------------------------------


def _asked(
    starts: DataFrame, links: DataFrame, node: list[str], most: int, keep: Keep, hubs: DataFrame | None
) -> DataFrame:
    """(profile, root, column, at, d) from ``starts`` (profile, root, column, hops)."""
    sources, ends, ats = ([f"{x}{c}" for c in node] for x in ("src", "dst", "at"))
    own, key = ["profile", "root", "column"], ["profile", "src"]
    start = {"at": F.col("root"), "at_col": F.col("column")}
    first = starts.select(*own, "hops", *[start[a].alias(a) for a in ats], F.lit(0).alias("d"))
    sharded = split_rows(links, hubs, key, "dst")
    found = [first]
    for hop in range(1, most + 1):
        front = found[-1].where(F.col("hops") >= hop).withColumnsRenamed(dict(zip(ats, sources)))
        step = (
            repeat_rows(front, hubs, key)
            .join(sharded, ["profile", *sources, *shard_key(hubs)])
            .select(*own, "hops", *[F.col(e).alias(a) for e, a in zip(ends, ats)], F.lit(hop).alias("d"))
        )
        told = step.unionByName(_union(found)).groupBy(*own, "hops", *ats).agg(F.min("d").alias("d"))
        found.append(keep(told.where(F.col("d") == hop), f"asked_{hop}"))
    every = _union(found[1:]) if most else found[0].limit(0)
    return every.groupBy(*own, "at").agg(F.min("d").alias("d")).where("at <> root")


def _ends(edges: DataFrame, profiles: list[str], *columns: Column) -> DataFrame:
    """(profile, up, down) and ``columns`` of edges, on compact keys."""
    if "mask" in edges.columns:  # of ``catalog.masked_edges``
        return edges.select(_seen(profiles), F.col("src").alias("up"), F.col("dst").alias("down"), *columns)
    up, down = compact(F.col("up_urn")).alias("up"), compact(F.col("down_urn")).alias("down")
    return edges.select("profile", up, down, *columns)


def asked_distances(
    requests: DataFrame, edges: DataFrame, column_edges: DataFrame, keep: Keep = lambda df, name: df,
    hubs: dict[str, DataFrame] | None = None, profiles: list[str] | None = None,
) -> DataFrame:
    """(profile, root_urn, dir, column, urn, d) within what was asked of each root and column.

    ``requests`` has profile, root_urn, dir, column ('*' for the table level) and hops. Only links
    of the directions and levels in it are built; which these are is asked first. ``hubs`` holds,
    by direction, nodes (profile, src) whose links are split. Edges may be those of
    ``catalog.masked_edges``, with ``profiles`` the names of the bits; nothing is made of URNs then.
    """
    level = F.col("column") == ANY
    kinds = requests.groupBy("dir", level.alias("plain")).agg(F.max("hops").alias("most")).collect()
    parts = []
    for way, plain, most in sorted(map(tuple, kinds)):
        rows = requests.where((F.col("dir") == way) & (level if plain else ~level))
        starts = rows.groupBy("profile", compact(F.col("root_urn")).alias("root"), "column").agg(
            F.max("hops").alias("hops")
        )
        names = ("src", "dst") if way == "down" else ("dst", "src")
        if plain:
            links, node = _ends(edges, profiles or []), [""]
        else:
            columns = [F.col("up_col").alias(f"{names[0]}_col"), F.col("down_col").alias(f"{names[1]}_col")]
            links, node = _ends(column_edges, profiles or [], *columns), ["", "_col"]
        links = links.withColumnsRenamed(dict(zip(("up", "down"), names)))
        found = _asked(starts, links, node, most, keep, (hubs or {}).get(way))
        parts.append(
            found.select(
                "profile", expanded(F.col("root")).alias("root_urn"), F.lit(way).alias("dir"), "column",
                expanded(F.col("at")).alias("urn"), "d",
            )
        )
    if not parts:
        return requests.select(*REQUEST, F.col("root_urn").alias("urn"), F.col("hops").alias("d")).limit(0)
    return _union(parts)


def answers(requests: DataFrame, found: DataFrame) -> DataFrame:
    """(profile, root_urn, dir, column, hops, urn): what lies within each request's hops."""
    asked = requests.select(*REQUEST, "hops").distinct()
    return asked.join(found, REQUEST).where("d <= hops").select(*REQUEST, "hops", "urn")
