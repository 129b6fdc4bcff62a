"""Bounded graph expansion of many roots at once.

One walk serves both directions and all profiles: an edge is one link (way, source, destination) with
the profiles that see it as bits of a mask, frontiers carry masks too, and each hop is one equi-join
of the frontier with the links. A hop is reduced to one row for each scope and node before it is
stored, and only what is new to some profile travels on. Inside the walk entities go by their compact
keys. First-discovery hop and the evidence of the discovering edge are one integer, ``code = hop * 4 +
rank``, so a plain ``min`` keeps the earliest and strongest. The last hop goes straight into that
``min``: nothing travels on from it, so it is neither reduced nor stored by itself.

Counters need no entities: ``signatures`` says how many entities of a scope look alike.

With a column, hop 1 comes from the column edges only and hops 2-3 are table-level closures from
the root, so a table-level neighbour outside the column edges counts as hop 2.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions.constants import MAX_HOPS, PROVENANCES
from ripplemap.functions.urn import compact, expanded, key_kind, key_platform, urn_name
from ripplemap.operators.catalog import profile_mask
from ripplemap.operators.skew import ROWS_PER_SHARD, crowded_keys, repeat_rows, shard_key, split_rows

Keep = Callable[[DataFrame, str], DataFrame]
_KEY = ["way", "src"]
_AT = ["way", "scope_id", "at"]
_RANKS = range(3)
_SCOPE = ["profile", "scope_id"]
MOST_KINDS = 1000


def _rank(provenance: Column) -> Column:
    rank = F.when(provenance == PROVENANCES[0], 0).when(provenance == PROVENANCES[1], 1)
    return rank.otherwise(2)


def _unkept(df: DataFrame, name: str) -> DataFrame:
    return df


def masked_edges(edges: DataFrame, profiles: list[str]) -> DataFrame:
    """Each edge once: (src, dst, rank, mask, src_kind, dst_kind) on compact keys.

    Edges of ``catalog.masked_edges`` have their masks and are rows of their own already; one that is
    given twice is only walked twice."""
    kinds = ["src_kind", "dst_kind"]
    if "mask" in edges.columns:
        return edges.select("src", "dst", _rank(F.col("provenance")).alias("rank"), "mask", *kinds)
    up, down = compact(F.col("up_urn")).alias("src"), compact(F.col("down_urn")).alias("dst")
    rows = edges.select(up, down, _rank(F.col("provenance")).alias("rank"), profile_mask(profiles).alias("mask"))
    once = rows.where("mask IS NOT NULL").groupBy("src", "dst", "rank").agg(F.bit_or("mask").alias("mask"))
    return once.withColumns(dict(zip(kinds, (key_kind(F.col("src")), key_kind(F.col("dst"))), strict=True)))


def both_ways(once: DataFrame) -> DataFrame:
    """``masked_edges`` from either end: (way, src, dst, rank, mask, kind), the kind that of ``src``;
    way 0 goes down."""
    down, up = (
        once.select(F.lit(way).alias("way"), F.col(a).alias("src"), F.col(b).alias("dst"), "rank", "mask",
                    F.col(f"{a}_kind").alias("kind"))
        for way, (a, b) in enumerate((("src", "dst"), ("dst", "src")))
    )
    return down.unionByName(up)


def links_of(edges: DataFrame, profiles: list[str], keep: Keep = _unkept) -> DataFrame:
    """Each edge once for each way: (way, src, dst, rank, mask, kind) on compact keys; way 0 goes down.

    ``keep`` may write the edges to a table, which is half as long as their links; edges that have
    masks are taken as they are."""
    once = masked_edges(edges, profiles)
    return both_ways(once if "mask" in edges.columns else keep(once, "links"))


def _column_links(column_edges: DataFrame, profiles: list[str]) -> DataFrame:
    rank = _rank(F.col("provenance")).alias("rank")
    if "mask" in column_edges.columns:
        rows = column_edges.select("src", "up_col", "dst", "down_col", rank, "mask", "src_kind", "dst_kind")
    else:
        rows = column_edges.select(
            compact(F.col("up_urn")).alias("src"), "up_col", compact(F.col("down_urn")).alias("dst"), "down_col",
            rank, profile_mask(profiles).alias("mask"),
        ).where("mask IS NOT NULL")
        rows = rows.withColumns({f"{end}_kind": key_kind(F.col(end)) for end in ("src", "dst")})
    down, up = (
        rows.select(F.lit(way).alias("way"), F.col(a).alias("src"), F.col(c).alias("src_col"),
                    F.col(b).alias("dst"), "rank", "mask", F.col(f"{a}_kind").alias("kind"))
        for way, (a, c, b) in enumerate((("src", "up_col", "dst"), ("dst", "down_col", "src")))
    )
    return down.unionByName(up)


def _kind(rows: DataFrame, key: str) -> Column:
    """The kind of the nodes ``key``: links carry it, so that a scan of stored ones can leave out the
    parts of files that hold other kinds."""
    return F.col("kind") if "kind" in rows.columns else key_kind(F.col(key))


def _kinds(rows: DataFrame, key: str) -> set | None:
    """Kinds of the nodes ``key`` for each way: (way, kind); None where they are too many to be told."""
    told = rows.select("way", _kind(rows, key).alias("kind")).distinct().limit(MOST_KINDS + 1).collect()
    return None if len(told) > MOST_KINDS else {tuple(r) for r in told if r["kind"] is not None}


def _of_kinds(rows: DataFrame, key: str, kinds: set | None) -> DataFrame:
    if kinds is None:
        return rows
    met = F.lit(False)
    for way in (0, 1):
        met = met | ((F.col("way") == way) & _kind(rows, key).isin(sorted(k for w, k in kinds if w == way)))
    return rows.where(met)


def _meeting(one: set | None, other: set | None) -> set | None:
    """Kinds of both sides, by which nothing is lost in a join of them."""
    return other if one is None else one if other is None else one & other


def link_hubs(links: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Nodes with more links in one direction than a task should hold."""
    return crowded_keys(links, _KEY, rows_per_shard)


def _by_rank(rows: DataFrame, keys: list[str], old: DataFrame) -> DataFrame:
    """One row for each of ``keys``: the mask of each rank, and what ``old`` (keys, mask) has of it."""
    none = F.lit(0).cast("long")
    marked = rows.select(
        *keys, *(F.when(F.col("rank") == r, F.col("mask")).otherwise(none).alias(f"m{r}") for r in _RANKS),
        none.alias("old"),
    )
    marked = marked.unionByName(
        old.select(*keys, *(none.alias(f"m{r}") for r in _RANKS), F.col("mask").alias("old"))
    )
    return marked.groupBy(*keys).agg(*(F.bit_or(c).alias(c) for c in [*(f"m{r}" for r in _RANKS), "old"]))


def _any_rank() -> Column:
    return F.col("m0").bitwiseOR(F.col("m1")).bitwiseOR(F.col("m2"))


def reached(
    scopes: DataFrame,
    links: DataFrame,
    column_edges: DataFrame,
    profiles: list[str],
    max_hops: int = MAX_HOPS,
    hubs: DataFrame | None = None,
    keep: Keep = _unkept,
) -> DataFrame:
    """Entities within ``max_hops``, one row for each scope and compact key: (scope_id, at) with
    ``down_k`` and ``up_k``, the least codes in the k-th profile; the root has code 0.

    ``links`` come from ``links_of``, whose edges a caller stores; ``column_edges`` carry a ``profile``. Nodes with very many links (``hubs``)
    are split over shards so that one hub cannot fill a task; None says that there are none. A hop reads
    only links from the kinds of nodes that it stands on, and nodes without links are not sent to them.
    ``keep(df, name)`` may write each hop to a table, so that later hops read it instead of
    computing it again.
    """
    everyone = F.lit((1 << len(profiles)) - 1).cast("long")
    sharded = split_rows(links, hubs, _KEY, "dst")
    starts = scopes.select(
        "scope_id", compact(F.col("root_urn")).alias("src"), "column",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("way"),
    )
    scoped = starts.filter(F.col("column") != "")
    fields = _column_links(column_edges, profiles)
    begun = _meeting(_kinds(scoped, "src"), _kinds(fields, "src"))
    first = (
        _of_kinds(scoped, "src", begun).withColumnRenamed("column", "src_col")
        .join(_of_kinds(fields, "src", begun), _KEY + ["src_col"])
        .select("way", "scope_id", F.col("dst").alias("at"), "rank", "mask")
    )
    nothing = starts.select("way", "scope_id", F.col("src").alias("at"), everyone.alias("mask")).limit(0)
    first = keep(_by_rank(first, _AT, nothing).drop("old"), "column_hop")
    # A scoped start whose column reaches nothing in a profile stops there.
    grown = first.groupBy("way", "scope_id").agg(F.bit_or(_any_rank()).alias("mask"))
    alive = starts.filter(F.col("column") == "").withColumn("mask", everyone)
    alive = alive.select(*_KEY, "scope_id", F.lit(1).alias("least"), "mask").unionByName(
        scoped.join(grown, ["way", "scope_id"]).select(*_KEY, "scope_id", F.lit(2).alias("least"), "mask")
    )

    keys = [*_AT, "least"]
    frontier = keep(alive, "starts")
    seen = frontier.withColumnRenamed("src", "at").select(*keys, "mask")
    found = [first.withColumn("hop", F.lit(1))]
    linked = _kinds(links, "src")
    for hop in range(1, max_hops + 1):
        kinds = _meeting(_kinds(frontier, "src"), linked)
        step = (
            repeat_rows(_of_kinds(frontier, "src", kinds).withColumnRenamed("mask", "own"), hubs, _KEY)
            .join(_of_kinds(sharded, "src", kinds), _KEY + shard_key(hubs))
            .select("way", "scope_id", "least", F.col("dst").alias("at"), "rank",
                    F.col("own").bitwiseAND(F.col("mask")).alias("mask"))
            .where("mask <> 0")
        )
        reached_at = F.greatest(F.lit(hop), F.col("least"))
        if hop == max_hops:
            of_rank = [F.when(F.col("rank") == r, F.col("mask")).otherwise(F.lit(0).cast("long")) for r in _RANKS]
            last = step.select(*_AT, *(m.alias(f"m{r}") for r, m in enumerate(of_rank)), reached_at.alias("hop"))
            found.append(last.where(F.col("hop") <= max_hops))
            break
        told = _by_rank(step, keys, seen)
        fresh = _any_rank().bitwiseAND(F.bitwise_not("old"))
        # Walks of one and of two steps count alike where hop 1 belongs to the columns.
        again = (F.col("least") == 2) & (_any_rank() != 0) if hop == 2 else F.lit(False)
        level = keep(told.where((fresh != 0) | again).withColumn("fresh", fresh).drop("old"), f"hop_{hop}")
        found.append(level.select(*_AT, "m0", "m1", "m2", reached_at.alias("hop")).where(F.col("hop") <= max_hops))
        new = level.where("fresh <> 0").withColumnRenamed("fresh", "mask")
        frontier = new.select("way", F.col("at").alias("src"), "scope_id", "least", "mask")
        seen = seen.unionByName(new.select(*keys, "mask"))

    zero, none = F.lit(0), F.lit(0).cast("long")
    roots = starts.select("way", "scope_id", F.col("src").alias("at"), everyone.alias("m0"),
                          none.alias("m1"), none.alias("m2"), zero.alias("hop"))
    every = roots
    for part in found:
        every = every.unionByName(part.select(*roots.columns))
    codes = []
    for place in range(len(profiles)):
        bit = F.lit(1 << place).cast("long")
        code = F.when(F.lit(False), 0)
        for r in _RANKS:
            code = code.when(F.col(f"m{r}").bitwiseAND(bit) != 0, F.col("hop") * 4 + r)
        for way, name in enumerate(("down", "up")):
            codes.append(F.min(F.when(F.col("way") == way, code)).alias(f"{name}_{place}"))
    return every.groupBy("scope_id", "at").agg(*codes)


def by_profile(found: DataFrame, profiles: list[str], *carry: str) -> DataFrame:
    """A row for each profile that sees a row of ``reached``: (profile, scope_id, …, down_code, up_code)."""
    rows = []
    for place, profile in enumerate(profiles):
        down, up = F.col(f"down_{place}"), F.col(f"up_{place}")
        row = F.struct(F.lit(profile).alias("profile"), down.alias("down_code"), up.alias("up_code"))
        rows.append(F.when(down.isNotNull() | up.isNotNull(), row))
    wide = found.select("scope_id", *carry, F.inline(F.array_compact(F.array(*rows))))
    return wide.select("profile", "scope_id", *carry, "down_code", "up_code")


def candidates(found: DataFrame, profiles: list[str]) -> DataFrame:
    """Candidates (profile, scope_id, urn, down_code, up_code) of ``reached``."""
    return by_profile(found, profiles, "at").select(
        *_SCOPE, expanded(F.col("at")).alias("urn"), "down_code", "up_code"
    )


def closure(
    scopes: DataFrame,
    links: DataFrame,
    column_edges: DataFrame,
    profiles: list[str],
    max_hops: int = MAX_HOPS,
    hubs: DataFrame | None = None,
    keep: Keep = _unkept,
) -> DataFrame:
    """Candidates (profile, scope_id, urn, down_code, up_code) within ``max_hops``; see ``reached``."""
    return candidates(reached(scopes, links, column_edges, profiles, max_hops, hubs, keep), profiles)


def signatures(found: DataFrame, profiles: list[str]) -> DataFrame:
    """``reached`` without its entities: (profile, scope_id, platform, down_code, up_code, n), ``n`` the
    entities that are alike. All counters of a scope follow from these rows, which are bounded by
    platforms and codes; they are counted before the shuffle."""
    codes = [f"{way}_{place}" for place in range(len(profiles)) for way in ("down", "up")]
    alike = found.groupBy("scope_id", key_platform(F.col("at")).alias("platform"), *codes).agg(
        F.count(F.lit(1)).alias("n")
    )
    return by_profile(alike, profiles, "platform", "n")


def _weight(rows: DataFrame) -> Column:
    """How many entities a row stands for."""
    return F.col("n") if "n" in rows.columns else F.lit(1)


def count_rows(condition: Column, weight: Column) -> Column:
    return F.sum(F.when(condition, weight).otherwise(0))


def hop_limits(candidates: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Last hop each direction may keep: a hop that adds no new entity ends its direction.

    Upstream runs second, so entities already kept downstream are not new to it. Only counters are
    aggregated; the candidate rows themselves are not shuffled by scope. Rows of ``signatures`` serve
    as well.
    """
    one = _weight(candidates)
    down = (F.col("down_code") / 4).cast("int")
    up = (F.col("up_code") / 4).cast("int")
    hops = range(1, max_hops + 1)
    counters = [count_rows(down == k, one).alias(f"d{k}") for k in hops]
    counters += [count_rows((up == k) & down.isNull(), one).alias(f"u{k}_0") for k in hops]
    counters += [
        count_rows((up == k) & (down == j), one).alias(f"u{k}_{j}") for k in hops for j in hops
    ]
    counted = candidates.groupBy(*_SCOPE).agg(*counters)

    def last_kept(new: list[Column]) -> Column:
        limit = F.when(new[0] == 0, 0)
        for k in range(1, max_hops):
            limit = limit.when(new[k] == 0, k)
        return limit.otherwise(max_hops)

    limited = counted.withColumn("down_limit", last_kept([F.col(f"d{k}") for k in hops]))
    new_up = []
    for k in hops:
        total = F.col(f"u{k}_0")
        for j in hops:
            total = total + F.when(F.col("down_limit") < j, F.col(f"u{k}_{j}")).otherwise(0)
        new_up.append(total)
    limited = limited.withColumn("up_limit", last_kept(new_up))
    beyond_down = F.lit(0)
    beyond_up = F.lit(0)
    for k in hops:
        beyond_down = beyond_down + F.when(F.col("down_limit") < k, F.col(f"d{k}")).otherwise(0)
        beyond_up = beyond_up + F.when(F.col("up_limit") < k, new_up[k - 1]).otherwise(0)
    return limited.select(
        *_SCOPE, "down_limit", "up_limit", ((beyond_down + beyond_up) > 0).alias("trims")
    )


def trimmed_scopes(candidates: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Scopes that lose rows to the stopping rule; none on acyclic graphs with consistent columns."""
    return hop_limits(candidates, max_hops).filter("trims").drop("trims")


def subgraph(
    candidates: DataFrame, trims: DataFrame | None = None, max_hops: int = MAX_HOPS
) -> DataFrame:
    """Kept entities (profile, scope_id, urn, direction, hop, provenance) after the stopping rule.

    Only scopes that really lose rows (``trims``) are joined back; None says that no scope does. Rows
    of ``signatures`` keep ``platform`` and ``n`` instead of ``urn``.
    """
    own = [c for c in candidates.columns if c not in (*_SCOPE, "down_code", "up_code")]
    if trims is None:
        limited = candidates.withColumn("down_limit", F.lit(max_hops)).withColumn("up_limit", F.lit(max_hops))
    else:
        limited = candidates.join(trims, _SCOPE, "left")
    down = (F.col("down_code") / 4).cast("int")
    up = (F.col("up_code") / 4).cast("int")
    keep_down = F.coalesce(down <= F.coalesce("down_limit", F.lit(max_hops)), F.lit(False))
    keep_up = F.coalesce(up <= F.coalesce("up_limit", F.lit(max_hops)), F.lit(False))
    code = F.when(keep_down, F.col("down_code")).when(keep_up, F.col("up_code"))
    rank = F.col("code") % 4
    return (
        limited.select(*_SCOPE, *own, code.alias("code"), keep_down.alias("is_down"))
        .filter(F.col("code").isNotNull())
        .select(
            *_SCOPE,
            *own,
            F.when(F.col("code") == 0, "root")
            .when(F.col("is_down"), "downstream")
            .otherwise("upstream")
            .alias("direction"),
            (F.col("code") / 4).cast("int").alias("hop"),
            F.when(F.col("code") == 0, F.lit(None))
            .when(rank == 0, PROVENANCES[0])
            .when(rank == 1, PROVENANCES[1])
            .otherwise(PROVENANCES[2])
            .alias("provenance"),
        )
    )


def star_edges(sub: DataFrame, scopes: DataFrame, true_provenance: bool = False) -> DataFrame:
    """One edge between the root and every other kept entity, parsed with full confidence.

    With ``true_provenance`` the edge carries the evidence of the edge that discovered it.
    """
    provenance = F.col("provenance") if true_provenance else F.lit(PROVENANCES[0])
    is_down = F.col("direction") == "downstream"
    joined = sub.filter(F.col("hop") > 0).join(scopes.select("scope_id", "root_urn"), "scope_id")
    return joined.select(
        *_SCOPE,
        F.when(is_down, F.col("root_urn")).otherwise(F.col("urn")).alias("up_urn"),
        F.when(is_down, F.col("urn")).otherwise(F.col("root_urn")).alias("down_urn"),
        provenance.alias("provenance"),
    ).withColumn("confidence", confidence_of(F.col("provenance")))


def confidence_of(provenance: Column) -> Column:
    return F.when(provenance == "parsed", 1.0).when(provenance == "curated", 0.9).otherwise(0.5)


def trace_text(direction: Column, hop: Column, root_name: Column) -> Column:
    return F.when(direction == "root", "the changed entity itself").otherwise(
        F.format_string("%s of %s at hop %d", direction, root_name, hop)
    )


def with_trace(sub: DataFrame, scopes: DataFrame) -> DataFrame:
    root = urn_name(F.col("root_urn"))
    return sub.join(scopes.select("scope_id", "root_urn"), "scope_id").select(
        *sub.columns, trace_text(F.col("direction"), F.col("hop"), root).alias("trace")
    )
