"""Coverage audit: how much of the declared estate the catalog can see, and what it cannot.

Inputs are the kept subgraph and the registry only; no verdict reaches this module.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions.constants import COVERAGE_THRESHOLD, MIN_REACH
from ripplemap.functions.urn import urn_platform
from ripplemap.operators.expand import count_rows
from ripplemap.operators.skew import ROWS_PER_SHARD, crowded_keys, join_split

SPOT_TYPE = "array<struct<ord:int,description:string,platform:string,blocks:boolean>>"


def registry_summary(registry: DataFrame) -> DataFrame:
    """One row per profile: declared and dark counts, and a blind spot for each dark platform.

    The collected list is bounded by the number of declared platforms.
    """
    dark = ~F.col("connector")
    text = F.when(
        F.col("hosts_consumers"),
        F.format_string(
            "%s reports no lineage: %d declared entities are out of sight and may consume this",
            "platform", "expected",
        ),
    ).otherwise(
        F.format_string("%s reports no lineage, but it only supplies data and cannot be hit", "platform")
    )
    spot = F.struct(
        F.lit(1).alias("ord"), text.alias("description"), F.col("platform"),
        F.col("hosts_consumers").alias("blocks"),
    )
    return registry.groupBy("profile").agg(
        F.coalesce(F.nullif(F.sum("expected"), F.lit(0)), F.lit(1)).alias("expected_nodes"),
        F.coalesce(F.sum(F.when(dark, F.col("expected"))), F.lit(0)).alias("dark_nodes"),
        F.array_sort(F.collect_list(F.when(dark, spot))).cast(SPOT_TYPE).alias("platform_spots"),
    )


def _inner(sub: DataFrame, landing: list[str]) -> DataFrame:
    """Kept entities that should have an origin: neither the root nor on a landing platform."""
    return sub.filter((F.col("hop") > 0) & ~urn_platform(F.col("urn")).isin(landing))


def with_origin(
    inner: DataFrame, sub: DataFrame, edges: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Rows (profile, scope_id, urn) of ``inner`` with an incoming edge of the induced subgraph: one
    that the profile sees and whose upper end was kept in the same scope.

    ``hot`` lists entities (profile, urn) that very many scopes hold; their rows are spread out.
    """
    keys = ["profile", "scope_id"]
    rows = inner.select(*keys, "urn")
    ends = edges.select("profile", F.col("down_urn").alias("urn"), "up_urn").distinct()
    ups = join_split(rows, ends, hot, ["profile", "urn"], "scope_id")
    held = sub.select(*keys, F.col("urn").alias("up_urn"))
    return ups.join(held, [*keys, "up_urn"], "left_semi").select(*keys, "urn").distinct()


def hot_entities(inner: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    return crowded_keys(inner, ["profile", "urn"], rows_per_shard)


def unproven(inner: DataFrame) -> DataFrame:
    """Entities that the walk itself does not show to have an origin.

    One two or more hops downstream was found on a table-level edge that the profile sees, from an
    entity that lies no further away than itself; the stopping rule keeps that one too. At hop 1 a
    column edge may have no table-level edge beside it.
    """
    return inner.filter((F.col("direction") != "downstream") | (F.col("hop") < 2))


def orphan_rows(
    sub: DataFrame, landing: list[str], edges: DataFrame | None = None, hot: DataFrame | None = None,
    walked: bool = False,
) -> DataFrame:
    """Kept entities whose origin the catalog cannot tell, one row each.

    Default: entities without an incoming star edge, which are the upstream ones. With ``edges`` the
    subgraph that the kept entities induce in the catalog decides. Landing platforms are expected to
    have no origin and the root is never listed.
    ``walked`` says that ``sub`` was found on these very edges; then only ``unproven`` entities are
    looked up in them.
    """
    inner = _inner(sub, landing)
    if edges is None:
        return inner.filter(F.col("direction") == "upstream")
    if walked:
        inner = unproven(inner)
    return inner.join(with_origin(inner, sub, edges, hot), ["profile", "scope_id", "urn"], "left_anti")


def scope_facts(
    sub: DataFrame, landing: list[str], true_provenance: bool = False, orphans: DataFrame | None = None
) -> DataFrame:
    """Counters per scope; every group is reduced map-side to one bounded row.

    ``sub`` are kept entities, or kept ``expand.signatures`` with ``platform`` and ``n``. ``orphans``
    are rows of ``orphan_rows``; without them those of the star count.
    """
    other = F.col("hop") > 0
    if "n" in sub.columns:
        platform, one = F.col("platform"), F.col("n")
    else:
        platform, one = urn_platform(F.col("urn")), F.lit(1)
    provenance = F.col("provenance") if true_provenance else F.lit("parsed")
    is_orphan = (F.col("direction") == "upstream") & ~platform.isin(landing)
    facts = sub.groupBy("profile", "scope_id").agg(
        F.sum(one).alias("reached"),
        count_rows(other, one).alias("edges"),
        count_rows(other & (provenance == "parsed"), one).alias("parsed_edges"),
        count_rows(other & (provenance == "inferred"), one).alias("inferred_edges"),
        count_rows(is_orphan, one).alias("orphans"),
        F.array_sort(F.collect_set(F.when(other, platform))).alias("consumer_platforms"),
    )
    if orphans is None:
        return facts
    counted = orphans.groupBy("profile", "scope_id").agg(F.count(F.lit(1)).alias("orphans"))
    return facts.drop("orphans").join(counted, ["profile", "scope_id"], "left").withColumn(
        "orphans", F.coalesce("orphans", F.lit(0))
    )


def _spot(ord_: int, description: Column, blocks: bool) -> Column:
    return F.struct(
        F.lit(ord_).alias("ord"), description.alias("description"),
        F.lit(None).cast("string").alias("platform"), F.lit(blocks).alias("blocks"),
    )


def _only_if(condition: Column, spot: Column) -> Column:
    none = F.array().cast(SPOT_TYPE)
    return F.when(condition, F.array(spot).cast(SPOT_TYPE)).otherwise(none)


def coverage(
    targets: DataFrame,
    facts: DataFrame,
    registry: DataFrame,
    profiles: list[str],
    threshold: float = COVERAGE_THRESHOLD,
) -> DataFrame:
    """One row per profile and target: score, counts, blind spots and the gate.

    Unresolved and ambiguous targets have no facts and keep a row with zero reach. The registry
    summary has one row per profile, so broadcasting it is bounded by the profile list.
    """
    per_profile = targets.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in profiles])))
    joined = per_profile.join(facts, ["profile", "scope_id"], "left").join(
        F.broadcast(registry_summary(registry)), "profile", "left"
    )
    zero = F.lit(0)
    counted = joined.select(
        "profile", *targets.columns,
        *[F.coalesce(c, zero).alias(c)
          for c in ("reached", "edges", "parsed_edges", "inferred_edges", "orphans")],
        F.coalesce("consumer_platforms", F.array().cast("array<string>")).alias("consumer_platforms"),
        F.coalesce("expected_nodes", F.lit(1)).alias("expected_nodes"),
        F.coalesce("dark_nodes", zero).alias("dark_nodes"),
        F.coalesce("platform_spots", F.array().cast(SPOT_TYPE)).alias("platform_spots"),
        F.col("platform_spots").isNull().alias("registry_missing"),
    )
    observable = 1.0 - F.col("dark_nodes") / F.col("expected_nodes")
    ratio = F.coalesce(F.try_divide("parsed_edges", "edges"), F.lit(0.0))
    reach = F.when(F.col("reached") >= MIN_REACH, 1.0).otherwise(0.0)
    scored = counted.select(
        "*",
        observable.alias("observable"),
        F.round(ratio, 3).alias("parsed_edge_ratio"),
        reach.alias("reach"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), observable * ratio * reach)), 3).alias("score"),
        F.concat(
            "platform_spots",
            _only_if(
                F.col("orphans") > 0,
                _spot(2, F.format_string("%d reached entities have no recorded origin", "orphans"), False),
            ),
            _only_if(
                F.col("candidates") > 1,
                _spot(3, F.format_string("the name matches %d entities; the target is undecided",
                                         "candidates"), True),
            ),
            _only_if(
                F.col("inferred_edges") > 0,
                _spot(4, F.format_string("%d lineage edges are guesses nobody has confirmed",
                                         "inferred_edges"), False),
            ),
        ).alias("spots"),
    )
    blocking = F.filter("spots", lambda s: s["blocks"])
    return scored.select(
        "*",
        F.lit(threshold).alias("threshold"),
        ((F.col("score") >= threshold) & (F.size(blocking) == 0)).alias("gate_passed"),
    ).drop("platform_spots")


def spot_rows(covered: DataFrame) -> DataFrame:
    """Blind spots as rows, in their fixed order."""
    return covered.select(
        "profile", "scope_id", "model", "column", F.explode("spots").alias("s")
    ).select("profile", "scope_id", "model", "column", "s.ord", "s.description", "s.platform", "s.blocks")


def with_override(reviewed: DataFrame, overrides: DataFrame) -> DataFrame:
    """An override counts only where a reason is given and the gate had failed.

    Of several reasons for a change the first in the alphabet is recorded.
    """
    given = overrides.filter(F.coalesce("reason", F.lit("")) != "")
    reasons = given.groupBy("change_id").agg(F.min("reason").alias("_reason"))
    overridden = F.col("_reason").isNotNull() & ~F.col("gate_passed")
    return (
        reviewed.join(reasons, "change_id", "left")
        .withColumn("overridden", overridden)
        .withColumn("override_reason", F.when(overridden, F.col("_reason")))
        .withColumn("may_assert_safe", F.col("gate_passed") | overridden)
        .drop("_reason")
    )


def registry_warnings(registry: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles without any registry row read as fully covered; say so."""
    return (
        profiles.select("profile")
        .join(registry.select("profile").distinct(), "profile", "left_anti")
        .withColumn("warning", F.lit("no registry rows: coverage is not measurable"))
    )


def joined_descriptions(spots: Column) -> Column:
    """All spot texts in order, joined by '; '. Spots are bounded by platforms plus three."""
    return F.array_join(F.transform(spots, lambda s: s["description"]), "; ")


def spot_platforms(spots: Column, blocking_only: bool = False) -> Column:
    """Platforms named by the spots, sorted, duplicates kept."""
    named = F.filter(spots, lambda s: s["platform"].isNotNull())
    if blocking_only:
        named = F.filter(named, lambda s: s["blocks"])
    return F.array_sort(F.transform(named, lambda s: s["platform"]))
