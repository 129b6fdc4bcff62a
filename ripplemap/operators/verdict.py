"""Verdicts for changes and explicit impact rows.

A verdict needs only the counters of its scope, so nothing is exploded to reach it; impact rows
are a separate output for those who want the list.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions import constants as K
from ripplemap.functions.text import dotted
from ripplemap.functions.urn import urn_name, urn_platform
from ripplemap.operators.coverage import joined_descriptions
from ripplemap.operators.skew import ROWS_PER_SHARD, crowded_keys, hot_keys, join_split

_TARGET = ["model", "column_key"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("column_key", F.coalesce("column", F.lit("")))


def hot_targets(targets: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    keyed = targets.select("model", F.col("column").alias("column_key"), "n_changes")
    return hot_keys(keyed, _TARGET, "n_changes", rows_per_shard)


def hot_scopes(sub: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    return crowded_keys(sub, ["profile", "scope_id"], rows_per_shard)


def changes_with(changes: DataFrame, per_target: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Changes joined with per-target rows; targets behind very many changes are spread out."""
    right = _keyed(per_target).drop("column", "n_changes")
    return join_split(_keyed(changes), right, hot, _TARGET, "change_id").drop("column_key")


def tier_of_kind(kind: Column, judged: Column | None = None) -> Column:
    """Tier for a consumed change: fixed by kind, else the judge's answer, else touches."""
    fixed = reduce(
        lambda acc, kv: acc.when(kind == kv[0], kv[1]),
        list(K.TIER_BY_KIND.items())[1:],
        F.when(kind == next(iter(K.TIER_BY_KIND)), next(iter(K.TIER_BY_KIND.values()))),
    )
    other = F.lit(K.TOUCHES) if judged is None else F.coalesce(judged_tier(judged), F.lit(K.TOUCHES))
    return F.coalesce(fixed, other)


def judged_tier(answer: Column) -> Column:
    upper = F.upper(answer)
    return F.when(F.contains(upper, F.lit("BREAKS")), K.BREAKS).when(
        F.contains(upper, F.lit("DEGRADES")), K.DEGRADES
    ).otherwise(F.when(answer.isNotNull(), K.TOUCHES))


def judged_text(answer: Column, characters: int | None = None) -> Column:
    text = F.trim(answer)
    return text if characters is None else F.substring(text, 1, characters)


def severity(tier: Column) -> Column:
    order = list(K.SEVERITY)
    out = F.when(tier == order[0], K.SEVERITY[order[0]])
    for name in order[1:]:
        out = out.when(tier == name, K.SEVERITY[name])
    return out


def tier_of_severity(rank: Column) -> Column:
    out = F.when(rank == K.SEVERITY[K.BREAKS], K.BREAKS)
    for name in (K.DEGRADES, K.TOUCHES):
        out = out.when(rank == K.SEVERITY[name], name)
    return out.otherwise(K.SAFE)


def is_intrinsic(kind: Column) -> Column:
    return kind.isin(*K.INTRINSICALLY_SAFE)


def verdicts(reviewed: DataFrame, judge_column: str | None = None) -> DataFrame:
    """Overall tier under the coverage gate, one row per profile and change.

    ``reviewed`` holds changes with coverage and override columns. Consumers are all kept entities
    but the root, upstream ones included.
    """
    kind = F.col("kind")
    consumers = F.greatest(F.col("reached") - 1, F.lit(0))
    intrinsic = is_intrinsic(kind)
    judged = F.col(judge_column) if judge_column else None
    impacted = F.when(intrinsic, 0).otherwise(consumers).cast("bigint")
    tier = F.when(impacted > 0, tier_of_kind(kind, judged)).otherwise(K.SAFE)
    held_back = (tier == K.SAFE) & ~F.col("may_assert_safe") & ~intrinsic
    texts = joined_descriptions(F.col("spots"))
    reasoning = (
        F.when(held_back, F.concat(
            F.lit("nothing found, yet safety cannot be claimed: "),
            F.coalesce(F.nullif(texts, F.lit("")), F.lit("coverage is under the threshold")),
        ))
        .when(intrinsic, F.concat(kind, F.lit(" only widens what readers may see")))
        .when(impacted == 0, F.lit("no consumer was reached"))
        .when((kind == K.LOGIC) & (judged.isNull() if judge_column else F.lit(True)),
              F.lit("logic change without a judge"))
        .otherwise(F.lit(""))
    )
    return reviewed.select(
        "*",
        consumers.cast("bigint").alias("consumers"),
        impacted.alias("impacted"),
        tier.alias("tier"),
        F.when(held_back, K.TOUCHES).otherwise(tier).alias("overall"),
        held_back.alias("abstained"),
        reasoning.alias("reasoning"),
    )


LIST = ["profile", "scope_id", "tier"]


def scope_entries(verdict_rows: DataFrame, sub: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Impacted entities of each scope and tier that some change refers to, with explanations.

    Changes of one scope and tier have the same list, so it is made once, however many they are;
    ``entries`` is its length. ``hot`` scopes with very many entities are spread out.
    """
    wanted = verdict_rows.filter(F.col("impacted") > 0).select(*LIST, "model", "column", "impacted").distinct()
    joined = join_split(sub.filter(F.col("hop") > 0), wanted, hot, LIST[:2], "urn")
    target = dotted(F.col("model"), F.col("column"))
    where = F.format_string("%s, hop %d", "direction", "hop")
    name = urn_name(F.col("urn"))
    why = (
        F.when(F.col("tier") == K.BREAKS,
               F.format_string("%s refers to %s (%s) and will no longer resolve", name, target, where))
        .when(F.col("tier") == K.DEGRADES,
              F.format_string("%s reads %s (%s); it keeps running with changed values", name, target, where))
        .otherwise(F.format_string("%s lies in reach of %s (%s)", name, target, where))
    )
    return joined.select(
        *LIST, "urn", name.alias("name"), urn_platform(F.col("urn")).alias("platform"), "direction", "hop",
        why.alias("why"), F.col("impacted").alias("entries"),
    )


def hot_lists(entries: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    return crowded_keys(entries, LIST, rows_per_shard)


def impact_rows(
    verdict_rows: DataFrame,
    entries: DataFrame,
    hot: DataFrame | None = None,
    judge_column: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every impacted entity of every change with tier and explanation: ``scope_entries`` exploded.

    ``hot`` comes from ``hot_lists``. ``carry`` names change columns to keep on every row, which saves
    joining them back by change.
    """
    judge = [judge_column] if judge_column else []
    own = dict.fromkeys([*LIST, "change_id", "kind", *judge, *carry])
    wanted = verdict_rows.filter(F.col("impacted") > 0).select(*own)
    joined = join_split(entries.drop("entries"), wanted, hot, LIST, "urn")
    why = F.col("why")
    if judge_column:
        text = judged_text(F.col(judge_column), K.JUDGE_CHARS)
        why = F.when(F.col("kind") == K.LOGIC, F.coalesce(text, why)).otherwise(why)
    return joined.select(
        "profile", "change_id", "scope_id", "urn", "name", "platform", "direction", "hop", "tier",
        why.alias("why"), *carry,
    )


def worst_tier(impacts: DataFrame) -> DataFrame:
    """Worst tier per change, from impact rows."""
    return impacts.groupBy("profile", "change_id").agg(
        tier_of_severity(F.max(severity(F.col("tier")))).alias("overall"),
        F.count(F.lit(1)).alias("impacted"),
    )
