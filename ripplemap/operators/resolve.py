"""Referent resolution: which catalog entity a change names.

Changes are first reduced to distinct targets (model, column), so a model named by many changes
is resolved, expanded and scored once.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_targets(changes: DataFrame) -> DataFrame:
    """(model, column) with a stable id and the number of changes behind it; '' means no column."""
    return changes.groupBy("model", F.coalesce("column", F.lit("")).alias("column")).agg(
        F.min("change_id").alias("scope_id"), F.count(F.lit(1)).alias("n_changes")
    )


def candidate_rows(targets: DataFrame, entities: DataFrame) -> DataFrame:
    """Every entity whose name equals a target's model exactly."""
    models = targets.select(F.col("model").alias("name")).distinct()
    return entities.join(models, "name", "left_semi").select(
        F.col("name").alias("model"), "urn", "platform"
    )


def resolve(targets: DataFrame, entities: DataFrame) -> DataFrame:
    """Three-way outcome per target: none unresolved, one resolved, more ambiguous and never a pick."""
    found = candidate_rows(targets, entities).groupBy("model").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min("urn").alias("only_urn"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
    )
    n = F.coalesce("candidates", F.lit(0))
    return targets.join(found, "model", "left").select(
        *targets.columns,
        n.alias("candidates"),
        F.coalesce("platforms", F.array().cast("array<string>")).alias("platforms"),
        F.when(n == 1, F.col("only_urn")).alias("root_urn"),
        F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("resolution"),
    )


def ambiguities(resolved: DataFrame) -> DataFrame:
    """One record per ambiguous model; candidate rows stay in ``candidate_rows``."""
    return (
        resolved.filter(F.col("resolution") == "ambiguous")
        .select("model", "candidates", F.array_join("platforms", ", ").alias("platforms"))
        .distinct()
        .withColumn(
            "reason",
            F.format_string("'%s' matches %d entities (%s)", "model", "candidates", "platforms"),
        )
    )


def with_placeholder_root(resolved: DataFrame) -> DataFrame:
    """Targets that did not resolve get a placeholder root outside the graph."""
    return resolved.select(
        "scope_id",
        "model",
        "column",
        "resolution",
        F.coalesce("root_urn", F.concat(F.lit("unresolved:"), F.col("model"))).alias("root"),
        F.when(F.col("root_urn").isNull(), "?").alias("placeholder_platform"),
    )


def scopes(resolved: DataFrame) -> DataFrame:
    """Roots to expand: (scope_id, root_urn, column)."""
    return resolved.filter(F.col("root_urn").isNotNull()).select("scope_id", "root_urn", "column")
