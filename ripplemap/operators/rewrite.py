"""Remediation: outcome ladder, SQL rewrites on model sources, check results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions import constants as K
from ripplemap.functions.text import replace_first_word, replace_words
from ripplemap.operators.coverage import joined_descriptions


def outcome(overall: Column, may_assert_safe: Column, kind: Column) -> Column:
    """First rule that applies decides."""
    return (
        F.when(overall == K.SAFE, "no_op_safe")
        .when(~may_assert_safe, "blocked")
        .when(overall == K.TOUCHES, "no_op_touches")
        .when(~kind.isin(*K.STRATEGY_BY_KIND), "escalate")
        .otherwise("generate")
    )


def strategy(kind: Column) -> Column:
    out = None
    for name, (chosen, _) in K.STRATEGY_BY_KIND.items():
        out = F.when(kind == name, chosen) if out is None else out.when(kind == name, chosen)
    return out.otherwise(K.UPDATE_REFERENCES)


def alternatives(kind: Column) -> Column:
    out = None
    for name, (_, others) in K.STRATEGY_BY_KIND.items():
        listed = F.array(*[F.lit(o) for o in others])
        out = F.when(kind == name, listed) if out is None else out.when(kind == name, listed)
    return out.otherwise(F.array().cast("array<string>"))


def rewrite_sql(sql: Column, chosen: Column, old: Column, new: Column) -> Column:
    """Update every reference, alias the first one, or leave the text as it is."""
    usable = (F.coalesce(old, F.lit("")) != "") & (F.coalesce(new, F.lit("")) != "")
    return (
        F.when(usable & (chosen == K.UPDATE_REFERENCES), replace_words(sql, old, new))
        .when(
            usable & (chosen == K.COMPATIBILITY_ALIAS),
            replace_first_word(sql, old, F.concat(new, F.lit(" as "), old)),
        )
        .otherwise(sql)
    )


def apply_change(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """The proposed change on its own model: first reference becomes ``old as new``."""
    wanted = changes.filter(F.col("column").isNotNull() & F.col("new_value").isNotNull()).select(
        "change_id", F.col("model").alias("name"), "column", "new_value"
    )
    aliased = F.concat(F.col("column"), F.lit(" as "), F.col("new_value"))
    return sources.join(wanted, "name").select(
        "change_id",
        "name",
        "path",
        replace_first_word(F.col("sql_text"), F.col("column"), aliased).alias("modified"),
    )


def with_outcome(verdict_rows: DataFrame) -> DataFrame:
    """Outcome, strategy and held reason; a projection, so it can run before any impact row exists."""
    kind = F.col("kind")
    rows = verdict_rows.withColumn(
        "outcome", outcome(F.col("overall"), F.col("may_assert_safe"), kind)
    )
    made = F.col("outcome") == "generate"
    blocked = F.col("outcome") == "blocked"
    total = F.when(made & (F.col("tier") == K.BREAKS), F.col("impacted")).otherwise(0)
    return rows.select(
        "*",
        blocked.alias("is_blocked"),
        F.when(made, strategy(kind)).otherwise(K.UPDATE_REFERENCES).alias("strategy"),
        F.when(made, alternatives(kind)).otherwise(F.array().cast("array<string>")).alias("alternatives"),
        total.cast("bigint").alias("total"),
        F.when(
            blocked,
            F.format_string(
                "coverage %s does not carry a fix: %s",
                F.col("score").cast("string"), joined_descriptions(F.col("spots")),
            ),
        ).alias("blocked_reason"),
    )


EDIT_CARRY = ("outcome", "strategy", "column", "new_value", "impacted")


def edit_rows(impacts: DataFrame, sources: DataFrame, platform: str) -> DataFrame:
    """Changed files only: breaking impacts on the model platform that have a source.

    ``impacts`` carry ``EDIT_CARRY``. The substring test runs before any regex.
    """
    assets = impacts.filter(
        (F.col("outcome") == "generate")
        & (F.col("tier") == K.BREAKS)
        & (F.col("platform") == platform)
        & F.col("column").isNotNull()
        & F.col("new_value").isNotNull()
    ).select("profile", "change_id", "name", "strategy", "column", "new_value", "impacted")
    modified = rewrite_sql(F.col("sql_text"), F.col("strategy"), F.col("column"), F.col("new_value"))
    return (
        assets.join(sources.select("name", "path", "sql_text"), "name")
        .filter(F.contains("sql_text", "column"))
        .select(
            "profile", "change_id", "impacted", "name", "path",
            F.col("sql_text").alias("original"), modified.alias("modified"),
        )
        .filter(F.col("original") != F.col("modified"))
    )


def with_fix_counts(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Repaired and remaining counts, rationale and escalation.

    Counts what was rewritten, not what was found.
    """
    counts = edits.groupBy("profile", "change_id").agg(F.count(F.lit(1)).alias("_fixed"))
    made = F.col("outcome") == "generate"
    chosen = F.col("strategy")
    elsewhere = F.col("total") - F.col("fixed")
    rest = F.when(elsewhere > 0, F.format_string("; %d are kept in other systems", elsewhere)).otherwise("")
    rationale = (
        F.when(F.col("outcome") == "no_op_safe", "nothing breaks, nothing to write")
        .when(F.col("outcome") == "no_op_touches", "assets are touched but none breaks")
        .when(F.col("outcome") == "escalate", F.concat(F.lit("no template for "), F.col("kind")))
        .when(made & (chosen == K.UPDATE_REFERENCES), F.concat(
            F.format_string("%d of %d broken references are rewritten here in one step",
                            "fixed", "total"), rest))
        .when(made & (chosen == K.COMPATIBILITY_ALIAS), "readers keep the old name as an alias meanwhile")
        .when(made, "the new form comes first, readers move over, then the old form goes")
    )
    spans = F.array_join("consumer_platforms", ", ")
    escalation = F.when(F.col("outcome") == "escalate", "a person has to judge this kind of change").when(
        made & (F.col("impacted") > 0) & (F.size("consumer_platforms") > 1),
        F.format_string("assets on %s are hit; their owners must agree on the timing", spans),
    )
    return (
        rows.join(counts, ["profile", "change_id"], "left")
        .withColumn("fixed", F.coalesce("_fixed", F.lit(0)))
        .withColumn("elsewhere", elsewhere)
        .withColumn("rationale", rationale)
        .withColumn("escalation", escalation)
        .drop("_fixed")
    )


def last_attempt_passed(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Passed when the last attempt ended with exit code 0."""
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        (F.max_by("exit_code", "attempt") == 0).alias("passed"),
    )


def first_marker(output: Column) -> Column:
    """First known error marker in list order, null when none occurs."""
    return F.coalesce(*[F.when(F.contains(output, F.lit(m)), m) for m in K.ERROR_MARKERS])


def output_tail(output: Column) -> Column:
    return F.right(output, F.lit(K.OUTPUT_TAIL))
