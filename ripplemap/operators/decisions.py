"""Decision log: decided or held, with the fact a held one waits for."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions import constants as K
from ripplemap.functions.text import dotted
from ripplemap.operators.coverage import spot_platforms
from ripplemap.operators.verdict import LIST

IMPACTS_PER_PART = 1000
_ID = ["profile", "change_id"]


def blocked_on(spots: Column, reason: Column, characters: int | None = None) -> Column:
    """Platforms named by any spot, else the reason (its first ``characters``), else a fixed text."""
    platforms = spot_platforms(spots)
    if characters is not None:
        reason = F.substring(reason, 1, characters)
    return (
        F.when(F.size(platforms) > 0, F.concat(F.lit("lineage of: "), F.array_join(platforms, ", ")))
        .when(F.coalesce(reason, F.lit("")) != "", reason)
        .otherwise("coverage is under the threshold")
    )


def decisions(remediation_rows: DataFrame) -> DataFrame:
    """Header row of every decision; ``recorded_at`` comes with the change."""
    held = F.col("is_blocked")
    title = F.concat(
        F.when(held, "held").otherwise("assessed"), F.lit(": "), F.col("kind"), F.lit(" on "),
        dotted(F.col("model"), F.col("column")),
    )
    return remediation_rows.select(
        "*",
        F.when(held, K.DOC_DECISION).otherwise(K.DOC_ANALYSIS).alias("doc_type"),
        F.when(held, K.MARKER_HELD).otherwise(K.MARKER_RESOLVED).alias("marker"),
        title.alias("title"),
        F.when(held, blocked_on(F.col("spots"), F.col("blocked_reason"), K.BLOCKED_ON_CHARS)).alias("blocked_on"),
    )


def _part_of(n: Column, text: Column, per_part: int) -> Column:
    parts = F.greatest(F.ceil(n / per_part), F.lit(1)).cast("bigint")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % parts


def _listed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The JSON list of each part."""
    entries = F.array_sort(F.collect_list(F.struct("urn", "tier", "why")))
    return rows.groupBy(*keys, "part").agg(F.to_json(entries).alias("impacted_json"))


def entry_lists(entries: DataFrame, per_part: int = IMPACTS_PER_PART) -> DataFrame:
    """JSON lists in parts, once for each scope and tier, from ``verdict.scope_entries``."""
    part = _part_of(F.col("entries"), F.col("urn"), per_part).alias("part")
    return _listed(entries.select(*LIST, "urn", "why", part), LIST)


def body_parts(
    decision_rows: DataFrame, impacts: DataFrame, edits: DataFrame | None = None,
    checks: DataFrame | None = None, per_part: int = IMPACTS_PER_PART, lists: DataFrame | None = None,
) -> DataFrame:
    """JSON bodies of 16 keys, in as many parts as the impacted list needs.

    A change with a million impacted assets must not become one string in one task, so the list is
    dealt over parts by a hash of the urn; each part holds about ``per_part`` entries and the parts
    together hold all of them. Edits are dealt the same way. Both inputs carry ``impacted``.
    ``lists`` of ``entry_lists`` (with the same ``per_part``) serve all changes of a scope and tier;
    without them each change's list is made from its ``impacts``.
    """
    heads = decision_rows.withColumn(
        "parts", F.greatest(F.ceil(F.col("impacted") / per_part), F.lit(1)).cast("bigint")
    )
    frame = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    if lists is None:
        part = _part_of(F.col("impacted"), F.col("urn"), per_part).alias("part")
        own = _listed(impacts.select(*_ID, "urn", "tier", "why", part), _ID)
        joined = frame.join(own, [*_ID, "part"], "left")
    else:
        joined = frame.join(lists, [*LIST, "part"], "left").withColumn(
            "impacted_json", F.when(F.col("impacted") > 0, F.col("impacted_json"))
        )
    if edits is not None:
        part = _part_of(F.col("impacted"), F.col("path"), per_part).alias("part")
        paths = edits.groupBy(*_ID, part).agg(F.array_sort(F.collect_list("path")).alias("edit_paths"))
        joined = joined.join(paths, [*_ID, "part"], "left")
    else:
        joined = joined.withColumn("edit_paths", F.lit(None).cast("array<string>"))
    if checks is not None:
        joined = joined.join(checks.select(*_ID, F.col("passed").alias("verified")), _ID, "left")
    else:
        joined = joined.withColumn("verified", F.lit(None).cast("boolean"))
    empty = F.array().cast("array<string>")
    before = F.struct(
        "marker",
        F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("recorded_at"),
        F.struct("model", "kind", "column", "new_value").alias("change"),
        F.col("overall").alias("verdict"),
        "abstained",
        F.col("score").alias("coverage"),
        "may_assert_safe",
        F.transform("spots", lambda s: s["description"]).alias("blind_spots"),
        "blocked_on",
    )
    after = F.struct(
        F.col("reached").alias("subgraph_size"),
        "strategy",
        "alternatives",
        F.coalesce("edit_paths", empty).alias("edits"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.lit(None).cast("string").alias("review_url"),
    )
    options = {"ignoreNullFields": "false"}
    head = F.regexp_replace(F.to_json(before, options), r"\}\z", "")
    tail = F.regexp_replace(F.to_json(after, options), r"\A\{", "")
    body = F.concat(
        head, F.lit(',"impacted":'), F.coalesce("impacted_json", F.lit("[]")), F.lit(","), tail
    )
    return joined.select(
        *_ID, "part", "parts", "doc_type", "title", "is_blocked", body.alias("body")
    )


TAG_CARRY = ("is_blocked", "spots")


def tag_rows(impacts: DataFrame) -> DataFrame:
    """Held or verified tag per impacted entity, plus the coverage gap tag when any spot exists.

    ``impacts`` carry ``TAG_CARRY``. The verified tag goes to every change that is not blocked,
    whether or not a check ran.
    """
    tags = F.array_compact(
        F.array(
            F.when(F.col("is_blocked"), K.TAG_HELD).otherwise(K.TAG_VERIFIED),
            F.when(F.size("spots") > 0, K.TAG_COVERAGE_GAP),
        )
    )
    return impacts.select(*_ID, F.col("urn").alias("entity_urn"), F.explode(tags).alias("tag"))


def one_per_state(verdict_rows: DataFrame) -> DataFrame:
    """One change with impacts for each scope, tier and outcome. The others put the same tags on the
    same entities, so that whoever wants the different tags only need not list their impacts."""
    return verdict_rows.filter(F.col("impacted") > 0).dropDuplicates([*LIST, "is_blocked"])


def inferred_notes(star: DataFrame, upstream_name: Column) -> DataFrame:
    """A note for the downstream description of every inferred edge."""
    text = F.format_string(
        "unconfirmed dependency on %s, confidence %s; guessed from code, no parser reported it",
        upstream_name, F.col("confidence").cast("string"),
    )
    return star.filter(F.col("provenance") == "inferred").select(
        "profile", "scope_id", F.col("down_urn").alias("entity_urn"), text.alias("note")
    )


def held_queue(decision_log: DataFrame, limit: int | None = None) -> DataFrame:
    """Held decisions, oldest first: all, or the first ``limit``."""
    queue = decision_log.filter(F.col("marker") == K.MARKER_HELD).orderBy(
        "recorded_at", "change_id", "profile"
    )
    return queue if limit is None else queue.limit(limit)


def resume(held: DataFrame, reviewed_again: DataFrame) -> DataFrame:
    """Held decisions whose new review passes the gate are recorded anew, pointing at the old one."""
    waiting = held.filter("is_blocked").select(
        "change_id",
        F.format_string("%s/%d", "profile", "change_id").alias("resumed_from"),
        F.col("profile").alias("held_profile"),
    )
    passed = reviewed_again.filter("may_assert_safe")
    return passed.join(waiting, "change_id").select(
        "held_profile",
        "profile",
        "change_id",
        "overall",
        F.lit(False).alias("is_blocked"),
        F.lit(K.MARKER_RESOLVED).alias("marker"),
        F.lit(K.DOC_ANALYSIS).alias("doc_type"),
        "resumed_from",
    )


LOG = (
    "profile", "change_id", "is_blocked", "marker", "doc_type", "title", "blocked_on", "overall",
    "recorded_at", "resumed_from",
)


def decision_id() -> Column:
    return F.format_string("%s/%d", "profile", "change_id")


def log_rows(decision_rows: DataFrame) -> DataFrame:
    """Decisions as the log records them."""
    return decision_rows.withColumn("resumed_from", F.lit(None).cast("string")).select(*LOG)


def latest(log: DataFrame) -> DataFrame:
    """The latest row of every decision (``decision``): its own, or one that resumed it.

    ``log`` has ``seq``; of one batch and decision the row with the smallest profile counts.
    """
    decision = F.coalesce("resumed_from", decision_id()).alias("decision")
    row = F.struct(*log.columns).alias("row")
    order = F.struct((-F.col("row.seq")).alias("seq"), F.col("row.profile").alias("profile"))
    rows = log.select(decision, row)
    return rows.groupBy("decision").agg(F.min_by("row", order).alias("row")).select("decision", "row.*")


def resumed_rows(log: DataFrame, reviewed_again: DataFrame) -> DataFrame:
    """Whole log rows for the decisions that are held by their latest row and pass the gate now.

    They point at the decision they resume. Once appended, the decision is not held any more, so
    that resuming again gives no row.
    """
    waiting = latest(log).filter("is_blocked").select("change_id", F.col("decision").alias("resumed_from"))
    passed = reviewed_again.filter("may_assert_safe").drop("resumed_from")
    rows = passed.join(waiting, "change_id").withColumns(
        {
            "is_blocked": F.lit(False),
            "marker": F.lit(K.MARKER_RESOLVED),
            "doc_type": F.lit(K.DOC_ANALYSIS),
            "title": F.regexp_replace("title", "^held: ", "assessed: "),
            "blocked_on": F.lit(None).cast("string"),
        }
    )
    return rows.select(*LOG)


def summary_line() -> Column:
    return F.when(
        F.col("is_blocked"), F.concat(F.lit("HELD, waiting for "), F.col("blocked_on"))
    ).otherwise(
        F.format_string(
            "%s, %d impacted (%s)", F.upper("overall"), "impacted",
            F.date_format("recorded_at", "yyyy-MM-dd HH:mm"),
        )
    )
