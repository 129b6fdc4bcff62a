"""Review and refusal documents as rows, one per line.

A document of a change that hits very many assets is long; keeping lines as rows
(profile, change_id, section, key, line) lets Spark sort and write it without ever building the
text in one task. ``section`` and ``key`` give the reading order.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions.text import dotted, file_stem
from ripplemap.operators.coverage import spot_platforms

_ID = ["profile", "change_id"]
REPORT_CARRY = ("is_blocked",)


def completeness_line(impacted: Column, spots: Column) -> Column:
    """Exact count when nothing blocks the view, else a lower bound naming the dark platforms."""
    dark = F.array_distinct(spot_platforms(spots, blocking_only=True))
    blocking = F.filter(spots, lambda s: s["blocks"])
    who = F.when(F.size(dark) == 0, "an undecided target").otherwise(F.array_join(dark, ", "))
    verb = F.when(F.size(dark) > 1, "have").otherwise("has")
    return F.when(
        F.size(blocking) == 0,
        F.format_string("Affected assets: %d, and the list is complete.", impacted),
    ).otherwise(
        F.format_string(
            "Affected assets: at least %d. %s %s no visible lineage, so more may exist.",
            impacted, who, verb,
        )
    )


def percent(ratio: Column) -> Column:
    return F.concat(F.round(ratio * 100).cast("bigint").cast("string"), F.lit("%"))


def coverage_lines(decision_rows: DataFrame) -> DataFrame:
    """Reached, declared and parsed share, then blocking and merely noted spots."""
    return _explode(decision_rows, _coverage_structs())


def _line(section: int, key: str, text: Column, when: Column | None = None) -> Column:
    row = F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), text.alias("line"))
    return row if when is None else F.when(when, row)


def _spot_lines(section: int, blocking: bool, lead: str) -> Column:
    chosen = F.filter("spots", lambda s: s["blocks"] == F.lit(blocking))
    return F.transform(
        chosen,
        lambda s: F.struct(
            F.lit(section).alias("section"),
            F.concat(s["ord"].cast("string"), F.lit("/"), s["description"]).alias("key"),
            F.concat(F.lit(lead), s["description"]).alias("line"),
        ),
    )


def _coverage_structs() -> Column:
    heads = F.array(
        _line(90, "", F.format_string("Reached %d of %d declared entities.", "reached", "expected_nodes")),
        _line(91, "", F.format_string("Parsed share of lineage edges: %s.", percent(F.col("parsed_edge_ratio")))),
    )
    return F.concat(heads, _spot_lines(92, True, "May hide consumers: "), _spot_lines(93, False, "Noted: "))


def _explode(rows: DataFrame, structs: Column) -> DataFrame:
    return rows.select(*_ID, "is_blocked", F.explode(structs).alias("l")).select(
        *_ID, "is_blocked", "l.section", "l.key", "l.line"
    )


def impact_lines(impacts: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """One line per impacted asset; unblocked changes say whether it is fixed here.

    ``impacts`` carry ``REPORT_CARRY``. Fixed means an edit whose file stem is the asset's name.
    """
    asset = F.format_string("%s %s:%s", "tier", "platform", "name")
    if edits is None:
        flagged = impacts.withColumn("fixed_here", F.lit(False))
    else:
        stems = edits.select(*_ID, file_stem(F.col("path")).alias("name")).distinct()
        flagged = impacts.join(stems.withColumn("_f", F.lit(True)), [*_ID, "name"], "left").withColumn(
            "fixed_here", F.coalesce("_f", F.lit(False))
        )
    suffix = F.when(F.col("is_blocked"), "").otherwise(
        F.when(F.col("fixed_here"), ", fixed here").otherwise(", kept elsewhere")
    )
    return flagged.select(
        *_ID, "is_blocked", F.lit(40).alias("section"), F.col("urn").alias("key"),
        F.concat(asset, suffix).alias("line"), "fixed_here",
    )


def review_lines(decision_rows: DataFrame) -> DataFrame:
    """Fixed lines of the documents of unblocked changes."""
    r = decision_rows.filter(~F.col("is_blocked"))
    target = dotted(F.col("model"), F.col("column"))
    lines = F.array(
        _line(10, "", F.concat(F.lit("# Review: "), F.translate("kind", "_", " "), F.lit(" on "), target)),
        _line(20, "", completeness_line(F.col("impacted"), F.col("spots"))),
        _line(30, "", F.format_string(
            "Gate overridden at coverage %s (threshold %s): %s", F.col("score").cast("string"),
            F.col("threshold").cast("string"), F.coalesce("override_reason", F.lit(""))),
            F.col("overridden")),
        _line(50, "", F.concat(F.lit("Fix: "), F.col("rationale"))),
        _line(60, "", F.concat(F.lit("Other ways: "), F.array_join("alternatives", ", ")),
              F.size("alternatives") > 0),
        _line(70, "", F.concat(F.lit("To decide by people: "), F.col("escalation")),
              F.col("escalation").isNotNull()),
        _line(99, "", F.format_string("Coverage %s, threshold %s.", F.col("score").cast("string"),
                                      F.col("threshold").cast("string"))),
    )
    return _explode(r, F.concat(F.array_compact(lines), _coverage_structs()))


def refusal_lines(decision_rows: DataFrame) -> DataFrame:
    """Fixed lines of the documents of held changes."""
    r = decision_rows.filter("is_blocked")
    target = dotted(F.col("model"), F.col("column"))
    lines = F.array(
        _line(10, "", F.concat(F.lit("# Held: "), target)),
        _line(20, "", F.lit("No fix was written: what can be seen is not the whole picture.")),
        _line(31, "", F.concat(F.lit("Waiting for "), F.col("blocked_on"))),
        _line(32, "", F.lit("Owners who know better can override with a reason, which is recorded.")),
        _line(45, "", F.lit("The assets above are a lower bound."), F.col("impacted") > 0),
        _line(45, "", F.lit("Nothing was found, which does not mean that nothing exists."),
              F.col("impacted") == 0),
        _line(99, "", F.format_string("Coverage %s, threshold %s.", F.col("score").cast("string"),
                                      F.col("threshold").cast("string"))),
    )
    return _explode(r, F.concat(F.array_compact(lines), _spot_lines(30, True, "Missing: ")))


def attempt_lines(decision_rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Check attempts of unblocked changes with edits, one line each, and the closing statement.

    Nothing runs where nothing was edited, whatever attempts there are for the change.
    """
    open_rows = decision_rows.filter(~F.col("is_blocked")).select(*_ID, "fixed")
    each = open_rows.filter("fixed > 0").join(attempts, "change_id").select(
        *_ID,
        F.lit(80).alias("section"),
        F.lpad(F.col("attempt").cast("string"), 12, "0").alias("key"),
        F.concat(
            F.format_string("Attempt %d: %s ", "attempt", "command"),
            F.when(F.col("exit_code") == 0, "passed").otherwise("failed"),
        ).alias("line"),
    )
    last = attempts.groupBy("change_id").agg((F.max_by("exit_code", "attempt") == 0).alias("passed"))
    closing = open_rows.join(last, "change_id", "left").select(
        *_ID,
        F.lit(81).alias("section"),
        F.lit("").alias("key"),
        F.when(F.col("passed").isNull() | (F.col("fixed") <= 0), "No code was run.")
        .when(F.col("passed"), "The rewritten models ran.")
        .otherwise("The rewritten models did not run; they are recorded only.")
        .alias("line"),
    )
    return each.unionByName(closing).withColumn("is_blocked", F.lit(False))


def documents(
    decision_rows: DataFrame, impacts: DataFrame, edits: DataFrame, attempts: DataFrame
) -> DataFrame:
    """All lines of all documents; one document per profile and change."""
    return (
        review_lines(decision_rows)
        .unionByName(refusal_lines(decision_rows))
        .unionByName(impact_lines(impacts, edits).drop("fixed_here"))
        .unionByName(attempt_lines(decision_rows, attempts))
    )


def document_name(profile: Column, model: Column, is_blocked: Column, change_id: Column) -> Column:
    """File of a document: profile, model and outcome, and the change, since a model may have many."""
    outcome = F.when(is_blocked, "held").otherwise("review")
    return F.concat_ws("-", profile, model, outcome, change_id.cast("string"))


def document_files(lines: DataFrame, decision_rows: DataFrame) -> DataFrame:
    """Lines of documents with the ``file`` that they belong to."""
    parts = [F.col(c) for c in ("profile", "model", "is_blocked", "change_id")]
    named = decision_rows.select(*_ID, document_name(*parts).alias("file"))
    return lines.join(named, _ID).select("file", "section", "key", "line")
