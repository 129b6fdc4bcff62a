"""Diff parsing, verdict, remediation and check queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.bridge.ctes import replace_first_sql, replace_words_sql
from ripplemap.bridge.registry import query
from ripplemap.bridge.tables import Driver
from ripplemap.functions import constants as K
from ripplemap.functions.text import replace_first_word, replace_words
from ripplemap.operators import changes as chg
from ripplemap.operators import rewrite, verdict

_CHANGE = 'diff_id, model, kind, "column", new_value, ord'


@query(
    "d1_model_names",
    "SELECT diff_id, nullif(regexp_extract(text, '[+-]{3} [ab]/.*/(\\w+)\\.sql', 1), '') AS model FROM fx_diffs",
)
def _(d: Driver) -> DataFrame:
    return chg.model_names(d.diffs())


@query("d2_changed_lines", "SELECT diff_id, model, side, body FROM fx_diff_lines")
def _(d: Driver) -> DataFrame:
    return chg.diff_lines(d.diffs())


@query("d3_renames", f"SELECT {_CHANGE} FROM fx_renames")
def _(d: Driver) -> DataFrame:
    return chg.renames(d.diffs())


@query("d4_type_changes", f"SELECT {_CHANGE} FROM fx_casts")
def _(d: Driver) -> DataFrame:
    return chg.type_changes(d.diffs())


@query("d5_bare_columns", 'SELECT diff_id, model, side, "column" FROM fx_bare')
def _(d: Driver) -> DataFrame:
    return chg.bare_columns(d.diffs())


@query("d6_column_sets", f"SELECT {_CHANGE} FROM fx_column_sets")
def _(d: Driver) -> DataFrame:
    return chg.column_set_changes(d.diffs())


@query("d7_logic_fallback", f"SELECT {_CHANGE} FROM fx_diff_changes WHERE ord = 4")
def _(d: Driver) -> DataFrame:
    return chg.logic_fallback(d.diffs())


@query("d8_changes", f"SELECT {_CHANGE} FROM fx_diff_changes")
def _(d: Driver) -> DataFrame:
    return chg.changes_from_diffs(d.diffs())


# --- verdict --------------------------------------------------------------


@query("i1_consumers", "SELECT profile, change_id, consumers FROM fx_verdicts")
def _(d: Driver) -> DataFrame:
    return d.review().verdicts.select("profile", "change_id", "consumers")


@query(
    "i2_intrinsically_safe",
    "SELECT profile, change_id, kind, impacted, overall, abstained FROM fx_verdicts WHERE intrinsic",
)
def _(d: Driver) -> DataFrame:
    rows = d.review().verdicts.filter(verdict.is_intrinsic(F.col("kind")))
    return rows.select("profile", "change_id", "kind", "impacted", "overall", "abstained")


@query(
    "i3_no_consumers",
    "SELECT profile, change_id, tier, overall FROM fx_verdicts WHERE NOT intrinsic AND consumers = 0",
)
def _(d: Driver) -> DataFrame:
    rows = d.review().verdicts.filter(
        ~verdict.is_intrinsic(F.col("kind")) & (F.col("consumers") == 0)
    )
    return rows.select("profile", "change_id", "tier", "overall")


@query(
    "i4_tier_by_kind",
    """SELECT profile, change_id, urn, tier FROM fx_impacts
WHERE kind IN ('column_renamed', 'column_dropped', 'type_narrowed')""",
)
def _(d: Driver) -> DataFrame:
    r = d.review()
    rows = r.impacts_of(r.verdicts.filter(F.col("kind").isin(*K.TIER_BY_KIND)))
    return rows.select("profile", "change_id", "urn", "tier")


@query("i5_explanations", "SELECT profile, change_id, urn, why FROM fx_impacts")
def _(d: Driver) -> DataFrame:
    return d.review().impacts.select("profile", "change_id", "urn", "why")


@query(
    "i6_unjudged_logic",
    "SELECT profile, change_id, urn, tier FROM fx_impacts WHERE kind = 'logic_changed'",
)
def _(d: Driver) -> DataFrame:
    r = d.review()
    rows = r.impacts_of(r.verdicts.filter(F.col("kind") == K.LOGIC))
    return rows.select("profile", "change_id", "urn", "tier")


@query(
    "i7_judged_logic",
    """SELECT profile, change_id, tier, overall, substring(trim(answer), 1, 300) AS answer_text
FROM fx_judged WHERE kind = 'logic_changed'""",
)
def _(d: Driver) -> DataFrame:
    rows = d.review(judge_column="answer").verdicts.filter(F.col("kind") == K.LOGIC)
    return rows.select(
        "profile", "change_id", "tier", "overall", verdict.judged_text(F.col("answer"), K.JUDGE_CHARS).alias("answer_text")
    )


@query(
    "i8_worst_tier",
    "SELECT profile, change_id, tier AS overall, impacted FROM fx_verdicts WHERE impacted > 0",
)
def _(d: Driver) -> DataFrame:
    return verdict.worst_tier(d.review().impacts)


@query(
    "i9_ceiling",
    """SELECT profile, change_id, overall, abstained,
  CASE WHEN abstained THEN 'nothing found, yet safety cannot be claimed: '
      || coalesce(nullif(array_to_string(texts, '; '), ''), 'coverage is under the threshold')
    WHEN intrinsic THEN kind || ' only widens what readers may see'
    WHEN impacted = 0 THEN 'no consumer was reached'
    WHEN kind = 'logic_changed' THEN 'logic change without a judge' ELSE '' END AS reasoning
FROM fx_verdicts""",
)
def _(d: Driver) -> DataFrame:
    return d.review().verdicts.select("profile", "change_id", "overall", "abstained", "reasoning")


# --- remediation ----------------------------------------------------------


@query("m1_outcome", "SELECT profile, change_id, overall, outcome FROM fx_outcomes")
def _(d: Driver) -> DataFrame:
    return d.review().verdicts.select("profile", "change_id", "overall", "outcome")


@query(
    "m2_strategy",
    """SELECT profile, change_id, strategy, array_to_string(alternatives, ', ') AS alternatives FROM fx_outcomes
WHERE made""",
)
def _(d: Driver) -> DataFrame:
    rows = d.review().verdicts.filter(F.col("outcome") == "generate")
    return rows.select(
        "profile", "change_id", "strategy", F.array_join("alternatives", ", ").alias("alternatives")
    )


@query("m3_edits", "SELECT profile, change_id, name, path, modified FROM fx_edits")
def _(d: Driver) -> DataFrame:
    return d.review().edits.select("profile", "change_id", "name", "path", "modified")



@query(
    "m4_rewrite_words",
    f"SELECT doc_id, md5({replace_words_sql('text', chr(39) + 'the' + chr(39), chr(39) + 'thx' + chr(39))}) AS digest "
    "FROM documents",
)
def _(d: Driver) -> DataFrame:
    sql = replace_words(F.col("sql_text"), F.lit("the"), F.lit("thx"))
    return d.document_sources().select("doc_id", F.md5(sql).alias("digest"))


@query(
    "m5_compatibility_alias",
    f"SELECT doc_id, md5({replace_first_sql('text', chr(39) + 'the' + chr(39), chr(39) + 'thx as the' + chr(39))}) "
    "AS digest FROM documents",
)
def _(d: Driver) -> DataFrame:
    sql = rewrite.rewrite_sql(
        F.col("sql_text"), F.lit(K.COMPATIBILITY_ALIAS), F.lit("the"), F.lit("thx")
    )
    return d.document_sources().select("doc_id", F.md5(sql).alias("digest"))


@query(
    "m6_changed_files",
    f"""SELECT * FROM (
  SELECT doc_id, md5({replace_words_sql('text', chr(39) + 'the' + chr(39), chr(39) + 'thx' + chr(39))}) AS digest, text
  FROM documents) WHERE digest <> md5(text)""".replace("SELECT * FROM", "SELECT doc_id, digest FROM", 1),
)
def _(d: Driver) -> DataFrame:
    """Every document breaks itself; drops and changes without a new name leave no edit."""
    docs = d.document_sources()
    impacts = docs.select(
        F.explode(F.array(F.lit(K.UPDATE_REFERENCES), F.lit(K.TWO_PHASE_DEPRECATE))).alias("strategy"),
        F.lit("covered").alias("profile"), F.col("doc_id").alias("change_id"), "name",
        F.lit("doc").alias("platform"), F.lit(K.BREAKS).alias("tier"), F.lit("generate").alias("outcome"),
        F.lit("the").alias("column"), F.lit("thx").alias("new_value"), F.lit(1).alias("impacted"),
    )
    edits = rewrite.edit_rows(impacts, docs, "doc")
    return edits.select(F.col("change_id").alias("doc_id"), F.md5("modified").alias("digest"))


@query("m7_fix_counts", "SELECT profile, change_id, fixed, total, elsewhere FROM fx_decisions WHERE made")
def _(d: Driver) -> DataFrame:
    rows = d.review().decisions.filter(F.col("outcome") == "generate")
    return rows.select("profile", "change_id", "fixed", "total", "elsewhere")


@query("m8_rationale", "SELECT profile, change_id, rationale FROM fx_decisions")
def _(d: Driver) -> DataFrame:
    return d.review().decisions.select("profile", "change_id", "rationale")


@query("m9_escalation", "SELECT profile, change_id, escalation FROM fx_decisions WHERE escalation IS NOT NULL")
def _(d: Driver) -> DataFrame:
    rows = d.review().decisions.filter(F.col("escalation").isNotNull())
    return rows.select("profile", "change_id", "escalation")


@query("m10_blocked_reason", "SELECT profile, change_id, blocked_reason FROM fx_outcomes WHERE is_blocked")
def _(d: Driver) -> DataFrame:
    rows = d.review().verdicts.filter("is_blocked")
    return rows.select("profile", "change_id", "blocked_reason")


@query(
    "m11_apply_change",
    f"""SELECT c.change_id, s.name, s.path, {replace_first_sql("s.sql_text", 'c."column"', 'c."column" || \' as \' || c.new_value')}
  AS modified FROM fx_changes c JOIN fx_sources s ON s.name = c.model
WHERE c."column" IS NOT NULL AND c.new_value IS NOT NULL""",
)
def _(d: Driver) -> DataFrame:
    return rewrite.apply_change(d.sources(), d.changes())


@query(
    "m11_apply_to_documents",
    f"SELECT doc_id, md5({replace_first_sql('text', chr(39) + 'de' + chr(39), chr(39) + 'de as du' + chr(39))}) AS digest "
    "FROM documents",
)
def _(d: Driver) -> DataFrame:
    sql = replace_first_word(F.col("sql_text"), F.lit("de"), F.lit("de as du"))
    return d.document_sources().select("doc_id", F.md5(sql).alias("digest"))


@query("m12_last_attempt", "SELECT * FROM fx_last")
def _(d: Driver) -> DataFrame:
    return rewrite.last_attempt_passed(d.attempts(), ["change_id"])


@query(
    "m13_first_marker",
    """SELECT attempt, CASE WHEN contains(output, 'Referenced column') THEN 'Referenced column'
  WHEN contains(output, 'column not found') THEN 'column not found'
  WHEN contains(output, 'Binder Error') THEN 'Binder Error' END AS marker FROM fx_attempts""",
)
def _(d: Driver) -> DataFrame:
    return d.attempts().select("attempt", rewrite.first_marker(F.col("output")).alias("marker"))


@query("m14_output_tail", "SELECT doc_id, right(text, 2000) AS tail FROM documents")
def _(d: Driver) -> DataFrame:
    return d.table("documents").select("doc_id", rewrite.output_tail(F.col("text")).alias("tail"))
