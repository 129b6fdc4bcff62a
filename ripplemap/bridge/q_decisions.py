"""Decision log, report and evaluation queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.bridge.ctes import NAME_OF_URN
from ripplemap.bridge.registry import query
from ripplemap.bridge.tables import PROFILES, Driver
from ripplemap.functions import constants as K
from ripplemap.operators import decisions, evaluate, expand, report
from ripplemap.functions.urn import urn_name
from ripplemap.plans.session import scratch
from ripplemap.sources import sinks


@query("x1_blocked_on", "SELECT profile, change_id, blocked_on FROM fx_decisions WHERE is_blocked")
def _(d: Driver) -> DataFrame:
    return d.review().decisions.filter("is_blocked").select("profile", "change_id", "blocked_on")


_PART = "CAST('0x' || substring(md5({text}), 1, 8) AS BIGINT) % greatest(ceil(impacted / 1000)::BIGINT, 1)"
_BODY = f"""SELECT d.profile, d.change_id, p.part, p.parts, d.doc_type, d.title, d.is_blocked, to_json({{
  'marker': d.marker, 'recorded_at': strftime(d.recorded_at, '%Y-%m-%dT%H:%M:%S'),
  'change': {{'model': d.model, 'kind': d.kind, 'column': d."column", 'new_value': d.new_value}},
  'verdict': d.overall, 'abstained': d.abstained, 'coverage': d.score, 'may_assert_safe': d.may_assert_safe,
  'blind_spots': d.texts, 'blocked_on': d.blocked_on, 'impacted': coalesce(i.entries, []),
  'subgraph_size': d.reached, 'strategy': d.strategy, 'alternatives': d.alternatives,
  'edits': coalesce(e.paths, []), 'verified': coalesce(a.passed, false), 'review_url': NULL}})::VARCHAR AS body
FROM fx_decisions d
JOIN (SELECT profile, change_id, parts, unnest(range(parts)) AS part FROM (
  SELECT profile, change_id, greatest(ceil(impacted / 1000)::BIGINT, 1) AS parts FROM fx_decisions)) p
  USING (profile, change_id)
LEFT JOIN (SELECT profile, change_id, {_PART.format(text="urn")} AS part,
  list({{'urn': urn, 'tier': tier, 'why': why}} ORDER BY urn) AS entries FROM fx_impacts GROUP BY ALL) i
  USING (profile, change_id, part)
LEFT JOIN (SELECT profile, change_id, {_PART.format(text="path")} AS part, list(path ORDER BY path) AS paths
  FROM fx_edits GROUP BY ALL) e USING (profile, change_id, part)
LEFT JOIN fx_last a ON a.change_id = d.change_id AND NOT d.is_blocked AND d.fixed > 0"""


@query("x2_decision_bodies", _BODY)
def _(d: Driver) -> DataFrame:
    return d.review().bodies


@query(
    "x3_tags",
    """SELECT profile, change_id, urn AS entity_urn, unnest(CASE WHEN n_spots > 0
    THEN [CASE WHEN is_blocked THEN 'urn:li:tag:ripplemap-held' ELSE 'urn:li:tag:ripplemap-verified' END,
      'urn:li:tag:ripplemap-coverage-gap']
    ELSE [CASE WHEN is_blocked THEN 'urn:li:tag:ripplemap-held' ELSE 'urn:li:tag:ripplemap-verified' END] END) AS tag
FROM fx_impacts""",
)
def _(d: Driver) -> DataFrame:
    return decisions.tag_rows(d.review().impacts)


@query(
    "x4_inferred_notes",
    f"""SELECT t.profile, t.scope_id, CASE t.direction WHEN 'downstream' THEN t.urn ELSE t.root_urn END AS entity_urn,
  'unconfirmed dependency on ' || CASE t.direction WHEN 'downstream' THEN {NAME_OF_URN.replace("(urn,", "(t.root_urn,")}
    ELSE {NAME_OF_URN.replace("(urn,", "(t.urn,")} END
    || ', confidence 0.5; guessed from code, no parser reported it' AS note
FROM (SELECT s.*, p.root_urn FROM fx_true_sub s JOIN fx_scopes p USING (profile, scope_id)) t
WHERE t.provenance = 'inferred'""",
)
def _(d: Driver) -> DataFrame:
    r = d.review(true_provenance=True)
    star = expand.star_edges(r.subgraph, r.scopes, true_provenance=True)
    return decisions.inferred_notes(star, urn_name(F.col("up_urn")))


@query(
    "x5_held_queue",
    """SELECT profile, change_id, marker, title, blocked_on FROM fx_decisions WHERE marker = 'ripplemap:held-decision'
ORDER BY recorded_at, change_id, profile LIMIT 50""",
)
def _(d: Driver) -> DataFrame:
    rows = decisions.held_queue(d.review().decisions, K.HELD_QUEUE_LIMIT)
    return rows.select("profile", "change_id", "marker", "title", "blocked_on")


@query(
    "x6_resume",
    """SELECT h.profile AS held_profile, n.profile, n.change_id, n.overall, false AS is_blocked,
  'ripplemap:resolved' AS marker, 'Analysis' AS doc_type, h.profile || '/' || h.change_id AS resumed_from
FROM fx_decisions h JOIN fx_decisions n ON n.change_id = h.change_id AND n.may_assert_safe
WHERE h.is_blocked AND h.profile = 'dark' AND n.profile = 'covered'""",
)
def _(d: Driver) -> DataFrame:
    """Decisions held on the dark profile, looked at again once every platform is connected."""
    log = d.review().decisions
    dark, covered = F.col("profile") == "dark", F.col("profile") == "covered"
    return decisions.resume(log.filter(dark), log.filter(covered))


_RESUMED = """SELECT n.profile, n.change_id, n.overall, false AS is_blocked, 'ripplemap:resolved' AS marker,
  'Analysis' AS doc_type, regexp_replace(n.title, '^held: ', 'assessed: ') AS title, NULL AS blocked_on,
  h.profile || '/' || h.change_id AS resumed_from, 'resume-1' AS batch
FROM fx_decisions h JOIN fx_decisions n ON n.change_id = h.change_id AND n.may_assert_safe
WHERE h.is_blocked AND h.profile = 'dark' AND n.profile = 'covered'"""
_REVIEWED = """SELECT profile, change_id, overall, is_blocked, marker, doc_type, title, blocked_on,
  NULL AS resumed_from, 'review-1' AS batch FROM fx_decisions WHERE profile = 'dark'"""


def _resumed_log(d: Driver) -> DataFrame:
    """The dark profile's decisions, resumed twice after every platform was connected."""
    rows = d.review().decisions
    held = decisions.log_rows(rows.filter(F.col("profile") == "dark"))
    again = rows.filter(F.col("profile") == "covered")
    log = sinks.DecisionLog(d.spark, scratch(d.spark, "decision_log"), held.schema)
    log.append(held, "review-1")
    for batch in ("resume-1", "resume-1", "resume-2"):
        log.append(decisions.resumed_rows(log.read(), again), batch)
    return log.read()


@query("x6_resume_log", f"{_REVIEWED} UNION ALL {_RESUMED}")
def _(d: Driver) -> DataFrame:
    return _resumed_log(d).drop("seq", "recorded_at")


@query(
    "x6_latest_decisions",
    f"""SELECT decision, is_blocked, marker, batch FROM (
  SELECT *, row_number() OVER (PARTITION BY decision ORDER BY batch = 'review-1') AS n FROM (
    SELECT *, coalesce(resumed_from, profile || '/' || change_id) AS decision FROM ({_REVIEWED} UNION ALL {_RESUMED})))
WHERE n = 1""",
)
def _(d: Driver) -> DataFrame:
    return decisions.latest(_resumed_log(d)).select("decision", "is_blocked", "marker", "batch")


@query(
    "x7_summary",
    """SELECT profile, change_id, CASE WHEN is_blocked THEN 'HELD, waiting for ' || blocked_on
  ELSE upper(overall) || ', ' || impacted || ' impacted (' || strftime(recorded_at, '%Y-%m-%d %H:%M') || ')' END AS summary
FROM fx_decisions""",
)
def _(d: Driver) -> DataFrame:
    return d.review().decisions.select("profile", "change_id", decisions.summary_line().alias("summary"))


# --- reports --------------------------------------------------------------

_COMPLETE = """CASE WHEN blocking = 0 THEN 'Affected assets: ' || impacted || ', and the list is complete.'
  ELSE 'Affected assets: at least ' || impacted || '. ' || CASE WHEN len(blocking_platforms) = 0
    THEN 'an undecided target' ELSE array_to_string(blocking_platforms, ', ') END
    || CASE WHEN len(blocking_platforms) > 1 THEN ' have' ELSE ' has' END
    || ' no visible lineage, so more may exist.' END"""


@query("p1_completeness", f"SELECT profile, change_id, {_COMPLETE} AS line FROM fx_decisions")
def _(d: Driver) -> DataFrame:
    return d.review().verdicts.select(
        "profile", "change_id", report.completeness_line(F.col("impacted"), F.col("spots")).alias("line")
    )


_IMPACT_LINE = """i.tier || ' ' || i.platform || ':' || i.name || CASE WHEN i.is_blocked THEN ''
  WHEN e.name IS NOT NULL THEN ', fixed here' ELSE ', kept elsewhere' END"""
_IMPACT_LINES = f"""SELECT i.profile, i.change_id, i.is_blocked, 40 AS section, i.urn AS key, {_IMPACT_LINE} AS line,
  e.name IS NOT NULL AS fixed_here
FROM fx_impacts i LEFT JOIN fx_edits e ON e.profile = i.profile AND e.change_id = i.change_id AND e.name = i.name"""


@query("p2_impact_table", _IMPACT_LINES)
def _(d: Driver) -> DataFrame:
    r = d.review()
    return report.impact_lines(r.impacts, r.edits)


def _spot_sql(texts: str, section: int, lead: str) -> str:
    return (
        f"SELECT profile, change_id, is_blocked, {section} AS section, unnest({texts}) AS text, '{lead}' AS lead "
        "FROM fx_decisions"
    )


_HEADS = """SELECT profile, change_id, is_blocked, 90 AS section,
  'Reached ' || reached || ' of ' || expected_nodes || ' declared entities.' AS line FROM fx_decisions
UNION ALL SELECT profile, change_id, is_blocked, 91,
  'Parsed share of lineage edges: ' || round(round(ratio, 3) * 100)::BIGINT || '%.' FROM fx_decisions"""
_COVERAGE_LINES = f"""SELECT profile, change_id, is_blocked, section, line FROM ({_HEADS})
UNION ALL SELECT profile, change_id, is_blocked, section, lead || text FROM (
  {_spot_sql("blocking_texts", 92, "May hide consumers: ")} UNION ALL {_spot_sql("noted_texts", 93, "Noted: ")})"""


@query("p3_coverage_section", _COVERAGE_LINES)
def _(d: Driver) -> DataFrame:
    lines = report.coverage_lines(d.review().verdicts)
    return lines.select("profile", "change_id", "is_blocked", "section", "line")


_TARGET = "model || coalesce('.' || \"column\", '')"
_END = "'Coverage ' || score || ', threshold 0.6.'"
_REVIEW_LINES = f"""SELECT profile, change_id, section, line FROM (
  SELECT profile, change_id, unnest([10, 20, 30, 50, 60, 70, 99]) AS section, unnest([
    '# Review: ' || replace(kind, '_', ' ') || ' on ' || {_TARGET}, {_COMPLETE},
    CASE WHEN overridden THEN 'Gate overridden at coverage ' || score || ' (threshold 0.6): ' || override_reason END,
    'Fix: ' || rationale,
    CASE WHEN len(alternatives) > 0 THEN 'Other ways: ' || array_to_string(alternatives, ', ') END,
    'To decide by people: ' || escalation, {_END}]) AS line
  FROM fx_decisions WHERE NOT is_blocked) WHERE line IS NOT NULL
UNION ALL SELECT profile, change_id, section, line FROM ({_COVERAGE_LINES}) WHERE NOT is_blocked
UNION ALL SELECT profile, change_id, section, line FROM ({_IMPACT_LINES}) WHERE NOT is_blocked
UNION ALL SELECT d.profile, d.change_id, 80, 'Attempt ' || a.attempt || ': ' || a.command
  || CASE WHEN a.exit_code = 0 THEN ' passed' ELSE ' failed' END
  FROM fx_decisions d JOIN fx_attempts a ON a.change_id = d.change_id WHERE NOT d.is_blocked AND d.fixed > 0
UNION ALL SELECT d.profile, d.change_id, 81, CASE WHEN a.passed IS NULL THEN 'No code was run.'
  WHEN a.passed THEN 'The rewritten models ran.'
  ELSE 'The rewritten models did not run; they are recorded only.' END
  FROM fx_decisions d LEFT JOIN fx_last a ON a.change_id = d.change_id AND d.fixed > 0
  WHERE NOT d.is_blocked"""


@query("p4_review_documents", _REVIEW_LINES)
def _(d: Driver) -> DataFrame:
    lines = d.review().documents.filter(~F.col("is_blocked"))
    return lines.select("profile", "change_id", "section", "line")


_REFUSAL_LINES = f"""SELECT profile, change_id, section, line FROM (
  SELECT profile, change_id, unnest([10, 20, 31, 32, 45, 99]) AS section, unnest([
    '# Held: ' || {_TARGET}, 'No fix was written: what can be seen is not the whole picture.',
    'Waiting for ' || blocked_on, 'Owners who know better can override with a reason, which is recorded.',
    CASE WHEN impacted > 0 THEN 'The assets above are a lower bound.'
      ELSE 'Nothing was found, which does not mean that nothing exists.' END, {_END}]) AS line
  FROM fx_decisions WHERE is_blocked)
UNION ALL SELECT profile, change_id, 30, 'Missing: ' || unnest(blocking_texts) FROM fx_decisions WHERE is_blocked
UNION ALL SELECT profile, change_id, section, line FROM ({_IMPACT_LINES}) WHERE is_blocked"""


DOCUMENT_LINES = f"{_REVIEW_LINES} UNION ALL {_REFUSAL_LINES}"


@query("p5_refusals", _REFUSAL_LINES)
def _(d: Driver) -> DataFrame:
    lines = d.review().documents.filter("is_blocked")
    return lines.select("profile", "change_id", "section", "line")


# --- evaluation -----------------------------------------------------------

_LABELS = """(SELECT change_id, CASE WHEN kind IN ('column_added', 'type_widened') THEN 'safe'
  WHEN kind = 'column_dropped' AND "column" = 'missing' THEN 'safe'
  WHEN kind = 'type_narrowed' THEN 'degrades' ELSE 'breaks' END AS expected_tier
FROM fx_changes WHERE kind <> 'logic_changed')"""
_OUTCOMES = f"""SELECT d.profile, d.change_id, l.expected_tier, d.overall AS verdict, d.is_blocked AS held,
  l.expected_tier = 'safe' AND d.overall IN ('breaks', 'degrades') AS false_alarm,
  l.expected_tier <> 'safe' AND d.overall NOT IN ('breaks', 'degrades') AS missed,
  l.expected_tier = 'safe' AND d.is_blocked AS safe_held
FROM fx_outcomes d JOIN {_LABELS} l USING (change_id)"""


def _labels(d: Driver) -> DataFrame:
    kind, column = F.col("kind"), F.col("column")
    tier = (
        F.when(kind.isin(*K.INTRINSICALLY_SAFE), K.SAFE)
        .when((kind == K.DROPPED) & (F.coalesce(column, F.lit("")) == "missing"), K.SAFE)
        .when(kind == K.NARROWED, K.DEGRADES).otherwise(K.BREAKS)
    )
    return d.changes().filter(kind != K.LOGIC).select("change_id", tier.alias("expected_tier"))


@query("e1_changes_by_profile", "SELECT profile, change_id, kind, overall, outcome FROM fx_outcomes")
def _(d: Driver) -> DataFrame:
    return d.review().verdicts.select("profile", "change_id", "kind", "overall", "outcome")


@query("e2_case_outcomes", _OUTCOMES)
def _(d: Driver) -> DataFrame:
    return evaluate.outcomes(d.review().verdicts, _labels(d))


_METRICS = f"""SELECT profile, count(*) AS cases, count(*) FILTER (false_alarm) AS false_alarms,
  count(*) FILTER (missed) AS missed_breakage, count(*) FILTER (safe_held) AS safe_changes_held
FROM ({_OUTCOMES}) GROUP BY profile"""


@query("e3_metrics", _METRICS)
def _(d: Driver) -> DataFrame:
    return evaluate.metrics(evaluate.outcomes(d.review().verdicts, _labels(d)))


_E4_RULES = [
    ("lit-open-gate-goes-on", "profile = 'covered' AND kind = 'column_renamed' AND gate_passed", "NOT is_blocked"),
    ("lit-rename-has-edits", "profile = 'covered' AND kind = 'column_renamed' AND fixed > 0", "true"),
    ("gate-carries-claim", "gate_passed", "may_assert_safe"),
    ("dim-rename-waits",
     "profile = 'dark' AND kind = 'column_renamed' AND impacted > 0 AND blocking > 0 AND NOT overridden", "is_blocked"),
    ("held-without-edits", "is_blocked", "fixed = 0"),
    ("held-with-reason", "is_blocked", "coalesce(blocked_on, '') <> ''"),
    ("reason-has-platform", "is_blocked AND len(blocking_platforms) > 0", "contains(blocked_on, blocking_platforms[1])"),
    ("widening-is-free", "intrinsic", "NOT is_blocked"),
    ("override-goes-on", "overridden", "NOT is_blocked"),
    ("override-has-reason", "overridden", "override_reason IS NOT NULL"),
    ("override-has-notice", "overridden", "noticed"),
]
_E4 = "\nUNION ALL ".join(
    f"SELECT '{name}' AS \"check\", count(*) FILTER ({applies}) AS cases, "
    f"count(*) FILTER ({applies} AND NOT ({holds})) AS violations, "
    f"count(*) FILTER ({applies}) > 0 AND count(*) FILTER ({applies} AND NOT ({holds})) = 0 AS passed "
    "FROM noticed_decisions"
    for name, applies, holds in _E4_RULES
)
# Whether a document has the notice is read from its lines.
_E4 = f"""SELECT * FROM (WITH noticed_decisions AS (
  SELECT d.*, n.change_id IS NOT NULL AS noticed FROM fx_decisions d LEFT JOIN (
    SELECT DISTINCT profile, change_id FROM ({_REVIEW_LINES}) WHERE section = 30 AND starts_with(line, 'Gate overridden')) n
  USING (profile, change_id))
{_E4})"""


@query("e4_gate_checks", _E4)
def _(d: Driver) -> DataFrame:
    r = d.review()
    notices = r.documents.filter((F.col("section") == 30) & F.startswith("line", F.lit("Gate overridden")))
    return evaluate.gate_checks(r.decisions, r.edits, notices, *PROFILES)


@query(
    "e5_side_by_side",
    """SELECT change_id, max(outcome) FILTER (profile = 'covered') AS covered,
  max(outcome) FILTER (profile = 'dark') AS dark FROM fx_outcomes GROUP BY change_id""",
)
def _(d: Driver) -> DataFrame:
    return evaluate.side_by_side(d.review().verdicts, list(PROFILES))


@query("s11_evaluation_sink", _METRICS)
def _(d: Driver) -> DataFrame:
    rows = evaluate.metrics(evaluate.outcomes(d.review().verdicts, _labels(d)))
    folder = scratch(d.spark, "evaluation")
    sinks.write_evaluation(rows, folder)
    return sinks.read_back(d.spark, folder, rows, "json")


