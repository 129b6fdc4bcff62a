"""Resolution, expansion and coverage queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.bridge.registry import query
from ripplemap.bridge.tables import LANDING, Driver
from ripplemap.operators import coverage as cov
from ripplemap.operators import expand, resolve

_LIST = "array_to_string(platforms, ', ')"


@query("r2_candidates", "SELECT model, urn, platform FROM fx_candidates")
def _(d: Driver) -> DataFrame:
    return resolve.candidate_rows(d.review().targets, d.entities())


@query(
    "r3_resolution",
    'SELECT c.change_id, c.model, r.candidates, r.root_urn, r.resolution FROM fx_changes c '
    'JOIN fx_resolved r ON r.model = c.model AND r."column" = coalesce(c."column", \'\')',
)
def _(d: Driver) -> DataFrame:
    from ripplemap.operators.verdict import changes_with

    r = d.review()
    rows = changes_with(r.changes, r.resolved, r.hot_targets)
    return rows.select("change_id", "model", "candidates", "root_urn", "resolution")


@query(
    "r4_ambiguities",
    f"""SELECT DISTINCT model, candidates, {_LIST} AS platforms,
  '''' || model || ''' matches ' || candidates || ' entities (' || {_LIST} || ')' AS reason
FROM fx_resolved WHERE resolution = 'ambiguous'""",
)
def _(d: Driver) -> DataFrame:
    return resolve.ambiguities(d.review().resolved)


@query(
    "r5_placeholder_roots",
    """SELECT scope_id, model, "column", resolution, coalesce(root_urn, 'unresolved:' || model) AS root,
  CASE WHEN root_urn IS NULL THEN '?' END AS placeholder_platform FROM fx_resolved""",
)
def _(d: Driver) -> DataFrame:
    return resolve.with_placeholder_root(d.review().resolved)


_SUB = "profile, scope_id, urn, direction, hop"


def _sub(d: Driver) -> DataFrame:
    return d.review().subgraph.select("profile", "scope_id", "urn", "direction", "hop")


@query(
    "g1_downstream_closure",
    """SELECT s.profile, s.scope_id, s.root_urn, r.urn, r.d::INTEGER AS hop FROM fx_scopes s
JOIN fx_reach r ON r.profile = s.profile AND r.root_urn = s.root_urn AND r.dir = 'down' WHERE s."column" = ''""",
)
def _(d: Driver) -> DataFrame:
    r = d.review()
    plain = r.scopes.filter(F.col("column") == "")
    found = r.subgraph_of(plain)
    return (
        found.filter(F.col("direction") == "downstream")
        .join(plain.select("scope_id", "root_urn"), "scope_id")
        .select("profile", "scope_id", "root_urn", "urn", "hop")
    )


@query(
    "g2_column_scoped",
    f"""SELECT {_SUB} FROM fx_sub WHERE direction = 'downstream'
  AND scope_id IN (SELECT scope_id FROM fx_scopes WHERE "column" <> '')""",
)
def _(d: Driver) -> DataFrame:
    r = d.review()
    scoped = r.scopes.filter(F.col("column") != "")
    found = r.subgraph_of(scoped)
    return found.filter(F.col("direction") == "downstream").drop("provenance")


@query(
    "g3_stopping_rule",
    """SELECT s.profile, s.scope_id, s."column", count(*) FILTER (w.direction = 'downstream' AND w.hop = 1) AS down_1,
  count(*) FILTER (w.direction = 'downstream' AND w.hop = 2) AS down_2,
  count(*) FILTER (w.direction = 'downstream' AND w.hop = 3) AS down_3,
  count(*) FILTER (w.direction = 'upstream') AS up_all
FROM fx_scopes s JOIN fx_sub w USING (profile, scope_id) GROUP BY ALL""",
)
def _(d: Driver) -> DataFrame:
    r = d.review()
    is_down = F.col("direction") == "downstream"
    counts = r.subgraph.groupBy("profile", "scope_id").agg(
        *[F.count_if(is_down & (F.col("hop") == k)).alias(f"down_{k}") for k in (1, 2, 3)],
        F.count_if(F.col("direction") == "upstream").alias("up_all"),
    )
    return counts.join(r.scopes.select("scope_id", "column"), "scope_id")


@query("g4_upstream", f"SELECT {_SUB} FROM fx_sub WHERE direction = 'upstream'")
def _(d: Driver) -> DataFrame:
    return _sub(d).filter(F.col("direction") == "upstream")


@query("g5_rooted_subgraph", f"SELECT {_SUB} FROM fx_sub")
def _(d: Driver) -> DataFrame:
    return _sub(d)


_STAR = """SELECT s.profile, s.scope_id, CASE s.direction WHEN 'downstream' THEN p.root_urn ELSE s.urn END AS up_urn,
  CASE s.direction WHEN 'downstream' THEN s.urn ELSE p.root_urn END AS down_urn, {how}
FROM {sub} s JOIN fx_scopes p USING (profile, scope_id) WHERE s.hop > 0"""


@query("g6_star_edges", _STAR.format(how="'parsed' AS provenance, 1.0::DOUBLE AS confidence", sub="fx_sub"))
def _(d: Driver) -> DataFrame:
    r = d.review()
    return expand.star_edges(r.subgraph, r.scopes)


_TRUE_STAR = _STAR.format(
    how="""provenance, CASE provenance WHEN 'parsed' THEN 1.0::DOUBLE WHEN 'curated' THEN 0.9::DOUBLE
  ELSE 0.5::DOUBLE END AS confidence""",
    sub="fx_true_sub",
)


@query("g6_true_star_edges", _TRUE_STAR)
def _(d: Driver) -> DataFrame:
    r = d.review()
    return expand.star_edges(r.subgraph, r.scopes, true_provenance=True)


@query(
    "g7_trace",
    """SELECT s.profile, s.scope_id, s.urn, CASE WHEN s.hop = 0 THEN 'the changed entity itself'
  ELSE s.direction || ' of ' || regexp_extract(p.root_urn, ',([^,]+),', 1) || ' at hop ' || s.hop END AS trace
FROM fx_sub s JOIN fx_scopes p USING (profile, scope_id)""",
)
def _(d: Driver) -> DataFrame:
    r = d.review()
    return expand.with_trace(r.subgraph, r.scopes).select("profile", "scope_id", "urn", "trace")


# --- coverage -------------------------------------------------------------


@query("v1_expected", "SELECT profile, expected_nodes FROM fx_reg_summary")
def _(d: Driver) -> DataFrame:
    return cov.registry_summary(d.registry()).select("profile", "expected_nodes")


@query(
    "v2_observable",
    """SELECT profile, dark_nodes, round(1.0::DOUBLE - dark_nodes / expected_nodes, 6) AS observable
FROM fx_reg_summary""",
)
def _(d: Driver) -> DataFrame:
    summary = cov.registry_summary(d.registry())
    return summary.select(
        "profile", "dark_nodes",
        F.round(1.0 - F.col("dark_nodes") / F.col("expected_nodes"), 6).alias("observable"),
    )


@query(
    "v3_parsed_ratio",
    """SELECT profile, scope_id, edges, parsed_edges, inferred_edges, round(ratio, 3) AS parsed_edge_ratio
FROM fx_true_score""",
)
def _(d: Driver) -> DataFrame:
    return d.review(true_provenance=True).coverage.select(
        "profile", "scope_id", "edges", "parsed_edges", "inferred_edges", "parsed_edge_ratio"
    )


@query("v4_reach", "SELECT profile, scope_id, reached, reach FROM fx_score")
def _(d: Driver) -> DataFrame:
    return d.review().coverage.select("profile", "scope_id", "reached", "reach")


@query(
    "v5_coverage_score",
    """SELECT profile, scope_id, model, "column", resolution, reached, expected_nodes,
  round(ratio, 3) AS parsed_edge_ratio, score FROM fx_score""",
)
def _(d: Driver) -> DataFrame:
    return d.review().coverage.select(
        "profile", "scope_id", "model", "column", "resolution", "reached", "expected_nodes",
        "parsed_edge_ratio", "score",
    )


@query(
    "v5_true_coverage_score",
    "SELECT profile, scope_id, reached, round(ratio, 3) AS parsed_edge_ratio, score FROM fx_true_score",
)
def _(d: Driver) -> DataFrame:
    return d.review(true_provenance=True).coverage.select(
        "profile", "scope_id", "reached", "parsed_edge_ratio", "score"
    )


def _spots(d: Driver, ord_: int | None = None, **options) -> DataFrame:
    rows = cov.spot_rows(d.review(**options).coverage)
    return rows if ord_ is None else rows.filter(F.col("ord") == ord_)


_SPOT = 'profile, scope_id, model, "column", ord, description, platform, blocks'


@query("v6_dark_platforms", f"SELECT {_SPOT} FROM fx_spots WHERE ord = 1")
def _(d: Driver) -> DataFrame:
    return _spots(d, 1)


@query(
    "v7_orphans",
    """SELECT profile, scope_id, urn, 'star' AS mode FROM fx_sub WHERE direction = 'upstream'
  AND regexp_extract(urn, 'dataPlatform:([^,]+),', 1) NOT IN ('region', 'part')
UNION ALL SELECT profile, scope_id, urn, 'true' FROM fx_induced_orphans""",
)
def _(d: Driver) -> DataFrame:
    sub = d.review().subgraph
    star = cov.orphan_rows(sub, list(LANDING)).withColumn("mode", F.lit("star"))
    true = d.review(true_edges=True, true_provenance=True).orphans.withColumn("mode", F.lit("true"))
    keep = ["profile", "scope_id", "urn", "mode"]
    return star.select(*keep).unionByName(true.select(*keep))


@query(
    "v7_induced_score",
    """SELECT s.profile, s.scope_id, s.reached, s.orphans, round(s.ratio, 3) AS parsed_edge_ratio, s.score,
  coalesce(x.n_spots, 0) AS n_spots, s.score >= 0.6 AND coalesce(x.blocking, 0) = 0 AS gate_passed
FROM fx_induced_score s LEFT JOIN (
  SELECT profile, scope_id, count(*) AS n_spots, count(*) FILTER (blocks) AS blocking FROM fx_induced_spots
  GROUP BY ALL) x USING (profile, scope_id)""",
)
def _(d: Driver) -> DataFrame:
    """Coverage with the catalog's own edges: evidence, orphans, spots, score and gate."""
    return d.review(true_edges=True, true_provenance=True).coverage.select(
        "profile", "scope_id", "reached", "orphans", "parsed_edge_ratio", "score",
        F.size("spots").alias("n_spots"), "gate_passed",
    )


@query("v7_induced_spots", f"SELECT {_SPOT} FROM fx_induced_spots")
def _(d: Driver) -> DataFrame:
    return _spots(d, true_edges=True, true_provenance=True)


@query("v7_orphan_spots", f"SELECT {_SPOT} FROM fx_spots WHERE ord = 2")
def _(d: Driver) -> DataFrame:
    return _spots(d, 2)


@query(
    "v8_ambiguity_spots",
    f"""SELECT {_SPOT}, c.urn FROM fx_spots s JOIN (SELECT model AS m, urn FROM fx_candidates) c ON c.m = s.model
WHERE ord = 3""",
)
def _(d: Driver) -> DataFrame:
    r = d.review()
    urns = resolve.candidate_rows(r.targets, d.entities()).select("model", "urn")
    return cov.spot_rows(r.coverage).filter(F.col("ord") == 3).join(urns, "model")


@query(
    "v9_inferred_spots",
    """SELECT s.profile, s.scope_id, s.description, t.urn FROM fx_true_spots s
JOIN fx_true_sub t ON t.profile = s.profile AND t.scope_id = s.scope_id AND t.provenance = 'inferred'
WHERE s.ord = 4""",
)
def _(d: Driver) -> DataFrame:
    r = d.review(true_provenance=True)
    spots = cov.spot_rows(r.coverage).filter(F.col("ord") == 4).select("profile", "scope_id", "description")
    guessed = r.subgraph.filter(F.col("provenance") == "inferred").select("profile", "scope_id", "urn")
    return guessed.join(spots, ["profile", "scope_id"])


@query("v10_blind_spots", f"SELECT {_SPOT} FROM fx_true_spots")
def _(d: Driver) -> DataFrame:
    return _spots(d, true_provenance=True)


@query(
    "v11_gate",
    "SELECT profile, scope_id, score, blocking, n_spots, gate_passed FROM fx_coverage",
)
def _(d: Driver) -> DataFrame:
    return d.review().coverage.select(
        "profile", "scope_id", "score",
        F.size(F.filter("spots", lambda s: s["blocks"])).alias("blocking"),
        F.size("spots").alias("n_spots"), "gate_passed",
    )


@query(
    "v12_override",
    "SELECT profile, change_id, gate_passed, overridden, override_reason, may_assert_safe FROM fx_reviewed",
)
def _(d: Driver) -> DataFrame:
    return d.review().reviewed.select(
        "profile", "change_id", "gate_passed", "overridden", "override_reason", "may_assert_safe"
    )


@query("v13_blocking_spots", f"SELECT {_SPOT} FROM fx_spots WHERE blocks")
def _(d: Driver) -> DataFrame:
    return _spots(d).filter("blocks")


@query(
    "v14_registry_warnings",
    """SELECT p.profile, 'no registry rows: coverage is not measurable' AS warning
FROM (SELECT profile FROM fx_profiles UNION ALL SELECT 'unregistered-' || r_regionkey FROM region) p
WHERE profile NOT IN (SELECT profile FROM fx_registry)""",
)
def _(d: Driver) -> DataFrame:
    named = d.table("region").select(
        F.concat(F.lit("unregistered-"), F.col("r_regionkey").cast("string")).alias("profile")
    )
    declared = d.profile_platforms().select("profile").distinct()
    return cov.registry_warnings(d.registry(), named.unionByName(declared))


