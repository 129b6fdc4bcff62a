"""DuckDB common table expressions: the SQL twins of ``tables``, and their composition.

``compose(body)`` puts every ``fx_*`` expression the body needs, directly or not, in front of it.
"""

import re

CTES: dict[str, str] = {}


def _urn(platform: str, name: str) -> str:
    return f"'urn:li:dataset:(urn:li:dataPlatform:{platform},' || {name} || ',PROD)'"


CTES["fx_pairs"] = "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem"
CTES["fx_names"] = """
SELECT 'region' AS platform, 'region-' || r_regionkey AS name FROM region
UNION ALL SELECT 'nation', 'nation-' || n_nationkey FROM nation
UNION ALL SELECT 'customer', 'acct-' || c_custkey FROM customer
UNION ALL SELECT 'supplier', 'acct-' || s_suppkey FROM supplier
UNION ALL SELECT 'part', 'part-' || p_partkey FROM part
UNION ALL SELECT 'orders', 'order-' || o_orderkey FROM orders
UNION ALL SELECT 'lineitem', 'line-' || l_orderkey || '-' || l_linenumber FROM fx_pairs
"""
CTES["fx_entities"] = """
SELECT 'urn:li:dataset:(urn:li:dataPlatform:' || platform || ',' || name || ',PROD)' AS urn,
  platform, name FROM fx_names
"""
_LINE = "'line-' || l_orderkey || '-' || l_linenumber"
_HOW = (
    "CASE WHEN l_orderkey % 7 = 0 THEN 'inferred' WHEN l_orderkey % 11 = 0 THEN 'curated' "
    "ELSE 'parsed' END"
)


def _edge(up: str, up_name: str, down: str, down_name: str, source: str, how: str = "'parsed'") -> str:
    return (
        f"SELECT {_urn(up, up_name)} AS up_urn, {_urn(down, down_name)} AS down_urn, "
        f"'{up}' AS up_platform, '{down}' AS down_platform, {how} AS provenance FROM {source}"
    )


_LINES_BY_SUPPLIER = "(SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem)"
_LINES_BY_PART = "(SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem)"
_EDGES = "\nUNION ALL ".join(
    [
        _edge("region", "'region-' || n_regionkey", "nation", "'nation-' || n_nationkey", "nation"),
        _edge("nation", "'nation-' || c_nationkey", "customer", "'acct-' || c_custkey", "customer"),
        _edge("nation", "'nation-' || s_nationkey", "supplier", "'acct-' || s_suppkey", "supplier"),
        _edge("customer", "'acct-' || o_custkey", "orders", "'order-' || o_orderkey", "orders"),
        _edge("orders", "'order-' || l_orderkey", "lineitem", _LINE, "fx_pairs", _HOW),
        _edge("supplier", "'acct-' || l_suppkey", "lineitem", _LINE, _LINES_BY_SUPPLIER, _HOW),
        _edge("part", "'part-' || l_partkey", "lineitem", _LINE, _LINES_BY_PART, _HOW),
    ]
)
CTES["fx_edges"] = f"""
SELECT *, CASE provenance WHEN 'parsed' THEN 1.0::DOUBLE WHEN 'curated' THEN 0.9::DOUBLE
  ELSE 0.5::DOUBLE END AS confidence FROM ({_EDGES})
"""
CTES["fx_column_edges"] = """
SELECT up_urn, 'key' AS up_col, down_urn, 'key' AS down_col, down_platform, provenance
FROM fx_edges WHERE up_platform <> 'supplier' AND down_platform <> 'supplier'
"""
CTES["fx_profiles"] = "SELECT unnest(['covered', 'dark']) AS profile"
CTES["fx_profile_platforms"] = """
SELECT 'covered' AS profile,
  unnest(['region','nation','customer','supplier','part','orders','lineitem']) AS platform,
  true AS emit_inferred
UNION ALL
SELECT 'dark', unnest(['nation','customer','supplier','part','orders']), false
"""
CTES["fx_pedges"] = """
SELECT p.profile, e.* FROM fx_edges e JOIN fx_profile_platforms p ON p.platform = e.down_platform
WHERE p.emit_inferred OR e.provenance <> 'inferred'
"""
CTES["fx_pcolumn_edges"] = """
SELECT p.profile, e.* FROM fx_column_edges e
JOIN fx_profile_platforms p ON p.platform = e.down_platform
WHERE p.emit_inferred OR e.provenance <> 'inferred'
"""
CTES["fx_registry"] = """
SELECT f.profile, n.platform, p.platform IS NOT NULL AS connector, n.expected,
  'entities of ' || n.platform AS note, n.platform NOT IN ('region', 'part') AS hosts_consumers
FROM (SELECT platform, count(*) AS expected FROM fx_names GROUP BY platform) n
CROSS JOIN fx_profiles f
LEFT JOIN fx_profile_platforms p ON p.profile = f.profile AND p.platform = n.platform
"""
CTES["fx_changes"] = """
SELECT change_id, model,
  CASE n % 6 WHEN 0 THEN 'column_renamed' WHEN 1 THEN 'column_dropped' WHEN 2 THEN 'column_added'
    WHEN 3 THEN 'type_narrowed' WHEN 4 THEN 'type_widened' ELSE 'logic_changed' END AS kind,
  CASE n % 4 WHEN 0 THEN NULL WHEN 3 THEN 'missing' ELSE 'key' END AS "column",
  CASE WHEN n % 6 = 0 THEN 'new_key' END AS new_value, ts AS recorded_at, answer
FROM (
  SELECT event_id AS change_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'acct-' || user_id
      WHEN event_type = 'purchase' THEN 'order-' || event_id
      WHEN event_type = 'signup' THEN 'part-' || user_id ELSE 'ghost-' || event_id END AS model,
    event_id AS n, ts,
    CASE event_type WHEN 'error' THEN 'Breaks hard' WHEN 'view' THEN 'it degrades'
      WHEN 'purchase' THEN 'BREAKS and DEGRADES' ELSE 'unknown' END AS answer
  FROM events
  UNION ALL
  SELECT -1 - n_nationkey::BIGINT, 'nation-' || n_nationkey, n_nationkey::BIGINT,
    TIMESTAMP '2024-01-01 00:00:00', NULL FROM nation
  UNION ALL
  SELECT -1001 - r_regionkey::BIGINT, 'region-' || r_regionkey, r_regionkey::BIGINT,
    TIMESTAMP '2024-01-01 00:00:00', NULL FROM region)
"""
CTES["fx_overrides"] = "SELECT change_id, 'accepted' AS reason FROM fx_changes WHERE change_id % 10 = 0"
CTES["fx_targets"] = """
SELECT model, coalesce("column", '') AS "column", min(change_id) AS scope_id, count(*) AS n_changes
FROM fx_changes GROUP BY ALL
"""
CTES["fx_candidates"] = """
SELECT e.name AS model, e.urn, e.platform FROM fx_entities e
WHERE e.name IN (SELECT model FROM fx_targets)
"""
CTES["fx_resolved"] = """
SELECT t.*, coalesce(c.n, 0) AS candidates, coalesce(c.platforms, []) AS platforms,
  CASE WHEN c.n = 1 THEN c.only_urn END AS root_urn,
  CASE WHEN c.n IS NULL THEN 'unresolved' WHEN c.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution
FROM fx_targets t LEFT JOIN (
  SELECT model, count(*) AS n, min(urn) AS only_urn, list_sort(list(DISTINCT platform)) AS platforms
  FROM fx_candidates GROUP BY model) c USING (model)
"""
CTES["fx_scopes"] = """
SELECT p.profile, r.scope_id, r.root_urn, r."column"
FROM fx_resolved r CROSS JOIN fx_profiles p WHERE r.root_urn IS NOT NULL
"""
CTES["fx_links"] = """
SELECT profile, 'down' AS dir, up_urn AS src, down_urn AS dst,
  CASE provenance WHEN 'parsed' THEN 0 WHEN 'curated' THEN 1 ELSE 2 END AS rank FROM fx_pedges
UNION ALL
SELECT profile, 'up', down_urn, up_urn,
  CASE provenance WHEN 'parsed' THEN 0 WHEN 'curated' THEN 1 ELSE 2 END FROM fx_pedges
"""
CTES["fx_roots"] = """
SELECT DISTINCT s.profile, d.dir, s.root_urn FROM fx_scopes s
CROSS JOIN (SELECT unnest(['down', 'up']) AS dir) d
"""
CTES["fx_w1"] = """
SELECT r.profile, r.dir, r.root_urn, l.dst AS urn, min(l.rank) AS rank FROM fx_roots r
JOIN fx_links l ON l.profile = r.profile AND l.dir = r.dir AND l.src = r.root_urn GROUP BY ALL
"""
CTES["fx_w2"] = """
SELECT w.profile, w.dir, w.root_urn, l.dst AS urn, min(l.rank) AS rank FROM fx_w1 w
JOIN fx_links l ON l.profile = w.profile AND l.dir = w.dir AND l.src = w.urn GROUP BY ALL
"""
CTES["fx_w3"] = """
SELECT w.profile, w.dir, w.root_urn, l.dst AS urn, min(l.rank) AS rank FROM fx_w2 w
JOIN fx_links l ON l.profile = w.profile AND l.dir = w.dir AND l.src = w.urn GROUP BY ALL
"""
CTES["fx_reach"] = """
SELECT profile, dir, root_urn, urn, min(d) AS d FROM (
  SELECT *, 1 AS d FROM fx_w1 UNION ALL SELECT *, 2 FROM fx_w2 UNION ALL SELECT *, 3 FROM fx_w3)
WHERE urn <> root_urn GROUP BY ALL
"""
# Provenance of the strongest edge among those that discover the entity first.
CTES["fx_first"] = """
SELECT s.profile, s.scope_id, s.root_urn, s."column", d.dir, c.urn, min(c.rank) AS rank
FROM fx_scopes s CROSS JOIN (SELECT unnest(['down', 'up']) AS dir) d
JOIN (
  SELECT profile, 'down' AS dir, up_urn AS src, up_col AS col, down_urn AS urn,
    CASE provenance WHEN 'parsed' THEN 0 WHEN 'curated' THEN 1 ELSE 2 END AS rank FROM fx_pcolumn_edges
  UNION ALL
  SELECT profile, 'up', down_urn, down_col, up_urn,
    CASE provenance WHEN 'parsed' THEN 0 WHEN 'curated' THEN 1 ELSE 2 END FROM fx_pcolumn_edges) c
  ON c.profile = s.profile AND c.dir = d.dir AND c.src = s.root_urn AND c.col = s."column"
GROUP BY ALL
"""
# hop 0 the root; no column: table distance; column: scoped set at hop 1, others from hop 2 on,
# nothing at all when the scoped set is empty.
CTES["fx_walked"] = """
SELECT s.profile, s.scope_id, r.dir, r.urn, r.d AS hop FROM fx_scopes s
JOIN fx_reach r ON r.profile = s.profile AND r.root_urn = s.root_urn WHERE s."column" = ''
UNION ALL
SELECT profile, scope_id, dir, urn, 1 FROM fx_first
UNION ALL
SELECT s.profile, s.scope_id, r.dir, r.urn, greatest(r.d, 2) FROM fx_scopes s
JOIN fx_reach r ON r.profile = s.profile AND r.root_urn = s.root_urn
WHERE s."column" <> ''
  AND EXISTS (SELECT 1 FROM fx_first f WHERE f.profile = s.profile AND f.scope_id = s.scope_id AND f.dir = r.dir)
  AND NOT EXISTS (SELECT 1 FROM fx_first f WHERE f.profile = s.profile AND f.scope_id = s.scope_id
    AND f.dir = r.dir AND f.urn = r.urn)
"""
CTES["fx_sub"] = """
SELECT profile, scope_id, root_urn AS urn, 'root' AS direction, 0 AS hop FROM fx_scopes
UNION ALL
SELECT profile, scope_id, urn, CASE dir WHEN 'down' THEN 'downstream' ELSE 'upstream' END, hop FROM (
  SELECT *, row_number() OVER (PARTITION BY profile, scope_id, urn ORDER BY dir) AS rn FROM fx_walked)
WHERE rn = 1
"""
CTES["fx_codes"] = """
SELECT profile, scope_id, dir, urn, min(code) AS code FROM (
  SELECT s.profile, s.scope_id, w.dir, w.urn,
    greatest(w.d, CASE WHEN s."column" = '' THEN 1 ELSE 2 END) * 4 + w.rank AS code
  FROM fx_scopes s JOIN (
    SELECT *, 1 AS d FROM fx_w1 UNION ALL SELECT *, 2 FROM fx_w2 UNION ALL SELECT *, 3 FROM fx_w3) w
    ON w.profile = s.profile AND w.root_urn = s.root_urn
  UNION ALL SELECT profile, scope_id, dir, urn, 4 + rank FROM fx_first) GROUP BY ALL
"""
CTES["fx_true_sub"] = """
SELECT s.*, CASE WHEN s.hop = 0 THEN NULL ELSE CASE c.code % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'curated'
  ELSE 'inferred' END END AS provenance
FROM fx_sub s LEFT JOIN fx_codes c ON c.profile = s.profile AND c.scope_id = s.scope_id AND c.urn = s.urn
  AND c.dir = CASE s.direction WHEN 'downstream' THEN 'down' ELSE 'up' END AND s.hop > 0
"""
_PLATFORM = "regexp_extract(urn, '^urn:li:dataset:\\(urn:li:dataPlatform:([^,]+),([^,]+),([^)]+)\\)', 1)"
_NAME = "regexp_extract(urn, '^urn:li:dataset:\\(urn:li:dataPlatform:([^,]+),([^,]+),([^)]+)\\)', 2)"
CTES["fx_facts"] = f"""
SELECT profile, scope_id, count(*) AS reached, count(*) FILTER (hop > 0) AS edges,
  count(*) FILTER (hop > 0) AS parsed_edges, 0 AS inferred_edges,
  count(*) FILTER (direction = 'upstream' AND {_PLATFORM} NOT IN ('region', 'part')) AS orphans,
  list_sort(coalesce(list(DISTINCT {_PLATFORM}) FILTER (hop > 0), [])) AS consumer_platforms
FROM fx_sub GROUP BY ALL
"""
CTES["fx_true_facts"] = """
SELECT f.* REPLACE (t.parsed AS parsed_edges, t.inferred AS inferred_edges) FROM fx_facts f JOIN (
  SELECT profile, scope_id, count(*) FILTER (provenance = 'parsed') AS parsed,
    count(*) FILTER (provenance = 'inferred') AS inferred FROM fx_true_sub GROUP BY ALL) t
USING (profile, scope_id)
"""
CTES["fx_induced_orphans"] = f"""
SELECT s.profile, s.scope_id, s.urn FROM fx_sub s WHERE s.hop > 0 AND {_PLATFORM} NOT IN ('region', 'part')
  AND NOT EXISTS (SELECT 1 FROM fx_pedges e JOIN fx_sub u ON u.profile = e.profile AND u.urn = e.up_urn
    WHERE e.profile = s.profile AND e.down_urn = s.urn AND u.scope_id = s.scope_id)
"""
CTES["fx_induced_facts"] = """
SELECT f.* REPLACE (coalesce(o.n, 0) AS orphans) FROM fx_true_facts f LEFT JOIN (
  SELECT profile, scope_id, count(*) AS n FROM fx_induced_orphans GROUP BY ALL) o USING (profile, scope_id)
"""
CTES["fx_reg_summary"] = """
SELECT profile, coalesce(nullif(sum(expected), 0), 1)::BIGINT AS expected_nodes,
  coalesce(sum(expected) FILTER (NOT connector), 0)::BIGINT AS dark_nodes
FROM fx_registry GROUP BY profile
"""
CTES["fx_platform_spots"] = """
SELECT profile, 1 AS ord, CASE WHEN hosts_consumers
  THEN platform || ' reports no lineage: ' || expected || ' declared entities are out of sight and may consume this'
  ELSE platform || ' reports no lineage, but it only supplies data and cannot be hit' END AS description,
  platform, hosts_consumers AS blocks
FROM fx_registry WHERE NOT connector
"""


def _score(facts: str) -> str:
    return f"""
SELECT p.profile, r.*, coalesce(f.reached, 0) AS reached, coalesce(f.edges, 0) AS edges,
  coalesce(f.parsed_edges, 0) AS parsed_edges, coalesce(f.inferred_edges, 0) AS inferred_edges,
  coalesce(f.orphans, 0) AS orphans, coalesce(f.consumer_platforms, []) AS consumer_platforms,
  s.expected_nodes, s.dark_nodes, 1.0::DOUBLE - s.dark_nodes / s.expected_nodes AS observable,
  coalesce(f.parsed_edges / nullif(f.edges, 0), 0.0)::DOUBLE AS ratio,
  CASE WHEN coalesce(f.reached, 0) >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reach,
  round(greatest(0.0, least(1.0, (1.0::DOUBLE - s.dark_nodes / s.expected_nodes)
    * coalesce(f.parsed_edges / nullif(f.edges, 0), 0.0)
    * CASE WHEN coalesce(f.reached, 0) >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 3) AS score
FROM fx_resolved r CROSS JOIN fx_profiles p
LEFT JOIN {facts} f ON f.profile = p.profile AND f.scope_id = r.scope_id
LEFT JOIN fx_reg_summary s ON s.profile = p.profile
"""


def _spots(score: str) -> str:
    return f"""
SELECT s.profile, s.scope_id, s.model, s."column", p.ord, p.description, p.platform, p.blocks
FROM {score} s JOIN fx_platform_spots p ON p.profile = s.profile
UNION ALL
SELECT profile, scope_id, model, "column", 2, orphans || ' reached entities have no recorded origin', NULL, false
FROM {score} WHERE orphans > 0
UNION ALL
SELECT profile, scope_id, model, "column", 3,
  'the name matches ' || candidates || ' entities; the target is undecided', NULL, true
FROM {score} WHERE candidates > 1
UNION ALL
SELECT profile, scope_id, model, "column", 4,
  inferred_edges || ' lineage edges are guesses nobody has confirmed', NULL, false
FROM {score} WHERE inferred_edges > 0
"""


CTES["fx_score"] = _score("fx_facts")
CTES["fx_true_score"] = _score("fx_true_facts")
CTES["fx_spots"] = _spots("fx_score")
CTES["fx_true_spots"] = _spots("fx_true_score")
CTES["fx_induced_score"] = _score("fx_induced_facts")
CTES["fx_induced_spots"] = _spots("fx_induced_score")
CTES["fx_coverage"] = """
SELECT s.*, coalesce(x.blocking, 0) AS blocking, coalesce(x.n_spots, 0) AS n_spots,
  coalesce(x.texts, []) AS texts, coalesce(x.spot_platforms, []) AS spot_platforms,
  coalesce(x.blocking_platforms, []) AS blocking_platforms,
  coalesce(x.blocking_texts, []) AS blocking_texts, coalesce(x.noted_texts, []) AS noted_texts,
  s.score >= 0.6 AND coalesce(x.blocking, 0) = 0 AS gate_passed
FROM fx_score s LEFT JOIN (
  SELECT profile, scope_id, count(*) FILTER (blocks) AS blocking, count(*) AS n_spots,
    list(description ORDER BY ord, description) AS texts,
    list(platform ORDER BY platform) FILTER (platform IS NOT NULL) AS spot_platforms,
    list(platform ORDER BY platform) FILTER (platform IS NOT NULL AND blocks) AS blocking_platforms,
    list(description ORDER BY ord, description) FILTER (blocks) AS blocking_texts,
    list(description ORDER BY ord, description) FILTER (NOT blocks) AS noted_texts
  FROM fx_spots GROUP BY ALL) x USING (profile, scope_id)
"""
CTES["fx_reviewed"] = """
SELECT c.change_id, c.kind, c."column", c.new_value, c.recorded_at, c.answer, v.* EXCLUDE ("column", n_changes),
  coalesce(o.reason, '') <> '' AND NOT v.gate_passed AS overridden,
  CASE WHEN coalesce(o.reason, '') <> '' AND NOT v.gate_passed THEN o.reason END AS override_reason,
  v.gate_passed OR coalesce(o.reason, '') <> '' AS may_assert_safe
FROM fx_changes c JOIN fx_coverage v ON v.model = c.model AND v."column" = coalesce(c."column", '')
LEFT JOIN fx_overrides o ON o.change_id = c.change_id
"""


def _verdicts(logic_tier: str) -> str:
    return f"""
SELECT *, CASE WHEN tier = 'safe' AND NOT may_assert_safe AND NOT intrinsic THEN 'touches' ELSE tier END AS overall,
  tier = 'safe' AND NOT may_assert_safe AND NOT intrinsic AS abstained
FROM (
  SELECT *, CASE WHEN impacted = 0 THEN 'safe' WHEN kind IN ('column_dropped', 'column_renamed') THEN 'breaks'
    WHEN kind = 'type_narrowed' THEN 'degrades' ELSE {logic_tier} END AS tier
  FROM (
    SELECT *, kind IN ('column_added', 'type_widened') AS intrinsic, greatest(reached - 1, 0) AS consumers,
      CASE WHEN kind IN ('column_added', 'type_widened') THEN 0 ELSE greatest(reached - 1, 0) END AS impacted
    FROM fx_reviewed))
"""


CTES["fx_verdicts"] = _verdicts("'touches'")
CTES["fx_judged"] = _verdicts(
    "CASE WHEN contains(upper(answer), 'BREAKS') THEN 'breaks' "
    "WHEN contains(upper(answer), 'DEGRADES') THEN 'degrades' ELSE 'touches' END"
)
CTES["fx_outcomes"] = """
SELECT *, outcome = 'blocked' AS is_blocked, outcome = 'generate' AS made,
  CASE WHEN outcome = 'generate' THEN CASE kind WHEN 'column_renamed' THEN 'update_references'
    WHEN 'column_dropped' THEN 'two_phase_deprecate' ELSE 'compatibility_alias' END
    ELSE 'update_references' END AS strategy,
  CASE WHEN outcome = 'generate' THEN CASE kind
    WHEN 'column_renamed' THEN ['compatibility_alias', 'two_phase_deprecate']
    ELSE ['update_references'] END ELSE []::VARCHAR[] END AS alternatives,
  CASE WHEN outcome = 'generate' AND tier = 'breaks' THEN impacted ELSE 0 END AS total,
  CASE WHEN outcome = 'blocked' THEN 'coverage ' || score || ' does not carry a fix: '
    || array_to_string(texts, '; ') END AS blocked_reason
FROM (
  SELECT *, CASE WHEN overall = 'safe' THEN 'no_op_safe' WHEN NOT may_assert_safe THEN 'blocked'
    WHEN overall = 'touches' THEN 'no_op_touches'
    WHEN kind NOT IN ('column_renamed', 'column_dropped', 'type_narrowed') THEN 'escalate'
    ELSE 'generate' END AS outcome FROM fx_verdicts)
"""
CTES["fx_impacts"] = f"""
SELECT v.profile, v.change_id, v.scope_id, s.urn, s.name, s.platform, s.direction, s.hop, v.tier, v.kind,
  v.model, v."column", v.new_value, v.impacted, v.outcome, v.strategy, v.is_blocked, v.n_spots,
  CASE v.tier
    WHEN 'breaks' THEN s.name || ' refers to ' || v.target || ' (' || s.direction || ', hop ' || s.hop
      || ') and will no longer resolve'
    WHEN 'degrades' THEN s.name || ' reads ' || v.target || ' (' || s.direction || ', hop ' || s.hop
      || '); it keeps running with changed values'
    ELSE s.name || ' lies in reach of ' || v.target || ' (' || s.direction || ', hop ' || s.hop || ')' END AS why
FROM (SELECT *, model || coalesce('.' || "column", '') AS target FROM fx_outcomes WHERE impacted > 0) v
JOIN (SELECT *, {_PLATFORM} AS platform, {_NAME} AS name FROM fx_sub WHERE hop > 0) s
  ON s.profile = v.profile AND s.scope_id = v.scope_id
"""
CTES["fx_sources"] = """
SELECT 'order-' || o_orderkey AS name, 'models/' || o_orderpriority || '/order-' || o_orderkey || '.sql' AS path,
  'select key, key_hash from acct_' || o_custkey || ' where key > 0' AS sql_text FROM orders
"""
_SEP = "[^\\p{L}\\p{N}_]"


def replace_words_sql(text: str, old: str, new: str) -> str:
    """Words and what lies between them, by one constant pattern; each equal word is replaced."""
    parts = f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+|{_SEP}+')"
    return f"array_to_string(list_transform({parts}, lambda x: CASE WHEN x = {old} THEN {new} ELSE x END), '')"


def replace_first_sql(text: str, old: str, new: str) -> str:
    return f"regexp_replace({text}, '(^|{_SEP})' || {old} || '({_SEP}|$)', '\\1' || {new} || '\\2')"


CTES["fx_edits"] = f"""
SELECT * FROM (
  SELECT i.profile, i.change_id, i.impacted, i.name, s.path, s.sql_text AS original,
    CASE WHEN i.strategy = 'update_references'
      THEN {replace_words_sql("s.sql_text", 'i."column"', "i.new_value")} ELSE s.sql_text END AS modified
  FROM fx_impacts i JOIN fx_sources s ON s.name = i.name
  WHERE i.outcome = 'generate' AND i.tier = 'breaks' AND i.platform = 'orders'
    AND i."column" IS NOT NULL AND i.new_value IS NOT NULL)
WHERE original <> modified
"""
CTES["fx_decisions"] = """
SELECT *,
  CASE WHEN is_blocked THEN 'Decision' ELSE 'Analysis' END AS doc_type,
  CASE WHEN is_blocked THEN 'ripplemap:held-decision' ELSE 'ripplemap:resolved' END AS marker,
  CASE WHEN is_blocked THEN 'held' ELSE 'assessed' END || ': ' || kind || ' on ' || model
    || coalesce('.' || "column", '') AS title,
  CASE WHEN NOT is_blocked THEN NULL
    WHEN len(spot_platforms) > 0 THEN 'lineage of: ' || array_to_string(spot_platforms, ', ')
    WHEN coalesce(blocked_reason, '') <> '' THEN substring(blocked_reason, 1, 200)
    ELSE 'coverage is under the threshold' END AS blocked_on,
  total - fixed AS elsewhere,
  CASE WHEN outcome = 'no_op_safe' THEN 'nothing breaks, nothing to write'
    WHEN outcome = 'no_op_touches' THEN 'assets are touched but none breaks'
    WHEN outcome = 'escalate' THEN 'no template for ' || kind
    WHEN made AND strategy = 'update_references' THEN fixed || ' of ' || total
      || ' broken references are rewritten here in one step'
      || CASE WHEN total > fixed THEN '; ' || (total - fixed) || ' are kept in other systems' ELSE '' END
    WHEN made AND strategy = 'compatibility_alias' THEN 'readers keep the old name as an alias meanwhile'
    WHEN made THEN 'the new form comes first, readers move over, then the old form goes' END AS rationale,
  CASE WHEN outcome = 'escalate' THEN 'a person has to judge this kind of change'
    WHEN made AND impacted > 0 AND len(consumer_platforms) > 1 THEN 'assets on '
      || array_to_string(consumer_platforms, ', ') || ' are hit; their owners must agree on the timing'
    END AS escalation
FROM (SELECT o.*, coalesce(e.fixed, 0) AS fixed FROM fx_outcomes o LEFT JOIN (
  SELECT profile, change_id, count(*) AS fixed FROM fx_edits GROUP BY ALL) e USING (profile, change_id))
"""
CTES["fx_attempts"] = """
SELECT user_id AS change_id, event_id AS attempt, 'build models' AS command,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
  CASE event_type WHEN 'error' THEN 'Binder Error: Referenced column ' || props || ' not found'
    WHEN 'view' THEN 'column not found in ' || props ELSE props END AS output
FROM events
"""
CTES["fx_last"] = """
SELECT change_id, count(*) AS attempts, arg_max(exit_code, attempt) = 0 AS passed
FROM fx_attempts GROUP BY change_id
"""
CTES["fx_diffs"] = """
SELECT event_id AS diff_id, CASE WHEN event_id % 7 < 6 THEN '--- a/models/staging/stg_' || event_type
    || '.sql' || chr(10) || '+++ b/models/staging/stg_' || event_type || '.sql' || chr(10) ELSE '' END
  || CASE event_id % 7
    WHEN 0 THEN '@@ -1 +1 @@' || chr(10) || '-    k' || user_id || ',' || chr(10) || '+    k' || user_id
      || ' as n' || user_id || ',' || chr(10) || ' context'
    WHEN 1 THEN '-    k' || user_id || ',' WHEN 2 THEN '+    k' || user_id || ','
    WHEN 3 THEN '+    cast(k' || user_id || ' as decimal(10,2)) v,'
    WHEN 4 THEN '+    cast(k' || user_id || ' as bigint) v,'
    WHEN 5 THEN '-where a' || chr(10) || '+where a and b'
    ELSE 'no header' || chr(10) || '-gone' END AS text
FROM events
"""
CTES["fx_diff_lines"] = """
SELECT DISTINCT diff_id, model, CASE WHEN line[1] = '-' THEN 'removed' ELSE 'added' END AS side,
  trim(substring(line, 2)) AS body
FROM (SELECT diff_id, regexp_extract(text, '[+-]{3} [ab]/.*/(\\w+)\\.sql', 1) AS model,
  unnest(string_split(text, chr(10))) AS line FROM fx_diffs)
WHERE model <> '' AND regexp_matches(line, '^(-[^-]|\\+[^+])')
"""
CTES["fx_renames"] = """
SELECT a.diff_id, a.model, 'column_renamed' AS kind, a.old AS "column", a.new AS new_value, 1 AS ord
FROM (SELECT *, regexp_extract(body, '(?i)\\b(\\w+)\\s+as\\s+(\\w+)\\b', 1) AS old,
  regexp_extract(body, '(?i)\\b(\\w+)\\s+as\\s+(\\w+)\\b', 2) AS new FROM fx_diff_lines WHERE side = 'added') a
WHERE old <> '' AND EXISTS (SELECT 1 FROM fx_diff_lines r WHERE r.diff_id = a.diff_id AND r.side = 'removed'
  AND contains(r.body, a.old) AND NOT contains(lower(r.body), 'as'))
"""
CTES["fx_casts"] = """
SELECT diff_id, model, CASE WHEN base IN ('decimal', 'numeric', 'int', 'smallint', 'varchar') THEN 'type_narrowed'
  WHEN base IN ('bigint', 'double', 'text', 'hugeint') THEN 'type_widened' ELSE 'logic_changed' END AS kind,
  col AS "column", typ AS new_value, 2 AS ord
FROM (SELECT *, string_split(typ, '(')[1] AS base FROM (
  SELECT *, regexp_extract(body, '(?i)cast\\s*\\(\\s*(\\w+)\\s+as\\s+([\\w()\\d,]+)\\s*\\)', 1) AS col,
    lower(regexp_extract(body, '(?i)cast\\s*\\(\\s*(\\w+)\\s+as\\s+([\\w()\\d,]+)\\s*\\)', 2)) AS typ
  FROM fx_diff_lines WHERE side = 'added')) WHERE col <> ''
"""
CTES["fx_bare"] = """
SELECT DISTINCT diff_id, model, side, regexp_extract(trim(rtrim(body, ',')), '^(\\w+)$', 1) AS "column"
FROM fx_diff_lines WHERE regexp_extract(trim(rtrim(body, ',')), '^(\\w+)$', 1) <> ''
"""
CTES["fx_column_sets"] = """
SELECT diff_id, model, 'column_dropped' AS kind, "column", NULL::VARCHAR AS new_value, 3 AS ord FROM (
  SELECT diff_id, model, "column" FROM fx_bare WHERE side = 'removed'
  EXCEPT SELECT diff_id, model, "column" FROM fx_bare WHERE side = 'added')
UNION ALL
SELECT diff_id, model, 'column_added', "column", NULL, 3 FROM (
  SELECT diff_id, model, "column" FROM fx_bare WHERE side = 'added'
  EXCEPT SELECT diff_id, model, "column" FROM fx_bare WHERE side = 'removed')
"""
CTES["fx_known"] = "SELECT * FROM fx_renames UNION ALL SELECT * FROM fx_casts UNION ALL SELECT * FROM fx_column_sets"
CTES["fx_diff_changes"] = """
SELECT * FROM fx_known UNION ALL
SELECT DISTINCT diff_id, model, 'logic_changed', NULL::VARCHAR, NULL::VARCHAR, 4 FROM fx_diff_lines
WHERE diff_id NOT IN (SELECT diff_id FROM fx_known)
"""
CTES["fx_payloads"] = f"""
SELECT event_id AS id, '{{"results": [{{"urn": "' || acct || '"}}, {{"urn": "' || ord || '"}}, {{"urn": "' || acct
  || '"}}], "' || ord || '": 1, "note": "see \\"' || ord || '\\" there", "props": ' || props || '}}' AS payload
FROM (SELECT *, {_urn("customer", "'acct-' || user_id")} AS acct, {_urn("orders", "'order-' || event_id")} AS ord
  FROM events)
"""
CTES["fx_query_log"] = f"""
SELECT {_urn("customer", "'acct-' || user_id")} AS urn, ts,
  CASE WHEN event_type = 'view' THEN 'key' ELSE 'other' END AS "column", value FROM events
"""
CTES["fx_raw_users"] = """
SELECT c_custkey AS user_id, c_name AS email, DATE '2024-01-01' + (c_custkey % 600)::INTEGER AS signup_date,
  c_mktsegment AS country, c_custkey % 97 = 0 AS is_test FROM customer
"""
CTES["fx_raw_orders"] = """
SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_orderdate::DATE AS order_date,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status,
  o_orderpriority AS channel FROM orders
"""
CTES["fx_raw_items"] = """
SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS order_id, 'SKU-' || l_partkey AS sku,
  l_quantity::BIGINT AS quantity, round(l_extendedprice)::BIGINT AS unit_price_cents FROM lineitem
"""
CTES["fx_order_totals"] = """
SELECT o.order_id, o.order_date, o.channel, coalesce(s.cents, 0)::BIGINT AS amount_cents
FROM fx_raw_orders o LEFT JOIN (
  SELECT order_id, sum(quantity * unit_price_cents) AS cents FROM fx_raw_items GROUP BY order_id) s USING (order_id)
WHERE o.status = 'completed'
"""
CTES["fx_raw_payments"] = """
SELECT order_id AS payment_id, order_id, amount_cents, channel AS method,
  order_date + (order_id % 30)::INTEGER AS paid_at FROM fx_order_totals
"""
CTES["fx_raw_refunds"] = """
SELECT l_orderkey * 10 + l_linenumber AS refund_id, l_orderkey AS order_id,
  floor(l_extendedprice * l_discount)::BIGINT AS refund_amount_cents, l_shipdate::DATE AS refund_date,
  l_linestatus AS reason FROM lineitem WHERE l_returnflag = 'R'
"""
CTES["fx_stg_users"] = "SELECT user_id, email, signup_date, country FROM fx_raw_users WHERE NOT is_test"
CTES["fx_stg_orders"] = "SELECT order_id, cust_id, order_date, status, channel FROM fx_raw_orders"
CTES["fx_stg_items"] = """
SELECT item_id, order_id, sku, quantity, unit_price_cents / 100.0 AS unit_price_usd FROM fx_raw_items
"""
CTES["fx_stg_payments"] = """
SELECT payment_id, order_id, amount_cents / 100.0 AS amount_usd, method, paid_at FROM fx_raw_payments
"""
CTES["fx_stg_refunds"] = """
SELECT refund_id, order_id, refund_amount_cents / 100.0 AS refund_amount_usd, refund_date, reason
FROM fx_raw_refunds
"""
CTES["fx_revenue"] = """
SELECT p.order_id, o.cust_id, o.order_date, p.amount_usd::DOUBLE AS gross_revenue_usd,
  coalesce(r.refunded, 0)::DOUBLE AS refunded_usd, (p.amount_usd - coalesce(r.refunded, 0))::DOUBLE AS net_revenue_usd
FROM fx_stg_payments p JOIN fx_stg_orders o USING (order_id)
LEFT JOIN (SELECT order_id, sum(refund_amount_usd) AS refunded FROM fx_stg_refunds GROUP BY order_id) r USING (order_id)
"""
CTES["fx_ltv"] = """
SELECT cust_id, count(DISTINCT order_id) AS paid_order_count, sum(net_revenue_usd) AS lifetime_value_usd,
  min(order_date) AS first_paid_date, max(order_date) AS last_paid_date FROM fx_revenue GROUP BY cust_id
"""
CTES["fx_segment_input"] = """
SELECT u.user_id AS cust_id, l.lifetime_value_usd / 40.0 AS lifetime_value_usd
FROM fx_raw_users u LEFT JOIN fx_ltv l ON l.cust_id = u.user_id
"""

PLATFORM_OF_URN, NAME_OF_URN = _PLATFORM, _NAME


def _needed(text: str) -> set[str]:
    return set(re.findall(r"\bfx_\w+", text))


def compose(body: str) -> str:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in sorted(_needed(CTES[name]) - {name}):
            visit(other)
        done.append(name)

    for name in sorted(_needed(body)):
        visit(name)
    if not done:
        return body.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in done)
    return f"WITH {parts}\n{body.strip()}"
