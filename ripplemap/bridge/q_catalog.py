"""Sources and sinks, catalog construction, catalog queries and annotations."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.bridge import q_decisions
from ripplemap.bridge.ctes import NAME_OF_URN, PLATFORM_OF_URN
from ripplemap.bridge.registry import query
from ripplemap.bridge.tables import PLATFORMS, PROFILES, TABLES, Driver, _name, line_name
from ripplemap.functions.constants import MAX_HOPS, URN_PREFIX
from ripplemap.functions.typing import type_family
from ripplemap.functions.urn import dataset_urn, field_urn, registry_urn, urn_name, urn_platform
from ripplemap.marts.segments import customer_segments
from ripplemap.operators import annotate, catalog, cube, decisions, expand, paths, postings, search
from ripplemap.plans.session import scratch, stored
from ripplemap.sources import files, readers, sinks

# --- sources and sinks ----------------------------------------------------


@query(
    "s1_urn_harvest",
    """SELECT id, value AS urn, (row_number() OVER (PARTITION BY id ORDER BY first))::INTEGER AS nth FROM (
  SELECT p.id, json_extract_string(t.value, '$') AS value, min(t.id) AS first
  FROM fx_payloads p, json_tree(p.payload::JSON) t
  WHERE t.type = 'VARCHAR' AND starts_with(json_extract_string(t.value, '$'), 'urn:li:dataset:') GROUP BY ALL)""",
)
def _(d: Driver) -> DataFrame:
    found = search.harvest_urns(d.payloads(), URN_PREFIX)
    # A payload holds few urns, so ordering them inside their own row group is bounded.
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "urn"))).alias("l"))
    return listed.select("id", F.posexplode("l").alias("i", "e")).select(
        "id", F.col("e.urn").alias("urn"), (F.col("i") + 1).alias("nth")
    )


@query(
    "s2_model_sources",
    """SELECT regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.sql$', '') AS name, min(url) AS path,
  count(*) AS files FROM pages GROUP BY 1""",
)
def _(d: Driver) -> DataFrame:
    pages = d.table("pages").select(F.col("url").alias("path"), F.col("html").alias("sql_text"))
    one = readers.one_per_stem(pages)
    files = pages.groupBy(readers.file_stem(F.col("path")).alias("name")).agg(
        F.count(F.lit(1)).alias("files")
    )
    return one.select("name", "path").join(files, "name")


@query(
    "s2_model_files",
    """SELECT 'doc-' || doc_id AS name, least(source, lang) || '/doc-' || doc_id || '.sql' AS path, md5(text) AS digest
FROM documents""",
)
def _(d: Driver) -> DataFrame:
    """Model files, most of them in two folders, written to storage and scanned back."""
    docs = d.table("documents")
    name = _name("doc-", F.col("doc_id"))
    folders = F.explode(F.array_distinct(F.array("source", "lang")))
    copies = docs.select(folders.alias("folder"), name.alias("name"), F.col("text").alias("line"))
    named = copies.withColumn("file", F.concat("folder", F.lit("/"), "name", F.lit(".sql")))
    folder = scratch(d.spark, "model_files")
    files.write_files(named, folder, [], ending="")
    found = readers.written_sources(d.spark, folder)
    return found.select("name", "path", F.md5(F.col("sql_text").cast("binary")).alias("digest"))


@query("s3_diff_scan", "SELECT text, count(*) AS n FROM fx_diffs GROUP BY text")
def _(d: Driver) -> DataFrame:
    folder = scratch(d.spark, "diff_feed")
    d.diffs().select("text").write.option("lineSep", readers.DIFF_BREAK).text(folder)
    return readers.diffs(d.spark, folder).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


_S4 = """SELECT 'covered' AS profile, {order} AS root_urn, 'down' AS dir, '*' AS "column", h.hops,
  {line} AS urn FROM fx_pairs CROSS JOIN (SELECT unnest([1, 2, 3]) AS hops) h"""


@query(
    "s4_snapshot_scan",
    _S4.format(
        order="'urn:li:dataset:(urn:li:dataPlatform:orders,order-' || l_orderkey || ',PROD)'",
        line="'urn:li:dataset:(urn:li:dataPlatform:lineitem,line-' || l_orderkey || '-' || l_linenumber || ',PROD)'",
    ),
)
def _(d: Driver) -> DataFrame:
    return readers.snapshot_lineage(_snapshot(d))


def _snapshot(d: Driver) -> DataFrame:
    """A document for each order with its lineage and a search, and one a profile with its registry."""
    order = dataset_urn(F.lit("orders"), _name("order-", F.col("l_orderkey")))
    line = dataset_urn(F.lit("lineitem"), line_name(F.col("l_orderkey"), F.col("l_linenumber")))
    # An order has at most seven line numbers, a registry one row a platform.
    lists = d.line_pairs().groupBy(order.alias("root"), _name("order-", F.col("l_orderkey")).alias("name")).agg(
        F.collect_set(line).alias("urns")
    )
    keys = F.transform(
        F.sequence(F.lit(1), F.lit(3)), lambda h: F.concat("root", F.lit("|down|*|"), h.cast("string"))
    )
    docs = lists.select(
        F.lit("covered").alias("profile"),
        F.map_from_arrays(keys, F.array_repeat("urns", 3)).alias("lineage"),
        F.create_map(F.col("name"), F.concat(F.array("root"), "urns")).alias("search"),
    )
    record = F.struct(
        "platform", F.col("connector").alias("lineage_connector_configured"),
        F.col("expected").alias("expected_entity_count"), "note",
        F.when(~F.col("hosts_consumers"), False).alias("hosts_consumers"),
    )
    registry = d.registry().groupBy("profile").agg(F.collect_list(record).alias("registry"))
    folder = scratch(d.spark, "snapshots")
    docs.write.json(folder)
    registry.write.mode("append").json(folder)
    return readers.snapshots(d.spark, folder, multi_line=False)


@query(
    "s4_snapshot_search",
    """SELECT 'covered' AS profile, 'order-' || l_orderkey AS query, unnest([
  'urn:li:dataset:(urn:li:dataPlatform:lineitem,line-' || l_orderkey || '-' || l_linenumber || ',PROD)']) AS urn FROM fx_pairs
UNION SELECT 'covered', 'order-' || l_orderkey,
  'urn:li:dataset:(urn:li:dataPlatform:orders,order-' || l_orderkey || ',PROD)' FROM fx_pairs""",
)
def _(d: Driver) -> DataFrame:
    return readers.snapshot_search(_snapshot(d))


@query(
    "s4_snapshot_registry",
    "SELECT profile, platform, connector, expected, note, hosts_consumers FROM fx_registry",
)
def _(d: Driver) -> DataFrame:
    return readers.snapshot_registry(_snapshot(d))


def _cube(d: Driver) -> DataFrame:
    found = cube.distances(
        d.masked_edges, d.masked_column_edges, list(PROFILES), MAX_HOPS, stored, d.down_hubs
    )
    return found


_CUBE_SQL = """
WITH RECURSIVE t(profile, dir, root_urn, urn, d) AS (
  SELECT profile, dir, src, dst, 1 FROM fx_links
  UNION
  SELECT t.profile, t.dir, t.root_urn, l.dst, t.d + 1 FROM t
  JOIN fx_links l ON l.profile = t.profile AND l.dir = t.dir AND l.src = t.urn WHERE t.d < 3),
clinks AS (
  SELECT profile, 'down' AS dir, up_urn AS src, down_urn AS dst FROM fx_pcolumn_edges
  UNION ALL SELECT profile, 'up', down_urn, up_urn FROM fx_pcolumn_edges),
k(profile, dir, root_urn, urn, d) AS (
  SELECT profile, dir, src, dst, 1 FROM clinks
  UNION
  SELECT k.profile, k.dir, k.root_urn, l.dst, k.d + 1 FROM k
  JOIN clinks l ON l.profile = k.profile AND l.dir = k.dir AND l.src = k.urn WHERE k.d < 3)
"""
_CUBE_ROWS = """(SELECT profile, root_urn, dir, '*' AS "column", urn, min(d) AS d FROM t GROUP BY ALL
  UNION ALL SELECT profile, root_urn, dir, 'key', urn, min(d) FROM k GROUP BY ALL) c
  JOIN (SELECT unnest([1, 2, 3]) AS hops) h ON h.hops >= c.d"""


def _cube_sql(select: str) -> str:
    """The recursive expressions sit inside a subquery so that ``compose`` can go in front."""
    return f"SELECT * FROM ({_CUBE_SQL} {select})"


_CUBE_COUNT = """SELECT profile, root_urn, dir, "column", hops, count(*) AS n, min(urn) AS first_urn,
  max(urn) AS last_urn FROM """ + _CUBE_ROWS + " GROUP BY ALL"


@query("s5_cube_sink", _cube_sql('SELECT profile, dir, "column", hops, count(*) AS n FROM ' + _CUBE_ROWS + " GROUP BY ALL"))
def _(d: Driver) -> DataFrame:
    folder = scratch(d.spark, "cube")
    rows = cube.cube_rows(_cube(d), list(PROFILES))
    sinks.write_cube(rows, folder)
    back = sinks.read_back(d.spark, folder, rows)
    counts = back.groupBy("profile", "dir", "column", "d").agg(F.count(F.lit(1)).alias("n"))
    hops = F.explode(F.sequence(F.col("d"), F.lit(MAX_HOPS))).alias("hops")
    within = counts.select("profile", "dir", "column", hops, "n")
    return within.groupBy("profile", "dir", "column", "hops").agg(F.sum("n").alias("n"))


@query("g8_closure_cube", _cube_sql(_CUBE_COUNT))
def _(d: Driver) -> DataFrame:
    return cube.cube_sizes(_cube(d), list(PROFILES), MAX_HOPS)


_TYPES = """CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint'
  WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  ELSE lower(column_type) END"""
_SCHEMA_SQL = "\nUNION ALL ".join(
    f"SELECT '{t}' AS \"table\", column_name AS \"column\", {_TYPES} AS native, "
    f"(SELECT count(*) FROM {t}) AS \"rows\" FROM (DESCRIBE {t})"
    for t in TABLES
)
_FAMILY = """CASE WHEN contains(upper(native), 'INT') OR contains(upper(native), 'DECIMAL')
  OR contains(upper(native), 'DOUBLE') OR contains(upper(native), 'FLOAT') OR contains(upper(native), 'NUMERIC')
  THEN 'number' WHEN contains(upper(native), 'BOOL') THEN 'boolean'
  WHEN contains(upper(native), 'DATE') OR contains(upper(native), 'TIME') THEN 'date' ELSE 'string' END"""


def _schema_rows(d: Driver) -> DataFrame:
    return catalog.schema_rows({t: d.table(t) for t in TABLES})


@query("s6_table_columns", f'SELECT "table", "column", native, "rows" FROM ({_SCHEMA_SQL})')
def _(d: Driver) -> DataFrame:
    for t in TABLES:
        d.table(t).createOrReplaceTempView(f"listed_{t}")
    listed = {t: readers.table_or_none(d.spark, f"listed_{t}") for t in [*TABLES, "no_such_table"]}
    rows = catalog.schema_rows({t: df for t, df in listed.items() if df is not None})
    return rows.select("table", "column", "native", "rows")


@query("c6_schema_rows", f'SELECT *, {_FAMILY} AS family FROM ({_SCHEMA_SQL})')
def _(d: Driver) -> DataFrame:
    return _schema_rows(d)


@query("q5_schema_fields", f"""SELECT *, {_FAMILY} AS family FROM ({_SCHEMA_SQL})
WHERE contains(lower("column"), 'key') OR contains(lower("column"), 'price')""")
def _(d: Driver) -> DataFrame:
    return search.schema_fields(_schema_rows(d), ["Key", "price"])


_SEGMENT = """CASE WHEN lifetime_value_usd IS NULL OR lifetime_value_usd <= -1 THEN 'nan'
  WHEN lifetime_value_usd <= 500 THEN 'low' WHEN lifetime_value_usd <= 2000 THEN 'mid'
  WHEN lifetime_value_usd <= 10000 THEN 'high' ELSE 'whale' END"""


@query(
    "s7_replace_table",
    f"SELECT cust_id, round(lifetime_value_usd, 5) AS lifetime_value_usd, {_SEGMENT} AS segment FROM fx_segment_input",
)
def _(d: Driver) -> DataFrame:
    segments = customer_segments(d.segment_input())
    folder = scratch(d.spark, "customer_segments")
    sinks.replace_table(segments.filter(F.col("segment") == "low"), "ripplemap_segments", folder)
    sinks.replace_table(segments, "ripplemap_segments", folder)
    return d.spark.table("ripplemap_segments").select(
        "cust_id", F.round("lifetime_value_usd", 5).alias("lifetime_value_usd"), "segment"
    )


@query(
    "s8_views_and_marts",
    """SELECT order_id, cust_id, round(net_revenue_usd, 2) AS net_revenue_usd FROM fx_revenue""",
)
def _(d: Driver) -> DataFrame:
    from ripplemap.marts import facts

    sinks.publish_staging(d.staging())
    v = d.spark.table
    sinks.publish_marts(
        {"fct_revenue": facts.fct_revenue(v("stg_payments"), v("stg_orders"), v("stg_refunds"))},
        scratch(d.spark, "marts"),
    )
    return v("fct_revenue").select(
        "order_id", "cust_id", F.round("net_revenue_usd", 2).alias("net_revenue_usd")
    )


_LOG = ["profile", "change_id", "is_blocked", "marker", "blocked_on", "overall", "recorded_at"]


@query(
    "s9_append_decisions",
    "SELECT profile, change_id, is_blocked, marker, blocked_on, overall FROM fx_decisions",
)
def _(d: Driver) -> DataFrame:
    rows = d.review().decisions.select(*_LOG)
    folder = scratch(d.spark, "decisions")
    sinks.append_decisions(rows.filter("is_blocked"), folder)
    sinks.append_decisions(rows.filter(~F.col("is_blocked")), folder)
    return sinks.read_back(d.spark, folder, rows).drop("recorded_at")


@query(
    "s10_review_documents",
    """SELECT profile, CASE WHEN is_blocked THEN 'held' ELSE 'review' END AS outcome, change_id,
  count(*) FILTER (section = 40) AS impact_lines, count(DISTINCT section) FILTER (section IN (10, 99)) AS ends
FROM (
  SELECT profile, change_id, is_blocked, 40 AS section FROM fx_impacts
  UNION ALL SELECT profile, change_id, is_blocked, unnest([10, 99]) FROM fx_decisions) GROUP BY ALL""",
)
def _(d: Driver) -> DataFrame:
    folder = scratch(d.spark, "documents")
    lines = d.review().documents
    sinks.write_documents(lines, folder)
    schema = "profile string, outcome string, change_id bigint, section int, key string, line string"
    back = d.spark.read.schema(schema).json(folder)
    return back.groupBy("profile", "outcome", "change_id").agg(
        F.count_if(F.col("section") == 40).alias("impact_lines"),
        F.count_distinct(F.when(F.col("section").isin(10, 99), F.col("section"))).alias("ends"),
    )


@query(
    "s10_document_files",
    f"""SELECT profile || '-' || model || '-' || CASE WHEN is_blocked THEN 'held' ELSE 'review' END || '-' || change_id || '.md'
  AS file, n AS lines, chars FROM fx_decisions JOIN (
  SELECT profile, change_id, count(*) AS n, sum(length(line))::BIGINT AS chars FROM (
    {q_decisions.DOCUMENT_LINES}) GROUP BY ALL) USING (profile, change_id)""",
)
def _(d: Driver) -> DataFrame:
    """Every decision's document as a file of its own, read back from the committed folders."""
    r, folder = d.review(), scratch(d.spark, "document_files")
    sinks.write_review_files(r.documents, r.decisions, folder)
    chars = F.length(F.replace("text", F.lit("\n"), F.lit(""))).cast("long")
    return files.read_files(d.spark, folder).select(
        F.col("path").alias("file"), (F.length("text") - chars).alias("lines"), chars.alias("chars")
    )


# --- catalog construction -------------------------------------------------


@query(
    "c1_declared_edges",
    """SELECT DISTINCT 'line-' || l_orderkey || '-' || l_linenumber AS down_name,
  unnest(['order-' || l_orderkey, 'acct-' || l_suppkey, 'part-' || l_partkey]) AS up_name FROM lineitem""",
)
def _(d: Driver) -> DataFrame:
    line = d.table("lineitem")
    ups = F.array(
        _name("order-", F.col("l_orderkey")), _name("acct-", F.col("l_suppkey")), _name("part-", F.col("l_partkey"))
    )
    declared = line.select(
        F.create_map(line_name(F.col("l_orderkey"), F.col("l_linenumber")), ups).alias("lineage")
    )
    rootless = d.table("region").select(
        F.create_map(_name("region-", F.col("r_regionkey")), F.array().cast("array<string>")).alias("lineage")
    )
    return catalog.edges_from_declared(declared.unionByName(rootless))


_CUST = "'urn:li:dataset:(urn:li:dataPlatform:customer,shop.acct-' || o_custkey || ',PROD)'"
_ORD = "'urn:li:dataset:(urn:li:dataPlatform:orders,order-' || o_orderkey || ',PROD)'"


@query(
    "c2_column_edges",
    f"""SELECT {_CUST} AS up_urn, 'key' AS up_col, {_ORD} AS down_urn, 'key' AS down_col FROM orders
UNION ALL SELECT {_CUST}, 'status', {_ORD}, 'state' FROM orders""",
)
def _(d: Driver) -> DataFrame:
    owner = F.concat(F.lit("shop."), _name("acct-", F.col("o_custkey")))

    def from_(column: str):
        return F.array(
            F.struct(
                F.lit("customer").alias("platform"), F.concat(owner, F.lit(f".{column}")).alias("qualified")
            )
        )

    declared = d.table("orders").select(
        F.lit("orders").alias("platform"),
        _name("order-", F.col("o_orderkey")).alias("model"),
        F.create_map(F.lit("key"), from_("key"), F.lit("state"), from_("status")).alias("columns"),
    )
    return catalog.column_edges_from_declared(declared)


@query(
    "c3_urn_builders",
    """SELECT urn, 'urn:li:schemaField:(' || urn || ',key)' AS field,
  'urn:li:dataset:(urn:li:dataPlatform:ripplemap,registry.' || platform || ',PROD)' AS registry FROM fx_entities""",
)
def _(d: Driver) -> DataFrame:
    return d.entities().select(
        "urn", field_urn(F.col("urn"), F.lit("key")).alias("field"), registry_urn(F.col("platform")).alias("registry")
    )


@query(
    "c4_upstream_platform",
    """SELECT up_name AS name, CASE WHEN up_name IN (SELECT 'part-' || p_partkey FROM part) THEN 'warehouse'
  ELSE 'model' END AS upstream_platform, count(*) AS edges FROM (
  SELECT DISTINCT l_orderkey, l_linenumber, unnest(['part-' || l_partkey, 'order-' || l_orderkey]) AS up_name
  FROM lineitem) GROUP BY ALL""",
)
def _(d: Driver) -> DataFrame:
    raw = d.table("part").select(_name("part-", F.col("p_partkey")).alias("name"))
    ups = d.edges().filter(
        (F.col("down_platform") == "lineitem") & F.col("up_platform").isin("part", "orders")
    ).groupBy(urn_name(F.col("up_urn")).alias("name")).agg(F.count(F.lit(1)).alias("edges"))
    return catalog.with_upstream_platform(ups, raw, "warehouse", "model")


@query(
    "c5_type_family",
    f"""SELECT native, {_FAMILY} AS family, count(*) AS n FROM (
  SELECT CASE event_id % 8 WHEN 0 THEN 'INTERVAL' WHEN 1 THEN 'decimal(' || user_id || ',2)' WHEN 2 THEN 'BOOLEAN'
    WHEN 3 THEN 'timestamp' WHEN 4 THEN 'date' WHEN 5 THEN 'varchar(' || user_id || ')' WHEN 6 THEN 'hugeint'
    ELSE event_type END AS native FROM events) GROUP BY ALL""",
)
def _(d: Driver) -> DataFrame:
    user = F.col("user_id").cast("string")
    names = [
        F.lit("INTERVAL"), F.concat(F.lit("decimal("), user, F.lit(",2)")), F.lit("BOOLEAN"),
        F.lit("timestamp"), F.lit("date"), F.concat(F.lit("varchar("), user, F.lit(")")), F.lit("hugeint"),
        F.col("event_type"),
    ]
    native = F.element_at(F.array(*names), (F.col("event_id") % 8 + 1).cast("int"))
    counted = d.table("events").groupBy(native.alias("native")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("family", type_family(F.col("native")))


_DESCRIBED = """SELECT e.platform, e.name, e.urn,
  CASE WHEN e.platform = 'customer' THEN c.c_name || ' of ' || c.c_mktsegment
    WHEN e.platform = 'lineitem' THEN 'Line: ' || replace(replace(e.name, '_', ' '), '-', ' ') END AS description,
  upper(e.platform[1]) || substring(e.platform, 2) AS platform_title
FROM fx_entities e LEFT JOIN customer c ON e.platform = 'customer' AND e.name = 'acct-' || c.c_custkey"""


def _described(d: Driver) -> DataFrame:
    notes = d.table("customer").select(
        F.lit("customer").alias("platform"), _name("acct-", F.col("c_custkey")).alias("name"),
        F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("description"),
    )
    return catalog.describe(d.entities(), notes, "Line: ", "lineitem")


@query("c7_descriptions", _DESCRIBED)
def _(d: Driver) -> DataFrame:
    return _described(d)


@query("c8_visible_edges", "SELECT profile, up_urn, down_urn, provenance FROM fx_pedges")
def _(d: Driver) -> DataFrame:
    seen = catalog.visible_edges(d.edges(), d.profile_platforms())
    return seen.select("profile", "up_urn", "down_urn", "provenance")


@query("c9_registry", "SELECT * FROM fx_registry")
def _(d: Driver) -> DataFrame:
    return d.registry()


@query(
    "c10_registry_wire",
    """SELECT profile, 'urn:li:dataset:(urn:li:dataPlatform:ripplemap,registry.' || platform || ',PROD)' AS urn,
  unnest(['platform', 'lineageConnectorConfigured', 'expectedEntityCount', 'registryNote', 'hostsConsumers']) AS key,
  unnest([platform, connector::VARCHAR, expected::VARCHAR, note, hosts_consumers::VARCHAR]) AS value
FROM fx_registry""",
)
def _(d: Driver) -> DataFrame:
    return catalog.registry_to_wire(d.registry()).select("profile", "urn", F.explode("properties").alias("key", "value"))


@query(
    "c11_registry_parse",
    """SELECT profile, platform, CASE WHEN platform = 'part' THEN false ELSE connector END AS connector,
  CASE WHEN platform = 'part' THEN 0 ELSE expected END AS expected,
  CASE WHEN platform = 'part' THEN '' ELSE note END AS note,
  CASE WHEN platform = 'part' THEN true ELSE hosts_consumers END AS hosts_consumers
FROM fx_registry WHERE platform <> 'region'""",
)
def _(d: Driver) -> DataFrame:
    """Half the rows as pair lists, one platform with nothing but its key, one without the key."""
    wire = catalog.registry_to_wire(d.registry())
    is_part, is_region = wire.urn.contains("registry.part,"), wire.urn.contains("registry.region,")
    sparse = F.create_map(F.lit("platform"), F.lit("part"))
    keyless = F.map_filter("properties", lambda k, v: k != "platform")
    props = F.when(is_part, sparse).when(is_region, keyless).otherwise(F.col("properties"))
    as_pairs = F.map_entries(props)
    mixed = wire.select(
        "profile", "urn",
        F.when(wire.urn.contains("orders"), F.lit(None)).otherwise(props).alias("properties"),
        F.when(wire.urn.contains("orders"), as_pairs).alias("pairs"),
    )
    return catalog.registry_from_wire(mixed, list(PLATFORMS))


@query(
    "c12_aspect_counts",
    f"""SELECT platform, 'key' AS aspect, count(*) AS n FROM fx_entities GROUP BY ALL
UNION ALL SELECT down_platform, 'lineage', count(DISTINCT down_urn) FROM fx_edges GROUP BY ALL
UNION ALL SELECT platform, 'properties', count(*) FROM ({_DESCRIBED}) WHERE description IS NOT NULL GROUP BY ALL""",
)
def _(d: Driver) -> DataFrame:
    return catalog.aspect_counts(d.entities(), d.edges(), _described(d))


@query(
    "c13_estate_size",
    """SELECT profile, sum(expected)::BIGINT AS expected,
  coalesce(string_agg(platform, ', ' ORDER BY platform) FILTER (NOT connector), '') AS dark_platforms
FROM fx_registry GROUP BY profile""",
)
def _(d: Driver) -> DataFrame:
    return catalog.estate_size(d.registry())


# --- catalog queries ------------------------------------------------------

_TERMS = ["NATION-1", "acct-10", "line-7-", "order-", "nothing-like-it"]


@query(
    "q1_search",
    f"""SELECT q.query, e.urn
FROM fx_entities e JOIN (SELECT unnest({_TERMS!r}) AS query) q ON contains(lower(e.urn), lower(q.query))""",
)
def _(d: Driver) -> DataFrame:
    return search.search(d.entities(), _TERMS)


@query(
    "q1_search_table",
    """SELECT DISTINCT q.query, e.urn FROM fx_entities e JOIN (
  SELECT 'Acct-' || c_custkey || ',' AS query FROM customer UNION ALL SELECT 'NATION-' || n_nationkey FROM nation
  UNION ALL SELECT lower(p_brand) FROM part UNION ALL SELECT '-' || n_nationkey FROM nation WHERE n_nationkey < 3
) q ON contains(lower(e.urn), lower(q.query))""",
)
def _(d: Driver) -> DataFrame:
    """Queries from tables; thousands of them, of which some match much and some nothing."""
    nation = F.col("n_nationkey").cast("string")
    terms = [
        d.table("customer").select(F.concat(_name("Acct-", F.col("c_custkey")), F.lit(",")).alias("query")),
        d.table("nation").select(F.concat(F.lit("NATION-"), nation).alias("query")),
        d.table("part").select(F.lower("p_brand").alias("query")),
        d.table("nation").where("n_nationkey < 3").select(F.concat(F.lit("-"), nation).alias("query")),
    ]
    return postings.contains_any(d.entities(), "urn", "urn", reduce(DataFrame.unionByName, terms))


@query(
    "q1_first_hits",
    """SELECT query, urn, rank::INTEGER AS rank FROM (
  SELECT q.query, e.urn, row_number() OVER (PARTITION BY q.query ORDER BY e.urn) AS rank FROM fx_entities e
  JOIN (SELECT DISTINCT 'ORDER-' || user_id AS query FROM events) q ON contains(lower(e.urn), lower(q.query))
  WHERE e.platform = 'orders') WHERE rank <= 10""",
)
def _(d: Driver) -> DataFrame:
    """The first ten orders for each user's query."""
    terms = d.table("events").select(_name("ORDER-", F.col("user_id")).alias("query"))
    orders = d.entities().where("platform = 'orders'")
    return postings.first_hits(postings.contains_any(orders, "urn", "urn", terms), "urn", 10)


@query(
    "q2_entity_lookup",
    """SELECT urn, platform, name FROM fx_entities WHERE urn IN (
  SELECT 'urn:li:dataset:(urn:li:dataPlatform:orders,order-' || event_id || ',PROD)' FROM events)""",
)
def _(d: Driver) -> DataFrame:
    wanted = d.table("events").select(
        dataset_urn(F.lit("orders"), _name("order-", F.col("event_id"))).alias("urn")
    )
    return search.lookup(d.entities(), wanted).select("urn", "platform", "name")


def _asked(d: Driver, asked: DataFrame) -> DataFrame:
    return cube.asked_distances(
        asked, d.masked_edges, d.masked_column_edges, stored, profiles=list(PROFILES)
    )


def _requests(d: Driver, table: str, key: str, prefix: str, direction: str, hops: int) -> DataFrame:
    return d.table(table).select(
        F.explode(F.array(*[F.lit(p) for p in PROFILES])).alias("profile"),
        dataset_urn(F.lit(table), _name(prefix, F.col(key))).alias("root_urn"),
        F.lit(direction).alias("dir"), F.lit("*").alias("column"), F.lit(hops).alias("hops"),
    )


@query(
    "q3_lineage_lookup",
    _cube_sql(
        f"""SELECT profile, root_urn, dir, "column", hops, urn FROM {_CUBE_ROWS}
WHERE "column" = '*' AND dir = 'down' AND hops = 2 AND contains(root_urn, 'dataPlatform:nation,')
  AND contains(lower(urn), 'order')"""
    ),
)
def _(d: Driver) -> DataFrame:
    asked = _requests(d, "nation", "n_nationkey", "nation-", "down", 2)
    found = _asked(d, asked)
    return search.lineage(asked, found, name_filter="ORDER")


@query(
    "q4_paths_between",
    """SELECT source, target, path FROM (
  SELECT DISTINCT n.up_urn AS source, s.down_urn AS target, n.up_urn || ' > ' || n.down_urn || ' > ' || s.down_urn AS path
  FROM fx_edges n JOIN fx_edges s ON s.up_urn = n.down_urn WHERE n.up_platform = 'nation' AND s.down_platform = 'lineitem'
  UNION
  SELECT DISTINCT n.up_urn, l.down_urn, n.up_urn || ' > ' || n.down_urn || ' > ' || o.down_urn || ' > ' || l.down_urn
  FROM fx_edges n JOIN fx_edges o ON o.up_urn = n.down_urn JOIN fx_edges l ON l.up_urn = o.down_urn
  WHERE n.up_platform = 'nation' AND l.down_platform = 'lineitem')
WHERE (source, target) IN (
  SELECT 'urn:li:dataset:(urn:li:dataPlatform:nation,nation-' || s_nationkey || ',PROD)',
    'urn:li:dataset:(urn:li:dataPlatform:lineitem,line-' || l_orderkey || '-' || l_linenumber || ',PROD)'
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)""",
)
def _(d: Driver) -> DataFrame:
    pairs = d.table("lineitem").join(
        d.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey")
    ).select(
        dataset_urn(F.lit("nation"), _name("nation-", F.col("s_nationkey"))).alias("source"),
        dataset_urn(F.lit("lineitem"), line_name(F.col("l_orderkey"), F.col("l_linenumber"))).alias("target"),
    )
    found = paths.paths_between(pairs, d.edges(), MAX_HOPS, stored)
    return found.select("source", "target", F.array_join("path", " > ").alias("path"))


@query(
    "q4_column_paths",
    """SELECT * FROM (WITH RECURSIVE e AS (SELECT DISTINCT up_urn, down_urn FROM fx_pcolumn_edges WHERE profile = 'covered'),
w(source, node, path) AS (
  SELECT up_urn, down_urn, up_urn || '.key > ' || down_urn || '.key' FROM e WHERE contains(up_urn, 'Platform:region,')
  UNION ALL SELECT source, e.down_urn, path || ' > ' || e.down_urn || '.key' FROM w JOIN e ON e.up_urn = w.node)
SELECT source, node AS target, path FROM w WHERE contains(node, 'Platform:orders,')
  AND node IN (SELECT 'urn:li:dataset:(urn:li:dataPlatform:orders,order-' || event_id || ',PROD)' FROM events))""",
)
def _(d: Driver) -> DataFrame:
    """From each region's key to the keys of its orders with an event, over any number of hops."""
    bought = d.table("events").join(d.table("orders"), F.col("event_id") == F.col("o_orderkey"))
    placed = bought.join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    pairs = placed.select(
        dataset_urn(F.lit("region"), _name("region-", F.col("n_regionkey"))).alias("source"),
        F.lit("key").alias("source_column"),
        dataset_urn(F.lit("orders"), _name("order-", F.col("event_id"))).alias("target"),
        F.lit("key").alias("target_column"),
    )
    links = d.profile_column_edges.where("profile = 'covered'")
    found = paths.column_paths_between(pairs, links, None, stored)
    places = F.transform("path", lambda p: F.concat(p["urn"], F.lit("."), p["column"]))
    return found.select("source.urn", "target.urn", F.array_join(places, " > ").alias("path")).toDF(
        "source", "target", "path"
    )


@query(
    "q6_query_history",
    "SELECT urn, count(*) AS queries, max(ts) AS last_ts FROM fx_query_log WHERE \"column\" = 'key' GROUP BY urn",
)
def _(d: Driver) -> DataFrame:
    return search.query_history(d.query_log(), "key")


_GREP = "[Tt]he [a-z]+"


@query(
    "q7_grep_documents",
    f"""SELECT doc_id, len(regexp_extract_all(text, '{_GREP}')) AS matches,
  right(head, 200) || hit || substring(text, length(head) + length(hit) + 1, 200) AS context FROM (
  SELECT doc_id, text, regexp_extract(text, '(?s)\\A(.*?)({_GREP})', 1) AS head,
    regexp_extract(text, '(?s)\\A(.*?)({_GREP})', 2) AS hit FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
WHERE hit <> ''""",
)
def _(d: Driver) -> DataFrame:
    return search.grep_documents(d.table("documents"), d.table("labels"), _GREP)


@query(
    "q8_search_documents",
    "SELECT doc_id, source FROM documents WHERE contains(text, 'the')",
)
def _(d: Driver) -> DataFrame:
    return search.search_documents(d.table("documents"), "the")


@query(
    "q8_document_table",
    """SELECT q.query, d.doc_id FROM documents d JOIN (SELECT DISTINCT substr(text, 1, 24) AS query FROM benchmark) q
  ON contains(d.text, q.query)""",
)
def _(d: Driver) -> DataFrame:
    """Documents that hold the opening words of a benchmark item, letter by letter."""
    openings = d.table("benchmark").select(F.substring("text", 1, 24).alias("query"))
    return postings.contains_any(d.table("documents"), "doc_id", "text", openings, fold=False)


@query(
    "q9_keyed_closure",
    f"""SELECT r.*, coalesce(c.n, 0) AS n, c.first_urn, c.last_urn FROM (
  SELECT DISTINCT p.profile, coalesce(e.urn, 'unresolved:' || t.model) AS root_urn, 'down' AS dir,
    coalesce(nullif(t."column", ''), '*') AS "column", 3 AS hops
  FROM fx_resolved t LEFT JOIN fx_entities e ON e.urn = t.root_urn CROSS JOIN fx_profiles p) r
LEFT JOIN ({_cube_sql(_CUBE_COUNT)}) c USING (profile, root_urn, dir, "column", hops)""",
)
def _(d: Driver) -> DataFrame:
    r = d.review()
    rooted = r.resolved.select(
        F.coalesce("root_urn", F.concat(F.lit("unresolved:"), "model")).alias("root_urn"), "column"
    )
    asked = rooted.select(
        F.explode(F.array(*[F.lit(p) for p in PROFILES])).alias("profile"), "root_urn",
        F.lit("down").alias("dir"), F.coalesce(F.nullif("column", F.lit("")), F.lit("*")).alias("column"),
        F.lit(3).alias("hops"),
    )
    found = _asked(d, asked)
    return search.keyed_closure(asked, found)


# --- annotations ----------------------------------------------------------

_TAGS_SQL = """SELECT DISTINCT urn AS entity_urn, '' AS column_path, 'tag' AS kind, tag AS annotation FROM (
  SELECT urn, unnest(CASE WHEN n_spots > 0 THEN [first, 'urn:li:tag:ripplemap-coverage-gap'] ELSE [first] END) AS tag
  FROM (SELECT *, CASE WHEN is_blocked THEN 'urn:li:tag:ripplemap-held' ELSE 'urn:li:tag:ripplemap-verified' END AS first
    FROM fx_impacts))"""


@query(
    "w1_add_annotations",
    f"""SELECT * FROM ({_TAGS_SQL})
UNION SELECT up_urn, 'key', 'owner', 'urn:li:corpuser:' || c.c_mktsegment FROM fx_edges e
  JOIN customer c ON e.up_platform = 'customer'
    AND e.up_urn = 'urn:li:dataset:(urn:li:dataPlatform:customer,acct-' || c.c_custkey || ',PROD)'
  WHERE e.down_platform = 'orders'""",
)
def _(d: Driver) -> DataFrame:
    none = d.spark.createDataFrame([], "entity_urn string, column_path string, kind string, annotation string")
    r = d.review()
    impacts = r.impacts_of(decisions.one_per_state(r.verdict_table))
    tags = decisions.tag_rows(impacts).select("entity_urn", "tag").distinct().select(
        F.array("tag").alias("annotations"), F.array("entity_urn").alias("entity_urns"),
        F.array().cast("array<string>").alias("column_paths"),
    )
    buyers = d.table("orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    owners = d.table("customer").join(buyers, "c_custkey", "left_semi").select(
        F.array(F.concat(F.lit("urn:li:corpuser:"), "c_mktsegment")).alias("annotations"),
        F.array(dataset_urn(F.lit("customer"), _name("acct-", F.col("c_custkey")))).alias("entity_urns"),
        F.array(F.lit("key")).alias("column_paths"),
    )
    return annotate.add_annotations(annotate.add_annotations(none, tags, "tag"), owners, "owner")


@query(
    "w2_update_descriptions",
    """SELECT p.* FROM (
  SELECT urn AS entity_urn, -1 AS seq, name AS text FROM fx_entities WHERE platform = 'customer'
  UNION ALL SELECT urn, event_id, event_type || ': ' || props FROM (
    SELECT *, 'urn:li:dataset:(urn:li:dataPlatform:customer,acct-' || user_id || ',PROD)' AS urn FROM events)) p
LEFT JOIN (SELECT 'urn:li:dataset:(urn:li:dataPlatform:customer,acct-' || user_id || ',PROD)' AS entity_urn,
  max(event_id) AS from_seq FROM events WHERE event_type = 'purchase' GROUP BY ALL) r USING (entity_urn)
WHERE r.from_seq IS NULL OR p.seq >= r.from_seq""",
)
def _(d: Driver) -> DataFrame:
    urn = dataset_urn(F.lit("customer"), _name("acct-", F.col("user_id")))
    current = d.entities().filter(F.col("platform") == "customer").select(
        F.col("urn").alias("entity_urn"), F.lit(-1).cast("bigint").alias("seq"), F.col("name").alias("text")
    )
    updates = d.table("events").select(
        urn.alias("entity_urn"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", "replace").otherwise("append").alias("op"),
        F.concat("event_type", F.lit(": "), "props").alias("text"),
    )
    return annotate.update_descriptions(current, updates)


@query(
    "w3_structured_properties",
    """SELECT c_custkey AS id, 'urn:li:dataset:(urn:li:dataPlatform:customer,acct-' || c_custkey || ',PROD)' AS entity_urn,
  CASE WHEN e.k IS NULL THEN 'seg' ELSE 'k,seg' END AS keys, coalesce(e.k, '') AS k, coalesce(e.last_type, c_mktsegment) AS seg
FROM customer c LEFT JOIN (
  SELECT user_id, arg_max(json_extract_string(props, '$.k'), event_id) AS k, arg_max(event_type, event_id) AS last_type
  FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey""",
)
def _(d: Driver) -> DataFrame:
    urn = "urn:li:dataset:(urn:li:dataPlatform:customer,acct-"
    current = d.table("customer").select(
        dataset_urn(F.lit("customer"), _name("acct-", F.col("c_custkey"))).alias("entity_urn"),
        F.create_map(F.lit("seg"), F.array("c_mktsegment")).alias("properties"),
    )
    last = d.table("events").groupBy("user_id").agg(
        F.max_by(F.get_json_object("props", "$.k"), "event_id").alias("k"),
        F.max_by("event_type", "event_id").alias("t"),
    )
    incoming = last.select(
        dataset_urn(F.lit("customer"), _name("acct-", F.col("user_id"))).alias("entity_urn"),
        F.create_map(F.lit("k"), F.array("k"), F.lit("seg"), F.array("t")).alias("properties"),
    )
    merged = annotate.upsert_properties(current, incoming)
    return merged.select(
        F.regexp_extract(F.replace("entity_urn", F.lit(urn), F.lit("")), r"^(\d+)", 1).cast("bigint").alias("id"),
        "entity_urn",
        F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("keys"),
        F.coalesce(F.try_element_at("properties", F.lit("k"))[0], F.lit("")).alias("k"),
        F.try_element_at("properties", F.lit("seg"))[0].alias("seg"),
    )


@query(
    "r1_urn_parse",
    f"""SELECT urn, nullif({PLATFORM_OF_URN}, '') AS platform, nullif({NAME_OF_URN}, '') AS name FROM (
  SELECT urn FROM fx_entities UNION ALL SELECT 'unresolved:' || model FROM fx_targets
  UNION ALL SELECT 'see ' || urn FROM fx_entities WHERE platform = 'nation')""",
)
def _(d: Driver) -> DataFrame:
    e = d.entities().select("urn", "platform")
    texts = (
        e.select("urn")
        .unionByName(d.review().targets.select(F.concat(F.lit("unresolved:"), "model").alias("urn")))
        .unionByName(e.filter(F.col("platform") == "nation").select(F.concat(F.lit("see "), "urn").alias("urn")))
    )
    return texts.select("urn", urn_platform(F.col("urn")).alias("platform"), urn_name(F.col("urn")).alias("name"))


