"""What is taken from a walk without its entities, against the same taken from them."""

import random

import pytest
from pyspark.sql import functions as F

from ripplemap.functions.urn import compact, dataset_urn, expanded, key_platform, urn_platform
from ripplemap.operators import catalog, coverage, expand
from ripplemap.operators.skew import crowded_keys
from ripplemap.plans.session import stored

PROFILES = ["p", "q"]


def graph(spark, seed=11):
    """Cycles, loops, column edges without a table-level edge, edges that one profile sees."""
    rng = random.Random(seed)
    rows, columns, scopes = [], [], []
    for g in range(30):
        names = [f"g{g}n{i}" for i in range(rng.randint(3, 9))]
        for _ in range(rng.randint(2, 16)):
            seen = rng.choice(["p", "q", "pq", "pq"])
            edge = (rng.choice(names), rng.choice(names), rng.choice(["parsed", "curated", "inferred"]))
            rows += [(p, *edge) for p in seen]
        for _ in range(rng.randint(0, 8)):
            columns.append((rng.choice("pq"), rng.choice(names), "k", rng.choice(names), "k", "parsed"))
        scopes += [(3 * g + i, names[0], column) for i, column in enumerate(("", "k", "gone"))]

    def urn(name):
        return dataset_urn(F.when(F.length(name) % 2 == 0, "land").otherwise("dbt"), F.col(name))

    e = spark.createDataFrame(rows, "profile string, up_urn string, down_urn string, provenance string")
    c = spark.createDataFrame(
        columns, "profile string, up_urn string, up_col string, down_urn string, down_col string, provenance string"
    )
    s = spark.createDataFrame(scopes, "scope_id bigint, root_urn string, column string")
    named = [d.withColumns({u: urn(u) for u in ("up_urn", "down_urn", "root_urn") if u in d.columns}) for d in (e, c, s)]
    return [stored(d, "graph") for d in named]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_counters_and_orphans_of_a_walk(spark):
    edges, column_edges, scopes = graph(spark)
    links = expand.links_of(edges, PROFILES, stored)
    found = stored(expand.reached(scopes, links, column_edges, PROFILES, keep=stored), "found")
    entities, alike = expand.candidates(found, PROFILES), expand.signatures(found, PROFILES)
    assert rows_of(expand.hop_limits(entities)) == rows_of(expand.hop_limits(alike))
    trims = expand.trimmed_scopes(alike)
    assert not trims.isEmpty()
    sub, counted = stored(expand.subgraph(entities, trims), "sub"), expand.subgraph(alike, trims)
    for landing in ([], ["land"]):
        for true_provenance in (False, True):
            want = coverage.scope_facts(sub, landing, true_provenance)
            assert rows_of(coverage.scope_facts(counted, landing, true_provenance)) == rows_of(want)
        looked_up = coverage.orphan_rows(sub, landing, edges)
        few = coverage.orphan_rows(sub, landing, edges, walked=True)
        assert rows_of(few) == rows_of(looked_up) and not few.isEmpty()
        want = coverage.scope_facts(sub, landing, True, looked_up)
        assert rows_of(coverage.scope_facts(counted, landing, True, few)) == rows_of(want)
    assert coverage.unproven(sub).count() < sub.count()


def test_the_last_hop_is_not_stored_by_itself(spark):
    edges, column_edges, scopes = graph(spark)
    kept = []

    def keep(df, name):
        kept.append(name)
        return stored(df, name)

    links = expand.links_of(edges, PROFILES, keep)
    expand.reached(scopes, links, column_edges, PROFILES, 3, None, keep).count()
    assert kept == ["links", "column_hop", "starts", "hop_1", "hop_2"]


def test_platform_of_a_key(spark):
    keys = ["dbt,a", "dbt,", ",a", "dbt", "dbt,a,b", "dbt,a,", "dbt,)x", "dbt,a),b", "urn:x", "urn:a,b", "", "a,b,)c",
            "urn:urn:li:dataset:(urn:li:dataPlatform:x,y,DEV)"]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    own = df.select("k", key_platform(F.col("k")).alias("a"), urn_platform(expanded(F.col("k"))).alias("b"))
    assert all(r["a"] == r["b"] for r in own.collect())


def test_crowded_keys(spark):
    rows = [(k, "x" if k % 2 else None) for k in range(40) for _ in range(k)]
    df = spark.createDataFrame(rows, "k int, t string")
    for buckets in (1, 3, 1 << 16):
        got = {(r["k"], r["_shards"]) for r in crowded_keys(df, ["k", "t"], 10, buckets).collect()}
        assert got == {(k, -(-k // 10)) for k in range(11, 40)}


def test_platforms_are_sent_to_the_edges(spark):
    """Seven platforms would make seven tasks of all edges."""
    edges = spark.range(1000).select(F.lit("a").alias("down_platform"), F.lit("parsed").alias("provenance"), "id")
    platforms = spark.createDataFrame([("p", "a", True)], "profile string, platform string, emit_inferred boolean")
    seen = catalog.visible_edges(edges, platforms)
    assert "hashpartitioning" not in seen._jdf.queryExecution().executedPlan().toString()
    assert seen.count() == 1000


def test_edges_with_masks_are_those_of_each_profile(spark):
    """No shuffle by edge: an edge is one row for all profiles, and the walk on them finds the same."""
    edges, column_edges, scopes = graph(spark)
    plain = edges.drop("profile").distinct().withColumns(
        {f"{end}_platform": urn_platform(F.col(f"{end}_urn")) for end in ("up", "down")}
    )
    seen = [(p, x, p == PROFILES[0]) for p in PROFILES for x in ("land", "dbt") if (p, x) != (PROFILES[-1], "land")]
    platforms = spark.createDataFrame(seen, "profile string, platform string, emit_inferred boolean")
    each = catalog.visible_edges(plain, platforms)
    masked = catalog.masked_edges(plain, platforms, PROFILES)
    assert "hashpartitioning(src" not in masked._jdf.queryExecution().executedPlan().toString()
    told = catalog.edges_by_profile(masked, PROFILES)
    assert not told.isEmpty() and rows_of(told) == rows_of(each.select(*told.columns))
    own = column_edges.drop("profile").distinct().withColumns(
        {f"{end}_platform": urn_platform(F.col(f"{end}_urn")) for end in ("up", "down")}
    )
    fields = catalog.visible_edges(own, platforms)
    ends = own.select("up_urn", "down_urn", "up_col", "down_col").distinct()
    masked_fields = catalog.masked_edges(own, platforms, PROFILES).join(
        ends.withColumns({"src": compact(F.col("up_urn")), "dst": compact(F.col("down_urn"))}), ["src", "dst"]
    )
    found = [
        expand.reached(scopes, expand.links_of(e, PROFILES, stored), c, PROFILES, keep=stored)
        for e, c in ((each, fields), (masked, masked_fields))
    ]
    assert not found[0].isEmpty() and rows_of(found[0]) == rows_of(found[1])


@pytest.mark.parametrize("most", [2, 1000])
def test_links_of_other_kinds_are_not_read(spark, monkeypatch, most):
    """However many kinds may be told apart, the walk finds the same."""
    edges, column_edges, scopes = graph(spark)
    links = expand.links_of(edges, PROFILES, stored)
    want = rows_of(expand.reached(scopes, links, column_edges, PROFILES, keep=stored))
    monkeypatch.setattr(expand, "MOST_KINDS", most)
    assert rows_of(expand.reached(scopes, links, column_edges, PROFILES, keep=stored)) == want
    assert (expand._kinds(links, "src") is None) == (most < 1000)


def test_stored_links_are_left_out_by_their_kind(spark):
    """The scan is told the kinds of a hop, and edges of the same kinds lie side by side."""
    edges, _, _ = graph(spark)
    plain = edges.drop("profile").distinct().withColumns(
        {f"{end}_platform": urn_platform(F.col(f"{end}_urn")) for end in ("up", "down")}
    )
    platforms = spark.createDataFrame(
        [("p", "land", True), ("q", "dbt", True)], "profile string, platform string, emit_inferred boolean"
    )
    masked = stored(catalog.masked_edges(plain.coalesce(1), platforms, PROFILES), "masked", plain=("src", "dst"))
    pairs = [(r["src_kind"], r["dst_kind"]) for r in masked.collect()]
    assert len(set(pairs)) > 1 and sum(a != b for a, b in zip(pairs, pairs[1:])) == len(set(pairs)) - 1
    for once in (masked, edges):
        links = expand.links_of(once, PROFILES, stored)
        few = expand._of_kinds(links, "src", {(0, "dbt"), (1, "land")})
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(src_kind,dbt)" in plan and "EqualTo(dst_kind,land)" in plan
        want = links.where("(way = 0 AND src LIKE 'dbt,%') OR (way = 1 AND src LIKE 'land,%')")
        assert not few.isEmpty() and rows_of(few) == rows_of(want)


def test_kinds_met_from_both_sides():
    assert expand._meeting({(0, "a"), (1, "a")}, {(0, "a"), (0, "b")}) == {(0, "a")}
    assert expand._meeting(None, {(0, "a")}) == expand._meeting({(0, "a")}, None) == {(0, "a")}
