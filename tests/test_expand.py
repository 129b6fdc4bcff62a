"""The expansion against a plain breadth-first walk, cycles and shared visited sets included."""

import random

from ripplemap.functions.urn import compact, expanded
from ripplemap.operators import expand
from ripplemap.plans.session import stored
from pyspark.sql import functions as F


def brute(root, column, edges, column_edges):
    """Closures of 1, 2 and 3 hops in turn; a hop without a new entity ends its direction."""
    kept = {root: ("root", 0)}
    for direction in ("downstream", "upstream"):
        flip = direction == "upstream"
        links = [(b, a) if flip else (a, b) for a, b in edges]
        scoped = [(d, e, b, c) if flip else (b, c, d, e) for b, c, d, e in column_edges]
        for hops in (1, 2, 3):
            if hops == 1 and column:
                found = {dst for src, col, dst, _ in scoped if (src, col) == (root, column)}
            else:
                found, level = set(), {root}
                for _ in range(hops):
                    level = {b for a, b in links if a in level}
                    found |= level
            new = [u for u in found if u not in kept]
            for u in new:
                kept[u] = (direction, hops)
            if not new:
                break
    return {(u, *v) for u, v in kept.items()}


def test_random_graphs(spark):
    rng = random.Random(7)
    rows, columns, scopes, want = [], [], [], set()
    for g in range(40):
        nodes = [f"g{g}n{i}" for i in range(rng.randint(3, 8))]
        edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randint(2, 14))}
        cols = {(rng.choice(nodes), "k", rng.choice(nodes), rng.choice("kx")) for _ in range(rng.randint(0, 8))}
        rows += [("p", a, b, "parsed") for a, b in edges]
        columns += [("p", a, b, c, d, "parsed") for a, b, c, d in cols]
        for column in ("", "k", "gone"):
            scopes.append((len(scopes), nodes[0], column))
            found = brute(nodes[0], column, edges, cols)
            want |= {(len(scopes) - 1, u, d, h) for u, d, h in found}
    e = spark.createDataFrame(rows, "profile string, up_urn string, down_urn string, provenance string")
    c = spark.createDataFrame(
        columns,
        "profile string, up_urn string, up_col string, down_urn string, down_col string, provenance string",
    )
    s = spark.createDataFrame(scopes, "scope_id bigint, root_urn string, column string")
    links = stored(expand.links_of(e, ["p"]), "links")
    for hubs in (None, expand.link_hubs(links, rows_per_shard=2)):
        found = expand.closure(s, links, c, ["p"], hubs=hubs, keep=stored)
        sub = expand.subgraph(found, expand.trimmed_scopes(found))
        got = {tuple(r) for r in sub.select("scope_id", "urn", "direction", "hop").collect()}
        assert got == want


def test_compact_keys_are_reversible(spark):
    texts = [
        "urn:li:dataset:(urn:li:dataPlatform:dbt,stg_orders,PROD)",
        "urn:li:dataset:(urn:li:dataPlatform:dbt,stg_orders,DEV)",
        "urn:li:dataset:(urn:li:dataPlatform:urn:x,y,PROD)",
        "unresolved:thing", "urn:li:dataset:(", "", "dbt,stg_orders", "urn:urn:",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "u string")
    keyed = df.select("u", compact(F.col("u")).alias("k")).select("u", "k", expanded(F.col("k")).alias("b"))
    rows = keyed.collect()
    assert all(r["u"] == r["b"] for r in rows)
    assert len({r["k"] for r in rows}) == len(texts)
    assert rows[0]["k"] == "dbt,stg_orders"
