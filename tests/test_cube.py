"""Closures of all nodes and of asked ones against a plain walk from every node."""

import random
from collections import defaultdict

import pytest

from ripplemap.operators import catalog, cube, search
from ripplemap.plans.session import stored

PROFILES = ["p", "q", "r"]


def walk(links, start, hops):
    """Least distance of every node within ``hops``."""
    found, level = {start: 0}, [start]
    for d in range(1, hops + 1):
        level = [b for a in level for b in links[a] if b not in found]
        found |= {b: d for b in level}
    return found


def brute(edges, columns, hops):
    """{(profile, root, dir, column): {urn: d}} of all nodes and columns."""
    out = defaultdict(dict)
    for profile in PROFILES:
        for way in ("down", "up"):
            plain, scoped = defaultdict(set), defaultdict(set)
            for p, a, b, _ in edges:
                if p == profile:
                    plain[a if way == "down" else b].add(b if way == "down" else a)
            for p, a, x, b, y, _ in columns:
                if p == profile:
                    ends = [(a, x), (b, y)]
                    scoped[ends[way == "up"]].add(ends[way == "down"])
            for root in list(plain):
                found = walk(plain, root, hops)
                out[profile, root, way, "*"] = {u: d for u, d in found.items() if u != root}
            for root, column in list(scoped):
                near = {}
                for (u, _), d in walk(scoped, (root, column), hops).items():
                    if u != root:
                        near[u] = min(near.get(u, d), d)
                out[profile, root, way, column] = near
    return out


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(11)
    edges, columns = set(), set()
    for g in range(12):
        nodes = [f"urn:li:dataset:(urn:li:dataPlatform:x,g{g}n{i},PROD)" for i in range(rng.randint(2, 9))]
        for _ in range(rng.randint(1, 16)):
            a, b = rng.choice(nodes), rng.choice(nodes)
            edges |= {(p, a, b, "parsed") for p in PROFILES if rng.random() < 0.7}
            if rng.random() < 0.7:
                x, y = rng.choice("kx"), rng.choice("kxy")
                columns |= {(p, a, x, b, y, "parsed") for p in PROFILES if rng.random() < 0.7}
    hub = [f"urn:li:dataset:(urn:li:dataPlatform:y,{i},PROD)" for i in range(40)]
    edges |= {("p", hub[0], u, "parsed") for u in hub[1:]} | {("p", hub[1], hub[0], "parsed")}
    e = spark.createDataFrame(sorted(edges), "profile string, up_urn string, down_urn string, provenance string")
    c = spark.createDataFrame(
        sorted(columns),
        "profile string, up_urn string, up_col string, down_urn string, down_col string, provenance string",
    )
    return edges, columns, e, c


@pytest.mark.parametrize("hops", [1, 3, 5])
@pytest.mark.parametrize("split", [False, True])
def test_all_closures(graph, hops, split):
    edges, columns, e, c = graph
    hubs = cube.link_hubs(cube.mask_links(e, PROFILES), ["src"], 3) if split else None
    found = cube.distances(e, c, PROFILES, hops, stored, hubs)
    want = brute(edges, columns, hops)
    rows = cube.cube_rows(found, PROFILES).collect()
    got = defaultdict(dict)
    for r in rows:
        assert r["urn"] not in got[r["profile"], r["root_urn"], r["dir"], r["column"]]
        got[r["profile"], r["root_urn"], r["dir"], r["column"]][r["urn"]] = r["d"]
    assert got == {k: v for k, v in want.items() if v}
    sizes = {
        (*r[:4], r["hops"]): (r["n"], r["first_urn"], r["last_urn"])
        for r in cube.cube_sizes(found, PROFILES, hops).collect()
    }
    expected = {}
    for key, near in want.items():
        for k in range(1, hops + 1):
            if own := [u for u, d in near.items() if d <= k]:
                expected[*key, k] = len(own), min(own), max(own)
    assert sizes == expected


def test_some_columns_only(graph):
    edges, columns, e, c = graph
    found = cube.cube_rows(cube.distances(e, c, PROFILES, keep=stored, columns=["k"]), PROFILES)
    want = {k: v for k, v in brute(edges, columns, 3).items() if k[3] in "*k"}
    assert found.count() == sum(map(len, want.values()))


def test_a_walk_without_bound_ends(spark):
    n = 13
    ring = spark.createDataFrame([("p", f"n{i}", f"n{(i + 1) % n}") for i in range(n)], "profile string, up_urn string, down_urn string")
    links = cube.mask_links(ring, ["p"])
    found = cube._hops(links, [""], None, stored, None)
    assert found.count() == n * (n - 1) and found.agg({"d": "max"}).first()[0] == n - 1


@pytest.mark.parametrize("split", [False, True])
def test_asked_closures(spark, graph, split):
    edges, columns, e, c = graph
    rng = random.Random(3)
    want = brute(edges, columns, 4)
    keys = sorted(want) + [("p", "nowhere", "down", "*"), ("p", sorted(edges)[0][1], "up", "gone")]
    asked = [(*rng.choice(keys), rng.randint(0, 4)) for _ in range(150)]
    requests = spark.createDataFrame(asked, "profile string, root_urn string, dir string, column string, hops int")
    hubs = None
    if split:
        links = e.selectExpr("profile", "regexp_extract(up_urn, 'Platform:(.*),PROD', 1) AS src")
        hubs = {"down": cube.link_hubs(links, ["profile", "src"], 3)}
    found = cube.asked_distances(requests, e, c, stored, hubs)
    got = defaultdict(set)
    for r in cube.answers(requests, found).collect():
        assert r["urn"] not in got[tuple(r[:5])]
        got[tuple(r[:5])].add(r["urn"])
    expected = {r: {u for u, d in want.get(r[:4], {}).items() if d <= r[4]} for r in asked}
    assert got == {k: v for k, v in expected.items() if v}
    told = {tuple(r[:5]): r["n"] for r in search.keyed_closure(requests, found).collect()}
    assert told == {k: len(v) for k, v in expected.items()}


def test_only_what_is_asked_is_built(spark, graph):
    _, _, e, c = graph
    requests = spark.createDataFrame([("p", "n", "down", "*", 2)], "profile string, root_urn string, dir string, column string, hops int")
    assert cube.asked_distances(requests, e, None).columns == [*cube.REQUEST, "urn", "d"]
    columns = requests.selectExpr("profile", "root_urn", "dir", "'k' AS column", "hops")
    assert cube.asked_distances(columns, None, c).columns == [*cube.REQUEST, "urn", "d"]
    assert cube.asked_distances(requests.limit(0), None, None).count() == 0


def test_asked_closures_of_masked_edges(spark):
    """Edges stored once for all profiles give what a row for each profile gives."""
    rows = [("a,1", "b,2", 1), ("b,2", "c,3", 3), ("c,3", "d,4", 2), ("a,1", "c,3", 2), ("b,2", "c,3", 2)]
    masked = spark.createDataFrame(rows, "src string, dst string, mask long").selectExpr(
        "*", "'k' AS up_col", "'k' AS down_col", "'x' AS up_platform", "'x' AS down_platform", "'parsed' AS provenance"
    )
    plain = catalog.edges_by_profile(masked, ["p", "q"]).selectExpr("*", "'k' AS up_col", "'k' AS down_col")
    urns = sorted({r["up_urn"] for r in plain.collect()} | {r["down_urn"] for r in plain.collect()})
    asked = [(p, u, way, c, h) for p in "pq" for u in urns for way in ("down", "up") for c in "*k" for h in (1, 2)]
    requests = spark.createDataFrame(asked, "profile string, root_urn string, dir string, column string, hops int")
    want = cube.asked_distances(requests, plain, plain, stored)
    got = cube.asked_distances(requests, masked, masked, stored, profiles=["p", "q"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
