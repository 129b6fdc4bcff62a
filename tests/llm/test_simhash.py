"""Near-duplicates against all pairs, and the parts of the search one by one."""

import random

import numpy as np
import pytest
from plain import slow_components, slow_fingerprint

from ripplemap.llm import simhash


def near(rnd, n):
    """Fingerprints in chains and clusters, and some of random bits."""
    fps = [rnd.getrandbits(64) for _ in range(n // 4)]
    while len(fps) < n:
        fp = rnd.choice(fps)
        for _ in range(rnd.randrange(5)):
            fp ^= 1 << rnd.randrange(64)
        fps.append(fp)
    return fps


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_every_pair(seed):
    fps = sorted(set(near(random.Random(seed), 1500)))
    values = np.array(fps, np.uint64)
    tree = simhash.fit_tree(values[::3], 3)
    edges = []
    for shard in range(8):
        home, guest = [], []
        for k, at, is_home in simhash.route(values, tree, 3):
            if k == shard:
                (home if is_home else guest).append(at)
        own = np.concatenate([*home, *guest]) if home else np.zeros(0, np.int64)
        n = sum(map(len, home))
        a, b = simhash.forest(values[own], n, 3, seed)
        edges += list(zip(own[a], own[b]))
    a, b = (np.array(x, np.int64) for x in zip(*edges))
    assert simhash.components(len(fps), a, b).tolist() == slow_components(fps, 3)


def test_whole_operator(docs):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(words) for _ in range(120)] for _ in range(40)]
    rows = [(5, None, "s"), (3, "", "s"), (4, " \n", "s"), (None, "only here", "s"), (9, "A b", "s")]
    rows += [(10, "a B", "s"), (11, "a b c d " * 20_000, "s")]
    for i in range(300):
        text = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            text[rnd.randrange(120)] = rnd.choice(words)
        rows.append((100 + i, " ".join(text), "s"))
    rows.append(rows[20])
    got = simhash.near_duplicates(docs(rows), shard_size=64).collect()
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    groups = slow_components(fps, 3)
    first = {}
    for (key, *_), g in zip(rows, groups):
        if key is not None:
            first[g] = min(first.get(g, key), key)
    want = sorted(
        (str(r[0]), fp, str(first.get(g))) for r, fp, g in zip(rows, fps, groups, strict=True)
    )
    assert want == sorted((str(r.key), r.fp % (1 << 64), str(r.component_id)) for r in got)
    kept = simhash.one_of_each(docs(rows), shard_size=64)
    assert kept.columns == docs(rows).columns
    of_row = {(r[0], r[1]): g for r, g in zip(rows, groups)}
    stayed = [(of_row[r.doc_id, r.text], r.doc_id) for r in kept.collect()]
    assert sorted(stayed, key=str) == sorted(((g, first.get(g)) for g in set(groups)), key=str)


def test_one_row_of_each_group_whatever_the_ids(docs):
    a, b, c = ("the cat sat on a mat", "quite another text here", "and one more of them all")
    rows = [(5, a, "s"), (5, b, "s"), (7, b, "s"), (None, a, "s"), (None, c, "s"), (None, c.upper(), "s")]
    rows += [(9, "", "x"), (8, None, "x")] + [(4, "only copies of one row", "s")] * 50 + [(4, b, "t")]
    for parts in (1, 4):
        kept = simhash.one_of_each(docs(rows).repartition(parts)).collect()
        got = [(r.doc_id, (r.text or "").lower()) for r in kept]
        want = [(5, a), (4, b), (None, c), (8, ""), (4, "only copies of one row")]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_few_guests():
    values = np.random.default_rng(5).integers(0, 2**64, 200_000, np.uint64, endpoint=False)
    for n, most in ((10**6, 1.6), (10**7, 3)):
        depth = simhash.tree_depth(n, simhash.SHARD_SIZE)
        tree = simhash.fit_tree(values[: max(simhash.SAMPLE, simhash.SAMPLE_OF_NODE << depth)], depth)
        sent = [(len(at), home) for _, at, home in simhash.route(values, tree, 3)]
        assert sum(k for k, home in sent if home) == len(values)
        assert sum(k for k, home in sent if not home) <= most * len(values)
        assert max(k for k, home in sent if home) < 2.5 * len(values) / 2**depth


def test_long_chain_and_empty(spark, docs):
    chain = spark.range(1, 400).selectExpr("id AS a", "id - 1 AS b").repartition(7)
    assert {(r.a, r.b) for r in simhash.stars(chain).collect()} == {(i, 0) for i in range(1, 400)}
    assert simhash.near_duplicates(docs([]).limit(0)).count() == 0
    assert simhash.one_of_each(docs([]).limit(0)).count() == 0
