"""Diffs, rewriting, readers, registry, segments and joins on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from ripplemap.functions import constants as K
from ripplemap.functions.text import replace_first_word, replace_words
from ripplemap.marts.segments import customer_segments
from ripplemap.operators import catalog, changes, coverage, decisions, resolve, search
from ripplemap.operators.skew import hot_keys, join_split
from ripplemap.plans.combined import combined_check
from ripplemap.plans.session import scratch
from ripplemap.sources import files, readers, sinks

HEAD = "--- a/models/staging/stg_orders.sql\n+++ b/models/staging/stg_orders.sql\n"
DIFFS = {
    1: HEAD + "-    cust_id,\n+    cust_id as customer_id,",
    2: HEAD + "-    channel,",
    3: HEAD + "+    region,",
    4: HEAD + "-where a = 1\n+where a = 2",
    5: HEAD + "+    cast(amount as decimal(10,2)) amount,\n+    CAST(n AS BIGINT) n,\n+    cast(d as date) d,",
    6: "no header\n-gone",
    7: HEAD + "-    \n",
    8: HEAD + "-    last_name,\n+    name as last_name,",
}


def test_diffs(spark):
    df = spark.createDataFrame(list(DIFFS.items()), "diff_id bigint, text string")
    rows = changes.changes_from_diffs(df).collect()
    got = sorted((r["diff_id"], r["kind"], r["column"] or "", r["new_value"] or "") for r in rows)
    assert [g for g in got if g[0] == 1] == [
        (1, "column_dropped", "cust_id", ""), (1, "column_renamed", "cust_id", "customer_id"),
    ]
    assert [g[1:3] for g in got if g[0] == 2] == [("column_dropped", "channel")]
    assert [g[1:3] for g in got if g[0] == 3] == [("column_added", "region")]
    assert [g[1] for g in got if g[0] == 4] == ["logic_changed"]
    narrowed = [g[1:] for g in got if g[0] == 5 and g[1].startswith(("type", "logic"))]
    assert narrowed == [
        ("logic_changed", "d", "date"), ("type_narrowed", "amount", "decimal(10,2)"), ("type_widened", "n", "bigint"),
    ]
    assert not [g for g in got if g[0] == 6]
    assert [g[1] for g in got if g[0] == 7] == ["logic_changed"]
    assert [g[1:3] for g in got if g[0] == 8] == [("column_dropped", "last_name")]


def test_diffs_are_parsed_in_their_own_row(spark):
    df = spark.createDataFrame(list(DIFFS.items()), "diff_id bigint, text string")
    plan = changes.changes_from_diffs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan") == 1


def test_split_files(spark):
    feed = spark.createDataFrame([(1, DIFFS[2] + "\n" + DIFFS[3].replace("orders", "users"))], "diff_id int, text string")
    rows = changes.model_names(changes.split_files(feed)).collect()
    assert sorted((r["diff_id"], r["model"]) for r in rows) == [("1#0", "stg_orders"), ("1#1", "stg_users")]


@pytest.mark.parametrize(
    ("text", "old", "new", "every", "first"),
    [
        ("cust_id, cust_id_hash, x.cust_id", "cust_id", "c", "c, cust_id_hash, x.c", "c, cust_id_hash, x.cust_id"),
        ("été the éthe the", "the", "a$1", "été a$1 éthe a$1", "été a$1 éthe the"),
        ("a.b a-b a.b", "a.b", "\\Q", "\\Q a-b \\Q", "\\Q a-b a.b"),
        ("none", "x", "y", "none", "none"),
        ("😀 id\nid", "id", "k", "😀 k\nk", "😀 k\nid"),
    ],
)
def test_word_rewriting(spark, text, old, new, every, first):
    df = spark.createDataFrame([(text, old, new)], "t string, o string, n string")
    row = df.select(
        replace_words(F.col("t"), F.col("o"), F.col("n")), replace_first_word(F.col("t"), F.col("o"), F.col("n"))
    ).first()
    assert tuple(row) == (every, first)


def test_ambiguity_is_never_a_pick(spark):
    entities = catalog.with_urn(
        spark.createDataFrame([("dbt", "orders"), ("tableau", "orders"), ("dbt", "x")], "platform string, name string")
    )
    wanted = spark.createDataFrame(
        [(1, "orders", None), (2, "x", "c"), (3, "nope", None)], "change_id bigint, model string, column string"
    )
    rows = {r["model"]: r for r in resolve.resolve(resolve.distinct_targets(wanted), entities).collect()}
    assert rows["orders"]["resolution"] == "ambiguous" and rows["orders"]["root_urn"] is None
    assert rows["orders"]["platforms"] == ["dbt", "tableau"]
    assert rows["x"]["resolution"] == "resolved" and rows["nope"]["resolution"] == "unresolved"


def test_harvest_skips_keys_and_inner_text(spark):
    payload = (
        '{"urn:li:dataset:key" : 1, "a": ["urn:li:dataset:b", {"c": "urn:li:dataset:a"}, "urn:li:dataset:b"],'
        ' "n": "see \\"urn:li:dataset:z\\"", "e": "urn:li:dataset:q\\u0041\\"x"}'
    )
    df = spark.createDataFrame([(1, payload), (2, "not json \"urn:li:dataset:b\"")], "id int, payload string")
    rows = search.harvest_urns(df, "urn:li:dataset:").orderBy("pos").collect()
    assert [r["urn"] for r in rows] == ["urn:li:dataset:b", "urn:li:dataset:a", 'urn:li:dataset:qA"x']


def test_files(spark, tmp_path):
    for folder, text in (("b", "second"), ("a", "first\nline")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "m.sql").write_text(text)
    (tmp_path / "skip.txt").write_text("x")
    rows = readers.model_sources(spark, str(tmp_path)).collect()
    assert [(r["name"], r["sql_text"]) for r in rows] == [("m", "first\nline")]
    (tmp_path / "d.diff").write_text(DIFFS[1])
    assert readers.diffs(spark, str(tmp_path / "d.diff"), None).first()[0] == DIFFS[1]
    snap = tmp_path / "snap.json"
    snap.write_text(
        '{"profile": "dark", "registry": [{"platform": "dbt", "lineage_connector_configured": true,'
        ' "expected_entity_count": 16, "note": "n"}],\n "search": {"q": ["u9"]},'
        ' "lineage": {"u1|down|*|1": ["u2", "u3"], "u1|up|k|2": []}}'
    )
    doc = readers.snapshots(spark, str(snap))
    lineage = {tuple(r) for r in readers.snapshot_lineage(doc).collect()}
    assert lineage == {("dark", "u1", "down", "*", 1, "u2"), ("dark", "u1", "down", "*", 1, "u3")}
    assert tuple(readers.snapshot_registry(doc).first()) == ("dark", "dbt", True, 16, "n", True)
    assert [tuple(r) for r in readers.snapshot_search(doc).collect()] == [("dark", "q", "u9")]
    (tmp_path / "bad.json").write_text("no JSON")
    assert readers.snapshots(spark, str(tmp_path / "bad.json")).count() == 0
    assert readers.columns_of(spark, "no_such_table") == []


def test_decision_log_appends(spark):
    rows = spark.createDataFrame([("dark", 1)], "profile string, change_id bigint")
    folder = scratch(spark, "log")
    sinks.append_decisions(rows, folder)
    sinks.append_decisions(rows, folder)
    assert sinks.read_back(spark, folder, rows).count() == 2


def test_segments(spark):
    values = [None, -1.0, -0.5, 500.0, 500.01, 2000.0, 10000.0, 10000.5]
    df = spark.createDataFrame(list(enumerate(values)), "cust_id int, lifetime_value_usd double")
    got = [r["segment"] for r in customer_segments(df).orderBy("cust_id").collect()]
    assert got == ["nan", "nan", "low", "low", "mid", "mid", "high", "whale"]


def test_skewed_join_is_whole(spark):
    many = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id")
    one = spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    hot = hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"], rows_per_shard=50)
    got = join_split(many, one, hot, ["k"], "id")
    assert hot.count() == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, "k").collect()))


def test_search_and_lineage_caps(spark):
    entities = spark.createDataFrame([(f"u{i:02d}",) for i in range(30)], "urn string")
    assert [r["urn"] for r in search.search(entities, ["U"], 3).orderBy("rank").collect()] == ["u00", "u01", "u02"]
    cube = entities.selectExpr("'p' profile", "'r' root_urn", "'down' dir", "'*' AS column", "urn", "1 d")
    asked = cube.drop("urn", "d").distinct().selectExpr("*", "1 AS hops")
    assert search.lineage(asked, cube).count() == 30
    assert search.lineage(asked, cube, limit=5).count() == 5


def test_plain_answers_are_harvested_whole(spark):
    df = spark.createDataFrame(
        [(1, "urn:li:dataset:x, not JSON"), (2, "see urn:li:dataset:y"), (3, ""), (4, None)], "id int, payload string"
    )
    rows = search.harvest_urns(df, "urn:li:dataset:").collect()
    assert [(r["id"], r["urn"]) for r in rows] == [(1, "urn:li:dataset:x, not JSON")]


def test_search_filter_and_order(spark):
    entities = spark.createDataFrame([("u1", 3), ("u2", 2), ("u3", 1), ("v", 0)], "urn string, n int")
    assert search.search(entities, ["u"]).count() == 3
    best = search.search(entities, ["u"], 1, where=F.col("n") > 1, sort_by=(F.col("n"),)).collect()
    assert [(r["urn"], r["rank"]) for r in best] == [("u2", 1)]


def test_repeated_overrides_keep_one_row(spark):
    reviewed = spark.createDataFrame([(1, False), (2, False)], "change_id int, gate_passed boolean")
    reasons = spark.createDataFrame([(1, "b"), (1, "a"), (2, ""), (2, None)], "change_id int, reason string")
    rows = coverage.with_override(reviewed, reasons).orderBy("change_id").collect()
    assert [(r["change_id"], r["overridden"]) for r in rows] == [(1, True), (2, False)]


def test_registry_pairs_with_repeats_and_bad_counts(spark):
    urn = catalog._registry_urn_text("p")
    wire = spark.createDataFrame(
        [(urn, "one", None, [("k", "old"), ("k", "p"), ("e", "many")])],
        "urn string, profile string, properties map<string,string>, pairs array<struct<key:string,value:string>>",
    )
    renamed = {"k": K.KEY_PLATFORM, "e": K.KEY_EXPECTED}
    pairs = F.transform("pairs", lambda p: F.struct(
        F.element_at(F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv]), p["key"]).alias("key"), p["value"].alias("value")
    ))
    (row,) = catalog.registry_from_wire(wire.withColumn("pairs", pairs), ["p"]).collect()
    assert (row["platform"], row["expected"]) == ("p", 0)


def test_a_model_broken_before_the_change_matches_nothing(spark):
    t = spark.createDataFrame([(1,)], "c int")
    models = {"m": "SELECT c FROM {t}", "n": "SELECT fixed FROM {m}"}
    rows = combined_check(spark, {"t": t}, models, {"model": "m", "column": "c", "new_value": "fixed"}, [])
    found = {(r["variant"], r["model"]): (r["exit_code"], r["matches"]) for r in rows.collect()}
    assert found[("change_only", "n")] == (0, False)


def test_decision_log_takes_each_batch_once(spark, tmp_path):
    schema = "profile string, change_id int, is_blocked boolean, marker string, doc_type string, title string, blocked_on string, overall string, recorded_at timestamp, resumed_from string"
    row = lambda p, c, held, frm=None: (p, c, held, "m", "d", "held: t" if held else "t", "x", "breaks", None, frm)
    rows = spark.createDataFrame([row("dark", 1, True), row("dark", 2, True), row("dark", 3, False)], schema)
    log = sinks.DecisionLog(spark, f"file://{tmp_path}/log", rows.schema)
    assert log.read().count() == 0 and log.batches().count() == 0
    assert log.append(rows, "one") and not log.append(rows, "one")
    rows.write.parquet(f"file://{tmp_path}/log/rows/batch=broken")  # broke off before its commit
    assert log.read().count() == 3
    again = spark.createDataFrame([row("all", 1, True), row("all", 2, False), row("all", 3, False)], schema)
    again = again.withColumn("may_assert_safe", F.col("change_id") != 1)
    assert log.append(decisions.resumed_rows(log.read(), again), "two")
    assert decisions.resumed_rows(log.read(), again).count() == 0
    assert log.append(decisions.resumed_rows(log.read(), again), "three")
    got = sorted((r["profile"], r["change_id"], r["is_blocked"], r["title"], r["resumed_from"], r["batch"], r["seq"]) for r in log.read().collect())
    assert got == [
        ("all", 2, False, "t", "dark/2", "two", 1),
        ("dark", 1, True, "held: t", None, "one", 0), ("dark", 2, True, "held: t", None, "one", 0),
        ("dark", 3, False, "t", None, "one", 0),
    ]
    state = {r["decision"]: r["is_blocked"] for r in decisions.latest(log.read()).collect()}
    assert state == {"dark/1": True, "dark/2": False, "dark/3": False}


def test_orphans_of_the_induced_subgraph(spark):
    urn = "urn:li:dataset:(urn:li:dataPlatform:x,{},PROD)".format
    kept = [("p", 1, urn("r"), "root", 0), ("p", 1, urn("a"), "downstream", 1), ("p", 1, urn("b"), "upstream", 1)]
    kept += [("p", 2, urn("c"), "root", 0), ("p", 2, urn("a"), "downstream", 1), ("p", 2, urn("b"), "downstream", 2)]
    sub = spark.createDataFrame(kept, "profile string, scope_id int, urn string, direction string, hop int")
    edges = spark.createDataFrame(
        [("p", urn("r"), urn("a")), ("p", urn("c"), urn("b")), ("q", urn("c"), urn("a"))],
        "profile string, up_urn string, down_urn string",
    )
    for hot in (None, coverage.hot_entities(sub, 1)):
        rows = coverage.orphan_rows(sub, ["land"], edges, hot).collect()
        assert {(r["scope_id"], r["urn"]) for r in rows} == {(1, urn("b")), (2, urn("a"))}
    facts = coverage.scope_facts(sub, ["land"], orphans=coverage.orphan_rows(sub, ["land"], edges))
    assert {(r["scope_id"], r["orphans"]) for r in facts.collect()} == {(1, 1), (2, 1)}


def test_one_file_a_document_and_only_finished_writes_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(f"d{k % 3}/doc-{k}.txt", n, f"line {n} of {k} é") for k in range(40) for n in range(k % 7 + 1)]
    rows += [("empty.txt", 0, None)]
    df = spark.createDataFrame(rows, "file string, n int, line string").repartition(5)
    files.write_files(df, path, ["n"])
    (tmp_path / "out" / "attempt-00000000000000000000000000000000").mkdir()
    (tmp_path / "out" / "attempt-00000000000000000000000000000000" / "stray.txt").write_text("broke off")
    got = {r["path"]: r["text"] for r in files.read_files(spark, path).collect()}
    want = {}
    for name, n, line in sorted(rows, key=lambda r: r[:2]):
        want[name] = want.get(name, "") + (line or "") + "\n"
    assert got == want and files.committed(spark, path)[1] == 41
    assert len([p for p in tmp_path.rglob("*.txt")]) == 42
    files.write_files(df.limit(0), f"{path}-none", ["n"])
    assert files.read_files(spark, f"{path}-none").count() == 0


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver knows of lists only, and a task reads no more than one of them."""
    monkeypatch.setattr(files, "LIST_FILES", 5)
    monkeypatch.setattr(files, "BATCH_BYTES", 8)
    rows = [(f"d{k % 3}/doc-{k}.{'sql' if k % 2 else 'txt'}", "é" * (k % 4)) for k in range(60)]
    df = spark.createDataFrame(rows, "file string, line string").repartition(2)
    path = f"file://{tmp_path}/out"
    files.write_files(df, path, [], ending="")
    found = files.read_files(spark, path)
    assert found.inputFiles() == [] and 12 <= found.rdd.getNumPartitions() <= 12 + 4
    want = {f: t for f, t in rows if t}  # as with Spark's own readers, an empty file gives no row
    assert {r["path"]: r["text"] for r in found.collect()} == want and found.count() == len(want)
    names = files.read_files(spark, path, "*.sql", texts=False)
    assert sorted(r["path"] for r in names.collect()) == sorted(f for f in want if f.endswith(".sql"))
    assert names.columns == ["path"]


def test_review_documents_are_stored_in_little_room(spark, tmp_path):
    names = ["profile", "change_id", "is_blocked", "section", "key", "line"]
    rows = [("covered", k // 50, k % 100 < 50, 40, f"urn-{k:05}", f"breaks orders:order-{k}, kept elsewhere") for k in range(3000)]
    sinks.write_documents(spark.createDataFrame(rows, names), str(tmp_path / "out"))
    kinds = "profile string, outcome string, change_id long, section long, key string, line string"
    back = spark.read.schema(kinds).json(str(tmp_path / "out"))
    back = back.select("profile", "outcome", "change_id", "section", "key", "line").collect()
    want = [(p, "held" if b else "review", c, s, k, t) for p, c, b, s, k, t in rows]
    assert sorted(map(tuple, back)) == sorted(want)
    size = sum(f.stat().st_size for f in (tmp_path / "out").rglob("part-*"))
    assert size < sum(len(t) for *_, t in rows) / 2


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.87, 1.0])
def test_seeded_share(spark, share):
    from hashlib import md5

    from ripplemap.marts import facts

    # A third of the rows are equal, and a third share a key.
    rows = [(7, 1)] * 60 + [(8, k) for k in range(60)] + [(k, 0) for k in range(100, 160)] + [(None, 5)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = sorted(map(tuple, facts.seeded_share(df, "id", share, "s").collect()), key=str)
    assert len(got) == int(share * len(rows) + 0.5)
    order = lambda r: ("0" * 32 if r[0] is None else md5(f"s{r[0]}".encode()).hexdigest())
    kept = sorted(rows, key=order)[: len(got)]
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in kept)
    assert sorted(map(tuple, facts.seeded_share(df.repartition(5), "id", share, "s").collect()), key=str) == got
    assert facts.seeded_share(df.limit(0), "id", share, "s").count() == 0
