"""Golden outcomes on the mini estate."""

import mini
import pytest
from pyspark.sql import functions as F

from ripplemap.operators import decisions as dec
from ripplemap.operators import evaluate, report


@pytest.fixture(scope="module")
def review(spark):
    return mini.build(spark)


# The declared estate has 25 entities; the part profile misses wall and robot, 8 of them: 17 / 25 = 0.68.
GOLDEN = {
    # change: (reached, score, impacted, overall, blocked, edits) per profile
    # Hop 1 of tides.level is dwell; then delays and port, then feedback and eta.
    (1, "full"): (6, 1.0, 0, "safe", False, 0),
    (1, "part"): (4, 0.68, 0, "safe", False, 0),
    (2, "full"): (1, 0.0, 0, "safe", False, 0),
    (2, "part"): (1, 0.0, 0, "safe", False, 0),
    # No column reads lifts.kg, so nothing can be claimed.
    (3, "full"): (1, 0.0, 0, "touches", True, 0),
    (3, "part"): (1, 0.0, 0, "touches", True, 0),
    # calls.ship: loads, dwell; berths, yard, wall.loads, delays, port; feedback, eta.
    (4, "full"): (10, 1.0, 9, "breaks", False, 3),
    (4, "part"): (5, 0.68, 4, "breaks", True, 0),
    (5, "full"): (6, 1.0, 5, "degrades", False, 0),
    (5, "part"): (4, 0.68, 3, "degrades", True, 0),
    (6, "full"): (10, 1.0, 9, "breaks", False, 3),
    (6, "part"): (5, 0.68, 4, "breaks", False, 3),
    # delays.minutes: feedback, then eta; the way back up finds feedback, which is known, and stops.
    (7, "full"): (3, 1.0, 2, "breaks", False, 0),
    (7, "part"): (2, 0.68, 1, "breaks", True, 0),
    # Two entities are called loads, and none nowhere.
    (8, "full"): (0, 0.0, 0, "touches", True, 0),
    (8, "part"): (0, 0.0, 0, "touches", True, 0),
    (9, "full"): (0, 0.0, 0, "touches", True, 0),
    (9, "part"): (0, 0.0, 0, "touches", True, 0),
}


def test_golden_outcomes(review):
    rows = {
        (r["change_id"], r["profile"]): (
            r["reached"], r["score"], r["impacted"], r["overall"], r["is_blocked"], r["fixed"],
        )
        for r in review.decisions.collect()
    }
    assert rows == GOLDEN


def test_override_only_where_the_gate_failed(review):
    rows = {(r["change_id"], r["profile"]): r for r in review.decisions.collect()}
    assert rows[6, "part"]["overridden"] and rows[6, "part"]["override_reason"] == "harbour master agreed"
    assert not rows[6, "full"]["overridden"]
    assert rows[4, "part"]["blocked_on"] == "lineage of: robot, wall"
    assert rows[3, "full"]["blocked_on"].startswith("coverage 0.0")


def test_edits_leave_longer_words_alone(review):
    texts = {r["name"]: r["modified"] for r in review.edits.filter("change_id = 4").collect()}
    assert texts == {
        "loads": "select c.vessel, ship_flag, kg from calls c",
        "dwell": "select vessel from calls where vessel > 0",
        "delays": "select vessel, minutes from dwell",
    }


def test_impacts_agree_with_verdict_counters(review):
    counted = review.impacts.groupBy("profile", "change_id").count().collect()
    want = {k: v[2] for k, v in GOLDEN.items() if v[2]}
    assert {(r["change_id"], r["profile"]): r["count"] for r in counted} == want


def test_splitting_hot_keys_changes_nothing(spark, review):
    split = mini.build(spark, rows_per_shard=1)
    columns = ["profile", "change_id", "urn", "tier", "why"]
    left = sorted(map(tuple, review.impacts.select(*columns).collect()))
    assert split.hubs is not None
    assert sorted(map(tuple, split.impacts.select(*columns).collect())) == left


def test_body_parts_hold_every_impact(review):
    whole = dec.body_parts(review.decisions, review.impacts, review.edits, review.checks)
    parts = dec.body_parts(review.decisions, review.impacts, review.edits, review.checks, per_part=2)
    schema = "impacted array<struct<urn:string>>, edits array<string>, verified boolean"

    def listed(df):
        read = df.select("profile", "change_id", F.from_json("body", schema).alias("b"))
        rows = read.select("profile", "change_id", F.explode("b.impacted.urn").alias("u"))
        return sorted(map(tuple, rows.collect()))

    assert listed(parts) == listed(whole)
    columns = ["profile", "change_id", "part", "parts", "body"]
    for n, made in ((1000, whole), (2, parts)):
        lists = dec.entry_lists(review.entries, n)
        shared = dec.body_parts(review.decisions, review.impacts, review.edits, review.checks, n, lists)
        got = sorted(map(tuple, shared.select(*columns).collect()))
        assert got == sorted(map(tuple, made.select(*columns).collect()))
    assert parts.count() > whole.count()
    body = whole.filter("change_id = 4 AND profile = 'full'").select(F.from_json("body", schema).alias("b"))
    read = body.first()["b"]
    assert read["verified"] and len(read["edits"]) == 3


def test_documents(review):
    lines = review.documents.orderBy("profile", "change_id", "section", "key").collect()
    text = {}
    for r in lines:
        text.setdefault((r["change_id"], r["profile"]), []).append(r["line"])
    refusal = "\n".join(text[4, "part"])
    assert "Waiting for lineage of: robot, wall" in refusal and "lower bound" in refusal
    assert "does not mean that nothing exists" in "\n".join(text[3, "part"])
    full = "\n".join(text[4, "full"])
    assert "Affected assets: 9, and the list is complete." in full
    # The flag goes by file stem, so the board called loads counts with the model of that name.
    assert "3 of 9 broken references" in full and full.count("fixed here") == 4
    assert "overridden" in "\n".join(text[6, "part"])
    assert "at least 4. robot, wall have no visible lineage" in "\n".join(text[6, "part"])
    assert "2 entities" in "\n".join(text[8, "full"])


def test_evaluation_metrics(spark, review):
    labels = spark.createDataFrame(
        [(1, "safe"), (2, "safe"), (3, "safe"), (4, "breaks"), (5, "degrades"), (7, "safe"), (8, "breaks")],
        "change_id bigint, expected_tier string",
    )
    rows = evaluate.metrics(evaluate.outcomes(review.decisions, labels)).collect()
    # Cases, false alarms (7), missed (8, which is held instead), safe ones held (3; 7 in part).
    assert {r["profile"]: tuple(r)[1:] for r in rows} == {"full": (7, 1, 1, 1), "part": (7, 1, 1, 2)}
    notices = report.review_lines(review.decisions).filter("section = 30")
    checks = evaluate.gate_checks(review.decisions, review.edits, notices, "full", "part").collect()
    assert len(checks) == 11 and all(r["passed"] for r in checks)
    lost = evaluate.gate_checks(review.decisions, review.edits, notices.limit(0), "full", "part").collect()
    assert [r["check"] for r in lost if not r["passed"]] == ["override-has-notice"]


def test_resume_and_summary(review):
    log = review.decisions
    again = dec.resume(log.filter("profile = 'part'"), log.filter("profile = 'full'")).collect()
    assert {r["change_id"] for r in again} == {4, 5, 7}
    assert all(r["resumed_from"].startswith("part/") and not r["is_blocked"] for r in again)
    lines = [r[0] for r in log.filter("change_id = 4").orderBy("profile").select(dec.summary_line()).collect()]
    assert lines == ["BREAKS, 9 impacted (2031-05-06 07:08)", "HELD, waiting for lineage of: robot, wall"]


def test_one_change_for_each_state_puts_all_tags(review):
    """Changes of one scope, tier and outcome tag alike, so one of them is listed."""
    few = review.impacts_of(dec.one_per_state(review.verdict_table))
    tags = [
        {tuple(r) for r in dec.tag_rows(rows).select("profile", "entity_urn", "tag").collect()}
        for rows in (review.impacts, few)
    ]
    assert tags[0] and tags[0] == tags[1]
    assert few.count() < review.impacts.count()
