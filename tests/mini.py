"""A harbour's estate with outcomes worked out by hand.

Sensors and bookings land in a lake, models are built in a mill, a wall shows boards, a robot predicts.
``loads`` exists twice, ``delays`` and ``feedback`` feed each other, and ``tariffs`` has no origin.

    lake.berth_calls -> calls    calls -> loads, dwell      dwell -> delays     delays -> feedback
    lake.cargo_lines -> loads    tides -> dwell             feedback -> delays  delays -> robot.eta
    lake.tide_log    -> tides    loads -> wall.yard, wall.loads
    lake.crane_runs  -> lifts    lifts -> wall.yard         dwell -> wall.port  calls -> wall.berths
"""

from ripplemap.operators import catalog
from ripplemap.plans.review import Catalog, Review

ENTITIES = {
    "lake": "berth_calls cargo_lines tide_log crane_runs",
    "mill": "calls loads tides lifts dwell delays feedback tariffs",
    "wall": "yard loads port berths",
    "robot": "eta",
}
EDGES = """
lake.berth_calls mill.calls; lake.cargo_lines mill.loads; lake.tide_log mill.tides; lake.crane_runs mill.lifts;
mill.calls mill.loads; mill.calls mill.dwell; mill.tides mill.dwell; mill.dwell mill.delays;
mill.feedback mill.delays; mill.delays mill.feedback; mill.delays robot.eta; mill.loads wall.yard;
mill.lifts wall.yard; mill.loads wall.loads; mill.dwell wall.port; mill.calls wall.berths
"""
COLUMN_EDGES = """
calls.ship loads.ship; calls.ship dwell.ship; dwell.ship delays.ship; tides.level dwell.depth;
delays.minutes feedback.minutes; feedback.minutes delays.minutes
"""
# Platform, declared entities, and whether it holds consumers.
DECLARED = [("lake", 5, False), ("mill", 12, True), ("wall", 6, True), ("robot", 2, True)]
PROFILES = ("full", "part")
CHANGES = [
    (1, "tides", "type_widened", "level", None),
    (2, "lifts", "column_added", "operator", None),
    (3, "lifts", "column_dropped", "kg", None),
    (4, "calls", "column_renamed", "ship", "vessel"),
    (5, "tides", "type_narrowed", "level", None),
    (6, "calls", "column_renamed", "ship", "vessel"),
    (7, "delays", "column_dropped", "minutes", None),
    (8, "loads", "column_renamed", "ship", "vessel"),
    (9, "nowhere", "logic_changed", None, None),
]
SOURCES = {
    "calls": "select ship, ship_flag from berth_calls",
    "loads": "select c.ship, ship_flag, kg from calls c",
    "dwell": "select ship from calls where ship > 0",
    "delays": "select ship, minutes from dwell",
    "feedback": "select minutes from delays",
}


def urn(name: str, platform: str = "mill") -> str:
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},{name},PROD)"


def pairs(text: str) -> list[tuple]:
    """((left, right), (left, right)) of each "a.b c.d" between semicolons."""
    return [tuple(tuple(end.split(".")) for end in x.split()) for x in text.split(";")]


def build(spark, **options) -> Review:
    names = [(p, n) for p, listed in ENTITIES.items() for n in listed.split()]
    entities = catalog.with_urn(spark.createDataFrame(names, "platform string, name string"))
    edges = spark.createDataFrame(
        [(urn(a, p), urn(b, q), q, "parsed") for (p, a), (q, b) in pairs(EDGES)],
        "up_urn string, down_urn string, down_platform string, provenance string",
    )
    column_edges = spark.createDataFrame(
        [(urn(a), x, urn(b), y, "mill", "parsed") for (a, x), (b, y) in pairs(COLUMN_EDGES)],
        "up_urn string, up_col string, down_urn string, down_col string, down_platform string, provenance string",
    )
    seen = [("full", p, True) for p, _, _ in DECLARED] + [("part", p, False) for p in ("lake", "mill")]
    visible = spark.createDataFrame(seen, "profile string, platform string, emit_inferred boolean")
    platforms = spark.createDataFrame(
        [(p, n, "", hosts) for p, n, hosts in DECLARED],
        "platform string, expected bigint, note string, hosts_consumers boolean",
    )
    book = Catalog(
        entities,
        catalog.visible_edges(edges, visible),
        catalog.visible_edges(column_edges, visible),
        catalog.build_registry(platforms, visible, list(PROFILES)),
        PROFILES,
        ("lake",),
        "mill",
    )
    changes = spark.createDataFrame(
        CHANGES, "change_id bigint, model string, kind string, column string, new_value string"
    ).selectExpr("*", "timestamp_ntz '2031-05-06 07:08:00' AS recorded_at", "CAST(NULL AS string) AS answer")
    overrides = spark.createDataFrame([(6, "harbour master agreed")], "change_id bigint, reason string")
    sources = spark.createDataFrame(
        [(n, f"mill/{n}.sql", text) for n, text in SOURCES.items()], "name string, path string, sql_text string"
    )
    attempts = spark.createDataFrame(
        [(4, 1, "build", 1, "Binder Error"), (4, 2, "build", 0, "fine")],
        "change_id bigint, attempt bigint, command string, exit_code int, output string",
    )
    return Review(changes, book, overrides, sources, attempts, **options)
