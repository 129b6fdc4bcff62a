"""Fixed values. They define the wire formats, rule tables and limits."""

# --- identifiers ----------------------------------------------------------
URN_PREFIX = "urn:li:dataset:"
URN_PATTERN = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),([^,]+),([^)]+)\)"
ENV = "PROD"
REGISTRY_PLATFORM = "ripplemap"

# --- registry wire keys ---------------------------------------------------
KEY_PLATFORM = "platform"
KEY_CONNECTOR = "lineageConnectorConfigured"
KEY_EXPECTED = "expectedEntityCount"
KEY_NOTE = "registryNote"
KEY_HOSTS = "hostsConsumers"

# --- expansion and coverage -----------------------------------------------
MAX_HOPS = 3
MIN_REACH = 2
COVERAGE_THRESHOLD = 0.6
PROVENANCES = ("parsed", "curated", "inferred")

# --- change kinds ---------------------------------------------------------
RENAMED = "column_renamed"
DROPPED = "column_dropped"
ADDED = "column_added"
NARROWED = "type_narrowed"
WIDENED = "type_widened"
LOGIC = "logic_changed"
INTRINSICALLY_SAFE = (ADDED, WIDENED)
NARROWING_TYPES = ("decimal", "numeric", "int", "smallint", "varchar")
WIDENING_TYPES = ("bigint", "double", "text", "hugeint")

# --- tiers, worst first ---------------------------------------------------
BREAKS, DEGRADES, TOUCHES, SAFE = "breaks", "degrades", "touches", "safe"
SEVERITY = {SAFE: 0, TOUCHES: 1, DEGRADES: 2, BREAKS: 3}
TIER_BY_KIND = {DROPPED: BREAKS, RENAMED: BREAKS, NARROWED: DEGRADES}

# --- native type families, tested in this order ---------------------------
TYPE_FAMILIES = (
    ("number", ("INT", "DECIMAL", "DOUBLE", "FLOAT", "NUMERIC", "HUGEINT")),
    ("boolean", ("BOOL",)),
    ("date", ("DATE", "TIMESTAMP", "TIME")),
)

# --- fix strategies -------------------------------------------------------
UPDATE_REFERENCES = "update_references"
COMPATIBILITY_ALIAS = "compatibility_alias"
TWO_PHASE_DEPRECATE = "two_phase_deprecate"
STRATEGY_BY_KIND = {
    RENAMED: (UPDATE_REFERENCES, (COMPATIBILITY_ALIAS, TWO_PHASE_DEPRECATE)),
    DROPPED: (TWO_PHASE_DEPRECATE, (UPDATE_REFERENCES,)),
    NARROWED: (COMPATIBILITY_ALIAS, (UPDATE_REFERENCES,)),
}

# --- check output ---------------------------------------------------------
ERROR_MARKERS = ("Referenced column", "column not found", "Binder Error")
OUTPUT_TAIL = 2000
JUDGE_CHARS = 300
BLOCKED_ON_CHARS = 200

# --- decision log ---------------------------------------------------------
TAG_HELD = "urn:li:tag:ripplemap-held"
TAG_VERIFIED = "urn:li:tag:ripplemap-verified"
TAG_COVERAGE_GAP = "urn:li:tag:ripplemap-coverage-gap"
DOC_DECISION, DOC_ANALYSIS = "Decision", "Analysis"
MARKER_HELD, MARKER_RESOLVED = "ripplemap:held-decision", "ripplemap:resolved"
HELD_QUEUE_LIMIT = 50
GREP_CONTEXT = 200
