"""Unified diffs to change rows, in one pass over each diff's own row.

``parse`` reads a diff once and keeps, as arrays, what every rule below needs; rules are array functions
on that row, so nothing is shuffled or joined. A feed of very large diffs is first cut by
``split_files`` into one diff a file.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions import constants as K

# --- fixed patterns -------------------------------------------------------
HEADER = r"(?U)[+-]{3} [ab]/.*/(\w+)\.sql"
ALIAS = r"(?iU)\b(\w+)\s+as\s+(\w+)\b"
CAST = r"(?iU)cast\s*\(\s*(\w+)\s+as\s+([\w()\d,]+)\s*\)"
BARE = r"(?U)^(\w+)$"
CHANGED_LINE = r"^(-[^-]|\+[^+])"
OUTER_SPACE = r"(?U)^\s+|\s+$"


CHANGE = "struct<kind: string, column: string, new_value: string, ord: int>"


def _change(kind: Column, column: Column, new_value: Column, ord_: int) -> Column:
    fields = {"kind": kind, "column": column, "new_value": new_value, "ord": F.lit(ord_)}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _none() -> Column:
    return F.lit(None).cast("string")


def parse(diffs: DataFrame) -> DataFrame:
    """(diff_id, model, removed, added): different trimmed lines of each side, file headers left out.

    Diffs without a model header give no row. A line pattern never crosses its line end.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(CHANGED_LINE)).alias("lines")
    rows = diffs.select("diff_id", F.regexp_extract("text", HEADER, 1).alias("model"), lines)

    def side(sign: str) -> Column:
        own = F.filter("lines", lambda x: x.startswith(sign))
        return F.array_distinct(F.transform(own, lambda x: F.regexp_replace(F.substring(x, 2, 1 << 30), OUTER_SPACE, "")))

    return rows.filter(F.col("model") != "").select(
        "diff_id", "model", side("-").alias("removed"), side("+").alias("added")
    )


def _sided(values: Column, side: str, name: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(side).alias("side"), x.alias(name)))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """The changed lines of ``parse`` as rows (diff_id, model, side, body)."""
    sides = [_sided(F.col(c), c, "body") for c in ("removed", "added")]
    return parse(diffs).select("diff_id", "model", F.inline(F.concat(*sides)))


def model_names(diffs: DataFrame) -> DataFrame:
    return diffs.select(
        "diff_id", F.nullif(F.regexp_extract("text", HEADER, 1), F.lit("")).alias("model")
    )


def _renames() -> Column:
    """``old as new`` added while a removed line holds ``old`` and no "as" letters.

    A word has no line end, so that one search in the joined lines asks all of them.
    """
    plain = F.filter("removed", lambda x: ~F.contains(F.lower(x), F.lit("as")))
    found = F.transform(
        "added",
        lambda x: F.struct(
            F.regexp_extract(x, ALIAS, 1).alias("old"), F.regexp_extract(x, ALIAS, 2).alias("new")
        ),
    )
    return F.transform(
        F.array(F.array_join(plain, "\n")),
        lambda text: F.transform(
            F.filter(found, lambda p: (p["old"] != "") & F.contains(text, p["old"])),
            lambda p: _change(F.lit(K.RENAMED), p["old"], p["new"], 1),
        ),
    )[0]


def _type_changes() -> Column:
    """``cast(col as type)`` in an added line; the base type decides narrowed, widened or logic."""
    found = F.transform(
        "added",
        lambda x: F.struct(
            F.regexp_extract(x, CAST, 1).alias("column"), F.lower(F.regexp_extract(x, CAST, 2)).alias("type")
        ),
    )

    def kind(type_: Column) -> Column:
        base = F.substring_index(type_, "(", 1)
        narrowed = F.when(base.isin(*K.NARROWING_TYPES), K.NARROWED)
        return narrowed.when(base.isin(*K.WIDENING_TYPES), K.WIDENED).otherwise(K.LOGIC)

    return F.transform(
        F.filter(found, lambda p: p["column"] != ""),
        lambda p: _change(kind(p["type"]), p["column"], p["type"], 2),
    )


def _bare(side: str) -> Column:
    """Lines that are one word, a trailing comma aside."""
    plain = F.transform(
        side,
        lambda x: F.regexp_extract(F.regexp_replace(F.regexp_replace(x, r",+$", ""), OUTER_SPACE, ""), BARE, 1),
    )
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


def _column_sets() -> Column:
    """Bare on one side only."""

    def only(kind: str, own: str, other: str) -> Column:
        return F.transform(F.array_except(own, other), lambda c: _change(F.lit(kind), c, _none(), 3))

    return F.concat(only(K.DROPPED, "gone", "new"), only(K.ADDED, "new", "gone"))


def _rules(diffs: DataFrame) -> DataFrame:
    """(diff_id, model, renamed, retyped, columns) of every diff with changed lines."""
    rows = parse(diffs).filter(F.size("removed") + F.size("added") > 0)
    sided = rows.select("*", _bare("removed").alias("gone"), _bare("added").alias("new"))
    return sided.select(
        "diff_id", "model", _renames().alias("renamed"), _type_changes().alias("retyped"),
        _column_sets().alias("columns"),
    )


def _rows(rules: DataFrame, changes: Column | str) -> DataFrame:
    return rules.select("diff_id", "model", F.inline(changes))


def renames(diffs: DataFrame) -> DataFrame:
    return _rows(_rules(diffs), "renamed")


def type_changes(diffs: DataFrame) -> DataFrame:
    return _rows(_rules(diffs), "retyped")


def column_set_changes(diffs: DataFrame) -> DataFrame:
    return _rows(_rules(diffs), "columns")


def bare_columns(diffs: DataFrame) -> DataFrame:
    """(diff_id, model, side, column) of bare lines."""
    sides = [_sided(_bare(c), c, "column") for c in ("removed", "added")]
    return parse(diffs).select("diff_id", "model", F.inline(F.concat(*sides)))


def _known() -> Column:
    return F.concat("renamed", "retyped", "columns")


def _unknown() -> Column:
    """Lines changed but nothing recognised: one logic change for the diff."""
    logic = F.array(_change(F.lit(K.LOGIC), _none(), _none(), 4))
    return F.when(F.size(_known()) == 0, logic).otherwise(F.array().cast(f"array<{CHANGE}>"))


def logic_fallback(diffs: DataFrame) -> DataFrame:
    return _rows(_rules(diffs), _unknown())


def changes_from_diffs(diffs: DataFrame) -> DataFrame:
    """All change rows; a rename also yields the drop of its old column."""
    return _rows(_rules(diffs), F.concat(_known(), _unknown()))


def split_files(feed: DataFrame) -> DataFrame:
    """A diff over several files to one diff per file; ids become ``<diff>#<file number>``."""
    parts = F.posexplode(F.split("text", r"(?m)^(?=--- a/)")).alias("n", "part")
    return feed.select("diff_id", parts).filter(F.col("part") != "").select(
        F.concat(F.col("diff_id").cast("string"), F.lit("#"), F.col("n").cast("string")).alias("diff_id"),
        F.col("part").alias("text"),
    )
