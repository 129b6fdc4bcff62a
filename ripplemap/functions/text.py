"""Whole-word rewriting and small text helpers on column-valued patterns.

A word character is a Unicode letter, number or underscore. Java's ``\\b`` follows another
definition, so the edges are spelled out as look-arounds.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"


def _quoted(text: Column) -> Column:
    """Regex-quote a column value; an embedded ``\\E`` must not end the quotation."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word(name: Column) -> Column:
    """Pattern for ``name`` bounded by word edges on both sides."""
    before = F.when(name.rlike("^" + WORD), F.lit(f"(?<!{WORD})")).otherwise(F.lit(f"(?<={WORD})"))
    after = F.when(name.rlike(WORD + "$"), F.lit(f"(?!{WORD})")).otherwise(F.lit(f"(?={WORD})"))
    return F.concat(before, _quoted(name), after)


def _literal_replacement(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def replace_words(text: Column, old: Column, new: Column) -> Column:
    """Every whole-word ``old`` becomes ``new``; the substring test spares the regex."""
    return F.when(
        F.contains(text, old), F.regexp_replace(text, whole_word(old), _literal_replacement(new))
    ).otherwise(text)


def replace_first_word(text: Column, old: Column, new: Column) -> Column:
    """Only the first whole-word ``old`` becomes ``new``: the match is anchored at the start."""
    pattern = F.concat(F.lit(r"(?s)\A(.*?)"), whole_word(old))
    return F.when(
        F.contains(text, old),
        F.regexp_replace(text, pattern, F.concat(F.lit("$1"), _literal_replacement(new))),
    ).otherwise(text)


def dotted(model: Column, column: Column) -> Column:
    """``model.column``, or just the model when no column is named."""
    return F.when(F.coalesce(column, F.lit("")) == "", model).otherwise(
        F.concat(model, F.lit("."), column)
    )


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.sql$", "")
