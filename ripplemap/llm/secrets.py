"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers.

Two first-order character models are trained from labelled strings (``random`` and ``identifier``):
counts of one character after another, smoothed by ``smoothing`` a character towards those of single
characters. A run of at least
``min_run`` key characters is a secret if its log-likelihood ratio is over ``min_ratio`` and it does
not overlap a span of a fixed pattern; those always stay. Only built-in functions are used, and a
scan shuffles nothing. The model has at most 2 * 68 * 67 counts, whatever the input.

Defined results: a null or empty text has no spans; repeated rows are scanned each; an empty table
gives an empty result; without labelled strings both models are uniform and add no span. Spans are
in code points, the end exclusive. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import bounded_sample, let, texts

# The kinds in order, their patterns, and the least length of what a match must hold.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LENGTH = 6
# The characters of keys and of identifiers.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Private characters that mark matches. In a text they are first replaced by another one, which no
# pattern matches either, so that no match moves.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"


@dataclass(frozen=True)
class Scan:
    """``sample_rows`` bounds the documents whose words train the model of identifiers."""

    min_run: int = 20
    min_ratio: float = 10.0
    smoothing: float = 0.5
    sample_rows: int = 4000


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(
        start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")
    )


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, pattern: str, kind: int, valid=None) -> Column:
    """Spans of all matches of ``pattern`` that are ``valid``, leftmost first, not overlapping."""
    parts = F.split(
        F.regexp_replace(
            F.translate(text, OPEN + CLOSE, OTHER * 2), f"(?:{pattern})", f"{OPEN}$0{CLOSE}"
        ),
        f"[{OPEN}{CLOSE}]",
    )
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(NO_SPANS).alias("spans")
    )

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        wanted = state["inside"] if valid is None else state["inside"] & valid(part)
        more = F.concat(state["spans"], F.array(_span(kind, state["at"], end)))
        return F.struct(
            end.alias("at"),
            (~state["inside"]).alias("inside"),
            F.when(wanted, more).otherwise(state["spans"]).alias("spans"),
        )

    found = F.aggregate(parts, zero, step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(NO_SPANS))


def _long_value(part: Column) -> Column:
    return F.length(F.regexp_extract(part, ASSIGN, 2)) >= ASSIGN_LENGTH


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    return F.sort_array(
        F.concat(
            _matches(text, ASSIGN, 0, _long_value),
            _matches(text, ACCESS, 1),
            _matches(text, HEX, 2),
        )
    )


def _run(at_least: int) -> str:
    return f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{at_least},}}+"


def _pairs(characters: Column, pair) -> Column:
    """``pair(previous, this)`` for each character after the first."""
    return F.transform(
        F.slice(characters, 2, F.greatest(F.size(characters) - 1, F.lit(0))),
        lambda c, i: pair(characters[i], c),
    )


def labelled(docs: DataFrame, text: str, key: str, scan: Scan) -> DataFrame:
    """``label`` and ``string``: values that the fixed patterns find are labelled ``random``, words of
    eight key characters and more outside them ``identifier``.

    Secrets are rare, so those of all documents count, however many there are. Words are not: those of
    at most ``sample_rows`` documents count, chosen by a hash.
    """
    own = texts(docs, key, text)
    secret = F.concat(
        F.filter(
            F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)),
            lambda v: F.length(v) >= ASSIGN_LENGTH,
        ),
        F.regexp_extract_all("text", F.lit(f"({ACCESS})"), F.lit(1)),
        F.regexp_extract_all("text", F.lit(f"({HEX})"), F.lit(1)),
    )
    some = own.where(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = F.regexp_extract_all(rest, F.lit(f"({_run(8)})"), F.lit(1))
    return some.select(F.lit("random").alias("label"), F.explode(secret).alias("string")).union(
        bounded_sample(own, scan.sample_rows).select(F.lit("identifier"), F.explode(words))
    ).where("string IS NOT NULL")


def train(samples: DataFrame, scan: Scan = Scan()) -> list[float]:
    """Log-likelihood ratio of each pair of characters, row by row, from ``label`` and ``string``."""
    pairs = samples.where(F.col("string").isNotNull()).select(
        "label",
        F.explode(
            let(F.split("string", ""), lambda c: _pairs(c, lambda a, b: F.concat(a, b)))
        ).alias("pair"),
    )
    counts = {
        (r["label"], r["pair"]): r["n"]
        for r in pairs.where(F.col("pair").rlike(f"^[{CHARACTERS}]{{2}}$"))
        .groupBy("label", "pair")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most two labels times the pairs of CHARACTERS
    }
    weight = scan.smoothing * len(CHARACTERS)
    logs: dict[str, list[float]] = {}
    for label in ("random", "identifier"):
        seen = {b: sum(counts.get((label, a + b), 0) for a in CHARACTERS) for b in CHARACTERS}
        total = sum(seen.values())
        single = {b: (seen[b] + scan.smoothing) / (total + weight) for b in CHARACTERS}
        logs[label] = []
        for a in CHARACTERS:
            row = [counts.get((label, a + b), 0) + weight * single[b] for b in CHARACTERS]
            logs[label] += [math.log(x / sum(row)) for x in row]
    return [x - y for x, y in zip(logs["random"], logs["identifier"], strict=True)]


def _ratio(run: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a run of key characters; the model is a constant array."""
    cells = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    place = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(CHARACTERS), c) - 1)
    steps = let(
        place, lambda p: _pairs(p, lambda a, b: F.get(cells, a * len(CHARACTERS) + b))
    )
    return F.aggregate(steps, F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))


def spans(text: Column, model: list[float], scan: Scan = Scan()) -> Column:
    """All spans of a text (``start``, ``kind`` as a place in ``KINDS``, ``end``), in order."""
    full = F.coalesce(text, F.lit(""))
    runs = _matches(full, _run(scan.min_run), 3, lambda r: _ratio(r, model) > scan.min_ratio)

    def merged(base: Column) -> Column:
        apart = F.filter(
            runs,
            lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])),
        )
        return F.sort_array(F.concat(base, apart))

    return let(base_spans(full), merged)


def listed(found: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
    )


def model_of(docs: DataFrame, text: str = "text", key: str = "doc_id", scan: Scan = Scan()):
    """The ratios trained from the labelled strings of ``docs``."""
    return train(labelled(docs, text, key, scan), scan)


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap give one mask."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        new = F.concat(
            state["out"],
            F.substring(text, state["at"] + 1, s["start"] - state["at"]),
            F.lit(mask),
        )
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], new).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(
        found,
        zero,
        step,
        lambda state: F.concat(
            state["out"], F.substring(text, state["at"] + 1, F.length(text) - state["at"])
        ),
    )
