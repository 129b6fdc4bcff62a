"""Quality rules: per-document rules, then verdicts on whole hosts.

Failures are counted by host and rule, also of rules that decide on no document alone (``RULES``). For
each rule, a host's rate is shrunk towards the rate of all documents by a beta prior. The prior is
fitted to the hosts by the method of moments, with the binomial noise of small hosts taken out, so
that hosts which differ by chance only are judged by the others and not by themselves. A host is
rejected where its rate lies above that of all documents by ``excess`` at least, as surely as
``deviations`` standard deviations of its posterior say; it loses all its documents. Only built-in
functions are used and no text is shuffled.

Defined results: a null or empty text has no words and fails; a null host is a host of its own;
repeated rows are judged and counted each; an empty table gives an empty result; other columns of the
input play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import GAP, let
from ripplemap.plans.session import stored

# What counts as a symbol, as white space, and the length of a repeated passage.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """``min_words`` and ``max_repeat_pct`` decide on a document; all of them on a host.

    ``prior_weights`` bounds the prior: it counts as that many documents at least and at most.
    """

    min_words: int = 10
    max_repeat_pct: int = 20
    max_symbol_pct: int = 10
    max_dup_lines: int = 5
    excess: float = 0.25
    deviations: float = 3.0
    prior_weights: tuple[float, float] = (1.0, 1e6)


RULES = ("short", "repeats", "symbols", "lines")


def failures(limits: Limits) -> dict[str, Column]:
    """Whether a document fails each rule, from its measures; no words fail the first alone."""
    repeats = 100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words")
    symbols = 100 * F.col("n_symbols") > limits.max_symbol_pct * F.col("word_chars")
    return {
        "short": F.col("n_words") < limits.min_words,
        "repeats": repeats,
        "symbols": symbols,
        "lines": F.col("n_dup_lines") > limits.max_dup_lines,
    }


def _covered(starts: Column) -> Column:
    """Words in windows that begin at the given positions, each word once."""
    width = F.lit(WINDOW)
    return let(
        F.sort_array(starts),
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(width, F.coalesce(F.get(p, k + 1) - x, width))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )


def _repeat_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash. Only a text with a repeated window is sorted.
    """

    def of_windows(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            ordered,
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            ),
        )
        twice = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(twice, _covered(starts)).otherwise(F.lit(0))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.slice(h, 1, F.size(h) - (WINDOW - 1)),
            lambda x, i: F.xxhash64(x, *(h[i + k] for k in range(1, WINDOW))),
        )
        return F.when(F.size(h) > WINDOW, let(windows, of_windows)).otherwise(F.lit(0))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measures(text: Column) -> dict[str, Column]:
    """The measures of one text; each is a long."""
    full = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(full, GAP), lambda w: w != "")
    by_words = let(
        words,
        lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    lines = F.filter(F.split(full, "\n"), lambda x: F.trim(F.translate(x, SPACES, " ")) != "")
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "by_words": by_words,
        "word_chars": F.length(full) - _count_of(full, r"\x20\x09-\x0D"),
        "n_symbols": _count_of(full, SYMBOLS),
        "n_dup_lines": dup_lines,
    }


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


# As many rejected hosts are sent to all tasks; more are joined by a shuffle.
SENT_HOSTS = 50_000
LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_rules(docs: DataFrame, text: str, host: str, limits: Limits, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (as a struct ``row``), ``host``, the measures and ``base_failed``."""
    m = measures(docs[text])
    found = docs.select(
        F.struct(*(docs[c] for c in keep)).alias("row"),
        docs[host].cast("string").alias("host"),
        *(c.alias(name) for name, c in m.items()),
    )
    nested = {"n_words": "by_words.n_words", "n_repeat_words": "by_words.n_repeat_words"}
    found = found.select(
        "row", "host", *(F.col(nested.get(c, c)).cast("long").alias(c) for c in LONGS)
    )
    rules = failures(limits)
    return found.withColumn("base_failed", rules["short"] | rules["repeats"])


def host_rates(judged: DataFrame, limits: Limits) -> DataFrame:
    """``host``, ``n`` and ``rejected``, and of each rule ``failed_…``, ``rate_…`` (shrunk) and
    ``bound_…``, what the rate surely exceeds; from stored rows."""
    rules = failures(limits)
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(c.cast("long")).alias(f"failed_{r}") for r, c in rules.items()),
    )
    hosts = stored(hosts, "hosts")
    # One row: of each rule the mean of all documents and the variance of the hosts' rates about it,
    # weighted by documents; and the hosts, whose number is the weight of the binomial noise.
    means = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"),
        *((F.sum(f"failed_{r}") / F.sum("n")).alias(r) for r in RULES),
    ).first()
    if not means["n"]:
        return hosts.withColumn("rejected", F.lit(False))

    def spread(rule: str) -> Column:
        return F.sum(F.col("n") * (F.col(f"failed_{rule}") / F.col("n") - means[rule]) ** 2) / means["n"]

    spreads = hosts.agg(*(spread(r).alias(r) for r in RULES)).first()
    low, high = limits.prior_weights
    rejected = F.lit(False)
    for r in RULES:
        mean = means[r]
        noise = mean * (1 - mean)
        between = spreads[r] - noise * (means["hosts"] - 1) / means["n"]
        weight = high if between <= 0 else min(high, max(low, noise / between - 1))
        rate = (F.col(f"failed_{r}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(weight + 1)))
        bound = rate - F.lit(limits.deviations) * deviation
        hosts = hosts.withColumn(f"rate_{r}", rate).withColumn(f"bound_{r}", bound)
        rejected = rejected | (F.col(f"bound_{r}") > mean + limits.excess)
    return hosts.withColumn("rejected", rejected)


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    limits: Limits = Limits(),
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row with ``row`` (its columns ``keep``), ``host``, the measures, ``base_failed``, ``kept``.

    The rows with their measures are written once, since hosts are counted over them before they
    can be judged. Rejected hosts are joined by host, without a shuffle if they are few.
    """
    judged = stored(with_rules(docs, text, host, limits, keep or docs.columns), "quality")
    rejected = host_rates(judged, limits).where("rejected").select(F.col("host").alias("bad"))
    rejected = stored(rejected.withColumn("host_rejected", F.lit(True)), "rejected_hosts")
    if rejected.count() <= SENT_HOSTS:
        rejected = F.broadcast(rejected)
    return judged.join(rejected, judged["host"].eqNullSafe(rejected["bad"]), "left").select(
        *judged.columns,
        (~F.col("base_failed") & F.col("host_rejected").isNull()).alias("kept"),
    )


def passing(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns."""
    return judge(docs, text, host).where("kept").select("row.*")
