"""Chat formatting from event logs.

A log has one row an event: conversation, message, sequence (any sortable type), kind, role, text.
``open`` begins a message and names its role, ``delta`` adds text, ``edit`` replaces all text so far,
``regenerate`` drops it. Logs are partitioned by conversation and message and folded in sequence:
the text of a message is that of its last event that is no delta, and all deltas after it.

Each message is rendered as a segment: marks, role and text, with the span of what counts for the
loss. A formatted conversation is its segments in the order of their first events; they are kept as
rows, so that a conversation of any length needs no memory. Characters with which control strings
begin are escaped inside roles and texts, which is undone on reading, so that no text can end a turn.

Defined results: a null role or text is empty; a repeated event counts once; events of one sequence
are ordered by kind and text; a message without events but deltas has an empty role; an edit before
any other event opens its message; unknown kinds change nothing; null conversations and messages are
keys like others; an empty log gives an empty result; other columns play no part, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import let

DELTA, EDIT, OPEN, REGENERATE = "delta", "edit", "open", "regenerate"
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks around a turn. ``controls`` are all strings that must not appear inside a text."""

    start: str = "<|turn|>"
    role_end: str = "\n"
    end: str = "</s>\n"
    controls: tuple[str, ...] = ("<|turn|>", "</s>", "<s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)

    def escapes(self, *more: str) -> list[tuple[str, str]]:
        """What is written for each character with which a control string begins."""
        first = sorted({c[0] for c in self.controls} | set(more))
        return [(c, ESCAPE + chr(ord("a") + k)) for k, c in enumerate(first)]


def escaped(text: Column, escapes: list[tuple[str, str]]) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for character, written in escapes:
        text = F.replace(text, F.lit(character), F.lit(written))
    return text


def unescaped(text: Column, escapes: list[tuple[str, str]]) -> Column:
    """Escape characters themselves are paired off first, from the left."""

    def part(x: Column) -> Column:
        for character, written in escapes:
            x = F.replace(x, F.lit(written), F.lit(character))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), ESCAPE)


def fold(log: DataFrame) -> DataFrame:
    """``conversation``, ``place`` (the sequence of the first event), ``role``, ``text``."""
    event = F.struct(
        F.col("sequence").alias("sequence"),
        F.col("kind").alias("kind"),
        F.col("text").alias("text"),
        F.col("role").alias("role"),
    )
    known = F.col("kind").isin(DELTA, EDIT, OPEN, REGENERATE)
    groups = log.where(known).groupBy("conversation", "message")
    events = F.array_distinct(F.sort_array(F.collect_list(event)))

    def message(e: Column) -> Column:
        resets = F.filter(
            F.transform(e, lambda x, k: F.when(x["kind"] != DELTA, k)), lambda k: k.isNotNull()
        )
        last = F.coalesce(F.get(resets, F.size(resets) - 1), F.lit(0))
        kept = F.slice(e, last + 1, F.size(e) - last)
        texts = F.transform(
            kept,
            lambda x: F.when(x["kind"].isin(DELTA, EDIT), F.coalesce(x["text"], F.lit(""))).otherwise(""),
        )
        roles = F.filter(
            F.transform(e, lambda x: F.when(x["kind"] == OPEN, x["role"])), lambda r: r.isNotNull()
        )
        return F.struct(
            e[0]["sequence"].alias("place"),
            F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
            F.array_join(texts, "").alias("text"),
        )

    return groups.agg(events.alias("events")).select(
        "conversation", let(F.col("events"), message).alias("m")
    ).select("conversation", "m.*")


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """``conversation``, ``place``, ``segment``, ``loss_start`` and ``loss_end`` (code points)."""
    role = escaped(F.col("role"), template.escapes(template.role_end))
    text = escaped(F.col("text"), template.escapes())
    head = F.concat(F.lit(template.start), role, F.lit(template.role_end))
    segments = messages.select(
        "conversation", "place", head.alias("head"), text.alias("body"),
        F.col("role").isin(*template.loss_roles).alias("loss"),
    )
    start = F.length("head")
    return segments.select(
        "conversation",
        "place",
        F.concat("head", "body", F.lit(template.end)).alias("segment"),
        F.when(F.col("loss"), start).alias("loss_start"),
        F.when(F.col("loss"), start + F.length("body")).alias("loss_end"),
    )


def parse(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns read back from segments: ``role``, ``text``, ``loss_text`` and ``chars`` of each."""
    whole = F.col("segment")
    after = F.substring(whole, len(template.start) + 1, F.length(whole))
    role = F.substring_index(after, template.role_end, 1)
    begin = F.length(role) + F.lit(len(template.start) + len(template.role_end))
    body = F.substring(whole, begin + 1, F.length(whole) - begin - len(template.end))
    span = F.substring(
        whole, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")
    )
    return segments.select(
        "conversation",
        "place",
        unescaped(role, template.escapes(template.role_end)).alias("role"),
        unescaped(body, template.escapes()).alias("text"),
        unescaped(span, template.escapes()).alias("loss_text"),
        F.length(whole).alias("chars"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """One row a conversation: turns, their hash, and the hash of all text under the loss mask.

    A hash over a conversation needs its turns in order; they are streamed by sorted partitions and
    never held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None

        def done() -> pa.RecordBatch:
            n, turns, n_loss, loss, chars = state
            row = [key, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        names = ["conversation", "turns", "turns_sha256", "loss_chars", "loss_sha256", "chars"]
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conversation", "role", "text", "loss_text", "chars"))
            for own, role, text, loss, chars in zip(*columns, strict=True):
                if state is None or own != key:
                    if state is not None:
                        yield done()
                    key, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss or "")
                state[3].update((loss or "").encode())
                state[4] += chars
        if state is not None:
            yield done()

    own = turns.withColumn("conversation", F.col("conversation").cast("long"))
    own = own.repartition("conversation").sortWithinPartitions("conversation", "place")
    return own.select("conversation", "role", "text", "loss_text", "chars").mapInArrow(
        run,
        "conversation long, turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "chars long",
    )
