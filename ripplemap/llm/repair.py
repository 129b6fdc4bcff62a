"""Repair of conversation structure by a dynamic program over checkpoints.

The roles of a repaired conversation begin with ``s`` or not, and then ``u`` and ``a`` take turns up
to an ``a``; or there is none at all. Each row is kept, given the role that is due (Rerole) or
deleted, and empty turns may be inserted anywhere. Of the cheapest edits, those whose initials come
first in ASCII are taken. What has been read so far decides which role is due, so there are four
states, and a string of initials leaves no choice of roles.

``costs[state]`` at a row is what the rest of the conversation costs from there. Only the costs at
checkpoints are stored, every ``rows_per_block`` rows (the square root of all rows, or
``LEAST_BLOCK`` if that is more). Going backwards, a block turns the costs at its end into those at
its start, a minimum over sums of its own 4 x 4 matrix; the matrices of one conversation are applied
in a stream. Going forward, a block is computed again from the costs at its end, and only edits that
are tight, whose cost and costs behind add up to the costs before, are looked at. Where it ends is
known for each of the four states it may begin in, so blocks are walked side by side, and a second
stream joins them. Conversations of one block need neither stream.

A conversation may hold most rows: rows are dealt by ranges of their order, equal rows are counted
before, first occurrences are found by a minimum, and texts meet their edits by a hash of the row.

Defined results: null roles and texts are one space; null turns come first; rows of one turn are
ordered by role, then by a hash of the text; equal rows of one turn follow each other; a null
conversation is one like any other; an empty table has no edits; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import GAP
from ripplemap.plans.session import stored

# Costs of edits, and the initials of roles that may follow each other.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}

LEAST_BLOCK = 4096
NEVER = 1 << 60

# States: nothing yet, after s, after u, after a. Inserted and reroled turns lead to NEXT.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# By state, then initial (s, u, a, other): the state after a kept row, or -1.
AFTER = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
END = (0, 2 * INSERT, INSERT, 0)

# A run's kind is its initial plus four times its fault.
FINE, CUT_OFF, GONE = 0, 4, 8


class Repaired(NamedTuple):
    """``edits``: conversation, part, block, audit, cost, illegal (adjacent rows), a row a block.
    ``messages``: conversation, place (sorts them), role, text, edit.
    ``facts``: conversation, gaps, blank, duplicate, truncated."""

    edits: DataFrame
    messages: DataFrame
    facts: DataFrame


def _id(*columns: str) -> Column:
    """A hash that tells rows apart, nulls included."""
    values = [F.hex(c) if c == "digest" else F.col(c).cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.lit("="), v), F.lit("-")) for v in values]
    sized = [F.concat(F.length(t).cast("string"), t) for t in told]
    return F.unhex(F.sha2(F.concat(*sized), 256))


KEYS = ("conversation", "turn", "role", "digest")


def _rows(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        "conversation", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def runs(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn once, with their number, initial and faults."""
    ends = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){GAP[:-1]}*\z", 1)
    counted = rows.select(
        *KEYS, (ends == "").alias("blank"), (~ends.isin(".", "!", "?")).alias("open")
    )
    counted = counted.groupBy(*KEYS, "blank", "open").agg(F.count("*").alias("copies"))
    counted = stored(counted.withColumn("id", _id(*KEYS)), "runs")
    turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    firsts = counted.groupBy("conversation", "role", "digest").agg(F.min(turn).alias("t"))
    firsts = firsts.select("conversation", "t.turn", "role", "digest").select(_id(*KEYS).alias("id"))
    told = counted.join(firsts.withColumn("first", F.lit(True)), "id", "left")
    first = F.coalesce("first", F.lit(False))
    initial = F.coalesce(
        F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3)
    )
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    fault = F.when(F.col("blank") | ~first, GONE).when(F.col("open"), CUT_OFF).otherwise(FINE)
    return told.select(
        *KEYS, "copies", (initial + fault).alias("kind"), "blank", "open", first.alias("first")
    )


def facts(told: DataFrame) -> DataFrame:
    """Counts of each conversation. Only a first occurrence's copies after it are duplicates."""
    n = F.col("copies")
    later = F.when(F.col("first"), n - 1).otherwise(n)
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return told.groupBy("conversation").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(later)).alias("duplicate"),
        F.sum((F.col("first") & ~F.col("blank") & F.col("open")).cast("long")).alias("truncated"),
    )


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.record_batch(arrays, names=[n for n, _ in fields])


def blocks(told: DataFrame, rows_per_block: int) -> DataFrame:
    """Neighbouring runs of a conversation, packed; ``alone`` if they are all that it has."""
    own = told.schema["conversation"].dataType
    kinds = [("conversation", None), ("part", pa.int32()), ("block", pa.int64()), ("alone", pa.bool_())]
    kinds += [("kinds", pa.binary()), ("copies", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64()))]
    kinds += [("roles", pa.list_(pa.string())), ("digests", pa.list_(pa.binary()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, whole = TaskContext.get().partitionId(), 0, True, True
        held: list[tuple] = []
        kind = None

        def packed(alone: bool) -> pa.RecordBatch:
            _, turns, roles, digests, copies, codes = map(list, zip(*held, strict=True))
            row = (held[0][0], part, block, alone, bytes(codes), copies, turns, roles, digests)
            fields = [(n, kind if t is None else t) for n, t in kinds]
            return _batch([row], fields)

        for batch in batches:
            kind = batch.schema.field("conversation").type
            columns = [batch.column(c).to_pylist() for c in (*KEYS, "copies", "kind")]
            for row in zip(*columns, strict=True):
                if held and (row[0] != held[0][0] or len(held) >= rows_per_block):
                    same = row[0] == held[0][0]
                    yield packed(whole and not first and not same)
                    first, whole, held, block = first and same, not same, [], block + 1
                held.append(row)
        if held:
            yield packed(False)

    order = told.select(*KEYS, "copies", "kind").repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    return order.mapInArrow(
        run,
        f"conversation {own.simpleString()}, part int, block long, alone boolean, kinds binary, "
        "copies array<long>, turns array<long>, roles array<string>, digests array<binary>",
    )


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs before a gap in which up to two turns may be inserted."""
    once = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return [min(c, INSERT + once[NEXT[q]]) for q, c in enumerate(once)]


def _before(kind: int, copies: int, costs: list[int]) -> list[int]:
    """Costs before a run, from those after it. All copies but the first are deleted."""
    rest = DELETE * (copies - 1)
    out = [c + DELETE + rest for c in costs]
    if kind < GONE:
        more, initial = (TRUNCATED if kind >= CUT_OFF else 0) + rest, kind & 3
        for q in range(4):
            kept = AFTER[q][initial]
            if kept >= 0:
                out[q] = min(out[q], KEEP + more + costs[kept])
            out[q] = min(out[q], REROLE + more + costs[NEXT[q]])
    return _with_inserts(out)


def backward(kinds: bytes, copies: list[int], costs: list[int]) -> list[list[int]]:
    """Costs before each run of a block, and at last those at its end."""
    out = [costs]
    for kind, n in zip(reversed(kinds), reversed(copies), strict=True):
        out.append(_before(kind, n, out[-1]))
    return out[::-1]


def forward(kinds: bytes, copies: list[int], costs: list[list[int]], state: int, last: bool):
    """Tight edits from ``state``, least initials first: ``edit``, run (or None) and state after."""
    for at, (kind, n) in enumerate(zip(kinds, copies, strict=True)):
        here, behind, rest = costs[at], costs[at + 1], DELETE * (n - 1)
        more = rest + (TRUNCATED if kind >= CUT_OFF else 0)
        while True:
            kept = AFTER[state][kind & 3] if kind < GONE else -1
            if here[state] == DELETE + rest + behind[state]:
                yield "D" * n, at, state
            elif here[state] == INSERT + here[NEXT[state]]:
                state = NEXT[state]
                yield "I", None, state
                continue
            elif kept >= 0 and here[state] == KEEP + more + behind[kept]:
                state = kept
                yield "K" + "D" * (n - 1), at, state
            else:
                state = NEXT[state]
                yield "R" + "D" * (n - 1), at, state
            break
    while last and costs[-1][state]:
        state = NEXT[state]
        yield "I", None, state


def _illegal(kinds: bytes, copies: list[int]) -> int:
    initials = ["sua?"[k & 3] for k in kinds]
    pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return pairs + sum(copies) - len(copies)


def _matrices(parts: DataFrame) -> DataFrame:
    """What a block does to costs: ``matrix[state]`` of each state at its end, 16 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ends = [], []
            for kinds, copies in zip(*(batch.column(c).to_pylist() for c in ("kinds", "copies"))):
                units = [[0 if q == k else NEVER for q in range(4)] for k in range(4)]
                out.append([x for unit in units for x in backward(kinds, copies, unit)[0]])
                ends.append(("sua?"[kinds[0] & 3], "sua?"[kinds[-1] & 3]))
            head = [batch.column(c) for c in ("conversation", "part", "block")]
            more = [pa.array([e[k] for e in ends], pa.string()) for k in (0, 1)]
            yield pa.record_batch(
                [*head, pa.array(out, pa.list_(pa.int64())), *more],
                names=["conversation", "part", "block", "matrix", "opens", "closes"],
            )

    own = parts.schema["conversation"].dataType.simpleString()
    return parts.select("conversation", "part", "block", "kinds", "copies").mapInArrow(
        run, f"conversation {own}, part int, block long, matrix array<long>, opens string, closes string"
    )


def _streamed(df: DataFrame, step: Callable, schema: str, down: bool) -> DataFrame:
    """``step(state, row)`` gives a new state and a row, over each conversation's blocks in order.

    ``state`` is None at a conversation's first row in that order.
    """
    fields = ["conversation", "part", "block"]
    order = ["conversation", *(F.desc(c) if down else F.asc(c) for c in fields[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conversation"] != key:
                    key, state, begun = row["conversation"], None, True
                state, made = step(state, row)
                out.append({"part": row["part"], "block": row["block"], **made})
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = pa.schema(
        [("part", pa.int32()), ("block", pa.int64()), *(
            (n, {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}[t])
            for n, t in (x.split() for x in schema.split(", "))
        )]
    )
    dealt = df.repartition("conversation").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"part int, block long, {schema}")


def _down(costs: list[int] | None, row: dict) -> tuple[list[int], dict]:
    last = costs is None
    costs, matrix = list(END) if last else costs, row["matrix"]
    before = [min(matrix[4 * k + q] + costs[k] for k in range(4)) for q in range(4)]
    return before, {"costs": costs, "last": int(last)}


def _up(held: tuple | None, row: dict) -> tuple[tuple, dict]:
    state, before = held or (START, None)
    pair = int(before is not None and before + row["opens"] not in LEGAL)
    return (row["exits"][state], row["closes"]), {"entry": state, "joint": pair}


def _exits(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = batch.select(["kinds", "copies", "costs"]).to_pydict().values()
            for kinds, copies, costs in zip(*rows, strict=True):
                levels, ends = backward(kinds, copies, costs), []
                for state in range(4):
                    for _, _, state in forward(kinds, copies, levels, state, False):  # noqa: B020
                        pass
                    ends.append(state)
                out.append(ends)
            head = [batch.column(c) for c in ("conversation", "part", "block", "opens", "closes")]
            names = ["conversation", "part", "block", "opens", "closes", "exits"]
            yield pa.record_batch([*head, pa.array(out, pa.list_(pa.int64()))], names=names)

    own = parts.schema["conversation"].dataType.simpleString()
    return parts.select("conversation", "part", "block", "opens", "closes", "kinds", "copies", "costs").mapInArrow(
        run, f"conversation {own}, part int, block long, opens string, closes string, exits array<long>"
    )


def _walk(parts: DataFrame) -> DataFrame:
    """Edits of each block, from its state at the start and its costs at the end."""
    made = pa.list_(pa.struct([("place", pa.int64()), ("edit", pa.string()), ("at", pa.int32()), ("role", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, costs_, illegal, lists = [], [], [], []
            rows = batch.select(["kinds", "copies", "costs", "entry", "joint", "last"]).to_pydict()
            for kinds, copies, end, entry, joint, last in zip(*rows.values(), strict=True):
                levels, audit, own, spent = backward(kinds, copies, end), [], [], 0
                for edit, at, state in forward(kinds, copies, levels, entry, last):
                    audit.append(edit)
                    kind = edit[0]
                    spent += DELETE * (len(edit) - 1)
                    spent += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[kind]
                    if kind in "KR" and kinds[at] >= CUT_OFF:
                        spent += TRUNCATED
                    if kind != "D":
                        own.append((len(own), kind, at, None if kind == "K" else ROLE[state]))
                audits.append("".join(audit))
                costs_.append(spent)
                illegal.append(_illegal(kinds, copies) + joint)
                lists.append([dict(zip(("place", "edit", "at", "role"), x, strict=True)) for x in own])
            head = [batch.column(c) for c in ("conversation", "part", "block", "turns", "roles", "digests")]
            yield pa.record_batch(
                [*head, pa.array(audits, pa.string()), pa.array(costs_, pa.int64()),
                 pa.array(illegal, pa.int64()), pa.array(lists, made)],
                names=["conversation", "part", "block", "turns", "roles", "digests", "audit", "cost", "illegal", "made"],
            )

    own = parts.schema["conversation"].dataType.simpleString()
    return parts.mapInArrow(
        run,
        f"conversation {own}, part int, block long, turns array<long>, roles array<string>, "
        "digests array<binary>, audit string, cost long, illegal long, "
        "made array<struct<place: long, edit: string, at: int, role: string>>",
    )


def repair(rows: DataFrame, rows_per_block: int | None = None) -> Repaired:
    """Repair all conversations of ``rows``: conversation, turn, role, text."""
    own = _rows(rows)
    told = stored(runs(own), "told_runs")
    if rows_per_block is None:
        rows_per_block = max(LEAST_BLOCK, math.isqrt(told.count()))
    parts = stored(blocks(told, rows_per_block), "conversation_blocks")
    more = parts.where(~F.col("alone"))
    matrices = stored(_matrices(more), "block_matrices")
    costs = stored(_streamed(matrices, _down, "costs array<long>, last int", True), "checkpoints")
    told_ends = matrices.drop("matrix", "conversation").join(costs, ["part", "block"])
    exits = _exits(more.join(told_ends, ["part", "block"]))
    entries = _streamed(exits, _up, "entry long, joint long", False)
    joined = parts.join(costs.join(entries, ["part", "block"]), ["part", "block"], "left")
    end = F.array(*(F.lit(x).cast("long") for x in END))
    walked = _walk(
        joined.withColumns({
            "last": F.coalesce(F.col("last") == 1, F.lit(True)),
            "costs": F.coalesce("costs", end),
            "entry": F.coalesce("entry", F.lit(0)),
            "joint": F.coalesce("joint", F.lit(0)),
        })
    )
    walked = stored(walked, "edits")
    edits = walked.select("conversation", "part", "block", "audit", "cost", "illegal")
    place = F.struct("part", "block", "m.place").alias("place")
    each = walked.select("*", F.explode("made").alias("m"))
    inserted = each.where("m.edit = 'I'").select(
        "conversation", place, "m.role", F.lit("").alias("text"), "m.edit"
    )
    found = each.where("m.edit != 'I'").select(
        "conversation", place, "m.edit", F.col("m.role").alias("new"),
        F.col("turns")[F.col("m.at")].alias("turn"), F.col("roles")[F.col("m.at")].alias("role"),
        F.col("digests")[F.col("m.at")].alias("digest"),
    )
    found = found.select("conversation", "place", "edit", F.coalesce("new", "role").alias("role"), _id(*KEYS).alias("id"))
    texts = own.select(_id(*KEYS).alias("id"), "text").dropDuplicates(["id"])
    kept = found.join(texts, "id").select("conversation", "place", "role", "text", "edit")
    return Repaired(edits, kept.unionByName(inserted), facts(told))


def text_hashes(messages: DataFrame) -> DataFrame:
    """``conversation`` and ``sha256`` of its ``role:text`` lines; streamed by sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            rows = (batch.column(c).to_pylist() for c in ("conversation", "role", "text"))
            for own, role, text in zip(*rows, strict=True):
                if state is not None and own == key:
                    state.update(b"\n")
                else:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
            kind = batch.schema.field("conversation").type
            yield _batch(out, [("conversation", kind), ("sha256", pa.string())])
        if state is not None:
            yield _batch([(key, state.hexdigest())], [("conversation", kind), ("sha256", pa.string())])

    own = messages.schema["conversation"].dataType.simpleString()
    dealt = messages.repartition("conversation").sortWithinPartitions("conversation", "place")
    return dealt.select("conversation", "role", "text").mapInArrow(
        run, f"conversation {own}, sha256 string"
    )


def summaries(conversations: DataFrame, repaired: Repaired) -> DataFrame:
    """One row for each of ``conversations``: counts, cost, audit and hash of the repaired texts."""
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    audit = F.array_sort(F.collect_list(F.struct("part", "block", "audit")))
    audits = repaired.edits.groupBy("conversation").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(audit, lambda b: b["audit"]), "").alias("audit"),
    )
    sources = [
        conversations.select("conversation").distinct(),
        repaired.facts,
        audits,
        text_hashes(repaired.messages),
    ]
    empty = {c: F.lit(0).cast("long") for c in longs} | {
        c: F.lit(None).cast("string") for c in ("audit", "sha256")
    }
    same = [
        s.select("conversation", *(s[c] if c in s.columns else x.alias(c) for c, x in empty.items()))
        for s in sources
    ]
    union = same[0]
    for s in same[1:]:
        union = union.unionByName(s)
    return union.groupBy("conversation").agg(
        *(F.sum(c).alias(c) for c in longs),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"),
    )
