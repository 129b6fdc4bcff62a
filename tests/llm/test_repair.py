"""Repaired conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from __spark_entry__ import queries
from ripplemap.llm import repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256"]
NONE = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def search(rows):
    """Cheapest edits by uniform-cost search: least cost, then least initials. (cost, audit, lines)"""
    full = re.compile(r"(s?(ua)+)?")
    begins = lambda x: any(full.fullmatch(x + t) for t in ("", "a", "ua"))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and full.fullmatch(roles):
            return cost, audit, lines
        state = (at, roles[-1:])
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            if begins(roles + role[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", at, roles + role[0], (*lines, f"{role}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles, lines))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 * (fault == "truncated")
        if role[:1] and begins(roles + role[0]):
            kept = (cost + more, audit + "K", at + 1, roles + role[0], (*lines, f"{role}:{text}"))
            heapq.heappush(heap, kept)
        for new in ("user", "assistant"):
            if begins(roles + new[0]):
                line = (*lines, f"{new}:{text}")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, roles + new[0], line))
    raise AssertionError


def slow(rows):
    """By conversation; rows are (conversation, turn, role, text)."""
    by = defaultdict(list)
    for conversation, turn, role, text in rows:
        by[conversation].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conversation, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, told = set(), []
        for _, role, text in own:
            plain = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else ""
            fault = fault or ("truncated" if plain[-1] not in ".!?" else "")
            seen.add((role, text))
            told.append((role, text, fault))
        cost, audit, lines = search(told)
        turns = [r[0] for r in own if r[0] is not None]
        faults = [r[2] for r in told]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(told, told[1:])]
        out[conversation] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(spark, rows, **more):
    schema = "conversation long, turn long, role string, text string, part int, block int, id int"
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    found = repair.summaries(table, repair.repair(table, **more))
    return {r["conversation"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}


def drawn(seed, conversations, most):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "Why? ", "é.", "end. ", "x?\x0b"]
    rows = []
    for c in range(conversations):
        for k in range(draw.randrange(most)):
            turn = None if draw.random() < 0.05 else k // draw.choice([1, 1, 1, 2]) * draw.choice([1, 1, 2])
            text = draw.choice(texts)
            text = f"{k}{text}" if text and draw.random() < 0.7 else text
            role = roles[k % 2] if draw.random() < 0.6 else draw.choice(roles)
            rows += [(None if c == 3 else c, turn, role, text)] * draw.choice([1, 1, 1, 1, 3])
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, conversations, most, block", [
    (1, 300, 12, 4096), (2, 40, 30, 1), (3, 20, 60, 3), (4, 4, 400, 7), (5, 1, 900, 16),
])
def test_same_as_a_search_over_all_edits(spark, seed, conversations, most, block):
    rows = drawn(seed, conversations, most)
    assert got(spark, rows, rows_per_block=block) == slow(rows)


def test_copies_of_one_row_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hm.")] * 3000 + [(1, 1, "assistant", "Yes.")] + [(2, None, None, None)] * 2
    found = got(spark, rows, rows_per_block=2)
    assert found == slow(rows)
    assert found[1][5:7] == (4 * 2999, "K" + "D" * 2999 + "K")
    assert got(spark, []) == {}


def test_messages(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "So?"), (1, 2, "user", "cut"), (1, 3, "assistant", "Ok.")]
    table = spark.createDataFrame(rows, "conversation long, turn long, role string, text string")
    made = repair.repair(table)
    found = made.messages.orderBy("place").select("role", "text", "edit").collect()
    assert [tuple(r) for r in found] == [
        ("user", "", "I"), ("assistant", "Hi.", "K"), ("user", "So?", "K"), ("assistant", "Ok.", "K")
    ]
    assert made.edits.first()["audit"] == "IKKDK"


def damaged(rows):
    out = []
    for r in rows:
        conv, turn, role, text = (r[c] for c in ("conv_id", "turn", "role", "text"))
        said = ":".join(" " if x is None else str(x) for x in (conv, turn))
        way, text = zlib.crc32(said.encode()) % 20, " " if text is None else text
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = pq.read_table(f"{folder}/conversations.parquet").to_pylist()
    want = {r["conv_id"]: NONE for r in rows} | slow(damaged(rows))
    found = queries()["op11_conversation_repair"](spark, folder)
    assert found.columns == ["conv_id", *COLUMNS[:-1], "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == want
