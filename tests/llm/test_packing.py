"""Packing: every id in one place, sequences as full as can be, ids read back from the sequences."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from __spark_entry__ import queries
from ripplemap.llm import packing

SMALL = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("word_bpe_49k.json")
TOKENS = Tokenizer.from_file(FILE)


def ids_of(text, end):
    return [*TOKENS.encode(text or "", add_special_tokens=False).ids, end]


def slow_packs(lengths, size):
    """Shortest pack first, one piece at a time: fills of all packs."""
    fills = []
    for own in sorted(lengths, reverse=True):
        k = min(range(len(fills)), key=fills.__getitem__, default=None)
        if k is None or fills[k] + own > size:
            fills.append(own)
        else:
            fills[k] += own
    return Counter(fills)


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    draw = random.Random(seed)
    size = draw.choice([1, 2, 7, 16, 64, 100])
    top = draw.choice([1, 3, size, size])
    lengths = [min(size, 1 + int(top * draw.random() ** draw.choice([1, 3]))) for _ in range(draw.choice([1, 5, 300]))]
    counts = Counter(lengths)
    plan = packing.Plan(counts, size)
    assert Counter({f: sum(n for _, n in r) for f, r in plan.runs.items()}) == slow_packs(lengths, size)
    taken, cuts = {}, 0
    for own, n in counts.items():
        for rank in range(n):
            places = plan.place(own, rank)
            cuts += len(places) - 1
            assert sum(p[0] for p in places) == own
            for some, sequence, offset in places:
                cells = taken.setdefault(sequence, [])
                cells += range(offset, offset + some)
    assert sorted(taken) == list(range(plan.sequences))
    for cells in taken.values():
        assert sorted(cells) == list(range(len(cells)))
        assert len(cells) == size or len(cells).bit_count() == 1
    assert sum(len(c) < size for c in taken.values()) <= size.bit_length()


def test_plan_is_small_for_large_counts():
    plan = packing.Plan({own: 10**9 + own for own in range(1, 2049)}, 2048)
    assert len(plan.table) < 100_000 and len(plan.gaps) < 10_000
    plan = packing.Plan({1: 10**12, 2: 5, 2047: 10**9, 1500: 10**9}, 2048)
    assert len(plan.table) < 100 and plan.place(1, 10**12 - 1)


def check(rows, docs, end, length=2048):
    """``rows``: key, start, length, crc, total, sequence, offset."""
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    want = {}
    for key, text in docs:
        want.setdefault(key, []).append(ids_of(text, end))
    assert by_key.keys() == want.keys()
    for key, own in by_key.items():
        if len(want[key]) > 1:
            assert sum(r[2] for r in own) == sum(map(len, want[key]))
            continue
        (ids,), at = want[key], 0
        for _, start, some, crc, total, _, _ in sorted(own, key=lambda r: r[1]):
            assert start == at and total == len(ids) and some > 0
            assert crc == zlib.crc32(np.array(ids[start : start + some], "<u4"))
            at += some
        assert at == len(ids)
    filled = {}
    for _, _, some, _, _, sequence, offset in rows:
        filled.setdefault(sequence, []).append((offset, some))
    tokens = padded = 0
    for own in filled.values():
        at = 0
        for offset, some in sorted(own):
            assert offset == at
            at += some
        assert at <= length
        tokens += at
        padded += at if at.bit_count() == 1 else length
    assert padded == tokens
    return len(rows) / len(docs)


def test_query(spark):
    found = queries()["op12_packing"](spark, SMALL)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.columns[:7] == names
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    check([tuple(r) for r in found.select(*names).collect()], docs, 1)


def test_odd_rows_and_sequences(spark, docs):
    rows = [(1, None, "a"), (2, "", "a"), (None, "A null key.", "a"), (3, "same here", "b")]
    rows += [(3, "same here", "b"), (4, "long words " * 3000, "c"), (5, "é漢字 <|endoftext|> x", "c")]
    rows += [(k, "w " * (k % 19), "hot") for k in range(10, 200)]
    packed = packing.pack(docs(rows).repartition(3), FILE, end=7, length=64)
    names = ["key", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]
    check([tuple(r) for r in packed.pieces.select(*names).collect()], [r[:2] for r in rows], 7, 64)
    made = packing.sequences(packed).collect()
    assert len(made) == packed.pieces.select("sequence_id").distinct().count()
    got = sum((Counter(r["ids"]) for r in made), Counter())
    assert got == sum((Counter(ids_of(t, 7)) for _, t, _ in rows), Counter())
    assert all(r["starts"][0] == 0 and r["starts"] == sorted(set(r["starts"])) for r in made)


def test_empty_table(spark, docs):
    packed = packing.pack(docs([]), FILE, end=1)
    assert packed.pieces.collect() == [] and packing.sequences(packed).collect() == []
