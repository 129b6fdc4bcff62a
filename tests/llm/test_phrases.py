"""Collocations against a plain count of all phrases."""

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from __spark_entry__ import queries
from ripplemap.llm import phrases

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def slow(docs, least, first, percent=100, longest=5):
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        many = {p: c for p, c in own.items() if c >= least and len(p) > 1}
        inside = Counter()
        for q, c in many.items():
            for n in range(2, len(q)):
                for i in range(len(q) - n + 1):
                    inside[q[i : i + n]] = max(inside[q[i : i + n]], c)
        rows = []
        for p, a in many.items():
            if inside[p] and 100 * inside[p] >= percent * a:
                continue
            score, _, left, right = min(
                (1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]])
                for k in range(1, len(p))
            )
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def read(folder):
    rows = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    return [(r["lang"], r["text"]) for r in rows]


def test_query(spark):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        assert got(queries()["op13_phrases"](spark, folder)) == slow(read(folder), 100, 2000)


@pytest.mark.parametrize("percent, least, block", [(100, 3, 1 << 20), (60, 5, 3000), (1, 4, 50_000)])
def test_small_blocks_narrow_filters_and_other_shares(spark, percent, least, block):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    found = phrases.collocations(
        docs, least=least, first=300, percent=percent, filter_bits=1 << 12, block_bytes=block
    )
    assert got(found) == slow(read(SMALL), least, 300, percent)


ODD = [
    (None, "A b c. A B c! a b  c\ta b\nc"),
    (None, "a b c " * 40),
    ("x", None),
    ("x", ""),
    ("x", " \t.,;\n"),
    ("x", "É é É é É é ÉÉ  z\u0085 z\u0085 É é z\x00q z\x00q " * 3),
    ("y", "one " * 500),
    ("y", "one " * 500),
    ("", "p q p q p q"),
    ("é", ("w" * 100_000 + " v ") * 4),
]


def test_odd_rows(spark):
    schema = "lang string, text string, count long, phrase string, total long, words int, k int"
    docs = spark.createDataFrame([(*r, 7, "x", 1, 2, 3) for r in ODD], schema)
    assert got(phrases.collocations(docs, least=3)) == slow(ODD, 3, None)
    assert got(phrases.collocations(docs.where("false"), least=3)) == []
    assert got(phrases.collocations(docs.where("text is null"), least=1)) == []


def test_products_beyond_64_bits(spark):
    a, n, left, right = 3 * 10**12, 7 * 10**12, 5 * 10**12 + 1, 4 * 10**12 + 3
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    score = row.select(phrases._score(row.a, row.n, row.l, row.r)).first()[0]
    assert score == 1000 * a * n // (left * right)
