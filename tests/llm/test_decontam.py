"""Contaminated passages: recall on edited items, exactness of what is found, edge cases."""

import random

import pytest

from ripplemap.llm import decontam
from ripplemap.llm.decontam import Bounds, Index

WORDS = [a + b for a in "the of in er on th re ti an".split() for b in "ing nd at ion le st ou ha is ed".split()]


def distance(item, passage):
    """Least edits to any part of the passage, by the plain recurrence."""
    row = [0] * (len(passage) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(passage, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


@pytest.fixture
def items():
    rnd = random.Random(3)
    return [(k, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(12, 60)))) for k in range(60)]


def edited(rnd, words, rate):
    words = list(words)
    for _ in range(int(len(words) * rate)):
        k, kind = rnd.randrange(len(words)), rnd.randrange(3)
        if kind == 0:
            words[k] = rnd.choice(WORDS)
        elif kind == 1:
            words.insert(k, rnd.choice(WORDS))
        else:
            del words[k]
    return words


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2])
def test_recall_and_precision(items, rate):
    rnd = random.Random(8)
    index = Index([(k, t.encode()) for k, t in items], Bounds())
    docs, planted = [], []
    for _ in range(150):
        k, text = rnd.choice(items)
        noise = [[rnd.choice(WORDS) for _ in range(rnd.randrange(80))] for _ in range(2)]
        docs.append(noise[0] + edited(rnd, text.split(), rate) + noise[1])
        planted.append(k)
    found = {}
    for doc, k, edits, start, stop in index.search([" ".join(d).encode() for d in docs]):
        words = items[index.ids[k]][1].split()
        assert edits <= len(words) * 0.2 and 0 <= start < stop <= len(docs[doc])
        assert distance(words, docs[doc]) <= edits
        found.setdefault(doc, set()).add(index.ids[k])
    hit = sum(k in found.get(d, ()) for d, k in enumerate(planted)) / len(planted)
    assert hit >= (1.0 if rate == 0 else 0.9)


@pytest.mark.parametrize("gone", [1, 2, 3])
def test_items_that_lost_words_at_either_end_of_a_document(items, gone):
    index = Index([(k, t.encode()) for k, t in items], Bounds())
    able = [k for k, n in enumerate(index.edits) if n >= gone]
    lost = [index.ids[k] for k in able]
    split = {k: items[k][1].split() for k in lost}
    for head, tail in ((gone, 0), (0, gone)):
        texts = [" ".join(split[k][head : len(split[k]) - tail]).encode() for k in lost]
        alone = [{h[1] for h in index.search([t])} for t in texts]  # the first of a batch
        later = [set() for _ in texts]
        for doc, k, *_ in index.search([b"", b"x y z", *texts]):
            later[doc - 2].add(k)
        for found in (alone, later):
            assert sum(k in f for k, f in zip(able, found)) >= 0.9 * len(able)


def test_short_items_match_exact_copies_only(spark, docs):
    bench = [(1, "w1 w2 w3 w4"), (2, "one two three"), (None, "Alpha beta, gamma delta epsilon."), (-1, "a b c d e f g")]
    rows = [
        (1, "w0 w1 w2 w3 w4 w5", "s"), (2, "w1 w2 w3 x w4", "s"), (3, "one two three", "s"),
        (4, "alpha beta gamma delta epsilon", "s"), (5, "w1 w2 w3 w4", "s"), (6, "a b c d e f", "s"),
    ]
    found = decontam.matches(docs(rows), spark.createDataFrame(bench, "item_id long, text string"))
    got = sorted(((r.key, r.item, r.edits, r.start, r.stop) for r in found.collect()), key=str)
    assert got == [(1, 1, 0, 1, 5), (4, None, 0, 0, 5), (5, 1, 0, 0, 4)]


def test_a_recall_out_of_reach_is_an_error(items):
    with pytest.raises(ValueError, match="repetitions"):
        Index([(k, t.encode()) for k, t in items], Bounds(recall=1.0, max_repetitions=2))


def test_verify_is_exact(items):
    rnd = random.Random(5)
    index = Index([(k, t.encode()) for k, t in items], Bounds())
    for _ in range(200):
        k = rnd.randrange(len(index.words))
        passage = edited(rnd, index.words[k].tolist(), rnd.random())
        passage = [w if isinstance(w, int) else 0 for w in passage] + [0] * rnd.randrange(3)
        assert index.verify(k, passage)[0] == distance(index.words[k].tolist(), passage)


def test_operator_and_edges(docs, spark, items):
    text = items[0][1]
    rows = [
        (1, text, "s"), (2, text.upper().replace(" ", ",\n"), "s"), (3, None, "s"), (4, "", "s"),
        (5, " ".join(WORDS * 3), "s"), (None, f"x {text} y", "s"), (1, text, "s"),
        (7, (text + " ") * 500, "s"), (8, " ".join(text.split()[: len(text.split()) // 2]), "s"),
    ]
    bench = spark.createDataFrame([*items, (98, None), (99, "too short"), (97, "")], "item_id long, text string")
    found = decontam.matches(docs(rows), bench).collect()
    assert sorted((str(r.key), r.item, r.edits) for r in found) == sorted(
        [(x, 0, 0) for x in ("1", "1", "2", "7", "None")]
    )
    small = Bounds(block_items=7)  # many blocks give the same
    again = decontam.matches(docs(rows), bench, bounds=small).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    left = decontam.clean(docs(rows), bench)
    assert left.columns == docs(rows).columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 8]
    assert decontam.matches(docs(rows), bench.limit(0)).count() == 0
    assert decontam.matches(docs(rows).limit(0), bench).count() == 0
    assert decontam.clean(docs(rows), bench.limit(0)).count() == len(rows)
