"""Encoding against the sentencepiece library; the language model against plain counts and laws."""

import itertools
import math
import random
import time
from collections import Counter
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import held, words_of

from ripplemap.llm import pieces_bpe, pitman_yor
from ripplemap.llm.pitman_yor import Settings

FILE = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=FILE)
MODEL = pieces_bpe.model_of(open(FILE, "rb").read())
LETTERS = "abctheingo é ß日 ▁\n\t<s>/0xA'.​😀́"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(LETTERS), st.characters(codec="utf-8")), max_size=60))
def test_encodes_and_decodes_as_the_library(text):
    ids = SP.encode(text, add_eos=True)
    got, decoded = MODEL.encode(text)
    assert got.tolist() == ids
    assert MODEL.decode(got) == decoded == SP.decode(ids)


def test_backtracking_where_the_longest_piece_is_wrong():
    rnd = random.Random(1)
    names = [n for n in MODEL.ids if n.isalpha() and len(n) > 2]
    tried = 0
    for _ in range(4000):
        word = "".join(rnd.choice(names) for _ in range(rnd.randrange(1, 5)))[: rnd.randrange(2, 20)]
        want = MODEL.merge(list(word))
        greedy = [n for _, n in MODEL.longest.iter_long(word)]
        tried += greedy != want
        first = MODEL._longest_at(word, 0)
        assert MODEL._backtrack(word, [], first) == want == MODEL.split(word)
    assert tried > 200


def test_very_long_words():
    rnd = random.Random(8)
    for letters, n in (("abcdefghij", 2_000_000), ("the", 100_000), ("é日x", 50_000)):
        word = "".join(rnd.choices(letters, k=n))
        start = time.process_time()
        ids, decoded = MODEL.encode(word)
        assert time.process_time() - start < 15
        assert ids.tolist() == SP.encode(word, add_eos=True) and decoded == word


def test_round_trip_operator(docs):
    rows = [(1, None, "s"), (2, "", "s"), (3, "  a \n b", "s"), (3, "x", "s"), (None, "word " * 30_000, "s")]
    got = pieces_bpe.round_trip(docs(rows), FILE).collect()
    have = sorted((str(r.key), r.ids, r.decoded) for r in got)
    want = [SP.encode(t or "", add_eos=True) for _, t, _ in rows]
    assert have == sorted((str(k), ids, SP.decode(ids)) for (k, *_), ids in zip(rows, want))
    assert pieces_bpe.round_trip(docs(rows).limit(0), FILE).count() == 0


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces_bpe, "WORDS", 50)
    monkeypatch.setattr(pieces_bpe, "PAIRS", 50)
    model = pieces_bpe.Model(open(FILE, "rb").read())
    rnd = random.Random(2)
    for _ in range(300):
        text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(6))) for _ in range(9))
        assert model.encode(text)[0].tolist() == SP.encode(text, add_eos=True)
        assert len(model.known) <= 51 and len(model.fits) <= 51


def corpus(n=250, seed=3):
    rnd = random.Random(seed)
    follow = {f"w{i}": [f"w{rnd.randrange(60)}" for _ in range(4)] for i in range(60)}
    rows = [(-1, None, "s"), (-2, "", "s"), (None, "w1 w2", "s"), (7, "W1\tÉ w2\x0b", "s"), (8, "the " * 3000, "s")]
    for i in range(n):
        word, text = "w0", []
        for _ in range(rnd.randrange(40)):
            word = rnd.choice(follow[word])
            text.append(word.upper() if rnd.random() < 0.2 else word)
        rows.append((100 + i, "  ".join(text), "s"))
    return [*rows, rows[9]]


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2000])
def test_scores(docs, bucket_bytes):
    rows = corpus()
    own = replace(Settings(), bucket_bytes=bucket_bytes, contexts=200)
    got = pitman_yor.scores(docs(rows).repartition(3), settings=own).collect()
    counts = Counter(itertools.chain(*(words_of(t) for k, t, _ in rows if not held(k))))
    total, v = counts.total(), len(counts)
    want = []
    for k, t, _ in rows:
        w = words_of(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w)
        want.append((str(k), held(k), len(w), sum(counts[x] > 0 for x in w), total, f"{base:.6f}"))
    have = [(str(r.key), r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}") for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    # Words that follow each other in a pattern: the model must know more than word counts do.
    long = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in long) > 0.8 * sum(r.base_score for r in long) + 1
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def state_of(rows, own):
    """One bucket, seated, outside Spark."""
    batch = pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["key", "text"]
    )
    word, text, last = pitman_yor.tokens(batch.column("text").fill_null(""))
    context = pitman_yor.context_of(last, own.contexts)
    words, place = np.unique(word, return_inverse=True)
    pair, count = np.unique(place << 16 | context, return_counts=True)
    blob = pitman_yor.pack(words=words, word=np.diff(pair >> 16, prepend=0), context=pair & 0xFFFF, count=count)
    totals = pitman_yor.Totals(n_tokens=int(count.sum()), n_words=len(words))
    totals.customers = np.bincount(context, minlength=own.contexts)
    bucket = pitman_yor.Bucket(0, blob, own, totals)

    def note():
        tables = np.bincount(bucket.context, bucket.tables, own.contexts).astype(np.int64)
        totals.sweeps.append(pitman_yor.Sweep(tables, int(bucket.parent_tables.sum()), {}))

    note()
    for sweep in range(3):
        bucket.sweep(sweep)
        note()
    return bucket


def test_probabilities_sum_to_one():
    own = replace(Settings(), contexts=50)
    b = state_of(corpus(), own)
    last, t = len(b.totals.sweeps) - 1, b.totals
    parent = b.word_probability(last)
    base = (own.strengths[0] + own.discounts[0] * t.sweeps[last].parent_tables) / (t.n_words + 1)
    unknown = base / (own.strengths[0] + t.sweeps[last].tables.sum())
    assert parent.sum() + unknown == pytest.approx(1)
    seen = np.bincount(b.context, b.probability(last), own.contexts)
    for c in np.flatnonzero(t.customers):
        rest = 1 - parent[b.word[b.context == c]].sum()
        new = own.strengths[1] + own.discounts[1] * t.sweeps[last].tables[c]
        assert seen[c] + rest * new / (own.strengths[1] + t.customers[c]) == pytest.approx(1)
    assert (b.tables <= b.count).all() and (b.tables >= np.minimum(b.count, 1)).all()


@pytest.mark.parametrize("new", [0.05, 0.8])
def test_seating_has_the_exact_distribution(new):
    discount, n = 0.7, 6
    law = np.zeros(n + 1)

    def walk(sizes, left, weight):
        """All ways to seat the customers in turn, weighted by the products of their choices."""
        if not left:
            law[len(sizes)] += weight
            return
        for k in range(len(sizes)):
            walk([*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]], left - 1, weight * (sizes[k] - discount))
        walk([*sizes, 1], left - 1, weight * new)

    walk([1], n - 1, new)
    law /= law.sum()
    rng = np.random.default_rng(0)
    drawn = pitman_yor.seat(np.full(40_000, n), np.full(40_000, new), discount, rng)
    assert np.abs(np.bincount(drawn, minlength=n + 1) / 40_000 - law).max() < 0.012
    large = pitman_yor.seat(np.full(200, 100_000), np.full(200, new), discount, rng)
    assert (large >= 1).all() and (large < 100_000).all()


def test_all_held_out_and_empty(docs):
    none = [(k, "a b", "s") for k in range(200) if held(k)]
    got = pitman_yor.scores(docs(none)).collect()
    assert len(got) == len(none) and all(r.held_out and r.n_known == 0 for r in got)
    assert all(r.score == pytest.approx(0) for r in got)  # one word, the unknown one
    assert pitman_yor.scores(docs(none).limit(0)).count() == 0
