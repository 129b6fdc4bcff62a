"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit verification.

A document is contaminated by an item if some passage of it is within ``max_edits`` (a share of the
item's words) word edits of the item: insertions, deletions and substitutions. Words are lower-case
without punctuation.

1. Every window of an item's length in words is a candidate place. A word that no item has can match
   nothing, so a window with fewer item words than the edit bound leaves is passed over; this bound
   loses nothing.
2. The others are embedded by CGK random walks: at each step the walk writes the word it stands on
   and moves on or stays, by a random bit of step and word. Words within few edits give walks that
   agree in most steps, so edit distance turns into Hamming distance.
3. Bit-sampling LSH: ``samples`` steps of an embedding form a bucket key. Each repetition has its
   own walk, which begins at another place of the window, and samples its first step and random
   others. Repetitions are added until items with the greatest allowed number of random edits share
   a bucket with the chance ``recall``; that chance is measured on the items themselves, for short
   and long ones each, and for items that lost their first words. If it is not reached, that is
   an error.
4. Every candidate (passage, item) is verified by exact edit distance, bit-parallel.

Items go to the tasks as broadcast indexes of at most ``block_items``, so any number of them can be
used; each block is a pass over the documents. Documents are never shuffled.

Defined results: a null or empty text matches nothing; items of fewer than ``min_words`` words are
matched by exact copies only, and those of fewer than ``min_exact`` say nothing about leakage and
match nothing; of two items with one id each is an item; a null item id is reported as null;
repeated documents are judged each; an empty table of either kind gives an empty result; other columns
play no part, whatever their names.

Items are collected a block at a time, which suits a benchmark; each block is a pass over the texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import pieces, texts

# Characters that are no part of a word.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Bounds:
    max_edits: float = 0.2
    min_words: int = 8
    min_exact: int = 4
    recall: float = 0.97
    samples: int = 3
    block_items: int = 4_000
    max_repetitions: int = 512
    seed: int = 11


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split()


def walk_keys(words, at, ends, moves, steps, levels) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``at`` of the windows that end in a bucket, and their bucket keys.

    A walk writes the word it stands on at each of ``steps``; a key is a hash of what it wrote.
    ``words`` are word numbers, 0 for words of no item; a walk writes -1 from its end on. ``levels``
    holds the sorted partial keys of the items after each sampled step: a walk whose partial key is
    not among them can reach no bucket and stops. Without ``levels`` no walk stops.
    """
    alive, place = np.arange(len(at)), at.copy()
    key, level, last = np.zeros(len(at), np.uint64), 0, len(words) - 1
    for step in range(int(steps[-1]) + 1):
        word = np.where(place < ends, words[np.minimum(place, last)], -1)
        if step == steps[level]:
            key = (key ^ word.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            if levels is not None:
                known = levels[level]
                stays = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                stays &= word != 0
                alive, place, ends, key, word = (x[stays] for x in (alive, place, ends, key, word))
                if not len(alive):
                    break
            level += 1
        place += moves[step][word]  # the last column is that of -1
    return alive, key


class Index:
    """Bucket keys of a block of items, and what is needed to embed windows and verify them."""

    def __init__(self, items: list[tuple[int | None, bytes]], bounds: Bounds):
        self.bounds = bounds
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if len(w) >= bounds.min_exact]
        self.numbers: dict[bytes, int] = {}
        for _, words in split:
            for w in words:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        self.ids = [i for i, _ in split]
        self.words = [np.array([self.numbers[w] for w in words]) for _, words in split]
        self.edits = [
            int(len(w) * bounds.max_edits) if len(w) >= bounds.min_words else 0 for w in self.words
        ]
        self.of_length: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            self.of_length.setdefault(len(w), []).append(k)
        rng = np.random.default_rng(bounds.seed)
        longest = max(self.of_length, default=0)
        self.moves: list[np.ndarray] = []
        self.skips: list[float] = []
        self.steps: list[np.ndarray] = []
        if split:
            self._repeat(rng, longest)
        self.buckets = self._buckets()
        self._count_bounds()
        self.masks = [self._masks(w) for w in self.words]

    def _walk(self, r: int, length: int) -> tuple[int, np.ndarray]:
        """Where in a window of that length the walk begins, and its sampled steps."""
        skip = int(self.skips[r] * length)
        return skip, np.unique((self.steps[r] * 2 * (length - skip)).astype(np.int64))

    def _keys(self, r: int, words: np.ndarray, at: np.ndarray, length: int, levels):
        skip, steps = self._walk(r, length)
        ends = np.minimum(at + length, len(words))
        return walk_keys(words, at + skip, ends, self.moves[r], steps, levels)

    def _item_keys(self, r: int, items: list[int]) -> list[np.ndarray]:
        """The partial keys of items of one length after each sampled step."""
        flat, n = np.concatenate([self.words[k] for k in items]), len(self.words[items[0]])
        skip, steps = self._walk(r, n)
        at = np.arange(len(items)) * n
        return [
            walk_keys(flat, at + skip, at + n, self.moves[r], steps[: k + 1], None)[1]
            for k in range(len(steps))
        ]

    def _edited(self, rng, words: np.ndarray, edits: int, first: bool) -> np.ndarray:
        """The item with that many random edits, or without its first words, amid foreign words,
        which are 0, as is what lies before a document."""
        new = list(words)
        for _ in range(0 if first else edits):
            k, kind = int(rng.integers(len(new))), rng.integers(3)
            if kind == 0:
                new[k] = 0
            elif kind == 1:
                new.insert(k, 0)
            elif len(new) > 1:
                del new[k]
        return np.array([0] * edits + new[edits if first else 0 :] + [0] * len(words))

    def _repeat(self, rng, longest: int) -> None:
        """Add repetitions until edited items are found with the wanted chance, of each length."""
        width = len(self.numbers) + 2
        some = [int(k) for k in rng.permutation(len(self.words))[:200]]
        trials = [
            (k, self._edited(rng, self.words[k], self.edits[k], way == 0))
            for k in some
            for way in range(5)
        ]
        # Trials are judged by length, in four classes of equal size, and those without their
        # first words on their own.
        order = np.argsort([len(self.words[k]) for k in some], kind="stable")
        rank = np.empty(len(some), np.int64)
        rank[order] = np.arange(len(some)) * 4 // len(some)
        kind = np.array([4 if way == 0 else rank[i] for i in range(len(some)) for way in range(5)])
        missed = np.ones(len(trials), bool)
        while len(self.moves) < self.bounds.max_repetitions:
            # The moves of a repetition, where in the window its walk begins, and its sampled
            # steps: the first one, and others as shares of twice the length that is left.
            self.moves.append(rng.integers(0, 2, (2 * longest, width)).astype(np.int8))
            self.skips.append(rng.random() / 2)
            self.steps.append(np.sort(np.append(0, rng.random(self.bounds.samples - 1))))
            r = len(self.moves) - 1
            for t in np.flatnonzero(missed):
                k, edited = trials[t]
                levels = [np.sort(x) for x in self._item_keys(r, [k])]
                windows = np.arange(2 * self.edits[k] + 1)
                missed[t] = not len(self._keys(r, edited, windows, len(self.words[k]), levels)[0])
            shares = np.bincount(kind, missed) / np.maximum(np.bincount(kind), 1)
            if shares.max() <= 1 - self.bounds.recall:
                return
        raise ValueError(f"{len(self.moves)} repetitions miss a share of {shares.max():.3f}; allow more")

    def _buckets(self) -> list[dict[int, tuple[list[np.ndarray], dict[int, list[int]]]]]:
        """For each repetition and length: sorted partial keys, and the items of each full key."""
        found = []
        for r in range(len(self.steps)):
            by_length = {}
            for n, items in self.of_length.items():
                levels, by_key = self._item_keys(r, items), {}
                for k, key in zip(items, levels[-1].tolist(), strict=True):
                    by_key.setdefault(key, []).append(k)
                by_length[n] = [np.unique(x) for x in levels], by_key
            found.append(by_length)
        return found

    def _count_bounds(self) -> None:
        """What a window of length n must hold at least: item words, and rare item words.

        A word is rare if few items have it. An item within the edit bound keeps all but that many
        of its words in the window, so both counts are bounds that lose nothing.
        """
        items_with: dict[int, int] = {}
        for words in self.words:
            for w in set(words.tolist()):
                items_with[w] = items_with.get(w, 0) + 1
        limit = max(1, len(self.words) // 50)
        self.rare = np.zeros(len(self.numbers) + 2, bool)
        self.rare[[w for w, n in items_with.items() if n <= limit]] = True
        self.least = {
            n: (
                n - self.edits[items[0]],
                max(0, min(int(self.rare[self.words[k]].sum()) for k in items) - self.edits[items[0]]),
            )
            for n, items in self.of_length.items()
        }
        # Lengths in groups, of which the longest window and the least bounds serve as a first test.
        self.groups: list[list[int]] = []
        for n in sorted(self.of_length):
            if self.groups and n <= 1.15 * self.groups[-1][0]:
                self.groups[-1].append(n)
            else:
                self.groups.append([n])

    @staticmethod
    def _masks(words: np.ndarray) -> dict[int, int]:
        masks: dict[int, int] = {}
        for k, w in enumerate(words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << k
        return masks

    def verify(self, k: int, passage: list[int]) -> tuple[int, int]:
        """Least edit distance of item ``k`` to any part of ``passage``, and where that part ends."""
        masks, n = self.masks[k], len(self.words[k])
        full, top = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score, best = full, 0, n, (n, 0)
        for j, w in enumerate(passage):
            eq = masks.get(w, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus) & full, plus & xh
            score += (ph & top > 0) - (mh & top > 0)
            ph, mh = ph << 1 & full, mh << 1 & full
            plus, minus = mh | ~(xv | ph) & full, ph & xv
            if score < best[0]:
                best = score, j + 1
        return best

    def candidates(self, words: np.ndarray) -> set[tuple[int, int]]:
        """``(item, window start)`` of all windows that share a bucket with an item."""
        found: set[tuple[int, int]] = set()
        total = len(words)
        known, rare = (
            np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in (words > 0, self.rare[words])
        )
        for group in self.groups:
            n = min(group[-1], total)
            least = min(self.least[m][1] for m in group)
            tail = np.arange(total - n + 1, total)
            near = np.flatnonzero(rare[n:] - rare[: total + 1 - n] >= least)
            near = np.concatenate([near[near < total], tail])
            for m in group:
                ends = np.minimum(near + m, total)
                enough = known[ends] - known[near] >= self.least[m][0]
                enough &= rare[ends] - rare[near] >= self.least[m][1]
                at = near[enough]
                for r in range(len(self.steps) if len(at) else 0):
                    levels, items = self.buckets[r][m]
                    alive, keys = self._keys(r, words, at, m, levels)
                    for i, key in zip(alive.tolist(), keys.tolist(), strict=True):
                        found.update((k, int(at[i])) for k in items[key])
        return found

    def search(self, docs: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """``(doc, item, edits, first word, end word)``: the best passage of each pair."""
        gap = [0] * max(self.of_length, default=1)
        numbers, flat, bounds = self.numbers, [*gap], []
        for text in docs:
            start = len(flat)
            flat.extend(map(numbers.get, words_of(text), itertools.repeat(0)))
            bounds.append((start, len(flat)))
            flat += gap  # no window of one document reaches the words of another
        if not self.words or not docs:
            return
        starts, stops = np.array(bounds).T
        places: dict[tuple[int, int], list[int]] = {}
        for k, at in self.candidates(np.array(flat)):
            # A window may begin before the document whose words it covers.
            doc = int(np.searchsorted(stops, at, "right"))
            if doc < len(stops) and starts[doc] < at + len(self.words[k]):
                places.setdefault((doc, k), []).append(at)
        for (doc, k), ats in sorted(places.items()):
            n, edits, best = len(self.words[k]), self.edits[k], None
            # Windows that overlap are verified as one passage.
            ats.sort()
            first = last = ats[0]
            for at in [*ats[1:], None]:
                if at is not None and at - last <= n:
                    last = at
                    continue
                low = max(bounds[doc][0], first - edits)
                high = min(bounds[doc][1], last + n + edits)
                score, end = self.verify(k, flat[low:high])
                if score <= edits and (best is None or score < best[0]):
                    stop = low + end - bounds[doc][0]
                    best = score, max(0, stop - n), stop
                first = last = at
            if best:
                yield doc, k, *best


def _blocks(items: DataFrame, key: str, text: str, bounds: Bounds) -> Iterator[list[tuple]]:
    """The items in lists of at most ``block_items``."""
    own = items.select(items[key].cast("long").alias("id"), items[text].alias("text")).where(
        F.col("text").isNotNull()
    )
    n = max(1, math.ceil(own.count() / bounds.block_items * 1.5))
    for b in range(n):
        part = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()
        rows = [(r["id"], r["text"].encode()) for r in part]
        yield sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _in_batches(batches, index: Index, text: str = "text"):
    for batch in pieces(batches, 4 << 20, text):
        whole = batch.column(text).cast(pa.binary()).to_pylist()
        yield batch, list(index.search([t or b"" for t in whole]))


def matches(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """A row for each contaminated document and item: ``key``, ``item``, ``edits`` and the words
    ``start`` to ``stop`` (exclusive) of its best passage."""
    spark = docs.sparkSession
    own = texts(docs, key, text)
    found = None
    for block in _blocks(items, item_key, item_text, bounds):
        shared = spark.sparkContext.broadcast(Index(block, bounds))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, hits in _in_batches(batches, index):
                if hits:
                    doc, k, *rest = (np.array(c) for c in zip(*hits, strict=True))
                    ids = batch.column("key").take(pa.array(doc))
                    items = pa.array([index.ids[i] for i in k], pa.int64())
                    columns = [ids, items, *map(pa.array, rest)]
                    yield pa.record_batch(columns, names=["key", "item", "edits", "start", "stop"])

        part = own.mapInArrow(run, "key long, item long, edits long, start long, stop long")
        found = part if found is None else found.union(part)
    return found


def clean(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with the same columns."""
    spark = docs.sparkSession
    for block in _blocks(items, item_key, item_text, bounds):
        shared = spark.sparkContext.broadcast(Index(block, bounds))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, hits in _in_batches(batches, index, text):
                stays = np.ones(batch.num_rows, bool)
                stays[[h[0] for h in hits]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
