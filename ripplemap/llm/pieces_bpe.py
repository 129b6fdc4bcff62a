"""SentencePiece encoding and decoding: exact merges found by backtracking.

A text is encoded word by word: no piece has a word mark after another character, and no merge
crosses a character that no piece has, so both cut a text into words of their own.

In a word, the encoding is the only sequence of pieces in which every two neighbours are compatible,
that is, in which merging the two pieces' characters anew gives these two pieces again. It is found
like this: take the longest piece at the current position (Aho-Corasick); if it is not compatible
with the piece before, take the next shorter one; if there is none, mark the position as failed in a
bitfield (a byte each), drop the piece before and go on from there with a shorter one. A piece that would end at a
failed position is passed over, so no position is tried twice. The longest pieces of a whole word are
tried first at once, since most words need no more.

Compatibility is kept by pairs, and encodings, with what they decode to, by words, in caches of
bounded size: the words of the last generation are not looked for again.

Defined results: a null text is encoded as an empty one, which has the end id only; characters of no
piece are encoded as bytes; repeated rows are encoded each; an empty table gives an empty result;
other columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ripplemap.llm.common import pieces, texts

# Fixed value: the word mark, which stands for a space.
MARK = "▁"
WORDS, PAIRS = 300_000, 700_000


class Model:
    """Pieces of a model file with byte fallback and a mark before each text."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.scores = [sp.get_score(i) for i in range(size)]
        normal = [
            i
            for i in range(size)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        ]
        self.ids = {self.names[i]: i for i in normal}
        self.bytes = [0] * 256
        for i in range(size):
            if sp.is_byte(i):
                self.bytes[int(self.names[i][3:5], 16)] = i
        self.end = sp.eos_id()
        self.characters = {c for name in self.ids for c in name}
        if any(MARK in name.lstrip(MARK) for name in self.ids) or self.characters - self.ids.keys():
            raise ValueError("a piece has a mark inside, or a character that is no piece")
        self.longest = ahocorasick.Automaton()
        for name in self.ids:
            self.longest.add_word(name, name)
        self.longest.make_automaton()
        self.shorter = {name: self._prefix(name) for name in self.ids}
        self.most = max(map(len, self.ids))
        self.fits: dict[tuple[str, str], bool] = {}
        # 32-bit ids of words and what they decode to; the words of the generation before.
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}
        # What each id decodes to.
        self.raw = [b""] * size
        for name, i in self.ids.items():
            self.raw[i] = name.replace(MARK, " ").encode()
        for value, i in enumerate(self.bytes):
            self.raw[i] = bytes([value])

    def _prefix(self, name: str) -> str | None:
        """The longest piece that begins ``name`` and is shorter."""
        return next((name[:k] for k in range(len(name) - 1, 0, -1) if name[:k] in self.ids), None)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge neighbours that form a piece, the best piece first, the leftmost of equals."""
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        pair = left, right
        fits = self.fits.get(pair)
        if fits is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            fits = self.merge([*left, *right]) == ([left, right] if right else [left])
            self.fits[pair] = fits
        return fits

    def split(self, word: str) -> list[str]:
        """The pieces of a word whose characters are all pieces."""
        greedy = [name for _, name in self.longest.iter_long(word)]
        if all(map(self.fits.get, zip(greedy, [*greedy[1:], ""]))):  # pairs met before
            return greedy
        for k, pair in enumerate(zip(greedy, [*greedy[1:], ""])):
            if not self.compatible(*pair):
                return self._backtrack(word, greedy[:k], greedy[k])
        return greedy

    def _longest_at(self, word: str, at: int) -> str:
        """No more than a piece's length is looked at, however long the word."""
        return next(self.longest.iter_long(word[at : at + self.most]))[1]

    def _backtrack(self, word: str, taken: list[str], name: str | None) -> list[str]:
        """Go on after ``taken``, whose neighbours are compatible, with ``name`` as the longest."""
        known, shorter = self.fits.get, self.shorter
        failed = bytearray(len(word) + 1)
        at = sum(map(len, taken))
        while True:
            while name is not None:
                end = at + len(name)
                if not failed[end]:
                    pair = (taken[-1], name) if taken else (name, "")
                    fits = known(pair)
                    if fits or (fits is None and self.compatible(*pair)):
                        break
                name = shorter[name]
            if name is not None:
                taken.append(name)
                at = end
                if at == len(word):
                    return taken
                name = self._longest_at(word, at)
            else:
                failed[at] = 1
                name = taken.pop()
                at -= len(name)
                # Its end has failed now, so that the loop goes on to a shorter piece.

    def encode_word(self, word: str) -> tuple[bytes, bytes]:
        """32-bit ids of a word of ``words``, and their bytes; both are kept for later."""
        found = self.before.get(word)
        if found is None:
            ids: list[int] = []
            own = word if word[:1] == "\n" else MARK + word
            parts = [own] if self.characters.issuperset(own) else self._known_parts(own)
            for part in parts:
                if part[0] in self.ids:
                    ids += map(self.ids.__getitem__, self.split(part))
                else:
                    ids += [self.bytes[b] for b in part.encode()]
            found = array("i", ids).tobytes(), b"".join(map(self.raw.__getitem__, ids))
        if len(self.known) >= WORDS:
            self.known, self.before = {}, self.known
        self.known[word] = found
        return found

    def _known_parts(self, word: str) -> Iterator[str]:
        """Runs of characters that are pieces, and each other character."""
        start = 0
        for k, c in enumerate(word):
            if c not in self.ids:
                if k > start:
                    yield word[start:k]
                yield c
                start = k + 1
        if start < len(word):
            yield word[start:]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text, with the end id, and the text that they decode to."""
        known, new = self.known.get, self.encode_word
        found = [known(w) or new(w) for w in words(text)]
        ids = b"".join([f[0] for f in found]) + np.int32(self.end).tobytes()
        raw = b"".join([f[1] for f in found])
        if raw[:1] == b" ":  # the mark before the text
            raw = raw[1:]
        return np.frombuffer(ids, "<i4"), raw.decode("utf-8", "replace")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are left out, and so is the mark before the text."""
        parts = list(map(self.raw.__getitem__, ids.tolist()))
        first = next((k for k, part in enumerate(parts) if part), None)
        if first is not None and self.names[ids[first]][:1] == MARK:
            parts[first] = parts[first][1:]
        return b"".join(parts).decode("utf-8", "replace")


def words(text: str) -> list[str]:
    """A text cut where no merge can cross.

    A line end begins a word; every other word has one mark before it that is left out here.
    """
    if not text:
        return []
    parts = text.replace(MARK, " ").replace("\n", " \n").split(" ")
    if "" not in parts:
        return parts
    out, marks = [], 0
    for part in [*parts, None]:
        if part == "":
            marks += 1
        elif part is None or part[0] == "\n":
            out += [MARK * (marks - 1)] * (marks > 0)
            out += [part] * (part is not None)
            marks = 0
        else:
            out.append(MARK * marks + part)
            marks = 0
    return out


@functools.lru_cache(maxsize=2)
def model_of(proto: bytes) -> Model:
    """One model, with its caches, for all tasks of a worker process."""
    return Model(proto)


def round_trip(
    docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``ids`` (with the end id) and ``decoded`` (the text that the ids give) of each row."""
    proto = docs.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(proto.value)
        for batch in pieces(batches, 4 << 20):
            both = [model.encode(t or "") for t in batch.column("text").to_pylist()]
            ids = [b[0] for b in both]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = [
                batch.column("key"),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                pa.array([b[1] for b in both], pa.string()),
            ]
            yield pa.record_batch(columns, names=["key", "ids", "decoded"])

    return texts(docs, key, text).mapInArrow(run, "key long, ids array<int>, decoded string")
