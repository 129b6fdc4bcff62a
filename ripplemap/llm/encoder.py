"""Token ids of whole texts, serialized, with a tokenizer file of the ``tokenizers`` library.

For tokenizers of the shape below, white space is dropped and never crossed, so texts are encoded word
by word, and each different word once for as long as it is remembered. A single mark after a letter
or digit is a token of its own there, and a word of plain lower-case letters reaches the merges as it
is. Any other tokenizer is given whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
from tokenizers import Tokenizer

# The normaliser and the word pattern of tokenizers whose words may be cut at white space.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE = 200_000

# Lower-case letters that no normaliser changes.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else one of those from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = _byte_letters()


def by_words(definition: str) -> bool:
    """Whether a tokenizer is of the shape that may be cut at white space."""
    own = json.loads(definition)
    normal, before = own.get("normalizer") or {}, own.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}, {}]
    return (
        normal.get("normalizers") == NORMALIZERS
        and len(steps) == 2
        and steps[0].get("pattern") == {"Regex": PATTERN}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex")
        and own["model"].get("dropout") is None
        and all(t["special"] and " " not in t["content"] and t["content"][:2] == "<|" for t in own["added_tokens"])
    )


class Words(dict):
    """Serialized ids by word; a word that is not there yet is encoded."""

    def __init__(self, tokenizer: Tokenizer, kind: np.dtype, before: dict[bytes, bytes]):
        super().__init__()
        self.tokenizer, self.model, self.kind, self.before = tokenizer, tokenizer.model, kind, before

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self._encode(word)
        self[word] = found
        return found

    def _encode(self, word: bytes) -> bytes:
        if word[-1:] in (b".", b",") and word[-2:-1].isalnum():
            return self[word[:-1]] + self[word[-1:]]
        text = word.decode()
        if PLAIN.fullmatch(text):
            if len(text) != len(word):
                text = "".join(map(LETTERS.__getitem__, word))
            ids = [t.id for t in self.model.tokenize(text)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()


class Encoder:
    """Serialized ids of texts, with a bounded memory of words."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs side by side
        self.tokenizer = Tokenizer.from_str(definition)
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.by_words = by_words(definition)
        self.known = Words(self.tokenizer, self.kind, {})

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text and then ``end``."""
        last = np.array([end], self.kind).tobytes()
        if not self.by_words:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(f.ids, self.kind).tobytes() + last for f in found]
        if len(self.known) > CACHE:
            self.known.before = {}
            self.known = Words(self.tokenizer, self.kind, self.known)
        ids = self.known.__getitem__
        return [b"".join([*map(ids, cut(t)), last]) for t in texts]


def cut(text: str) -> list[bytes]:
    """Words between white space. Capitals are lowered as the tokenizer does, except where that could
    touch a composed letter (lead bytes CC and CD) or a special token."""
    raw = text.encode()
    plain = b"\xcc" not in raw and b"\xcd" not in raw and b"<|" not in raw
    return (raw.lower() if plain else raw).split()


@functools.lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    """One encoder, with its memory, for all tasks of a worker process."""
    return Encoder(definition)
