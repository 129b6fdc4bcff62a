"""Word by word encoding against the library on whole texts."""

import json
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ripplemap.llm import encoder

FILE = public_tokenizers.path("word_bpe_49k.json")
DEFINITION = Path(FILE).read_text(encoding="utf8")
OWN, LIBRARY = encoder.Encoder(DEFINITION), Tokenizer.from_str(DEFINITION)
PARTS = "a B é É ß ÿ Ÿ İ ı K Å Å é . , ' 's 'LL 7 ½ … - <|endoftext|> <| |>   \u0085 \x1c   \x00 日 ﬁ Ω 😀".split(" ")


def same(text):
    (got,) = OWN.encode([text], 5)
    assert np.frombuffer(got, OWN.kind).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 5]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*PARTS, " ", " ", "\n", "the"]), st.characters(codec="utf-8")), max_size=40))
def test_same_as_the_library(parts):
    same("".join(parts))


def test_words_met_before_and_generations(monkeypatch):
    monkeypatch.setattr(encoder, "CACHE", 40)
    OWN.known = encoder.Words(OWN.tokenizer, OWN.kind, {})
    draw = random.Random(4)
    for _ in range(400):
        same("".join(draw.choice([*"abcdé.,  E", "foo", "Bar."]) for _ in range(draw.randrange(60))))
        assert len(OWN.known) < 200 and len(OWN.known.before) < 200


@pytest.mark.parametrize("change", ["pattern", "normalizer", "dropout", "other"])
def test_other_tokenizers_get_whole_texts(change):
    own = json.loads(DEFINITION)
    if change == "pattern":
        own["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\s*\p{L}+|\S"}
    elif change == "normalizer":
        own["normalizer"] = None
    elif change == "dropout":
        own["added_tokens"][0]["content"] = "a b"
    else:
        own = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf8"))
    definition = json.dumps(own)
    made, library = encoder.Encoder(definition), Tokenizer.from_str(definition)
    assert OWN.by_words and not made.by_words
    texts = ["", " Two  Words.\n", "Été a b a"]
    for raw, text in zip(made.encode(texts, 3), texts, strict=True):
        assert np.frombuffer(raw, made.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 3]
