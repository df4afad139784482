"""Chunked encoding equals encoding the whole text."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylens.llm._encode import ChunkEncoder

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
ODD = [
    "", " ", "  a  b", "a \n b", "x\n", "\n\n\ty z", "don't  we'll x 　y", " ́a", "Σίσυφος ΣΑΣ", "<|endoftext|> a<|endoftext|>b",
    "a\x1cb c\x85d", "naïve 123 4567  !!??  ", "é x", "​ zz ﻿ qq", "a  ", "été. Été,, ÉCOLE!? ǅx Kelvin İstanbul ISTANBUL é́ straße ŁÓDŹ; ﬁ.",
    "a.\nB, c.\n", " . , ;; a;b; a..", "ab.c, d.,e", "it's o' x'' y\nz\n", "a*** b&&&\nc_d\n\ne f\ng\th", "head", " lead x", "x\n y\nÉz, \nq", "a\n\nb c\n'sd", "x" * 300 + " " + "é" * 200,
]


@pytest.fixture(scope="module")
def pair():
    out = {}
    for kind, name in FILES.items():
        whole = Tokenizer.from_file(str(public_tokenizers.path(name)))
        whole.encode_special_tokens = True
        out[kind] = (ChunkEncoder(str(public_tokenizers.path(name)), kind), whole)
    return out


def check(pair, texts):
    for chunked, whole in pair.values():
        for text, got in zip(texts, chunked.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_texts(pair):
    check(pair, ODD)
    check(pair, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abEÉéſK 's.,!\n\t\r  012_#&日😀́İΣ-"), max_size=40), min_size=1, max_size=4))
def test_any_text(pair, texts):
    check(pair, texts)


class Counting:
    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, run):
        self.asked.append(run)
        return self.model.tokenize(run)


def test_words_are_encoded_once_and_recurring_ones_stay(monkeypatch):
    """Marks after a word do not make it a new one; where too many words are remembered, those of one slice alone go."""
    path = str(public_tokenizers.path(FILES["word"]))
    whole, enc = Tokenizer.from_file(path), ChunkEncoder(path, "word")
    enc.model = Counting(enc.model)
    right = lambda t: np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    letters = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    monkeypatch.setattr("quarrylens.llm._encode._ROOM", 50)
    for k in range(30):
        texts = ["the, THE. the; été, été. " + "y" * 70 + ",", "", " ".join(letters(10_000 + 20 * k + i) for i in range(20))]
        assert enc.encode(texts) == [right(t) for t in texts]
    assert enc.model.asked.count("the") == 1
