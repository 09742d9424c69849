import random

import numpy as np
import pytest

from quire.llm import tokenfiles
from quire.llm.queries import WORDS


@pytest.fixture(scope="module")
def spec():
    with open(WORDS, encoding="utf-8") as f:
        return f.read()


def test_words_with_any_punctuation_need_no_whole_encoding(spec, monkeypatch):
    enc = tokenfiles.ChunkEncoder(spec)
    given, whole = [], enc._whole
    monkeypatch.setattr(enc, "_whole", lambda chunks: given.extend(chunks) or whole(chunks))
    list(enc.batch(["Naïve### thing&&&, it' (x) été... naïve### a<| a2", "Other### other... 7"]))
    assert sorted(given) == ["###", "&&&,", "'", "(x)", "...", "7", "<|", "a2"]  # the runs of marks once each, and what is no word


def test_chunks_of_marks_and_letters_equal_the_library(spec):
    from tokenizers import Tokenizer

    enc, tok, rng = tokenfiles.ChunkEncoder(spec), Tokenizer.from_str(spec), random.Random(2)
    letters = ["a", "The", "É", "ß", "µ", "ª", "ÿ", "İ", "Σ", "é", "́", "'s", "'S", "ll", "7", "²", "\x85", "\x00", "中", "q" * 50]
    marks = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "#" * 60, "¿", "…"]
    texts = ["".join(rng.choice(letters if rng.random() < 0.6 else [*marks, " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for t, raw in zip(texts, enc.batch(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_remembered_chunks_have_a_bound(spec, monkeypatch):
    monkeypatch.setattr(tokenfiles, "CHUNKS", 200)
    enc = tokenfiles.ChunkEncoder(spec)
    sizes = []
    for _ in enc.batch(" ".join(f"w{'abcdefgh'[k % 8]}{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}." for j in range(20)) for k in range(600)):
        sizes.append(len(enc.known))
    assert max(sizes) <= 200 + 16 * 20 * 2 + 10  # and those of one group of texts
