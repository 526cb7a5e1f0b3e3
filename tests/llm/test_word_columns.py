"""The encoder's work on whole columns: one look-up a distinct word, long texts, and cuts that the library makes too."""

import random

import numpy as np

from lodestone.llm.id_files import WordEncoder
from lodestone.llm.token_counts import load


def made() -> WordEncoder:
    return WordEncoder(load("word_bpe_49k.json"), "<u2")


def test_looks_up_each_distinct_word_once():
    looked = 0

    class Counted(dict):
        def get(self, *key):
            nonlocal looked
            looked += 1
            return super().get(*key)

        def __getitem__(self, key):
            nonlocal looked
            looked += 1
            return super().__getitem__(key)

    encoder = made()
    encoder.known = Counted(encoder.known)
    texts = ["one two three four five " * 500] * 4
    assert encoder(texts) == encoder.direct(texts)
    assert looked <= 20


def test_text_longer_than_a_part():
    encoder = made()
    for text in ("abcde fg " * 130_000, "x" * 1_100_000, "ÉÀ, né<b> " * 110_000, "a" * (1 << 20) + " b "):
        assert encoder([text, "z", ""]) == encoder.direct([text, "z", ""])


def test_parts_of_any_length_give_the_library_ids():
    encoder, rng = made(), random.Random(2)
    encoder.PART = 9
    for _ in range(200):
        texts = ["".join(rng.choices("abÀé ,\n", k=rng.randint(0, 60))) for _ in range(3)]
        assert encoder(texts) == encoder.direct(texts)


def test_punctuation_after_latin_letters_makes_no_new_words():
    encoder = made()
    texts = ["né là über", "né, là; über! né. là? über| Né, LÀ; ÜBER!"]
    assert encoder(texts[:1]) == encoder.direct(texts[:1])
    known = len(encoder.known)
    assert encoder(texts) == encoder.direct(texts)
    assert len(encoder.known) <= known + 6  # the marks


def test_odd_strings_with_and_without_the_model():
    rng = random.Random(4)
    letters = [*"abzAZéÉßÿ÷×Ãµªº ' \n\t,.!?;:|*#$%&\")(<>-_0123'sdmlrȩ́ıİΣσς中文 \u0085​😀ẞKǅ", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'ll", " the ", " "]
    model, steps = made(), made()
    steps.by_model = False
    for _ in range(150):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(10)]
        found = model.direct(texts)
        assert model(texts) == steps(texts) == found


def test_end_id_follows_each_text():
    encoder, texts = made(), ["", "a b, c", "", "d"]
    end = np.array([2], dtype="<u2").tobytes()
    got = encoder.coded([t.encode() for t in texts], end).to_pylist()
    assert got == [x + end for x in encoder.direct(texts)]
    assert encoder.coded([], end).to_pylist() == []
    encoder.by_word = False
    assert encoder.coded([t.encode() for t in texts], end).to_pylist() == got
