"""Words and shingles against a plain version."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheet.llm import words as w

LETTERS = st.text(alphabet="aAbÉé \t\n\x0b\x0c\r\x1c", max_size=40)


def plain(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=6))
def test_words_and_shingles_match_a_plain_version(texts):
    column = pa.array(texts, pa.string())
    found = w.words(column)
    want = [plain(t) for t in texts]
    assert np.diff(found.first).tolist() == [len(x) for x in want]
    code = {}
    for word, value in zip((x for row in want for x in row), found.hashes.tolist()):
        assert code.setdefault(word, value) == value
    assert len(set(code.values())) == len(code)
    seen = {}
    for row, got in zip(want, w.shingle_sets(column, 3)):
        grams = {tuple(row[i : i + 3]) for i in range(len(row) - 2)} if len(row) >= 3 else ({tuple(row)} if row else set())
        assert len(got) == len(grams)
        assert seen.setdefault(frozenset(grams), got.tobytes()) == got.tobytes()


def test_a_text_in_pieces_has_the_same_words(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(5000)) + " " + "x" * 300
    whole = w.words(pa.array([text, text])).hashes
    monkeypatch.setattr(w, "PIECE", 64)
    assert (w.words(pa.array([text, text])).hashes == whole).all()


def test_sliced_and_null_columns():
    column = pa.array(["a b", None, "", "c d e", "f"]).slice(1, 3)
    assert np.diff(w.words(column).first).tolist() == [0, 0, 3]


def test_place_in_a_long_word_counts():
    a, b = "a" * 64 + "b", "b" + "a" * 64
    assert len(set(w.words(pa.array([f"{a} {b}"])).hashes.tolist())) == 2


def test_letters_and_digits_are_separate_words():
    found = w.words(pa.array(["5kg x-ray 3.5"]), w.letter_classes())
    assert len(found.hashes) == 6
