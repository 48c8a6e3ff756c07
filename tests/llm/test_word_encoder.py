"""Pieces encoded many at a time have the ids of whole texts."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from tripleweft.llm import queries, wavelet


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_pieces(most):
    plain, coder = Tokenizer.from_file(queries.VOCABULARY), wavelet.Encoder(queries.VOCABULARY, most)
    rng = np.random.default_rng(5)
    parts = ["don't", "x1,", "Word.", "word", "é!?", "Ünï-code", "中文", "\U0001f600", "a\x1fb", "No break", "<|endoftext|>", "<|startoftext|>", "<|", "'", "​", "é", "İ", "12.5%", "...", "﻿", "#*$"]
    texts = ["", None, " \t\n", *parts, *[" ".join(rng.choice(parts, 30)) for _ in range(200)], *["\n".join(rng.choice(parts[:8], 9)) for _ in range(50)]]
    for i in range(0, len(texts), 20):
        got = [x.tolist() for x in coder.encode(texts[i : i + 20])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts[i : i + 20]]


def test_words_of_letters_need_no_special_tokens(monkeypatch):
    """Pieces of letters are encoded between spaces; one that lower-cases to two words takes the plainer way."""
    plain, coder, seen = Tokenizer.from_file(queries.VOCABULARY), wavelet.Encoder(queries.VOCABULARY), []
    ids = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda text: seen.append(text) or ids(text))
    text = "every größe was niño über. été!"
    assert coder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert not any(coder.between in x and any(c.isalpha() for c in x.replace(coder.between, "")) for x in seen)
    for text in ["İstanbul word", "ǅ ʼn ß ﬁ Ⅷ x", "a\u0301 e\u0301 \u0345", "日本語 한국어 ไทย ไม่"]:
        assert coder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_planes_of_wide_and_narrow_ids():
    for top in (1, 2, 255, 49_408, 70_000, 1 << 20):
        ids = np.random.default_rng(top).integers(0, top, 5000).astype(np.uint32)
        assert wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes()).decode().tolist() == ids.tolist()


def test_marks_behind_words(monkeypatch):
    """A word with marks behind it is learnt without them, unless its last letter turns into a letter and a mark, which goes with them."""
    plain, coder, seen = Tokenizer.from_file(queries.VOCABULARY), wavelet.Encoder(queries.VOCABULARY), []
    ids = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda text: seen.append(text) or ids(text))
    texts = ["İ. İ, aİ### क़. क़!!", "word### groß,%%% word$$$ groß", "don't. 'll, 's### a'. a'## x≠ ='."]
    assert [x.tolist() for x in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(x.count("word") for x in seen) == sum(x.count("groß") for x in seen) == 1
