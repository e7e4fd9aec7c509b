"""Tables that workers keep give the same results when they overflow."""

from __future__ import annotations

import random

from riverloom.llm import language, token_files
from riverloom.llm.queries import tokenizer_path


def texts():
    rng = random.Random(0)
    return [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(60)) for _ in range(40)]


def test_pieces(monkeypatch):
    want = [token_files.Encoder(tokenizer_path()).lib.encode(t, add_special_tokens=False).ids for t in texts()]
    monkeypatch.setattr(token_files, "CACHE_PIECES", 100)
    enc = token_files.Encoder(tokenizer_path())
    got = [x.tolist() for t in texts() for x in enc.encode([t])]
    assert got == want and len(enc.known) == len(enc.start) - 1


def test_words(monkeypatch):
    model = language.Model.fit([("abc abd " * 9, "x"), ("ééd ceé " * 9, "y")])
    whole = language.Tagger(model)
    want = [p.tolist() for p, *_ in whole.paths(texts())]
    monkeypatch.setattr(language, "CACHE_WORDS", 50)
    small = language.Tagger(model)
    assert [p.tolist() for t in texts() for p, *_ in small.paths([t])] == want
    assert len(small.known) == len(small.score) == len(small.letters)
