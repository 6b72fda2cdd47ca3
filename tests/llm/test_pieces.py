"""SentencePiece encoding against the library and against merging by the definition."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from vitalink.llm import pieces
from vitalink.llm.queries import PIECES

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("seed", range(6))
def test_cutting_equals_merging_for_any_scores(seed):
    """Random vocabularies with equal scores, unreachable pieces and characters without a piece."""
    rng = random.Random(seed)
    scores = {x: 0.0 for x in "abc"}
    while len(scores) < 40:
        scores["".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6)))] = -float(rng.randrange(12))
    cutter = pieces.Backtracker(scores, most=50)
    for _ in range(600):
        text = "".join(rng.choice("abcd" if rng.random() < 0.9 else "xyz") for _ in range(rng.randrange(40)))
        assert cutter.encode(text) == cutter.remerge(text)


def test_long_units_cross_blocks(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 7)
    cutter = pieces.Backtracker({"a": 0.0, "b": 0.0, "aa": -3.0, "ab": -1.0, "aba": -2.0, "baab": -0.5, "aaaa": -4.0})
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aab") for _ in range(rng.randrange(50)))
        assert cutter.encode(text) == cutter.remerge(text)


def test_texts_equal_the_library():
    encoder, rng = pieces.Encoder(PIECES, most=40), random.Random(2)
    known = [p for p in encoder.ids if len(p) > 1]
    for k in range(1500):
        if k % 3 == 0:
            text = "".join(rng.choice("ab e▁st\n\té\U0001f600漢字 ..__==00--\x00  ") for _ in range(rng.randrange(60)))
        elif k % 3 == 1:
            text = "".join(rng.choice(known) for _ in range(rng.randrange(12))).replace("▁", " ")
        else:
            text = rng.choice(" ax0漢") * rng.randrange(90) + rng.choice(known) * rng.randrange(9)
        want = LIBRARY.encode(text, add_bos=True, add_eos=True)
        got = encoder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert encoder.decode(got) == encoder.decode(got, part=5) == LIBRARY.decode(want)


def test_long_text_takes_linear_time():
    encoder = pieces.Encoder(PIECES)
    for text in ("ab" * 300_000, "漢字x" * 100_000, "word 12 " * 100_000):
        got = encoder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert encoder.decode(got, part=10_000) == text


def test_rows(odd, none):
    got = pieces.encode(odd, PIECES).collect()
    assert len(got) == odd.count() and pieces.encode(none, PIECES).count() == 0
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect())
    want = []
    for null, key, text in texts:
        ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
        want.append((null, key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), LIBRARY.decode(ids)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in got) == sorted(want)


def test_decoding_of_a_column(odd):
    coded = pieces.encode(odd, PIECES)
    again = pieces.decode(coded.select("doc_id", "ids", "decoded"), PIECES)
    assert again.columns == ["doc_id", "ids", "decoded", "text"] and all(r.text == r.decoded for r in again.collect())
