"""Collocations against counting by the definition; perfect hashes; sums along the tree."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vitalink.llm import collocations
from vitalink.llm.collocations import Miner
from vitalink.llm.perfect_hash import PerfectHash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, longest, top, share):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= share * f[lang, w[i : i + m]]:
                    hidden.add((lang, w[i : i + m]))
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) not in hidden:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "\U0001f600", "a b", "Zed", "x\x00y"]
    out = []
    for k in range(n):
        part = []
        for _ in range(rng.randrange(60)):
            part.append(rng.choice(words) if rng.random() < 0.8 else "alpha Beta gamma")
            part.append(rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " \x0c"]))
        out.append((rng.choice(["en", "en", "en", "und", None, "a\nb", ""]), "".join(part)))
    return [*out, (None, None), ("en", ""), ("en", " ,.; "), *[("en", "same same same same same same")] * 5, *out[:3]]


@pytest.mark.parametrize(("least", "load", "shard_keys", "share", "top"), [(3, 1, 16, 100, 2000), (8, 4, 1000, 60, 7), (2, 1, 5, 100, 2000)])
def test_phrases_match_brute_force(spark, least, load, shard_keys, share, top):
    rows = texts(least, 60)
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "lang string, text string, id string, f int").repartition(5)
    got = collocations.collocations(docs, top=top, share=share, miner=Miner(least, 5, load, shard_keys))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, 5, top, share)


def test_nothing_to_count(none, table):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(table([(1, None, None, None), (2, "one two", "en", "a")])).count() == 0


@pytest.mark.parametrize("most", [3, 10, 64])
def test_chunks_of_long_texts_are_whole_pieces(most):
    """However small the chunks, words and pieces come out as from the whole text."""
    values = ["one two three four. Five six", "", None, "no end here at all in this text", "a,b;c", "x" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array([None] * 6, pa.string()), pa.array(values)], names=["lang", "text"])
    whole = [(w, int(t), bool(f)) for ws, ts, fs in collocations.chunks(batch) for w, t, f in zip(ws.to_pylist(), ts, fs, strict=True)]
    cut = [(w, int(t), bool(f)) for ws, ts, fs in collocations.chunks(batch, most) for w, t, f in zip(ws.to_pylist(), ts, fs, strict=True)]
    assert cut == whole and len(whole) == 18


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_slots_are_a_bijection(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    made = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    assert (made.slots(np.arange(1000, dtype=np.uint64)) < max(1, len(keys))).all()


def test_foreign_keys_and_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "hashes", lambda keys: np.array([len(k) for k in keys.to_pylist()], np.uint64))
    keys = pa.array(["a", "bb", "b", "ccc", "dd"])
    data, order = collocations.Shard.order(keys)
    shard = collocations.Shard(data, keys.take(pa.array(order)))
    asked = pa.array(["dd", "b", "x", "ccc", "a", "bb", "yyyy"])
    slots = shard.slots(asked, collocations.hashes(asked))
    assert [None if k < 0 else shard.keys[k].as_py() for k in slots.tolist()] == ["dd", "b", None, "ccc", "a", "bb", None]


def test_tree_sum(spark):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 4000, 900) for _ in range(40)]
    rows = [r for k, x in enumerate(parts) for r in collocations._counted(np.concatenate([x, np.full(300, 7)]), 10, k)]
    got = collocations.tree_sum(spark.createDataFrame(rows, collocations._PARTIAL), 1 << 10, 40).collect()
    total = np.bincount(np.concatenate([*parts, np.full(40 * 300, 7)]), minlength=4096)
    assert len(got) == 4
    for r in got:
        found = np.zeros(1024, np.int64)
        found[np.frombuffer(r.slots, "<u4")] = np.frombuffer(r.counts, "<i8" if r.wide else "u1")
        assert (found == total[r["at"] * 1024 : r["at"] * 1024 + 1024]).all()
