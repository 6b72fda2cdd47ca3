"""One-versus-one machines within a family, and the same n-grams in training and prediction."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from vitalink.llm import langid


def test_training_and_prediction_see_the_same_ngrams():
    texts = pa.array(["hi", "", "a", "thé", "the end of it", None, "ab"])
    raw, offsets = langid.lowered(texts)
    rng = np.random.default_rng(0)
    table = rng.normal(size=(langid.DIMENSIONS + 1, 3))
    table[-1] = 0
    got = langid.means(table, langid.grams(raw, offsets), offsets)
    assert np.allclose(got, langid.features(raw, offsets) @ table[:-1], atol=1e-4)
    for k in range(len(texts)):  # the neighbours in a batch change nothing
        alone = langid.means(table, langid.grams(raw[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]])), np.array([0, offsets[k + 1] - offsets[k]]))
        assert np.allclose(got[k], alone[0])


def test_a_machine_for_each_pair_where_one_against_the_rest_fails():
    """Five classes on a line: no plane separates a middle one from all others, pairs do."""
    rng = np.random.default_rng(1)
    centre = {"da": 0.0, "is": 0.25, "nb": 0.5, "nn": 0.75, "sv": 1.0}
    labels = [c for c in centre for _ in range(200)]
    t = np.array([centre[c] for c in labels]) + rng.normal(0, 0.02, len(labels))
    x = np.stack([t, 1 - t], axis=1).astype(np.float32)
    pairs = langid.fit_pairs(x, labels)
    assert len(pairs.pairs) == 10 and pairs.pairs[:2] == [(0, 1), (0, 2)]
    got = pairs.decide(x @ pairs.weights[:-1])[0]
    assert np.mean([pairs.names[k] == c for k, c in zip(got, labels, strict=True)]) > 0.98
    rest = langid.fit(x, labels)
    other = (x @ rest.weights.T + rest.bias).argmax(axis=1)
    assert np.mean([rest.names[k] == c for k, c in zip(other, labels, strict=True)]) < 0.9


def test_ties_go_by_margin_then_name():
    pairs = langid.Pairs(["a", "b", "c"], [(0, 1), (0, 2), (1, 2)], np.zeros((1, 3)), np.zeros(3))
    mean = np.array([[1.0, -2.0, 0.5], [1.0, -1.0, 1.0], [1.0, 1.0, -1.0], [0.0, 0.0, 0.0]])  # two circles, a winner, nothing
    pick, share = pairs.decide(mean)
    assert pick.tolist() == [2, 0, 0, 0] and (share >= 0).all() and (share <= 1).all() and share[3] == 0.5


def test_family_of_four_and_many_labels(table):
    sounds = {"da": "ø ør de hv ag", "nb": "ø ei de hv ak", "sv": "ö ör de va ag", "de": "ö er de wa ch", "fr": "eau ou que é", "xx": "zz q x"}
    texts = []
    for k in range(720):
        lang = list(sounds)[k % 6]
        rng = random.Random(k)
        texts.append((k, " ".join("".join(rng.choices(sounds[lang].split(), k=rng.randint(1, 4))) for _ in range(rng.randint(12, 60))), lang, "a"))
    texts += [(5000 + k, f"{chr(97 + k % 26) * 6} {chr(97 + k // 26) * 9}", f"l{k:03d}", "a") for k in range(260)]  # labels of one text each
    got = {r.doc_id: r for r in langid.held_out_languages(table(texts), per_label=60).collect()}
    held = [k for k in range(720) if got[k].held_out]
    assert sum(got[k].lang_pred == texts[k][2] for k in held) >= 0.95 * len(held)


def _many(labels: int, dimensions: int = langid.DIMENSIONS) -> langid.Hierarchy:
    rng = np.random.default_rng(5)
    names = [f"x{k:03d}" for k in range(labels)]
    table = np.concatenate([rng.normal(size=(dimensions, labels)), np.zeros((1, labels))]).astype(np.float32)
    one = {n: langid.Pairs([n], [], np.zeros((dimensions + 1, 0), np.float32), np.zeros(0)) for n in names}
    return langid.Hierarchy(langid.Linear(names, table[:-1].T, np.zeros(labels, np.float32)), table, one)


def test_long_texts_count_as_whole_ones():
    """Pieces lose and repeat no n-gram, and the prediction is that of the plain form."""
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, langid.PIECE - 1, langid.PIECE, langid.PIECE + 1, langid.PIECE + 2, 2 * langid.PIECE + 1):
        raw = rng.integers(1, 256, size).astype(np.uint8)
        want = np.bincount(langid.grams(raw, np.array([0, size])).ravel(), minlength=langid.DIMENSIONS + 1)
        assert (langid.gram_counts(raw) == want).all()
    x = np.stack([langid.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"der die das und", b"the and of that", b"le la les et des")])
    model = langid.train(np.repeat(x, 4, axis=0), [c for c in ("de", "en", "fr") for _ in range(4)])
    for t in (b"the cat and the dog of that house", b"der Hund und die Katze", b"le chat et la table des rois"):
        raw = np.frombuffer(t * 50_000, np.uint8)
        (language,), (score,) = langid.predict(model, raw, np.array([0, len(raw)]))
        got = langid.predict_long(model, raw)
        assert got[0] == language and abs(got[1] - score) < 1e-3


def test_memory_of_long_texts_and_many_labels_is_bounded():
    raw = np.frombuffer(b"some words of a very long text " * 3_300_000, np.uint8)  # 100 MB
    model = _many(500)
    short = raw[: 1 << 20]
    for run in (lambda: langid.predict_long(model, raw), lambda: langid.predict(model, short, np.arange(0, len(short) + 1, 1 << 10)), lambda: langid.has_letter(raw, np.array([0, len(raw)]))):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 500 << 20


def test_letters_after_the_first_piece():
    raw = np.frombuffer(("12 " * langid.PIECE + "é").encode(), np.uint8)
    assert langid.has_letter(np.concatenate([raw, raw[:-2]]), np.array([0, len(raw), 2 * len(raw) - 2])).tolist() == [True, False]
