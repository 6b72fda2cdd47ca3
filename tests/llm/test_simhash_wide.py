"""Near-copies of the pipeline: brute force over all pairs, recall against exact similarity, crowds cut into blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vitalink.llm import simhash_wide as wide

from .conftest import awkward, prose


def edited(base, n, rng):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def shingles(text):
    w = (text or "").split()
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def roots_of(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(n)]


def brute_kept(texts):
    """(is null, id) of the first row of each component of the near-copies, all pairs compared one by one."""
    w, n = wide.wide_prints(pa.array([t for _, t in texts], pa.string()))
    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            apart = [(int(w[i, k]) ^ int(w[j, k])).bit_count() for k in range(3)]
            common = np.cos(np.pi * sum(apart) / 192) * (n[i] * n[j]) ** 0.5
            same = tuple(w[i]) == tuple(w[j]) and n[i] == n[j]
            if same or (max(n[i], n[j]) > 4 and min(apart) <= 8 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and common / (n[i] + n[j] - common) >= 0.8):
                pairs.append((i, j))
    ids = {}
    for r, (i, _) in zip(roots_of(len(texts), pairs), texts, strict=True):
        ids.setdefault(r, []).append((i is None, i or 0))
    return sorted(map(min, ids.values()))


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(6)
    texts = [(k, prose(k, 60)) for k in range(1000, 1040)]
    for base in range(12):
        w = prose(base, 150).split()
        texts += [(2000 + 10 * base + k, edited(w, k, rng)) for k in range(7)]
    crowd = prose(77, 146).split()  # many copies, half of their pairs below the similarity
    texts += [(5000 + k, edited(crowd, 1 + k % 7, rng)) for k in range(150)]
    line = prose(78, 40)
    texts += [(7000 + k, f"{line} {prose(k, 14)}") for k in range(60)]  # a common passage, not copies
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("most", [8, 40, 1 << 14])
def test_groups_match_all_pairs(table, copies, most):
    kept = wide.keep_one(table([(i, t, "en", "a") for i, t in copies]), most=most)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == brute_kept(copies)


def test_fingerprint_bits():
    text = prose(3, 400)
    w, n = wide.wide_prints(pa.array([text, None, "one two", " "], pa.string()))
    assert n.tolist() == [len(shingles(text)), 0, 1, 0] and w[1].tolist() == w[3].tolist() == [0, 0, 0]
    raw = np.frombuffer(text.encode(), np.uint8)
    value, _ = wide.shingle_sets(raw, np.array([0, len(raw)]))
    ones = [sum(int(v) >> b & 1 for v in wide.mix(value).tolist()) for b in range(64)]
    assert int(w[0, 0]) == sum(1 << b for b in range(64) if 2 * ones[b] > len(value))


def test_recall_against_exact_similarity():
    """Of the rows that exact similarity 0.8 puts in a group with another, 0.9 or more are linked as well."""
    rng, texts = random.Random(9), []
    for base in range(120):
        w = prose(300 + base, rng.randrange(80, 500)).split()
        texts += [edited(w, rng.randrange(0, max(2, len(w) // 45)), rng) for _ in range(4)]
    sets = [shingles(t.lower()) for t in texts]
    w, n = wide.wide_prints(pa.array(texts))
    exact, found = [], []
    for i in range(len(texts)):
        for j in range(i):
            if i // 4 == j // 4:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    exact.append((i, j))
                if sets[i] == sets[j] or wide.near(w, n, np.array([i]), np.array([j]), 8, 0.8)[0]:
                    found.append((i, j))
    gone = lambda pairs: {k for k, r in enumerate(roots_of(len(texts), pairs)) if r != k}
    assert len(gone(exact) & gone(found)) >= 0.9 * len(gone(exact)) > 100
    far = rng.sample(range(len(texts)), 200)
    apart = [(i, j) for i in far for j in far if i // 4 != j // 4]
    assert not wide.near(w, n, *map(np.array, zip(*apart, strict=True)), 8, 0.8).any()


def test_near_copies_leave_the_pipeline(table):
    import corpus_pipeline

    base = prose(9, 300).split()
    docs = table([(1, " ".join(base), "en", "a"), (2, edited(base, 4, random.Random(1)), "en", "a"), (3, prose(10, 300), "en", "a")])
    kept = corpus_pipeline.near_dedup(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3]


def test_awkward_rows(odd, none):
    texts = [(i, t) for i, t, _, _ in awkward()]
    kept = wide.keep_one(odd).select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == brute_kept(texts)
    assert wide.keep_one(none).count() == 0


def test_mix_stage_takes_rows_as_often_as_the_mix(table):
    import corpus_pipeline

    from vitalink.llm import mixing

    texts = [(k // 2 if k % 7 else None, prose(k // 3, 20 + k // 3), "en", f"s{k % 4}" if k % 5 else None) for k in range(90)]
    texts += [texts[3], texts[3], (None, "equal size here", "en", "s1"), (None, "equal size too", "en", "s1"), (7, None, "en", "s2")]
    docs = table(texts)
    for extra in (docs, docs.withColumnRenamed("size", "_time").withColumnRenamed("rank", "row")):
        times = mixing.mix(extra).selectExpr("sum(times) t", "sum(taken) w").first()
        rows = corpus_pipeline.source_mix(extra.sparkSession, extra, "")
        assert rows.columns == extra.columns
        got = rows.select("text").collect()
        assert len(got) == times.t and sum(len(r.text.split()) for r in got) == times.w
