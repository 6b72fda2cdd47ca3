"""Product codes against plain Lloyd rounds."""

import math
import random

import numpy as np
import pytest

from vitalink.llm import vector_codes
from vitalink.llm.vector_codes import Coder


def plain(rows, parts, entries, rounds, scale):
    """{id: (code, error)} and codebooks, by the definition."""
    kept = [(k, v) for k, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(((k, [math.floor(scale * x) for x in v]) for k, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for _, v in kept] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(x, books[p])[1] for x in cut[p]]
            for e in range(len(books[p])):
                mine = [x for x, k in zip(cut[p], own, strict=True) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    return [(k, [c for _, c in f], sum(d for d, _ in f)) for (k, _), f in zip(kept, found, strict=True)], books


def rows_of(n, dim, seed, spread):
    rng = random.Random(seed)
    return [(k, [rng.choice([-1, 1]) * rng.randrange(spread) / 4096 + rng.choice([0.0, 0.25, 1.5]) for _ in range(dim)], rng.choice([None, 1, 2, 3])) for k in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string"


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize(("n", "dim", "parts", "spread", "groups"), [(300, 16, 8, 3, 4), (500, 8, 4, 2000, 4), (9, 8, 8, 5, 4), (400, 4, 2, 40, 1), (200, 6, 3, 2, 16)])
def test_rounds_match_plain_lloyd(make, n, dim, parts, spread, groups):
    """Few different values make ties, also of whole vectors; with 9 rows the codebooks stay small."""
    rows = rows_of(n, dim, n, spread)
    want, books = plain(rows, parts, 16, 6, 4096)
    coded, got_books = Coder(parts=parts, groups=groups, block=64).fit_codes(make(rows))
    assert [b.tolist() for b in got_books] == books
    assert sorted((r.vec_id, list(r.code), r.error) for r in coded.collect()) == want


def test_awkward_rows(make):
    rows = rows_of(60, 8, 1, 50)
    rows += [(3, list(rows[5][1]), 1), (3, list(rows[5][1]), 1), (None, list(rows[7][1]), None), (61, None, 2), (62, [1.0] * 7 + [None], 2), (63, [math.inf] * 8, 2), (64, [math.nan] + [0.0] * 7, 1), (-5, [-0.0001] * 8, 3)]
    want, books = plain(rows, 8, 16, 6, 4096)
    coded, got_books = Coder(block=16).fit_codes(make(rows))
    assert [b.tolist() for b in got_books] == books
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, list(r.code), r.error) for r in coded.collect()), key=key) == sorted(want, key=key)
    sums = {}
    for r in coded.collect():
        sums[r.label] = sums.get(r.label, 0) + r.error
    for most_hot in (1, 4, 2000):  # all joined by a shuffle, some of both, all broadcast
        out = vector_codes.label_errors(coded, most_hot).collect()
        assert len(out) == coded.count() and all(r.label_error == sums[r.label] for r in out)


def test_no_rows_and_refusals(make):
    coded, books = Coder().fit_codes(make([]))
    assert coded.count() == 0 and books == [] and vector_codes.label_errors(coded).count() == 0
    assert Coder().fit_codes(make([(1, None, 1)]))[0].count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        Coder().fit_codes(make([(1, [1.0] * 9, 1)]))
    with pytest.raises(ValueError, match="64 bits"):
        Coder().fit_codes(make([(1, [1e30] * 8, 1)]))
    with pytest.raises(Exception, match="has not 8 components"):
        Coder().fit_codes(make([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]))


def test_bounds_save_scans_and_lose_nothing():
    """Over the rounds the bounds must leave the exact assignment and spare most distances of settled clusters."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-5000, 5000, (16, 8))
    x = centres[rng.integers(0, 16, 6000)] + rng.integers(-300, 300, (6000, 8))
    book = x[:16].copy()
    group = vector_codes.cluster_entries(book, 4)
    own = bounds = drift = None
    scanned = []
    for _ in range(12):
        own, least, bounds, n = vector_codes.assign(x, book, group, own, bounds, drift)
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (own == every.argmin(1)).all() and (least == every.min(1)).all()
        for g in range(4):
            for e in np.flatnonzero(group == g):
                others = own != e
                assert (bounds[others, g].astype(float) <= np.sqrt(every[others, e])).all()
        scanned.append(n)
        after = np.stack([x[own == e].sum(0) // max(1, (own == e).sum()) if (own == e).any() else book[e] for e in range(16)])
        drift, book = np.sqrt(((after - book) ** 2).sum(1)), after
    assert scanned[0] == 6000 * 16 and scanned[-1] < scanned[0] / 4
