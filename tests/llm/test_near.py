import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from vitalink.llm import simhash
from vitalink.llm.components import connected_components

from .conftest import awkward, prose


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_near_duplicates_match_brute_force(odd):
    got = simhash.near_duplicates(odd).collect()
    texts = awkward()
    fps = [brute_fingerprint(t) for _, t, _, _ in texts]
    roots = brute_components(fps)
    least = defaultdict(list)
    for (i, *_), r in zip(texts, roots, strict=True):
        if i is not None:
            least[r].append(i)
    want = sorted((str(i), f"{f:016x}", min(least[r], default=None)) for (i, *_), f, r in zip(texts, fps, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_links_of_crowded_values(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(1, 64, 7)}  # a crowd
    for _ in range(60):  # chains
        x = rng.choice(sorted(fps))
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for groups, most in ((3, 64), (3, 4), (2, 8), (1, 10_000)):
        pairs = [(r.a, r.b) for r in simhash.links(table, 2, groups, most=most).collect()]
        where = {x: k for k, x in enumerate(signed)}
        up = list(range(len(fps)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            x, y = root(where[a]), root(where[b])
            up[max(x, y)] = min(x, y)
        assert [root(i) for i in range(len(fps))] == brute_components(fps), (groups, most)


def test_allocation_spends_the_whole_budget():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    groups = [list(range(k, 64, 3)) for k in range(3)]
    sketch = rng.integers(0, 50, (3, 128))
    t = simhash.allocate(fp, groups, sketch, 2)
    assert (t.sum(axis=0) == 2 - 3 + 1).all() and t.min() >= -1


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(None, 3), (4, 4), (2, 1), (1, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 161)} | {k: 5 for k in range(5, 60)} | {1: 1, 2: 1}
    assert got == want
