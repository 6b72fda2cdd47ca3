"""Maximal repeats, rows without id, and many ranges."""

import numpy as np
import pytest

from vitalink.llm import substring

from .conftest import prose


def brute(texts, window=20):
    """[start, end) ranges of the removed words of each document; documents in their order."""
    seen, out = set(), []
    for t in texts:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.array(gone, int), [0]])))
        out.append(edge.reshape(-1, 2).tolist())
    return out


@pytest.mark.parametrize("chunk_bytes", [300, 1500, 4 << 20])
def test_runs_are_the_maximal_repeats(table, chunk_bytes):
    passage, other = prose(1, 90), prose(2, 55)
    texts = [f"{prose(10 + k, 7 * k)} {passage if k % 2 else other} {prose(50 + k, 15)} {other if k % 3 == 0 else ''} {' '.join(passage.split()[k : k + 30])}" for k in range(24)]
    got = substring.repeats(table([(k, t, "en", "a") for k, t in enumerate(texts)]), chunk_bytes=chunk_bytes).orderBy("doc_id").collect()
    assert [r.removed for r in got] == brute(texts)
    assert [r.kept.split() for r in got] == [[w for k, w in enumerate(t.split()) if not any(i <= k < j for i, j in r.removed)] for t, r in zip(texts, got, strict=True)]


def test_rows_without_id_come_last_and_spread(table, spark):
    passage = prose(3, 60)
    texts = [(None, f"{prose(k, 20)} {passage} {prose(k + 70, 9)}", "en", "a") for k in range(40)] + [(5, passage, "en", "a")]
    got = substring.repeats(table(texts), chunk_bytes=2000).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].n_removed == 0 and all(r.n_removed >= 60 for r in got if r.doc_id is None) and len(got) == 41
    alone = substring.repeats(table(texts[:40]), chunk_bytes=2000).collect()
    assert sum(r.n_removed == 0 for r in alone) == 1  # the first by the hash of its text keeps the passage


@pytest.mark.parametrize("n", [1, 5, 65_536, 70_000, 1 << 18])
def test_packed_ranges(n):
    rng = np.random.default_rng(n)
    ranges = substring.Ranges(n)
    prefix = np.sort(rng.integers(0, 1 << ranges.bits, 500).astype(np.uint64))
    low = rng.integers(0, 1 << 32, 500).astype("<u4")
    found = [ranges.unpack(data, r, ["<u4"]) for r, data in ranges.pack(prefix, [low])]
    assert np.concatenate([x[0] for x in found]).tolist() == prefix.tolist() and np.concatenate([x[1] for x in found]).tolist() == low.tolist()
