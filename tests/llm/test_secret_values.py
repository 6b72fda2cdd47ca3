import itertools
import math
import random
import time

import pytest

from vitalink.llm import secret_scan

from .conftest import prose


@pytest.mark.parametrize("text", ["passphrase: kQz!xWp#LmRtYvB", "pwd: hGtRqXzPmKvBnLwY", "the password is xqzvkwjhpfgtrmbd", "my password is Zq-XvLp.MwRtYnHk"])
def test_values_of_any_characters_are_costed(text):
    assert [k for k, _, _ in secret_scan.spans(text)] == ["guess"]


@pytest.mark.parametrize("text", ["secret understanding of things", "token authentication", "password: PasswordManagement", "the secret is international", "pwd: aaaaaaaaaaaaaaaaaaaa"])
def test_words_are_no_secrets(text):
    assert all(k != "guess" for k, _, _ in secret_scan.spans(text))


@pytest.mark.parametrize("piece", ["ab1", "xy1", "qwertyui", "a"])
def test_a_long_repeat_is_costed_whole(piece):
    value = piece * 400
    cost, parts = secret_scan.guess_cost(value)
    assert cost < 14 and len(parts) <= 3
    assert "guess" not in [k for k, _, _ in secret_scan.spans(f"password is {value}")]


def every_cut(value):
    """The least cost over all segmentations, one by one, from the cost of each segment by itself."""
    ranks, more, low = secret_scan.ranks(), math.log10(2), value.lower()
    each, plain, n = math.log10(secret_scan._alphabet(value)), low.translate(secret_scan._LEET), len(value)

    def piece(i, j):
        out = [(j - i) * each]
        if 3 <= j - i <= 40 and (rank := ranks.get(low[i:j]) or ranks.get(plain[i:j])) is not None:
            out.append(math.log10(rank + 1) + ((value[i:j] != low[i:j]) + (low[i:j] not in ranks)) * more)
        if (m := secret_scan._DATE.match(value, i)) is not None and m.end() == j:
            out.append(math.log10(200 if j - i == 4 else 365 * 120))
        if 3 <= j - i <= 40 and all(secret_scan._next(a, b) for a, b in itertools.pairwise(low[i:j])):
            out.append(math.log10(188) + math.log10(j - i))
        for size in (1, 2, 3, 4, 6, 8):
            times = (j - i) // size
            if times >= 2 and times * size == j - i >= 3 and value[i:j] == value[i : i + size] * times and value[j : j + size] != value[i : i + size]:
                out.append(size * each + math.log10(times))
        return min(out)

    best = math.inf
    for cuts in range(2 ** (n - 1)):
        edge = [0, *(k + 1 for k in range(n - 1) if cuts >> k & 1), n]
        best = min(best, sum(piece(i, j) for i, j in itertools.pairwise(edge)) + more * (len(edge) - 2))
    return best


def test_cost_is_the_least_over_all_segmentations():
    rng = random.Random(5)
    parts = ["pass", "key", "2024", "aa", "qwe", "x9", "Z", "abab", "th1s", "love", "7", "!"]
    for _ in range(120):
        value = "".join(rng.choice(parts) for _ in range(4))[:11]
        assert secret_scan.guess_cost(value)[0] == pytest.approx(every_cut(value)), value


def test_the_early_end_changes_no_verdict():
    rng = random.Random(6)
    for k in range(300):
        value = "".join(rng.choice(["pass", "qwerty", "aaaa", "2024", "xK", "9", "!", "secret", "zq", "ab1ab1"]) for _ in range(rng.randint(2, 9)))
        least = rng.uniform(3, 20)
        assert (secret_scan.guess_cost(value, least)[0] >= least) == (secret_scan.guess_cost(value)[0] >= least), (k, value)


def test_time_grows_with_the_length():
    rng = random.Random(7)
    for value in ("a1" * 50_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100_000)), "asdf" * 25_000, "a" * 100_000):
        began = time.time()
        secret_scan.spans(f"password is {value}")
        assert time.time() - began < 20


def test_planted_secrets_are_added_and_prose_is_not(table):
    rng = random.Random(8)
    texts = [(k, f"{prose(k, 30)} the password is {''.join(rng.choices('abcdefghjkmnpqrstuvwxyzABCDEFGH23456789!#', k=14))} {prose(k + 300, 9)}", "en", "a") for k in range(60)]
    texts += [(100 + k, f"{prose(k, 30)} the secret is {w} {prose(k + 300, 9)}", "en", "a") for k, w in enumerate(["marketing", "everything", "password123", "qwertyuiop", "20240131", "sunshine2024"] * 5)]
    found = {r.doc_id: [x.kind for x in r.found] for r in secret_scan.scan(table(texts)).collect()}
    assert sum(found[k] == ["guess"] for k in range(60)) == 60 and all(found[100 + k] == [] for k in range(30))
