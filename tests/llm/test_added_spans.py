import random
import time

from pyspark.sql import functions as F

from vitalink.llm import pii

from .conftest import prose


def test_wide_phones_are_found_at_the_production_threshold(table):
    texts = [(k, f"{prose(k, 20)} call +1 (212) 555-{k:04d} now {prose(k + 500, 9)}", "en", "a") for k in range(1000, 1060)]
    texts += [(k, f"{prose(k, 20)} phone 212-555-{k:04d} please", "en", "a") for k in range(2000, 2040)]
    found = {r.doc_id: r.found for r in pii.find(table(texts)).collect()}
    assert all(len(found[k]) == 1 and found[k][0].base for k in range(1000, 1060))
    assert all(len(found[k]) == 1 and not found[k][0].base for k in range(2000, 2040))


def test_planted_spans_among_look_alikes(table):
    """Personal data of wide form is added; numbers of the same form in other contexts mostly are not."""
    rng = random.Random(3)
    texts, truth = [], set()
    for k in range(400):
        number = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        if k % 2:
            truth.add(k)
            body = rng.choice([f"phone: {number}, ", f"please call {number} today", f"mobile {number}."])
        else:
            body = rng.choice([f"order {number}x7", f"serial {number}-00", f"invoice version {number}A", f"part no {number}"])
        texts.append((k, f"{prose(k, 20)} {body} {prose(k + 500, 9)}", "en", "a"))
    got = {r.doc_id for r in pii.find(table(texts)).where(F.size("found") > 0).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.1 * len(truth)


def test_traits_move_the_score():
    votes = {(0, (1, 1, 1, 1), (1, 0, 1, 1)): 500, (0, (-1, 0, -1, -1), (0, 0, 0, 0)): 500, (0, (1, 0, 0, 0), (1, 0, 1, 1)): 40, (0, (1, 0, 0, 0), (0, 0, 0, 0)): 40}
    w = pii.train(votes)[0]
    assert len(w) == len(pii.LABELERS) + len(pii.TRAITS) + 1 and w[len(pii.LABELERS)] > 0.1


def test_long_values_take_linear_time(table):
    long = ["a@" + "x" * 100_000 + ".com", "a@" + "x." * 50_000 + "com", "y" * 100_000 + "@b.com", "+" + "1 (" * 30_000 + "2", "1." * 50_000, "1 " * 50_000, "1-" * 50_000, ":a" * 50_000, "(" * 100_000, "[at]" * 25_000]
    docs = table([(k, t, "en", "a") for k, t in enumerate(long)])
    pii.digest(pii.find(table([(0, "a@b.com", "en", "a")]))).collect()
    began = time.time()
    assert pii.digest(pii.find(docs)).count() == len(long)
    assert time.time() - began < 60


def test_unbeaten_equals_all_pairs(spark):
    """The sweep against the plain rule over all pairs, with spans that touch, nest, cross and tie, across blocks."""
    rng = random.Random(11)
    cases = []
    for k in range(40):
        spans = []
        for kind in range(3):  # spans of a kind do not overlap, as matches of a pattern
            at = 0
            for _ in range(rng.choice([0, 1, 3, 30, 700])):
                at += rng.choice([0, 1, 5])
                end = at + rng.choice([1, 2, 4, 40])
                spans.append((kind, at, end, rng.random() < 0.3, rng.choice([0.5, 0.9, 0.95])))
                at = end
        cases.append((k, spans))
    fields = "base boolean, score double"
    rows = spark.createDataFrame(cases, "k int, spans array<struct<kind:int,start:int,end:int,base:boolean,score:double>>")
    got = {r.k: sorted(map(tuple, r.spans)) for r in pii.unbeaten(rows, "spans", fields, lambda a, b: (a["base"] & ~b["base"]) | ((a["base"] == b["base"]) & (a["score"] > b["score"]))).collect()}
    beats = lambda a, b: (a[3] and not b[3]) or (a[3] == b[3] and a[4] > b[4])
    for k, spans in cases:
        want = [c for c in spans if not any(b[1] < c[2] and c[1] < b[2] and beats(b, c) for b in spans)]
        assert got[k] == sorted(want)


def test_many_spans_take_nearly_linear_time(table):
    many = ["a@b.cd 999.1.1.1 " * 60_000, "call 212-555-0100 now " * 45_000, "10.0.0.1,+1 212 555 0100;4111111111111111; " * 24_000]
    docs = table([(k, t, "en", "a") for k, t in enumerate(many)])
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    assert got[0].n_email == 60_000 and got[2].n_ip == got[2].n_phone == got[2].n_card == 24_000
    assert time.time() - began < 60
