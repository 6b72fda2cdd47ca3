"""Pair scores as expressions: equal to the comparison of nested persons, for all pairs that they cover."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from vitalink.functions import blend, names
from vitalink.operators import link, score
from vitalink.plans.persons import nested

FIRST = ["jean", "Élise", "marie", "georges", "xavier", "inconnu", "", None, "jean paul"]
LAST = ["dupont", "dupond", "martin", "jean", "sn", None, "de la tour"]
DATES = ["19691101", "19691111", "19700101", "00000000", "19691200", None, "", ">19600101"]


@pytest.fixture(scope="module")
def pairs(spark):
    asked = list(itertools.product(FIRST[:8], LAST[:5], ["M", "F", None], ["19691101", "19700101", None, ">19600101"]))[::3]
    known = list(itertools.product(["jean", "elise", "Marie", "georges"], ["paul henri", "", None, "georges"], LAST[:3] + ["de la tour"], ["M", "F"], DATES[:5]))[::7]
    rows = [(q * 1000 + u, u, *a, *p) for q, a in enumerate(asked[::4]) for u, p in enumerate(known[q % 3 :: 3])]
    schema = "qid long, uid long, first_q string, last_q string, sex_q string, birth_q string, first string, second_name string, last string, sex string, birth_date string"
    place = {"birth_city": "x", "birth_code": "01001", "birth_department": "01", "birth_country": "FRANCE"}
    table = spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in place.items()} | {"lat": F.lit(42.0), "lon": F.lit(1.0), "death_date": F.lit("20000101")})
    return table.where("second_name is not null")


def test_expressions_equal_the_comparison(pairs):
    rows = score.with_plain_scores(score.plain(pairs)).withColumn("a", link.request_json()).withColumn("b", nested()).collect()
    plain = [r for r in rows if r.plain]
    assert 200 < len(plain) < len(rows)
    for r in plain:
        want = blend.compare(json.loads(r.a), json.loads(r.b))
        got = {k: r[f"_{k}"] for k in ("birthDate", "sex", "score") if r[f"_{k}"] is not None}
        assert got == pytest.approx({k: want[k] for k in ("birthDate", "sex", "score") if k in want}), (r, want)
        name = want.get("name")
        assert (r._name is None) == (name is None) and (name is None or (r._name, r._name_first, r._name_last) == pytest.approx((name["score"], name["first"], name["last"])))
        assert r._n_parts == sum(k in want for k in score._PARTS)


def test_other_pairs_go_to_the_function(pairs):
    got = {(r.qid, r.uid): r for r in link.scored_pairs(pairs, nested()).collect()}
    flagged = score.plain(pairs).withColumn("a", link.request_json()).withColumn("b", nested()).where("not plain").collect()
    assert len(got) == pairs.count() and len(flagged) > 50
    for r in flagged[::5]:
        assert got[r.qid, r.uid].score == pytest.approx(blend.compare(json.loads(r.a), json.loads(r.b))["score"])


def test_pairs_that_cannot_be_compared_lose(spark):
    rows = spark.createDataFrame([("a", "{\"name\": {\"first\": \"x\", \"last\": 5}}"), ("b", None)], "k string, j string")
    got = {r.k: r.s for r in rows.select("k", score.pair_scores()(F.lit('{"name": {"first": "x", "last": "y"}}'), F.col("j")).alias("s")).collect()}
    assert got["a"].score is None and got["a"].explain.startswith("failed") and got["b"].score is None
    few = spark.createDataFrame([(1, 1, 5.0, None, None, "M"), (1, 2, 2.0, 0.79, 1.0, "M")], "qid long, uid long, rank double, score double, name double, sex_b string")
    assert [(r.uid, r.final) for r in score.candidate_set(few).collect()] == [(2, 0.79)]


def test_readings_of_names():
    assert names.token_score("marie", ["anne", "marie", "marie"]) == 0.7 and names.token_score(["a", "b"], ["a", "b"]) == 1
    assert names.token_score("", "x") == names.BLIND_TOKEN
    assert names.score("jean", "dupont dit le grand", "jean", "dupont")["particle"] == 0.8
    assert names.score(["jean", "paul"], "tour de france", ["jean", "paul"], "france tour").get("fuzz") is not None


def test_countries_joined():
    from vitalink.functions.places import country_score

    assert country_score("grande bretagne", ["pays de galles", "royaume uni"]) == 1
    assert country_score("republique du congo", ["congo", "republique"]) == 1 and country_score(["viet nam", "du sud"], "vietnam sud") == 1
    assert country_score("france", []) == 0 and country_score(["france"], ["italie"]) < 0.5
