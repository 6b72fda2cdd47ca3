"""Text, date, name and place functions: goldens, laws, and expressions against plain functions."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalink.functions import dates, names, places, text
from vitalink.functions.blend import Params, compare, person_from_request, reduce_scores
from vitalink.operators.score import compare_one

WORDS = ["", "georges", "pompidou", "pompidous", "marie", "martin", "martine", "dupond", "dupont", "jean", "jeanne", "le", "xavier", "wurtz", "hennequin"]
DATES = ["19691101", "19691110", "19961101", "19690000", "00001101", "19700101", "19690101", "00000000", "19691331", "19691001", "20010228", ""]


def test_normalize_and_its_expression(spark):
    values = ["Élodie-Anne  O'Connor", "  ", None, "ÇA ñ ß 12", "naïve²", "Łódź", "ＡＢＣ", "x\ty\nz", "İstanbul"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.normalized(F.col("v")).alias("n")).collect()
    assert [r.n for r in rows] == [text.normalize(r.v) for r in rows]
    assert text.normalize("Élodie-Anne  O'Connor") == "elodie anne o connor" and text.normalize(None) == ""


@given(st.floats(0, 2, allow_nan=False))
@settings(max_examples=200, deadline=None)
def test_rounding_is_to_two_places(x):
    assert abs(text.to_fixed(x) - x) <= 0.005 + 1e-12


def test_rounding_expression(spark):
    values = [k / 1000 for k in range(0, 2000, 5)] + [1.005, 0.125, 0.375, 1.115, 0.575]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", text.round2(F.col("v")).alias("r")).collect()
    assert [r.r for r in rows] == [text.to_fixed(r.v) for r in rows]


def test_replace_first(spark):
    row = spark.createDataFrame([("de la de la rue",)], "v string").select(text.replace_first(F.col("v"), "de la ", "").alias("r")).first()
    assert row.r == "de la rue"


@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
@settings(max_examples=200, deadline=None)
def test_edit_distances(a, b):
    d, t = text.levenshtein(a, b), text.damerau(a, b)
    assert t <= d <= 2 * t and d == text.levenshtein(b, a) and t == text.damerau(b, a) and (d == 0) == (a == b)


def test_damerau_of_dates_as_expression(spark):
    pairs = [(a, b) for a in DATES if a for b in DATES if b]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.damerau_short(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == text.damerau(r.a, r.b) for r in rows)


def test_rounding_expression_next_to_halves(spark):
    near = [v for k in range(1, 101) for v in ((2 * k - 1) / 200, math.nextafter((2 * k - 1) / 200, 0), math.nextafter((2 * k - 1) / 200, 2), k / 100)]
    rows = spark.createDataFrame([(v,) for v in [0.0, -0.125, -0.25, -1.004, 1234.567, *near]], "v double").select("v", text.round2(F.col("v")).alias("r")).collect()
    assert [r.r for r in rows[5:]] == [text.to_fixed(r.v) for r in rows[5:]] and [r.r for r in rows[:5]] == [0.0, -0.12, -0.25, -1.0, 1234.57]


def test_two_swaps_equal_the_least_of_all_copies(spark):
    def copies(s, n):
        swaps = [(k,) for k in range(n - 1)] + [(k, j) for k in range(n - 1) for j in range(k + 2, n - 1)]
        for at in [(), *swaps]:
            c = list(s)
            for k in at:
                c[k : k + 2] = c[k : k + 2][::-1]
            yield len(at), "".join(c)

    draw = random.Random(3)
    word = lambda: "".join(draw.choices("0123"[: draw.randint(2, 4)], k=draw.choice([0, 3, 4, 7, 8, 8, 8, 8])))
    pairs = [(word(), word()) for _ in range(1500)]
    pairs += [(a, "".join(draw.sample(a, len(a)))) for a, _ in pairs[:500]]
    rows = spark.createDataFrame([*pairs, (None, "1"), ("1", None)], "a string, b string").select("a", "b", text.damerau_short(F.col("a"), F.col("b")).alias("d"), dates._ratio8(F.col("a"), F.col("b"), 5, 4).alias("r")).collect()
    assert [r.d for r in rows] == [min(n + text.levenshtein(c, b) for n, c in copies(a, 8)) for a, b in pairs] + [None, None]
    tails = [(a[4:8], b[4:8]) for a, b in pairs]
    assert [r.r for r in rows[: len(pairs)]] == [1.0 if a == b else text.to_fixed(1 - min(n + text.levenshtein(c, b) for n, c in copies(a, 4)) / max(len(a), len(b))) for a, b in tails]


def test_distances_of_dates_cut_each_copy_once(spark):
    assert str(text.damerau_short(F.col("a"), F.col("b"))).count("substring") < 200  # 328 before


def test_soundex(spark):
    assert text.soundex_fr("pompidou") == text.soundex_fr("pompidous") and text.soundex_fr("martin") != text.soundex_fr("dupond") and text.soundex_fr("") == ""
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", text.soundex_fr_column(F.col("w")).alias("s")).collect()
    assert [r.s for r in rows] == [text.soundex_fr(r.w) for r in rows]


def test_token_ratios():
    assert text.token_set_ratio("fuzzy was a bear", "a fuzzy bear fuzzy was") == 1
    assert text.token_sort_ratio("jean martin", "martin jean") == 1 and text.token_set_ratio("", "a") == 0
    assert 0 < text.token_sort_ratio("jean martin", "jean martine") < 1


@pytest.mark.parametrize(("value", "source", "target", "want"), [
    ("01/11/1969", "dd/MM/yyyy", "yyyyMMdd", "19691101"), ("1969-11-01", "YYYY-MM-DD", "yyyyMMdd", "19691101"), ("11/1969", "MM/YYYY", "yyyyMMdd", "19691100"),
    ("", "dd/MM/yyyy", "yyyyMMdd", ""), ("19691101", "yyyyMMdd", "dd/MM/yyyy", "01/11/1969"),
])
def test_reformat(spark, value, source, target, want):
    assert dates.reformat(value, source, target) == want
    assert spark.createDataFrame([(value,)], "v string").select(dates.reformatted(F.col("v"), source, target).alias("r")).first().r == want


def test_date_scores(spark):
    assert dates.score("19691101", "19691101") == 1 and dates.score("", "19691101") == dates.score("19691101", "00000000") == dates.BLIND
    assert dates.score("01/11/1969", "19691101") == 1 and dates.score("01/11/1969", "01/11/1969", "dd/MM/yyyy", "dd/MM/yyyy") == 1
    inside, outside = dates.score("1960-1970", "19691101"), dates.score("1950-1960", "19691101")
    assert inside == round(0.95**2.5, 2) and outside == round(0.2**2.5, 2)
    assert dates.score(">19600101", "19691101") == inside and dates.score("<19600101", "19691101") == outside
    pairs = [(a, b) for a in DATES for b in DATES if not a.startswith("0000") and a != "19690000"]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", dates.score_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r.s - dates.score(r.a, r.b)) < 1e-9 for r in rows), [(r, dates.score(r.a, r.b)) for r in rows if abs(r.s - dates.score(r.a, r.b)) > 1e-9][:5]


def test_french_dates(spark):
    row = spark.createDataFrame([("01/11/1969-02/12/1970",)], "v string").select(dates.from_french_column(F.col("v")).alias("r"), dates.to_french(F.lit("19691101")).alias("f")).first()
    assert row.r == dates.from_french("01/11/1969-02/12/1970") == "19691101-02/12/1970" and row.f == "01/11/1969"


def test_name_scores(spark):
    assert names.score("georges", "pompidous", "Georges", "Pompidou")["score"] == 0.9
    assert names.score(None, None, "a", "b") == names.BLIND
    assert names.score("jean", "martin", "jean", "martin") == {"first": 1.0, "last": 1.0, "score": 1.0}
    assert names.score("martin", "jean", "jean", "martin")["score"] == 0.7
    assert names.score("jeanne", ["michou", "marie"], "jeanne", "marie", "F")["last"] > 0.65
    assert names.score("jean", "de la tour", "jean", "tour").get("particle") == 0.8
    assert names.token_score(["a", "b"], ["a", "b"]) == 1 and names.token_score("", "a") == names.BLIND_TOKEN
    assert names.sex_mismatch("martin", "martine") and not names.sex_mismatch("jean", "paul")
    pairs = [(a, b) for a in WORDS if a for b in WORDS if b]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", names.alike_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r.s == names.alike(r.a, r.b) for r in rows)


def test_sex_scores(spark):
    values = [("H", "M"), ("M", "M"), ("F", "M"), (None, "M"), ("F", None), ("", "F")]
    rows = spark.createDataFrame(values, "a string, b string").select("a", "b", names.sex_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in rows] == [1, 1, 0.5, 0.99, 0.99, 0.99] == [names.sex(r.a, r.b) for r in rows]


CODES = ["75056", "1234", "01234", "91352", "93352", "99352", "98001", "99001", "92001", "75101", "2A004"]


def test_code_scores(spark):
    rows = spark.createDataFrame([(a, b) for a in CODES for b in CODES], "a string, b string").select("a", "b", places.code_score_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r.s == places.code_score(r.a, r.b) for r in rows)
    assert places.code_score("1234", ["x", "01234"]) == 1 and places.code_score("98001", "99001") == 0.75 and places.code_score("75056", "75101") == 0.87


def test_places():
    assert places.department_score("2A", "20", None) == 1 and places.department_score("075", "75", None) == 1 and places.department_score("99", "75", None) is None
    assert places.department_score("75", "92", None) == 0.93 and places.department_score("75", "92", False) == 0.7 and places.department_score("75", "92", True) == 1
    assert places.city_score("Paris 12", "PARIS") == 1 and places.city_score("Ste Clotilde", "Saint Denis") == 1
    assert places.city_score("Paris 12", ["Paris", "Paris 13"]) == 0.9
    assert places.country_score("Angleterre", "Royaume Uni") == 1 and places.country_score("France", "Allemagne") < 1
    assert places.geo_score(45.0, 2.0, 45.0, 2.0) == 1 and places.distance_km(0, 0, 0, 180) > 20000
    france = {"city": "Metz", "country": "France", "countryCode": "FRA", "departmentCode": "57", "code": "57463", "latitude": 49.1, "longitude": 6.2}
    assert places.score({"city": "Metz"}, france)["score"] == 1 and places.score({}, france)["score"] == 0.75
    assert places.score({"city": "Mets"}, france, {"mets": {"lat": 49.1, "lon": 6.2, "code": "57463"}})["city"] >= 0.75
    assert places.score({}, {"country": "Italie", "countryCode": "ITA"})["score"] == 0.75
    assert places.score({"city": "Italie"}, {"country": "Italie", "countryCode": "ITA", "city": "Rome"})["country"] == 1


def test_goldens_of_whole_persons():
    request = {"firstName": "georges", "lastName": "pompidous", "birthDate": "19691101"}
    person = {"name": {"first": "Georges", "last": "Pompidou"}, "sex": "M", "birth": {"date": "19691101"}}
    assert compare_one(request, person)["score"] == 0.73
    assert compare_one(request | {"birthDate": "01/11/1969"}, person | {"birth": {"date": "01/11/1969"}}, Params("dd/MM/yyyy", "dd/MM/yyyy"))["score"] == 0.73
    place = {"countryCode": "FRA", "country": "France", "latitude": 48.8, "longitude": 2.3}
    undated = {k: v for k, v in request.items() if k != "birthDate"}
    near = compare_one(undated | {"birthCountry": "France", "birthGeoPoint": {"latitude": 48.8, "longitude": 2.4}}, person | {"birth": {"date": "19691101", "location": place}})
    assert near["birthLocation"]["geo"] == 0.73 and near["score"] == 0.6


def test_pruning_and_blend():
    person = {"name": {"first": "a", "last": "b"}, "birth": {"date": "19500101"}}
    s = compare(person_from_request({"firstName": "zoe", "lastName": "quux", "birthDate": "19991231"}), person)
    assert s["score"] == 0 and "birthLocation" not in s
    assert reduce_scores({}) == 0 and reduce_scores({"a": 0.5, "b": {"score": 0.8}}) == 0.4 and reduce_scores({"score": 0.123, "a": 1}) == 0.12
    assert person_from_request({"lastSeenAliveDate": "19900101"}) == {} and person_from_request({"deathAge": 80, "deathDate": "2000"})["death"]["date"] == "80"
    explained = compare(person_from_request({"firstName": "a", "lastName": "b"}), person, Params(explain=True))
    assert "name" in explained["explain"]
