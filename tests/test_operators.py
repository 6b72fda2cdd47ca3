"""Requests, search, aggregation, scoring of candidate sets, linkage, files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vitalink.functions import text
from vitalink.functions.blend import Params
from vitalink.operators import aggregate, link, requests, score, search
from vitalink.operators.requests import RequestError, parse
from vitalink.plans.persons import nested
from vitalink.sources import bulk, reference
from vitalink.streaming.bulk import link_stream

PEOPLE = [
    (1, "georges", "jean", "pompidou", "M", "19691101", "20100101", 40, "75056", "75", "Paris", "France", 48.85, 2.35, "2010"),
    (2, "georgette", "marie", "pompidou", "F", "19691102", "20110101", 41, "75056", "75", "Paris", "France", 48.86, 2.36, "2011"),
    (3, "jean", "paul", "dupont", "M", "19300000", "20000230", 70, "57463", "57", "Metz", "France", 49.12, 6.18, "2000"),
    (4, "jeanne", "anne", "dupond", "F", "19300512", "20000303", 69, "99127", "99", "Roma", "Italie", 41.9, 12.5, "2000"),
    (5, "élise", "rose", "de la tour", "F", "19450615", "20150615", 70, "13055", "13", "Marseille", "France", 43.3, 5.4, "2015"),
    (6, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
]
SCHEMA = "uid long, first string, second_name string, last string, sex string, birth_date string, death_date string, death_age int, birth_code string, birth_department string, birth_city string, birth_country string, lat double, lon double, source string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


def found(people, **fields):
    return sorted(r.uid for r in search.search(people, parse(fields)).select("uid").collect())


@pytest.mark.parametrize(("fields", "want"), [
    ({"lastName": "pompidou"}, [1, 2]), ({"lastName": "pompidu", "firstName": "george"}, [1]), ({"lastName": "pompidu", "fuzzy": "false"}, []), ({"firstName": "pompidou", "lastName": "georges"}, [1]),
    ({"lastName": "dupont"}, [3, 4]), ({"lastName": "dupont", "sex": "H"}, [3]), ({"birthDate": "1930"}, [3, 4]), ({"birthDate": "01/01/1940-31/12/1950"}, [5]), ({"birthDate": "1940-1950"}, [5]),
    ({"birthDate": "<1940"}, [3, 4]), ({"birthDate": ">01/01/1969"}, [1, 2]), ({"deathAge": "69-70"}, [3, 4, 5]), ({"deathAge": 41}, [2]), ({"birthLocationCode": "57463"}, [3]), ({"birthDepartment": 57}, [3]),
    ({"birthCity": "Pariss"}, [1, 2]), ({"birthCity": "Pariss", "fuzzy": False}, []), ({"birthCountry": "italie"}, [4]), ({"birthGeoPoint": {"latitude": 48.85, "longitude": 2.35, "distance": "5km"}}, [1, 2]),
    ({"birthGeoPoint": {"latitude": 48.85, "longitude": 2.35, "distance": "1000km"}}, [1, 2, 3, 5]), ({"q": "Georges Pompidou"}, [1]), ({"q": "Élise de la Tour"}, [5]), ({"q": "01/11/1969"}, [1]), ({"source": "2015"}, [5]),
    ({"lastName": "Inconnu"}, []), ({"id": 3}, [3]), ({"firstName": "Elise"}, [5]), ({"lastSeenAliveDate": "01/01/2011"}, [2, 5]),
])
def test_search(people, fields, want):
    assert found(people, **fields) == want


@pytest.mark.parametrize("raw", [
    {}, {"q": "a", "lastName": "b"}, {"nonsense": 1}, {"birthDate": "31/31/3131"}, {"sex": "X", "lastName": "a"}, {"deathAge": "90-80"}, {"lastName": "a", "sort": "[]"}, {"lastName": "a", "fuzzy": "perhaps"},
    {"birthGeoPoint": {"latitude": 1}}, {"lastName": "a", "source": "12"},
])
def test_invalid_requests(raw):
    with pytest.raises(RequestError) as e:
        parse(raw)
    assert e.value.messages


def test_masks():
    assert [requests.is_age(x) for x in ("", "7", "99", "100", "139", "140", "x")] == [True, True, True, True, True, False, False]
    assert requests.is_age_or_range("20-30") and not requests.is_age_or_range("30-20")
    assert requests.is_date("0000") and requests.is_date("1969") and requests.is_date("01/11/1969") and not requests.is_date("1769")
    assert requests.date_bounds("1960-1970") == ("1960", "1970") and requests.date_bounds(">01/02/1960") == ("19600201", None)
    with pytest.raises(RequestError):
        parse({"lastName": "a"}, aggregation=True)
    assert parse({"lastName": "a", "legalName": "b"}).echo() == {"lastName": "a", "legalName": "b"}


def test_edits_against_plain_function(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(30)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    rows = pairs.select("a", "b", *(search.within_edits(F.col("a"), F.col("b"), k).alias(f"k{k}") for k in (0, 1, 2))).collect()
    for r in rows:
        d = text.damerau(r.a, r.b)
        assert (r.k0, r.k1) == (d == 0, d <= 1)
        assert r.k2 or d > 2  # two swaps with an edit between may count less


def test_pages_add_up(people):
    whole = search.ordered(search.search(people, parse({"deathAge": "0-99"})), [("birthDate", "asc")]).select("uid").collect()
    pages = []
    for n in (1, 2, 3, 4):
        r = parse({"deathAge": "0-99", "size": 2, "page": n, "sort": json.dumps([{"birthDate": "asc"}])})
        pages += search.page(search.search(people, r), r).select("uid").collect()
    assert pages == whole and len(whole) == 5


def test_filters_reach_the_scan(people, spark, tmp_path):
    people.write.parquet(f"{tmp_path}/p")
    table = spark.read.parquet(f"{tmp_path}/p")
    plan = search.search(table, parse({"birthDate": "1969", "sex": "M"})).select("uid")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(birth_date,1969)" in plan and "EqualTo(sex,M)" in plan


def test_aggregations(people, spark):
    rows = people.where("uid < 6")
    assert [tuple(r) for r in aggregate.terms(rows, "birth_country").collect()] == [("France", 4), ("Italie", 1)]
    months = aggregate.months(rows, "death_date").collect()
    assert months[0].key == "20000301" or min(m.key for m in months) == "20000301"
    assert sum(m.value for m in months) == 4 and len(months) == 184  # 20000230 is no day; months without rows count
    groups = aggregate.composite(people, ["sex", "birth_country"]).collect()
    assert [tuple(r) for r in groups] == [("F", "France", 2), ("F", "Italie", 1), ("M", "France", 2)]
    assert aggregate.composite(people, ["sex", "birth_country"], after=["F", "France"], size=1).collect()[0].sex == "F"
    arrays = spark.createDataFrame([(["a", "a", "b"],), (["b"],), (None,)], "x array<string>")
    assert [tuple(r) for r in aggregate.terms(arrays, "x").collect()] == [("b", 2), ("a", 1)]
    assert aggregate.aggregate(people, parse({"aggs": '["sex"]', "birthDate": "1969"}, aggregation=True)).count() == 2
    assert aggregate.months(people.where("false"), "birth_date").count() == 0
    assert aggregate.cardinality(rows, ["sex"]).first().sex == 2


def test_candidate_set_penalties(spark):
    schema = "qid long, uid long, rank double, score double, name double, sex_b string"
    alone = spark.createDataFrame([(1, 1, 9.0, 0.8, 0.9, "M"), (1, 2, 0.0, 0.9, 0.9, "M")], schema)
    assert [(r.uid, r.final) for r in score.candidate_set(alone).collect()] == [(1, 0.8)]
    two = spark.createDataFrame([(1, 1, 9.0, 0.8, 0.9, "M"), (1, 2, 8.0, 0.5, 0.9, "M"), (2, 3, 8.0, 0.2, 0.9, "M"), (3, 4, 100.0, None, None, "M")], schema)
    got = {r.uid: r.final for r in score.candidate_set(two).collect()}
    assert got == {1: 0.72, 4: 0.5}  # 1 - 0.1 * (1 - 1 + 1) = 0.9; the second falls below 0.4
    female = spark.createDataFrame([(1, 1, 9.0, 0.9, 0.9, "F"), (1, 2, 8.0, 0.8, 0.5, "F")], schema)
    assert {r.uid for r in score.candidate_set(female).collect()} == {1}


def test_linkage_keeps_unmatched_and_prunes(spark, people):
    asked = spark.createDataFrame([(10, "georges", "pompidous", "M", "19691101"), (11, "nobody", "atall", "F", "18000101"), (12, "jean", "dupont", "M", "19300000"), (13, None, None, None, None), (14, "Georges", "Pompidou", "M", "19691110")], "qid long, first_q string, last_q string, sex_q string, birth_q string")
    out = link.link(asked, people, nested(), Params(candidates=5, prune=0.1))
    got = {(r.qid, r.uid) for r in out.collect()}
    assert {(10, 1), (11, None), (13, None), (14, 1)} <= got and {q for q, _ in got} == {10, 11, 12, 13, 14}
    strict = link.link(asked, people, nested(), Params(candidates=5, prune=0.7))
    assert strict.where("uid is not null").count() <= out.where("uid is not null").count()
    assert link.link(asked.where("false"), people, nested()).count() == 0


def test_no_edit_distance_is_a_join_condition(spark, people):
    asked = spark.createDataFrame([(10, "georges", "pompidou", "M", "19691101")], "qid long, first_q string, last_q string, sex_q string, birth_q string")
    plan = link.candidates(asked, people)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_csv_in(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("junk\nPrenom;Nom;Date\nÉlise;Tour;15/06/1945\n\nJean;\"Du;pont\";1930\nSeul\n".encode())
    rows = bulk.read_csv(spark, str(tmp_path / "a.csv"), sep=";", skip_lines=1)
    assert [tuple(r) for r in rows.orderBy("sourceLineNumber").collect()] == [("Élise", "Tour", "15/06/1945", 1), ("Jean", "Du;pont", "1930", 2), ("Seul", None, None, 3)]
    (tmp_path / "r.csv").write_bytes(b"Nom;Date\rA;1\rB;2\rC;3\r")
    assert bulk.read_csv(spark, str(tmp_path / "r.csv"), sep=";").count() == 3 and bulk.count_lines(spark, str(tmp_path / "r.csv")) == 4
    (tmp_path / "l.csv").write_bytes("Nom,Date\nÉric,1\n".encode("latin-1"))
    assert bulk.read_csv(spark, str(tmp_path / "l.csv"), encoding="latin1").first().Nom == "Éric"
    (tmp_path / "bad.csv").write_bytes(b"a,b\n1,2,3\n")
    with pytest.raises(Exception, match="column header mismatch"):
        bulk.read_csv(spark, str(tmp_path / "bad.csv")).collect()
    mapped = bulk.map_columns(rows, {"Prenom": "firstName", "Nom": "lastName", "Date": "birthDate"})
    assert mapped.columns == ["source", "sourceLineNumber", "firstName", "lastName", "birthDate"] and mapped.first().source["Nom"] in ("Tour", "Du;pont", None)


def test_csv_and_json_out(spark, tmp_path, people):
    order = bulk.column_order(["Prenom", "Nom", "Date", "Sex"], {"Prenom": "firstName", "Nom": "lastName", "Date": "birthDate", "Sex": "sex"}, interleave=True)
    assert order[:8] == ["name.first", "Prenom", "name.last", "Nom", "birth.date", "Date", "sex", "Sex"] and len(bulk.RESULT_COLUMNS) == 27
    person = people.where("uid = 1").select(F.col("uid").alias("id"), F.struct(F.array("first", "second_name").alias("first"), F.col("last").alias("last")).alias("name"), "sex", F.struct(F.col("birth_date").alias("date")).alias("birth"))
    row = bulk.cells(person, ["id", "name.first", "birth.date", "sex", "death.date", "birth"], F.lit(False)).first()
    assert row["name.first"] == "georges, jean" and row["sex"] == "" and row["death.date"] == "" and json.loads(row["birth"]) == {"date": "19691101"}
    bulk.write_csv(people.select("uid", "last"), f"{tmp_path}/c", codec="gzip")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 6
    bulk.write_json(people.select("uid"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 6
    assert json.loads(bulk.json_records(people.select("uid"), {}).first().record)["header"] == ["uid"]
    assert bulk.export(people.where("uid = 1"), "fr").first()["date de naissance"] == "01/11/1969"
    with pytest.raises(bulk.TooManyRows):
        bulk.export(people, limit=3)
    assert bulk.charset("windows-1252") == "windows-1252" and bulk.charset("win1252") == "windows-1252"


def test_reference_data(spark, tmp_path, people):
    (tmp_path / "c.json").write_text(json.dumps({"features": [
        {"properties": {"nom": "Metz", "code": "57463"}, "geometry": {"coordinates": [[[6.0, 49.0], [6.2, 49.2]]]}},
        {"properties": {"nom": "METZ", "code": "57464"}, "geometry": {"coordinates": [[[[1.0, 2.0], [3.0, 4.0]]]]}},
    ]}))
    towns = reference.commune_dictionary(reference.communes(spark, str(tmp_path / "c.json")))
    assert towns["metz"]["code"] == "57464" and towns["metz"]["lat"] == 3.0 and towns["metz"]["lon"] == 2.0
    (tmp_path / "w.json").write_text(json.dumps({"1": {"wikidata": "Q1", "label": "G"}}))
    linked = reference.with_links(people, reference.wiki_links(spark, str(tmp_path / "w.json")), "uid").where("links is not null").collect()
    assert [(r.uid, r.links.wikidata) for r in linked] == [(1, "Q1")]
    for name, date in (("a.json", "20200101"), ("b.json", "20210101")):
        (tmp_path / "log" / "1").mkdir(parents=True, exist_ok=True)
        (tmp_path / "log" / "1" / f"{date}_{name}").write_text(json.dumps({"date": date, "author": "someone@mail.example", "fields": {"lastName": "x"}}))
    log = reference.corrections(spark, str(tmp_path / "log"))
    row = log.first()
    assert row.id == "1" and [m.date for m in row.modifications] == ["20200101", "20210101"] and row.modifications[0].author == "so...ne@mail.example"
    assert reference.latest(log).first().date == "20210101" and reference.corrected_only(people, log, "uid").count() == 1 and reference.with_corrections(people, log, "uid").count() == 6
    flat = spark.createDataFrame([("7", "Doe", "John Paul", "M", "19000101", "POINT (2.5 48.5)")], "UID string, NOM string, PRENOMS string, SEXE string, DATE_NAISSANCE string, GEOPOINT_NAISSANCE string")
    person = reference.nest(flat).first()
    assert person.name.first == ["John", "Paul"] and person.birth.location.latitude == 48.5 and person.death.age is None
    assert reference.with_raw(flat).first().NOM_raw == "doe"


def test_stream_links_each_file_once(spark, tmp_path, people):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    (source / "1.csv").write_text("qid,first_q,last_q,sex_q,birth_q\n10,georges,pompidou,M,19691101\n")
    for _ in range(2):
        link_stream(spark, str(source), "qid long, first_q string, last_q string, sex_q string, birth_q string", people, nested(), out, f"{tmp_path}/check").awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r.qid, r.uid) for r in rows] == [(10, 1)]


def test_ranking(people):
    rows = search.bm25(people, "Pompidou Georges").orderBy(F.desc("rank")).collect()
    assert rows[0].uid == 1 and {r.uid for r in rows} == {1, 2}
    assert search.status(people).first().records == 6


def test_blocks_scroll_and_scored_hits(people):
    block = {"scope": ["name", "birthDate"], "minimum_match": 1}
    assert found(people, firstName="georges", lastName="pompidou", birthDate="01/11/1969", block=block) == [1, 2]
    assert found(people, firstName="x", lastName="pompidu", birthDate="01/11/1969", block=block) == [1]
    assert found(people, firstName="jean", lastName="dupont", birthDate="1920-1940", block=block) == [3]
    assert found(people, lastName="pompidou", birthDate="1930", block=block) == [1, 2, 3, 4]
    r = parse({"deathAge": "0-99", "size": 2, "sort": [{"birthDate": "asc"}]})
    assert [len(p) for p in search.scroll(search.search(people, r), r)] == [2, 2, 1]
    hits = search.search(people, parse({"lastName": "pompidou"}))
    rows = score.score_hits(hits, {"firstName": "georges", "lastName": "pompidou", "birthDate": "19691101"}, nested()).collect()
    assert rows[0].uid == 1 and rows[0].final > rows[1].final >= 0 and len(rows) == 2
