"""Distance joins, the term dictionary, stored pages of groups and merged distinct counts, each against its plain form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vitalink.operators import aggregate, blocking, near, search, terms
from vitalink.operators.requests import parse
from vitalink.plans import catalogue


def _km(a, b):
    if a == b:
        return 0.0
    x, y = math.radians(a[0]), math.radians(b[0])
    return 6370.693486 * math.acos(max(-1.0, min(1.0, math.sin(x) * math.sin(y) + math.cos(x) * math.cos(y) * math.cos(math.radians(a[1] - b[1])))))


def test_distance_join_equals_all_pairs_everywhere(spark):
    """Poles, the date line, the whole globe, distance 0, nulls and a crowded place."""
    rng = random.Random(2)
    spots = [(48.85, 2.35), (-33.9, 151.2), (0.5, 179.9995), (0.5, -179.9995), (89.9, 10.0), (-89.99, -170.0), (60.0, -179.99), (10.0, 10.0)]
    known = [(k, *(lambda s: (max(-90.0, min(90.0, s[0] + rng.gauss(0, 0.3))), (s[1] + rng.gauss(0, 0.6) + 180) % 360 - 180))(rng.choice(spots))) for k in range(500)]
    known += [(1000 + k, 48.85, 2.35) for k in range(300)] + [(2000 + k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(200)]
    asked = [(k, *rng.choice(spots), rng.choice([0.0, 0.05, 1.0, 12.5, 80.0, 900.0, 6000.0, 30000.0])) for k in range(120)]
    want = {(q, u) for q, a, b, km in asked for u, c, d in known if _km((a, b), (c, d)) <= km}
    left = spark.createDataFrame(asked + [(900, None, 2.0, 5.0), (901, 48.85, 2.35, None), (902, 0.0, 2.0, 9.0)], "qid int, lat double, lon double, km double")
    right = spark.createDataFrame(known + [(5000, None, 2.35), (5001, 48.85, None)], "uid int, lat double, lon double")
    got = near.within_distance(left, right, least=100).collect()
    assert len(got) == len({(r.qid, r.uid) for r in got}) and {(r.qid, r.uid) for r in got} == want
    assert near.within_distance(left.limit(0), right).count() == near.within_distance(left, right.limit(0)).count() == 0


def test_cells_of_coarser_grids_are_prefixes(spark):
    rows = [(r, c) for r in (0, 1, 5, 1023, 1 << 19) for c in (0, 3, 77, (1 << 20) - 1)]
    z = spark.createDataFrame(rows, "r long, c long").select("r", "c", near.z_number(F.col("r"), F.col("c")).alias("z"), near.z_number(F.shiftright("r", 4), F.shiftright("c", 4)).alias("p")).collect()
    for x in z:
        bits = sum(((x.r >> k & 1) << 2 * k + 1) | ((x.c >> k & 1) << 2 * k) for k in range(20))
        assert x.z == bits and x.p == x.z >> 8


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    syllables = "ba be bi bo ca ce da de fa ga la le li lo ma me mi na ne no pa ra re ro sa se ta te ti va".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = [word() for _ in range(1500)]
    rows = [(k, rng.choice(words), rng.choice([None, rng.choice(words), f"{rng.choice(words)} {rng.choice(words)}"]), "martin" if k % 3 == 0 else rng.choice(words), f"19{k % 90 + 10}0101") for k in range(6000)]
    rows += [(9000, None, None, None, "19500101"), (9001, "", "", "", "19500101"), (9002, "Élodie", None, "D'Arc", "19500101")]
    return spark.createDataFrame(rows, "uid long, first string, second_name string, last string, birth_date string").withColumn("death_date", F.col("birth_date"))


@pytest.fixture(scope="module")
def dictionary(people, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("terms"))
    people.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        terms.build(people, f"file://{path}")
    finally:
        people.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return f"file://{path}"


def test_searches_over_the_dictionary_equal_plain_ones(spark, people, dictionary):
    some = people.where("uid in (7, 50, 333)").collect()
    asked = [{"lastName": r["last"] + "x", "firstName": r["first"]} for r in some] + [{"lastName": "mratin"}, {"firstName": "elodi", "lastName": "arc"}, {"firstName": "arc", "lastName": "elodie"}]
    asked += [{"q": f"{some[1]['first']} {some[1]['last']}"}, {"q": "martin lalala nobody"}, {"lastName": "zzzzzzzzz"}, {"lastName": "martin", "firstName": some[0]["first"], "fuzzy": False}]
    asked += [{"birthDate": "1950"}, {"lastName": "martin", "legalName": "lala", "firstName": "dede"}, {"lastName": "martin", "birthDate": "1950", "block": {"scope": ["name", "birthDate"], "minimum_match": 1, "should": True}}]
    for fields in asked:
        r = parse(fields)
        want = sorted(tuple(x) for x in search.search(people, r).select("uid", "rank").collect())
        assert sorted(tuple(x) for x in terms.find(people, dictionary, r).select("uid", "rank").collect()) == want, fields


def test_the_rarest_word_is_read_and_little_else(spark, people, dictionary):
    r = parse({"firstName": people.where("uid = 9").first()["first"], "lastName": "martin"})
    _, many = terms.rows_near(spark, dictionary, ["martin"])
    rows, few = terms.rows_near(spark, dictionary, terms.needed(r)[0])
    assert few < many and terms.needed(r)[1] == ["martin"]
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
    assert 0 < few <= read < spark.read.parquet(f"{dictionary}/people").count()


def test_more_near_words_than_a_filter_takes_are_joined(spark, people, dictionary, monkeypatch):
    words = terms.needed(parse({"lastName": people.where("uid = 10").first()["last"]}))[0]
    want = sorted(r.uid for r in terms.rows_near(spark, dictionary, words)[0].select("uid").collect())
    monkeypatch.setattr(terms, "MOST_WORDS", 1)
    rows, n = terms.rows_near(spark, dictionary, words)
    assert sorted(r.uid for r in rows.select("uid").collect()) == want and n == len(want) > 0


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_all_stored_pages_are_one_group_by(spark, people, tmp_path, size):
    path, columns = f"file://{tmp_path}/pages", ["last", "birth_date"]
    some = people.where("uid % 40 = 0 or uid >= 9000" if size < 10 else "true")
    aggregate.store_groups(some, columns, path, rows_per_file=50)
    want = [tuple(r) for r in aggregate.composite(some, columns).collect()]
    got, after = [], None
    while page := [tuple(r) for r in aggregate.group_page(spark, path, columns, after, size).collect()]:
        got, after = got + page, list(page[-1][:2])
        if size == 64 and len(got) > 300:
            want = want[: len(got)]
            break
        if size < 10 and len(got) > 40:
            want = want[: len(got)]
            break
    assert got == want
    if size == 7:  # a page is one or two files
        assert len(aggregate.group_page(spark, path, columns, after, size).inputFiles()) <= 2


def test_merged_distinct_counts(spark, people):
    rows = people.withColumn("part", F.col("uid") % 5).withColumn("words", F.split("second_name", " "))
    sketches = aggregate.distinct_sketches(rows, ["uid", "last", "words"], "part")
    got = {r.column: r.n for r in aggregate.merged_cardinality(sketches).collect()}
    exact = aggregate.cardinality(rows, ["uid", "last"], exact=True).first().asDict() | {"words": rows.select(F.explode("words").alias("w")).distinct().count()}
    assert set(got) == set(exact) and all(abs(got[c] - n) <= 0.03 * n for c, n in exact.items())
    assert aggregate.merged_cardinality(aggregate.distinct_sketches(rows.limit(0), ["uid"], "part")).count() == 0


def test_distances_are_taken_once_for_equal_points(spark):
    """A hundred requests and 300 persons of one point: no shuffle has their 30,000 pairs, and each pair comes once."""
    left = spark.range(100).select(F.col("id").alias("qid"), F.lit(48.85).alias("lat"), F.lit(2.35).alias("lon"), F.lit(5.0).alias("km"))
    right = spark.range(300).select(F.col("id").alias("uid"), F.lit(48.86).alias("lat"), F.lit(2.36).alias("lon"))
    got = near.within_distance(left, right)
    assert got.count() == got.select("qid", "uid").distinct().count() == 30_000 and got.select("km").distinct().count() == 1
    assert "_members" in got._jdf.queryExecution().optimizedPlan().toString()  # the rows of a class are listed, then made


def test_a_distance_join_computes_the_persons_once(spark):
    """What gives the pairs of rows reads stored points; the joins that make the persons are not in its plan."""
    rows = catalogue.link_distance(spark, "/root/testdata/sf0.001")
    assert "o_custkey" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_the_right_are_few(spark):
    """A class of 3,750 persons (one in 2,400 at 60 times sf0.1) stays one list: a list of requests is sent to it once."""
    _, cut = blocking._lists(spark.range(3750).select("id", F.lit(1).alias("k")), "id", ["k"], 10_000, 8000)
    assert cut.count() == 0
    pairs, left = spark.range(1).select(F.lit(1).alias("a"), F.lit(1).alias("k")), spark.range(19).select(F.col("id").alias("qid"), F.lit(1).alias("a"))
    got = blocking.members_of(pairs, left, spark.range(3750).select(F.col("id").alias("uid"), F.lit(1).alias("k")), ["a"], ["k"])
    assert got.distinct().count() == got.count() == 19 * 3750
    assert got.select(F.spark_partition_id()).distinct().count() == 1
