"""Runs in the background, batches that are whole or absent, explanations, and what stays after a failure."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalink.functions import blend
from vitalink.operators import link, score
from vitalink.plans import catalogue
from vitalink.plans.persons import nested
from vitalink.streaming import bulk, jobs

from .test_pair_scores import pairs  # noqa: F401

SCHEMA = "qid long, first_q string, last_q string, sex_q string, birth_q string"


@F.udf(T.LongType())
def slow(x):
    time.sleep(0.2)
    return x


def until(holds, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not holds():
        time.sleep(0.1)
    assert holds()


def test_a_run_ends_with_its_whole_table(spark, tmp_path):
    job = jobs.Job(spark, lambda: spark.range(1000, numPartitions=8).groupBy((F.col("id") % 7).alias("k")).count(), f"{tmp_path}/out")
    assert job.progress() == jobs.Progress(jobs.WAITING, 0, 0, 0, 0)
    assert job.start().result().agg(F.sum("count")).first()[0] == 1000
    at = job.progress()
    assert at.state == jobs.DONE and at.jobs == at.jobs_done > 0 and at.tasks_done >= 8 and at.error is None
    assert not job.cancel() and job.state == jobs.DONE and os.listdir(tmp_path) == ["out"]
    with pytest.raises(ValueError):
        job.start()
    # an empty table is a table
    assert jobs.Job(spark, lambda: spark.range(0), f"{tmp_path}/none").start().result().count() == 0


def test_a_cancelled_run_leaves_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    spark.range(3).write.parquet(out)
    job = jobs.Job(spark, lambda: spark.range(4000, numPartitions=200).select(slow("id").alias("id")), out).start()
    until(lambda: job.progress().tasks_done > 2)
    at = job.progress()
    assert at.state == jobs.RUNNING and at.tasks_done < at.tasks == 200
    assert job.cancel() and job.wait() == jobs.CANCELLED and not job.cancel()
    assert os.listdir(tmp_path) == ["out"] and spark.read.parquet(out).count() == 3
    with pytest.raises(RuntimeError):
        job.result()
    # other jobs of the session go on
    assert spark.range(10).count() == 10


def test_a_run_that_is_cancelled_before_it_starts_stays_so(spark, tmp_path):
    job = jobs.Job(spark, lambda: spark.range(1), f"{tmp_path}/out")
    assert job.cancel()
    with pytest.raises(ValueError):
        job.start()
    assert os.listdir(tmp_path) == []


def test_a_failed_run_says_why(spark, tmp_path):
    job = jobs.Job(spark, lambda: spark.range(5).select(F.raise_error(F.lit("no such thing"))), f"{tmp_path}/out").start()
    assert job.wait() == jobs.FAILED and "no such thing" in job.progress().error and os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="no such thing"):
        job.result()


def persons_of(spark):
    rows = [(k, "georges", "", f"pompidou{'abcdefghij'[k % 10]}", "M", "19691101") for k in range(20)]
    place = {"birth_city": "x", "birth_code": "01001", "birth_department": "01", "birth_country": "FRANCE", "death_date": "20000101"}
    table = spark.createDataFrame(rows, "uid long, first string, second_name string, last string, sex string, birth_date string")
    return table.withColumns({k: F.lit(v) for k, v in place.items()} | {"lat": F.lit(42.0), "lon": F.lit(1.0)})


def test_linkage_that_fails_leaves_no_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(link, "workspace", lambda spark: f"{tmp_path}/work")
    asked = spark.createDataFrame([(1, "georges", "pompidoua", "M", "19691101")], SCHEMA)
    broken = F.when(F.col("uid") >= 0, F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        link.link(asked.withColumn("first_q", F.lit("jean paul")), persons_of(spark), broken)
    assert os.listdir(tmp_path) == []
    assert [r.uid for r in link.link(asked, persons_of(spark), nested()).collect()] == [0]
    assert os.listdir(f"{tmp_path}/work") == ["found"]


def test_a_stopped_stream_leaves_whole_batches_and_goes_on(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.csv").write_text(f"qid,first_q,last_q,sex_q,birth_q\n{k},georges,pompidou{'abc'[k]},M,19691101\n")
    people, seen = persons_of(spark), jobs.BatchProgress()
    spark.streams.addListener(seen)
    try:
        run = lambda prepare=None: bulk.link_stream(spark, str(source), SCHEMA, people, nested(), out, f"{tmp_path}/check", prepare=prepare, files_per_trigger=1)
        held = run(lambda rows: rows.withColumn("qid", F.when(F.col("qid") >= 0, slow("qid") + slow(slow("qid")) * 0)))
        until(lambda: os.path.isdir(f"{out}/batch=0"), 120)
        held.stop()
        whole = [n for n in os.listdir(out) if n.startswith("batch=")]
        assert whole and all(os.path.exists(f"{out}/{n}/_SUCCESS") for n in whole)
        run().awaitTermination()
        until(lambda: len(seen.ended) == 1 and sum(seen.rows.values()) >= 2)
    finally:
        spark.streams.removeListener(seen)
    rows = spark.read.parquet(out).select("qid", "uid", "batch").collect()
    assert sorted(r.qid for r in rows) == [0, 1, 2] and {r.batch for r in rows} == {0, 1, 2}
    assert list(seen.ended.values()) == [None] and not [n for n in os.listdir(out) if n.startswith(".batch=") and os.path.isdir(f"{out}/{n}")]


@pytest.mark.parametrize("country", ["FRA", "ITA", None])
def test_explanations_of_plain_pairs_equal_the_function(pairs, country):  # noqa: F811
    how = blend.Params(explain=True)
    person = nested(code="code")
    plain = score.plain(pairs.withColumn("code", F.lit(country).cast("string")), how).where("plain").withColumn("_json", person)
    got = {(r.qid, r.uid): json.loads(r.explain) for r in link.scored_pairs(plain, F.col("_json"), how).collect()}
    want = plain.select("qid", "uid", score.pair_scores(how)(link.request_json(), person).alias("s")).collect()
    assert len(got) == len(want) > 200
    for r in want:
        assert got[r.qid, r.uid] == json.loads(r.s.explain), (got[r.qid, r.uid], r.s.explain)


def test_a_run_of_several_tables(spark, tmp_path):
    made = {"a": spark.range(5), "b": spark.range(7).withColumnRenamed("id", "x")}
    found = jobs.Job(spark, lambda: made, f"{tmp_path}/out").start().result()
    assert {k: (v.columns, v.count()) for k, v in found.items()} == {"a": (["id"], 5), "b": (["x"], 7)}
    assert os.listdir(tmp_path) == ["out"] and sorted(os.listdir(f"{tmp_path}/out")) == ["a", "b"]


def test_the_run_of_a_linkage_writes_no_pairs_of_rows(spark, tmp_path, monkeypatch):
    """Tables of 30 copies of each row, keys shifted: 900 times the pairs, none of which is written."""
    one = "/root/testdata/sf0.001"
    size = {"orders": 150_000, "customer": 15_000}
    (tmp_path / "many").mkdir()
    for name in ("orders", "customer", "part", "nation"):
        rows = spark.read.parquet(f"{one}/{name}.parquet")
        if name in size:
            rows = rows.crossJoin(spark.range(30).withColumnRenamed("id", "_k"))
            rows = rows.withColumns({c: F.col(c) + F.col("_k") * size["orders" if c == "o_orderkey" else "customer"] for c in rows.columns if c.endswith(("orderkey", "custkey"))})
        rows.drop("_k").write.parquet(f"{tmp_path}/many/{name}.parquet")
    few = {(r.qid, r.uid) for r in catalogue.link_job(spark, one).collect()}
    base = f"{tmp_path}/work"
    monkeypatch.setattr(catalogue.stage, "workspace", lambda _: base)
    got = catalogue.link_job(spark, f"{tmp_path}/many")
    alike = got.groupBy((F.col("qid") % size["orders"]).alias("q"), (F.col("uid") % size["orders"]).alias("u")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("qid", "uid").alias("d")).collect()
    assert {(r.q, r.u) for r in alike} == few and {(r.n, r.d) for r in alike} == {(900, 900)}
    persons = spark.read.parquet(f"{tmp_path}/many/orders.parquet").count()
    written = [rows for d, _, files in os.walk(base) if any(f.endswith(".parquet") for f in files) for rows in [spark.read.parquet(d).count()]]
    assert written and max(written) <= persons < 900 * len(few)
