"""Aggregations of a search: top terms, calendar-month histograms, multi-key groups with a cursor, distinct counts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .requests import SORT_COLUMNS, SearchRequest
from .search import search

#: Fields with a single-field aggregation of their own; all other groups are composite.
TERMS = ("firstName", "lastName", "sex", "birthCity", "birthDepartment", "birthCountry", "deathAge", "deathCity", "deathDepartment", "deathCountry", "birthLocationCode", "deathLocationCode")
DATES = ("birthDate", "deathDate")


def _key(rows: DataFrame, column: str) -> Column:
    """A group key; each different value of a multi-valued column is one."""
    return F.explode(F.array_distinct(column)) if dict(rows.dtypes)[column].startswith("array") else F.col(column)


def terms(rows: DataFrame, column: str, size: int = 250) -> DataFrame:
    """key and value (count) of the most frequent values; ties by key.  Nulls are no values."""
    counted = rows.select(_key(rows, column).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("value"))
    return counted.orderBy(F.desc("value"), F.asc("key")).limit(size)


def months(rows: DataFrame, column: str) -> DataFrame:
    """key (yyyyMM01) and value of each calendar month from the first to the last, also those without rows.

    Dates are yyyyMMdd strings; partial and impossible ones are left out.
    """
    month = F.trunc(F.try_to_date(F.col(column), "yyyyMMdd"), "month")
    counted = rows.select(month.alias("m")).where("m is not null").groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    # one row: the number of months, not of rows, bounds what follows
    every = counted.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("each"))
    return every.join(counted, F.col("each") == F.col("m"), "left").select(F.date_format("each", "yyyyMMdd").alias("key"), F.coalesce("n", F.lit(0)).alias("value"))


def composite(rows: DataFrame, columns: list[str], after: list | None = None, size: int | None = None) -> DataFrame:
    """The key columns and value of each group, in order of the keys, after a cursor.  Groups with a null key are left out."""
    keyed = rows
    for c in columns:
        if dict(rows.dtypes)[c].startswith("array"):
            keyed = keyed.withColumn(c, F.explode(F.array_distinct(c)))
    out = keyed.dropna(subset=columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("value"))
    if after is not None:
        out = out.where(_beyond([F.col(c) for c in columns], after))
    out = out.orderBy(*columns)
    return out if size is None else out.limit(size)


def _beyond(columns: list[Column], after: list) -> Column:
    """Whether the columns come after a cursor in the order of all of them."""
    steps = []
    for k, (c, x) in enumerate(zip(columns, after, strict=True)):
        test = c > F.lit(x)
        for d, y in zip(columns[:k], after[:k], strict=True):
            test = test & (d == F.lit(y))
        steps.append(test)
    return reduce(or_, steps)


def store_groups(rows: DataFrame, columns: list[str], path: str, rows_per_file: int = 100_000) -> None:
    """Write the groups of :func:`composite` once, in order, and a table of what each file holds, for :func:`group_page`.

    The order is made by ranges; no file has more than ``rows_per_file`` groups.
    """
    composite(rows, columns).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/groups")
    stored = rows.sparkSession.read.parquet(f"{path}/groups").select(F.col("_metadata.file_path").alias("file"), F.struct(*columns).alias("k"))
    stored.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/files")


def group_page(spark: SparkSession, path: str, columns: list[str], after: list | None, size: int) -> DataFrame:
    """The ``size`` groups after a cursor: only the files that hold them are read, mostly one."""
    files = spark.read.parquet(f"{path}/files")
    if after is not None:
        files = files.where(_beyond([F.col("high")[c] for c in columns], after))
    chosen, sure = [], 0
    # a row for each file, in the order of the keys; they stop as soon as the page is full
    for row in files.orderBy("low").toLocalIterator():
        chosen.append(row["file"])
        # what the first file has beyond the cursor is not known
        sure += row["n"] if after is None or len(chosen) > 1 else 0
        if sure >= size:
            break
    groups = spark.read.parquet(f"{path}/groups")
    page = spark.read.schema(groups.schema).parquet(*chosen) if chosen else groups.limit(0)
    return (page if after is None else page.where(_beyond([F.col(c) for c in columns], after))).orderBy(*columns).limit(size)


def distinct_sketches(rows: DataFrame, columns: list[str], part: str, precision: int = 14) -> DataFrame:
    """``part``, ``column`` and ``sketch``: a sketch of the distinct values of each column in each part of the data.

    Sketches of parts are kept and merged by :func:`merged_cardinality`, so that new parts need no second reading of the
    old ones.  Each value of a multi-valued column counts; nulls are no values.  ``precision`` 14 is a standard error of
    0.8 %, in 16 KiB at most.
    """
    kinds = dict(rows.dtypes)
    each = [F.struct(F.lit(c).alias("column"), (F.transform(c, lambda x: x.cast("string")) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))).alias("values")) for c in columns]
    values = rows.select(F.col(part).alias("part"), F.explode(F.array(*each)).alias("e")).select("part", "e.column", F.explode("e.values").alias("value"))
    return values.where("value is not null").groupBy("part", "column").agg(F.hll_sketch_agg("value", precision).alias("sketch"))


def merged_cardinality(sketches: DataFrame) -> DataFrame:
    """``column`` and the estimate ``n`` of its distinct values over the parts given, from their sketches alone."""
    return sketches.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def cardinality(rows: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Distinct values of each column: approximate, or exact."""
    count = F.countDistinct if exact else F.approx_count_distinct
    return rows.agg(*(count(c).alias(c) for c in columns))


def aggregate(people: DataFrame, request: SearchRequest, after: list | None = None) -> DataFrame:
    """The aggregation that a request names, over its matches."""
    rows = search(people, request)
    columns = [SORT_COLUMNS[x] for x in request.aggs]
    if len(columns) == 1 and request.aggs[0] in DATES:
        return months(rows, columns[0])
    if len(columns) == 1 and request.aggs[0] in TERMS:
        return terms(rows, columns[0], request.aggs_size)
    return composite(rows, columns, after)


def all_groups(people: DataFrame, request: SearchRequest) -> DataFrame:
    """Every group of an aggregation, beyond any page: what its CSV and JSON sinks write."""
    rows = search(people, request)
    columns = [SORT_COLUMNS[x] for x in request.aggs]
    return months(rows, columns[0]) if len(columns) == 1 and request.aggs[0] in DATES else composite(rows, columns)


def summary(people: DataFrame, request: SearchRequest) -> DataFrame:
    """One row: the total of hits of a request, and the number of buckets of its aggregation, whatever its page."""
    total = search(people, request).agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(all_groups(people, request).agg(F.count(F.lit(1)).alias("buckets")))  # of one row each
