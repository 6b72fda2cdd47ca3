"""Person and request views over the benchmark tables, defined alike for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERSONS_SQL = """
persons AS (
  SELECT o.o_orderkey AS uid, split_part(p.p_name, ' ', 1) AS first, split_part(p.p_name, ' ', 2) AS last,
         lower(p.p_type) AS second_name, CASE WHEN o.o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
         strftime(o.o_orderdate, '%Y%m%d') AS birth_date,
         strftime(o.o_orderdate::DATE + (o.o_orderkey % 2000)::INT, '%Y%m%d') AS death_date,
         p.p_size AS death_age, n.n_name AS birth_country, c.c_mktsegment AS birth_city,
         lpad(c.c_nationkey::VARCHAR, 2, '0') AS birth_department,
         lpad(c.c_nationkey::VARCHAR, 2, '0') || lpad((o.o_custkey % 1000)::VARCHAR, 3, '0') AS birth_code,
         year(o.o_orderdate)::VARCHAR AS source,
         42.0::DOUBLE + (o.o_custkey % 800) / 100.0::DOUBLE AS lat, -4.0::DOUBLE + (o.o_custkey % 1200) / 100.0::DOUBLE AS lon
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN part p ON p.p_partkey = (o.o_orderkey * 7 + o.o_custkey) % 200),
requests AS (
  SELECT uid AS qid,
         CASE WHEN uid // 50 % 4 = 2 THEN last ELSE first END AS first_q,
         CASE uid // 50 % 4 WHEN 1 THEN left(last, length(last)::BIGINT - 1) WHEN 2 THEN first ELSE last END AS last_q,
         sex AS sex_q,
         CASE WHEN uid // 50 % 4 = 3 THEN left(birth_date, 7) || ((right(birth_date, 1)::INT + 1) % 10)::VARCHAR ELSE birth_date END AS birth_q
  FROM persons WHERE uid % 50 = 0)
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in names]


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: a person of the flat shape."""
    orders, customer, nation, part = tables(spark, sf_dir, "orders", "customer", "nation", "part")
    rows = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.join(part, F.col("p_partkey") == (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 200)
    day = F.to_date("o_orderdate")
    key = F.col("o_custkey")
    return rows.select(
        F.col("o_orderkey").alias("uid"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("last"),
        F.lower("p_type").alias("second_name"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
        F.date_format(day, "yyyyMMdd").alias("birth_date"),
        F.date_format(F.date_add(day, (F.col("o_orderkey") % 2000).cast("int")), "yyyyMMdd").alias("death_date"),
        F.col("p_size").alias("death_age"),
        F.col("n_name").alias("birth_country"),
        F.col("c_mktsegment").alias("birth_city"),
        _two(F.col("c_nationkey")).alias("birth_department"),
        F.concat(_two(F.col("c_nationkey")), F.lpad((key % 1000).cast("string"), 3, "0")).alias("birth_code"),
        F.year(day).cast("string").alias("source"),
        (F.lit(42.0) + (key % 800) / F.lit(100.0)).alias("lat"),
        (F.lit(-4.0) + (key % 1200) / F.lit(100.0)).alias("lon"),
    )


def requests(people: DataFrame) -> DataFrame:
    """Every fiftieth person, corrupted by rule: untouched, last name cut, names swapped, or a digit of the date changed."""
    kind = F.floor(F.col("uid") / 50) % 4
    last = F.col("last")
    changed = F.concat(F.left("birth_date", F.lit(7)), ((F.right("birth_date", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return people.where("uid % 50 = 0").select(
        F.col("uid").alias("qid"),
        F.when(kind == 2, last).otherwise(F.col("first")).alias("first_q"),
        F.when(kind == 1, F.left(last, F.length(last) - 1)).when(kind == 2, F.col("first")).otherwise(last).alias("last_q"),
        F.col("sex").alias("sex_q"),
        F.when(kind == 3, changed).otherwise(F.col("birth_date")).alias("birth_q"),
    )


def nested(p: str = "", code: str | None = None) -> Column:
    """The nested person of the flat columns (with a prefix), as JSON; ``code`` is a column with the country's code."""
    c = lambda x: F.col(p + x)
    place = F.struct(c("birth_city").alias("city"), c("birth_code").alias("code"), c("birth_department").alias("departmentCode"), c("birth_country").alias("country"), c("lat").alias("latitude"), c("lon").alias("longitude"), *([c(code).alias("countryCode")] if code else []))
    return F.to_json(F.struct(
        F.struct(F.array(c("first"), c("second_name")).alias("first"), c("last").alias("last")).alias("name"), c("sex").alias("sex"),
        F.struct(c("birth_date").alias("date"), place.alias("location")).alias("birth"), F.struct(c("death_date").alias("date")).alias("death"),
    ))
