"""Reference data: the flat index, communes, wiki links, the log of corrections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalized

_EVENTS = (("NAISSANCE", "birth"), ("DECES", "death"))


def point(text: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of ``POINT (lon lat)``; null where it is none."""
    number = r"(-?\d+(?:\.\d+)?)"
    cut = lambda k: F.regexp_extract(text, rf"^POINT\s*\(\s*{number}\s+{number}\s*\)$", k)
    value = lambda k: F.when(cut(k) != "", cut(k).cast("double"))
    return value(2), value(1)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The flat index; raw columns for grouping are lower case (folding of accents there is an assumption)."""
    return with_raw(spark.read.parquet(path))


def with_raw(rows: DataFrame, *columns: str) -> DataFrame:
    names = columns or tuple(c for c in ("NOM", "PRENOM", "COMMUNE_NAISSANCE", "COMMUNE_DECES", "PAYS_NAISSANCE", "PAYS_DECES") if c in rows.columns)
    return rows.withColumns({f"{c}_raw": normalized(F.col(c)) for c in names})


def nest(rows: DataFrame) -> DataFrame:
    """Nested persons of the flat index: first names split at single spaces, places as records, points as numbers."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    events = {}
    for suffix, event in _EVENTS:
        lat, lon = point(has(f"GEOPOINT_{suffix}"))
        place = F.struct(
            has(f"COMMUNE_{suffix}").alias("city"), has(f"CODE_INSEE_{suffix}").alias("code"), has(f"CODE_INSEE_{suffix}_HISTORIQUE").alias("codeHistory"),
            has(f"CODE_POSTAL_{suffix}").alias("codePostal"), has(f"DEPARTEMENT_{suffix}").alias("departmentCode"), has(f"PAYS_{suffix}").alias("country"),
            has(f"PAYS_{suffix}_CODEISO3").alias("countryCode"), lat.alias("latitude"), lon.alias("longitude"),
        )
        more = [has("NUM_DECES").alias("certificateId"), has("AGE_DECES").alias("age")] if event == "death" else []
        events[event] = F.struct(has(f"DATE_{suffix}").alias("date"), *more, place.alias("location"))
    name = F.struct(F.split(F.coalesce(has("PRENOMS"), F.lit("")), " ").alias("first"), has("NOM").alias("last"))
    return rows.select(has("UID").alias("id"), has("SOURCE").alias("source"), has("SOURCE_LINE").alias("sourceLine"), name.alias("name"), has("SEXE").alias("sex"), *(c.alias(k) for k, c in events.items()))


def _city_names(labels: pd.Series) -> pd.Series:
    from ..functions.places import city_name

    return labels.map(city_name)


def communes(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lon, code, surface of a GeoJSON of communes: the mean of all vertices of a feature; the last of a name wins."""
    raw = spark.read.option("multiLine", True).json(path).select(F.posexplode("features").alias("k", "f"))
    properties = raw.schema["f"].dataType["properties"].dataType.fieldNames()
    optional = lambda c: F.col(f"f.properties.{c}").cast("string") if c in properties else F.lit(None).cast("string")
    numbers = F.regexp_extract_all(F.to_json("f.geometry.coordinates"), F.lit(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0))
    rows = raw.select("k", F.col("f.properties.nom").alias("label"), optional("code").alias("code"), optional("surface").alias("surface"), numbers.alias("n"))
    mean = lambda odd: F.aggregate(F.filter("n", lambda x, i: i % 2 == odd), F.lit(0.0), lambda s, x: s + x.cast("double")) / (F.size("n") / 2)
    named = rows.select("k", F.pandas_udf(_city_names, "string")("label").alias("name"), mean(1).alias("lat"), mean(0).alias("lon"), "code", "surface")
    return named.groupBy("name").agg(F.max_by(F.struct("lat", "lon", "code", "surface"), "k").alias("v")).select("name", "v.*")


def commune_dictionary(table: DataFrame, most: int = 100_000) -> dict:
    """The communes as a dictionary for comparisons.  The list of a country's communes is bounded; more rows than ``most`` are refused."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} communes")
    return {r["name"]: {"lat": r["lat"], "lon": r["lon"], "code": r["code"], "surface": r["surface"]} for r in rows}


def wiki_links(spark: SparkSession, path: str) -> DataFrame:
    """id, wikidata, wikimedia, wikipedia, label from an object keyed by id."""
    links = "struct<wikidata:string,wikimedia:string,wikipedia:string,label:string>"
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"map<string,{links}>")).alias("id", "l")).select("id", "l.*")


def with_links(people: DataFrame, links: DataFrame, id_col: str = "id") -> DataFrame:
    """Persons with their links as a record, null without any.  Catalyst broadcasts the links where they are small."""
    named = links.select(F.col("id").alias("_link"), F.struct(*(c for c in links.columns if c != "id")).alias("links"))
    return people.join(named, F.col(id_col).cast("string") == F.col("_link"), "left").drop("_link")


def mask_author(address: Column) -> Column:
    """ab...yz@domain: the first and last two characters of the part before the @."""
    local = F.substring_index(address, "@", 1)
    return F.concat(F.left(local, F.lit(2)), F.lit("..."), F.right(local, F.lit(2)), F.lit("@"), F.substring_index(address, "@", -1))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """id and modifications (oldest first, authors masked) from a folder of folders, one for each id, of JSON files."""
    schema = "date string, proof string, auth string, author string, message string, review struct<date:string,status:int>, fields map<string,string>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.input_file_name())
    each = rows.select(F.element_at(F.split("file", "/"), -2).alias("id"), F.struct(F.element_at(F.split("file", "/"), -1).alias("file"), "date", "proof", "auth", mask_author(F.col("author")).alias("author"), "message", "review", "fields").alias("m"))
    return each.groupBy("id").agg(F.array_sort(F.collect_list("m"), lambda a, b: F.when(a["file"] < b["file"], -1).when(a["file"] > b["file"], 1).otherwise(0)).alias("modifications"))


def with_corrections(people: DataFrame, log: DataFrame, id_col: str = "id") -> DataFrame:
    return people.join(log.withColumnRenamed("id", "_fixed"), F.col(id_col).cast("string") == F.col("_fixed"), "left").drop("_fixed")


def corrected_only(people: DataFrame, log: DataFrame, id_col: str = "id") -> DataFrame:
    """Persons that have corrections, with these; ids without a person go."""
    return people.join(log.withColumnRenamed("id", "_fixed"), F.col(id_col).cast("string") == F.col("_fixed"), "inner").drop("_fixed")


def latest(log: DataFrame) -> DataFrame:
    """The last correction of each id."""
    each = log.select("id", F.explode("modifications").alias("m"))
    order = Window.partitionBy("id").orderBy(F.desc("m.date"), F.desc("m.file"))
    return each.withColumn("k", F.row_number().over(order)).where("k = 1").select("id", "m.*")
