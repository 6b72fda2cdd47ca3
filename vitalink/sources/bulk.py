"""Bulk files: CSV in, CSV and JSON out, with the caller's own columns mapped to request fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Result columns of a linked row, in order, and where they are in the nested person.
RESULT_COLUMNS = (
    "score", "scores", "source", "id", "name.first", "name.last", "name.legal", "sex", "birth.date", "birth.location.city", "birth.location.cityCode",
    "birth.location.departmentCode", "birth.location.country", "birth.location.countryCode", "birth.location.latitude", "birth.location.longitude",
    "death.date", "death.certificateId", "death.age", "death.location.city", "death.location.cityCode", "death.location.departmentCode",
    "death.location.country", "death.location.countryCode", "death.location.latitude", "death.location.longitude", "links.wikidata",
)
#: Result columns that go in front of the input column mapped to a field, when columns are interleaved.
BESIDE = {"firstName": "name.first", "lastName": "name.last", "sex": "sex", "birthDate": "birth.date", "birthCity": "birth.location.city", "deathDate": "death.date", "deathCity": "death.location.city"}


def charset(name: str) -> str:
    """Java's name of a charset, as users write them."""
    low = name.lower().replace("_", "-")
    return "windows-" + low[3:].lstrip("-") if low.startswith("win") and not low.startswith("windows") else {"utf8": "UTF-8", "latin1": "ISO-8859-1"}.get(low, name)


class HeaderMismatch(ValueError):
    """A row has more or fewer columns than the header."""


def read_csv(spark: SparkSession, path: str, sep: str = ",", quote: str | None = '"', escape: str = '"', encoding: str = "utf8", skip_lines: int = 0, ignore_empty: bool = True, multi_line: bool | None = None) -> DataFrame:
    """All columns as strings, and ``sourceLineNumber`` from 1.

    Lines may end in CR, LF or both.  The first ``skip_lines`` lines go; the next one is the header.  A row that is
    longer than the header raises HeaderMismatch when it is read; a shorter one has nulls.  Lines are numbered in the
    order of the files without sorting: by partition, then within it.

    With ``multi_line`` quoted cells may hold line ends; each file is then one task, and empty lines always go.  By
    default this is so where some line has an odd number of quotes: one pass more, which ends at the first such line.
    Skipped lines and the header end at their first line end.
    """
    quote = None if quote == "null" else quote
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", charset(encoding)).alias("t")) if charset(encoding) != "UTF-8" else None
    if raw is None:
        lines = spark.read.text(path).select(F.explode(F.split("value", "\r")).alias("line"))
    else:
        lines = raw.select(F.explode(F.split("t", "\r\n|\r|\n")).alias("line"))
    lines = lines.withColumn("_n", F.monotonically_increasing_id())
    if ignore_empty:
        lines = lines.where(F.length(F.trim("line")) > 0)
    head = [r["line"] for r in lines.orderBy("_n").limit(skip_lines + 1).collect()]
    if len(head) <= skip_lines:
        return spark.createDataFrame([], "sourceLineNumber long")
    last = lines.orderBy("_n").limit(skip_lines + 1).agg(F.max("_n")).first()[0]
    options = {"sep": sep, "escape": escape, "mode": "PERMISSIVE"} | ({"quote": quote} if quote else {"quote": ""})
    names = _header(head[-1].lstrip("﻿"), sep, quote)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_too_long", T.StringType())])
    if multi_line is None:
        multi_line = bool(quote) and not lines.where(F.length(F.regexp_replace("line", f"[^{_in_class(quote)}]", "")) % 2 == 1).isEmpty()
    if multi_line:
        records = spark.read.schema(schema).options(**options, multiLine=True, encoding=charset(encoding), enforceSchema=True).csv(path).withColumn("_n", F.monotonically_increasing_id())
        last = records.orderBy("_n").limit(skip_lines + 1).agg(F.max("_n")).first()[0]
        whole = F.struct(*(F.col(f"`{f.name}`") for f in schema.fields))
        rows = records.where(F.col("_n") > last).select("_n", F.concat_ws(sep, *(F.col(f"`{n}`") for n in names)).alias("line"), whole.alias("r"))
    else:
        rows = lines.where(F.col("_n") > last).select("_n", "line", F.from_csv("line", _ddl(schema), options).alias("r"))
    wrong = F.raise_error(F.concat(F.lit("column header mismatch: "), F.col("line")))
    rows = rows.withColumn("r", F.when(F.col("r._too_long").isNotNull(), wrong.cast(schema)).otherwise(F.col("r")))
    counts = rows.groupBy(F.shiftright("_n", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row for each partition
    within = Window.partitionBy("part").orderBy("_n")
    numbered = rows.withColumn("part", F.shiftright("_n", 33)).withColumn("k", F.row_number().over(within)).join(F.broadcast(before), "part")
    return numbered.select(*(F.col("r").getField(n).alias(n) for n in names), (F.col("before") + F.col("k")).cast("long").alias("sourceLineNumber"))


def _in_class(char: str) -> str:
    return "\\" + char if char in r"\]^-[&" else char


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` string" for f in schema.fields)


def _header(line: str, sep: str, quote: str | None) -> list[str]:
    import csv

    names = next(csv.reader([line], delimiter=sep, quotechar=quote)) if quote else line.split(sep)
    return [n.strip() or f"column{k}" for k, n in enumerate(names, 1)]


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a file, whichever way they end."""
    return int(spark.read.text(path).select(F.size(F.split(F.regexp_replace("value", "\r$", ""), "\r")).alias("n")).agg(F.sum("n")).first()[0] or 0)


def map_columns(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Request fields from the caller's columns, all input columns as the map ``source``.  Unmapped names stay fields."""
    fields = {mapping.get(c, c): c for c in rows.columns if c != "sourceLineNumber"}
    source = F.create_map(*(x for c in rows.columns if c != "sourceLineNumber" for x in (F.lit(c), F.col(f"`{c}`"))))
    return rows.select(source.alias("source"), "sourceLineNumber", *(F.col(f"`{c}`").alias(f) for f, c in fields.items()))


def column_order(inputs: list[str], mapping: dict[str, str], interleave: bool = False) -> list[str]:
    """Names of the output columns: inputs, line number, results; or each result in front of the input it answers."""
    if not interleave:
        return [*inputs, "sourceLineNumber", *RESULT_COLUMNS]
    front: list[str] = []
    for c in inputs:
        beside = BESIDE.get(mapping.get(c, c))
        front += [beside, c] if beside else [c]
    return [*front, "sourceLineNumber", *(c for c in RESULT_COLUMNS if c not in front)]


def as_text(column: Column, kind: T.DataType) -> Column:
    """A value as the text of a cell: '' for null, arrays joined by a comma, records as JSON."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.coalesce(F.array_join(column, ", "), F.lit(""))
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.coalesce(F.to_json(column), F.lit(""))
    return F.coalesce(column.cast("string"), F.lit(""))


def type_of(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a path ``a.b.c`` of nested records; None if the table does not have it."""
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def cells(rows: DataFrame, names: list[str], matched: Column | None = None) -> DataFrame:
    """The named columns (nested ones by path) as texts, blank for those that the table does not have.

    The result's sex is blank where nothing matched.
    """
    out = []
    for name in names:
        if name in rows.columns:
            text = as_text(F.col(f"`{name}`"), rows.schema[name].dataType)
        elif (kind := type_of(rows.schema, name)) is not None:
            text = as_text(F.col(name), kind)
        else:
            text = F.lit("")
        if name == "sex" and matched is not None:
            text = F.when(matched, text).otherwise("")
        out.append(text.alias(name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str, sep: str = ",", codec: str | None = None) -> None:
    rows.write.option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "").option("compression", codec or "none").mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str, codec: str | None = None) -> None:
    rows.write.option("compression", codec or "none").mode("overwrite").json(path)


def json_records(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The JSON export as one text column: a record with header and mapping first, then a record for each row."""
    import json

    head = json.dumps({"header": rows.columns, "mapping": mapping})
    first = rows.sparkSession.createDataFrame([(head,)], "record string").coalesce(1)
    # the parts of a union are written in their order: no sort, the rows stay where they are
    return first.union(rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("record")))


HEADERS = {
    "en": {"uid": "id", "last": "last name", "first": "first name", "sex": "sex", "birth_date": "birth date", "birth_city": "birth city", "birth_country": "birth country", "death_date": "death date", "death_age": "death age", "source": "source"},
    "fr": {"uid": "identifiant", "last": "nom", "first": "prénom", "sex": "sexe", "birth_date": "date de naissance", "birth_city": "commune de naissance", "birth_country": "pays de naissance", "death_date": "date de décès", "death_age": "âge de décès", "source": "source"},
}


class TooManyRows(ValueError):
    """An export above its limit."""


def export(rows: DataFrame, language: str = "en", limit: int | None = None) -> DataFrame:
    """A search result for CSV: dates as dd/MM/yyyy, a header in English or French; all rows, or refused from ``limit`` rows on."""
    from ..functions.dates import to_french

    if limit is not None and rows.limit(limit).count() >= limit:
        raise TooManyRows(f"{limit} rows or more")
    names = HEADERS[language]
    return rows.select(*((to_french(F.col(c)) if c.endswith("_date") else F.col(c)).alias(n) for c, n in names.items() if c in rows.columns and c != "uid"))
