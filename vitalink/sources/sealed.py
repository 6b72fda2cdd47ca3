"""Sealed tables: rows as AES-256 cells in Parquet, the key in a file of its own and never in a plan."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_BYTES = 32
#: Microseconds and the zone, so that times come back as they were.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def new_key(spark: SparkSession, path: str) -> None:
    """A random key in a new file, which only its owner may read; an existing file is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = files.create(place, False)
    try:
        files.setPermission(place, hadoop.permission.FsPermission("600"))
        out.write(bytearray(secrets.token_bytes(KEY_BYTES)))
    finally:
        out.close()


def _key(spark: SparkSession, path: str) -> Column:
    """The key as the result of a subquery: executors get it, and plans, their texts and event logs show its file only."""
    content = F.col("content")
    checked = F.when(F.length(content) == KEY_BYTES, content).otherwise(F.raise_error(F.lit(f"a key has {KEY_BYTES} bytes")).cast("binary"))
    return spark.read.format("binaryFile").load(path).select(checked).scalar()


def write_sealed(rows: DataFrame, path: str, key: str) -> None:
    """Each row as one cell, sealed under a random vector of its own; nulls, repeated and empty rows come back as they were.

    The mode (GCM) tells a wrong key and altered cells.  Column names must differ.  Files of shuffles and spills are
    Spark's; ``spark.io.encryption.enabled`` seals those.
    """
    if len({c.lower() for c in rows.columns}) < len(rows.columns):
        raise ValueError("column names must differ")
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), _JSON)
    rows.select(F.aes_encrypt(text.cast("binary"), _key(rows.sparkSession, key), F.lit("GCM")).alias("cell")).write.parquet(path)


def read_sealed(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """The rows of :func:`write_sealed`; fails where the key is another or a cell was altered."""
    text = F.aes_decrypt("cell", _key(spark, key), F.lit("GCM")).cast("string")
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    rows = spark.read.schema("cell binary").parquet(path).select(F.from_json(text, nullable, {**_JSON, "mode": "FAILFAST"}).alias("r"))
    return rows.select(*(F.col("r").getField(f.name).alias(f.name) for f in schema.fields))
