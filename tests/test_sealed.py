"""Sealed tables: round trip, nothing readable in the files or the plan, other keys and altered cells refused."""

import datetime
import glob
import io
from contextlib import redirect_stdout
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitalink.sources import sealed

ROWS = [
    (1, "Élise, \"de\"\nla Tour", 0.1, Decimal("12.34"), datetime.date(1900, 1, 1), datetime.datetime(2020, 5, 4, 3, 2, 1, 123456), bytearray(b"\x00\xff"), ["a", None]),
    (2, "", float("inf"), None, None, None, bytearray(), []),
    (2, "", float("inf"), None, None, None, bytearray(), []),
    (None,) * 8,
    (3, "pompidou" * 20_000, -0.0, Decimal("0.00"), datetime.date(1, 1, 1), None, None, None),
]
SCHEMA = "n long, `full name` string, x double, d decimal(9,2), day date, at timestamp, raw binary, words array<string>"


@pytest.fixture()
def kept(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    sealed.new_key(spark, f"{tmp_path}/key")
    sealed.write_sealed(rows, f"{tmp_path}/out", f"{tmp_path}/key")
    return rows


def test_round_trip(spark, tmp_path, kept):
    back = sealed.read_sealed(spark, f"{tmp_path}/out", f"{tmp_path}/key", kept.schema)
    assert back.schema == kept.schema and sorted(map(repr, back.collect())) == sorted(map(repr, kept.collect()))
    sealed.write_sealed(kept.limit(0), f"{tmp_path}/none", f"{tmp_path}/key")
    assert sealed.read_sealed(spark, f"{tmp_path}/none", f"{tmp_path}/key", kept.schema).count() == 0


def test_nothing_can_be_read_without_the_key(spark, tmp_path, kept):
    files = b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/out/*.parquet"))
    assert b"pompidou" not in files and b"full name" not in files
    cells = [bytes(r.cell) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(set(cells)) == len(ROWS)  # equal rows, different cells
    secret = open(f"{tmp_path}/key", "rb").read()
    back = sealed.read_sealed(spark, f"{tmp_path}/out", f"{tmp_path}/key", kept.schema)
    text = io.StringIO()
    with redirect_stdout(text):
        back.explain("extended")
    assert len(secret) == 32 and secret.hex() not in text.getvalue().lower()
    sealed.new_key(spark, f"{tmp_path}/other")
    with pytest.raises(Exception, match="AES"):
        sealed.read_sealed(spark, f"{tmp_path}/out", f"{tmp_path}/other", kept.schema).collect()
    altered = F.concat(F.expr("substring(cell, 1, length(cell) - 1)"), F.lit(bytearray(b"?")))
    spark.read.parquet(f"{tmp_path}/out").select(altered.alias("cell")).write.parquet(f"{tmp_path}/altered")
    with pytest.raises(Exception, match="AES"):
        sealed.read_sealed(spark, f"{tmp_path}/altered", f"{tmp_path}/key", kept.schema).collect()


def test_keys_and_names_are_checked(spark, tmp_path, kept):
    with pytest.raises(Exception, match="exist"):
        sealed.new_key(spark, f"{tmp_path}/key")
    (tmp_path / "short").write_bytes(b"0123456789abcdef")
    with pytest.raises(Exception, match="32 bytes"):
        sealed.write_sealed(kept, f"{tmp_path}/x", f"{tmp_path}/short")
    with pytest.raises(ValueError, match="differ"):
        sealed.write_sealed(spark.range(1).select("id", F.col("id").alias("ID")), f"{tmp_path}/y", f"{tmp_path}/key")
