"""CSV files whose quoted cells hold line ends, and the order of the JSON export."""

import json

import pytest
from pyspark.sql import functions as F

from vitalink.sources import bulk


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("encoding", ["utf8", "latin1"])
def test_line_ends_within_quotes(spark, tmp_path, end, encoding):
    lines = ["skipped", 'a,"b",c', '1,"x' + "\n" + 'y ""z""",é', "", "2,w,", '3,"' + "\n\n" + '",v']
    # a cell's own line ends are of the file's kind
    (tmp_path / "f.csv").write_bytes(end.join(x.replace("\n", end) for x in lines).encode("utf-8" if encoding == "utf8" else encoding))
    rows = bulk.read_csv(spark, str(tmp_path / "f.csv"), encoding=encoding, skip_lines=1).orderBy("sourceLineNumber").collect()
    assert [r.a for r in rows] == ["1", "2", "3"] and [r.sourceLineNumber for r in rows] == [1, 2, 3]
    assert rows[0].b.split() == ["x", "y", '"z"'] and "y" not in rows[0].b.split("\n")[0].split("\r")[0] and rows[0].c == "é" and rows[2].c == "v"


def test_odd_quotes_in_plain_cells_and_long_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n5" pipe,1\nz,2\n')
    rows = bulk.read_csv(spark, str(tmp_path / "f.csv")).orderBy("sourceLineNumber").collect()
    assert [(r.a, r.b) for r in rows] == [('5" pipe', "1"), ("z", "2")]
    (tmp_path / "g.csv").write_text('a,b\n"1\n2",3,4\n')
    with pytest.raises(Exception, match="column header mismatch"):
        bulk.read_csv(spark, str(tmp_path / "g.csv")).collect()


def test_json_records_start_with_the_header_and_keep_their_partitions(spark, tmp_path):
    rows = spark.range(0, 100, 1, 5)
    records = bulk.json_records(rows, {"id": "uid"})
    assert records.rdd.getNumPartitions() == 6
    records.write.text(str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    lines = [json.loads(x) for p in parts for x in p.read_text().splitlines()]
    assert lines[0] == {"header": ["id"], "mapping": {"id": "uid"}} and [x["id"] for x in lines[1:]] == list(range(100))


def test_export_of_more_rows_than_the_reference_pages(spark):
    """Without a limit of the caller's a table of 500,000 rows and more is exported whole."""
    rows = spark.range(500_001).select(F.col("id").alias("uid"), F.lit("bolt").alias("last"), F.lit("19691101").alias("birth_date"))
    out = bulk.export(rows)
    assert out.count() == 500_001 and out.first()["birth date"] == "01/11/1969"
