"""Bulk linkage of files that arrive: each micro-batch is linked like a batch and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.blend import Params
from ..operators.link import link
from ..sources.stage import drop
from .jobs import beside, renamed


def link_stream(spark: SparkSession, source: str, schema: str, people: DataFrame, person_json: Column, out: str, checkpoint: str, params: Params = Params(), prepare: Callable[[DataFrame], DataFrame] | None = None, files_per_trigger: int = 8) -> StreamingQuery:
    """Link CSV files of requests (qid, first_q, last_q, sex_q, birth_q) as they come into a folder.

    ``prepare`` maps other columns to these.  Each batch goes to a folder of its own number, which a repeated batch
    replaces, so that every request is written once; the folder appears when the batch is whole, whether the query is
    stopped, fails or ends.  Runs until stopped; processes what is there, then ends.
    """
    stream = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        part = beside(f"{out}/batch={number}")
        try:
            link(rows, people, person_json, params).write.parquet(part)
            renamed(spark, part, f"{out}/batch={number}")
        finally:
            drop(spark, part)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
