"""A persisted dictionary of names: a fuzzy search reads the rows of the few words near its own, not all persons.

Two tables, both sorted, so that the statistics of their row groups let a scan skip nearly all of them: ``words`` has each
word under the hashes of its deletions (see :func:`.blocking.shortened`) with the number of its persons, ``people`` each
person once for each of its words, in order of the words.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from .blocking import shortened
from .requests import SearchRequest
from .search import auto_edits, first_names, full_text_parts, search, within_auto, words_of

#: Values of one pushed-down comparison; Spark makes ranges of longer lists by default.
_PUSHED = 10
#: Near words that are written into the scan's filter; more are joined instead.
MOST_WORDS = 1000


def build(people: DataFrame, path: str, uid: str = "uid") -> None:
    """Write the dictionary of ``people`` under ``path``.

    Rows are spread by word and id, so a name that a third of all persons bear fills many files and no single task.
    Persons without a name are in no row.
    """
    words = F.array_distinct(F.filter(words_of(F.concat_ws(" ", first_names(people), F.col("last"))), lambda w: F.length(w) > 0))
    rows = people.withColumn("_word", F.explode(words))
    rows.repartitionByRange("_word", uid).sortWithinPartitions("_word", uid).write.parquet(f"{path}/people")
    stored = people.sparkSession.read.parquet(f"{path}/people")
    counted = stored.groupBy("_word").agg(F.count(F.lit(1)).alias("n"))
    edits = F.when(F.length("_word") <= 3, 1).otherwise(2)
    keyed = counted.select(F.explode(shortened(F.col("_word"), edits)).alias("key"), F.col("_word").alias("word"), "n")
    keyed.repartitionByRange("key", "word").sortWithinPartitions("key", "word").write.parquet(f"{path}/words")


def _any_of(column: str, values: Iterable) -> Column:
    """Membership in a list, in pieces that reach the row groups as single values."""
    values = sorted(values)
    return reduce(or_, [F.col(column).isin(values[k : k + _PUSHED]) for k in range(0, len(values), _PUSHED)])


def near(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """word and n of all words of the dictionary within the edits that the length of one of ``words`` allows."""
    asked = spark.createDataFrame([(w, auto_edits(len(w))) for w in words], "w string, k int")
    keys = asked.select(F.explode(shortened(F.col("w"), F.col("k"))).alias("key")).distinct().collect()  # some 140 a word
    rows = spark.read.parquet(f"{path}/words").where(_any_of("key", [r["key"] for r in keys]))
    return rows.where(reduce(or_, [within_auto(F.col("word"), F.lit(w)) for w in words])).select("word", "n").distinct()


def needed(request: SearchRequest) -> list[list[str]]:
    """Lists of words: a match of the request has, for each of them, a word near one of it.  None if nothing is needed."""
    if request.full_text:
        names = full_text_parts(request.full_text)[1]
        lists = [[n] for n in names] if len(names) == 2 else [names]
    elif request.uid is not None or request.block:
        return []
    else:
        v = request.values  # a legal name may stand in for one of two names that must match
        lists = [] if v.get("legalName") else [[v[k]] for k in ("firstName", "lastName") if v.get(k)]
    return [words for x in lists if (words := " ".join(normalize(n) for n in x).split())]


def rows_near(spark: SparkSession, path: str, words: list[str]) -> tuple[DataFrame, int]:
    """(persons with a word near one of ``words``, once for each such word; how many such rows there are)."""
    found = near(spark, path, words)
    some = found.limit(MOST_WORDS + 1).collect()
    people = spark.read.parquet(f"{path}/people")
    if not some:
        return people.where(F.lit(False)), 0
    if len(some) > MOST_WORDS:
        return people.join(found.withColumnRenamed("word", "_word"), "_word", "left_semi"), found.agg(F.sum("n")).first()[0]
    return people.where(_any_of("_word", [r["word"] for r in some])), sum(r["n"] for r in some)


def find(people: DataFrame, path: str, request: SearchRequest, uid: str = "uid") -> DataFrame:
    """The result of :func:`.search.search`, over the dictionary where the request needs a word: the rarest of them.

    Requests that need none (a date, an id, a block, a legal name) search ``people``.  Ids must tell persons apart.
    """
    lists = needed(request)
    if not lists:
        return search(people, request)
    rows, _ = min((rows_near(people.sparkSession, path, words) for words in lists), key=lambda x: x[1])
    return search(rows.drop("_word").dropDuplicates([uid]).select(*people.columns), request)
