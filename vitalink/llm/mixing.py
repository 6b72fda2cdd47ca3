"""Mixing overlapping sources to target weights as a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them), so the network has a node for each
pattern and each source, not for each document.  A pattern offers its words once at no cost, a second time at cost 1,
a third time at cost 2 ...: a convex price of repetition.  The flow fills the sources' quotas at the least total
repetition.  Documents of a pattern are then taken whole, in a seeded order, up to the words routed from it.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

BUCKET_ROWS = 10_000  # documents of a bucket, about, if all had one pattern


def cycle_weights(sources: list[str | None], cycle: tuple[float, ...] = (5, 2, 1)) -> dict[str | None, float]:
    """Weights 5, 2, 1, 5, ... of the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: cycle[k % len(cycle)] for k, s in enumerate(ordered)}


def water_fill(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Targets in proportion to the weights that sum to ``share`` of all sizes, none above ``most`` times its source's size."""
    total = share * sum(sizes.values())
    order = sorted(sizes, key=lambda s: (most * sizes[s] / weights[s], s is None, s or ""))
    capped, weight, out = 0.0, float(sum(weights[s] for s in sizes)), {}
    level = None
    for s in order:
        if level is None:
            now = (total - capped) / weight
            if now * weights[s] > most * sizes[s]:
                out[s] = float(most * sizes[s])
                capped += most * sizes[s]
                weight -= weights[s]
                continue
            level = now
        out[s] = level * weights[s]
    return out


def min_cost_flow(supply: dict[tuple, int], quota: dict, most: int) -> dict[tuple, dict]:
    """Words routed from each pattern to each of its sources, by successive cheapest augmenting paths.

    ``supply`` has the size of each pattern (a tuple of sources); a pattern can be taken ``most`` times.
    """
    start, end = ("start",), ("end",)
    arcs: dict[tuple, list[list]] = {start: [], end: []}

    def arc(a, b, room, cost):
        there, back = [b, room, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        arcs.setdefault(a, []).append(there)
        arcs.setdefault(b, []).append(back)
        return there

    routes = []
    for p, size in supply.items():
        for again in range(most):
            arc(start, ("pattern", p), size, again)
        routes += [(p, s, arc(("pattern", p), ("source", s), most * size, 0)) for s in p]
    for s, room in quota.items():
        arc(("source", s), end, room, 0)
    while True:
        cost, via, queue, waiting = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for x in arcs[a]:
                if x[1] > 0 and cost[a] + x[2] < cost.get(x[0], float("inf")):
                    cost[x[0]], via[x[0]] = cost[a] + x[2], x
                    if x[0] not in waiting:
                        queue.append(x[0])
                        waiting.add(x[0])
        if end not in via:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = via[at][3][0]
        room = min(x[1] for x in path)
        for x in path:
            x[1] -= room
            x[3][1] += room
    out: dict[tuple, dict] = {p: {} for p in supply}
    for p, s, x in routes:
        out[p][s] = x[3][1]
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | Column = "source",
    weights: Callable[[list], dict] = cycle_weights,
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix-1",
    most_patterns: int = 20_000,
    carry: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, times: one row for each row of ``docs``.

    With ``carry`` each row also has ``row``, a struct of all its columns, so that nothing need be joined back.

    ``source_col`` is a string or an array of strings (the sources that hold the document); null is a source of its
    own.  size counts words, 0 for null and blank texts.  source_size and target are of the document's source (of the
    first in order, if there are several); taken is ``times`` (0 .. ``most``) times the size.  Documents come in the
    order of md5(seed, id), so reruns agree; of an epoch's words a document is taken if over half of it fits.  Rows of
    equal id have equal order and are told apart by size, then text.  The table of patterns is collected: over ``most_patterns``
    of them are refused with an error.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    source = F.col(source_col) if isinstance(source_col, str) else source_col
    kind = docs.select(source.alias("s")).schema["s"].dataType.typeName()
    members = F.coalesce(F.array_sort(F.array_distinct(source)), F.expr("array(cast(null as string))")) if kind == "array" else F.array(source)
    rank = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    fields = [
        F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"), F.to_json(members).alias("pattern"), rank.alias("rank"),
        F.xxhash64(F.col(text_col)).alias("own"),
    ]
    rows = cut(docs.select(*fields))
    digits = max(2, math.ceil(math.log(rows.count() / BUCKET_ROWS + 1, 16)))
    bucket = F.substring("rank", 1, digits)
    rows = rows.withColumn("bucket", bucket)
    buckets = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    found = buckets.groupBy("pattern").agg(F.sum("words").alias("words")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"over {most_patterns} membership patterns")
    supply = {tuple(json.loads(r["pattern"]) if r["pattern"] else [None]): r["words"] for r in found}
    names = {tuple(json.loads(r["pattern"]) if r["pattern"] else [None]): r["pattern"] for r in found}
    sizes: dict = {}
    for p, words in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    targets = water_fill(sizes, weights(list(sizes)), share, most)
    flow = min_cost_flow(supply, {s: round(t) for s, t in targets.items()}, most)
    plan = []
    for p, words in supply.items():
        routed = sum(flow[p].values())
        lead = p[0] if p else None
        plan.append((names[p], sizes.get(lead, 0), targets.get(lead, 0.0), [min(words, max(0, routed - k * words)) for k in range(most)]))
    amounts = spark.createDataFrame(plan, "pattern string, source_size long, target double, epochs array<long>")

    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("pattern", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"))
    if carry:
        rows = docs.select(*fields, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("bucket", bucket)
    within = Window.partitionBy("pattern", "bucket").orderBy("rank", "doc_id", "size", "own").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["pattern", "bucket"])
    # at most most_patterns rows
    placed = placed.join(F.broadcast(amounts), "pattern", "left").withColumn("middle", 2 * (F.col("before") + F.col("inner")) + F.col("size"))
    times = F.size(F.filter("epochs", lambda a: (F.col("size") > 0) & (F.col("middle") <= 2 * a)))
    return placed.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.alias("times"), *(["row"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, with all their columns (see :func:`mix`)."""
    taken = mix(docs, carry=True, **options).where("times > 0")
    return taken.select(F.explode(F.expr("array_repeat(row, times)")).alias("row")).select("row.*")


#: The result of :func:`mix` over the documents table, for DuckDB.
ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, md5('mix-1:' || doc_id) AS rank,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k
  FROM weighed
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT k, level FROM filled WHERE level * w <= 2 * source_size ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN f.k < s.k THEN 2.0::DOUBLE * source_size ELSE s.level * w END AS target
  FROM filled f CROSS JOIN stop s),
amounts AS (
  SELECT *, least(source_size, round_even(target, 0)::BIGINT) AS once,
         greatest(0, round_even(target, 0)::BIGINT - source_size) AS twice
  FROM targets),
placed AS (
  SELECT r.*, t.source_size, t.target, t.once, t.twice,
         2 * (sum(size) OVER (PARTITION BY r.source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) - size) + size AS middle
  FROM rows r JOIN amounts t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * ((size > 0 AND middle <= 2 * once)::INT + (size > 0 AND middle <= 2 * twice)::INT))::BIGINT AS taken
FROM placed
"""
