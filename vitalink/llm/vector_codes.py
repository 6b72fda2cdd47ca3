"""Product codes of vectors: integer Lloyd rounds with the group bounds of Yinyang k-means.

Components become integers floor(scale * x), vectors are cut into equal parts, each part position has a codebook.  A
round assigns each part to its codebook's nearest entry (ties to the lower index), then moves each entry to the floored
mean of its parts.  The entries of a codebook are clustered into a few groups; each part keeps one lower bound of its
distance to all entries of a group but its own.  After a move the bounds fall by the group's largest drift, and a group
is scanned only if its bound does not clear the exact distance to the part's own entry.  Scans are in integers, so that
ties and results are exact; bounds are floats rounded down, and a bound that comes near counts as failed.

Vectors travel in packed blocks (a row for some thousand of them) that carry assignment and bounds from round to round,
each round written to the shared folder and the one before dropped.  What a block adds to the sums of its entries is a
column of its own, summed by Spark: the driver sees codebooks only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, shared_dir


#: A block of vectors and what one round knows of it.
_STATE = "n int, ids binary, labels binary, width int, points binary, own binary, bounds binary, sums array<long>, error binary"


def limit(dim: int) -> int:
    """Integers from here on are refused, so that a row's squared distances fit 64 bits."""
    return int((2**60 / max(1, dim)) ** 0.5)


def cluster_entries(book: np.ndarray, n_groups: int, rounds: int = 8) -> np.ndarray:
    """The group of each entry of a codebook, by a small k-means from entries far apart."""
    x = book.astype(float)
    n_groups = max(1, min(n_groups, len(x)))
    seeds = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(seeds) < n_groups:
        seeds.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[seeds[-1]]) ** 2).sum(1))
    centres = x[seeds]
    group = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        group = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(n_groups):
            if (group == g).any():
                centres[g] = x[group == g].mean(0)
    return group


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared integer distances of all rows to all entries."""
    gap = x[:, None, :] - entries[None]
    return np.einsum("nkw,nkw->nk", gap, gap)


def assign(x: np.ndarray, book: np.ndarray, group: np.ndarray, own: np.ndarray | None, bounds: np.ndarray | None, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(own, squared distance, bounds, scanned): the nearest entry of each row of integers, with ties to the lower index.

    ``own`` and ``bounds`` (rows x groups) are of the round before, ``drift`` has how far each entry moved since; None in
    the first round.  ``scanned`` is the number of distances computed in scans.
    """
    n, n_groups = len(x), int(group.max()) + 1 if bounds is None else bounds.shape[1]
    members = [np.flatnonzero(group == g) for g in range(n_groups)]
    scanned = 0
    if own is None:
        every = _distances(x, book)
        own = every.argmin(1)  # the first of equals
        least = every[np.arange(n), own]
        every[np.arange(n), own] = np.iinfo(np.int64).max
        bounds = np.stack([_root_down(every[:, m].min(1)) if len(m) else np.full(n, np.inf, np.float32) for m in members], 1)
        return own, least, bounds, every.size
    fall = np.array([drift[m].max() if len(m) else 0 for m in members])
    bounds = np.nextafter((bounds - fall[None]).astype(np.float32), np.float32(-np.inf))
    gap = x - book[own]
    least = np.einsum("nw,nw->n", gap, gap)
    reach = np.sqrt(least.astype(float)) * (1 + 1e-6) + 1e-6
    before, cost = own.copy(), least.copy()
    best, own_cost = own.copy(), least.copy()
    failed = bounds <= reach[:, None]
    second = {}
    for g, m in enumerate(members):
        rows = np.flatnonzero(failed[:, g])
        if not len(rows) or not len(m):
            continue
        d = _distances(x[rows], book[m])
        scanned += d.size
        second[g] = (rows, d)
        k = d.argmin(1)
        low = d[np.arange(len(rows)), k]
        better = (low < own_cost[rows]) | ((low == own_cost[rows]) & (m[k] < best[rows]))
        best[rows[better]], own_cost[rows[better]] = m[k[better]], low[better]
    # an entry that was left behind now counts for the bound of its group
    moved = np.flatnonzero(best != before)
    left = group[before[moved]]
    bounds[moved, left] = np.minimum(bounds[moved, left], _root_down(cost[moved]))
    for g, (rows, d) in second.items():
        mine = group[best[rows]] == g
        at = np.searchsorted(members[g], best[rows[mine]])
        d[np.flatnonzero(mine), at] = np.iinfo(np.int64).max
        bounds[rows, g] = _root_down(d.min(1))
    return best, own_cost, bounds, scanned


def _root_down(squares: np.ndarray) -> np.ndarray:
    """Roots as 32-bit floats that are never above the true ones."""
    return np.nextafter(np.sqrt(squares.astype(float)).astype(np.float32), np.float32(-np.inf))


def moved(book: list[np.ndarray], sums: dict[tuple[int, int], tuple[int, list[int]]]) -> list[np.ndarray]:
    """Codebooks at the floored means of their parts; entries without a part stay."""
    out = [b.copy() for b in book]
    for (part, entry), (count, total) in sums.items():
        out[part][entry] = [x // count for x in total]
    return out


def _narrow(points: np.ndarray) -> np.ndarray:
    return points.astype("<i2") if not points.size or np.abs(points).max() < 1 << 15 else points.astype("<i4")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and nulls of a column of numbers."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


class Coder:
    """Learns codebooks and codes a table of vectors.

    Rows whose vector is null or has null or non-finite components are dropped.  Vectors of different lengths, of a length
    that ``parts`` does not divide, or with components that reach :func:`limit` / ``scale`` are refused with an error.  With
    fewer than ``entries`` vectors the codebooks are smaller.  Null ids are vectors like others, after all others.
    """

    def __init__(self, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, groups: int = 4, block: int = 4096):
        self.parts, self.entries, self.rounds, self.scale, self.groups, self.block = parts, entries, rounds, scale, groups, block

    def kept(self, vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
        """id, v (array of doubles), label of the rows that are coded."""
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
        odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.where(F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(False)))

    def first_books(self, rows: DataFrame) -> list[np.ndarray]:
        """The parts of the vectors of the smallest ids, of equal ids the smallest vectors."""
        first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(self.entries).collect()
        if not first:
            return []
        if len({len(r.v) for r in first}) > 1:
            raise ValueError(f"a vector has not {len(first[0].v)} components, as that of the smallest id")
        whole = self._integers(np.array([r.v for r in first], float).reshape(len(first), -1))
        return [np.ascontiguousarray(p) for p in np.split(whole, self.parts, 1)]

    def _integers(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] % self.parts or not x.shape[1]:
            raise ValueError(f"vectors of {x.shape[1]} components have no {self.parts} equal parts")
        x = np.floor(x * self.scale)
        if x.size and np.abs(x).max() >= limit(x.shape[1]):
            raise ValueError(f"a component reaches {limit(x.shape[1]) // self.scale}: errors might not fit 64 bits")
        return x.astype(np.int64)

    def _state(self, ids: list[bytes], n: int, points: np.ndarray, books: list[np.ndarray], groups: list[np.ndarray], old: tuple | None, drifts: list | None) -> dict:
        """A packed block after one assignment, with its sums: for each part and entry a count and the sums of components."""
        w = points.shape[1] // self.parts
        own, bounds, sums, error = [], [], [], np.zeros(n, np.int64)
        for p, (book, group) in enumerate(zip(books, groups, strict=True)):
            x = points[:, p * w : (p + 1) * w]
            mine, least, low, _ = assign(x, book, group, *((None,) * 3 if old is None else (old[0][:, p].astype(np.int64), old[1][:, p], drifts[p])))
            own.append(mine.astype(np.uint8))
            bounds.append(np.pad(low, ((0, 0), (0, self.groups - low.shape[1])), constant_values=np.inf))
            error += least
            sums.append(np.bincount(mine, minlength=len(book)))
            sums += [np.bincount(mine, x[:, k], len(book)).astype(np.int64) for k in range(w)]  # below 2^53, so exact
        narrow = _narrow(points)
        return {
            "n": n, "ids": ids[0], "labels": ids[1], "width": narrow.dtype.itemsize, "points": narrow.tobytes(), "own": np.stack(own, 1).tobytes(),
            "bounds": np.stack(bounds, 1).astype("<f4").tobytes(), "sums": np.concatenate(sums), "error": error.tobytes(),
        }

    def _packed(self, rows: DataFrame, books: list[np.ndarray], groups: list[np.ndarray]) -> DataFrame:
        dim = sum(b.shape[1] for b in books)

        def run(batches):
            for whole in batches:
                for at in range(0, len(whole), self.block):
                    batch = whole.slice(at, self.block)
                    lists = batch.column(1)
                    if not (np.diff(lists.offsets.to_numpy()) == dim).all():
                        raise ValueError(f"a vector has not {dim} components, as that of the smallest id")
                    points = self._integers(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                    key, null = _numbers(batch.column(0))
                    sink = pa.BufferOutputStream()
                    labels = pa.RecordBatch.from_arrays([batch.column(2)], names=["label"])
                    with pa.ipc.new_stream(sink, labels.schema) as out:
                        out.write_batch(labels)
                    ids = key.astype("<i8").tobytes() + np.packbits(null).tobytes()
                    yield _one(self._state([ids, sink.getvalue().to_pybytes()], len(batch), points, books, groups, None, None))

        return rows.select("id", "v", "label").mapInArrow(run, _STATE)

    def _next(self, state: DataFrame, books: list[np.ndarray], groups: list[np.ndarray], drifts: list[np.ndarray]) -> DataFrame:
        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    n = r["n"]
                    points = np.frombuffer(r["points"], f"<i{r['width']}").reshape(n, -1).astype(np.int64)
                    old = np.frombuffer(r["own"], np.uint8).reshape(n, -1), np.frombuffer(r["bounds"], "<f4").reshape(n, self.parts, -1)
                    yield _one(self._state([r["ids"], r["labels"]], n, points, books, groups, old, drifts))

        return state.select(*(x.split()[0] for x in _STATE.split(", "))).mapInArrow(run, _STATE)

    def _sums(self, state: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
        """Count and sums of each part and entry: as many numbers as the codebooks have."""
        rows = state.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        total = {r["at"]: r["x"] for r in rows}
        out, at = {}, 0
        for p, book in enumerate(books):
            k, w = book.shape
            for e in range(k):
                if total.get(at + e):
                    out[p, e] = total[at + e], [total[at + k * (1 + c) + e] for c in range(w)]
            at += k * (1 + w)
        return out

    def fit_codes(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
        """(rows, codebooks): vec_id, label (as text), code (an index for each part), error (squared distance) of each vector.

        The rows are a table in the shared folder.
        """
        spark = vectors.sparkSession
        rows = self.kept(vectors, id_col, vector_col, label_col)
        books = self.first_books(rows)
        out_schema = "vec_id long, label string, code array<int>, error long"
        if not books:
            return spark.createDataFrame([], out_schema), []
        groups = [cluster_entries(b, self.groups) for b in books]
        base = shared_dir(spark)
        state = self._packed(rows, books, groups)
        for r in range(self.rounds + 1):
            state.write.parquet(f"{base}/{r}")
            if r:
                drop_dir(spark, f"{base}/{r - 1}")
            state = spark.read.parquet(f"{base}/{r}")
            if r == self.rounds:
                break
            after = moved(books, self._sums(state, books))
            drifts = [np.sqrt(((a - b) ** 2).sum(1).astype(float)) * (1 + 1e-6) for a, b in zip(after, books, strict=True)]
            books = after
            state = self._next(state, books, groups, drifts)
        parts = self.parts

        def unpack(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    n = r["n"]
                    null = np.unpackbits(np.frombuffer(r["ids"], np.uint8, offset=8 * n), count=n).astype(bool)
                    key = pa.array(np.frombuffer(r["ids"], "<i8", n), mask=null)
                    label = pa.ipc.open_stream(r["labels"]).read_next_batch().column(0)
                    code = pa.ListArray.from_arrays(np.arange(0, n * parts + 1, parts, dtype=np.int32), np.frombuffer(r["own"], np.uint8).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([key, label.cast(pa.string()), code, pa.array(np.frombuffer(r["error"], "<i8"))], names=["vec_id", "label", "code", "error"])

        state.select("n", "ids", "labels", "own", "error").mapInArrow(unpack, out_schema).write.parquet(f"{base}/codes")
        drop_dir(spark, f"{base}/{self.rounds}")
        return spark.read.parquet(f"{base}/codes"), books


def _one(row: dict) -> pa.RecordBatch:
    kinds = {"n": pa.int32(), "width": pa.int32(), "sums": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))


def listed(books: list[np.ndarray]) -> str:
    """All components of all entries as decimals, by part, entry and position."""
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def label_errors(coded: DataFrame, most_hot: int = 2000) -> DataFrame:
    """Coded rows with label_error, the sum of error over equal labels, nulls together.

    The sums of labels with more than one in ``most_hot`` of all rows (so at most ``most_hot`` of them) are broadcast; the
    others are joined by a shuffle, in which no label weighs more than that.
    """
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label"))
    rows = coded.withColumn("_k", key)
    sums = rows.groupBy("_k").agg(F.sum("error").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    n = coded.count()
    hot = F.broadcast(sums.where(F.col("_n") * most_hot > n).select("_k", F.col("_sum").alias("_hot")))
    rest = sums.where(F.col("_n") * most_hot <= n).select(F.col("_k").alias("_key"), "_sum")
    flagged = rows.join(hot, "_k", "left")
    easy = flagged.where(F.col("_hot").isNotNull()).withColumn("label_error", F.col("_hot"))
    other = flagged.where(F.col("_hot").isNull()).join(rest, F.col("_k") == F.col("_key")).withColumn("label_error", F.col("_sum"))
    cols = [*coded.columns, "label_error"]
    return easy.select(*cols).unionByName(other.select(*cols))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same rounds in SQL."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"near{r} AS (SELECT i, p, arg_min(e, [d, e]) AS e, min(d) AS d, any_value(v) AS v FROM (SELECT x.i, x.p, x.v, b.e, "
            f"list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cells x JOIN book{r} b USING (p)) GROUP BY i, p)"
        )
        if r < rounds:
            steps.append(
                f"sums{r} AS (SELECT p, e, list(m ORDER BY k) AS v FROM (SELECT p, e, k, floor_div(sum(c), count(*)) AS m FROM (SELECT p, e, unnest(v) AS c, unnest(range(len(v))) AS k FROM near{r}) GROUP BY p, e, k) GROUP BY p, e), "
                f"book{r + 1} AS (SELECT p, e, coalesce(s.v, b.v) AS v FROM book{r} b LEFT JOIN sums{r} s USING (p, e))".replace("floor_div(sum(c), count(*))", "((sum(c) - (((sum(c) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT")
            )
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT i, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v FROM (SELECT i, v, unnest(range({parts})) AS p FROM kept)),
book0 AS (SELECT p, i - 1 AS e, v FROM cells WHERE i <= {entries}),
{", ".join(steps)},
coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY i),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (i), books
"""


ORACLE = oracle()
