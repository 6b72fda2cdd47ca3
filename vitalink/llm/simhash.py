"""SimHash near-duplicates, found with the generalised pigeonhole principle.

Fingerprints at a Hamming distance of at most ``tau`` must agree, within a threshold of its own, in at least one of
``m`` groups of bits, whenever the thresholds sum to ``tau - m + 1`` (a threshold of -1 leaves a group out).  Bits that
correlate over the corpus share a group.  For each fingerprint a dynamic program allocates the thresholds that give
the smallest candidate count, estimated from a sketch of how often the values of each group occur.  Each fingerprint
is indexed under its values, probes all values within its thresholds, and candidates are verified.

Values that very many fingerprints share are not compared pair by pair.  Their fingerprints go, exactly, through the
points at distance 0 and 1 around them: two fingerprints differ in at most two bits if and only if they share such a
point, and a point has at most 65 of them.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, sliced, utf8, words
from .components import connected_components

SEED = 42
BIN_ROWS = 1 << 19  # index and probe rows of a task, on average
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SLOT = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def text_fingerprint(text: bytes, shingle: int) -> int:
    parts = text.translate(_LOWER).split()  # splits bytes at ASCII white space only
    if not parts:
        return 0
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return fingerprint(np.array([digest(line, SEED)], np.uint64))
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    lo, hi = (end - size)[: len(parts) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    return fingerprint(np.array([digest(line[i:j], SEED) for i, j in zip(lo, hi, strict=True)], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text, one row for each row of ``docs``.

    A null or blank text has the fingerprint 0; a text of fewer words than a shingle is one shingle.
    """

    def run(batches):
        for batch in sliced(batches, 1):
            raw, at = utf8(batch.column(1))
            data = raw.tobytes()
            found = [text_fingerprint(data[i:j], shingle) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- grouping of bits


def bit_groups(distinct: DataFrame, m: int) -> list[list[int]]:
    """m groups of bits, correlated ones together, from the co-occurrence counts of all fingerprints."""

    def count(batches):
        total = np.zeros((64, 64), np.int64)
        n = 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(fp)
        if n:
            i, j = np.divmod(np.arange(4096), 64)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(i, 64)), "j": pa.array(np.append(j, 64)), "n": pa.array(np.append(total.ravel(), n))})

    both, n = np.zeros((64, 64)), 0
    for r in distinct.select("fp").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] == 64:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    if not n:
        return [list(range(64))[k::m] for k in range(m)]
    p = both / n
    one = np.diag(p)
    spread = np.sqrt(np.maximum(np.outer(one * (1 - one), one * (1 - one)), 1e-12))
    phi = np.abs(p - np.outer(one, one)) / spread
    np.fill_diagonal(phi, 0)
    free, groups = list(range(64)), []
    for k in range(m):
        size = (64 - sum(map(len, groups))) // (m - k)
        group = [max(free, key=lambda b: (phi[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (phi[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def group_value(fp: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, bit in enumerate(group):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def _slot(value: np.ndarray, slots: int) -> np.ndarray:
    return ((value * _SLOT) >> np.uint64(40)).astype(np.int64) % slots


def value_sketch(distinct: DataFrame, groups: list[list[int]], slots: int) -> np.ndarray:
    """How many fingerprints have a value of each slot, for each group: a table of fixed size."""

    def count(batches):
        total = np.zeros((len(groups), slots), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for g, group in enumerate(groups):
                total[g] += np.bincount(_slot(group_value(fp, group), slots), minlength=slots)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int64()), "n": pa.array(total.ravel()[at], pa.int64())})

    table = distinct.select("fp").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(groups) * slots, np.int64)
    out[table["slot"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return out.reshape(len(groups), slots)


def allocate(fp: np.ndarray, groups: list[list[int]], sketch: np.ndarray, tau: int, exact: bool = False) -> np.ndarray:
    """Thresholds (-1 .. tau) of each fingerprint and group, of least estimated candidate count, by dynamic programming.

    ``sketch`` counts fingerprints by slot of their group's value, or by the value itself if it is ``exact``.
    """
    m, n, slots = len(groups), len(fp), sketch.shape[1]
    load = sketch.sum(axis=1) / slots
    slot = (lambda v: v.astype(np.int64)) if exact else (lambda v: _slot(v, slots))
    cost = np.zeros((m, tau + 2, n))  # cost[g, t + 1]
    for g, group in enumerate(groups):
        value = group_value(fp, group)
        ball = sketch[g, slot(value)].astype(float)
        cost[g, 1] = ball
        if tau >= 1:
            ball = ball.copy()
            for k in range(len(group)):
                ball += sketch[g, slot(value ^ np.uint64(1 << k))]
            cost[g, 2] = ball + len(group)
        for t in range(2, tau + 1):
            size = comb(len(group), t)
            cost[g, t + 1] = cost[g, t] + size * (load[g] + 1)
    spend = tau - m + 1 + m  # thresholds plus one each
    best = np.full((m + 1, spend + 1, n), np.inf)
    best[0, 0] = 0
    pick = np.zeros((m + 1, spend + 1, n), np.int8)
    for g in range(m):
        for have in range(spend + 1):
            for t in range(min(tau + 1, spend - have) + 1):
                new = best[g, have] + cost[g, t]
                better = new < best[g + 1, have + t]
                best[g + 1, have + t] = np.where(better, new, best[g + 1, have + t])
                pick[g + 1, have + t] = np.where(better, t, pick[g + 1, have + t])
    out = np.zeros((m, n), np.int8)
    have = np.full(n, spend)
    for g in range(m, 0, -1):
        t = pick[g, have, np.arange(n)]
        out[g - 1] = t - 1
        have = have - t
    return out


def keys(fp: np.ndarray, groups: list[list[int]], thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) rows: each fingerprint under its own values, and under the values that it probes."""
    found, owner = [], []
    for g, group in enumerate(groups):
        value = group_value(fp, group) | np.uint64(g << 56)
        found.append(value)
        owner.append(fp)
        for t in range(1, int(thresholds[g].max(initial=-1)) + 1):
            at = thresholds[g] >= t
            for flip in combinations(range(len(group)), t):
                found.append(value[at] ^ np.uint64(sum(1 << k for k in flip)))
                owner.append(fp[at])
    return np.concatenate(found), np.concatenate(owner)


class Forest:
    """Union-find over the numbers that have been joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        links = [(x, self.root(x)) for x in self.up]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _near(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= tau


def links(distinct: DataFrame, tau: int = 2, m: int = 3, slots: int = 1 << 14, most: int = 64) -> DataFrame:
    """(a, b): links between different fingerprints, enough to connect all that are linked at a distance up to ``tau``.

    ``distinct`` has each fingerprint once (long column fp).  Values shared by over ``most`` index and probe rows go
    through the points around their fingerprints (exact for tau up to 2), all others are compared directly.
    """
    if tau > 2:
        raise ValueError("tau up to 2")
    if not 1 <= m <= tau + 1:
        raise ValueError("one to tau + 1 groups")
    spark = distinct.sparkSession
    groups = bit_groups(distinct, m)
    sketch = spark.sparkContext.broadcast(value_sketch(distinct, groups, slots))

    def probe(batches):
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at : at + 4096]
                key, owner = keys(fp, groups, allocate(fp, groups, sketch.value, tau))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner.view(np.int64))], names=["key", "fp"])

    rows = cut(distinct.select("fp").mapInArrow(probe, "key long, fp long"))
    n_bins = max(4 * shuffle_partitions(spark), rows.count() // BIN_ROWS)
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("key").alias("k"))
    marked = rows.join(crowded, F.col("key") == F.col("k"), "left")

    def compare(table: pa.Table) -> pa.Table:
        key, fp = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "fp"))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order].view(np.uint64)
        forest, step = Forest(), 1
        while step < len(key):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                break
            near = same[_near(fp[same], fp[same + step], tau) & (fp[same] != fp[same + step])]
            for a, b in zip(fp[near].view(np.int64).tolist(), fp[near + step].view(np.int64).tolist(), strict=True):
                forest.join(a, b)
            step += 1
        return pa.Table.from_batches([forest.batch()])

    direct = marked.where("k is null").select("key", "fp", F.pmod(F.xxhash64("key"), F.lit(n_bins)).alias("bin")).repartition(n_bins, "bin").groupBy("bin").applyInArrow(compare, "a long, b long")

    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])

    def around(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 2048):
                part = fp[at : at + 2048]
                point = (part[:, None] ^ flips).ravel()
                owner = np.repeat(part, 65)
                to = ((point * _SLOT) >> np.uint64(33)).astype(np.int64) % n_bins
                order = np.argsort(to, kind="stable")
                to, data = to[order], np.stack([point[order], owner[order]], axis=1)
                edge = np.flatnonzero(np.diff(to)) + 1
                blobs = [x.tobytes() for x in np.split(data, edge)]
                yield pa.RecordBatch.from_arrays([pa.array(to[np.concatenate([[0], edge])], pa.int64()), pa.array(blobs, pa.binary())], names=["bin", "data"])

    def meet(table: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint64).reshape(-1, 2)
        order = np.lexsort((data[:, 1], data[:, 0]))
        point, fp = data[order, 0], data[order, 1].view(np.int64)
        same = np.flatnonzero((point[1:] == point[:-1]) & (fp[1:] != fp[:-1]))
        forest = Forest()
        for a, b in zip(fp[same].tolist(), fp[same + 1].tolist(), strict=True):
            forest.join(a, b)
        return pa.Table.from_batches([forest.batch()])

    dense = marked.where("k is not null").select("fp").distinct()
    by_point = dense.mapInArrow(around, "bin long, data binary").groupBy("bin").applyInArrow(meet, "a long, b long")
    return direct.union(by_point)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 2, groups: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs``.

    component_id is the smallest id among the rows whose fingerprints are linked, directly or in steps, at a distance
    up to ``tau``, the row's own included.  Blank and null texts have fingerprint 0 and are linked like any other.
    Null ids stay null and count in no minimum; a component of null ids only has a null component_id.  Repeated rows
    give repeated rows.  Other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = cut(connected_components(links(first.select("fp"), tau, groups)))
    member = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = member.join(least, "root").select(F.col("fp").alias("label_fp"), "component_id")
    return prints.join(label, prints["fp"] == label["label_fp"], "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
