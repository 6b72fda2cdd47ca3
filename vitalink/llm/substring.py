"""Exact substring dedup with fixed-block anchors.

A repeat of ``window`` words holds, wherever it lies in its document, at least one whole block of ``window // 2``
words that starts at a multiple of that length.  So all documents are cut into such non-overlapping reference blocks,
and every rolling window of a block's length, of every document, probes them.  A hit is a block-length word sequence
that occurs at least twice, once of these as a reference block.  Hits are extended to maximal exact repeats a word at a
time: each window of ``window`` words that contains a hit is compared with all its occurrences in the corpus at once,
not with one reference (which need not be the one that repeats furthest), and the windows that also start earlier join
to maximal runs.  Windows are told apart by 112 bits, of two hashes that rest on different hashes of the words.

Nothing is paired.  Documents are dealt to chunks of bounded size; a chunk sends each different hash once, whatever
the number of its occurrences, as packed numbers to the task for its range of hashes, which answers one bit for each
hash.  A passage that a third of all documents share thus costs each chunk one number.  Chunks and ranges grow in number
with the data, so that none grows in size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import inside, text_bytes, utf8, window_hashes, word_hashes, words

_KEY = 46  # bits of a block's hash


class Chunk:
    """The documents of a chunk in order of (id, text), and the hashes of their words."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("id").to_pylist()
        own = table.column("own").to_pylist()
        texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        if table.num_rows > 1:
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, own[k] if ids[k] is None else ids[k]))
            if len(set(ids)) < len(ids):
                plain = texts.to_pylist()
                order.sort(key=lambda k: (ids[k] is None, own[k] if ids[k] is None else ids[k], plain[k] or ""))
            ids, own, texts = [ids[k] for k in order], [own[k] for k in order], texts.take(pa.array(order))
        self.ids, self.window, self.block = ids, window, window // 2
        #: What orders documents: those without an id come last, by the hash of their text.
        self.none = np.array([x is None for x in ids], np.uint8)
        self.rank = np.array([y if x is None else x for x, y in zip(ids, own, strict=True)], np.int64)
        raw, offsets = utf8(texts)
        self.raw, self.offsets = raw, offsets
        self.start, self.end, self.first = words(raw, offsets)
        self.h = word_hashes(raw, self.start, self.end)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys in order, their flags, key number of each probe, word number of each probe).

        A key has _KEY bits.  Flags: 1 it is a reference block here, 2 it occurs twice here.
        """
        count = np.diff(self.first)
        long = np.repeat(count >= self.window, count)
        at = inside(self.first, self.block)
        at = at[long[at]]
        key = window_hashes(self.h, self.block)[at] >> np.uint64(64 - _KEY)
        is_block = (at - np.repeat(self.first[:-1], count)[at]) % self.block == 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(new) - 1
        distinct = ordered[new]
        size = np.bincount(number, minlength=len(distinct))
        blocks = np.bincount(number, weights=is_block, minlength=len(distinct))
        return distinct, (blocks > 0).astype(np.uint64) + 2 * (size > 1).astype(np.uint64), number, at

    def touched(self, hit: np.ndarray, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Word numbers of the windows that contain a hit."""
        marks = np.zeros(len(self.h) + 1, np.int64)
        marks[at[hit[number]] + 1] = 1
        upto = np.cumsum(marks)
        starts = inside(self.first, self.window)
        last = starts + self.window - self.block + 1
        return starts[upto[last] > upto[starts]]

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first hash, second hash, document number) of each different window, at its first start; and the number of the different window at each start."""
        a = b = np.zeros(0, np.uint64)
        if len(starts):
            a = window_hashes(self.h, self.window)[starts]
            used = np.zeros(len(self.h) + 1, np.int64)
            np.add.at(used, starts, 1)
            np.add.at(used, starts + self.window, -1)
            used = np.flatnonzero(np.cumsum(used)[:-1] > 0)
            other = np.zeros(len(self.h), np.uint64)
            other[used] = word_hashes(self.raw, self.start[used], self.end[used], 0x51ED270B)
            b = window_hashes(other, self.window, 0xA24BAED4963EE407)[starts]
        order = np.lexsort((b, a))  # stable: the first of a group starts first
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        number = np.empty(len(a), np.int64)
        number[order] = np.cumsum(new) - 1
        lead = order[new]
        doc = np.searchsorted(self.first, starts[lead], "right") - 1
        self.leads = np.zeros(len(a), bool)
        self.leads[lead] = True
        return a[lead], b[lead], doc, number


@dataclass(frozen=True)
class Ranges:
    """Consecutive ranges of hash prefixes; prefixes have at least 16 bits, and more than ranges."""

    n: int

    @property
    def bits(self) -> int:
        return max(16, (self.n - 1).bit_length())

    @cached_property
    def bounds(self) -> np.ndarray:
        """The first prefix of each range, and the end."""
        return -(-np.arange(self.n + 1) * (1 << self.bits) // self.n)

    def pack(self, prefix: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
        """Rows (range, counts of each prefix and then the columns), from columns that are ordered by prefix."""
        counts = np.bincount(prefix.astype(np.int64), minlength=1 << self.bits).astype("<u4")
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[self.bounds]
        out = []
        for r in np.flatnonzero(np.diff(upto)).tolist():
            lo, hi = upto[r], upto[r + 1]
            out.append((r, counts[self.bounds[r] : self.bounds[r + 1]].tobytes() + b"".join(np.ascontiguousarray(c[lo:hi]).tobytes() for c in columns)))
        return out

    def unpack(self, data: bytes, r: int, kinds: list[str]) -> list[np.ndarray]:
        lo, hi = self.bounds[r], self.bounds[r + 1]
        counts = np.frombuffer(data, "<u4", hi - lo)
        n, at = int(counts.sum()), 4 * (hi - lo)
        out = [np.repeat(np.arange(lo, hi, dtype=np.uint64), counts)]
        for kind in kinds:
            out.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return out

    def answers(self, table: pa.Table, step: int, prefix: np.ndarray) -> np.ndarray:
        """The answers to a step, for hashes in order of their prefix."""
        out = np.zeros(len(prefix), bool)
        upto = np.searchsorted(prefix, self.bounds.astype(np.uint64))
        for s, r, data in zip(*(table.column(c).to_pylist() for c in ("step", "range", "data")), strict=True):
            if s == step:
                lo, hi = upto[r], upto[r + 1]
                out[lo:hi] = np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo).astype(bool)
        return out


def _rows(chunk: int, packed: list[tuple[int, bytes]], step: int) -> pa.Table:
    return pa.table({"chunk": pa.array([chunk] * len(packed), pa.int64()), "range": pa.array([r for r, _ in packed], pa.int64()), "step": pa.array([step] * len(packed), pa.int64()), "data": pa.array([x for _, x in packed], pa.binary())})


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of [start, end) word ranges: the repeats), kept (text of the kept words).

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a document of smaller id,
    or earlier in the same one.  Null ids come last, by a hash of their text; rows of equal id are ordered by text, and
    count as documents of their own.  Null and blank texts, and texts shorter than a window, lose nothing.  Other columns are ignored.  Each
    row gives a row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = max(8, -(-text_bytes(rows, "text")[1] // chunk_bytes))
    ranges = Ranges(n)
    low_bits = np.uint64(_KEY - ranges.bits)
    key_prefix = lambda distinct: distinct >> low_bits
    top_prefix = lambda a: a >> np.uint64(64 - ranges.bits)
    rows = rows.withColumn("own", F.xxhash64("text"))
    dealt = rows.withColumn("chunk", F.pmod(F.when(F.col("id").isNull(), F.col("own")).otherwise(F.xxhash64("id")), F.lit(n))).repartition(n, "chunk")
    schema = "chunk long, range long, step long, data binary"

    def send_probes(key, table):
        distinct, flags, _, _ = Chunk(table, window).probes()
        low = (((distinct & ((np.uint64(1) << low_bits) - np.uint64(1))) << np.uint64(2)) | flags).astype("<u4")
        return _rows(key[0].as_py(), ranges.pack(key_prefix(distinct), [low]), 1)

    def find_hits(key, table):
        r = key[0].as_py()
        parts = [ranges.unpack(x, r, ["<u4"]) for x in table.column("data").to_pylist()]
        size = [len(p[0]) for p in parts]
        low = np.concatenate([p[1] for p in parts]).astype(np.uint64)
        whole = np.concatenate([p[0] for p in parts]) << low_bits | low >> np.uint64(2)
        del parts
        order = np.argsort(whole, kind="stable")
        ordered = whole[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        flags = low[order] & np.uint64(3)
        several = (np.diff(np.append(first, len(ordered))) > 1) | (np.maximum.reduceat(flags, first) >= 2)
        block = np.bitwise_or.reduceat(flags, first) & np.uint64(1) > 0
        hit = np.empty(len(ordered), bool)
        hit[order] = (several & block)[np.cumsum(new) - 1]
        cut = np.cumsum(size)[:-1]
        answers = [(c, np.packbits(x).tobytes()) for c, x in zip(table.column("chunk").to_pylist(), np.split(hit, cut), strict=True) if x.any()]
        return pa.table({"chunk": pa.array([c for c, _ in answers], pa.int64()), "range": pa.array([r] * len(answers), pa.int64()), "step": pa.array([1] * len(answers), pa.int64()), "data": pa.array([x for _, x in answers], pa.binary())})

    def candidates(table, answers):
        chunk = Chunk(table, window)
        distinct, _, number, at = chunk.probes()
        hit = ranges.answers(answers, 1, key_prefix(distinct))
        starts = chunk.touched(hit, number, at)
        return chunk, starts, *chunk.windows(starts)

    def send_windows(key, table, answers):
        if not table.num_rows or not answers.num_rows:
            return _rows(0, [], 2)
        chunk, _, a, b, doc, _ = candidates(table, answers)
        columns = [(a & np.uint64(0xFFFFFFFF)).astype("<u4"), (a >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2")]
        columns += [(b & np.uint64(0xFFFFFFFF)).astype("<u4"), (b >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2")]
        return _rows(key[0].as_py(), ranges.pack(top_prefix(a), [*columns, chunk.none[doc], chunk.rank[doc].astype("<i8")]), 2)

    def find_earlier(key, table):
        r = key[0].as_py()
        parts = [ranges.unpack(x, r, ["<u4", "<u2", "<u4", "<u2", "u1", "<i8"]) for x in table.column("data").to_pylist()]
        size = [len(p[0]) for p in parts]
        prefix, low, mid, low_b, mid_b, none, rank = (np.concatenate([p[k] for p in parts]) for k in range(7))
        del parts
        a = mid.astype(np.uint64) << np.uint64(32) | low
        b = mid_b.astype(np.uint64) << np.uint64(32) | low_b
        order = np.lexsort((rank, none, b, a, prefix))
        later = np.zeros(len(a), bool)
        equal = np.ones(max(0, len(a) - 1), bool)
        for x in (prefix, a, b):
            equal &= x[order][1:] == x[order][:-1]
        later[order[1:]] = equal
        cut = np.cumsum(size)[:-1]
        answers = [(c, np.packbits(x).tobytes()) for c, x in zip(table.column("chunk").to_pylist(), np.split(later, cut), strict=True) if x.any()]
        return pa.table({"chunk": pa.array([c for c, _ in answers], pa.int64()), "range": pa.array([r] * len(answers), pa.int64()), "step": pa.array([2] * len(answers), pa.int64()), "data": pa.array([x for _, x in answers], pa.binary())})

    def finish(key, table, answers):
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string()))})
        chunk, starts, a, _, _, number = candidates(table, answers)
        late = ranges.answers(answers, 2, top_prefix(a))
        gone = starts[~chunk.leads | late[number]] if len(starts) else starts
        change = np.zeros(len(chunk.h) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + window, -1)
        covered = np.cumsum(change)[:-1] > 0
        raw, at, first = chunk.raw.tobytes(), chunk.offsets.tolist(), chunk.first
        n_removed = np.concatenate([[0], np.cumsum(covered)])[first]
        n_removed = np.diff(n_removed)
        spans, kept = [], []
        for k, lost in enumerate(n_removed.tolist()):
            parts = raw[at[k] : at[k + 1]].split()
            if lost:
                mask = covered[first[k] : first[k + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append(edge.reshape(-1, 2).tolist())
                parts = [x for x, y in zip(parts, mask.tolist(), strict=True) if not y]
            else:
                spans.append([])
            kept.append(b" ".join(parts).decode())
        return pa.table({"doc_id": pa.array(chunk.ids, pa.int64()), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.string())})

    probes = dealt.groupBy("chunk").applyInArrow(send_probes, schema)
    hits = probes.repartition(n, "range").groupBy("range").applyInArrow(find_hits, schema)
    hits = hits.repartition(n, "chunk")
    found = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, schema)
    earlier = found.repartition(n, "range").groupBy("range").applyInArrow(find_earlier, schema)
    answers = hits.union(earlier).repartition(n, "chunk")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, removed array<array<long>>, kept string")


def digest(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()


#: doc_id, n_words, n_removed and kept_sha256 over the documents table, for DuckDB.
ORACLE = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM texts WHERE len(w) >= 20),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM starts),
late AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM late),
lost AS (
  SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id),
placed AS (
  SELECT t.doc_id, t.w[u.k] AS word, u.k AS k
  FROM texts t JOIN lost l USING (doc_id), unnest(range(1, len(t.w) + 1)) AS u(k)),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.k) AS s
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY p.doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN l.n IS NULL THEN array_to_string(t.w, ' ') ELSE coalesce(k.s, '') END) AS kept_sha256
FROM texts t LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
