"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The seeds of a test item are its n-grams that few different items have; those that the corpus has a few times only are
rare.  What many items share, such as the words of a question's form, is no seed, so a document meets at most
``few_items`` items for each of its n-grams, however many items there are.  An item without an n-gram of its own is
sought by longer ones, up to its whole length.  Documents that hold seeds of an item in about the same order are aligned
with it if one of the seeds is rare or several come in company: the n-grams of an item that has leaked very often are as
frequent as common phrases, but come together.  The score is the best local alignment's, as a share of the item's own
(1: verbatim).  Words are compared in lower case, without ASCII punctuation.

Documents never move: the items are the stated query set, broadcast in blocks of bounded size, one pass over the
documents for each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, inside, sliced, text_bytes, utf8, window_hashes, word_hashes, words

_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_SIEVE = 22  # bits of the sieve that n-grams pass first


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, number of the first word of each)."""
    raw, offsets = utf8(pc.utf8_lower(texts))
    raw = np.frombuffer(raw.tobytes().translate(_KEEP), np.uint8)
    start, end, first = words(raw, offsets)
    return word_hashes(raw, start, end), first


#: Lengths of seeds: the first for nearly all items, longer ones for those without a shorter one of their own.
LADDER = (3, 6, 12, 24, 48, 96)


@dataclass
class Seeds:
    """The seeds of one length, in order of their hash, and where items have them."""

    n: int
    grams: np.ndarray
    sieve: np.ndarray
    pointer: np.ndarray  # of each seed into the two below
    item: np.ndarray
    place: np.ndarray
    rare: np.ndarray  # of each seed

    def find(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number, seed number) of the documents' n-grams that are seeds."""
        at = inside(first, self.n)
        if not len(at) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = window_hashes(h, self.n)[at]
        maybe = np.flatnonzero(self.sieve[(key >> np.uint64(64 - _SIEVE)).astype(np.int64)])
        at, key = at[maybe], key[maybe]
        number = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        same = self.grams[number] == key
        return at[same], number[same]


@dataclass
class Items:
    """A block of different test items by word hashes; ``ids`` lists those of all items of equal words."""

    ids: list[list]
    h: np.ndarray
    first: np.ndarray

    def grams(self, n: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, item, place) of the n-grams of all items, or of some."""
        at = inside(self.first, n)
        item = np.searchsorted(self.first, at, "right") - 1
        if some is not None:
            keep = np.isin(item, some)
            at, item = at[keep], item[keep]
        return (window_hashes(self.h, n)[at] if len(at) else np.zeros(0, np.uint64)), item, at - self.first[item]


def different(ids: list, texts: list[str]) -> Items:
    """Items of equal words as one, those without words left out."""
    h, first = hashed(pa.array(texts, pa.string()))
    of: dict[bytes, list] = {}
    for k, i in enumerate(ids):
        if first[k + 1] > first[k]:
            of.setdefault(h[first[k] : first[k + 1]].tobytes(), []).append(i)
    sizes = [len(x) // 8 for x in of]
    return Items(list(of.values()), np.frombuffer(b"".join(of), np.uint64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64))


def seeds_of(n: int, gram: np.ndarray, item: np.ndarray, place: np.ndarray) -> Seeds:
    order = np.argsort(gram, kind="stable")
    grams, begin = np.unique(gram[order], return_index=True)
    sieve = np.zeros(1 << _SIEVE, bool)
    sieve[(grams >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
    return Seeds(n, grams, sieve, np.append(begin, len(gram)), item[order], place[order], np.ones(len(grams), bool))


def choose_seeds(items: Items, shared: dict[int, np.ndarray], ladder: tuple[int, ...] = LADDER) -> list[Seeds]:
    """The seeds of each length.  ``shared`` has, by length, the hashes of the n-grams that too many items have.

    An item's seeds have the least length at which it has an n-gram that is not shared; an item without takes those of
    the greatest length that fits, for itself alone.
    """
    left, out = np.arange(len(items.ids)), []
    size = np.diff(items.first)
    for k, n in enumerate(ladder):
        left = left[size[left] >= n]
        if not len(left):
            break
        gram, item, place = items.grams(n, left)
        own = ~np.isin(gram, shared[n])
        has = np.isin(left, item[own])
        last = ~has & (size[left] < ladder[k + 1] if k + 1 < len(ladder) else np.ones(len(left), bool))
        keep = own & np.isin(item, left[has]) | np.isin(item, left[last])
        if keep.any():
            out.append(seeds_of(n, gram[keep], item[keep], place[keep]))
        left = left[~has & ~last]
    return out


def align(a: list[np.ndarray], b: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over pairs of word sequences: (best score, number of the words of b up to its end).

    All pairs go through the rows of a at once; gaps along b are a running maximum.
    """
    n, rows, width = len(a), max(map(len, a)), max(map(len, b))
    # numbers that no two paddings share
    left, right = np.zeros((n, rows), np.uint64), np.ones((n, width), np.uint64)
    left_in, right_in = np.zeros((n, rows), bool), np.zeros((n, width), bool)
    for k in range(n):
        left[k, : len(a[k])], left_in[k, : len(a[k])] = a[k], True
        right[k, : len(b[k])], right_in[k, : len(b[k])] = b[k], True
    before = np.zeros((n, width + 1), np.int32)
    slope = gap * np.arange(width + 1, dtype=np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(rows):
        same = (right == left[:, i, None]) & right_in & left_in[:, i, None]
        now = np.zeros_like(before)
        now[:, 1:] = np.maximum(before[:, :-1] + np.where(same, match, mismatch).astype(np.int32), before[:, 1:] - gap)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        at = now.argmax(axis=1)
        top = now[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        before = now
    return best, end


@dataclass
class Matcher:
    items: Items
    seeds: list[Seeds]
    least: float
    company: int

    def _hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, shift, whether rare) of each seed that a document has."""
        parts = []
        for seeds in self.seeds:
            at, number = seeds.find(h, first)
            each = np.diff(seeds.pointer)[number]
            where = np.repeat(at, each)
            slot = np.arange(len(where)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(seeds.pointer[number], each)
            doc = np.searchsorted(first, where, "right") - 1
            parts.append((doc, seeds.item[slot], where - first[doc] - seeds.place[slot], np.repeat(seeds.rare[number], each)))
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))

    def match(self, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(text number, item number, score, first word, end word) of the best match of each text and item."""
        h, first = hashed(texts)
        items = self.items
        doc, item, shift, rare = self._hits(h, first)
        if not len(doc):
            return []
        order = np.lexsort((shift, item, doc))
        doc, item, shift, rare = doc[order], item[order], shift[order], rare[order]
        length = np.diff(items.first)[item]
        slack = np.maximum(6, length // 4)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > slack[1:])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(doc))
        have = np.bincount(np.concatenate([s.item for s in self.seeds]), minlength=len(items.ids))[item[lo]]
        several = np.add.reduceat(rare, lo) > 0
        enough = hi - lo >= np.minimum(have, np.where(several, 2, self.company))
        lo, hi = lo[enough], hi[enough]
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        size = max(1, (1 << 21) // max(1, int((length[lo] * 2).max(initial=1))))
        for part in range(0, len(lo), size):
            pairs, a, b = [], [], []
            for i, j in zip(lo[part : part + size].tolist(), hi[part : part + size].tolist(), strict=True):
                d, t = int(doc[i]), int(item[i])
                begin = max(int(first[d]), int(first[d] + shift[i] - slack[i]))
                stop = min(int(first[d + 1]), int(first[d] + shift[j - 1] + length[i] + slack[i]))
                pairs.append((d, t, begin))
                a.append(items.h[items.first[t] : items.first[t + 1]])
                b.append(h[begin:stop])
            score, end = align(a, b)
            share = score / np.array([2 * len(x) for x in a])
            good = np.flatnonzero(share >= self.least).tolist()
            if not good:
                continue
            back = align([a[k][::-1] for k in good], [b[k][: end[k]][::-1] for k in good])[1]
            for k, length_back in zip(good, back.tolist(), strict=True):
                d, t, begin = pairs[k]
                stop = begin + int(end[k]) - int(first[d])
                value = (float(share[k]), stop - length_back, stop)
                if (d, t) not in found or value[0] > found[d, t][0]:
                    found[d, t] = value
        return [(d, t, *v) for (d, t), v in sorted(found.items())]


def shared_grams(items: DataFrame, few_items: int) -> DataFrame:
    """(n, gram): the n-grams of each length of the ladder that over ``few_items`` different items have."""

    def emit(batches):
        for batch in batches:
            some = different(list(range(batch.num_rows)), batch.column(0).to_pylist())
            label = [xxhash.xxh64_intdigest(some.h[i:j].tobytes()) for i, j in zip(some.first[:-1].tolist(), some.first[1:].tolist(), strict=True)]
            label = np.array(label, np.uint64).view(np.int64)
            for n in LADDER:
                gram, item, _ = some.grams(n)
                both = np.unique(np.stack([gram.view(np.int64), item]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(both.shape[1], n)), pa.array(both[0]), pa.array(label[both[1]])], names=["n", "gram", "item"])

    rows = items.select("text").mapInArrow(emit, "n long, gram long, item long")
    return cut(rows.distinct().groupBy("n", "gram").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > few_items).select("n", "gram"))


def _among(spark, table: DataFrame, grams: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Those of the hashes of each length that the table (n, gram) has; the result is no larger than ``grams``."""
    asked = spark.sparkContext.broadcast(grams)

    def keep(batches):
        for batch in batches:
            n, gram = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            mine = np.zeros(len(n), bool)
            for length, known in asked.value.items():
                mine |= (n == length) & np.isin(gram.view(np.uint64), known)
            yield batch.filter(pa.array(mine))

    found = table.mapInArrow(keep, "n long, gram long").toPandas()
    asked.unpersist()
    return {n: found["gram"][found["n"] == n].to_numpy(np.int64).view(np.uint64) for n in grams}


def matchers(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id_col: str, item_text_col: str, few: int, few_items: int, company: int, least: float, block_bytes: int) -> list[Matcher]:
    """A matcher for each block of test items, its rare seeds marked by their counts over all documents."""
    spark = docs.sparkSession
    chosen = benchmark.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-text_bytes(chosen, "text")[1] // block_bytes))
    common = shared_grams(chosen, few_items)
    out = []
    for block in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["text"]))
        items = different([r["id"] for r in rows], [r["text"] for r in rows])
        seeds = choose_seeds(items, _among(spark, common, {n: np.unique(items.grams(n)[0]) for n in LADDER}))
        if not seeds:
            continue
        shared = spark.sparkContext.broadcast(seeds)

        def count(batches, shared=shared):
            total = [np.zeros(len(s.grams), np.int64) for s in shared.value]
            for batch in sliced(batches, 0):
                h, first = hashed(batch.column(0))
                for s, t in zip(shared.value, total, strict=True):
                    t += np.bincount(s.find(h, first)[1], minlength=len(t))
            for k, t in enumerate(total):
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k), pa.int64()), "gram": pa.array(at, pa.int64()), "n": pa.array(t[at], pa.int64())})

        texts = docs.select(F.col(text_col).cast("string").alias("text"))
        often = texts.mapInArrow(count, "k long, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).where(F.col("n") > few).toPandas()
        shared.unpersist()
        for k, s in enumerate(seeds):
            s.rare[often["gram"][often["k"] == k].to_numpy(np.int64)] = False
        out.append(Matcher(items, seeds, least, company))
    return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    few: int = 16,
    few_items: int = 8,
    company: int = 3,
    least: float = 0.5,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: a row for each row of ``docs`` and test item of a score of ``least`` or more.

    A seed is rare if the corpus has it at most ``few`` times, and no seed if over ``few_items`` different items have it.
    Candidates have two seeds of an item near each other, one of them rare, or ``company`` seeds (all of the item's
    seeds, if it has fewer).  Word numbers are of the compared words (end exclusive).  Null and blank texts match
    nothing; items of fewer than three words can't be told from chance and match nothing.  Repeated rows and repeated
    items give repeated rows; null ids stay null.  Without items or documents the result is empty.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    found = None
    for matcher in matchers(docs, benchmark, text_col, item_id_col, item_text_col, few, few_items, company, least, block_bytes):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches, shared=shared):
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            for batch in sliced(batches, 1):
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], i, *rest) for d, t, *rest in shared.value.match(batch.column(1)) for i in shared.value.items.ids[t]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", few: int = 16, few_items: int = 8, company: int = 3, least: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that match no test item (see :func:`contaminated`)."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for matcher in matchers(docs, benchmark, text_col, item_id_col, item_text_col, few, few_items, company, least, block_bytes):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches, shared=shared):
            for batch in sliced(batches, at):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in shared.value.match(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
