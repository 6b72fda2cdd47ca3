"""Collocations: frequent phrases of two to five words and how much more often they occur than their parts would.

Phrases are counted level by level.  A frequent phrase has a frequent beginning and a frequent end of one word less, so
that its key is the pair of their numbers, 64 bits that stand for exactly one phrase.  A level takes these steps over
the documents, which are held as arrays of the numbers of the level before, -1 where no frequent phrase starts:

1. Keys are counted in hashed buckets; what lies in a bucket below the least count is no candidate.
2. The different keys that are left are the candidates: no frequent phrase is lost, few others come along.
3. Candidates are dealt to shards of a quarter of a million at most, each with a minimal perfect hash and its keys by slot.
4. Mappers look up slots, compare the stored key, and count slots with ``bincount``; arrays are summed up a tree.

The words themselves are level one, with their text as the stored key.  Counts of the parts of a phrase are then those of
the slots that its key leads to.  Buckets and shards live in the shared folder; a task holds a few shards at a time.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_dir, mix, shared_dir, sliced, utf8, word_hashes
from .perfect_hash import PerfectHash

PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bits of a number that are its slot, and the most keys of a shard on average.
SLOT_BITS, SHARD_KEYS = 20, 1 << 18
_CHUNK, _KEPT_BYTES, _BRANCHES = 1 << 20, 24 << 20, 16
_PARTIAL = "at int, node int, wide int, slots binary, counts binary"

_IS_END, _IS_GAP, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_IS_END[list(PIECE_ENDS)] = True
_IS_GAP[list(PIECE_ENDS + SPACES)] = True
_LOWER[65:91] += 32


# ---------------------------------------------------------------- words


def chunks(batch: pa.RecordBatch, most: int = _CHUNK):
    """(words, text numbers, starts a piece) of runs of whole pieces of about ``most`` bytes; texts are column 1."""
    raw, offsets = utf8(batch.column(1))
    at = 0
    while at < len(raw):
        to = min(len(raw), at + most)
        if to < len(raw):
            ends = np.flatnonzero(_IS_END[raw[at:to]])
            text_end = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            to = max(at + int(ends[-1]) + 1 if len(ends) else 0, text_end)
            if to <= at:  # one piece of more than that
                later = np.flatnonzero(_IS_END[raw[at + most :]])
                next_text = int(offsets[np.searchsorted(offsets, at, "right")])
                to = min(at + most + int(later[0]) + 1 if len(later) else len(raw), next_text)
        part = raw[at:to]
        solid = ~_IS_GAP[part]
        edge = np.zeros(len(part) + 1, bool)
        inner = offsets[(offsets >= at) & (offsets <= to)] - at
        edge[inner] = True
        edge[0] = True
        before = np.concatenate([[False], solid[:-1]])
        after = np.concatenate([solid[1:], [False]])
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        if len(start):
            text = np.searchsorted(offsets, start + at, "right") - 1
            piece = np.cumsum(_IS_END[part], dtype=np.int32)[start]
            first = np.ones(len(start), bool)
            first[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
            cuts = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
            words = pa.StringArray.from_buffers(len(start), pa.py_buffer(cuts), pa.py_buffer(_LOWER[part[solid]]))
            yield words, text, first
        at = to


def _pairs(batch: pa.RecordBatch):
    """For each chunk: (languages, words) of its different words, each word's place among them, and ``starts a piece``."""
    lang = batch.column(0).fill_null("und").dictionary_encode()
    of_text = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for words, text, first in chunks(batch):
        coded = words.dictionary_encode()
        pair = of_text[text] * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        each, place = np.unique(pair, return_inverse=True)
        yield lang.dictionary.take(pa.array(each // len(coded.dictionary))), coded.dictionary.take(pa.array(each % len(coded.dictionary))), place, first


def word_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """lang, word, f: all words with their counts, and for each language a row without a word with the number of them all.

    A task adds up what fits ``most`` rows before it sends them.
    """

    def run(batches):
        held, n = [], 0

        def summed() -> pa.Table:
            found = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("f", "sum")])
            return found.rename_columns(["lang", "word", "f"]).cast(held[0].schema)

        for batch in sliced(batches, 1, _CHUNK):
            for langs, words, place, _ in _pairs(batch):
                count = pa.array(np.bincount(place, minlength=len(words)), pa.int64())
                held.append(pa.table({"lang": langs, "word": words, "f": count}))
                total = held[-1].group_by("lang").aggregate([("f", "sum")])
                held.append(pa.table({"lang": total["lang"], "word": pa.nulls(len(total), pa.string()), "f": total["f_sum"]}))
                n += len(words)
                if n > most:
                    held = [summed()]
                    n = len(held[0])
                    if 2 * n > most:  # most words are rare ones
                        yield from held[0].to_batches(1 << 16)
                        held, n = [], 0
        if held:
            yield from summed().to_batches(1 << 16)

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


# ---------------------------------------------------------------- shards of perfect hashes


def text_keys(words: pa.Array, langs: pa.Array) -> pa.Array:
    """A word and its language in one string; no word has a line end."""
    return pc.binary_join_element_wise(words, langs, "\n")


def hashes(keys: pa.Array | np.ndarray) -> np.ndarray:
    """64-bit hashes of strings, or of numbers (then each its own)."""
    if isinstance(keys, np.ndarray):
        return mix(keys.view(np.uint64))
    raw, offsets = utf8(keys)
    return word_hashes(raw, offsets[:-1], offsets[1:])


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n)).astype(np.int32)


class Shard:
    """Slots of the keys of one shard.  Of keys with equal hashes all but one are behind the others, without a hash."""

    def __init__(self, hash_bytes: bytes, keys: pa.Array | np.ndarray):
        self.hash, self.keys = PerfectHash.from_bytes(hash_bytes), keys
        self.extra = keys[self.hash.n :] if isinstance(keys, pa.Array) else keys[:0]
        self.bytes = len(hash_bytes) * 2 + keys.nbytes

    @staticmethod
    def order(keys: pa.Array | np.ndarray) -> tuple[bytes, np.ndarray]:
        """The hash and the order in which keys are stored."""
        h = hashes(keys)
        _, alone = np.unique(h, return_index=True)
        made = PerfectHash.build(h[alone])
        order = np.empty(made.n, np.int64)
        order[made.slots(h[alone])] = alone
        return made.to_bytes(), np.concatenate([order, np.setdiff1d(np.arange(len(h)), alone)])

    def slots(self, keys: pa.Array | np.ndarray, h: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that are not stored."""
        slot = self.hash.slots(h)
        if not len(self.keys):
            return np.full(len(slot), -1, np.int64)
        if isinstance(keys, np.ndarray):
            return np.where(self.keys[np.maximum(slot, 0)] == keys, slot, -1)
        same = pc.equal(self.keys.take(pa.array(np.maximum(slot, 0))), keys).to_numpy(zero_copy_only=False)
        slot = np.where(same, slot, -1)
        if len(self.extra):
            more = pc.index_in(keys, value_set=self.extra)
            slot = np.where(more.is_valid().to_numpy(zero_copy_only=False), more.fill_null(0).to_numpy() + self.hash.n, slot)
        return slot


_KEPT: OrderedDict[tuple[str, int], Shard] = OrderedDict()


def _table(uri: str, columns: list[str], where=None) -> pa.Table:
    store, path = fs.FileSystem.from_uri(uri)
    return dataset.dataset(path, filesystem=store, format="parquet").to_table(columns=columns, filter=where)


def _shard(uri: str, k: int) -> Shard:
    """A shard from the shared folder; those of its table used last stay in memory, up to a number of bytes."""
    if (uri, k) in _KEPT:
        _KEPT.move_to_end((uri, k))
        return _KEPT[uri, k]
    rows = _table(uri, ["shard", "hash", "numbers", "texts"], dataset.field("shard") == k).combine_chunks()
    if not len(rows):
        found = Shard(PerfectHash.build(np.zeros(0, np.uint64)).to_bytes(), np.zeros(0, np.int64))
    else:
        numbers, texts = rows["numbers"][0], rows["texts"][0]
        found = Shard(rows["hash"][0].as_py(), np.frombuffer(numbers.as_buffer(), "<i8") if numbers.is_valid else texts.values.cast(pa.string()))
    for other in [x for x in _KEPT if x[0] != uri]:
        del _KEPT[other]
    _KEPT[uri, k] = found
    while len(_KEPT) > 1 and sum(s.bytes for s in _KEPT.values()) > _KEPT_BYTES:
        _KEPT.popitem(last=False)
    return found


class Slots:
    """Numbers of keys, by the shards of a table: shard and slot in one."""

    def __init__(self, uri: str, n_shards: int):
        self.uri, self.n_shards = uri, n_shards

    def __call__(self, keys: pa.Array | np.ndarray) -> np.ndarray:
        h = hashes(keys)
        shard = shard_of(h, self.n_shards)
        out = np.full(len(h), -1, np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.n_shards + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[k] : cuts[k + 1]]
            some = keys[rows] if isinstance(keys, np.ndarray) else keys.take(pa.array(rows))
            slot = _shard(self.uri, k).slots(some, h[rows])
            out[rows] = np.where(slot >= 0, (k << SLOT_BITS) + slot, -1)
        return out


def write_shards(keys: DataFrame, uri: str, shard_keys: int = SHARD_KEYS) -> int:
    """Write the shards of a table of different keys (numbers ``key``, or ``word``, ``lang`` and ``f``); return their number."""
    spark, texts = keys.sparkSession, "word" in keys.columns
    n = max(1, -(-keys.count() // shard_keys))
    if n > 1 << 32 - SLOT_BITS - 1:
        raise ValueError(f"more than {n} shards of candidates: the numbers of phrases do not fit 32 bits")

    def dealt(batches):
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            h = hashes(text_keys(cols["word"], cols["lang"]) if texts else cols["key"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, n)), *batch.columns], names=["shard", *batch.schema.names])

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        stored = text_keys(*(rows[c].combine_chunks().cast(pa.string()) for c in ("word", "lang"))) if texts else rows["key"].to_numpy()
        if len(stored) > 1 << SLOT_BITS:
            raise ValueError("a shard has more keys than slots")
        data, order = Shard.order(stored)
        counts = rows["f"].to_numpy()[order].astype("<i8").tobytes() if texts else None
        row = {"shard": rows["shard"][0].as_py(), "hash": data, "numbers": None if texts else stored[order].astype("<i8").tobytes(), "texts": stored.take(pa.array(order)).to_pylist() if texts else None, "counts": counts}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("hash", pa.binary()), ("numbers", pa.binary()), ("texts", pa.list_(pa.string())), ("counts", pa.binary())]))

    own = "word string, lang string, f long" if texts else "key long"
    rows = keys.select(*(c.split()[0] for c in own.split(", "))).mapInArrow(dealt, f"shard int, {own}")
    rows.groupBy("shard").applyInArrow(build, "shard int, hash binary, numbers binary, texts array<string>, counts binary").write.parquet(uri)
    return n


# ---------------------------------------------------------------- counting


def _partial(at: int, node: int, slots: np.ndarray, counts: np.ndarray) -> tuple:
    wide = int(counts.max() > 255 if len(counts) else 0)
    return at, node, wide, slots.astype("<u4").tobytes(), counts.astype("<i8" if wide else "u1").tobytes()


def _counted(numbers: np.ndarray, bits: int, node: int) -> list[tuple]:
    """Partial counts of numbers, a row for each value of the bits above ``bits``."""
    if not len(numbers):
        return []
    numbers = np.sort(numbers)
    edge = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    each, count = numbers[edge], np.diff(np.append(edge, len(numbers)))
    high = each >> bits
    cuts = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1], [True]]))
    return [_partial(int(high[i]), node, each[i:j] & ((1 << bits) - 1), count[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def tree_sum(partial: DataFrame, size: int, nodes: int) -> DataFrame:
    """at, total: sums of partial counts of arrays of ``size`` numbers, sixteen branches to a node."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for r in rows.select(["wide", "slots", "counts"]).to_batches(256):
            for wide, slots, counts in zip(*(r.column(i) for i in range(3)), strict=True):
                total[np.frombuffer(slots.as_buffer(), "<u4")] += np.frombuffer(counts.as_buffer(), "<i8" if wide.as_py() else "u1")
        used = np.flatnonzero(total)
        return pa.Table.from_batches([_rows([_partial(rows["at"][0].as_py(), rows["node"][0].as_py(), used, total[used])], _PARTIAL)])

    while True:
        partial = partial.groupBy("at", "node").applyInArrow(add, _PARTIAL)
        if nodes <= 1:
            return partial
        nodes = -(-nodes // _BRANCHES)
        partial = partial.withColumn("node", F.floor(F.col("node") / _BRANCHES).cast("int"))


def _collapsed(numbers: np.ndarray) -> np.ndarray:
    """Numbers with a single -1 between runs."""
    known = numbers >= 0
    return numbers[known | np.concatenate([[False], known[:-1]])]


def _keys(numbers: np.ndarray) -> np.ndarray:
    """Keys of the neighbours of which both have a number; and their places."""
    at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
    return numbers[at] << 32 | numbers[at + 1], at


class _Bits:
    """Bits by number, from rows of (at, bits) in the shared folder, for ``size`` numbers each."""

    _last: tuple[str, np.ndarray] | None = None

    @classmethod
    def of(cls, uri: str, rows: int, size: int) -> np.ndarray:
        if cls._last is None or cls._last[0] != uri:
            cls._last = None
            bits = np.zeros((rows, size // 8), np.uint8)
            for r in _table(uri, ["at", "bits"]).to_batches(64):
                for at, data in zip(r.column(0).to_pylist(), r.column(1), strict=True):
                    bits[at] = np.frombuffer(data.as_buffer(), np.uint8)
            cls._last = uri, bits.ravel()
        return cls._last[1]


def _has(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (bits[numbers >> 3] >> (numbers & 7).astype(np.uint8) & 1).astype(bool)


def _packed(totals: DataFrame, size: int, least: int) -> DataFrame:
    """at, bits: which numbers have at least ``least``."""

    def run(batches):
        for batch in batches:
            rows = []
            for at, wide, slots, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                enough = np.zeros(size, bool)
                enough[np.frombuffer(slots.as_buffer(), "<u4")[np.frombuffer(counts.as_buffer(), "<i8" if wide else "u1") >= least]] = True
                rows.append((at, np.packbits(enough, bitorder="little").tobytes()))
            if rows:
                yield _rows(rows, "at int, bits binary")

    return totals.mapInArrow(run, "at int, bits binary")


# ---------------------------------------------------------------- the levels


class Miner:
    """Counts phrases; ``least`` is the least count, ``longest`` the most words, ``load`` the mean keys of a bucket."""

    def __init__(self, least: int = 100, longest: int = 5, load: int = 32, shard_keys: int = SHARD_KEYS):
        self.least, self.longest, self.load, self.shard_keys = least, longest, load, shard_keys

    def _bucket_bits(self, n: int) -> int:
        return max(16, int(max(1, n // self.load) - 1).bit_length())

    def levels(self, docs: DataFrame, base: str) -> tuple[DataFrame, list[DataFrame]]:
        """(lang and n, [words, phrases of two words, ...]): words have id, lang, word, f; phrases id, p, s, f.

        p and s are the ids of a phrase's beginning and end of one word less.  All are tables under ``base``.
        """
        spark = docs.sparkSession
        slot_space = 1 << SLOT_BITS
        counts = word_counts(docs)
        counts.where(F.col("word").isNull() | (F.col("f") >= self.least)).write.parquet(f"{base}/words")
        words = spark.read.parquet(f"{base}/words")
        totals = words.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
        n_words = totals.agg(F.sum("n")).first()[0] or 0
        n_shards = write_shards(words.where(F.col("word").isNotNull()), f"{base}/shards1", self.shard_keys)
        slots = Slots(f"{base}/shards1", n_shards)

        def encode(batches):
            for batch in sliced(batches, 1, _CHUNK):
                for langs, texts, place, first in _pairs(batch):
                    number = slots(text_keys(texts, langs))[place]
                    out = np.full(len(number) + int(first.sum()), -1, np.int64)
                    out[np.arange(len(number)) + np.cumsum(first)] = number
                    out = _collapsed(out)
                    if len(out) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<i4").tobytes()], pa.binary())], names=["numbers"])

        docs.mapInArrow(encode, "numbers binary").write.parquet(f"{base}/numbers1")
        found = [self._unpacked_words(spark.read.parquet(f"{base}/shards1"))]
        enough: tuple[str, int] | None = None  # at the first level all numbers are frequent
        for m in range(2, self.longest + 1):
            rows = spark.read.parquet(f"{base}/numbers{m - 1}").select("numbers").where(F.col("numbers").isNotNull())
            nodes = max(1, rows.rdd.getNumPartitions())
            bits = self._bucket_bits(n_words)
            low = max(16, bits - 8)

            def numbers_of(batch, enough=enough):
                for x in batch.column(0):
                    numbers = np.frombuffer(x.as_buffer(), "<i4").astype(np.int64)
                    if enough is not None:
                        numbers = np.where((numbers >= 0) & _has(_Bits.of(enough[0], enough[1], slot_space), np.maximum(numbers, 0)), numbers, -1)
                    yield numbers

            def buckets_of(keys, bits=bits):
                return (mix(keys.view(np.uint64) + np.uint64(7)) >> np.uint64(64 - bits)).astype(np.int64)

            def bucket_counts(batches, numbers_of=numbers_of, buckets_of=buckets_of, low=low):
                from pyspark import TaskContext

                node = TaskContext.get().partitionId() // _BRANCHES
                for batch in batches:
                    for numbers in numbers_of(batch):
                        if out := _counted(buckets_of(_keys(numbers)[0]), low, node):
                            yield _rows(out, _PARTIAL)

            partial = rows.mapInArrow(bucket_counts, _PARTIAL)
            # written first, or each task would have a second Python worker
            tree_sum(partial, 1 << low, -(-nodes // _BRANCHES)).write.parquet(f"{base}/sums{m}")
            _packed(spark.read.parquet(f"{base}/sums{m}"), 1 << low, self.least).write.parquet(f"{base}/buckets{m}")
            full = f"{base}/buckets{m}", 1 << bits - low, 1 << low

            def candidates(batches, numbers_of=numbers_of, buckets_of=buckets_of, full=full):
                for batch in batches:
                    for numbers in numbers_of(batch):
                        keys = np.unique(_keys(numbers)[0])
                        keys = keys[_has(_Bits.of(*full), buckets_of(keys))]
                        yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

            rows.mapInArrow(candidates, "key long").distinct().write.parquet(f"{base}/keys{m}")
            keys = spark.read.parquet(f"{base}/keys{m}")
            if keys.isEmpty():
                break
            n_shards = write_shards(keys, f"{base}/shards{m}", self.shard_keys)
            slots = Slots(f"{base}/shards{m}", n_shards)

            def count(batches, numbers_of=numbers_of, slots=slots):
                from pyspark import TaskContext

                node = TaskContext.get().partitionId() // _BRANCHES
                for batch in batches:
                    for numbers in numbers_of(batch):
                        keys, at = _keys(numbers)
                        each, place = np.unique(keys, return_inverse=True)
                        number = slots(each)[place]
                        known = number >= 0
                        if not known.any():
                            continue
                        out = np.full(len(numbers), -1, np.int64)
                        out[at] = number
                        yield _rows([(_collapsed(out).astype("<i4").tobytes(), None, None, None, None, None)], "numbers binary, " + _PARTIAL)
                        yield _rows([(None, *r) for r in _counted(number[known], SLOT_BITS, node)], "numbers binary, " + _PARTIAL)

            rows.mapInArrow(count, "numbers binary, " + _PARTIAL).write.parquet(f"{base}/numbers{m}")
            partial = spark.read.parquet(f"{base}/numbers{m}").select("at", "node", "wide", "slots", "counts").where(F.col("at").isNotNull())
            tree_sum(partial, slot_space, -(-nodes // _BRANCHES)).write.parquet(f"{base}/totals{m}")
            sums = spark.read.parquet(f"{base}/totals{m}")
            _packed(sums, slot_space, self.least).write.parquet(f"{base}/enough{m}")
            enough = f"{base}/enough{m}", n_shards
            found.append(self._unpacked(spark.read.parquet(f"{base}/shards{m}"), sums))
            drop_dir(spark, f"{base}/numbers{m - 1}")
            drop_dir(spark, f"{base}/sums{m}")
            drop_dir(spark, f"{base}/buckets{m}")
            drop_dir(spark, f"{base}/keys{m}")
        return totals, found

    def _unpacked_words(self, shards: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    parts = [t.split("\n", 1) for t in r["texts"]]
                    ids = (r["shard"] << SLOT_BITS) + np.arange(len(parts), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x[1] for x in parts], pa.string()), pa.array([x[0] for x in parts], pa.string()), pa.array(np.frombuffer(r["counts"], "<i8"))], names=["id", "lang", "word", "f"])

        return shards.select("shard", "texts", "counts").mapInArrow(run, "id long, lang string, word string, f long")

    def _unpacked(self, shards: DataFrame, totals: DataFrame) -> DataFrame:
        least = self.least

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    slots, counts = np.frombuffer(r["slots"], "<u4"), np.frombuffer(r["counts"], "<i8" if r["wide"] else "u1").astype(np.int64)
                    slots, counts = slots[counts >= least].astype(np.int64), counts[counts >= least]
                    keys = np.frombuffer(r["numbers"], "<i8")[slots]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((r["shard"] << SLOT_BITS) + slots, keys >> 32, keys & 0xFFFFFFFF, counts)], names=["id", "p", "s", "f"])

        rows = shards.select("shard", "numbers").join(totals.select(F.col("at").alias("shard"), "wide", "slots", "counts"), "shard")
        return rows.select("shard", "numbers", "wide", "slots", "counts").mapInArrow(run, "id long, p long, s long, f long")


#: Exact: products of up to 38 digits, and a whole quotient below ten times the number of words.
_SCORE = "(cast(1000 AS decimal(4,0)) * cast(f AS decimal(15,0)) * cast(n AS decimal(18,0))) div (cast(pf[k - 1] AS decimal(19,0)) * cast(sf[k] AS decimal(19,0)))"


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = 2000, share: int = 100, miner: Miner | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are lower-cased in A-Z only; null texts have no words, null languages are ``und``.  A phrase's score is that of
    its weakest cut, 1000 a n / (l r) floored, a and n the counts of the phrase and of all words, l and r those of the
    two parts.  Phrases inside a longer one that is at least ``share`` percent as frequent are left out.  Repeated rows
    count as often as they occur; without words there are no rows.
    """
    miner = miner or Miner()
    spark = docs.sparkSession
    base = shared_dir(spark)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    totals, levels = miner.levels(rows, base)
    same = F.array("f").alias("x")
    levels[0].select("id", "lang", F.col("word").alias("text"), F.col("word").alias("last"), "f", same.alias("pf"), same.alias("sf")).write.parquet(f"{base}/phrases1")
    out = None
    for m, level in enumerate(levels[1:], 2):
        before = spark.read.parquet(f"{base}/phrases{m - 1}")
        begin = before.select(F.col("id").alias("p"), "lang", F.col("text").alias("_text"), F.col("pf").alias("_pf"))
        end = before.select(F.col("id").alias("s"), "last", F.col("sf").alias("_sf"))
        made = level.join(begin, "p").join(end, "s").select(
            "id", "lang", F.concat_ws(" ", "_text", "last").alias("text"), "last", "f", F.concat("_pf", F.array("f")).alias("pf"), F.concat(F.array("f"), "_sf").alias("sf"), "p", "s"
        )
        made.write.parquet(f"{base}/phrases{m}")
    for m in range(2, len(levels) + 1):
        part = spark.read.parquet(f"{base}/phrases{m}")
        if m < len(levels):
            longer = spark.read.parquet(f"{base}/phrases{m + 1}")
            more = longer.select(F.explode(F.array("p", "s")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("_more"))
            part = part.join(more, "id", "left").where(F.coalesce(F.col("_more") * 100 < F.col("f") * share, F.lit(True)))
        part = part.join(totals, "lang").withColumn("cut", F.expr(f"array_min(transform(sequence(1, {m - 1}), k -> struct({_SCORE} AS score, k AS k, pf[k - 1] AS l, sf[k] AS r)))"))
        part = part.select("lang", F.col("text").alias("phrase"), F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(len(w))) AS i FROM pieces),
phrases AS (
  SELECT lang, m, array_to_string(list_slice(w, i + 1, i + m), ' ') AS phrase, count(*) AS f
  FROM starts, range(1, 6) t(m) WHERE i + m <= len(w) GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM phrases WHERE m >= 2),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.f AS l, y.f AS r, s.n, ((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN sizes s USING (lang) JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.m), ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i + 1, i + j), ' ') AS phrase, max(a) AS more
  FROM (SELECT lang, w, m, a, unnest(range(m)) AS i FROM candidates), range(2, 5) t(j) WHERE j < m AND i + j <= m GROUP BY ALL),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN inside USING (lang, phrase) WHERE more IS NULL OR 100 * more < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
