"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

File format.  A shard ``*.rec`` begins with 8 bytes: ``VLREC1``, the width of an id in bytes, a zero.  Then comes
one record for each document::

    uint64  length of the payload           uint32  masked CRC-32 of these 8 bytes
    payload                                 uint32  masked CRC-32 of the payload

All numbers are little-endian.  The payload is one byte (1: the document has an id), the int64 id, and the token
ids, the end id included.  A checksum is masked as ``rotate_right(crc, 15) + 0xa282ead8``, so that checksums of data
that hold checksums stay useful.  The index ``*.idx`` has the uint64 offset of each record and of the end of the
shard, so a reader can seek to any record and read in shuffled order (:func:`read_record`).

Each task writes its shard under a name of its own attempt and puts that name in the manifest, a table beside the
shards; Spark commits the rows of successful attempts only, so that lost executors and repeated attempts leave no trace
in the result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, sliced, text_bytes, utf8

MAGIC = b"VLREC1"
_FRAME = struct.Struct("<QI")
_HEAD = struct.Struct("<Bq")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(key: int | None, tokens: bytes) -> bytes:
    """One record, from the id of its document and its serialized token ids."""
    payload = _HEAD.pack(key is not None, key or 0) + tokens
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


#: Bytes of letters that are letters in any Unicode version: ASCII, and U+00C0 to U+017F but two signs.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4\xC5][\x80-\xBF])+")
_LETTER, _SOLID = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SOLID[0x21:0x7F] = True
#: ASCII characters that end before a letter begins; an apostrophe may belong to it.
_MARK = _SOLID & ~_LETTER
_MARK[ord("'")] = False
#: By the first byte, the length of characters that are no white space; others may be.
_WIDTH = np.zeros(256, np.uint8)
_WIDTH[0xC3:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:0xF8] = 2, 3, 4
_WIDTH[0xE1:0xE4] = 0


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin that a byte-level BPE is sure to split, and the end of the last.

    It splits after each run of letters, between a mark or digit and a letter, and about a space or line end that stands
    alone between two other characters.  Where a character may be white space or a letter of some other kind, no cut is
    made.
    """
    letter, solid = _LETTER[raw], _SOLID[raw]
    lead = np.flatnonzero(raw >= 0xC3)
    for width in (2, 3, 4):
        at = lead[_WIDTH[raw[lead]] == width]
        for k in range(width):
            solid[at + k] = True
    at = lead[raw[lead] <= 0xC5]
    at = at[(raw[at] != 0xC3) | ((raw[at + 1] != 0x97) & (raw[at + 1] != 0xB7))]
    letter[at] = letter[at + 1] = True
    cut = np.zeros(len(raw) + 1, bool)
    inner = cut[1:-1]  # before byte 1, 2, ...
    inner |= letter[:-1] & ~letter[1:] & (raw[1:] < 0x80)
    inner |= _MARK[raw[:-1]] & letter[1:]
    between = solid[:-2] & solid[2:]
    cut[1:-2] |= between & (raw[1:-1] == 0x20)
    line = between & (raw[1:-1] == 0x0A)
    cut[1:-2] |= line
    cut[2:-1] |= line
    cut[offsets] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes whole texts with a tokenizer file, remembering the ids of their pieces.

    A byte-level BPE splits texts before merging, and :func:`piece_starts` finds places where it is sure to.  Pieces are
    therefore encoded once and joined; texts with the text of a special token go through the tokenizer whole.  Up to
    ``most`` pieces are kept, and those of one batch more, as two Arrow columns, which take some 30 bytes a piece where
    Python objects take 200; beyond that, the half stays that was used last.  Pieces of over ``longest`` bytes are not
    kept.
    """

    def __init__(self, path: str, width: int = 0, most: int = 400_000, longest: int = 100):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executors' cores are taken already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.width = width or (2 if size <= 1 << 16 else 4)
        self.kind = np.dtype(f"<u{self.width}")
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = pa.array([], pa.binary())
        self.coded = pa.array([], pa.large_binary())  # the ids of each piece
        self.used = np.zeros(0, np.int64)  # the last batch that had it
        self.batch = 0
        self.most, self.longest = most, longest
        split = repr(self.tokenizer.pre_tokenizer)  # the tokenizer's whole JSON would take far more memory
        self.by_word = split.startswith("ByteLevel(") and "add_prefix_space=False" in split and "use_regex=True" in split and self.tokenizer.normalizer is None
        #: The id of a line end, which byte-level vocabularies write as U+010A.
        self.line = vocabulary.get("\u010a", -1)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of new pieces.  Runs of letters are encoded together, a line end between two."""
        out = {}
        fit = [x for x in new if _LETTERS.fullmatch(x)]
        if fit:
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(fit).decode()], add_special_tokens=False)[0].ids, self.kind)
            line = np.flatnonzero(ids == self.line)
            if len(line) == len(fit) - 1:
                data, cuts = ids.tobytes(), (np.concatenate([[-1], line, [len(ids)]]) * self.width).tolist()
                out.update(zip(fit, [data[i + self.width : j] for i, j in zip(cuts, cuts[1:], strict=False)], strict=True))
        other = [x for x in new if x not in out]
        for at in range(0, len(other), 1000):
            part = other[at : at + 1000]
            out.update(zip(part, self._whole([x.decode() for x in part]), strict=True))
        return [out[x] for x in new]

    def _forget(self) -> None:
        """Keep the half of ``most`` that was used last."""
        kept = np.sort(np.argsort(self.used, kind="stable")[len(self.used) - self.most // 2 :])
        self.words, self.coded, self.used = self.words.take(pa.array(kept)), self.coded.take(pa.array(kept)), self.used[kept]

    def _found(self, pieces: pa.BinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """(ids, where among them those of each piece are) of different pieces."""
        if len(self.words) > self.most:
            self._forget()
        self.batch += 1
        at = pc.index_in(pieces, value_set=self.words)
        lost = pieces.filter(at.is_null())
        where = at.fill_null(-1).to_numpy()
        self.used[where[where >= 0]] = self.batch
        if not len(lost):
            return self.coded, where
        learnt = [pa.array(self._learn(lost[k : k + 10_000].to_pylist()), pa.large_binary()) for k in range(0, len(lost), 10_000)]
        coded = pa.concat_arrays([self.coded, *learnt])
        where = np.where(where < 0, len(self.words) - 1 + np.cumsum(where < 0), where)
        if pc.max(pc.binary_length(lost)).as_py() > self.longest:
            short = pc.less_equal(pc.binary_length(lost), self.longest)
            lost, learnt = lost.filter(short), [pa.concat_arrays(learnt).filter(short)]
        self.words, self.coded = pa.concat_arrays([self.words, lost]), pa.concat_arrays([self.coded, *learnt])
        self.used = np.concatenate([self.used, np.full(len(lost), self.batch)])
        return coded, where

    def encode_flat(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin, and the end) of UTF-8 texts, as :func:`utf8` gives them."""
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        data = raw.tobytes()
        starts = piece_starts(raw, offsets) if self.by_word else np.unique(offsets)
        if self.by_word and any(x in data for x in self.special):
            bounds = offsets.tolist()
            plain = np.array([not any(x in data[i:j] for x in self.special) for i, j in zip(bounds, bounds[1:], strict=False)] + [True])
            text = np.searchsorted(offsets, starts, "right") - 1
            starts = starts[plain[text] | (starts == offsets[text])]
        edges = pa.py_buffer(starts.astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, edges, pa.py_buffer(data)]).dictionary_encode()
        coded, where = self._found(pieces.dictionary)
        joined = coded.take(pa.array(where[pieces.indices.to_numpy()]))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(starts)]
        ids = np.frombuffer(joined.buffers()[2] or b"", self.kind, int(ends[-1]) // self.width)
        return ids, ends[np.searchsorted(starts, offsets)] // self.width

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        ids, at = self.encode_flat(*utf8(pa.array(texts, pa.string())))
        data, cuts = ids.tobytes(), (at * self.width).tolist()
        return [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_bytes: int = 16 << 20) -> DataFrame:
    """Encode texts and write them as records, in ascending order of id.

    Return the manifest, which is also a table under ``out``: uri (without suffix), part (the shards' order), n_docs,
    n_tokens of each shard.

    Null texts count as empty (their record has the end id only); null ids come first; rows of equal id are ordered
    by text, and each gives a record.  Other columns are ignored.  An empty table gives no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = max(shuffle_partitions(spark), -(-text_bytes(rows, "text")[1] // shard_bytes))

    def write(batches):
        encoder = _encoder(tokenizer)
        store = path = sink = None
        sizes, n_docs, n_tokens = [8], 0, 0
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in sliced(batches, 1):
            keys = batch.column(0).to_pylist()
            if sink is None:
                store, base = _open(out)
                store.create_dir(base, recursive=True)
                path = f"{base}/{uuid.uuid4().hex}"
                sink = store.open_output_stream(path + ".rec")
                sink.write(MAGIC + bytes([encoder.width, 0]))
            ids, at = encoder.encode_flat(*utf8(batch.column(1)))
            data, cuts = ids.tobytes(), (at * encoder.width).tolist()
            framed = [frame(key, data[i:j] + end) for key, i, j in zip(keys, cuts, cuts[1:], strict=False)]
            sizes += map(len, framed)
            n_tokens += len(ids) + len(keys)
            n_docs += len(keys)
            sink.write(b"".join(framed))
            del ids, framed, data
            pa.default_memory_pool().release_unused()  # else Arrow keeps some 100 MB for later
        if sink is not None:
            sink.close()
            with store.open_output_stream(path + ".idx") as index:
                index.write(np.cumsum(sizes).astype("<u8").tobytes())
            yield pa.RecordBatch.from_pydict({
                "uri": [f"{out}/{path.rsplit('/', 1)[1]}"], "part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()),
            })

    from pyspark import TaskContext

    rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text").mapInArrow(write, "uri string, part long, n_docs long, n_tokens long").write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def starts(manifest: DataFrame, block: int = 1024) -> DataFrame:
    """(uri, start): the number of token ids before each shard, summed up in blocks of ``block`` shards."""
    rows = manifest.select("uri", "part", "n_tokens", F.floor(F.col("part") / block).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = lambda n, of: F.coalesce(F.sum(n).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each block of shards
    blocks = F.broadcast(blocks.select(F.col("block").alias("b"), before("n", Window.orderBy("block")).alias("upto")))
    within = before("n_tokens", Window.partitionBy("block").orderBy("part"))
    return rows.withColumn("within", within).join(blocks, F.col("block") == F.col("b")).select("uri", (F.col("upto") + F.col("within")).alias("start"))


def parse(frame: bytes, width: int) -> tuple[int | None, np.ndarray]:
    """(id, token ids) of one record; ValueError where a checksum doesn't hold."""
    length, check = _FRAME.unpack_from(frame)
    payload = frame[12 : 12 + length]
    if masked(frame[:8]) != check or len(frame) != length + 16 or masked(payload) != struct.unpack_from("<I", frame, 12 + length)[0]:
        raise ValueError("damaged record")
    known, key = _HEAD.unpack_from(payload)
    return key if known else None, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def read_record(uri: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a shard (``uri`` without suffix), found through the index."""
    store, path = _open(uri)
    with store.open_input_file(path + ".idx") as index:
        lo, hi = struct.unpack("<2Q", index.read_at(16, 8 * k))
    with store.open_input_file(path + ".rec") as shard:
        return parse(shard.read_at(hi - lo, lo), shard.read_at(1, 6)[0])


def read_records(manifest: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before), n_tokens, ids_crc32, one row for each record."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    spark = manifest.sparkSession

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = _open(uri)
                with store.open_input_stream(path + ".idx") as index:
                    at = np.frombuffer(index.read(), "<u8")
                with store.open_input_stream(path + ".rec", buffer_size=1 << 20) as shard:
                    head = shard.read(8)
                    if head[:6] != MAGIC:
                        raise ValueError(f"{path} is no shard")
                    rows = []
                    for k, size in enumerate(np.diff(at).tolist()):
                        key, ids = parse(shard.read(size), head[6])
                        rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000 or k == len(at) - 2:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []

    return starts(manifest).repartition(max(1, 4 * shuffle_partitions(spark))).mapInArrow(read, schema)


def token_records(docs: DataFrame, tokenizer: str, out: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token records under ``out`` (default: a new shared folder) and read them back."""
    return read_records(write_records(docs, out or shared_dir(docs.sparkSession), tokenizer, **options))
