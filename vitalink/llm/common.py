"""Shared helpers: checkpoints, shared folders, and vectorised handling of words in Arrow text columns."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, in Java and Python regular expressions and in DuckDB.
SPACE = "\\x20\\x09-\\x0D"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ---------------------------------------------------------------- Spark side


def _shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder under /tmp if the driver is the only machine."""
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/vitalink-shared"


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    return f"{_shared_base(spark)}/vitalink-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store Spark has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared checkpoint folder and forget its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, col: str) -> tuple[int, int]:
    """(rows, UTF-8 bytes of a text column)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(col)).cast("long")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def n_words(text: Column) -> Column:
    """Number of words of a text: 0 for null and blank ones."""
    body = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(body, f"[{SPACE}]+"))
    ).cast("long")


# ---------------------------------------------------------------- Arrow side


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty.  Offsets are int64 and start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words, and the number of the first word of each text (one more at the end)."""
    if not len(raw):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a round."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = end - start
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    left = np.minimum(length, 8).astype(np.uint64)
    mask = np.where(left >= 8, full, (np.uint64(1) << (left * np.uint64(8) % np.uint64(64))) - np.uint64(1))
    h = mix((eights[start] & mask) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    done = 8
    at = np.flatnonzero(length > done)
    while len(at):
        rest = np.minimum(length[at] - done, 8).astype(np.uint64)
        mask = np.where(rest >= 8, full, (np.uint64(1) << (rest * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        h[at] = mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + (eights[start[at] + done] & mask))
        done += 8
        at = at[length[at] > done]
    return h


def window_hashes(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each run of n values (len(h) - n + 1 of them), by doubling a polynomial over 2^64."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    out, have, block, size = None, 0, h, 1
    left = n
    while left:
        if left & 1:
            out, have = (block, size) if out is None else (out[: len(block) - have] + power(have) * block[have:][: len(out)], have + size)
        left >>= 1
        if left:
            block = block[:-size] + power(size) * block[size:]
            size *= 2
    return mix(out[: len(h) - n + 1])


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the words at which a window of n words of one text starts."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(count) - count
    return np.arange(total) - np.repeat(skip, count) + np.repeat(first[:-1], count)


def sliced(batches, text: int, most: int = 2 << 20):
    """Arrow batches cut into slices of about ``most`` bytes of a text column (more where one text is longer)."""
    for batch in batches:
        for i, j in slices(utf8(batch.column(text))[1], most):
            yield batch.slice(i, j - i)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of texts of about `most` bytes each (more where one text is longer)."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, min(to, n)))
        at = min(to, n)
    return out
