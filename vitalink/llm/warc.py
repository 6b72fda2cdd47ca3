"""Dictionary-compressed WARC archives.

An archive ``*.warc.zst`` begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from
the archive's own records; every record then is a frame of its own, compressed with it, so that each can be read alone.
``*.idx`` has the uint64 offset of each frame and of the end.  Of records with equal payloads one is a response; the
others are revisits (RFC-style headers of WARC/1.1, profile identical-payload-digest) without the payload.

Each task writes under names of its own attempt; only the names that successful tasks return are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, shuffle_partitions

SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"  # the pages carry no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:vitalink:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """(page_id, url, payload bytes, digest, type, refers_to, payload) of a record; the digest of a response is taken anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    number = lambda x: int(y) if (y := field[x][len(_URN) + 1 : -1]) else None
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    if field["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), field.get("WARC-Target-URI"), size, digest, "revisit", number("WARC-Refers-To"), None
    if size != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("damaged payload")
    return number("WARC-Record-ID"), field.get("WARC-Target-URI"), size, digest, "response", None, payload


def build_dictionary(records: list[bytes], size: int, samples: int = 4000) -> bytes:
    """A dictionary of at most ``size`` bytes from evenly spaced records of a whole archive.

    Few records are cut into pieces, so that one is enough to learn from; where even the pieces are too few to train on,
    the dictionary is the records' own bytes (Zstandard's raw-content kind).
    """
    step = max(1, len(records) // samples, sum(map(len, records)) // (64 * size))
    some = records[::step]
    total = sum(map(len, some))
    if len(some) < 64:
        piece = max(64, min(2048, total // 64))
        some = [x[i : i + piece] for x in some for i in range(0, len(x), piece)]
    try:
        return zstandard.train_dictionary(max(256, min(size, total // 4)), some).as_bytes()
    except zstandard.ZstdError:
        return b"".join(some)[:size]


class Writer:
    """Writes archives of about ``archive_bytes`` of records each; an archive's records wait for its dictionary."""

    def __init__(self, out: str, level: int, dictionary_bytes: int, archive_bytes: int):
        self.store, self.base = fs.FileSystem.from_uri(out)
        self.store.create_dir(self.base, recursive=True)
        self.level, self.dictionary_bytes, self.archive_bytes = level, dictionary_bytes, archive_bytes
        self.waiting: list[bytes] = []
        self.held = 0

    def add(self, data: bytes) -> tuple[str, int] | None:
        """(name, records) of the archive that this record completes."""
        self.waiting.append(data)
        self.held += len(data)
        return self.close() if self.held >= self.archive_bytes else None

    def close(self) -> tuple[str, int] | None:
        if not self.waiting:
            return None
        name, n = uuid.uuid4().hex, len(self.waiting)
        words = build_dictionary(self.waiting, self.dictionary_bytes)
        compress = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(words)).compress
        at = [8 + len(words)]
        with self.store.open_output_stream(f"{self.base}/{name}.warc.zst", compression=None) as sink:  # the default would compress by suffix
            sink.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
            for x in self.waiting:
                data = compress(x)
                sink.write(data)
                at.append(at[-1] + len(data))
        with self.store.open_output_stream(f"{self.base}/{name}.idx") as index:
            index.write(np.array(at, "<u8").tobytes())
        self.waiting, self.held = [], 0
        return name, n


def read_archive(uri: str):
    """The records of an archive (``uri`` without suffix), in order."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path + ".idx") as index:
        at = np.frombuffer(index.read(), "<u8")
    with store.open_input_stream(path + ".warc.zst", compression=None, buffer_size=1 << 20) as archive:
        magic, size = struct.unpack("<II", archive.read(8))
        if magic != SKIPPABLE:
            raise ValueError("no leading skippable frame")
        words = archive.read(size)
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompress
        for n in np.diff(at).tolist():
            yield expand(archive.read(n))


def _answered(rows: DataFrame, first: DataFrame, few: int) -> DataFrame:
    """``rows`` with the column ``first`` of their digest, null where it occurs once.

    Up to ``few`` repeated digests are broadcast, so that no payload moves.  Beyond, those that hold over a 10,000th of
    all rows each (so 10,000 at most) are, and the rest is joined by digest.
    """
    first = cut(first)
    narrow = first.select(F.col("digest").alias("d"), "first", "n")
    if first.count() <= few:
        return rows.join(F.broadcast(narrow), F.col("digest") == F.col("d"), "left")
    total = rows.count()
    hot, rest = narrow.where(F.col("n") * 10_000 > total), narrow.where(F.col("n") * 10_000 <= total)
    known = rows.join(F.broadcast(hot), F.col("digest") == F.col("d"), "left")
    others = known.where("d is null").drop("d", "first", "n").join(rest, F.col("digest") == F.col("d"), "left")
    return known.where("d is not null").unionByName(others)


def write_archives(
    pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, level: int = 3, dictionary_bytes: int = 16 << 10,
    archive_bytes: int = 32 << 20, few: int = 200_000,
) -> DataFrame:
    """Write a record for each row; return the manifest (uri, n), which is also a table under ``out``.

    The payload is the html in UTF-8; null counts as empty.  Of records with equal payloads of at least ``least``
    bytes that with the smallest id is the response and the others revisit it.  Rows that repeat the smallest id are
    responses as well, rows without an id are revisits if another of their payload has one.  Other columns are ignored.
    A task holds ``archive_bytes`` of records at a time and one record more.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = _answered(rows, first, few).select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        writer = None
        row = lambda done: pa.RecordBatch.from_pydict({"uri": [f"{out}/{done[0]}"], "n": pa.array([done[1]], pa.int64())})
        for batch in batches:
            writer = writer or Writer(out, level, dictionary_bytes, archive_bytes)
            for k in range(batch.num_rows):
                if done := writer.add(record(*(c[k].as_py() for c in batch.columns))):
                    yield row(done)
        if writer and (done := writer.close()):
            yield row(done)

    known.mapInArrow(write, "uri string, n long").write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row for each record of the archives."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for x in map(parse, read_archive(uri)):
                    rows.append((x[0], *x[2:6]))
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    spark = manifest.sparkSession
    return manifest.select("uri").repartition(max(1, 4 * shuffle_partitions(spark))).mapInArrow(read, schema)


def round_trip(pages: DataFrame, out: str | None = None, **options) -> DataFrame:
    """Write archives under ``out`` (default: a new shared folder) and read them back."""
    return read_archives(write_archives(pages, out or shared_dir(pages.sparkSession), **options))


ORACLE = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
known AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM rows)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM known
"""
