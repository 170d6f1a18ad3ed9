"""Media columns: content-addressed payloads in tar shards.

Method: each distinct payload is stored once per task as a member of a tar shard, named by its SHA-256; a row carries only
digest, shard, offset and length. Rows of one digest agree on one copy, the least (shard, offset). Metadata columns are filled
by range reads of the members' first 33 bytes, the PNG signature and header; only readers of pixels fetch whole members.

Here a payload is a text's UTF-8 bytes, zero-padded to a positive multiple of 64, kept losslessly as an 8-bit grey PNG, 64
pixels wide. Shards are written to the shared folder with pyarrow's file systems, a new name per attempt, so a task that is
lost leaves a file that no row refers to; rows are written down before anything is read back. Texts are never shuffled.
A task remembers digests of its own partition only, the last REMEMBERED; copies in other tasks' shards stay as unreferenced bytes.

Defined cases: null and empty texts are 64 zero bytes with n_bytes 0; texts that differ only in trailing NULs share a payload;
repeated rows share a member; an empty table gives an empty result and no shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import fresh_path, settle, small_batches, table

WIDTH, SHARD_BYTES, HEADER_BYTES = 64, 256 << 20, 33
#: Media bytes that are read together; and keys a task remembers, beyond which it forgets them all.
READ_BYTES, REMEMBERED = 8 << 20, 1 << 17
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row has filter byte 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height, bits per sample from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    width, height, bits = read_header(media[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            packed.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * bits // 8 + 1)
    if rows[:, 0].any():
        raise ValueError("rows with a filter are not of this writer")
    return rows[:, 1:].tobytes()


class Shards:
    """Tar shards of one task: add() gives (shard, offset, length); members are appended, never changed."""

    def __init__(self, folder: str, limit: int):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.name, self.at = limit, None, "", 0

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at + len(data) > self.limit:
            self.close()
        if self.out is None:
            self.system.create_dir(self.root, recursive=True)
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.system.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        offset = self.at + len(head)
        pad = bytes(-len(data) % tarfile.BLOCKSIZE)
        for part in (head, data, pad):
            self.out.write(part)
        self.at = offset + len(data) + len(pad)
        return self.name, offset, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length), a row per row of ``docs``, settled; writes the shards."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = Shards(folder, shard_bytes), {}
        for batch in batches:
            sizes, digests, places = [], [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                payload = payload_of(data)
                digest = hashlib.sha256(payload).digest()
                if len(known) > REMEMBERED:  # a copy stored twice does no harm
                    known.clear()
                if digest not in known:
                    known[digest] = shards.add(f"{digest.hex()}.png", encode_png(payload))
                sizes.append(len(data))
                digests.append(digest)
                places.append(known[digest])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *(pa.array([p[i] for p in places], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return settle(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(write, schema))


def members(rows: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): the one copy that counts for each digest, in the order of the shards.

    Dealt by stretches of READ_BYTES of a shard, as many tasks as there are stretches by their bytes: rows here are small, what they
    ask to read is not."""
    best = settle(rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("_m")).select("digest", "_m.*"))
    size = best.agg(F.sum("length")).first()[0] or 0
    return best.repartition(max(1, -(-size // READ_BYTES)), "shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")


def ranged(folder: str, shards: list[str], offsets: list[int], lengths: list[int]) -> Iterator[bytes]:
    """Range reads; a shard stays open while rows of it follow each other."""
    system, root = fs.FileSystem.from_uri(folder)
    name, source = None, None
    for shard, offset, length in zip(shards, offsets, lengths, strict=True):
        if shard != name:
            if source is not None:
                source.close()
            name, source = shard, system.open_input_file(f"{root}/{shard}")
        yield source.read_at(length, offset)
    if source is not None:
        source.close()


def with_metadata(objects: DataFrame, folder: str) -> DataFrame:
    """Adds width, height, bits by reading HEADER_BYTES bytes of each member."""
    schema = T.StructType([*objects.schema.fields, *(T.StructField(n, T.IntegerType()) for n in ("width", "height", "bits"))])
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, offsets = batch.column("shard").to_pylist(), batch.column("offset").to_pylist()
            heads = [read_header(h) for h in ranged(folder, shards, offsets, [HEADER_BYTES] * len(shards))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([h[i] for h in heads], pa.int32()) for i in range(3))], names=names)

    return objects.mapInArrow(read, schema)


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours in a row and in a column."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    share = np.bincount(x.ravel(), minlength=256) / x.size
    share = share[share > 0]
    x = x.astype(np.int32)
    steps = np.abs(np.diff(x, axis=1)).mean(), np.abs(np.diff(x, axis=0)).mean() if len(x) > 1 else 0.0
    return "mean=%.4f,std=%.4f,entropy=%.4f,dx=%.4f,dy=%.4f" % (x.mean(), x.std(), -(share * np.log2(share)).sum() + 0.0, *steps)


def with_payload(objects: DataFrame, folder: str) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature from the members as stored."""
    kinds = {"payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("long", pa.int64()), "media_bytes": ("long", pa.int64()), "media_sha256": ("string", pa.string()), "feature": ("string", pa.string())}
    schema = objects.schema
    for name, (kind, _) in kinds.items():
        schema = T.StructType([*schema.fields, T.StructField(name, T.LongType() if kind == "long" else T.StringType())])
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for media in ranged(folder, *(batch.column(n).to_pylist() for n in ("shard", "offset", "length"))):
                payload = decode_png(media)
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(kinds.values()))], names=names)

    return objects.mapInArrow(read, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "media")
    rows = store(table(spark, sf_dir, "documents"), folder)
    objects = settle(with_payload(with_metadata(members(rows), folder), folder).drop("shard", "offset", "length"))
    out = rows.select("doc_id", "n_bytes", "digest").join(objects, "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")
