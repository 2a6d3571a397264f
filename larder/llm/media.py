"""Media columns: content-addressed payloads in tar shards.

Each task turns its texts into 8-bit grayscale PNG images (64 samples a row), names them by the SHA-256 of their
samples and appends them to tar shards of bounded size; within a task, whose share of texts is bounded, a digest is stored once.  Rows carry digest,
shard, offset and length.  A digest that several tasks have stored is resolved to its first place by a small
aggregation, so payload bytes are never shuffled and every row with that digest points to one object.  Header-only range
reads (the first 33 bytes of an object) fill the metadata columns; features read the whole object back.

Edge cases: a null text is empty; an empty text is 64 zero bytes; texts that differ only in trailing zero bytes share a
payload but keep their own ``n_bytes``; repeated rows give repeated rows; a null doc_id stays null; an empty table writes
no shard.  Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import fresh_path, join_groups, splits, staged, storage, text_bytes

WIDTH = 64
SHARD_BYTES = 256 << 20
#: PNG signature and IHDR chunk.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(payload: bytes) -> bytes:
    """A lossless 8-bit grayscale image, one byte a sample."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row after a zero: no filter
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from an image's first bytes."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, bits = struct.unpack(">IIB", start[16:25])
    return width, height, bits


def png_decode(image: bytes) -> bytes:
    width, height, _ = png_header(image)
    at, data = 8, []
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def average_hash(payload: bytes) -> bytes:
    """64 bits: which of 64 equal stretches of the samples are brighter than the whole."""
    samples = np.frombuffer(payload, np.uint8)
    sums = np.add.reduceat(samples, np.arange(64) * len(samples) // 64, dtype=np.int64)
    return np.packbits(sums * 64 > samples.sum(dtype=np.int64)).tobytes()


class _Shards:
    """Tar shards of one task; a finished shard is moved to its final name, so a repeated task overwrites its own."""

    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.number, self.sink = folder, part, -1, None
        self.fs, self.base = storage(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.places: dict[bytes, tuple[str, int, int]] = {}

    def _open(self) -> None:
        self.close()
        self.number += 1
        self.name = f"part-{self.part:06d}-{self.number:04d}.tar"
        self.own = f"{self.base}/{self.name}.{TaskContext.get().taskAttemptId()}"
        self.sink, self.at = self.fs.open_output_stream(self.own), 0

    def put(self, digest: bytes, payload: bytes) -> tuple[str, int, int]:
        if digest not in self.places:
            if self.sink is None or self.at > SHARD_BYTES:
                self._open()
            image = png_encode(payload)
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(image)
            head = info.tobuf()
            self.sink.write(head + image + bytes(-len(image) % tarfile.BLOCKSIZE))
            self.places[digest] = (f"{self.folder}/{self.name}", self.at + len(head), len(image))
            self.at += len(head) + len(image) + -len(image) % tarfile.BLOCKSIZE
        return self.places[digest]

    def close(self) -> None:
        if self.sink is not None:
            self.sink.write(bytes(2 * tarfile.BLOCKSIZE))
            self.sink.close()
            self.fs.move(self.own, f"{self.base}/{self.name}")


_ROW = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"


def _store_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder, TaskContext.get().partitionId())
        for batch in batches:
            texts = text_bytes(batch.column(1))
            digests, places = [], []
            for text in texts:
                payload = padded(text)
                digests.append(hashlib.sha256(payload).digest())
                places.append(shards.put(digests[-1], payload))
            shard, offset, length = zip(*places, strict=True) if places else ((), (), ())
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.binary()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return run


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write all payloads; a row for each document (doc_id, n_bytes, digest), and one for each digest (shard, offset, length, n documents)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = staged(spark, rows.mapInArrow(_store_batches(fresh_path(spark, "media")), _ROW), "media-rows")
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    places = found.groupBy("digest").agg(place, F.count("*").alias("n")).select("digest", "place.*", "n")
    return found.select("doc_id", "n_bytes", "digest"), staged(spark, places, "media-places")


def _ranges(batches: Iterator[pa.RecordBatch], size) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch (digest, shard, offset, length, n) with a range of each object: ``size(length)`` bytes from its start."""
    at, source = None, None
    for batch in batches:
        found = []
        for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if shard != at:
                fs, path = storage(shard)
                at, source = shard, fs.open_input_file(path)
            found.append(source.read_at(size(length), offset))
        yield batch, found


def _header_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, starts in _ranges(batches, lambda length: min(length, HEADER_BYTES)):
        columns = list(zip(*map(png_header, starts), strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in columns)], [*batch.schema.names, "width", "height", "bits"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, images in _ranges(batches, lambda length: length):
        rows = []
        for digest, image in zip(batch.column(0).to_pylist(), images, strict=True):
            payload = png_decode(image)
            if hashlib.sha256(payload).digest() != digest:
                raise ValueError(f"the stored object {digest.hex()} is damaged")
            rows.append((len(payload), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).digest(), average_hash(payload)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
        keep = [batch.column(i) for i in (0, 4, 5, 6, 7)]
        yield pa.RecordBatch.from_arrays(keep + columns, ["digest", "n", "width", "height", "bits", "payload_bytes", "tail_crc32", "media_bytes", "media_digest", "hash"])


def read_metadata(places: DataFrame) -> DataFrame:
    """Adds width, height and bits to (digest, shard, offset, length, n), by reading headers only."""
    return places.mapInArrow(_header_batches, "digest binary, shard string, offset long, length long, n long, width int, height int, bits int")


def read_features(places: DataFrame) -> DataFrame:
    """Digests, sizes and a feature of whole objects, read back and held against their names, for rows of ``read_metadata``."""
    return places.mapInArrow(_feature_batches, "digest binary, n long, width int, height int, bits int, payload_bytes long, tail_crc32 long, media_bytes long, media_digest binary, hash binary")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores all payloads and gives each document the metadata and features of its object."""
    spark = docs.sparkSession
    rows, places = store(docs)
    # Objects in the order of their shards, in as many tasks as wrote them: a task's share of bytes does not grow.
    objects = places.repartitionByRange(splits(docs), "shard", "offset").sortWithinPartitions("shard", "offset")
    features = staged(spark, read_features(read_metadata(objects)), "media-features")
    found = join_groups(rows, features, "digest", broadcast_rows=20_000)
    hexed = {"payload_sha256": "digest", "media_sha256": "media_digest", "feature": "hash"}
    return found.withColumns({name: F.lower(F.hex(c)) for name, c in hexed.items()})


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")
