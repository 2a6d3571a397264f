"""Token ids in Arrow IPC files of fixed-size-list batches.

Documents are range-partitioned and sorted by doc_id, into twice as many ranges as tasks read them, and each partition
writes its run of ids as one Arrow file: rows
are sequences of equal length with a mask of what is real, so row *i* of a memory-mapped file is found by arithmetic and
read without a copy.  A second Arrow file lists the partition's documents with their place in that run.  Ids are stored
in 16 bits, as the vocabulary fits.  A small manifest (one row a partition) gives each file's first id in the whole run.

Edge cases: a null text is empty; an empty document is its end id alone; a null doc_id sorts first; repeated rows are
written each on their own, rows of one doc_id in the order of their texts' hashes; an empty table writes no file.  Only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import fresh_path, splits, staged, storage
from larder.llm.tokens import memo_tokenizer

SEQUENCE = 2048
END_ID = 0
#: Sequences in a record batch of a file.
ROWS = 64
#: Tasks that read files, at most.
MOST_TASKS = 50_000
_MANIFEST = "part int, tokens long, documents long, path string"


def _schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """Writes one partition's two files under temporary names; ``close`` moves them into place."""

    def __init__(self, folder: str, part: int, length: int):
        self.fs, base = storage(folder)
        self.fs.create_dir(base, recursive=True)
        self.length, self.path = length, f"{base}/part-{part:06d}"
        own = f"{self.path}.{TaskContext.get().taskAttemptId()}"
        self.names = {f"{own}.{kind}": f"{self.path}.{kind}" for kind in ("arrow", "index.arrow")}
        self.sinks = [self.fs.open_output_stream(name) for name in self.names]
        self.ids, self.index = (pa.ipc.new_file(s, k) for s, k in zip(self.sinks, (_schema(length), _INDEX), strict=True))
        self.rest, self.tokens, self.documents = np.zeros(0, "<u2"), 0, 0

    def _rows(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=_schema(self.length)))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents' ids one after another, and how many each has."""
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=_INDEX))
        self.tokens += len(ids)
        self.documents += len(sizes)
        run = np.concatenate([self.rest, ids])
        full = len(run) // (ROWS * self.length) * ROWS * self.length
        for at in range(0, full, ROWS * self.length):
            self._rows(run[at : at + ROWS * self.length], ROWS * self.length)
        self.rest = run[full:].copy()

    def close(self) -> None:
        if n := len(self.rest):
            self._rows(np.pad(self.rest, (0, -n % self.length)), n)
        for x in (self.ids, self.index, *self.sinks):
            x.close()
        for own, final in self.names.items():
            self.fs.move(own, final)


class TokenFile:
    """Random access to a written file: sequence ``i``, or any span of ids, without reading the rest."""

    def __init__(self, path: str):
        fs, inner = storage(path)
        source = pa.memory_map(inner) if fs.type_name == "local" else fs.open_input_file(inner)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _load(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.reader.get_batch(k)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = self._load(i // ROWS), i % ROWS
        return tuple(c[row].values.to_numpy(zero_copy_only=False) for c in (batch.column(0), batch.column(1)))

    def span(self, start: int, count: int) -> Iterator[np.ndarray]:
        size = ROWS * self.length
        while count:
            ids = self._load(start // size).column(0).flatten().to_numpy()
            part = ids[start % size : start % size + count]
            yield part
            start, count = start + len(part), count - len(part)


def _write_batches(folder: str, path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part = memo_tokenizer(path, "bytes"), None, TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            for ids, sizes in encoder.encode(batch.column(1).fill_null("").to_pylist(), end_id):
                writer = writer or _Writer(folder, part, length)
                writer.add(batch.column(0).slice(at, len(sizes)), ids, sizes)
                at += len(sizes)
        if writer:
            writer.close()
            row = [[part], [writer.tokens], [writer.documents], [f"{folder}/part-{part:06d}"]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "tokens", "documents", "path"])

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Write all documents; returns the manifest: part, tokens, documents, path, base (ids before the file)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows of one doc_id, or of none, are split by their texts' hashes, and equal rows by their place.
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    keys = ("doc_id", "hash", "place")
    ordered = keyed.repartitionByRange(2 * splits(rows), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    folder = fresh_path(spark, "tokens")
    manifest = staged(spark, ordered.mapInArrow(_write_batches(folder, tokenizer_path, end_id, length), _MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each file
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens, (fs, inner) = TokenFile(f"{path}.arrow"), storage(f"{path}.index.arrow")
            with fs.open_input_file(inner) as f, pa.ipc.open_file(f) as index:
                for k in range(index.num_record_batches):
                    own = index.get_batch(k)
                    sums = []
                    for start, count in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True):
                        crc = 0
                        for part in tokens.span(start, count):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    starts = pa.array(np.asarray(own.column(1)) + base)
                    yield pa.RecordBatch.from_arrays([own.column(0), starts, own.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in the whole run), n_tokens, ids_crc32 of each document, from the files."""
    files = manifest.select("path", "base")
    return files.repartition(max(1, min(files.count(), MOST_TASKS))).mapInArrow(_read_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
