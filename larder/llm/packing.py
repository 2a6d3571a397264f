"""Packing along a space-filling curve.

A document's token ids are hashed into a fixed number of buckets; the counts, scaled to length 1, are projected to three
dimensions by a fixed random matrix and placed on a Hilbert curve.  Documents are range-sorted along the curve
and each partition fills sequences with neighbouring documents one after another.  A document is cut wherever a sequence
ends.  What is left at a partition's end is cut into sequences of power-of-two lengths, which need no padding.

Edge cases: a null text is empty; an empty document is its end id alone; equal keys are ordered by doc_id; a null doc_id
comes first; repeated rows are packed each on their own; an empty table gives no rows.  Only ``doc_id`` and ``text`` are
read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import releasing, splits, staged
from larder.llm.tokens import memo_tokenizer

SEQUENCE = 2048
END_ID = 1
HASH_BITS = 12
DIMENSIONS = 3
BITS = 16


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates (Skilling 2004: transpose, then interleave)."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q, p = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> np.uint64(level)) & one, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def project(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashed counts of a document's token ids, scaled to length 1 and projected: about normal in each dimension."""
    counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS), minlength=1 << HASH_BITS).astype(float)
    return counts @ rows / np.linalg.norm(counts)


def _keyed_batches(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo_tokenizer(path, "words")
        rows = np.random.default_rng(7).standard_normal((1 << HASH_BITS, DIMENSIONS))
        for batch in batches:
            at = 0
            for ids, sizes in encoder.encode(batch.column(1).fill_null("").to_pylist(), end_id):
                ends = np.cumsum(sizes)
                points = np.array([project(ids[e - n : e], rows) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
                grid = np.clip((points + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
                offsets = pa.py_buffer(np.append(0, 2 * ends).astype("<i8").tobytes())
                held = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array(hilbert_key(grid)), held.cast(pa.binary())], ["doc_id", "curve", "ids"])
                at += len(sizes)

    return run


def _packed_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64()] * len(names)
        filled, sequence, tail = 0, 0, []  # tail: pieces of the sequence that is being filled
        done: list[tuple] = []

        def piece(doc, start, ids, total, seq, offset):
            return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + seq, offset

        def flush():
            columns = zip(*done, strict=True) if done else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<u2")
                at = 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    tail.append((doc, at, ids[at : at + take], len(ids), filled))
                    filled, at = filled + take, at + take
                    if filled == length:
                        done += [piece(d, s, x, n, sequence, o) for d, s, x, n, o in tail]
                        filled, sequence, tail = 0, sequence + 1, []
            yield flush()
            done = []
        # The rest, cut into sequences whose lengths are the powers of two that it is the sum of.
        lengths = [1 << k for k in range(length.bit_length() - 1, -1, -1) if filled >> k & 1]
        ends = np.cumsum(lengths).tolist()
        which = 0
        for doc, start, ids, total, offset in tail:
            at = 0
            while at < len(ids):
                begin = ends[which] - lengths[which]
                take = min(len(ids) - at, ends[which] - (offset + at))
                done.append(piece(doc, start + at, ids[at : at + take], total, sequence + which, offset + at - begin))
                at += take
                which += offset + at == ends[which]
        yield flush()

    return run


def along_curve(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, curve (Hilbert key), ids (little-endian 16-bit, with the end id) of every document, in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(docs.sparkSession, rows.mapInArrow(releasing(_keyed_batches(tokenizer_path, end_id)), "doc_id long, curve long, ids binary"), "curve")


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    keyed = along_curve(docs, tokenizer_path, end_id)
    # As many ranges as the staged table has splits, so that a task's share does not grow with the input; only the key
    # columns are sampled for them, and doc_id splits groups of copies.
    ordered = keyed.repartitionByRange(splits(keyed), "curve", "doc_id").sortWithinPartitions("curve", "doc_id").select("doc_id", "ids")
    return ordered.mapInArrow(releasing(_packed_batches(length)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
