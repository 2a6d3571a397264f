"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and a Hamming check.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its three-word shingles.  Two fingerprints that
differ in at most three bits agree on at least two of five blocks, so every close pair meets under one of the ten pairs
of blocks.  Fingerprints, not documents, are compared: copies fold into one vertex, whose name is its smallest doc_id.
A bucket with many fingerprints is cut into a grid of bounded cells, so that none is ever held by one task and no pair
is left out; a cell hands on a spanning forest of its links instead of all pairs.

Edge cases: a null or wordless text has fingerprint zero and links like any other; fewer than three words count as one
shingle; repeated rows give repeated rows; a row without doc_id keeps its fingerprint, names no vertex, and gets the
component of its fingerprint if some document with an id has it, else null.  Only ``doc_id`` and ``text`` are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import join_groups, releasing, staged, text_bytes

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
BLOCK_BITS = (13, 13, 13, 13, 12)
#: Members of a bucket's cell; a larger bucket becomes a grid of cells of about this many by this many.
CELL = 1024
#: Groups up to this size are compared by shifted vectors, all groups of a task at once.
SMALL = 32
_HASHES_AT_ONCE = 1 << 18


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a UTF-8 text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z, and white space x20 and x09 to x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[i : i + _HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "bits"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(releasing(_fingerprint_batches), "doc_id long, bits long")


def _block_masks() -> list[int]:
    starts = np.cumsum((0, *BLOCK_BITS))
    blocks = [((1 << width) - 1) << int(start) for start, width in zip(starts[:-1], BLOCK_BITS, strict=True)]
    return [sum(pair) - (1 << 64 if sum(pair) >> 63 else 0) for pair in combinations(blocks, len(blocks) - MAX_DISTANCE)]


def _cell_links(bits: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a cell's members: each member with its component's smallest name."""
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= MAX_DISTANCE
    label = names.copy()
    while True:
        lower = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)
        if (lower == label).all():
            break
        label = lower
    moved = label != names
    return names[moved], label[moved]


def _linked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group (mask, key, row, col); gives the links found in each group."""

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        *group, bits, names = columns
        bits = bits.view(np.uint64)
        new = np.ones(len(bits), bool)
        if len(bits) > 1:
            new[1:] = np.any([g[1:] != g[:-1] for g in group], axis=0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(bits)))
        of, size_of = np.cumsum(new) - 1, np.repeat(sizes, sizes)
        a, b = [], []
        for shift in range(1, min(SMALL, int(sizes.max(initial=0)))):
            left = np.flatnonzero((of[:-shift] == of[shift:]) & (size_of[shift:] <= SMALL))
            left = left[np.bitwise_count(bits[left] ^ bits[left + shift]) <= MAX_DISTANCE]
            a.append(names[left])
            b.append(names[left + shift])
        for i in np.flatnonzero(sizes > SMALL):
            own = slice(starts[i], starts[i] + sizes[i])
            for out, found in zip((a, b), _cell_links(bits[own], names[own]), strict=True):
                out.append(found)
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        last = np.all([g == g[-1] for g in columns[:-2]], axis=0)
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # the last group may go on
        rest = [c[cut:] for c in columns]
        if cut:
            yield links([c[:cut] for c in columns])
    if rest is not None:
        yield links(rest)


def close_links(vertices: DataFrame) -> DataFrame:
    """a > b, doc_ids of fingerprints at most three bits apart; enough of them to connect all that are."""
    masks = F.array(*[F.lit(m).cast("long") for m in _block_masks()])
    bucket = F.struct("mask", F.col("bits").bitwiseAND(F.col("of")).alias("key")).alias("bucket")
    keyed = vertices.select("name", "bits", F.posexplode(masks).alias("mask", "of")).select(bucket, "bits", "name")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
    # A bucket with a share of the fingerprints meets its size in every task; only then is it cut into cells.
    met = join_groups(keyed, staged(vertices.sparkSession, sizes, "buckets"), "bucket").where("size is not null")
    met = met.select("bucket.*", "bits", "name", "size")
    side = F.ceil(F.col("size") / CELL).cast("int")
    own = F.pmod(F.xxhash64("bits", "mask"), side).cast("int")
    cells = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), side - 1)))
    cells = cells.select("mask", "key", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), "bits", "name")
    dealt = cells.repartition("mask", "key", "row", "col").sortWithinPartitions("mask", "key", "row", "col")
    return dealt.mapInArrow(releasing(_linked_batches), "a long, b long").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """name, root: the smallest name reachable, for each name that has a smaller one.

    Every name points to its smallest neighbour, which takes over its other smaller neighbours, until each has one; then
    pointers are followed by doubling.  Each round is a few shuffles of the links, written to the shared folder.
    """
    edges = staged(spark, links, "links")
    while True:
        low = edges.groupBy("a").agg(F.min("b").alias("p"))
        joined = staged(spark, edges.join(low, "a"), "stars")
        moved = joined.where("b <> p").select(F.col("b").alias("a"), F.col("p").alias("b"))
        if moved.isEmpty():
            break
        edges = staged(spark, moved.union(joined.select("a", F.col("p").alias("b"))).distinct(), "links")
    pointers = edges.select(F.col("a").alias("name"), F.col("b").alias("root"))
    while True:
        further = pointers.select(F.col("name").alias("root"), F.col("root").alias("next"))
        # A large component's names all point to one root, so roots are counted before they are looked up.
        roots = staged(spark, pointers.groupBy("root").agg(F.count("*").alias("n")).join(further, "root", "left"), "roots")
        if roots.where("next is not null").isEmpty():
            return pointers
        pointers = staged(spark, join_groups(pointers, roots, "root").select("name", F.coalesce("next", "root").alias("root")), "pointers")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, bits, component_id for every document."""
    spark = docs.sparkSession
    prints = staged(spark, fingerprints(docs), "fingerprints")
    vertices = staged(spark, prints.groupBy("bits").agg(F.min("doc_id").alias("name"), F.count("*").alias("n")), "vertices")
    roots = components(spark, close_links(vertices.where("name is not null").select("name", "bits")))
    named = vertices.join(roots, "name", "left").select("bits", "n", F.coalesce("root", "name").alias("component_id"))
    return join_groups(prints, staged(spark, named, "named"), "bits").select("doc_id", "bits", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
