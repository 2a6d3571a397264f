"""Centroid clustering over a vector-approximation file.

Every vector is compressed to six bits for each dimension: the number of its cell among 64.  For a set of centroids a
lookup table gives the smallest and largest squared distance from each centroid to each cell of each dimension; summed
over a vector's cells they bound its distance to every centroid.  Where one centroid's interval lies below all others the
vector is assigned from its cells alone.  Only where intervals overlap is the full vector fetched, that is handed to
Python, and compared exactly.  Results are the same as without cells.

A round moves centroids by the vectors that changed their cluster: their components are added to the new cluster's sum
and taken from the old one's, so after the first round full vectors are fetched for overlaps and moves only.  A round is
one scan without a shuffle of vectors; the driver gets (clusters x dimensions) numbers, and holds no vector but a sample
of ``SAMPLE``, from which cells are cut.  The sample changes how many vectors are fetched, never a result.

Edge cases: vectors with another number of components, a null or a non-finite one are left out; components are whole
numbers of at most 2^27 in size, larger ones count as that, so that every squared distance fits in a long; repeated rows
are vectors of their own, and a row without vec_id is ordered as the empty id; with fewer vectors than clusters there
are as many clusters as vectors; an empty table has no row.  Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import staged

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
LARGEST = 1 << 27
#: Bits of a component's cell.  With four, intervals of the given tables' 64 dimensions overlap for every vector.
BITS = 6
CELLS = 1 << BITS
#: Vectors (of the smallest hashes) from which cells are cut.
SAMPLE = 4096


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, vec (whole numbers): the rows that have exactly ``dimensions`` finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(SCALE)), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return embeddings.where((F.size("embedding") == dimensions) & finite).select("vec_id", scaled.alias("vec"))


def _matrix(column) -> np.ndarray:
    """A list column of an Arrow batch as rows of whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def exact_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors x centroids, in whole numbers."""
    return np.stack([np.square(vectors - c).sum(1) for c in centroids], 1)


def _cuts(sample: np.ndarray, low: int, high: int) -> np.ndarray:
    """``CELLS`` - 1 ascending first values of cells between ``low`` and ``high``."""
    quantiles = np.ceil(np.quantile(sample, np.arange(1, CELLS) / CELLS)).astype(np.int64)
    cuts = {int(c) for c in quantiles if low < c <= high}
    ends = [low, *sorted(cuts), high + 1]
    widest = [(a - b, a) for a, b in zip(ends, ends[1:], strict=False)]
    heapq.heapify(widest)
    while len(cuts) < CELLS - 1 and widest and widest[0][0] < -1:
        width, begin = heapq.heappop(widest)
        middle = begin - width // 2
        cuts.add(middle)
        heapq.heappush(widest, (begin - middle, begin))
        heapq.heappush(widest, (middle - (begin - width), middle))
    return np.array(sorted(cuts) + [high] * (CELLS - 1 - len(cuts)), np.int64)


@dataclass(frozen=True)
class Cells:
    """Cuts between the cells of each dimension, and the least and largest component that each cell may hold."""

    cuts: np.ndarray  # dimensions x (CELLS - 1)
    low: np.ndarray  # dimensions x CELLS
    high: np.ndarray

    @classmethod
    def cut(cls, sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> Cells:
        """Cells with about as many of the sample's components each, between the least and largest component of all vectors.

        Where components repeat, quantiles coincide; the cells that are left over split the widest ones, so components of
        few different values have a cell each.
        """
        cuts = np.stack([_cuts(x, int(a), int(b)) for x, a, b in zip(sample.T, low, high, strict=True)])
        return cls(cuts, np.concatenate([low[:, None], cuts], 1), np.concatenate([cuts - 1, high[:, None]], 1))

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        """The cells of each vector's components, ``BITS`` bits each, as rows of bytes."""
        found = np.stack([np.searchsorted(cuts, x, side="right") for cuts, x in zip(self.cuts, vectors.T, strict=True)], 1).astype(np.uint8)
        return np.packbits(np.unpackbits(found[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(found), -1), axis=1)

    def unpacked(self, rows: np.ndarray) -> np.ndarray:
        """The cells of packed rows: vectors x dimensions."""
        bits = np.unpackbits(rows, axis=1)[:, : BITS * len(self.cuts)].reshape(len(rows), -1, BITS)
        return np.packbits(bits, axis=2)[:, :, 0] >> (8 - BITS)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest squared distance: dimensions x CELLS x centroids."""
        c = centroids.T[:, None, :]
        below, above = self.low[:, :, None] - c, c - self.high[:, :, None]
        return np.square(np.maximum(np.maximum(below, above), 0)), np.square(np.maximum(np.abs(below), np.abs(above)))

    def nearest(self, packed: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """The nearest centroid (of ties the smaller number) where cells alone tell it, else -1."""
        lower, upper = self.tables(centroids)
        least = np.zeros((len(packed), len(centroids)), np.int64)
        most = least.copy()
        for d, cell in enumerate(self.unpacked(packed).T):
            least += lower[d][cell]
            most += upper[d][cell]
        best = most.argmin(1)
        limit = most[np.arange(len(packed)), best][:, None]
        number = np.arange(len(centroids))
        # A centroid of a larger number may be as near at its nearest; one of a smaller number must be farther.
        beaten = (least > limit) | ((least == limit) & (number > best[:, None])) | (number == best[:, None])
        return np.where(beaten.all(1), best, -1)


def _bounds(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and largest component of each dimension; None without vectors."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if batch.num_rows:
                m = _matrix(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(range(m.shape[1]), pa.int32()), pa.array(m.min(0)), pa.array(m.max(0))], ["d", "low", "high"])

    rows = vectors.select("vec").mapInArrow(batches, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    rows.sort()
    return (np.array([r.low for r in rows]), np.array([r.high for r in rows])) if rows else None


def _approximated(vectors: DataFrame, cells: Cells) -> DataFrame:
    """vec_id, cells (bytes), vec."""

    @F.pandas_udf("binary")
    def pack(vec: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in cells.packed(np.stack(vec.to_numpy()).astype(np.int64))], dtype=object) if len(vec) else pd.Series([], dtype=object)

    return vectors.select("vec_id", pack("vec").alias("cells"), "vec")


def _told(cells: Cells, *centroids: np.ndarray):
    """A function of the cells: an array of the nearest centroid for each set of centroids, -1 where cells do not tell."""

    @F.pandas_udf("array<int>")
    def told(packed: pd.Series) -> pd.Series:
        if not len(packed):
            return pd.Series([], dtype=object)
        rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        return pd.Series(list(np.stack([cells.nearest(rows, c) for c in centroids], 1).astype(np.int32)))

    return told


def _settled(near: np.ndarray, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """``near`` with the exact nearest centroid where it is -1."""
    open_rows = np.flatnonzero(near < 0)
    if len(open_rows):
        near = near.copy()
        near[open_rows] = exact_distances(vectors[open_rows], centroids).argmin(1)
    return near


def _moves(index: DataFrame, cells: Cells, before: np.ndarray | None, now: np.ndarray) -> dict[tuple[int, int], int]:
    """(cluster, dimension) -> what vectors that change their cluster add to its sum; dimension -1: to its count."""
    sets = [now] if before is None else [before, now]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not batch.num_rows:
                continue
            near, vectors = _matrix(batch.column(0)), _matrix(batch.column(1))
            new = _settled(near[:, -1], vectors, now)
            old = np.full(len(new), -1) if before is None else _settled(near[:, 0], vectors, before)
            moved = old != new
            counted = np.concatenate([np.ones((len(new), 1), np.int64), vectors], 1)
            sums = np.zeros((len(now), counted.shape[1]), np.int64)
            np.add.at(sums, new[moved], counted[moved])
            np.subtract.at(sums, old[moved & (old >= 0)], counted[moved & (old >= 0)])
            cluster, d = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(d.astype(np.int32) - 1), pa.array(sums[cluster, d])], ["cluster", "d", "change"])

    rows = index.select(_told(cells, *sets)("cells").alias("near"), "vec")
    if before is not None:
        first, last = F.get("near", F.lit(0)), F.get("near", F.lit(1))
        rows = rows.where((first != last) | (first < 0) | (last < 0))
    changes = rows.mapInArrow(batches, "cluster int, d int, change long").groupBy("cluster", "d").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change"))
    return {(r.cluster, r.d): int(r.change) for r in changes.collect()}


def starts(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``1:<vec_id>``, in that order; of equal ids, in the order of their components."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(order.alias("order"), "vec").orderBy("order", "vec").limit(sample).collect()
    return np.array([r.vec for r in rows], np.int64)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each whole vector, and the final centroids."""
    spark = vectors.sparkSession
    sample, ends = starts(vectors), _bounds(vectors)
    if ends is None:
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), np.zeros((0, 0), np.int64)
    cells = Cells.cut(sample, *ends)
    index = staged(spark, _approximated(vectors, cells), "approximations")
    before, now = None, sample[:clusters]
    sums: dict[tuple[int, int], int] = {}
    for _ in range(rounds):
        for key, change in _moves(index, cells, before, now).items():
            sums[key] = sums.get(key, 0) + change
        before, now = now, now.copy()
        for c in range(len(now)):
            if count := sums.get((c, -1), 0):
                now[c] = [sums.get((c, d), 0) // count for d in range(now.shape[1])]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not batch.num_rows:
                continue
            near, vectors = _matrix(batch.column(1)), _matrix(batch.column(2))
            own = _settled(near[:, 0], vectors, now)
            distance = np.square(vectors - now[own]).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    last = index.select("vec_id", _told(cells, now)("cells").alias("near"), "vec")
    found = last.mapInArrow(batches, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")
    return staged(spark, found, "clusters"), now


def overlapping(vectors: DataFrame, centroids: np.ndarray) -> float:
    """The share of vectors whose intervals overlap, so that they are fetched in full; for tests and tuning."""
    cells = Cells.cut(starts(vectors), *_bounds(vectors))
    near = _approximated(vectors, cells).select(F.get(_told(cells, centroids)("cells"), F.lit(0)).alias("near"))
    return near.agg(F.avg((F.col("near") < 0).cast("double"))).first()[0]


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    facts = [(c, sums.get(c, 0), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    inertia = F.lit(sum(sums.values())).cast("long").alias("inertia")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia, "centroid_sha256")
