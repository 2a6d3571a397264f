"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, in local mode, one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder()
    return root.rstrip("/")


@cache
def _own_folder() -> str:
    """For sessions in one process, as in tests."""
    return tempfile.mkdtemp(prefix="larder-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that may hold a share of over 1 / HOT_KEYS of the rows; there are at most so many, so they are broadcast.
HOT_KEYS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, broadcast_rows: int = 200_000) -> DataFrame:
    """Left join of ``rows`` with ``groups``, which has a row for each key and in ``n`` how many rows have it; drops ``n``.

    ``groups`` must be a table that is cheap to read again.  Up to ``broadcast_rows`` it is broadcast.  Beyond, only its hot
    keys are; their rows are spread by a salt, so no task gets all rows of a key, and the others are joined by a shuffle.
    """
    values = [c for c in groups.columns if c not in (key, "n")]
    size = groups.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    if size["keys"] <= broadcast_rows:
        return rows.join(F.broadcast(groups.drop("n")), key, "left")
    hot = F.col("n") > size["rows"] / HOT_KEYS
    hot_groups = groups.where(hot).select(key, F.struct(*values).alias("_hot"), F.lit(True).alias("_is_hot"))
    met = rows.join(F.broadcast(hot_groups), key, "left")
    salt = F.when(F.col("_is_hot"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    met = met.withColumn("_salt", salt)
    cold_groups = groups.where(~hot).select(key, F.struct(*values).alias("_cold"), F.lit(-1).cast("long").alias("_salt"))
    met = met.join(cold_groups, [key, "_salt"], "left")
    value = F.when(F.col("_is_hot"), F.col("_hot")).otherwise(F.col("_cold"))
    return met.select(*rows.columns, *[value[v].alias(v) for v in values])


def give_back() -> None:
    """Return memory that is no longer needed to the system.  A Python worker lives on for later tasks and stages, and would keep it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run: Callable) -> Callable:
    """A function of batches for ``mapInArrow``; the task gives back its memory when it has run."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def splits(df: DataFrame) -> int:
    """How many tasks read ``df``, a scan or what is computed from one without a shuffle: a count that follows its bytes."""
    return max(1, df.rdd.getNumPartitions())


def storage(uri: str):
    """(pyarrow filesystem, path) of a folder or file; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def text_bytes(column) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).fill_null(b"").to_pylist()
