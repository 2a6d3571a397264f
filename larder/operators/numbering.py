"""Consecutive numbers over all partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.shared import staged

#: ``monotonically_increasing_id`` holds the partition above this bit and the row's place in it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[str | Column], name: str = "number", after: int = 0) -> DataFrame:
    """Adds ``name``: after + 1, after + 2, ... in the given order, nulls first; of rows that are equal in it, any order.

    Rows are range-partitioned and sorted by the order, so that every partition numbers its own rows; a partition begins
    behind what the ones before it hold.  Only a count for each partition is ever in one task.  The sorted rows are written
    to the shared folder, since sampled ranges need not come out alike a second time.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    table = staged(sorted_rows, "numbered")
    part, place = F.shiftrightunsigned("_place", _PLACE_BITS), F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    counts = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))  # as many rows as partitions
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("_part", before.alias("_before"))
    found = table.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return found.select(*rows.columns, (F.col("_before") + place + 1 + after).alias(name))
