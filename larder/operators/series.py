"""Time series of a statistic: calendar gaps, averages, trend and moving average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.scalars import convert_unit, half_up
from larder.sources.shared import staged


def kept(series: DataFrame) -> DataFrame:
    """Days whose value is there and not 0."""
    return series.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0))


def gap_fill(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day, index, value (rounded; null in gaps) for every calendar day between a key's first and last day."""
    days = series.groupBy(*keys).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = days.select(*keys, F.posexplode(F.sequence("lo", "hi")).alias("index", "day"))
    values = series.select(*keys, "day", half_up(F.col("value")).alias("value"))
    return calendar.join(values, [*keys, "day"], "left").select(*keys, "day", "index", "value")


def moving_average(filled: DataFrame, keys: list[str], period: int = 7) -> DataFrame:
    """Adds ``moving``: mean of the present values of the last ``period`` days; null if there is none."""
    period = period if period >= 2 else 7
    window = Window.partitionBy(*keys).orderBy("day").rowsBetween(1 - period, 0)
    return filled.withColumn("moving", half_up(F.avg("value").over(window)))


def trend(filled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slope, intercept of the least-squares line over the days' indexes; for at least two values.

    Values have two decimals, so their sums are kept as whole hundredths: exact, whatever the order of rows.
    """
    x, y = F.col("index").cast("long"), F.floor(F.col("value") * 100 + F.lit(0.5)).cast("long")
    sums = {"n": F.count("value"), "sx": F.sum(x), "sy": F.sum(y), "sxy": F.sum(x * y), "sxx": F.sum(x * x)}
    out = filled.where("value is not null").groupBy(*keys).agg(*[c.alias(name) for name, c in sums.items()]).where("n >= 2")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double") / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double") / 100.0
    line = out.withColumn("slope", slope).withColumn("intercept", (F.col("sy").cast("double") / 100.0 - F.col("slope") * F.col("sx").cast("double")) / F.col("n").cast("double"))
    return line.select(*keys, half_up(F.col("slope"), 4).alias("slope"), half_up(F.col("intercept"), 4).alias("intercept"))


def average(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, days, average of the unrounded values of kept days."""
    mean = F.sum(F.col("value").cast("decimal(24,6)")).cast("double") / F.count("value")
    return kept(series).groupBy(*keys).agg(F.count("value").alias("days"), half_up(mean, 3).alias("average"))


def statistic(series: DataFrame, keys: list[str], unit: Column | None = None, shown_in: Column | None = None, period: int = 7) -> DataFrame:
    """keys, day, index, value, moving, average, slope, intercept: all that a chart of a statistic shows.

    Values are converted from ``unit`` to the one they are shown in; days without a value, or with 0, are gaps; the average
    is of the unrounded values, the moving one and the trend (null for a single value) of the rounded ones.
    """
    if unit is not None:
        series = series.withColumn("value", convert_unit(F.col("value"), unit, shown_in))
    days = kept(series.select(*keys, "day", "value"))
    filled = moving_average(gap_fill(days, keys), keys, period)
    return filled.join(average(days, keys).drop("days"), keys).join(trend(filled, keys), keys, "left")


def gap_clusters(rows: DataFrame, keys: list[str], place: str, tolerance: float) -> DataFrame:
    """Adds ``cluster``: numbered islands of ``place`` whose neighbours are at most ``tolerance`` apart."""
    window = Window.partitionBy(*keys).orderBy(place)
    starts = (F.col(place) - F.lag(place).over(window) > tolerance).cast("int")
    marked = rows.withColumn("starts", F.coalesce(starts, F.lit(0)))
    running = Window.partitionBy(*keys).orderBy(place).rangeBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("cluster", F.sum("starts").over(running)).drop("starts")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], place: str) -> DataFrame:
    """left's id with ``nearest``: right's id at the nearest ``place`` of the same keys; the smaller id on ties.

    Both have keys, id and place.  Rows are merged in the order of keys and places over as many partitions as there are, so
    a key with most of the rows is in many; in each, rows look back and ahead for their neighbours.  What lies beyond a
    partition's ends is carried over from the nearest partition of the same keys that has a neighbour: one row for each
    key and partition.
    """
    there = right.groupBy(*keys, place).agg(F.min("id").alias("id"))
    there = there.select(*keys, place, F.lit(None).cast("long").alias("id"), F.struct(F.col(place).alias("at"), F.col("id").alias("other")).alias("near"))
    both = left.select(*keys, place, F.col("id").cast("long").alias("id"), F.lit(None).cast(there.schema["near"].dataType).alias("near")).union(there)
    # Written once, since sampled ranges need not come out alike a second time.
    both = staged(both.repartitionByRange(*keys, place).withColumn("_part", F.spark_partition_id()), "nearest")
    first = F.col("id").isNotNull()  # neighbours at the same place come before the rows that look for them

    def look(order: Column) -> Column:
        window = Window.partitionBy(*keys, "_part").orderBy(order, first).rowsBetween(Window.unboundedPreceding, 0)
        return F.last("near", ignorenulls=True).over(window)

    ends = both.groupBy(*keys, "_part").agg(F.min("near").alias("_first"), F.max("near").alias("_last"))  # in the order of places
    part = Window.partitionBy(*keys).orderBy("_part")
    carried = ends.select(
        *keys, "_part", F.last("_last", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(part.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"),
    )
    found = both.withColumn("below", look(F.col(place).asc())).withColumn("above", look(F.col(place).desc())).where("id is not null")
    found = found.join(carried, [*keys, "_part"]).withColumns({"below": F.coalesce("below", "_before"), "above": F.coalesce("above", "_behind")})
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(place) - F.col(f"{side}.at")).alias("far"), F.col(f"{side}.other").alias("other")))
    return found.select("id", F.least(far("below"), far("above"))["other"].alias("nearest"))
