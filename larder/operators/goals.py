"""Goals: effective dates, weekdays, shares of energy, and adjustment to what was eaten before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.scalars import half_up, percent_goal, weekday


def goal_asof(days: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day, stat, seq, shared, percent, goal: for each day the last goal of its owner's list that is undated or in effect.

    ``days`` has keys (such as the user) and day, ``goals`` keys, stat, seq (the place in the list, which decides), the day
    effective_from, and the goal's fields.  Goals and days of an owner and stat are merged in the order of days and the
    last goal so far is carried on: one shuffle by (keys, stat), neither a broadcast nor pairs of days and goals.  A
    group is as long as an owner's distinct days and goals, so the calendar bounds it.
    """
    fields = F.struct("seq", "shared", "percent", "goal")
    begins = goals.select(*keys, "stat", F.col("effective_from").alias("day"), fields.alias("g"), F.lit(0).alias("asked"))
    asked = days.select(*keys, "day").distinct().join(goals.select(*keys, "stat").distinct(), keys)
    asked = asked.select(*keys, "stat", "day", F.lit(None).cast(begins.schema["g"].dataType).alias("g"), F.lit(1).alias("asked"))
    so_far = Window.partitionBy(*keys, "stat").orderBy(F.asc_nulls_first("day"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    found = begins.unionByName(asked).withColumn("g", F.max("g").over(so_far))  # the largest seq
    return found.where("asked = 1 and g is not null").select(*keys, "day", "stat", "g.*")


def day_goal(days: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day, stat, value: the weekday's goal, or the first for shared ones; percentages become grams of the day's energy goal."""
    found = goal_asof(days, goals, keys)
    raw = found.withColumn("raw", F.when(F.col("shared"), F.col("goal")[0]).otherwise(F.element_at("goal", (weekday(F.col("day")) + 1).cast("int"))))
    energy = F.max(F.when(F.col("stat") == "calories", F.col("raw"))).over(Window.partitionBy(*keys, "day"))
    value = F.when(F.col("percent"), percent_goal(F.col("raw"), F.col("energy"), F.col("stat"))).otherwise(F.col("raw"))
    return raw.withColumn("energy", energy).select(*keys, "day", "stat", value.alias("value"))


def average_goal(goals: DataFrame) -> DataFrame:
    """Every goal's keys, stat, seq, and average: the first value of a shared goal, else the mean of the week."""
    week = F.aggregate("goal", F.lit(0.0), lambda a, x: a + x) / 7
    rest = [c for c in goals.columns if c not in ("effective_from", "shared", "percent", "goal")]
    return goals.select(*rest, F.when(F.col("shared"), F.col("goal")[0]).otherwise(half_up(week)).alias("average"))


def auto_adjust(actual: DataFrame, keys: list[str], first_day: int | None = None, trailing: int | None = None) -> DataFrame:
    """Adds ``adjusted``: the goal less what earlier logged days of the window were over it, spread over the days left.

    ``actual`` has keys, day, total, goal.  The window is the week from ``first_day`` (0: Sunday), or the ``trailing`` days
    before, whose deviation is spread over two days.  Never below 0.
    """
    day_number = F.datediff("day", F.lit("1970-01-01"))
    rows = actual.withColumn("day_number", day_number)
    if first_day is not None:
        place = weekday(F.col("day"), first_day)
        rows = rows.withColumn("place", place).withColumn("week", F.date_sub("day", place))
        window = Window.partitionBy(*keys, "week").orderBy("day_number").rowsBetween(Window.unboundedPreceding, -1)
        left = F.lit(7) - F.col("place")
    else:
        window = Window.partitionBy(*keys).orderBy("day_number").rangeBetween(-trailing, -1)
        left = F.lit(2)
    over = F.coalesce(F.sum((F.col("total") - F.col("goal")).cast("decimal(18,2)")).over(window).cast("double"), F.lit(0.0))
    return rows.withColumn("adjusted", F.greatest(half_up(F.col("goal") - over / left, 0), F.lit(0.0))).select(*actual.columns, "adjusted")
