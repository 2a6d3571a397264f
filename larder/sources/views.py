"""Logical tables of the diary domain over the given base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.scalars import KCAL_PER_KJ


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, date_time, name, brand, unit, portion, nutrition map, barcode, categories, archived, hidden."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("double")
    calories = F.when(k % 29 == 0, -F.col("p_retailprice") / 10).otherwise(F.col("p_retailprice") / 10)
    nutrition = {
        "calories": calories, "fat": size * 0.5, "saturated-fat": size * 0.2, "carbohydrates": size * 1.5, "sugars": size * 0.7,
        "proteins": F.when(k % 31 == 0, -size * 0.9).otherwise(size * 0.9), "kilojoules": F.when(k % 2 == 0, calories / KCAL_PER_KJ),
    }
    entries = F.create_map(*[x for name, value in nutrition.items() for x in (F.lit(name), value)])
    return p.select(
        k.alias("id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k * 7 % 700).cast("int")).alias("date_time"),
        F.when(k % 41 != 0, F.col("p_name")).alias("name"),
        F.col("p_brand").alias("brand"),
        F.lit("g").alias("unit"),
        F.lit(100.0).alias("portion"),
        F.map_filter(entries, lambda _, v: v.isNotNull()).alias("nutrition"),
        F.when(k % 13 == 0, F.lit("")).when(k % 5 == 0, F.concat(F.lit("0"), (k % 900 + 1000).cast("string"))).otherwise((k % 900 + 1000).cast("string")).alias("barcode"),
        F.when(k % 11 != 0, F.when(k % 3 == 0, F.array(F.col("p_type"), F.lit("organic"))).otherwise(F.array(F.col("p_type")))).alias("categories"),
        (k % 17 == 0).alias("archived"),
        (k % 23 == 0).alias("hidden"),
    )


def known_foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foods without those that were deleted: diary items may refer to missing ones."""
    return foods(spark, sf_dir).where("id % 37 <> 0")


def diary_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, user, day, food_id, portion, quantity, category: one row per diary item."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entry"),
        F.col("l_partkey").alias("food_id"),
        (F.col("l_quantity") * 10).alias("portion"),
        (F.col("l_linenumber") % 3 + 1).cast("double").alias("quantity"),
        (F.col("l_linenumber") - 1).alias("category"),
    )
    return lines.join(diary(spark, sf_dir), "entry").select("entry", "user", "day", "food_id", "portion", "quantity", "category")


def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, user, day."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("user"), F.to_date("o_orderdate").alias("day"))


def body_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, day, stat, value: the day's last reading of each stat."""
    e = table(spark, sf_dir, "events")
    last = F.max_by("value", "event_id").alias("value")
    return e.groupBy(F.col("user_id").alias("user"), F.to_date("ts").alias("day"), F.col("event_type").alias("stat")).agg(last)


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, stat, seq (place in the list), effective_from, shared, percent, goal (seven weekday values from Sunday).

    Every customer has a list for energy and fat and two of three have one for proteins; some lists are not in the order
    of their days, and the later place counts.
    """
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("double")
    date = lambda text: F.lit(text).cast("date")

    def goal(stat: str, seq: int, day, shared: bool, percent: bool, *values):
        week = F.array(*[F.lit(float(v)) if isinstance(v, int) else v for v in values * (7 if len(values) == 1 else 1)])
        return F.struct(F.lit(stat).alias("stat"), F.lit(seq).alias("seq"), F.coalesce(day, F.lit(None).cast("date")).alias("effective_from"), F.lit(shared).alias("shared"), F.lit(percent).alias("percent"), week.alias("goal"))

    undated = F.lit(None).cast("date")
    rows = F.array(
        goal("calories", 0, undated, True, False, n * 10 + 1800),
        goal("calories", 1, F.date_add(date("1997-06-01"), (k % 200).cast("int")), False, False, n + 2200, 2000, 2000, 2000, 2000, 2100, 2300),
        F.when(k % 4 == 0, goal("calories", 2, date("1996-01-01"), True, False, 1700)),
        goal("fat", 0, undated, True, False, 70),
        goal("fat", 1, date("1998-01-01"), True, True, 30),
        F.when(k % 3 != 0, goal("proteins", 0, date("1996-03-01"), False, False, 50, 60, 60, 60, 60, 60, 50)),
    )
    return table(spark, sf_dir, "customer").select(k.alias("user"), F.inline(F.array_compact(rows)))
