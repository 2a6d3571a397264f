"""Diary queries: totals, macros, goals, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import scalars as S
from larder.operators import goals as G
from larder.operators import nutrition as N
from larder.operators import series as T
from larder.plans.registry import query
from larder.sources import views as V


def _day_totals(spark: SparkSession, d: str, mode: str = "subtract", keys=("user", "day")) -> DataFrame:
    return N.total_nutrition(V.diary_items(spark, d), V.known_foods(spark, d), list(keys), mode)


@query('SELECT "user", day, nutrient, total FROM day_totals', "day_totals")
def total_nutrition(spark, d):
    return _day_totals(spark, d)


_SUMS = 'SELECT day, {name} AS nutrient, CAST(sum(CAST({value} AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM summed WHERE {where} GROUP BY ALL'
_ENERGY = "nutrient IN ('calories', 'kilojoules')"


@query(_SUMS.format(name="nutrient", value="amount", where="amount >= 0"), "summed")
def total_ignore(spark, d):
    return _day_totals(spark, d, "ignore", ["day"])


@query(_SUMS.format(name="CASE WHEN amount < 0 THEN 'burned-' || nutrient ELSE nutrient END", value="abs(amount)", where=f"amount >= 0 OR {_ENERGY}"), "summed")
def total_disclose(spark, d):
    return _day_totals(spark, d, "disclose", ["day"])


@query(_SUMS.format(name="nutrient", value="amount", where=f"amount >= 0 OR {_ENERGY}"), "summed")
def total_subtract(spark, d):
    return _day_totals(spark, d, "subtract", ["day"])


@query("SELECT food_id, value AS kilojoules FROM nutrients WHERE nutrient = 'kilojoules'", "nutrients")
def derived_kj(spark, d):
    rows = N.long_nutrition(V.known_foods(spark, d))
    return rows.where("nutrient = 'kilojoules'").select("food_id", F.col("value").alias("kilojoules"))


@query(f'SELECT day, category, nutrient, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM summed WHERE amount >= 0 OR {_ENERGY} GROUP BY ALL', "summed")
def group_totals(spark, d):
    return _day_totals(spark, d, "subtract", ["day", "category"])


@query('SELECT i.entry, i.food_id, i.category, f.name, f.brand FROM diary_items i JOIN known_foods f ON i.food_id = f.id', "diary_items known_foods")
def join_items_foods(spark, d):
    foods = V.known_foods(spark, d).select(F.col("id").alias("food_id"), "name", "brand")
    return V.diary_items(spark, d).join(foods, "food_id").select("entry", "food_id", "category", "name", "brand")


@query("SELECT i.entry, i.food_id, i.portion * i.quantity AS size, coalesce(f.unit, '?') AS unit, coalesce(f.name, 'deleted') AS name FROM diary_items i LEFT JOIN known_foods f ON i.food_id = f.id", "diary_items known_foods")
def diary_detail(spark, d):
    foods = V.known_foods(spark, d).select(F.col("id").alias("food_id"), "name", "unit")
    rows = V.diary_items(spark, d).join(foods, "food_id", "left")
    return rows.select("entry", "food_id", (F.col("portion") * F.col("quantity")).alias("size"), F.coalesce("unit", F.lit("?")).alias("unit"), F.coalesce("name", F.lit("deleted")).alias("name"))


@query("SELECT l_orderkey AS entry, l_partkey AS id, l_quantity * 10 AS portion, coalesce(nullif(l_linenumber % 3, 0), 1) AS quantity, 'food' AS type FROM lineitem")
def flatten_items(spark, d):
    quantity = F.nullif(F.col("l_linenumber") % 3, F.lit(0))
    return V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("id"), (F.col("l_quantity") * 10).alias("portion"), F.coalesce(quantity, F.lit(1)).alias("quantity"), F.lit("food").alias("type"))


@query('SELECT entry, food_id, category, nutrient, amount FROM amounts', "amounts")
def scale_item(spark, d):
    rows = N.item_nutrients(V.diary_items(spark, d), V.known_foods(spark, d))
    return rows.select("entry", "food_id", "category", "nutrient", "amount")


_WIDE = """SELECT day, coalesce(sum(CASE WHEN nutrient = 'fat' THEN total END), 0) AS fat, coalesce(sum(CASE WHEN nutrient = 'saturated-fat' THEN total END), 0) AS saturated_fat,
 coalesce(sum(CASE WHEN nutrient = 'carbohydrates' THEN total END), 0) AS carbohydrates, coalesce(sum(CASE WHEN nutrient = 'sugars' THEN total END), 0) AS sugars,
 coalesce(sum(CASE WHEN nutrient = 'proteins' THEN total END), 0) AS proteins FROM (SELECT day, nutrient, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM summed WHERE amount >= 0 GROUP BY ALL) GROUP BY day"""


@query(f"""SELECT day, x.macro AS macro, x.energy AS energy FROM (SELECT day, unnest([{{'macro': 'fat', 'energy': (fat - saturated_fat) * 9e0}}, {{'macro': 'saturated-fat', 'energy': saturated_fat * 9e0}},
 {{'macro': 'carbohydrates', 'energy': (carbohydrates - sugars) * 4e0}}, {{'macro': 'sugars', 'energy': sugars * 4e0}}, {{'macro': 'proteins', 'energy': proteins * 4e0}}]) AS x FROM ({_WIDE})) WHERE x.energy > 0""", "summed")
def macro_split(spark, d):
    return N.macro_split(_day_totals(spark, d, "ignore", ["day"]), ["day"])


@query(f"""SELECT day, floor(fat * 9e0 * 100 / whole * 100 + 0.5) / 100 AS fat_percent, floor(carbohydrates * 4e0 * 100 / whole * 100 + 0.5) / 100 AS carbohydrates_percent,
 floor(proteins * 4e0 * 100 / whole * 100 + 0.5) / 100 AS proteins_percent, 0e0 AS alcohol_percent FROM (SELECT *, nullif(fat * 9e0 + carbohydrates * 4e0 + proteins * 4e0 + 0e0, 0) AS whole FROM ({_WIDE}))""", "summed")
def macro_percent(spark, d):
    return N.macro_percent(_day_totals(spark, d, "ignore", ["day"]), ["day"])


@query(f"SELECT day, nutrient, floor(total * 100e0 + 0.5e0) / 100e0 AS total FROM ({_SUMS.format(name='nutrient', value='amount', where='amount >= 0')}) WHERE nutrient IN ('calories', 'fat', 'proteins') AND total <> 0", "summed")
def nutrient_totals(spark, d):
    totals = _day_totals(spark, d, "ignore", ["day"]).where(F.col("nutrient").isin("calories", "fat", "proteins") & (F.col("total") != 0))
    return totals.withColumn("total", S.half_up(F.col("total")))


@query("SELECT DISTINCT nutrient FROM nutrients WHERE nutrient NOT IN ('sugars', 'kilojoules')", "nutrients")
def visible_nutriments(spark, d):
    rows = N.long_nutrition(V.known_foods(spark, d))
    return rows.where(~F.col("nutrient").isin("sugars", "kilojoules")).select("nutrient").distinct()


@query("""SELECT l_suppkey AS recipe, nutrient, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM
 (SELECT l_suppkey, nutrient, floor(value * ((l_quantity * 10 / food_portion) * 1e0) * 100e0 + 0.5e0) / 100e0 AS amount FROM lineitem JOIN nutrients ON l_partkey = food_id)
 WHERE amount >= 0 OR nutrient IN ('calories', 'kilojoules') GROUP BY ALL""", "nutrients")
def recipe_nutrition(spark, d):
    items = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("recipe"), F.col("l_partkey").alias("food_id"), (F.col("l_quantity") * 10).alias("portion"), F.lit(1.0).alias("quantity"))
    return N.total_nutrition(items, V.known_foods(spark, d), ["recipe"])


@query("SELECT i.entry, count(*) AS items, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS energy FROM amounts i WHERE nutrient = 'calories' GROUP BY ALL", "amounts")
def selection_energy(spark, d):
    rows = N.item_nutrients(V.diary_items(spark, d), V.known_foods(spark, d)).where("nutrient = 'calories'")
    return rows.groupBy("entry").agg(F.count("*").alias("items"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("energy"))


@query("SELECT entry, category, nutrient, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM summed WHERE category <> 2 AND (amount >= 0 OR nutrient IN ('calories', 'kilojoules')) GROUP BY ALL", "summed")
def clear_group(spark, d):
    """Entries' totals after one meal group was cleared."""
    items = V.diary_items(spark, d).where("category <> 2")
    return N.total_nutrition(items, V.known_foods(spark, d), ["entry", "category"])


@query('SELECT entry, food_id, CASE category WHEN 1 THEN 5 ELSE category END AS category FROM diary_items', "diary_items")
def move_group(spark, d):
    category = F.when(F.col("category") == 1, 5).otherwise(F.col("category"))
    return V.diary_items(spark, d).select("entry", "food_id", category.alias("category"))


# Goals


@query('SELECT "user", day, stat, g.seq AS seq, g.goal[1] AS first_value FROM goal_asof', "goal_asof")
def goal_asof(spark, d):
    return G.goal_asof(V.diary(spark, d), V.goals(spark, d), ["user"]).select("user", "day", "stat", "seq", F.col("goal")[0].alias("first_value"))


@query("""SELECT "user", day, stat, value FROM day_goals WHERE stat = 'fat'""", "day_goals")
def percent_goal(spark, d):
    return G.day_goal(V.diary(spark, d), V.goals(spark, d), ["user"]).where("stat = 'fat'")


@query('SELECT "user", stat, seq, CASE WHEN shared THEN goal[1] ELSE floor((goal[1] + goal[2] + goal[3] + goal[4] + goal[5] + goal[6] + goal[7]) / 7 * 100e0 + 0.5e0) / 100e0 END AS average FROM goals', "goals")
def average_goal(spark, d):
    return G.average_goal(V.goals(spark, d))


def _against_goals(spark, d) -> DataFrame:
    goals = G.day_goal(V.diary(spark, d), V.goals(spark, d), ["user"])
    totals = _day_totals(spark, d).withColumnRenamed("nutrient", "stat")
    return totals.join(goals.withColumnRenamed("value", "goal"), ["user", "day", "stat"]).select("user", "day", "stat", "total", "goal")


@query("""SELECT t."user", t.day, stat, total, value AS goal, value - total AS remaining, CASE WHEN total / value > 2 THEN 1e0 WHEN total / value > 1 THEN total / value - 1 ELSE total / value END AS progress
 FROM day_totals t JOIN day_goals g ON t."user" = g."user" AND t.day = g.day AND t.nutrient = g.stat""", "day_totals day_goals")
def diary_vs_goals(spark, d):
    rows = _against_goals(spark, d)
    return rows.select("*", (F.col("goal") - F.col("total")).alias("remaining"), S.goal_progress(F.col("total"), F.col("goal")).alias("progress"))


@query("""SELECT t."user", t.day, stat, CASE WHEN total / value > 2 THEN 1e0 WHEN total / value > 1 THEN total / value - 1 ELSE total / value END AS progress, total > value AS over
 FROM day_totals t JOIN day_goals g ON t."user" = g."user" AND t.day = g.day AND t.nutrient = g.stat WHERE stat = 'calories'""", "day_totals day_goals")
def goal_progress(spark, d):
    rows = _against_goals(spark, d).where("stat = 'calories'")
    return rows.select("user", "day", "stat", S.goal_progress(F.col("total"), F.col("goal")).alias("progress"), (F.col("total") > F.col("goal")).alias("over"))


_ADJUST = """SELECT "user", day, total, goal, greatest(floor(goal - coalesce(CAST(sum(CAST(total - goal AS DECIMAL(18, 2))) OVER w AS DOUBLE), 0e0) / {left} + 0.5e0), 0e0) AS adjusted FROM {rows} {window}"""


@query(_ADJUST.format(left="(7 - (dayofweek(day) + 6) % 7)", rows="calorie_days", window='WINDOW w AS (PARTITION BY "user", day - CAST((dayofweek(day) + 6) % 7 AS INTEGER) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'), "calorie_days")
def goal_auto_adjust_week(spark, d):
    actual = _against_goals(spark, d).where("stat = 'calories'").drop("stat")
    return G.auto_adjust(actual, ["user"], first_day=1)


@query(_ADJUST.format(left="2", rows="(SELECT *, CAST(date_diff('day', DATE '1970-01-01', day) AS INTEGER) AS n FROM calorie_days)", window='WINDOW w AS (PARTITION BY "user" ORDER BY n RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)'), "calorie_days")
def goal_auto_adjust_rolling(spark, d):
    actual = _against_goals(spark, d).where("stat = 'calories'").drop("stat")
    return G.auto_adjust(actual, ["user"], trailing=10)


# Series


def _stats(spark, d) -> DataFrame:
    return T.kept(V.body_stats(spark, d))


@query('SELECT "user", stat, day, "index", value FROM filled', "filled")
def gap_fill(spark, d):
    return T.gap_fill(_stats(spark, d), ["user", "stat"])


@query('SELECT "user", stat, day, "index", value, floor(avg(value) OVER (PARTITION BY "user", stat ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 100e0 + 0.5e0) / 100e0 AS moving FROM filled', "filled")
def moving_average(spark, d):
    return T.moving_average(T.gap_fill(_stats(spark, d), ["user", "stat"]), ["user", "stat"], 7)


@query("""SELECT "user", stat, floor(slope * 10000e0 + 0.5e0) / 10000e0 AS slope, floor(intercept * 10000e0 + 0.5e0) / 10000e0 AS intercept FROM
 (SELECT *, (CAST(sy AS DOUBLE) / 100e0 - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept FROM
 (SELECT *, CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) / 100e0 AS slope FROM
 (SELECT "user", stat, count(*) AS n, sum("index") AS sx, sum(y) AS sy, sum("index" * y) AS sxy, sum("index" * "index") AS sxx FROM
 (SELECT *, CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS y FROM filled WHERE value IS NOT NULL) GROUP BY ALL HAVING count(*) >= 2)))""", "filled")
def trend_line(spark, d):
    return T.trend(T.gap_fill(_stats(spark, d), ["user", "stat"]), ["user", "stat"])


@query('SELECT "user", count(value) AS days, floor(CAST(sum(CAST(value AS DECIMAL(24, 6))) AS DOUBLE) / count(value) * 1000e0 + 0.5e0) / 1000e0 AS average FROM series GROUP BY ALL', "series")
def series_average(spark, d):
    calories = _day_totals(spark, d).where("nutrient = 'calories'").select("user", "day", F.col("total").alias("value"))
    return T.average(calories, ["user"])


@query('SELECT s."user", s.day, floor(s.value * 100e0 + 0.5e0) / 100e0 AS value, average FROM series s JOIN (SELECT "user", floor(CAST(sum(CAST(value AS DECIMAL(24, 6))) AS DOUBLE) / count(value) * 1000e0 + 0.5e0) / 1000e0 AS average FROM series GROUP BY ALL) a ON s."user" = a."user"', "series")
def stat_series(spark, d):
    calories = T.kept(_day_totals(spark, d).where("nutrient = 'calories'").select("user", "day", F.col("total").alias("value")))
    return calories.withColumn("value", S.half_up(F.col("value"))).join(T.average(calories, ["user"]).drop("days"), "user")


@query("SELECT \"user\", day, stat, value FROM body_stats WHERE stat = 'purchase' AND value <> 0 AND day >= DATE '2024-01-10' AND day < DATE '2024-01-17' ORDER BY day DESC", "body_stats")
def stat_log(spark, d):
    day = F.col("day")
    rows = _stats(spark, d).where((F.col("stat") == "purchase") & (day >= F.lit("2024-01-10").cast("date")) & (day < F.lit("2024-01-17").cast("date")))
    return rows.select("user", "day", "stat", "value").orderBy(F.desc("day"))


@query("SELECT entry, \"user\", day FROM diary WHERE day >= DATE '1996-01-01' AND day < DATE '1996-02-01' AND entry IN (SELECT l_orderkey FROM lineitem)", "diary")
def diary_range(spark, d):
    """Days of a range that hold an item."""
    day = F.col("day")
    rows = V.diary(spark, d).where((day >= F.lit("1996-01-01").cast("date")) & (day < F.lit("1996-02-01").cast("date")))
    return rows.join(V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry")), "entry", "left_semi").select("entry", "user", "day")


@query("""SELECT "user", event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY "user" ORDER BY event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS last_value
 FROM (SELECT user_id AS "user", * FROM events)""")
def last_stats(spark, d):
    """The newest present value among the 15 latest entries."""
    window = Window.partitionBy("user").orderBy("event_id").rowsBetween(-14, 0)
    rows = V.table(spark, d, "events").withColumnRenamed("user_id", "user")
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return rows.select("user", "event_id", F.last(value, ignorenulls=True).over(window).alias("last_value"))


@query("""SELECT n, CASE n WHEN 7 THEN last - 6 ELSE CAST(last - to_months(n) AS DATE) END AS start, last FROM (SELECT max(day) AS last FROM diary), (VALUES (7), (1), (3), (6), (12)) t(n)""", "diary")
def range_preset(spark, d):
    last = V.diary(spark, d).agg(F.max("day").alias("last"))
    n = F.explode(F.array(*map(F.lit, (7, 1, 3, 6, 12)))).alias("n")
    return last.select(n, "last").select("n", F.when(F.col("n") == 7, F.date_sub("last", 6)).otherwise(F.add_months("last", -F.col("n"))).alias("start"), "last")


@query('SELECT a."user", a.day, a.entry, b.food_id, b.category FROM diary a JOIN diary_items b ON a."user" = b."user" AND a.day = b.day + 1', "diary diary_items")
def yesterdays_meal(spark, d):
    before = V.diary_items(spark, d).select("user", F.date_add("day", 1).alias("day"), "food_id", "category")
    return V.diary(spark, d).join(before, ["user", "day"]).select("user", "day", "entry", "food_id", "category")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(24, 6))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def daily_rollup(spark, d):
    from larder.streaming.rollup import daily_totals

    return daily_totals(V.table(spark, d, "events"))
