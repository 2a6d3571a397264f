"""Queries that change foods, diary, goals and settings, and the lookups around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars as S
from larder.operators import edits as E
from larder.plans.registry import query
from larder.sources import views as V


@query("SELECT id, name, brand FROM foods WHERE id = 42", "foods")
def key_lookup(spark, d):
    return V.foods(spark, d).where("id = 42").select("id", "name", "brand")


@query("SELECT entry, \"user\", day FROM diary WHERE day = DATE '1998-03-05'", "diary")
def diary_entry(spark, d):
    return V.diary(spark, d).where("day = DATE '1998-03-05'")


@query("SELECT entry, food_id, category FROM (SELECT entry, CASE WHEN food_id % 7 <> 0 THEN food_id END AS food_id, CASE WHEN food_id % 5 <> 0 THEN category END AS category FROM diary_items) WHERE food_id IS NOT NULL AND category IS NOT NULL", "diary_items")
def eligible_items(spark, d):
    items = V.diary_items(spark, d).select("entry", F.when(F.col("food_id") % 7 != 0, F.col("food_id")).alias("food_id"), F.when(F.col("food_id") % 5 != 0, F.col("category")).alias("category"))
    return E.eligible(items)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'calories' ELSE 'kilojoules' END AS stat FROM orders")
def energy_unit_name(spark, d):
    unit = F.when(F.col("o_orderkey") % 2 == 0, "kcal").otherwise("kJ")
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.energy_unit_name(unit).alias("stat"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%d/%m/%Y') AS date FROM orders")
def locale_date(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.locale_date(F.col("o_orderdate")).alias("date"))


@query("SELECT c_custkey AS id, c_name || ' é ☃ 5% %zz ' || CAST(c_nationkey AS VARCHAR) AS text FROM customer")
def legacy_unescape(spark, d):
    text = F.concat("c_name", F.lit("%20%E9 %u2603 5% %zz%20"), F.col("c_nationkey").cast("string"))
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.legacy_unescape(text).alias("text"))


@query("SELECT p_partkey AS id, floor(CASE p_partkey % 4 WHEN 0 THEN p_size / 1000e0 WHEN 1 THEN p_size * 1000e0 WHEN 2 THEN p_size / 1000e0 ELSE p_size END * 1e6 + 0.5e0) / 1e6 AS value FROM part")
def label_to_app_unit(spark, d):
    units = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("app")) for a, b in (("mg", "g"), ("g", "mg"), ("µg", "mg"), ("ml", "g"))])
    unit = F.element_at(units, (F.col("p_partkey") % 4 + 1).cast("int"))
    value = S.label_to_app_unit(F.col("p_size").cast("double"), unit["label"], unit["app"])
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.half_up(value, 6).alias("value"))


@query("SELECT event_id AS id, event_id % 10 = 0 OR ts - to_minutes(event_id % 90) < ts - INTERVAL 60 MINUTE AS due FROM events")
def backup_due(spark, d):
    """The last backup was made up to 89 minutes before each event; every tenth has none."""
    now = F.col("ts").cast("timestamp")
    last = F.when(F.col("event_id") % 10 != 0, now - F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int")))
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), E.backup_due(last, now).alias("due"))


@query("SELECT id, name FROM foods WHERE name IS NOT NULL UNION ALL SELECT (SELECT max(id) FROM foods WHERE name IS NOT NULL) + row_number() OVER (ORDER BY s_name), s_name FROM supplier", "foods")
def bulk_insert(spark, d):
    new = V.table(spark, d, "supplier").select(F.lit(None).cast("long").alias("id"), F.col("s_name").alias("name"))
    return E.insert_all(V.foods(spark, d).where("name is not null").select("id", "name"), new)


_CHOSEN = """(SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey % 1800 + 1000 AS VARCHAR) END AS barcode, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS id FROM supplier)"""


@query(f"""SELECT id, barcode, name, coalesce(hidden, false) AND id NOT IN (SELECT coalesce(c.id, f.id) FROM {_CHOSEN} c LEFT JOIN (SELECT barcode, min(id) AS id FROM foods WHERE NOT archived GROUP BY 1) f
 ON c.barcode = f.barcode WHERE coalesce(c.id, f.id) IS NOT NULL) AS hidden FROM foods UNION ALL
 SELECT (SELECT max(id) FROM foods) + row_number() OVER (ORDER BY barcode NULLS FIRST, name), barcode, name, false FROM (SELECT c.barcode, min(s_name) AS name FROM {_CHOSEN} c
 LEFT JOIN (SELECT barcode, min(id) AS id FROM foods WHERE NOT archived GROUP BY 1) f ON c.barcode = f.barcode WHERE c.id IS NULL AND f.id IS NULL GROUP BY c.barcode, CASE WHEN c.barcode IS NULL THEN s_suppkey END)""", "foods")
def choose_remote(spark, d):
    """Foods after suppliers' records were chosen as a remote search gives them: some are stored already, some known by their barcode, the others are added."""
    foods = V.foods(spark, d).select("id", "barcode", "name", "archived", "hidden")
    return E.resolve_or_insert(foods, _chosen(spark, d))[0].select("id", "barcode", "name", "hidden")


def _chosen(spark, d):
    k = F.col("s_suppkey")
    code = F.when(k % 10 != 0, (k % 1800 + 1000).cast("string"))
    return V.table(spark, d, "supplier").select(F.when(k % 4 == 0, k).alias("id"), code.alias("barcode"), F.col("s_name").alias("name"), F.lit(False).alias("archived"), F.lit(False).alias("hidden"))


@query("SELECT id, name FROM foods WHERE id NOT IN (SELECT s_suppkey FROM supplier)", "foods")
def delete_by_key(spark, d):
    return E.delete_keys(V.foods(spark, d).select("id", "name"), V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("""SELECT CAST(NULL AS BIGINT) AS id, barcode, name, date_time FROM n WHERE id IS NULL UNION ALL SELECT id, barcode, name, date_time FROM n WHERE id IS NOT NULL
 UNION ALL SELECT id, barcode, name, date_time FROM foods WHERE id NOT IN (SELECT id FROM n WHERE id IS NOT NULL)""".replace("FROM n ", "FROM (SELECT f.id, k.barcode, k.name, DATE '2024-05-01' AS date_time FROM (SELECT CAST(s_suppkey % 900 + 1000 AS VARCHAR) AS barcode, min(s_name) AS name FROM supplier GROUP BY 1) k LEFT JOIN (SELECT barcode, min(id) AS id FROM foods WHERE NOT archived AND barcode <> '' GROUP BY 1) f ON k.barcode = f.barcode) n "), "foods")  # fmt: skip
def upsert_foods_by_barcode(spark, d):
    new = V.table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 900 + 1000).cast("string").alias("barcode")).agg(F.min("s_name").alias("name"))
    rows = V.foods(spark, d).select("id", "barcode", "name", "date_time", "archived")
    found = E.upsert_by_barcode(rows, new.withColumns({"id": F.lit(None).cast("long"), "archived": F.lit(False)}), F.lit("2024-05-01").cast("date"))
    return found.select("id", "barcode", "name", "date_time")


@query("SELECT id, name, CASE WHEN id % 3 = 0 THEN false ELSE archived END AS archived, false AS hidden FROM foods", "foods")
def save_rules(spark, d):
    rows = V.foods(spark, d).select("id", "name", F.when(F.col("id") % 3 != 0, F.col("archived")).alias("archived"), "hidden", F.lit("100g").alias("nutrition_per"))
    return E.saved(rows)


@query("SELECT id, name, hidden AND id NOT IN (SELECT food_id FROM diary_items) AS hidden FROM foods", "foods diary_items")
def unhide_selected(spark, d):
    return E.selected(V.foods(spark, d).select("id", "name", "hidden"), V.diary_items(spark, d).select(F.col("food_id").alias("id"))).select("id", "name", "hidden")


@query("SELECT l_orderkey AS entry, l_linenumber - 1 AS category, l_partkey AS id, CASE WHEN l_linenumber = 2 THEN '2024-05-01T08:00' ELSE '-' END AS date_time FROM lineitem")
def stamp_group(spark, d):
    """The second group's items of every entry are given a time."""
    item = F.struct((F.col("l_linenumber") - 1).alias("category"), F.col("l_partkey").alias("id"), F.lit("-").alias("date_time"))
    entries = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entry")).agg(F.collect_list(item).alias("items"))
    return entries.select("entry", F.inline(E.stamp_group(F.col("items"), 1, F.lit("2024-05-01T08:00"))))


@query("SELECT event_id AS id, x.k AS stat, x.v AS value FROM (SELECT event_id, unnest([{'k': 'weight', 'v': floor(value * 0.4535924e0 * 10000e0 + 0.5e0) / 10000e0}, {'k': 'waist', 'v': CASE WHEN event_id % 3 <> 0 THEN floor(event_id % 50 * 2.54e0 * 10000e0 + 0.5e0) / 10000e0 END}]) AS x FROM events) WHERE x.v IS NOT NULL")
def save_stats(spark, d):
    """Inputs in pounds and inches; some are no numbers."""
    waist = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise((F.col("event_id") % 50).cast("string"))
    values = F.create_map(F.lit("weight"), F.col("value").cast("string"), F.lit("waist"), waist, F.lit("neck"), F.lit(""))
    stored = E.saved_stats(values, {"weight": "lb", "waist": "inch"}, {"weight": "kg", "waist": "cm"})
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.explode(stored).alias("stat", "value"))


@query("""SELECT "user", stat, seq, effective_from, goal[1] AS first FROM goals WHERE NOT (stat = 'calories' AND seq = 1 AND "user" % 5 = 0) AND NOT (stat = 'proteins' AND "user" % 13 = 0)
 UNION ALL SELECT c_custkey, 'calories', 1, DATE '1997-06-01' + CAST(c_custkey % 200 AS INTEGER), 2500e0 FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT c_custkey, 'fat', 2, DATE '2001-01-01', c_nationkey + 0e0 FROM customer WHERE c_custkey % 7 = 0
 UNION ALL SELECT c_custkey, 'sugars', 0, DATE '2001-01-01', 25e0 FROM customer WHERE c_custkey % 11 = 0""", "goals")
def edit_goals(spark, d):
    """Some users edit a goal, some add one or a stat's first, and some delete a stat's only one."""
    goals = V.goals(spark, d).select("user", "stat", "seq", "effective_from", F.col("goal")[0].alias("first"))
    k, keys = F.col("c_custkey"), ["user", "stat"]

    def goal(stat, day, first):
        return F.struct(F.lit(stat).alias("stat"), F.coalesce(day, F.lit(None).cast("date")).alias("effective_from"), first.alias("first"))

    later = F.lit("2001-01-01").cast("date")
    edits = [
        F.when(k % 5 == 0, goal("calories", F.date_add(F.lit("1997-06-01").cast("date"), (k % 200).cast("int")), F.lit(2500.0))),
        F.when(k % 7 == 0, goal("fat", later, F.col("c_nationkey").cast("double"))),
        F.when(k % 11 == 0, goal("sugars", later, F.lit(25.0))),
    ]
    new = V.table(spark, d, "customer").select(k.alias("user"), F.inline(F.array_compact(F.array(*edits))))
    gone = goals.where("stat = 'proteins' and user % 13 = 0")
    return E.delete_goal(E.set_goal(goals, new, keys), gone, keys).select("user", "stat", "seq", "effective_from", "first")


@query("SELECT old, new, new NOT IN (SELECT DISTINCT event_type FROM events UNION SELECT 'fat') AS allowed FROM (SELECT DISTINCT p_brand AS old, CASE WHEN p_size % 3 = 0 THEN 'fat' WHEN p_size % 3 = 1 THEN p_type ELSE 'view' END AS new FROM part)")
def may_rename(spark, d):
    size = F.col("p_size")
    wanted = V.table(spark, d, "part").select(F.col("p_brand").alias("old"), F.when(size % 3 == 0, "fat").when(size % 3 == 1, F.col("p_type")).otherwise("view").alias("new")).distinct()
    names = V.body_stats(spark, d).select(F.col("stat").alias("name")).union(spark.range(1).select(F.lit("fat")))
    return E.may_rename(names, wanted)


@query("""SELECT g."user", n.stat, CASE n.stat WHEN 'calories' THEN 'kcal' WHEN 'kilojoules' THEN 'kJ' ELSE 'g' END AS unit, g.seq, g.goal[1] AS value
 FROM (SELECT DISTINCT nutrient AS stat FROM nutrients) n LEFT JOIN goals g ON n.stat = g.stat""", "nutrients goals")
def nutriment_catalogue(spark, d):
    """Every nutriment that a food has, with its unit and the users' goals; one without a goal stays."""
    from larder.operators.nutrition import with_kilojoules

    names = V.known_foods(spark, d).select(F.explode(F.map_keys(with_kilojoules(F.col("nutrition")))).alias("stat")).distinct()
    units = names.withColumn("unit", S.goal_unit(F.col("stat"), F.lit(False)))
    return units.join(V.goals(spark, d).select("user", "stat", "seq", F.col("goal")[0].alias("value")), "stat", "left").select("user", "stat", "unit", "seq", "value")


@query("SELECT DISTINCT event_type AS stat, 'body' AS kind FROM events UNION ALL SELECT DISTINCT nutrient, 'nutriment' FROM nutrients", "nutrients")
def all_stats(spark, d):
    """Body stats, then nutriments."""
    body = V.body_stats(spark, d).select("stat", F.lit("body").alias("kind")).distinct()
    nutriments = V.known_foods(spark, d).select(F.explode(F.map_keys("nutrition")).alias("stat")).union(spark.range(1).select(F.lit("kilojoules"))).distinct()
    return body.union(nutriments.withColumn("kind", F.lit("nutriment")))


@query("SELECT l_orderkey AS entry, l_partkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey) - 1 AS INTEGER) AS place FROM lineitem")
def manual_order(spark, d):
    """Items of an entry in an order of the user's own, kept as places."""
    item = F.struct((-F.col("l_linenumber")).alias("key"), F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("next"))
    entries = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entry")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return entries.select("entry", F.posexplode("items").alias("place", "item")).select("entry", "item.id", "place")


