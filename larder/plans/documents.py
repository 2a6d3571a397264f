"""Queries on documents: migrations of old layouts, settings, merges, edits of an entry's items, fetched activities."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars as S
from larder.operators import documents as D
from larder.operators import edits as E
from larder.plans.registry import query
from larder.sources import migrations as M
from larder.sources import views as V


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'x' || chr(p_size + 200) || 'y' WHEN 1 THEN '☃ ☃' WHEN 2 THEN 'café' WHEN 3 THEN '&lt;' || p_name ELSE '¬it; &nosuch; & ¶§' END AS text FROM part""")
def character_references(spark, d):
    """Numeric, named, doubly escaped, and unended references, each decoded once."""
    k, size = F.col("p_partkey"), F.col("p_size")
    texts = [F.concat(F.lit("x&#"), (size + 200).cast("string"), F.lit(";y")), F.lit("&#x2603; &#X02603"), F.lit("caf&eacute;"), F.concat(F.lit("&amp;lt;"), "p_name"), F.lit("&notit; &nosuch; & &para&sect;")]
    return V.table(spark, d, "part").select(k.alias("id"), S.html_unescape(F.element_at(F.array(*texts), (k % 5 + 1).cast("int"))).alias("text"))


# Migrations: rows of three layouts, 29, 31 and 34.

_LAYOUT = "CASE p_partkey % 3 WHEN 0 THEN 29 WHEN 1 THEN 31 ELSE 34 END"


def _layout(k):
    return F.when(k % 3 == 0, 29).when(k % 3 == 1, 31).otherwise(34)


@query(f"""SELECT id, name, portion, unit, CASE WHEN v < 34 AND code LIKE '0%' THEN substring(code, 2) ELSE code END AS barcode,
 CASE WHEN v < 34 AND code LIKE '0%' THEN code WHEN v < 34 AND code LIKE 'fdcId_%' THEN replace(code, 'fdcId_', '') END AS original_barcode, image_url, x.n AS nutrient, x.v AS value
 FROM (SELECT p_partkey AS id, {_LAYOUT} AS v, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' é' ELSE p_name || '%20%E9' END AS name,
 CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN p_size * 10 + 5e0 ELSE p_size * 1e0 END AS portion, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'gr' ELSE 'ml' END AS unit,
 CASE WHEN p_partkey % 4 = 0 THEN 'fdcId_' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 4 = 1 THEN '00' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 4 = 2 THEN CAST(p_partkey AS VARCHAR) END AS code,
 CASE WHEN p_partkey % 3 <> 0 THEN '' END AS image_url, unnest([{{'n': CASE WHEN p_partkey % 3 = 0 THEN 'carbohydrates' ELSE 'carbs' END, 'v': p_size * 2e0}}, {{'n': 'fat', 'v': p_size * 1e0}},
 {{'n': CASE WHEN p_partkey % 3 = 0 THEN 'sugars' ELSE 'sugar' END, 'v': p_size * 3e0}}]) AS x FROM part)""")
def migrate_foods(spark, d):
    """Foods of three layouts: only the oldest have their portions, names and nutrients changed, and the newest nothing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = V.table(spark, d, "part").select(
        _layout(k).alias("version"), k.alias("id"), F.concat("p_name", F.lit("%20%E9")).alias("name"), F.lit(None).cast("string").alias("brand"),
        F.when((k % 3 == 0) & (k % 2 == 0), F.concat(size.cast("string"), F.lit(".5 gr"))).otherwise(size.cast("string")).alias("portion"),
        F.when((k % 3 != 0) | (k % 2 != 0), F.lit("ml")).alias("unit"),
        F.create_map(F.lit("carbs"), size * 2.0, F.lit("fat"), size * 1.0, F.lit("sugar"), size * 3.0).alias("nutrition"),
        F.when(k % 4 == 0, F.concat(F.lit("fdcId_"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("00"), k.cast("string"))).when(k % 4 == 2, k.cast("string")).alias("barcode"),
        F.lit(None).cast("string").alias("originalBarcode"), F.lit("").alias("image_url"),
    )
    found = M.migrate_foods(rows)
    return found.select("id", "name", "portion", "unit", "barcode", F.col("originalBarcode").alias("original_barcode"), "image_url", F.explode("nutrition").alias("nutrient", "value"))


_QUICK = 77


@query(f"""WITH flat AS (SELECT o_custkey AS "user", CAST(o_orderdate AS DATE) AS day, l_linenumber - 1 AS category, l_partkey, l_suppkey, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q, l_orderkey AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 weights AS (SELECT user_id AS "user", DATE '1995-01-01' + CAST(event_id % 1500 AS INTEGER) AS day, arg_max(value, event_id) AS weight FROM events GROUP BY ALL),
 old AS (SELECT "user", day, CASE WHEN n = 1 THEN {_QUICK} WHEN n % 2 = 0 THEN l_partkey ELSE l_suppkey END AS id, CASE WHEN n <> 1 AND n % 2 = 1 THEN 'recipe' ELSE 'food' END AS type, CASE WHEN n = 1 THEN 1e0 ELSE q END AS portion,
  CASE WHEN n <> 1 THEN 'g' END AS unit, CASE WHEN n = 1 THEN q * 10e0 WHEN n = 3 THEN 1e0 ELSE 2e0 END AS quantity, category FROM flat WHERE "user" % 3 = 0)
 SELECT old."user", old.day, id, type, portion, unit, quantity, category, weight FROM old LEFT JOIN weights ON old."user" = weights."user" AND old.day = weights.day
 UNION ALL SELECT "user", day, l_partkey, 'food', q * 1e0, 'ml', 1e0, category, n * 1e0 FROM flat WHERE "user" % 3 <> 0""")
def migrate_diary(spark, d):
    """A third of the users have flat entries of the oldest layout with a log of weights; the others have documents already."""
    flat = V.table(spark, d, "lineitem").join(V.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n, user = F.col("l_linenumber"), F.col("o_custkey")
    old, quantity = user % 3 == 0, F.col("l_quantity").cast("int")
    at = (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=n)).cast("timestamp_ntz")
    item = F.struct(F.col("l_partkey").alias("id"), F.lit("food").alias("type"), quantity.cast("double").alias("portion"), F.lit("ml").alias("unit"), F.lit(1.0).alias("quantity"), (n - 1).alias("category")).cast(M.ITEM)
    entries = flat.select(
        user.alias("user"), F.when(old, 29).otherwise(F.lit(30) + user % 3).cast("int").alias("version"), at.alias("date_time"), F.when(old, n - 1).cast("int").alias("category"),
        F.when(old, F.when(n == 1, M.QUICK_ADD).otherwise(F.concat(quantity.cast("string"), F.lit(".9 g")))).alias("portion"), F.when(old & (n != 3), 2.0).alias("quantity"),
        F.when(old & (n % 2 == 0), F.col("l_partkey")).alias("food_id"), F.when(old & (n != 1) & (n % 2 == 1), F.col("l_suppkey")).alias("recipe_id"), F.when(old & (n == 1), quantity * 10.0).alias("calories"),
        F.when(~old, F.array(item)).alias("items"), F.when(~old, F.create_map(F.lit("weight"), n.cast("double"))).alias("stats"),
    )
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 1500).cast("int"))
    weights = V.table(spark, d, "events").select(F.col("user_id").alias("user"), (day.cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("event_id") / 1000)).alias("date_time"), F.col("value").alias("weight"))
    found = M.migrate_diary(entries, weights, _QUICK)
    rows = found.select("user", "day", F.explode("items").alias("i"), F.try_element_at("stats", F.lit("weight")).alias("weight"))
    return rows.select("user", "day", "i.id", "i.type", "i.portion", "i.unit", "i.quantity", "i.category", "weight")


@query(f"""SELECT id, name, x.i AS item, x.p AS portion, CASE WHEN v < 30 THEN 'g' ELSE 'ml' END AS unit, CASE WHEN v < 30 THEN 1e0 END AS quantity FROM (SELECT p_partkey AS id, {_LAYOUT} AS v, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' x' ELSE p_name || '%20x' END AS name,
 unnest([{{'i': p_partkey + 1, 'p': p_size * 1e0}}, {{'i': p_partkey + 2, 'p': 7e0}}]) AS x FROM part)""")
def migrate_meals(spark, d):
    """Meals of three layouts: the oldest list foods with portions such as "5 g"."""
    k, size = F.col("p_partkey"), F.col("p_size")
    food = lambda more, text: F.struct((k + more).alias("id"), text.alias("portion"))
    foods = F.array(food(1, F.concat(size.cast("string"), F.lit(" g"))), food(2, F.lit("7g")))
    item = lambda more, portion: F.struct((k + more).alias("id"), F.lit("food").alias("type"), portion.cast("double").alias("portion"), F.lit("ml").alias("unit"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("int").alias("category")).cast(M.ITEM)
    meals = V.table(spark, d, "part").select(_layout(k).alias("version"), k.alias("id"), F.concat("p_name", F.lit("%20x")).alias("name"), F.lit(None).cast("string").alias("portion"), F.lit(None).cast("string").alias("unit"), F.when(k % 3 == 0, foods).alias("foods"), F.when(k % 3 != 0, F.array(item(1, size), item(2, F.lit(7)))).alias("items"))
    found = M.migrate_dishes(meals, recipes=False)
    return found.select("id", "name", F.explode("items").alias("i")).select("id", "name", F.col("i.id").alias("item"), "i.portion", "i.unit", "i.quantity")


@query("""SELECT c_custkey AS "user", x.stat AS stat, x.d AS show_in_diary, x.s AS show_in_stats, x.shared AS shared_goal, x.pct AS percent_goal, x.n AS goals, x.first AS first, x.last AS last FROM (SELECT *, unnest([
 {'stat': 'fat', 'd': true, 's': c_custkey % 2 = 0, 'shared': true, 'pct': CAST(NULL AS BOOLEAN), 'n': 1, 'first': CAST(c_nationkey AS VARCHAR), 'last': '7'},
 {'stat': 'weight', 'd': NULL, 's': NULL, 'shared': NULL, 'pct': NULL, 'n': 1, 'first': '70', 'last': '70'},
 {'stat': 'my-own', 'd': false, 's': NULL, 'shared': NULL, 'pct': true, 'n': 1, 'first': NULL, 'last': NULL},
 {'stat': 'salt', 'd': false, 's': NULL, 'shared': NULL, 'pct': NULL, 'n': 0, 'first': NULL, 'last': NULL}]) AS x FROM customer WHERE c_custkey % 4 <> 0)""")
def migrate_goals(spark, d):
    """Flat goal keys of the old settings become nested goals with a list; every fourth user's settings are new already."""
    found = D.migrated_settings(_settings(spark, d), ["fat", "salt"])
    rows = found.where("stats is not null").select("user", F.explode("stats").alias("stat", "v"))
    goal = F.try_element_at("v.goal_list", F.lit(1))
    return rows.select("user", "stat", "v.show_in_diary", "v.show_in_stats", goal["shared_goal"].alias("shared_goal"), goal["percent_goal"].alias("percent_goal"), F.coalesce(F.size("v.goal_list"), F.lit(0)).alias("goals"), F.try_element_at(goal["goal"], F.lit(1)).alias("first"), F.try_element_at(goal["goal"], F.lit(-1)).alias("last"))


@query("""SELECT c_custkey AS "user", CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'dark' WHEN c_custkey % 3 = 1 THEN 'light' END END AS mode, CASE WHEN c_custkey % 4 <> 0 OR c_custkey % 3 = 2 THEN 'blue' END AS color,
 CASE WHEN c_custkey % 4 <> 0 THEN 'salt,sugars,fat' ELSE 'salt,sugars' END AS "order", CASE WHEN c_custkey % 4 <> 0 THEN '9' ELSE '10' END AS version, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 <> 0 END AS show_brands,
 CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 6 = 1 THEN '1' ELSE '0' END END AS first_day, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'weight' ELSE '' END END AS shown FROM customer""")
def migrate_settings(spark, d):
    """Old settings' look, order, defaults, and body stats' visibility."""
    found = D.migrated_settings(_settings(spark, d), ["fat", "salt"])
    return found.select("user", F.try_element_at("appearance", F.lit("mode")).alias("mode"), F.try_element_at("appearance", F.lit("color")).alias("color"), F.array_join("order", ",").alias("order"), F.col("schemaVersion").alias("version"), "show_brands", F.try_element_at("general", F.lit("first-day-of-week")).alias("first_day"), F.array_join(F.map_keys("body_visibility"), ",").alias("shown"))


def _settings(spark, d):
    k = F.col("c_custkey")
    json = lambda column: F.to_json(F.array(column, F.lit("7")))
    flat = {
        "fat-show-in-diary": F.lit("true"), "fat-show-in-stats": F.when(k % 2 == 0, "true").otherwise("false"), "fat-shared-goal": F.lit("true"), "fat": json(F.col("c_nationkey").cast("string")),
        "weight": F.lit('["70"]'), "weight-show-in-stats": F.when(k % 5 == 0, "true").otherwise("false"), "my-own-show-in-diary": F.lit("false"), "my-own-percent-goal": F.lit("true"),
        "my-own": F.lit('["1"]'), "salt-show-in-diary": F.lit("false"), "nonsense": F.lit("3"), "first-day-of-week": F.when(k % 6 == 1, "1"),
    }
    goals = F.map_filter(F.create_map(*[x for key, v in flat.items() for x in (F.lit(key), v)]), lambda _, v: v.isNotNull())
    look = F.map_filter(F.create_map(F.lit("color"), F.lit("blue"), F.lit("dark-mode"), F.when(k % 3 == 0, "true").when(k % 3 == 1, "false")), lambda _, v: v.isNotNull())
    none = F.lit(None).cast("map<string,string>")
    return V.table(spark, d, "customer").select(
        k.alias("user"), F.when(k % 4 == 0, "10").when(k % 4 == 1, "3").alias("schemaVersion"), F.when(k % 3 != 2, look).otherwise(none).alias("theme"), F.when(k % 3 == 2, look).otherwise(none).alias("appearance"),
        goals.alias("goals"), F.array(F.lit("salt"), F.lit("sugars")).alias("order"), F.when((k % 4 != 0) & (k % 5 == 0), F.lit(False)).alias("show_brands"),
    )


# Merges


@query("""SELECT c_custkey AS "user", CASE WHEN c_custkey % 2 = 0 THEN 'dark' ELSE 'system' END AS mode, 7 AS period, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 0 END AS x, CASE WHEN c_custkey % 3 = 0 THEN 'kJ' ELSE 'kcal' END AS energy,
 CASE WHEN c_custkey % 2 = 0 THEN 'Brunch' ELSE 'Breakfast' END AS first_meal, 'Lunch' AS second_meal, c_name AS own FROM customer""")
def deep_merge(spark, d):
    """Settings of three levels: defaults, and over them what a user has set."""
    k = F.col("c_custkey")
    null = lambda kind: F.lit(None).cast(kind)
    defaults = F.struct(
        F.struct(F.lit("system").alias("mode"), F.struct(F.lit(7).alias("period"), F.lit(0).alias("x")).alias("chart")).alias("look"),
        F.create_map(F.lit("units"), F.create_map(F.lit("energy"), F.lit("kcal"), F.lit("weight"), F.lit("kg"))).alias("more"), F.array(F.lit("Breakfast"), F.lit("Lunch")).alias("meals"),
    )
    own = F.struct(
        F.struct(F.when(k % 2 == 0, "dark").alias("mode"), F.struct(F.when(k % 3 == 0, F.col("c_nationkey").cast("int")).alias("x"), F.col("c_name").alias("own")).alias("chart")).alias("look"),
        F.when(k % 3 == 0, F.create_map(F.lit("units"), F.create_map(F.lit("energy"), F.lit("kJ")))).otherwise(null("map<string,map<string,string>>")).alias("more"),
        F.when(k % 2 == 0, F.array(F.lit("Brunch"))).otherwise(null("array<string>")).alias("meals"),
    )
    rows = V.table(spark, d, "customer").select(k.alias("user"), defaults.alias("defaults"), own.alias("own"))
    m = rows.select("user", D.merge_columns(rows, "defaults", "own").alias("m"))
    return m.select("user", "m.look.mode", "m.look.chart.period", "m.look.chart.x", F.col("m.more")["units"]["energy"].alias("energy"), F.col("m.meals")[0].alias("first_meal"), F.col("m.meals")[1].alias("second_meal"), "m.look.chart.own")


# Edits of an entry's items


@query("""WITH s0 AS (SELECT o_orderkey AS e, o_custkey AS c, coalesce(xs, []) AS xs FROM orders LEFT JOIN (SELECT l_orderkey, list({'id': l_partkey, 'category': CAST(l_linenumber - 1 AS INTEGER)} ORDER BY l_linenumber, l_partkey, l_suppkey) AS xs FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
 s1 AS (SELECT e, c, xs || [{'id': c, 'category': CAST(9 AS INTEGER)}] AS xs FROM s0),
 s2 AS (SELECT e, c, CASE WHEN e % 3 = 0 THEN xs[1 : e % 5] || xs[e % 5 + 2 :] ELSE xs END AS xs FROM s1),
 s3 AS (SELECT e, c, CASE WHEN e % 2 = 0 THEN xs[1 : e % 7] || [{'id': -e, 'category': CAST(1 AS INTEGER)}] || xs[e % 7 + 2 :] ELSE xs END AS xs FROM s2),
 s4 AS (SELECT e, c, list_transform(xs, lambda x: {'id': x.id, 'category': CASE WHEN x.category = 1 THEN CAST(5 AS INTEGER) ELSE x.category END}) AS xs FROM s3)
 SELECT e AS entry, CAST(i - 1 AS INTEGER) AS place, xs[i].id AS id, xs[i].category AS category FROM (SELECT e, xs, unnest(range(1, len(xs) + 1)) AS i FROM s4)""")
def edit_items(spark, d):
    """In every entry an item is added, in some one is removed and one replaced, and the second group is moved; places may lie behind the end."""
    lines = V.table(spark, d, "lineitem")
    item = F.struct(F.col("l_partkey").alias("id"), (F.col("l_linenumber") - 1).cast("int").alias("category"))
    placed = F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("item"))
    entries = lines.groupBy(F.col("l_orderkey").alias("entry")).agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["item"]).alias("items"))
    e = F.col("o_orderkey")
    kind = "struct<id:bigint,category:int>"
    item_of = lambda k, category: F.struct(k.alias("id"), F.lit(category).cast("int").alias("category")).cast(kind)
    none = F.lit(None)

    def edit(seq, op, place=none, item=none, group=none, to=none):
        return F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), place.cast("int").alias("place"), item.cast(kind).alias("item"), group.cast("int").alias("group"), to.cast("int").alias("to"))

    edits = [
        edit(1, "add", item=item_of(F.col("o_custkey"), 9)), F.when(e % 3 == 0, edit(2, "remove", e % 5)),
        F.when(e % 2 == 0, edit(3, "update", e % 7, item_of(-e, 1))), edit(4, "move", group=F.lit(1), to=F.lit(5)),
    ]
    log = V.table(spark, d, "orders").select(e.alias("entry"), F.inline(F.array_compact(F.array(*edits))))
    return D.apply_edits(entries, log).select("entry", F.posexplode("items").alias("place", "i")).select("entry", "place", "i.id", "i.category")


@query("""WITH c AS (SELECT DISTINCT user_id AS "user", CAST(ts AS DATE) AS day, ts AS date_time, CAST(0 AS INTEGER) AS category, -value AS quantity, CASE WHEN event_id % 3 <> 0 THEN event_type END AS description FROM events WHERE event_type <> 'view')
 SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id AS "user", ts AS date_time, -value AS quantity, CASE WHEN event_id % 3 <> 0 THEN event_type END AS description FROM events WHERE event_id % 2 = 0) s
 WHERE s."user" = c."user" AND s.date_time = c.date_time AND s.quantity = c.quantity AND s.description IS NOT DISTINCT FROM c.description)""")
def activity_sync(spark, d):
    """Fetched activities as items of burned energy, without those that the day has already; some have no name."""
    rows = V.table(spark, d, "events")
    fetched = rows.where("event_type <> 'view'").select(F.col("user_id").alias("user"), F.to_date("ts").alias("day"), F.col("ts").alias("date_time"), F.col("value").alias("calories"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("name"))
    stored = rows.where("event_id % 2 = 0").select(F.col("user_id").alias("user"), F.to_date("ts").alias("day"), F.col("ts").alias("date_time"), F.lit(0).alias("category"), (-F.col("value")).alias("quantity"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("description"))
    return E.new_activities(fetched, stored)
