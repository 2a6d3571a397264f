"""Food-list queries: scans, lookups, filters, search, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars as S
from larder.operators import lists as L
from larder.plans.registry import query
from larder.sources import views as V

_COLUMNS = ["id", "name", "brand", "barcode", "archived", "hidden"]


@query("SELECT id, date_time, name, brand, unit, portion, barcode, archived, hidden, CAST(len(categories) AS INTEGER) AS labels FROM foods", "foods")
def scan_foods(spark, d):
    rows = V.foods(spark, d)
    return rows.select("id", "date_time", "name", "brand", "unit", "portion", "barcode", "archived", "hidden", F.when(F.col("categories").isNotNull(), F.size("categories")).alias("labels"))


@query("SELECT id, name FROM foods WHERE name IS NOT NULL ORDER BY name, id", "foods")
def list_alpha(spark, d):
    return L.alphabetical(V.foods(spark, d)).select("id", "name")


@query("SELECT id, date_time FROM foods ORDER BY date_time DESC, id", "foods")
def list_recent(spark, d):
    return L.recent(V.foods(spark, d)).select("id", "date_time")


@query("SELECT id, name FROM foods WHERE name IS NOT NULL ORDER BY name, id LIMIT 20 OFFSET 40", "foods")
def page_20(spark, d):
    return L.page(L.alphabetical(V.foods(spark, d)), 2).select("id", "name")


@query("SELECT k.key, f.id FROM (SELECT DISTINCT CAST(o_custkey % 1200 + 900 AS VARCHAR) AS key FROM orders) k LEFT JOIN (SELECT barcode, min(id) AS id FROM foods GROUP BY 1) f ON k.key = f.barcode", "foods")
def lookup_by_barcode(spark, d):
    keys = V.table(spark, d, "orders").select((F.col("o_custkey") % 1200 + 900).cast("string").alias("key")).distinct()
    return L.lookup(V.foods(spark, d), "barcode", keys)


@query("SELECT barcode AS key, min(id) AS id FROM foods WHERE NOT archived AND barcode <> '' GROUP BY 1", "foods")
def first_non_archived(spark, d):
    rows = L.archived_filter(V.foods(spark, d), False).where("barcode <> ''")
    return rows.groupBy(F.col("barcode").alias("key")).agg(F.min("id").alias("id"))


@query("SELECT l_orderkey AS entry, l_linenumber AS place, l_partkey AS id, f.name FROM lineitem LEFT JOIN known_foods f ON l_partkey = f.id", "known_foods")
def multi_get(spark, d):
    keys = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("id"))
    return keys.join(V.known_foods(spark, d).select("id", "name"), "id", "left").select("entry", "place", "id", "name")


@query("SELECT k.key, coalesce(l.id, r.id) AS id, l.id IS NULL AND r.id IS NOT NULL AS remote FROM (SELECT DISTINCT barcode AS key FROM foods WHERE barcode <> '') k LEFT JOIN (SELECT barcode, min(id) AS id FROM foods WHERE NOT archived AND id % 2 = 0 GROUP BY 1) l ON k.key = l.barcode LEFT JOIN (SELECT barcode, min(id) AS id FROM foods WHERE id % 2 = 1 GROUP BY 1) r ON k.key = r.barcode", "foods")
def lookup_local_then_remote(spark, d):
    """Even foods are the local list, odd ones the remote one."""
    rows = V.foods(spark, d)
    keys = rows.where("barcode <> ''").select(F.col("barcode").alias("key")).distinct()
    local = L.lookup(L.archived_filter(rows, False).where("id % 2 = 0"), "barcode", keys).withColumnRenamed("id", "local")
    remote = L.lookup(rows.where("id % 2 = 1"), "barcode", keys).withColumnRenamed("id", "remote_id")
    return local.join(remote, "key").select("key", F.coalesce("local", "remote_id").alias("id"), (F.col("local").isNull() & F.col("remote_id").isNotNull()).alias("remote"))


@query("SELECT id, name, brand, barcode, archived, hidden FROM foods WHERE archived", "foods")
def filter_archived(spark, d):
    return L.archived_filter(V.foods(spark, d), True).select(_COLUMNS)


@query("SELECT id, name, brand, barcode, archived, hidden FROM foods WHERE NOT archived AND NOT hidden", "foods")
def filter_hidden(spark, d):
    return L.hidden_filter(L.archived_filter(V.foods(spark, d), False), False).select(_COLUMNS)


@query("SELECT id, name, brand FROM foods WHERE name IS NULL OR ((regexp_matches(name, '(?i)red') OR regexp_matches(brand, '(?i)red')) AND (regexp_matches(name, '(?i)1') OR regexp_matches(brand, '(?i)1')))", "foods")
def text_search(spark, d):
    return L.text_search(V.foods(spark, d), "red 1").select("id", "name", "brand")


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(strip_accents(text), '(?i)ete') AND regexp_matches(strip_accents(text), '(?i)uber')")
def text_search_accent(spark, d):
    docs = V.table(spark, d, "documents").withColumns({"name": F.col("text"), "brand": F.lit("")})
    return L.text_search(docs, "été über").select("doc_id", "lang")


@query("SELECT id FROM foods WHERE list_contains(categories, 'organic') AND list_contains(categories, 'STANDARD')", "foods")
def category_all(spark, d):
    return L.has_all(V.foods(spark, d), ["organic", "STANDARD"]).select("id")


@query("SELECT id FROM foods WHERE categories IS NULL OR len(categories) = 0", "foods")
def no_category(spark, d):
    return L.uncategorised(V.foods(spark, d)).select("id")


@query("SELECT id, array_to_string(list_filter(['organic', 'PROMO', 'SMALL'], lambda x: list_contains(categories, x)), ',') AS labels FROM foods WHERE categories IS NOT NULL", "foods")
def label_display(spark, d):
    labels = F.array_intersect(F.array(F.lit("organic"), F.lit("PROMO"), F.lit("SMALL")), "categories")
    return V.foods(spark, d).where("categories IS NOT NULL").select("id", F.concat_ws(",", labels).alias("labels"))


@query("SELECT id, array_to_string(list_transform(categories, lambda x: CASE WHEN x = 'organic' THEN 'bio' ELSE x END), ',') AS labels FROM foods WHERE categories IS NOT NULL", "foods")
def rename_category(spark, d):
    return V.foods(spark, d).where("categories IS NOT NULL").select("id", F.concat_ws(",", L.rename_label(F.col("categories"), "organic", "bio")).alias("labels"))


@query("SELECT id, array_to_string(list_filter(categories, lambda x: x <> 'STANDARD'), ',') AS labels FROM foods WHERE len(list_filter(categories, lambda x: x <> 'STANDARD')) > 0", "foods")
def drop_category(spark, d):
    rows = V.foods(spark, d).withColumn("left", L.drop_label(F.col("categories"), "STANDARD")).where("left IS NOT NULL")
    return rows.select("id", F.concat_ws(",", "left").alias("labels"))


@query("SELECT id, replace(nutrient, 'proteins', 'protein') AS nutrient, value FROM (SELECT food_id AS id, nutrient, value FROM nutrients) WHERE nutrient <> 'kilojoules'", "nutrients")
def rename_map_key(spark, d):
    renamed = L.drop_key(L.rename_key(F.col("nutrition"), "proteins", "protein"), "kilojoules")
    return V.known_foods(spark, d).select("id", F.explode(renamed).alias("nutrient", "value"))


@query("SELECT food_id AS id, nutrient, value FROM nutrients WHERE nutrient NOT IN ('kilojoules', 'sugars')", "nutrients")
def drop_map_key(spark, d):
    left = L.drop_key(L.drop_key(F.col("nutrition"), "kilojoules"), "sugars")
    return V.known_foods(spark, d).select("id", F.explode(left).alias("nutrient", "value"))


@query("SELECT id, floor(coalesce(calories, 0e0) * 100e0 + 0.5e0) / 100e0 AS kcal, floor(CASE WHEN calories IS NULL THEN 0e0 ELSE coalesce(kilojoules, calories / 0.23900573614e0) END * 100e0 + 0.5e0) / 100e0 AS kj FROM foods", "foods")
def item_energy(spark, d):
    n = F.col("nutrition")
    kcal, kj = (S.item_energy(n["calories"], n["kilojoules"], in_kj) for in_kj in (False, True))
    return V.foods(spark, d).select("id", S.half_up(kcal).alias("kcal"), S.half_up(kj).alias("kj"))


@query("SELECT id, fat * (250e0 / portion) AS fat, carbohydrates * (250e0 / portion) AS carbohydrates, portion * (50e0 / proteins) AS portion_for_50g FROM foods WHERE proteins > 0", "foods")
def linked_rescale(spark, d):
    """All nutrients at a portion of 250, and the portion that has 50 g of protein."""
    n, to = F.col("nutrition"), F.lit(250.0) / F.col("portion")
    rows = V.foods(spark, d).where(n["proteins"] > 0)
    return rows.select("id", (n["fat"] * to).alias("fat"), (n["carbohydrates"] * to).alias("carbohydrates"), (F.col("portion") * (F.lit(50.0) / n["proteins"])).alias("portion_for_50g"))


@query("SELECT id, 'x' || CAST(id % 5 AS VARCHAR) AS name, id % 5 = 0 AS changed FROM (SELECT id, id AS k FROM foods WHERE id % 5 = 0 UNION ALL SELECT id + 10000000, 5 AS k FROM foods WHERE id % 50 = 0) UNION ALL SELECT id, coalesce(name, '-'), false FROM foods WHERE id % 5 <> 0", "foods")
def upsert_by_id(spark, d):
    rows = V.foods(spark, d).select("id", F.coalesce("name", F.lit("-")).alias("name"), F.lit(False).alias("changed"))
    new = rows.where("id % 5 = 0").select("id").union(rows.where("id % 50 = 0").select(F.col("id") + 10000000))
    new = new.select("id", F.concat(F.lit("x"), (F.col("id") % 5).cast("string")).alias("name"), (F.col("id") % 5 == 0).alias("changed"))
    return L.upsert(rows, new)


@query("SELECT n.key, n.amount, f.id FROM (SELECT DISTINCT CAST(ps.s_suppkey % 900 + 1000 AS VARCHAR) AS key, ps.s_suppkey AS amount FROM supplier ps) n LEFT JOIN (SELECT barcode, min(id) AS id FROM foods WHERE NOT archived GROUP BY 1) f ON n.key = f.barcode", "foods")
def upsert_by_barcode(spark, d):
    """New records take the id of the first food with their barcode that is not archived; null: they are inserted."""
    new = V.table(spark, d, "supplier").select((F.col("s_suppkey") % 900 + 1000).cast("string").alias("key"), F.col("s_suppkey").alias("amount"))
    found = L.archived_filter(V.foods(spark, d), False).groupBy(F.col("barcode").alias("key")).agg(F.min("id").alias("id"))
    return new.join(found, "key", "left").select("key", "amount", "id")


@query("SELECT f.id, coalesce(CASE WHEN f.id % 4 = 0 THEN s_name END, name) AS name, CASE WHEN f.id % 4 = 0 AND s_name IS NOT NULL THEN 'new' ELSE brand END AS brand FROM foods f LEFT JOIN supplier ON f.id = s_suppkey", "foods")
def partial_update(spark, d):
    changes = V.table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("new").alias("brand"))
    return L.partial_update(V.foods(spark, d).select("id", "name", "brand"), changes, ["name", "brand"])


@query("SELECT id, CASE WHEN id % 9 = 0 THEN NOT archived ELSE archived END AS archived FROM foods", "foods")
def archive_toggle(spark, d):
    return V.foods(spark, d).select("id", F.when(F.col("id") % 9 == 0, ~F.col("archived")).otherwise(F.col("archived")).alias("archived"))


@query("SELECT id, name FROM foods UNION ALL SELECT id + (SELECT max(id) FROM foods), name || ' 2' FROM foods WHERE id % 100 = 0", "foods")
def clone_item(spark, d):
    rows = V.foods(spark, d).select("id", "name")
    last = rows.agg(F.max("id").alias("last"))
    copies = rows.where("id % 100 = 0").join(F.broadcast(last)).select((F.col("id") + F.col("last")).alias("id"), F.concat("name", F.lit(" 2")).alias("name"))
    return rows.union(copies)


@query("SELECT f.id, greatest(date_time, coalesce(last, date_time)) AS date_time FROM foods f LEFT JOIN (SELECT food_id, max(day) AS last FROM diary_items GROUP BY 1) u ON f.id = u.food_id", "foods diary_items")
def recency_bump(spark, d):
    used = V.diary_items(spark, d).groupBy(F.col("food_id").alias("id")).agg(F.max("day").alias("last"))
    return V.foods(spark, d).join(used, "id", "left").select("id", F.greatest("date_time", "last").alias("date_time"))


@query("SELECT id, barcode FROM foods f WHERE NOT EXISTS (SELECT 1 FROM (SELECT id, barcode FROM foods WHERE id % 97 = 0) g WHERE g.id = f.id OR (g.barcode = f.barcode AND f.barcode <> ''))", "foods")
def anti_id_or_barcode(spark, d):
    """Two anti joins, one by key each, instead of one with an OR, which could only be a nested loop."""
    rows = V.foods(spark, d).select("id", "barcode")
    stale = rows.where("id % 97 = 0")
    return rows.join(stale.select("id"), "id", "left_anti").join(stale.where("barcode <> ''").select("barcode"), "barcode", "left_anti").select("id", "barcode")


@query("SELECT f.id, coalesce(s_name, f.name) AS name, 'notes ' || CAST(f.id AS VARCHAR) AS notes, CASE WHEN f.id % 2 = 0 AND s_suppkey IS NOT NULL THEN s_acctbal ELSE f.portion END AS portion FROM foods f LEFT JOIN supplier ON f.id = s_suppkey", "foods")
def selective_merge(spark, d):
    """Refresh from a remote record: its name, its portion where asked for (even ids), the local notes always."""
    local = V.foods(spark, d).select("id", "name", "portion", F.concat(F.lit("notes "), F.col("id").cast("string")).alias("notes"))
    remote = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("remote_name"), F.col("s_acctbal").alias("remote_portion"))
    portion = F.when((F.col("id") % 2 == 0) & F.col("remote_name").isNotNull(), F.col("remote_portion")).otherwise(F.col("portion"))
    return local.join(remote, "id", "left").select("id", F.coalesce("remote_name", "name").alias("name"), "notes", portion.alias("portion"))


@query("SELECT user_id AS \"user\", CAST(ts AS DATE) AS day, -value AS calories FROM events WHERE event_type = 'click' GROUP BY ALL")
def activity_dedup(spark, d):
    """Activities as negative quick-add rows, equal ones once."""
    rows = V.table(spark, d, "events").where("event_type = 'click'")
    return rows.select(F.col("user_id").alias("user"), F.to_date("ts").alias("day"), (-F.col("value")).alias("calories")).dropDuplicates()


@query("SELECT 'part' AS source, p_partkey AS id, p_name AS name, p_retailprice AS amount FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def union_sources(spark, d):
    part = V.table(spark, d, "part").select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("amount"))
    supplier = V.table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return part.unionByName(supplier, allowMissingColumns=True)


@query("SELECT l_orderkey AS entry, l_partkey AS food_id, l_linenumber AS place, l_partkey % 3 = 0 AS exploded FROM lineitem WHERE l_partkey % 3 <> 0 UNION ALL SELECT l_orderkey, l_partkey * 10 + x.k, l_linenumber, true FROM (SELECT *, {'k': unnest([1, 2])} AS x FROM lineitem WHERE l_partkey % 3 = 0)")
def expand_selection(spark, d):
    """Meals (every third id) become their two items; foods and recipes stay one row."""
    rows = V.table(spark, d, "lineitem")
    parts = F.when(F.col("l_partkey") % 3 == 0, F.array(F.col("l_partkey") * 10 + 1, F.col("l_partkey") * 10 + 2)).otherwise(F.array("l_partkey"))
    return rows.select(F.col("l_orderkey").alias("entry"), F.explode(parts).alias("food_id"), F.col("l_linenumber").alias("place"), (F.col("l_partkey") % 3 == 0).alias("exploded"))


@query("SELECT food_id AS id, CASE nutrient WHEN 'proteins' THEN 'protein' WHEN 'carbohydrates' THEN 'carbs' ELSE nutrient END AS nutrient, value FROM nutrients WHERE nutrient <> 'kilojoules'", "nutrients")
def migrate_nutrients(spark, d):
    old = {"proteins": "protein", "carbohydrates": "carbs"}
    nutrition = L.drop_key(F.col("nutrition"), "kilojoules")
    for now, then in old.items():
        nutrition = L.rename_key(nutrition, now, then)
    return V.known_foods(spark, d).select("id", F.explode(nutrition).alias("nutrient", "value"))


@query("SELECT id, CASE WHEN name IS NULL THEN 'no name' WHEN id % 7 = 0 THEN 'no unit' ELSE 'ok' END AS status, CASE WHEN name IS NOT NULL AND id % 7 <> 0 THEN 'custom_' || CAST(id AS VARCHAR) END AS barcode FROM foods", "foods")
def import_foods_validate(spark, d):
    rows = V.foods(spark, d).withColumn("unit", F.when(F.col("id") % 7 != 0, F.col("unit")))
    status = F.when(F.col("name").isNull(), "no name").when(F.col("unit").isNull(), "no unit").when(F.col("portion").isNull(), "no portion").otherwise("ok")
    return rows.select("id", status.alias("status")).select("id", "status", F.when(F.col("status") == "ok", F.concat(F.lit("custom_"), F.col("id").cast("string"))).alias("barcode"))


@query("SELECT id, list_aggregate(xs, 'sum') AS total, len(list_filter(xs, lambda x: x > 5)) AS large, list_contains(xs, 0.5e0) AS has_half FROM (SELECT id, [fat, sugars, carbohydrates] AS xs FROM foods)", "foods")
def hof_suite(spark, d):
    n = F.col("nutrition")
    xs = V.foods(spark, d).select("id", F.array(n["fat"], n["sugars"], n["carbohydrates"]).alias("xs"))
    return xs.select("id", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.filter("xs", lambda x: x > 5)).cast("long").alias("large"), F.array_contains("xs", 0.5).alias("has_half"))


@query("SELECT DISTINCT list_position(o, x) AS place, x AS nutrient FROM (SELECT ['fat', 'calories'] || list_filter(list_sort(list(DISTINCT nutrient)), lambda y: y NOT IN ('fat', 'calories')) AS o, unnest(['fat', 'calories'] || list_filter(list_sort(list(DISTINCT nutrient)), lambda y: y NOT IN ('fat', 'calories'))) AS x FROM nutrients)", "nutrients")
def merge_order(spark, d):
    """The saved order, then the names it lacks."""
    from larder.operators.nutrition import long_nutrition

    names = long_nutrition(V.known_foods(spark, d)).agg(F.array_sort(F.collect_set("nutrient")).alias("names"))
    order = F.array_union(F.array(F.lit("fat"), F.lit("calories")), "names")
    return names.select(F.posexplode(order).alias("place", "nutrient")).select((F.col("place") + 1).alias("place"), "nutrient")


@query("SELECT id, coalesce(b, u) AS unit FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'mg' END AS b, unit AS u FROM foods)", "foods")
def merge_units(spark, d):
    """Custom units win over the defaults."""
    custom = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("fat"), F.lit("mg"))).otherwise(F.create_map().cast("map<string,string>"))
    defaults = F.map_filter(F.create_map(F.lit("fat"), F.col("unit")), lambda k, _: ~F.map_contains_key(custom, "fat"))
    return V.foods(spark, d).select("id", F.map_concat(defaults, custom)["fat"].alias("unit"))
