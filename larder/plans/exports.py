"""Queries on files and charts: exports, imports, backups, uploads, payloads, whole statistics, label columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars as S
from larder.operators import documents as D
from larder.operators import edits as E
from larder.operators import labeltables as T
from larder.operators import nutrition as N
from larder.operators import series as Z
from larder.plans.registry import query
from larder.sources import exchange as X
from larder.sources import fooddata
from larder.sources import views as V

_TEXT = "regexp_replace(regexp_replace(CAST(CAST(floor({v} * 100e0 + 0.5e0) / 100e0 AS DECIMAL(18, 2)) AS VARCHAR), '0+$', ''), '[.]$', '')"
_FIELDS = [X.CsvField("calories", "kcal"), X.CsvField("fat", "g"), X.CsvField("carbohydrates", "g"), X.CsvField("proteins", "g"), X.CsvField("purchase", "lb", "kg"), X.CsvField("view", "cm", "cm")]


@query(f"""WITH n AS (SELECT "user", day, max(CASE WHEN nutrient = 'calories' THEN total END) AS calories, max(CASE WHEN nutrient = 'fat' THEN total END) AS fat, max(CASE WHEN nutrient = 'carbohydrates' THEN total END) AS carbohydrates,
 max(CASE WHEN nutrient = 'proteins' THEN total END) AS proteins FROM day_totals GROUP BY ALL), b AS (SELECT "user", day, max(CASE WHEN stat = 'purchase' THEN value / 0.4535924e0 END) AS purchase, max(CASE WHEN stat = 'view' THEN value END) AS view FROM body_stats GROUP BY ALL)
 SELECT NULL AS "user", NULL AS day, 'Date;calories (kcal);fat (g);carbohydrates (g);proteins (g);purchase (lb);view (cm)' AS line UNION ALL
 SELECT "user", day, strftime(day, '%d/%m/%Y') || ';' || {_TEXT.format(v="coalesce(calories, 0e0)")} || ';' || coalesce({_TEXT.format(v="fat")}, '') || ';' || coalesce({_TEXT.format(v="carbohydrates")}, '') || ';' || coalesce({_TEXT.format(v="proteins")}, '')
 || ';' || coalesce({_TEXT.format(v="purchase")}, '') || ';' || coalesce({_TEXT.format(v="view")}, '') FROM n FULL JOIN b USING ("user", day) WHERE calories IS NOT NULL OR purchase IS NOT NULL""".replace("WITH n AS", "SELECT * FROM (WITH n AS") + ")", "day_totals body_stats")
def diary_csv(spark, d):
    """The diary's export: its head, and a line for each day with an item or a weight."""
    items = V.diary_items(spark, d)
    totals = N.total_nutrition(items, V.known_foods(spark, d), ["user", "day"])
    lines = X.csv_lines(totals, items, V.body_stats(spark, d), _FIELDS, weight="purchase")
    head = spark.range(1).select(F.lit(None).cast("long").alias("user"), F.lit(None).cast("date").alias("day"), F.lit(X.csv_header(_FIELDS)).alias("line"))
    return head.unionByName(lines)


@query("""SELECT * FROM (WITH b AS (SELECT "user", stat, day, CASE WHEN stat = 'purchase' THEN value / 0.4535924e0 ELSE value END AS value FROM body_stats WHERE value <> 0),
 f AS (SELECT c."user", c.stat, c.day, CAST(date_diff('day', lo, c.day) AS INTEGER) AS "index", floor(value * 100e0 + 0.5e0) / 100e0 AS value
  FROM (SELECT "user", stat, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT "user", stat, min(day) AS lo, max(day) AS hi FROM b GROUP BY ALL)) c LEFT JOIN b s ON c."user" = s."user" AND c.stat = s.stat AND c.day = s.day),
 a AS (SELECT "user", stat, floor(CAST(sum(CAST(value AS DECIMAL(24, 6))) AS DOUBLE) / count(*) * 1000e0 + 0.5e0) / 1000e0 AS average FROM b GROUP BY ALL),
 t AS (SELECT "user", stat, floor(slope * 10000e0 + 0.5e0) / 10000e0 AS slope, floor((CAST(sy AS DOUBLE) / 100e0 - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) * 10000e0 + 0.5e0) / 10000e0 AS intercept FROM
  (SELECT *, CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) / 100e0 AS slope FROM (SELECT "user", stat, count(*) AS n, sum("index") AS sx, sum(y) AS sy, sum("index" * y) AS sxy, sum("index" * "index") AS sxx FROM
  (SELECT *, CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS y FROM f WHERE value IS NOT NULL) GROUP BY ALL HAVING count(*) >= 2)))
 SELECT f.*, floor(avg(value) OVER (PARTITION BY "user", stat ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * 100e0 + 0.5e0) / 100e0 AS moving, average, slope, intercept FROM f JOIN a USING ("user", stat) LEFT JOIN t USING ("user", stat))""", "body_stats")
def statistic(spark, d):
    """All that charts of body stats show, one of them in another unit than it is stored in."""
    unit = F.when(F.col("stat") == "purchase", "lb").otherwise("kg")
    return Z.statistic(V.body_stats(spark, d), ["user", "stat"], F.lit("kg"), unit, 5)


# Label columns and measures

_COLUMNS = "SELECT p_partkey AS image_id, CAST(i AS INTEGER) AS \"column\", CASE (p_partkey + i) % 3 WHEN 0 THEN '100' WHEN 1 THEN 'serving' END AS basis, p_size * (i + 1) % 6 + 1 AS n FROM part, range(CAST(p_partkey % 5 AS BIGINT)) r(i)"


def _columns(spark, d):
    """Up to four columns of a label for each part, each with a few values."""
    k = F.col("p_partkey")
    places = F.when(k % 5 > 0, F.sequence(F.lit(0), (k % 5 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = V.table(spark, d, "part").select(k.alias("image_id"), "p_size", F.explode(places).alias("column"))
    basis = F.when((F.col("image_id") + F.col("column")) % 3 == 0, "100").when((F.col("image_id") + F.col("column")) % 3 == 1, "serving")
    keys = F.sequence(F.lit(0).cast("long"), (F.col("p_size") * (F.col("column") + 1) % 6).cast("long"))
    return rows.select("image_id", "column", basis.alias("basis"), F.explode(F.transform(keys, lambda i: F.concat(F.lit("k"), i.cast("string")))).alias("key"))


@query(f"""SELECT image_id, "column", basis, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, "column") AS o FROM (SELECT c.*, CASE WHEN bool_or(coalesce(basis = '100', false)) OVER (PARTITION BY image_id) THEN '100'
 ELSE first_value(basis) OVER (PARTITION BY image_id ORDER BY "column") END AS wanted FROM ({_COLUMNS}) c) WHERE basis IS NOT DISTINCT FROM wanted) WHERE o = 1""")
def best_column(spark, d):
    """The column that is shown first: per 100 if there is one, else the first one's basis; of those the fullest."""
    return T.best_columns(_columns(spark, d))


@query(f"""SELECT image_id, min_by(c."column", c."column") AS "column", 'serving' AS basis, min_by(n, c."column") AS n FROM ({_COLUMNS}) c WHERE basis = 'serving' GROUP BY image_id
 UNION ALL SELECT image_id, "column", basis, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, "column") AS o FROM (SELECT c.*, CASE WHEN bool_or(coalesce(basis = '100', false)) OVER (PARTITION BY image_id) THEN '100'
 ELSE first_value(basis) OVER (PARTITION BY image_id ORDER BY "column") END AS wanted, bool_or(coalesce(basis = 'serving', false)) OVER (PARTITION BY image_id) AS kept FROM ({_COLUMNS}) c) WHERE basis IS NOT DISTINCT FROM wanted AND NOT kept) WHERE o = 1""")
def kept_column(spark, d):
    """After more of a label was read, the column of the basis that was shown stays."""
    before = V.table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.lit("serving").alias("basis"))
    return T.best_columns(_columns(spark, d), before)


@query("""SELECT image_id, amount, unit FROM (SELECT p_partkey AS image_id, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5e0 END AS amount, 'ml' AS unit FROM part) WHERE amount IS NOT NULL""")
def review_serving(spark, d):
    """The serving that a user typed beside a label's values; most left it empty."""
    k = F.col("p_partkey")
    typed = V.table(spark, d, "part").select(k.alias("image_id"), F.when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",5"))).when(k % 3 == 1, F.lit("")).alias("portion"), F.lit(" ml ").alias("unit"))
    return T.reviewed_serving(typed)


@query("""SELECT id, CASE WHEN guess IS NOT NULL THEN guess.t ELSE heavy.t END AS measure, CASE WHEN guess IS NOT NULL THEN guess.g ELSE heavy.g END AS grams FROM (SELECT id, list_filter(named, lambda m: m.g = ms[-1].g)[1] AS guess,
 list_filter(ms[1:1] || named, lambda m: m.g = list_max(list_transform(ms[1:1] || named, lambda x: x.g)))[1] AS heavy FROM (SELECT id, ms, list_filter(ms, lambda m: m.t <> 'Quantity not specified') AS named FROM (SELECT p_partkey AS id,
 [{'t': '1 slice', 'g': p_size * 1e0}, {'t': CASE WHEN p_partkey % 2 = 0 THEN 'Quantity not specified' ELSE 'cup' END, 'g': p_partkey % 30 * 1e0}, {'t': CASE WHEN p_partkey % 3 = 0 THEN 'bowl' ELSE 'Quantity not specified' END, 'g': CASE WHEN p_partkey % 5 = 0 THEN p_size * 1e0 ELSE p_partkey % 7 * 10e0 END}] AS ms FROM part)))""")
def argmax_portion(spark, d):
    """The measure that a food is served in, of three."""
    k, size = F.col("p_partkey"), F.col("p_size")
    measure = lambda text, grams: F.struct(text.alias("disseminationText"), grams.cast("double").alias("gramWeight"))
    none = F.lit(fooddata.UNSPECIFIED)
    measures = F.array(measure(F.lit("1 slice"), size), measure(F.when(k % 2 == 0, none).otherwise(F.lit("cup")), k % 30), measure(F.when(k % 3 == 0, "bowl").otherwise(none), F.when(k % 5 == 0, size).otherwise(k % 7 * 10)))
    return V.table(spark, d, "part").select(k.alias("id"), fooddata.measured(measures).alias("m")).select("id", F.col("m.disseminationText").alias("measure"), F.col("m.gramWeight").alias("grams"))


@query("""SELECT e AS entry, CAST(i - 1 AS INTEGER) AS place, xs[i] AS id FROM (SELECT e, CASE WHEN a < len(xs) AND b < len(xs) THEN rest[1 : b] || [xs[a + 1]] || rest[b + 1 :] ELSE xs END AS xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT e, xs, a, b, xs[1 : a] || xs[a + 2 :] AS rest FROM
 (SELECT l_orderkey AS e, l_orderkey % 4 AS a, l_orderkey % 5 AS b, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS xs FROM lineitem GROUP BY 1)))""")
def move_item(spark, d):
    """In every entry one item is dragged to another place, if both are there."""
    placed = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    entries = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entry")).agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["l_partkey"]).alias("items"))
    moved = D.moved(F.col("items"), (F.col("entry") % 4).cast("int"), (F.col("entry") % 5).cast("int"))
    return entries.select("entry", F.posexplode(moved).alias("place", "id"))


# Plain energy


@query("""SELECT day, n.k AS nutrient, CAST(sum(CAST(n.v AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM (SELECT day, unnest([{'k': 'calories', 'v': floor(q * 100e0 + 0.5e0) / 100e0}, {'k': 'kilojoules', 'v': floor(1e0 / 0.23900573614e0 * q * 100e0 + 0.5e0) / 100e0}]) AS n
 FROM (SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'click' THEN -value WHEN 'purchase' THEN value * 0.23900573614e0 ELSE value END AS q FROM events)) GROUP BY ALL""")
def quick_add_energy(spark, d):
    """Plain energy as items of the reserved food: eaten in kcal or kJ, or burned."""
    foods, quick = E.with_quick_add(V.foods(spark, d))
    kind = F.col("event_type")
    rows = V.table(spark, d, "events").select(F.to_date("ts").alias("day"), F.when(kind == "click", -F.col("value")).otherwise(F.col("value")).alias("energy"), F.when(kind == "purchase", "kJ").otherwise("kcal").alias("unit"))
    return N.total_nutrition(E.quick_added(rows, quick, F.col("energy"), F.col("unit")), foods.where(F.col("id") == quick), ["day"])


# Uploads, imports, backups, payloads

_NUMBER = "regexp_replace(CAST({v} AS VARCHAR), '[.]0$', '')"
_URI = "replace(replace({v}, ' ', '%20'), '#', '%23')"


@query(f"""SELECT id, 'code=' || barcode || '&user_id=me%40x&password=a%2Fb!&lang=en&product_name_en=' || {_URI.format(v="name")} || '&brands=' || {_URI.format(v="brand")} || '&nutrition_data_per=100g' || CASE WHEN id % 2 = 0 THEN '&serving_size=30%20ml' ELSE '' END
 || CASE WHEN kilojoules IS NOT NULL THEN '&nutriment_energy=' || {_NUMBER.format(v="kilojoules")} || '&nutriment_energy_unit=kJ&nutriment_energy-kcal=' || {_NUMBER.format(v="calories")} ELSE '&nutriment_energy=' || {_NUMBER.format(v="calories")} || '&nutriment_energy_unit=kcal' END
 || '&nutriment_fat=' || {_NUMBER.format(v="fat")} || '&nutriment_fat_unit=g&nutriment_saturated-fat=' || {_NUMBER.format(v="saturated_fat")} || '&nutriment_saturated-fat_unit=g&nutriment_carbohydrates=' || {_NUMBER.format(v="carbohydrates")} || '&nutriment_carbohydrates_unit=g&nutriment_sugars='
 || {_NUMBER.format(v="sugars")} || '&nutriment_sugars_unit=g&nutriment_proteins=' || {_NUMBER.format(v="proteins")} || '&nutriment_proteins_unit=g&nutriment_vitamin-d=5&nutriment_vitamin-d_unit=%C2%B5g' AS upload FROM foods WHERE name IS NOT NULL AND barcode <> ''""", "foods")
def upload_string(spark, d):
    """What is sent to add a food to the open database; nutrients that it does not know are left out."""
    rows = V.foods(spark, d).where("name IS NOT NULL AND barcode <> ''")
    more = F.map_concat("nutrition", F.create_map(F.lit("my-own"), F.lit(1.0), F.lit("vitamin-d"), F.lit(5.0)))
    rows = rows.withColumns({"nutrition": more, "portion": F.when(F.col("id") % 2 == 0, 30.0).otherwise(100.0), "unit": F.when(F.col("id") % 2 == 0, "ml").otherwise("g")})
    return rows.select("id", X.product_upload("me@x", "a/b!").alias("upload"))


def _grouped_json(rows, item, **more):
    """A JSON text for each brand's parts."""
    entries = rows.groupBy("p_brand").agg(F.collect_list(item).alias("foodList"))
    return entries.select(F.to_json(F.struct(*[v.alias(k) for k, v in more.items()], "foodList")).alias("json"))


@query("""SELECT CASE WHEN p_partkey % 10 = 0 AND p_partkey % 17 <> 0 THEN p_partkey END AS id, 'custom_' || CAST(p_partkey AS VARCHAR) AS barcode, p_name AS name, p_size * 1e0 AS portion, CASE WHEN p_partkey % 10 = 0 AND p_partkey % 17 <> 0 THEN p_partkey % 23 = 0 ELSE true END AS hidden, p_size / 2e0 AS fat
 FROM part WHERE p_partkey % 7 <> 0 AND p_brand <> 'Brand#11'""")
def import_foods(spark, d):
    """Import files, one for each brand, one of another version; foods without unit are left out, known barcodes keep their id and visibility."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    item = F.struct(F.col("p_name").alias("name"), k.cast("string").alias("uniqueId"), F.concat(size, F.lit("g")).alias("portion"), F.when(k % 7 != 0, "g").alias("unit"), F.create_map(F.lit("fat"), (F.col("p_size") / 2).cast("string"), F.lit("salt"), F.lit("-")).alias("nutrition"))
    texts = _grouped_json(V.table(spark, d, "part"), item, version=F.when(F.col("p_brand") == "Brand#11", 2).otherwise(1))
    foods = V.foods(spark, d).withColumn("barcode", F.when(F.col("id") % 10 == 0, F.concat(F.lit("custom_"), F.col("id").cast("string"))).otherwise(F.col("barcode")))
    found = E.imported(foods, X.food_lists(texts), F.lit("2024-05-01").cast("date"))
    return found.select("id", "barcode", "name", "portion", "hidden", F.try_element_at("nutrition", F.lit("fat")).alias("fat"))


@query("""SELECT CASE WHEN p_brand = 'Brand#11' THEN 24 WHEN p_brand = 'Brand#12' THEN 27 ELSE 33 END AS layout, p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN 'b' || CAST(p_partkey AS VARCHAR) END AS barcode, DATE '2024-01-01' + CAST(p_partkey % 90 AS INTEGER) AS day FROM part
 UNION ALL SELECT NULL, (SELECT max(p_partkey) + 1 FROM part), 'quick-add', NULL""")
def restore_backup(spark, d):
    """Backups of three layouts; empty barcodes are none, and the food for plain energy is added."""
    k = F.col("p_partkey")
    at = F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")), "yyyy-MM-dd"), F.lit("T13:14:15.678Z"))
    item = F.struct(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("b"), k.cast("string"))).alias("barcode"), F.col("p_name").alias("name"), at.alias("dateTime"))
    brand = F.col("p_brand")
    texts = _grouped_json(V.table(spark, d, "part"), item, version=F.when(~brand.isin("Brand#11", "Brand#12"), 33), _version=F.when(brand == "Brand#12", 1))
    rows = X.backup_store(texts, "foodList", "id bigint, barcode string, name string, dateTime timestamp, portion double, nutrition map<string,double>, archived boolean")
    return E.with_quick_add(rows)[0].select("layout", "id", "barcode", F.to_date("dateTime").alias("day"))


_LONG = "CAST(CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS BIGINT) AS VARCHAR)"


@query(f"""SELECT * FROM (WITH n AS (SELECT "user", day, string_agg('{{"nutrient":"' || nutrient || '","total":' || total || '}}', ',' ORDER BY nutrient) AS nutrition FROM (SELECT "user", day, nutrient, {_LONG} AS total FROM summed WHERE amount >= 0 GROUP BY ALL) GROUP BY ALL),
 i AS (SELECT "user", day, string_agg('{{"category":' || category || ',"id":' || food_id || '}}', ',' ORDER BY category, food_id) AS items FROM diary_items GROUP BY ALL),
 e AS (SELECT "user", day, string_agg('{{"category":' || category || ',"id":' || food_id || ',"name":"' || name || '","calories":' || kcal || '}}', ',' ORDER BY category, food_id, name, CAST(kcal AS BIGINT)) AS details FROM (SELECT "user", day, category, food_id, coalesce(k.name, '') AS name, CAST(CAST(CAST(amount AS DECIMAL(18, 2)) AS BIGINT) AS VARCHAR) AS kcal
  FROM amounts JOIN known_foods k ON food_id = k.id WHERE nutrient = 'calories') GROUP BY ALL)
 SELECT n."user", n.day, '{{"nutrition":[' || nutrition || '],"entryDetails":[' || coalesce(details, '') || '],"entry":{{"user":' || CAST(n."user" AS VARCHAR) || ',"items":[' || items || ']}}}}' AS payload FROM n JOIN i USING ("user", day) LEFT JOIN e USING ("user", day))""", "summed diary_items amounts known_foods")
def statistics_payload(spark, d):
    """What is sent of each user's day as JSON: whole totals, the items as their foods resolve them, and the entry."""
    items, foods = V.diary_items(spark, d), V.known_foods(spark, d)
    whole = lambda c: F.round(F.col(c).cast("decimal(18,2)"), 0).cast("long")
    totals = N.total_nutrition(items, foods, ["user", "day"], "ignore")
    nutrition = totals.groupBy("user", "day").agg(F.array_sort(F.collect_list(F.struct("nutrient", whole("total").alias("total")))).alias("nutrition"))
    resolved = N.item_nutrients(items, foods, derive_kj=False).where("nutrient = 'calories'").join(foods.select(F.col("id").alias("food_id"), F.coalesce("name", F.lit("")).alias("name")), "food_id")
    details = resolved.groupBy("user", "day").agg(F.array_sort(F.collect_list(F.struct("category", F.col("food_id").alias("id"), "name", whole("amount").alias("calories")))).alias("entryDetails"))
    entries = items.groupBy("user", "day").agg(F.array_sort(F.collect_list(F.struct("category", F.col("food_id").alias("id")))).alias("items"))
    days = nutrition.join(entries, ["user", "day"]).join(details, ["user", "day"], "left")
    none = F.array().cast(days.schema["entryDetails"].dataType)
    return days.select("user", "day", F.to_json(F.struct("nutrition", F.coalesce("entryDetails", none).alias("entryDetails"), F.struct("user", "items").alias("entry"))).alias("payload"))


@query("""SELECT 'version' AS store, '34' AS json UNION ALL SELECT 'foodList', '{"id":' || id || CASE WHEN name IS NOT NULL THEN ',"name":"' || name || '"' ELSE '' END || ',"barcode":"' || barcode || '"}' FROM foods
 UNION ALL SELECT 'diary', '{"id":' || entry || ',"dateTime":"' || strftime(day, '%Y-%m-%d') || '","items":' || n || '}' FROM diary JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON entry = l_orderkey""", "foods diary")
def export_backup(spark, d):
    """All stores as the lines of a backup."""
    counts = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entry")).agg(F.count("*").alias("items"))
    diary = V.diary(spark, d).join(counts, "entry").select(F.col("entry").alias("id"), S.iso_date(F.col("day")).alias("dateTime"), "items")
    return X.backup_lines({"foodList": V.foods(spark, d).select("id", "name", "barcode"), "diary": diary}, 34)


@query("""SELECT "user", day, '{"id":"' || strftime(day, '%Y-%m-%d') || '","kcalConsumed":' || CAST(total AS VARCHAR) || '}' AS payload FROM (SELECT "user", day, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM summed WHERE nutrient = 'calories' AND amount >= 0 GROUP BY ALL) WHERE total > 0""", "summed")
def energy_push(spark, d):
    """What a training service is told of each day with energy."""
    totals = N.total_nutrition(V.diary_items(spark, d), V.known_foods(spark, d), ["user", "day"], "ignore").where("nutrient = 'calories'")
    return X.activity_payload(totals.withColumnRenamed("total", "calories"))
