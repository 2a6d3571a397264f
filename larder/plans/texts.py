"""Queries on semi-structured data: food databases' JSON and nutrition labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import scalars as S
from larder.operators import labels as B
from larder.operators import labeltables as T
from larder.operators.series import gap_clusters
from larder.plans.registry import query
from larder.sources import fooddata
from larder.sources import views as V


def _products(spark, d) -> DataFrame:
    """Each part as a product's JSON, in six kinds: per 100 only, a serving with kJ only, a fraction of a cup with kcal, a quantity only, a prepared one with alcohol, and one without any amount."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    kinds = [
        {"energy_100g": size * 40, "energy-kcal_100g": size * 10, "fat_100g": size, "sodium_100g": size / 8, "vitamin-d_100g": F.lit(0.25)},
        {"energy_serving": size * 10, "fat_serving": size / 4, "fat_100g": size},
        {"energy_serving": size * 4, "energy-kcal_serving": size + 0.75, "energy_100g": size * 8},
        {"energy": size * 4, "fat": size},
        {"energy_prepared_serving": size * 2, "fat_prepared_serving": size, "fat_serving": size * 9, "alcohol_prepared_serving": F.lit(40.0)},
        {"fat": size},
    ]
    per = lambda values: F.element_at(F.array(*values), (k % 6 + 1).cast("int"))
    null = F.lit(None).cast("string")
    nutriments = per([F.create_map(*[x for key, v in kind.items() for x in (F.lit(key), v.cast("string"))]) for kind in kinds])
    product = F.struct(
        F.concat(F.lit("0"), k.cast("string")).alias("code"), F.when(k % 7 == 1, F.concat(F.lit("caf&eacute; &amp;lt; "), "p_name")).alias("product_name_en"),
        F.when(k % 7 > 1, F.col("p_name")).alias("product_name_de"), F.concat("p_brand", F.lit("&#39;s,x")).alias("brands"), per([F.lit("500 ml"), F.lit("9"), null, F.lit("330 ml"), null, F.lit("")]).alias("quantity"),
        per([F.lit("(2 cl)"), F.lit("25 g (1 piece)"), F.lit("1/2 Cup"), null, F.lit("2,5 CL"), null]).alias("serving_size"), nutriments.alias("nutriments"),
    )
    return V.table(spark, d, "part").select(F.to_json(product).alias("json"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS barcode, '0' || CAST(p_partkey AS VARCHAR) AS original_barcode, CASE p_partkey % 7 WHEN 0 THEN '0' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'café &lt; ' || p_name ELSE p_name END AS name,
 p_brand || chr(39) || 's' AS brand, CASE p_partkey % 6 WHEN 0 THEN 100e0 WHEN 1 THEN 25e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 330e0 ELSE 2.5e0 END AS portion,
 CASE p_partkey % 6 WHEN 0 THEN 'ml' WHEN 1 THEN 'g' WHEN 2 THEN 'Cup' WHEN 3 THEN 'ml' ELSE 'cl' END AS unit, x.n AS nutrient, x.v AS value FROM (SELECT *, unnest(CASE p_partkey % 6
 WHEN 0 THEN [{'n': 'calories', 'v': p_size * 10e0}, {'n': 'kilojoules', 'v': p_size * 40e0}, {'n': 'fat', 'v': p_size * 1e0}, {'n': 'sodium', 'v': p_size / 8e0 / 0.001e0}, {'n': 'vitamin-d', 'v': 0.25e0 / 0.000001e0}]
 WHEN 1 THEN [{'n': 'calories', 'v': floor(p_size * 10e0 * 0.23900573614e0 + 0.5e0)}, {'n': 'kilojoules', 'v': p_size * 10e0}, {'n': 'fat', 'v': p_size / 4e0}]
 WHEN 2 THEN [{'n': 'calories', 'v': p_size * 1e0}, {'n': 'kilojoules', 'v': p_size * 4e0}] WHEN 3 THEN [{'n': 'calories', 'v': p_size * 4e0}, {'n': 'kilojoules', 'v': p_size * 4e0}]
 WHEN 4 THEN [{'n': 'calories', 'v': floor(p_size * 2e0 * 0.23900573614e0 + 0.5e0)}, {'n': 'kilojoules', 'v': p_size * 2e0}, {'n': 'fat', 'v': p_size * 1e0}, {'n': 'alcohol', 'v': 2.5e0 / 0.1e0 * 40e0 / 100e0 * 0.7893e0}] END) AS x FROM part)""")
def off_normalise(spark, d):
    return fooddata.products(_products(spark, d))


def _usda(spark, d) -> DataFrame:
    """Each part as a food's JSON, in six kinds: a serving in g, a described measure of the last's weight, the largest measure, none, a serving in ml, and energy in kJ only."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    entry = lambda name, unit, value: F.struct(F.lit(name).alias("nutrientName"), F.lit(unit).alias("unitName"), value.cast("double").alias("value"))
    nutrients = F.array(
        entry("Energy", "kJ", size * 40), entry("Energy (Atwater)", "KCAL", size * 10 + 0.25), entry("Energy", "KCAL", size * 11), entry("Protein", "G", size / 2), entry("Protein, other", "G", size * 3),
        entry("Carbohydrate, by difference", "G", size), entry("Fiber, total dietary", "G", size / 4), entry("Total Sugars", "G", size * 0.8), entry("Sodium, Na", "MG", size * 100),
        entry("Vitamin B-12", "UG", size * 3), entry("Vitamin A, RAE", "MG", size), entry("Vitamin D (D2 + D3)", "IU", size), entry("Zinc, Zn", "G", size / 1000),
    )
    nutrients = F.filter(nutrients, lambda n: ~((k % 6 == 5) & (F.lower(n["unitName"]) == "kcal")))
    measure = lambda text, grams: F.struct(F.lit(text).alias("disseminationText"), F.lit(float(grams)).alias("gramWeight"))
    half, bowl = F.array(measure("1 slice", 20), measure(fooddata.UNSPECIFIED, 200), measure("1/2 large-sized cup", 200)), F.array(measure("slice", 20), measure("bowl", 300), measure(fooddata.UNSPECIFIED, 250))
    food = F.struct(
        k.alias("fdcId"), F.col("p_name").alias("description"), F.col("p_brand").alias("brandOwner"), F.when(k % 6 == 0, 50.0).when(k % 6 == 1, 3.0).when(k % 6 == 4, 30.0).alias("servingSize"),
        F.when(k % 6 == 0, "g").when(k % 6 == 1, "cup").when(k % 6 == 4, "ml").alias("servingSizeUnit"), F.when(k % 6 < 2, half).when(k % 6 == 2, bowl).alias("foodMeasures"), nutrients.alias("foodNutrients"),
    )
    return V.table(spark, d, "part").select(F.to_json(food).alias("json"))


@query("""SELECT 'fdcId_' || CAST(p_partkey AS VARCHAR) AS barcode, p_name AS name, p_brand AS brand, portion, unit, x.n AS nutrient, x.v AS value FROM (SELECT *, unnest([{'n': 'calories', 'v': kcal}, {'n': 'kilojoules', 'v': floor(kcal / 0.23900573614e0 + 0.5e0)},
 {'n': 'proteins', 'v': floor(p_size / 2e0 * t * 100e0 + 0.5e0) / 100e0}, {'n': 'carbohydrates', 'v': greatest(floor(p_size * t * 100e0 + 0.5e0) / 100e0 - floor(p_size / 4e0 * t * 100e0 + 0.5e0) / 100e0, floor(p_size * 0.8e0 * t * 100e0 + 0.5e0) / 100e0)},
 {'n': 'fiber', 'v': floor(p_size / 4e0 * t * 100e0 + 0.5e0) / 100e0}, {'n': 'sugars', 'v': floor(p_size * 0.8e0 * t * 100e0 + 0.5e0) / 100e0}, {'n': 'sodium', 'v': floor(p_size * 100e0 * t * 100e0 + 0.5e0) / 100e0},
 {'n': 'salt', 'v': floor(p_size * 100e0 * t * 100e0 + 0.5e0) / 100e0 * 0.0025e0}, {'n': 'vitamin-b12', 'v': floor(p_size * 3e0 * t * 100e0 + 0.5e0) / 100e0}, {'n': 'vitamin-a', 'v': floor(p_size / 0.001e0 * t * 100e0 + 0.5e0) / 100e0},
 {'n': 'zinc', 'v': floor(p_size / 1000e0 / 0.001e0 * t * 100e0 + 0.5e0) / 100e0}]) AS x FROM (SELECT *, floor((p_size * 10e0 + 0.25e0) * t + 0.5e0) AS kcal FROM (SELECT *,
 CASE p_partkey % 6 WHEN 0 THEN 50e0 WHEN 1 THEN 0.5e0 WHEN 2 THEN 300e0 WHEN 3 THEN 100e0 ELSE 30e0 END AS portion, CASE p_partkey % 6 WHEN 0 THEN 0.5e0 WHEN 1 THEN 2e0 WHEN 2 THEN 3e0 WHEN 3 THEN 1e0 ELSE 0.3e0 END AS t,
 CASE p_partkey % 6 WHEN 1 THEN 'large-sized cup (' || chr(8206) || '200' || chr(8201) || 'g)' WHEN 4 THEN 'ml' ELSE 'g' END AS unit FROM part WHERE p_partkey % 6 <> 5)))""")
def usda_normalise(spark, d):
    return fooddata.usda_foods(_usda(spark, d))


@query("SELECT p_partkey AS id, floor(p_size / 0.23900573614e0 * 1000e0 + 0.5e0) / 1000e0 AS kj, floor(p_size / 10e0 * 2.5e0 * 1000e0 + 0.5e0) / 1000e0 AS salt FROM part")
def label_values(spark, d):
    """A label's values in the app's units: kJ from kcal, salt from sodium, three decimals."""
    size = F.col("p_size").cast("double")
    salt, _ = S.salt_and_sodium(F.lit(None).cast("double"), size / 10)
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.half_up(S.kcal_to_kj(size), 3).alias("kj"), S.half_up(salt, 3).alias("salt"))


def _labels(spark, d) -> DataFrame:
    names = F.array(*map(F.lit, ("fat", "proteine", "sugers", "total carbohydrat", "xyz")))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("text"))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'fat' WHEN 1 THEN 'proteins' WHEN 2 THEN 'sugars' WHEN 3 THEN 'carbohydrates' END AS key, floor((CASE p_partkey % 5 WHEN 0 THEN 1.003e0 WHEN 1 THEN 1.008e0 WHEN 2 THEN 1 - levenshtein('sugers', 'sugars') / 6e0 + 0.006e0 ELSE 1 - levenshtein('total carbohydrat', 'total carbohydrate') / 18e0 + 0.018e0 END) * 10000e0 + 0.5e0) / 10000e0 AS likeness FROM part WHERE p_partkey % 5 <> 4")
def synonym_match(spark, d):
    return B.synonym_match(_labels(spark, d))


@query("SELECT doc_id, x AS number FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'))) AS x FROM documents)")
def tokenise_numbers(spark, d):
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))
    return V.table(spark, d, "documents").select("doc_id", F.explode(numbers).alias("number"))


@query("SELECT \"user\", event_id, sum(starts) OVER (PARTITION BY \"user\" ORDER BY place RANGE UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY \"user\" ORDER BY place) > 20000 THEN 1 ELSE 0 END AS starts FROM (SELECT user_id AS \"user\", event_id, epoch(ts) AS place FROM events))")
def gap_cluster(spark, d):
    place = (F.col("ts").cast("timestamp").cast("double")).alias("place")
    rows = V.table(spark, d, "events").select(F.col("user_id").alias("user"), "event_id", place)
    return gap_clusters(rows, ["user"], "place", 20000).select("user", "event_id", "cluster")


@query("SELECT p_partkey AS id, CASE WHEN p_size = 100 OR p_partkey % 2 = 0 THEN '100' ELSE 'serving' END AS basis, CASE WHEN p_partkey % 2 = 0 THEN 100e0 ELSE p_size + 0.5e0 END AS amount, CASE WHEN p_partkey % 2 = 0 THEN 'ml' ELSE 'g' END AS unit FROM part")
def parse_header(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.lit("per 100 ML")).otherwise(F.concat(F.lit("Per serving ("), F.col("p_size").cast("string"), F.lit(",5 g)")))
    basis, amount, unit = B.header(text)
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), basis.alias("basis"), amount.alias("amount"), unit.alias("unit"))


@query("SELECT p_partkey AS id, p_size * 10e0 AS kcal FROM part")
def energy_repair_kcal(spark, d):
    """Every third kcal was read with a table line as a leading 1; the kJ tell."""
    kcal = F.col("p_size").cast("double") * 10
    read = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("1"), kcal.cast("long").cast("string")).cast("double")).otherwise(kcal)
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), B.repaired_kcal(F.floor(kcal / S.KCAL_PER_KJ + F.lit(0.5)).cast("double"), read).alias("kcal"))


@query("SELECT p_partkey AS id, floor(p_size * 10 / 0.23900573614e0 + 0.5e0) AS kj FROM part")
def energy_repair(spark, d):
    """Every third kJ was read with a table line as a leading 1; the kcal tell."""
    kcal = F.col("p_size").cast("double") * 10
    kj = F.floor(kcal / S.KCAL_PER_KJ + F.lit(0.5)).cast("double")
    read = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("1"), kj.cast("long").cast("string")).cast("double")).otherwise(kj)
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), B.repaired_energy(read, kcal).alias("kj"))


@query("""SELECT id, x.value AS value, x.unit AS unit FROM (SELECT p_partkey AS id, unnest(CASE p_partkey % 10
 WHEN 0 THEN [{'value': p_size::DOUBLE, 'unit': 'g'}] WHEN 1 THEN [{'value': 3e0, 'unit': 'µg'}] WHEN 2 THEN [{'value': 12345e0, 'unit': 'mg'}]
 WHEN 3 THEN [{'value': p_size * 1000 + 190e0, 'unit': 'kj'}] WHEN 4 THEN [{'value': 0.5e0, 'unit': 'g'}] WHEN 5 THEN [{'value': 0.2e0, 'unit': 'g'}, {'value': p_size::DOUBLE, 'unit': '%'}]
 WHEN 6 THEN [{'value': 7e0, 'unit': 'g'}] WHEN 7 THEN [{'value': 2.5e0, 'unit': 'µg'}] WHEN 8 THEN [{'value': 0e0, 'unit': 'g'}] END) AS x FROM part)""")
def label_numbers(spark, d):
    """Lines as they are read from labels: names with letters that look like digits, lost marks, grouped thousands."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    lines = ["Oil {} g", "Vitamin B12 3 µg", "12345 mg", "{},190 kJ", "O,5 g", "02g ({} %)", "Omega-3 7 g", "2.5 ug soil", "og", "Sol"]
    text = F.replace(F.element_at(F.array(*map(F.lit, lines)), (k % 10 + 1).cast("int")), F.lit("{}"), size)
    return V.table(spark, d, "part").select(k.alias("id"), F.inline(B.label_numbers(text)))


@query("SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'trans-fat' WHEN 1 THEN 'saturated-fat' WHEN 2 THEN 'saturated-fat' WHEN 3 THEN 'fat' WHEN 4 THEN 'sugars' WHEN 5 THEN 'vitamin-b12' WHEN 6 THEN 'carbohydrates' WHEN 8 THEN 'carbohydrates' WHEN 9 THEN 'fiber' END AS key FROM part")
def label_key(spark, d):
    """The nutrient that a line names, whatever numbers are on it."""
    lines = ["Trans fat 0 g", "Acidi grassi saturi", "davon gesättigte Fettsäuren", "Matières grasses 3,5g", "dont sucres", "Vitamin B12 3 µg", "Total Carbohydrat", "12 %", "qq Kohlenhydrata ww zz", "aa b Dietery Fibre ccc d"]
    text = F.element_at(F.array(*map(F.lit, lines)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), B.label_key(text).alias("key"))


def _photo(spark, d, texts: list[tuple[str, float, float]], turn: float = 0.02) -> DataFrame:
    """A label for each part on a slightly turned photo; in a text {} is the part's size, {4} a quarter and {1} one with a mark lost."""
    size = F.col("p_size")
    quarter = (size / 4).cast("decimal(9,2)").cast("string")
    spelled = {"{}": size.cast("string"), "{4}": quarter, "{1}": F.replace(quarter, F.lit("."), F.lit(""))}

    def line(text: str, x: float, y: float):
        value = F.lit(text)
        for mark, number in spelled.items():
            value = F.replace(value, F.lit(mark), number) if mark in text else value
        return F.struct(value.alias("text"), F.lit(float(x)).alias("cx"), F.lit(float(y)).alias("cy"), F.lit(10.0 * len(text)).alias("w"))

    parts = V.table(spark, d, "part")
    tasks = max(4 * spark.sparkContext.defaultParallelism, len(texts) * parts.rdd.getNumPartitions())  # few bytes, but a row becomes many lines
    rows = parts.repartition(tasks, "p_partkey").select(F.col("p_partkey").alias("image_id"), F.inline(F.array(*[line(*t) for t in texts])))
    return rows.select("image_id", "text", (F.col("cx") - F.col("cy") * turn).alias("cx"), (F.col("cy") + F.col("cx") * turn).alias("cy"), "w", F.lit(20.0).alias("h"), F.lit(turn).alias("angle"))


@query("""SELECT p_partkey AS image_id, CAST(0 AS INTEGER) AS "column", '100' AS basis, 100e0 AS amount, x.k AS key, x.v AS value, x.u AS unit FROM (SELECT *, unnest([
 {'k': 'calories', 'v': p_size * 10e0, 'u': 'kcal'}, {'k': 'fat', 'v': p_size + 0.5e0, 'u': 'g'}, {'k': 'sugars', 'v': CAST('0.' || p_size AS DOUBLE), 'u': 'g'}, {'k': 'proteins', 'v': p_size * 1e0, 'u': 'g'}]) AS x FROM part)""")
def parse_label(spark, d):
    """Whole labels, a few lines for each part."""
    texts = [("per 100 g", 300, 0), ("Energy", 40, 30), ("{}0 kcal", 300, 31), ("Fat", 30, 60), ("{},5 g", 300, 61), ("of which sugars", 70, 90), ("0{} g", 300, 91), ("Protein", 40, 120), ("{} g", 300, 120)]
    return T.parse_labels(_photo(spark, d, texts))


#: Two columns; carbohydrates' name is not readable, saturated fat's takes two lines, salt's is cut off, a stray number stands below.
_TABLE = [
    ("per 100 g", 300, 0), ("per serving 25 g", 500, 0), ("Energy", 40, 30), ("{}.00 kcal", 300, 31), ("{4} kcal", 500, 31), ("Oil / Fat", 55, 60), ("{}.00 g", 300, 61), ("{1} g", 500, 61), ("Saturated fatty", 85, 80), ("acids", 45, 100), ("{}.40 g", 300, 90), ("{4} g", 500, 90),
    ("#~#", 30, 120), ("{}.00 g", 300, 121), ("{4} g", 500, 121), ("of which sugars", 85, 150), ("{}.00 g", 300, 151), ("{4} g", 500, 151), ("Protein", 45, 180), ("{}.00 g", 300, 181), ("{4} g", 500, 181), ("{}.00 g", 300, 211), ("{4} g", 500, 211), ("77", 900, -200),
]


@query("""SELECT p_partkey AS image_id, x.c AS "column", x.b AS basis, x.a AS amount, y.k AS key, y.v AS value FROM (SELECT *, unnest([{'c': CAST(0 AS INTEGER), 'b': '100', 'a': 100e0, 'q': 1e0}, {'c': CAST(1 AS INTEGER), 'b': 'serving', 'a': 25e0, 'q': 4e0}]) AS x FROM part),
 LATERAL (SELECT unnest([{'k': 'calories', 'v': p_size / x.q}, {'k': 'fat', 'v': CASE WHEN x.c = 0 OR p_size <> 4 THEN p_size / x.q END}, {'k': 'saturated-fat', 'v': CASE WHEN x.c = 0 THEN p_size + 0.4e0 ELSE p_size / 4e0 END}, {'k': 'carbohydrates', 'v': p_size / x.q}, {'k': 'sugars', 'v': p_size / x.q}, {'k': 'proteins', 'v': p_size / x.q}, {'k': 'salt', 'v': p_size / x.q}]) AS y) WHERE y.v IS NOT NULL""")
def label_table(spark, d):
    """Labels with two columns, a wrapped name, two unreadable ones and a lost decimal mark in one column ("100 g" for 1.00 g reads as a head)."""
    return T.parse_labels(_photo(spark, d, _TABLE)).drop("unit")


@query("""SELECT p_partkey AS image_id, CASE WHEN x.k IN ('fat', 'sugars') THEN 0 ELSE 1 END AS panel, x.k AS key, x.v AS value FROM (SELECT *, unnest([{'k': 'fat', 'v': p_size + 0.5e0}, {'k': 'sugars', 'v': p_size * 1e0}, {'k': 'proteins', 'v': p_size / 4e0}, {'k': 'salt', 'v': 3e0}]) AS x FROM part)""")
def label_panels(spark, d):
    """Two tables side by side are two panels."""
    texts = [("per 100 g", 250, 0), ("per 100 g", 850, 0), ("Fat", 40, 30), ("{}.5 g", 250, 30), ("Sugars", 55, 60), ("{} g", 250, 60), ("Protein", 640, 30), ("{4} g", 850, 30), ("Salt", 625, 60), ("3 g", 850, 60)]
    rows = T.panels(T.grouped_lines(_photo(spark, d, texts, 0.0))).select("image_id", "panel", F.explode(F.arrays_zip("keys", "rows")).alias("r"))
    return rows.select("image_id", "panel", F.col("r.keys").alias("key"), F.explode("r.rows.items").alias("t")).select("image_id", "panel", "key", "t.value")


@query("SELECT p_partkey AS image_id, 15e0 AS x0, -10e0 AS y0, 345e0 AS x1, 70e0 AS y1 FROM part")
def label_bounds(spark, d):
    """The box around a table; words elsewhere on the photo are no part of it."""
    texts = [("per 100 g", 300, 0), ("Fat", 30, 30), ("9.50 g", 300, 30), ("Sugars", 45, 60), ("1.50 g", 300, 60), ("Best before", 300, 500)]
    return T.table_bounds(_photo(spark, d, texts, 0.0))


@query("SELECT p_partkey AS id, (p_size + 4) / 4e0 AS value FROM part")
def decimal_repair(spark, d):
    """A serving's value lost its mark; the one of 100 still has its own."""
    size = F.col("p_size").cast("double") + 4
    digits = F.replace((size / 4).cast("decimal(9,2)").cast("string"), F.lit("."), F.lit(""))
    value = T.repaired_decimal(digits.cast("double"), digits, size / 4, F.concat(size.cast("long").cast("string"), F.lit(".0")))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), value.alias("value"))


@query("SELECT p_partkey AS id, CAST(x.p AS INTEGER) AS place, x.k AS key FROM (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [{'p': 0, 'k': 'fat'}, {'p': 1, 'k': 'saturated-fat'}, {'p': 2, 'k': 'carbohydrates'}, {'p': 3, 'k': 'sugars'}] WHEN 1 THEN [{'p': 0, 'k': 'fiber'}, {'p': 1, 'k': 'proteins'}, {'p': 2, 'k': 'salt'}] ELSE [{'p': 0, 'k': 'sugars'}, {'p': 1, 'k': 'fiber'}, {'p': 2, 'k': NULL}, {'p': 3, 'k': 'proteins'}] END) AS x FROM part)")
def infer_rows(spark, d):
    """Rows of values whose names could not be read, told by their neighbours."""
    null = F.lit(None).cast("string")
    read = F.when(F.col("p_partkey") % 3 == 0, F.array(null, F.lit("saturated-fat"), null, F.lit("sugars"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("fiber"), F.lit("proteins"), null)).otherwise(F.array(F.lit("sugars"), null, null, F.lit("proteins")))
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), read.alias("read"))
    return rows.select("id", F.posexplode(T.with_inferred(F.col("read"))).alias("place", "key"))


@query("""SELECT p_partkey AS image_id, 'fat' AS key, CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.25e0 ELSE p_size * 1e0 END AS value FROM part
 UNION ALL SELECT p_partkey, 'salt', 2e0 FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'sugars', 4e0 FROM part WHERE p_partkey % 5 = 0""")
def review_label(spark, d):
    """What was read in the chosen column, with the user's edits; text that is no number drops the nutrient, and new ones are added."""
    k, size = F.col("p_partkey"), F.col("p_size")
    cell = lambda basis, key, value: F.struct(F.lit(basis).alias("basis"), F.lit(key).alias("key"), value.cast("double").alias("value"))
    parts = V.table(spark, d, "part")
    values = parts.select(k.alias("image_id"), F.inline(F.array(cell("100", "fat", size), cell("100", "salt", F.lit(2)), cell("serving", "fat", F.lit(1)))))
    edit = lambda when, key, text: F.when(when, F.struct(F.lit(key).alias("key"), text.alias("text")))
    edits = F.array_compact(F.array(edit(k % 2 == 0, "fat", F.concat(size.cast("string"), F.lit(",25g"))), edit(k % 3 == 0, "salt", F.lit("n/a")), edit(k % 5 == 0, "sugars", F.lit("4"))))
    return T.reviewed(values, parts.select(k.alias("image_id"), F.inline(edits)), parts.select(k.alias("image_id"), F.lit("100").alias("basis")))
