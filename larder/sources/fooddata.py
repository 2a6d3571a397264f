"""Normalisers of two food databases' JSON into foods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import KCAL_PER_KJ, alcohol_grams, convert_unit, decimal_number, half_up, html_unescape, net_carbs, serving_number, tidy_number, unit_text

PRODUCT = "code string, brands string, quantity string, serving_size string, nutriments map<string,string>"
FOOD = "fdcId long, description string, brandOwner string, servingSize double, servingSizeUnit string, foodMeasures array<struct<disseminationText:string,gramWeight:double>>, foodNutrients array<struct<nutrientName:string,unitName:string,value:double>>"

# Nutrients that a product may have, besides its energy, and those that are not kept in g.
NUTRIENTS = (
    "fat", "saturated-fat", "carbohydrates", "sugars", "fiber", "proteins", "salt", "sodium", "cholesterol", "trans-fat", "monounsaturated-fat",
    "polyunsaturated-fat", "omega-3-fat", "omega-6-fat", "omega-9-fat", "vitamin-a", "vitamin-b1", "vitamin-b2", "vitamin-pp", "pantothenic-acid",
    "vitamin-b6", "biotin", "vitamin-b9", "vitamin-b12", "vitamin-c", "vitamin-d", "vitamin-e", "vitamin-k", "potassium", "chloride", "calcium",
    "phosphorus", "iron", "magnesium", "zinc", "copper", "manganese", "fluoride", "selenium", "iodine", "caffeine", "alcohol", "sucrose", "glucose",
    "fructose", "lactose",
)
APP_UNITS = {
    "mg": (
        "sodium", "cholesterol", "vitamin-b1", "vitamin-b2", "vitamin-pp", "pantothenic-acid", "vitamin-b6", "vitamin-c", "vitamin-e", "potassium",
        "chloride", "calcium", "phosphorus", "iron", "magnesium", "zinc", "copper", "manganese", "fluoride", "caffeine",
    ),
    "µg": ("vitamin-a", "biotin", "vitamin-b9", "vitamin-b12", "vitamin-d", "vitamin-k", "selenium", "iodine"),
}
UNIT_SYMBOLS = ("kcal", "kj", "µg", "ug", "mg", "g", "kg", "ml", "cl", "dl", "l")

# The second database's nutrient names; a name is found as part of an entry's name, the first entry wins.
USDA_NAMES = {
    "calories": "Energy",
    "fat": "Total lipid (fat)",
    "saturated-fat": "Fatty acids, total saturated",
    "carbohydrates": "Carbohydrate, by difference",
    "sugars": "Total Sugars",
    "fiber": "Fiber, total dietary",
    "proteins": "Protein",
    "monounsaturated-fat": "Fatty acids, total monounsaturated",
    "polyunsaturated-fat": "Fatty acids, total polyunsaturated",
    "sodium": "Sodium",
    "cholesterol": "Cholesterol",
    "trans-fat": "Fatty acids, total trans",
    "vitamin-a": "Vitamin A",
    "vitamin-b1": "Thiamin",
    "vitamin-b2": "Riboflavin",
    "vitamin-pp": "Niacin",
    "pantothenic-acid": "Pantothenic acid",
    "vitamin-b6": "Vitamin B-6",
    "biotin": "Biotin",
    "vitamin-b9": "Folate, total",
    "vitamin-b12": "Vitamin B-12",
    "vitamin-c": "Vitamin C",
    "vitamin-d": "Vitamin D",
    "vitamin-e": "Vitamin E",
    "vitamin-k": "Vitamin K",
    "potassium": "Potassium",
    "calcium": "Calcium",
    "phosphorus": "Phosphorus",
    "iron": "Iron",
    "magnesium": "Magnesium",
    "zinc": "Zinc",
    "copper": "Copper",
    "manganese": "Manganese",
    "fluoride": "Fluoride",
    "selenium": "Selenium",
    "iodine": "Iodine",
    "caffeine": "Caffeine",
    "alcohol": "Alcohol",
    "sucrose": "Sucrose",
}


def app_unit(nutrient: Column) -> Column:
    """The unit that is kept for a nutrient; of most it is g."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for unit, names in APP_UNITS.items() for n in names for x in (n, unit)]), nutrient), F.lit("g"))


def products(rows: DataFrame, column: str = "json", prefer_100g: bool = False, language: str = "en") -> DataFrame:
    """barcode, original_barcode, name, brand, portion, unit, nutrient, value from JSON texts of products.

    The name is the one in ``language``, else the first that has any, else the code, with character references decoded.
    Values per serving are taken if the serving has a number and there are some, unless those per 100 are preferred and
    there are some; else those per 100; else the quantity with its energy alone.  Of either kind the prepared product's
    are taken where only that has energy.  kcal come from kJ where they are missing, and values of grams are turned to
    the unit that is kept; alcohol, per cent of volume, to grams of the portion.  Without any amount a product is left out.
    """
    text = F.col(column)
    p = rows.select(F.from_json(text, PRODUCT).alias("p"), F.from_json(text, "map<string,string>").alias("fields")).select("p.*", "fields")
    n = F.coalesce("nutriments", F.create_map().cast("map<string,string>"))
    keys = F.map_keys(n)
    has = lambda suffix: F.exists(keys, lambda k: k.endswith(suffix))
    number = lambda key: F.try_element_at(n, key).try_cast("double")
    per_serving = F.coalesce(F.col("serving_size").rlike(r"[0-9.,]"), F.lit(False)) & has("_serving") & (F.lit(not prefer_100g) | ~has("_100g"))
    per_100 = ~per_serving & has("_100g")
    by_quantity = ~per_serving & ~per_100 & (F.coalesce("quantity", F.lit("")) != "")
    kind = F.when(per_serving, "_serving").when(per_100, "_100g")
    there = lambda value: F.coalesce(value, F.lit(0.0)) != 0
    prepared = ~there(number(F.concat(F.lit("energy"), kind))) & there(number(F.concat(F.lit("energy_prepared"), kind)))
    p = p.withColumn("suffix", F.when(prepared, F.concat(F.lit("_prepared"), kind)).otherwise(F.coalesce(kind, F.lit(""))))

    amount_text = F.when(per_serving, F.col("serving_size")).when(by_quantity, F.col("quantity"))
    amount = F.when(per_100, 100.0).when(per_serving, serving_number(amount_text)).when(by_quantity, decimal_number(amount_text))
    spelled = F.nullif(F.trim(unit_text(amount_text)), F.lit(""))
    known = F.when(F.lower(spelled).isin(*UNIT_SYMBOLS), F.lower(spelled)).otherwise(spelled)
    in_volume = F.coalesce(F.col("serving_size").rlike(r"(?i)\d\s*(ml|cl|l)(\s|\)|\]|,|;|$)"), F.lit(False))
    unit = F.when(per_100, F.when(in_volume, "ml").otherwise("g")).otherwise(F.coalesce(known, F.lit("?")))
    p = p.withColumns({"portion": amount, "unit": unit})

    kcal, kj = number(F.concat(F.lit("energy-kcal"), F.col("suffix"))), number(F.concat(F.lit("energy"), F.col("suffix")))
    whole = F.when(per_serving, F.when(kcal >= 0, F.floor(kcal)).otherwise(F.ceil(kcal)).cast("double")).otherwise(kcal)
    from_kj = F.when(by_quantity, kj).otherwise(half_up(kj * KCAL_PER_KJ, 0))
    calories = F.when(by_quantity | there(kj), F.when(there(kcal), whole).otherwise(from_kj))
    kilojoules = F.when(by_quantity | there(kj), kj)

    # Each key that is a nutrient's name and the suffix; the map is gone through once.
    nutrient = lambda e: F.substring(e["key"], F.lit(1), F.length(e["key"]) - F.length("suffix"))
    own = F.filter(F.map_entries(n), lambda e: ~by_quantity & e["key"].endswith(F.col("suffix")) & nutrient(e).isin(*NUTRIENTS))

    def read(e: Column) -> Column:
        kept = convert_unit(e["value"].try_cast("double"), F.lit("g"), app_unit(nutrient(e)))
        return F.struct(nutrient(e).alias("nutrient"), F.when(nutrient(e) == "alcohol", alcohol_grams(kept, F.col("portion"), F.col("unit"))).otherwise(kept).alias("value"))

    energies = F.array(*[F.struct(F.lit(k).alias("nutrient"), v.alias("value")) for k, v in (("calories", calories), ("kilojoules", kilojoules))])
    entries = F.concat(energies, F.transform(own, read))
    # Of the other names the first in the order of the text counts, as a map read from JSON keeps it.
    others = F.filter(F.map_entries("fields"), lambda e: e["key"].contains("product_name") & (F.length(e["value"]) > 1))
    local = F.try_element_at("fields", F.lit(f"product_name_{language}"))
    name = F.coalesce(F.when(F.length(local) > 1, local), F.try_element_at(others, F.lit(1))["value"])
    found = p.where("portion IS NOT NULL").select(
        F.regexp_replace("code", "^0", "").alias("barcode"),
        F.when(F.col("code").startswith("0"), F.col("code")).alias("original_barcode"),
        F.coalesce(html_unescape(name), F.col("code")).alias("name"),
        html_unescape(F.substring_index(F.coalesce("brands", F.lit("")), ",", 1)).alias("brand"),
        "portion",
        "unit",
        F.inline(entries),
    )
    return found.where("value IS NOT NULL")


#: Texts of a measure that describe nothing.
UNSPECIFIED = "Quantity not specified"


def measured(measures: Column) -> Column:
    """The measure that a food is served in, of an array of struct(disseminationText, gramWeight).

    The last entry's weight is the best guess: the first described entry of that weight.  Where none describes it, the
    first of the heaviest among the first entry and the described ones.
    """
    last = F.try_element_at(measures, F.lit(-1))["gramWeight"]
    described = F.filter(measures, lambda m: m["disseminationText"] != UNSPECIFIED)
    guess = F.try_element_at(F.filter(described, lambda m: m["gramWeight"] == last), F.lit(1))
    candidates = F.concat(F.slice(measures, 1, 1), described)
    most = F.array_max(F.transform(candidates, lambda m: m["gramWeight"]))
    return F.coalesce(guess, F.try_element_at(F.filter(candidates, lambda m: m["gramWeight"] == most), F.lit(1)))


def entry_key(name: Column) -> Column:
    """The nutrients that an entry's name stands for: an array, as one name may contain two of the table's."""
    return F.filter(F.array(*[F.when(name.contains(text), key) for key, text in USDA_NAMES.items() if key != "calories"]), lambda k: k.isNotNull())


def usda_foods(rows: DataFrame, column: str = "json", prefer_100g: bool = False) -> DataFrame:
    """barcode, name, brand, portion, unit, nutrient, value from JSON texts of foods; foods without energy in kcal are left out.

    Values are per 100 g and are scaled to the serving: its size if that is in g or ml, else a measure, else 100.  A
    measure's text such as "1/2 cup" gives portion and unit, with its weight behind the unit.  Energy is the first entry
    of that name in kcal, as a whole number; every other nutrient is the first entry whose name contains the table's, in
    the unit that is kept for it.  Each food's entries are gone through once.
    """
    f = rows.select(F.from_json(column, FOOD).alias("f")).select("f.*")
    in_volume = F.col("servingSizeUnit") == "ml"
    served = F.col("servingSize").isNotNull() & ~F.isnan("servingSize") & F.col("servingSizeUnit").isin("g", "ml") & F.lit(not prefer_100g)
    f = f.withColumn("measure", F.when(~F.coalesce(served, F.lit(False)) & F.lit(not prefer_100g), measured(F.col("foodMeasures"))))
    weight, text = F.col("measure.gramWeight"), F.col("measure.disseminationText")
    base = F.when(in_volume, "ml").otherwise("g")
    named = F.nullif(F.trim(unit_text(text)), F.lit(""))
    amount = F.when(named.isNotNull(), serving_number(text))
    portion = F.when(served, F.col("servingSize")).otherwise(F.coalesce(amount, weight, F.lit(100.0)))
    unit = F.when(amount.isNotNull(), F.concat(named, F.lit(" ("), tidy_number(weight, base), F.lit(")"))).otherwise(base)
    times = F.coalesce(F.when(served, F.col("servingSize")).otherwise(weight) / 100, F.lit(1.0))
    energy = F.try_element_at(F.filter("foodNutrients", lambda x: x["nutrientName"].startswith("Energy") & (F.lower(x["unitName"]) == "kcal")), F.lit(1))["value"]
    f = f.select("fdcId", "description", "brandOwner", "foodNutrients", portion.alias("portion"), unit.alias("unit"), times.alias("times"), half_up(energy * times, 0).alias("kcal")).where("kcal is not null")

    # (key, place, value) of each entry; the first place of a key wins.
    read = F.transform("foodNutrients", lambda x, i: F.transform(entry_key(x["nutrientName"]), lambda k: F.struct(k.alias("key"), i.alias("place"), x["value"].alias("value"), x["unitName"].alias("unit"))))
    first = F.aggregate(F.flatten(read), F.create_map().cast("map<string,struct<value:double,unit:string>>"), lambda held, x: F.when(F.map_contains_key(held, x["key"]), held).otherwise(F.map_concat(held, F.create_map(x["key"], F.struct(x["value"].alias("value"), x["unit"].alias("unit"))))))
    kept = F.transform_values(first, lambda k, x: half_up(convert_unit(x["value"], x["unit"], app_unit(k)) * F.col("times")))
    f = f.withColumn("n", kept)
    n = lambda key: F.try_element_at(F.col("n"), F.lit(key))
    energies = F.array(F.struct(F.lit("calories").alias("key"), F.col("kcal").alias("value")), F.struct(F.lit("kilojoules").alias("key"), half_up(F.col("kcal") / KCAL_PER_KJ, 0).alias("value")))
    carbohydrates = net_carbs(n("carbohydrates"), n("fiber"), n("sugars"))
    others = F.transform(F.map_entries("n"), lambda x: F.struct(x["key"].alias("key"), F.when(x["key"] == "carbohydrates", carbohydrates).otherwise(x["value"]).alias("value")))
    salt = F.array(F.struct(F.lit("salt").alias("key"), (n("sodium") * 0.0025).alias("value")))
    out = f.select(F.concat(F.lit("fdcId_"), F.col("fdcId").cast("string")).alias("barcode"), F.col("description").alias("name"), F.col("brandOwner").alias("brand"), "portion", "unit", F.inline(F.concat(energies, others, salt)))
    return out.withColumnRenamed("key", "nutrient").where("value IS NOT NULL")
