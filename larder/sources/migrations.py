"""Stores of older layouts brought to the present one, step by step.

Every store has a ``version``, its database's layout.  A step touches only rows of layouts before it, so stores of all
versions may be in one table, and running a migration again changes nothing more.

| Before version | What changes |
|---|---|
| 30 | flat diary entries become one document a day, with the day's weight; texts such as "200g" become portion and unit; three nutrients get their present names; names are unescaped; empty image addresses go; meals and recipes list items |
| 31 | a diary's day is a midnight |
| 34 | a barcode loses one leading zero or, kept apart, its database's prefix |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import legacy_unescape

ITEMS_VERSION, DAYS_VERSION, BARCODES_VERSION = 30, 31, 34
#: The present layout.
VERSION = 34
# Nutrients that were renamed.
RENAMED = {"carbs": "carbohydrates", "protein": "proteins", "sugar": "sugars"}
QUICK_ADD = "Quick Add"


def _before(version: int) -> Column:
    return F.coalesce(F.col("version"), F.lit(0)) < version


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{L}", "")


def digits(text: Column) -> Column:
    """All digits of a text as one number: "12.5 g" is 125, as old portions were read."""
    return F.nullif(F.regexp_replace(text, r"[^0-9]", ""), F.lit("")).try_cast("double")


def whole(text: Column) -> Column:
    """The whole number that a text starts with."""
    return F.regexp_extract(text, r"^\s*([-+]?[0-9]+)", 1).try_cast("double")


def _portion(text: Column, read) -> tuple[Column, Column]:
    """Portion and unit of an old text; what is a number already has no unit, and only its whole part counts."""
    plain = text.try_cast("double").isNotNull()
    return F.when(plain, whole(text)).otherwise(read(text)), F.when(~plain, letters(text))


def migrate_barcodes(foods: DataFrame) -> DataFrame:
    """Version 34; ``barcode`` and ``originalBarcode``."""
    code, old = F.col("barcode"), _before(BARCODES_VERSION)
    zero, prefixed = old & code.startswith("0"), old & code.startswith("fdcId_")
    original = F.when(zero, code).when(prefixed, F.replace(code, F.lit("fdcId_"), F.lit(""))).otherwise(F.col("originalBarcode"))
    return foods.withColumns({"originalBarcode": original, "barcode": F.when(zero, F.substring(code, 2, 1 << 20)).otherwise(code)})


def migrate_foods(foods: DataFrame) -> DataFrame:
    """version, id, name, brand, portion (as text, also "200g"), unit, nutrition, barcode, originalBarcode, image_url: all steps, with portion as a number."""
    old = _before(ITEMS_VERSION)
    amount, unit = _portion(F.col("portion"), digits)
    nutrition = F.col("nutrition")
    for then, now in RENAMED.items():  # where a food has both names, the old one's value counts
        both = F.map_concat(F.map_filter(nutrition, lambda k, _: ~k.isin(then, now)), F.create_map(F.lit(now), F.try_element_at(nutrition, F.lit(then))))  # noqa: B023
        nutrition = F.when(F.map_contains_key(nutrition, then), both).otherwise(nutrition)
    found = foods.withColumns({
        "unit": F.when(old, F.coalesce(F.nullif(unit, F.lit("")), F.col("unit"))).otherwise(F.col("unit")),
        "portion": F.when(old, amount).otherwise(F.col("portion").try_cast("double")),
        "nutrition": F.when(old, nutrition).otherwise(F.col("nutrition")),
        "name": F.when(old, legacy_unescape(F.col("name"))).otherwise(F.col("name")),
        "brand": F.when(old, legacy_unescape(F.col("brand"))).otherwise(F.col("brand")),
        "image_url": F.when(old & F.col("image_url").isin("", "undefined"), F.lit(None).cast("string")).otherwise(F.col("image_url")),
    })
    return migrate_barcodes(found).withColumn("version", F.lit(VERSION))


ITEM = "struct<id:bigint,type:string,portion:double,unit:string,quantity:double,category:int>"


def migrate_diary(entries: DataFrame, weights: DataFrame, quick_add: int, owner: str = "user") -> DataFrame:
    """owner, day, items, stats: one document for each day of an owner.

    ``entries`` has owner, version, date_time; of old layouts one row for each item with category, portion (text),
    quantity, food_id, recipe_id and calories; of later ones items and stats.  ``weights`` (owner, date_time, weight) is
    the old layout's log, of which a day's last is taken; a day without entry gets no document for it.  ``quick_add`` is
    the id of the food that stands for plain energy.
    """
    old, text = _before(ITEMS_VERSION), F.col("portion")
    day = F.to_date("date_time")
    quick = text == QUICK_ADD
    item = F.struct(
        F.coalesce("food_id", "recipe_id", F.when(quick, F.lit(quick_add).cast("long"))).alias("id"),
        F.when(F.col("food_id").isNotNull(), "food").when(F.col("recipe_id").isNotNull(), "recipe").when(quick, "food").alias("type"),
        F.when(quick, 1.0).otherwise(whole(text)).alias("portion"),
        F.when(~quick, letters(text)).alias("unit"),
        F.when(quick, F.col("calories")).otherwise(F.coalesce("quantity", F.lit(1.0))).alias("quantity"),
        F.col("category"),
    ).cast(ITEM)
    place = F.struct(F.col("date_time").alias("at"), item.alias("item"))
    flat = entries.where(old).groupBy(owner, day.alias("day")).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["item"]).alias("items"))
    last = weights.groupBy(owner, day.alias("day")).agg(F.max_by("weight", "date_time").alias("weight"))
    weight = F.map_filter(F.create_map(F.lit("weight"), F.col("weight").cast("double")), lambda _, v: v.isNotNull())
    grouped = flat.join(last, [owner, "day"], "left").select(owner, "day", "items", weight.alias("stats"))
    # Later layouts have their documents already; before version 31 with a time of day, which is cut off as it is anyway.
    later = entries.where(~old).select(owner, day.alias("day"), F.col("items").cast(f"array<{ITEM}>").alias("items"), F.col("stats").cast("map<string,double>").alias("stats"))
    return grouped.unionByName(later)


def migrate_dishes(dishes: DataFrame, recipes: bool) -> DataFrame:
    """Meals, or recipes: version, id, name, portion (text), unit, foods (array of id and portion text), items: all steps; ``foods`` of old layouts become items."""
    old = _before(ITEMS_VERSION)

    def item(food: Column) -> Column:
        amount, unit = _portion(food["portion"], digits)
        quantity = F.lit(None).cast("double") if recipes else F.lit(1.0)
        return F.struct(food["id"].alias("id"), F.lit("food").alias("type"), amount.alias("portion"), unit.alias("unit"), quantity.alias("quantity"), F.lit(None).cast("int").alias("category")).cast(ITEM)

    items = F.coalesce(F.transform("foods", item), F.array().cast(f"array<{ITEM}>"))
    text = F.col("portion")
    number = F.when(old, whole(text)).otherwise(text.try_cast("double")) if recipes else F.lit(None).cast("double")
    unit = F.when(old & text.try_cast("double").isNull(), letters(text)).otherwise(F.col("unit")) if recipes else F.lit(None).cast("string")
    found = dishes.withColumns({
        "items": F.when(old, items).otherwise(F.col("items").cast(f"array<{ITEM}>")), "unit": unit, "portion": number,
        "name": F.when(old, legacy_unescape(F.col("name"))).otherwise(F.col("name")) if not recipes else F.col("name"),
    })
    return found.drop("foods").withColumn("version", F.lit(VERSION))
