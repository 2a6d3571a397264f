"""Resolving items against foods into portion-scaled nutrient totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import ENERGY, KCAL_PER_GRAM, KCAL_PER_KJ, half_up

MODES = ("ignore", "disclose", "subtract")


def multiplier(portion: Column, food_portion: Column, quantity: Column) -> Column:
    return F.try_divide(portion, food_portion) * quantity


def with_kilojoules(nutrition: Column) -> Column:
    """A nutrition map; kilojoules that it lacks are derived from its calories."""
    kj = F.create_map(F.lit("kilojoules"), nutrition["calories"] / KCAL_PER_KJ)
    lacks = ~F.map_contains_key(nutrition, "kilojoules") & nutrition["calories"].isNotNull()
    return F.when(lacks, F.map_concat(nutrition, kj)).otherwise(nutrition)


def long_nutrition(foods: DataFrame, derive_kj: bool = True) -> DataFrame:
    """food_id, food_portion, nutrient, value."""
    nutrition = with_kilojoules(F.col("nutrition")) if derive_kj else F.col("nutrition")
    return foods.select(F.col("id").alias("food_id"), F.col("portion").alias("food_portion"), F.explode(nutrition).alias("nutrient", "value"))


def item_nutrients(items: DataFrame, foods: DataFrame, derive_kj: bool = True) -> DataFrame:
    """Each item's nutrients for its portion, rounded per item; items of unknown foods are left out.

    Items meet their food's map, one row each, and the map is made long behind the join.
    """
    nutrition = with_kilojoules(F.col("nutrition")) if derive_kj else F.col("nutrition")
    found = foods.select(F.col("id").alias("food_id"), F.col("portion").alias("_food_portion"), nutrition.alias("_nutrition"))
    met = items.join(found, "food_id").withColumn("_times", multiplier(F.col("portion"), F.col("_food_portion"), F.col("quantity")))
    rows = met.select(*items.columns, "_times", F.explode("_nutrition").alias("nutrient", "_value"))
    amount = F.coalesce(F.nanvl(half_up(F.col("_value") * F.col("_times")), F.lit(0.0)), F.lit(0.0))
    return rows.select(*items.columns, "nutrient", amount.alias("amount"))


def apply_mode(rows: DataFrame, mode: str) -> DataFrame:
    """Negative amounts: only energy may be negative.  ignore drops it, disclose reports it as burned, subtract nets it."""
    negative, energy = F.col("amount") < 0, F.col("nutrient").isin(*ENERGY)
    if mode == "ignore":
        return rows.where(~negative)
    kept = rows.where(~negative | energy)
    if mode == "subtract":
        return kept
    if mode != "disclose":
        raise ValueError(f"mode is one of {MODES}")
    burned = F.when(negative, F.concat(F.lit("burned-"), F.col("nutrient"))).otherwise(F.col("nutrient"))
    return kept.select(*[burned.alias(c) if c == "nutrient" else F.abs("amount").alias(c) if c == "amount" else c for c in kept.columns])


def total_nutrition(items: DataFrame, foods: DataFrame, keys: list[str], mode: str = "subtract", derive_kj: bool = True) -> DataFrame:
    """keys, nutrient, total.  Sums are of decimals, so that their order does not matter.

    Every group of items has calories, 0 where none of its foods is known.
    """
    rows = apply_mode(item_nutrients(items, foods, derive_kj), mode).select(*keys, "nutrient", "amount")
    rows = rows.unionByName(items.select(*keys, F.lit("calories").alias("nutrient"), F.lit(0.0).alias("amount")))
    total = F.sum(F.col("amount").cast("decimal(18,2)")).cast("double")
    return rows.groupBy(*keys, "nutrient").agg(total.alias("total"))


def wide(totals: DataFrame, keys: list[str], nutrients: list[str]) -> DataFrame:
    """One column per nutrient, 0 where a group has none."""
    columns = [F.coalesce(F.sum(F.when(F.col("nutrient") == n, F.col("total"))), F.lit(0.0)).alias(n.replace("-", "_")) for n in nutrients]
    return totals.groupBy(*keys).agg(*columns)


def macro_split(totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, macro, energy: kcal of each macronutrient, subtypes taken out of their type, positive ones only."""
    w = wide(totals, keys, ["fat", "saturated-fat", "carbohydrates", "sugars", "proteins", "alcohol"])
    amounts = {
        "fat": F.col("fat") - F.col("saturated_fat"), "saturated-fat": F.col("saturated_fat"),
        "carbohydrates": F.col("carbohydrates") - F.col("sugars"), "sugars": F.col("sugars"),
        "proteins": F.col("proteins"), "alcohol": F.col("alcohol"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("macro"), (v * float(KCAL_PER_GRAM[k])).alias("energy")) for k, v in amounts.items()])
    return w.select(*keys, F.inline(entries)).where("energy > 0")


def macro_percent(totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the percentage of fat, carbohydrates (with their subtypes), proteins and alcohol; null without energy."""
    w = wide(totals, keys, ["fat", "carbohydrates", "proteins", "alcohol"])
    energy = {k: F.col(k) * float(KCAL_PER_GRAM[k]) for k in ("fat", "carbohydrates", "proteins", "alcohol")}
    whole = energy["fat"] + energy["carbohydrates"] + energy["proteins"] + energy["alcohol"]
    return w.select(*keys, *[half_up(F.try_divide(v * 100, whole)).alias(f"{k}_percent") for k, v in energy.items()])
