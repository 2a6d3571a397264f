"""Changes to foods, diary, goals and settings: each gives the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import convert_unit, half_up
from larder.operators.numbering import numbered


def last_id(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def insert_all(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Adds rows with ids of their own, and others behind the last id of ``rows``, in the order of their names, then of their other columns."""
    others = [c for c in new.columns if c not in ("id", "name")]
    numbers = numbered(new.where("id is null").drop("id"), ["name", *others], "id", last_id(rows))
    return rows.unionByName(new.where("id is not null")).unionByName(numbers.select(new.columns))


def resolve_or_insert(foods: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Foods after some were chosen, and the chosen ones, each with the id of the food that it now is.

    A chosen row with an id is that food, which is hidden no longer.  One without, as a remote search gives it, is the
    first food with its barcode that is not archived.  One that is not there either is added with the next id; of
    rows with one barcode the first (by name, then the other columns) is added, and all of them are that food; rows
    without barcode are each added.  Both tables have id, barcode, name and the foods' other columns.
    """
    known = foods.where("not archived and barcode is not null").groupBy("barcode").agg(F.min("id").alias("_found"))
    rows = chosen.join(known, "barcode", "left").withColumn("id", F.coalesce("id", "_found")).drop("_found").select(foods.columns)
    missing = rows.where("id is null")
    fields = [c for c in foods.columns if c not in ("id", "barcode")]
    first = F.min(F.struct(*["name"], *[c for c in fields if c != "name"])).alias("_first")
    coded = missing.where("barcode is not null").groupBy("barcode").agg(first).select("barcode", "_first.*")
    wanted = coded.unionByName(missing.where("barcode is null").select("barcode", *fields))
    added = numbered(wanted, ["barcode", "name", *[c for c in fields if c != "name"]], "id", last_id(foods)).select(foods.columns)
    new_ids = added.where("barcode is not null").select("barcode", F.col("id").alias("_new"))
    coded_rows = missing.where("barcode is not null").join(new_ids, "barcode").withColumn("id", F.col("_new")).select(foods.columns)
    resolved = rows.where("id is not null").unionByName(coded_rows).unionByName(added.where("barcode is null"))
    return selected(foods, rows.where("id is not null")).select(foods.columns).unionByName(added), resolved


def delete_keys(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def upsert_by_barcode(rows: DataFrame, new: DataFrame, stamp: Column) -> DataFrame:
    """New records replace the first food with their barcode that is not archived, keep its id, and are stamped; others are added without an id."""
    found = rows.where("not archived and barcode <> ''").groupBy("barcode").agg(F.min("id").alias("id"))
    known = new.drop("id").join(found, "barcode", "left").withColumn("date_time", stamp)
    return delete_keys(rows, known.where("id is not null")).unionByName(known.select(rows.columns))


def saved(rows: DataFrame) -> DataFrame:
    """A food as it is stored: archived as it was or not at all, never hidden, without the editor's own field."""
    return rows.withColumns({"archived": F.coalesce("archived", F.lit(False)), "hidden": F.lit(False)}).drop("nutrition_per")


def selected(foods: DataFrame, chosen: DataFrame) -> DataFrame:
    """Foods after some were chosen: a hidden one that was is hidden no longer."""
    keys = chosen.select("id").distinct().withColumn("_chosen", F.lit(True))
    return foods.join(keys, "id", "left").withColumn("hidden", F.col("hidden") & F.col("_chosen").isNull()).drop("_chosen")


def eligible(items: DataFrame) -> DataFrame:
    """Diary items whose food is fetched: those with an id and, where items have a category, with one."""
    rows = items.where("food_id is not null")
    return rows.where("category is not null") if "category" in rows.columns else rows


def stamp_group(items: Column, category: int, stamp: Column) -> Column:
    """An entry's items with the time of one group's set."""
    return F.transform(items, lambda x: F.when(x["category"] == category, x.withField("date_time", stamp)).otherwise(x))


def saved_stats(values: Column, units: dict[str, str], internal: dict[str, str]) -> Column:
    """A map of inputs by stat in the units that are stored; what is no number is left out."""
    numbers = F.map_filter(F.transform_values(values, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull() & ~F.isnan(v))

    def stored(stat: Column, value: Column) -> Column:
        out = value
        for name, unit in units.items():
            out = F.when(stat == name, half_up(convert_unit(value, F.lit(unit), F.lit(internal[name])), 4)).otherwise(out)
        return out

    return F.transform_values(numbers, stored)


def set_goal(goals: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A goal that is set for a stat on a day replaces that day's, else it is added behind the stat's others; ``keys`` name a list's owner and stat."""
    last = goals.groupBy(*keys).agg(F.max("seq").alias("_last"))
    same = goals.groupBy(*keys, "effective_from").agg(F.max("seq").alias("_seq"))
    on = [F.col(f"n.{k}") == F.col(f"s.{k}") for k in keys] + [F.col("n.effective_from").eqNullSafe(F.col("s.effective_from"))]
    placed = new.join(last, keys, "left").alias("n").join(same.alias("s"), on, "left")
    placed = placed.select(*[f"n.{c}" for c in new.columns], F.coalesce("_seq", F.col("_last") + 1, F.lit(0)).alias("seq"))
    return delete_goal(goals, placed, keys).unionByName(placed)


def delete_goal(goals: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return goals.join(gone.select(*keys, "seq"), [*keys, "seq"], "left_anti")


def may_rename(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """old, new, allowed: a new name must not be one that a nutriment or body stat has."""
    taken = names.select(F.col("name").alias("new"), F.lit(True).alias("_taken")).distinct()
    return wanted.join(taken, "new", "left").select("old", "new", F.col("_taken").isNull().alias("allowed"))


QUICK_ADD = "quick-add"


def with_quick_add(foods: DataFrame) -> tuple[DataFrame, int]:
    """Foods with the reserved one that stands for plain energy (a kcal a portion, archived), and its id; added behind the last id where it is missing."""
    there = foods.where(F.col("barcode") == QUICK_ADD).agg(F.min("id")).first()[0]
    if there is not None:
        return foods, there
    new = last_id(foods) + 1
    values = {"id": F.lit(new), "barcode": F.lit(QUICK_ADD), "name": F.lit("Quick Add"), "portion": F.lit(1.0), "nutrition": F.create_map(F.lit("calories"), F.lit(1.0)), "archived": F.lit(True)}
    row = foods.sparkSession.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in foods.schema])
    return foods.unionByName(row), new


def quick_added(rows: DataFrame, food_id: int, energy: Column, unit: Column) -> DataFrame:
    """Diary items of plain energy, in kcal or kJ; burned energy is negative; what is no number is left out."""
    kcal = convert_unit(energy, unit, F.lit("kcal"))
    return rows.withColumns({"food_id": F.lit(food_id), "portion": F.lit(1.0), "quantity": kcal}).where(F.col("quantity").isNotNull() & ~F.isnan("quantity"))


def imported(foods: DataFrame, new: DataFrame, stamp: Column) -> DataFrame:
    """Foods of an import (without ids) as they are stored: with id and visibility of the first food with their barcode that is not archived, else new and hidden; stamped."""
    known = foods.where("not archived and barcode is not null").groupBy("barcode").agg(F.min_by(F.struct("id", "hidden"), "id").alias("_known"))
    met = new.drop("id", "hidden").join(known, "barcode", "left")
    return met.withColumns({"id": F.col("_known.id"), "hidden": F.coalesce("_known.hidden", F.lit(True)), "date_time": stamp}).drop("_known")


def new_activities(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Items of burned energy for fetched activities that are not stored yet.

    ``fetched`` has user, day, date_time, calories and name, of which the last may be null; ``stored`` the items as they
    are kept: user, day, date_time, category, quantity (kcal, negative) and description.  An activity is there already
    if an item equals it in every field, where null equals null; equal fetched ones are one.  The join's keys are all
    fields, so a day with many activities is spread over the shuffle.
    """
    items = fetched.select("user", "day", "date_time", F.lit(0).alias("category"), (-F.col("calories")).alias("quantity"), F.col("name").alias("description"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in items.columns]
    return items.dropDuplicates().alias("n").join(stored.alias("s"), same, "left_anti")


def backup_due(last: Column, now: Column, minutes: int = 60) -> Column:
    """Never made, or made more than so many minutes ago."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last) > 60 * minutes, F.lit(True))
