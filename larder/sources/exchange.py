"""Exchange formats: form-encoded uploads, JSON backups, CSV exports, food-list imports."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.scalars import convert_unit, locale_date, plain_number, uri_component
from larder.sources.fooddata import NUTRIENTS, app_unit

#: Settings that a backup must not carry.
SECRETS = ("off-password", "usda-key", "icu-key")

_IMPORT = "version int, foodList array<struct<name:string,brand:string,uniqueId:string,portion:string,unit:string,nutrition:map<string,string>,categories:array<string>>>"


def upload_string(fields: dict[str, Column]) -> Column:
    """name=value pairs, form-encoded and joined by ampersands; null values are left out."""
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in fields.items()]
    return F.concat_ws("&", *pairs)


def product_upload(user: str, password: str, language: str = "en", energy_unit: str = "kcal", per_serving: bool = False, country: str | None = None) -> Column:
    """What is sent to add a food (barcode, name, brand, portion, unit, nutrition) to the open database.

    The serving is named unless it is 100 g; energy goes in kJ if the food has it, with kcal beside it where the user
    counts those, else in kcal; of the nutrition only nutrients that the database knows, each with the unit it is kept in.
    """
    text = lambda v: F.regexp_replace(v.cast("string"), "\\.0$", "")
    pair = lambda name, value: F.concat(F.lit(f"{name}="), value)
    n, per = F.col("nutrition"), "serving" if per_serving else "100g"
    kj, kcal = F.try_element_at(n, F.lit("kilojoules")), F.try_element_at(n, F.lit("calories"))
    whole = F.lit(not per_serving) & (F.col("portion") == 100) & (F.col("unit") == "g")
    in_kj = [pair("nutriment_energy", text(kj)), F.lit("nutriment_energy_unit=kJ"), F.when(kcal.isNotNull() & F.lit(energy_unit == "kcal"), pair("nutriment_energy-kcal", text(kcal)))]
    in_kcal = [pair("nutriment_energy", text(kcal)), F.lit("nutriment_energy_unit=kcal")]
    energy = F.when(kj.isNotNull(), F.concat_ws("&", *in_kj)).when(kcal.isNotNull(), F.concat_ws("&", *in_kcal))

    def nutrient(entry: Column) -> Column:
        name = entry["key"]
        return F.concat(F.lit("nutriment_"), name, F.lit("="), text(entry["value"]), F.lit("&nutriment_"), name, F.lit("_unit="), uri_component(app_unit(name)))

    others = F.transform(F.filter(F.map_entries(n), lambda e: e["key"].isin(*NUTRIENTS)), nutrient)
    return F.concat_ws(
        "&", pair("code", uri_component(F.col("barcode"))), pair("user_id", uri_component(F.lit(user))), pair("password", uri_component(F.lit(password))), F.lit(f"lang={language}"),
        pair(f"product_name_{language}", uri_component(F.col("name"))), pair("brands", uri_component(F.col("brand"))), F.lit(f"nutrition_data_per={per}"),
        F.when(~whole, pair("serving_size", uri_component(F.concat_ws(" ", text(F.col("portion")), F.col("unit"))))), energy, F.nullif(F.concat_ws("&", others), F.lit("")), F.lit(f"countries={country}") if country else F.lit(None).cast("string"),
    )


class CsvField(NamedTuple):
    name: str
    unit: str
    #: Of a body stat, the unit that it is stored in.
    stored_in: str | None = None


def csv_header(fields: list[CsvField]) -> str:
    return ";".join(["Date", *(f"{f.name} ({f.unit})" for f in fields)])


def csv_lines(totals: DataFrame, days: DataFrame, stats: DataFrame, fields: list[CsvField], weight: str = "weight") -> DataFrame:
    """user, day, line of the diary's export: a line for each day that has an item or a weight, blank where a field has no value.

    ``totals`` has user, day, nutrient, total; ``days`` the days with items; ``stats`` user, day, stat, value.
    """
    name = lambda f: f"_{fields.index(f)}"
    nutrients = totals.groupBy("user", "day").agg(*[F.max(F.when(F.col("nutrient") == f.name, F.col("total"))).alias(name(f)) for f in fields if not f.stored_in])
    body = [F.max(F.when(F.col("stat") == f.name, convert_unit(F.col("value"), F.lit(f.stored_in), F.lit(f.unit)))).alias(name(f)) for f in fields if f.stored_in]
    measured = stats.groupBy("user", "day").agg(*body, F.max(F.when(F.col("stat") == weight, F.col("value"))).alias("_weight"))
    listed = days.select("user", "day").distinct().withColumn("_items", F.lit(True)).join(measured, ["user", "day"], "full").where("_items or _weight is not null")
    rows = listed.join(nutrients, ["user", "day"], "left")
    cells = []
    for f in fields:
        value = F.coalesce(name(f), F.lit(0.0)) if f.name == "calories" else F.col(name(f))  # a day without items has no energy, but the other fields are unknown
        cells.append(F.coalesce(plain_number(value), F.lit("")))
    return rows.select("user", "day", F.concat_ws(";", locale_date(F.col("day")), *cells).alias("line"))


def redact_settings(settings: Column, secrets: tuple[str, ...] = SECRETS) -> Column:
    """JSON text of settings with every secret's value emptied."""
    blank = lambda c, name: F.regexp_replace(c, rf'("{name}"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}}\]]+)', '$1""')
    return reduce(blank, secrets, settings)


def write_backup(stores: dict[str, DataFrame], folder: str) -> None:
    """One folder of JSON lines for each store."""
    for name, rows in stores.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")


def backup_lines(stores: dict[str, DataFrame], version: int) -> DataFrame:
    """store, json: every record of every store, and the layout's version, as lines of one backup; null fields are left out."""
    lines = [rows.select(F.lit(name).alias("store"), F.to_json(F.struct(*rows.columns)).alias("json")) for name, rows in stores.items()]
    head = next(iter(stores.values())).sparkSession.range(1).select(F.lit("version").alias("store"), F.lit(str(version)).alias("json"))
    return reduce(DataFrame.union, lines, head)


def write_csv(rows: DataFrame, folder: str) -> None:
    """A diary export: semicolons, with a header, blank where there is no value."""
    rows.write.mode("overwrite").option("sep", ";").option("header", True).option("emptyValue", "").csv(folder)


def food_lists(texts: DataFrame, column: str = "json") -> DataFrame:
    """Foods of import files' JSON texts (version 1) that have name, unit and portion; others are left out.  Ids become barcodes."""
    rows = texts.select(F.from_json(column, _IMPORT).alias("j")).where("j.version = 1").select(F.inline("j.foodList"))
    portion = F.regexp_extract("portion", r"^\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    kept = rows.withColumn("portion", portion).where("name IS NOT NULL AND unit IS NOT NULL AND portion IS NOT NULL")
    nutrition = F.map_filter(F.transform_values("nutrition", lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    barcode = F.when(F.col("uniqueId").isNotNull(), F.concat(F.lit("custom_"), "uniqueId"))
    return kept.select("name", "brand", "unit", "portion", nutrition.alias("nutrition"), "categories", barcode.alias("barcode"), F.lit(True).alias("hidden"))


def read_food_list(spark: SparkSession, path: str) -> DataFrame:
    return food_lists(spark.read.text(path, wholetext=True), "value")


def backup_store(texts: DataFrame, store: str, schema: str, column: str = "json") -> DataFrame:
    """layout, and the rows of ``schema`` of one store, of backups' JSON texts; the barcode ``''`` is null, and ISO texts of the fields that are timestamps are read."""
    from pyspark.sql.types import StructType

    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))
    found = texts.select(F.from_json(column, f"version string, _version string, {store} array<struct<{fields}>>").alias("j"))
    rows = found.select(backup_version(F.col("j.version"), F.col("j._version")).alias("layout"), F.inline(f"j.{store}"))
    return rows.withColumn("barcode", F.nullif("barcode", F.lit(""))) if "barcode" in rows.columns else rows


def read_backup(spark: SparkSession, path: str, store: str, schema: str) -> DataFrame:
    """One store of backup files."""
    return backup_store(spark.read.text(path, wholetext=True), store, schema, "value").drop("layout")


def backup_version(version: Column, legacy: Column) -> Column:
    """Layout of a backup: as it says, else 27 where only the older field is there, else 24."""
    return F.coalesce(version.cast("int"), F.when(legacy.isNotNull(), 27), F.lit(24))


def write_ring_backup(rows: DataFrame, folder: str, day: Column) -> None:
    """A backup that keeps one folder for each weekday and overwrites only the one it is written on."""
    stamped = rows.withColumn("weekday", F.dayofweek(day) - 1)
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("weekday").json(folder)


def activity_payload(rows: DataFrame) -> DataFrame:
    """JSON to send for each user and day whose energy is positive: user, day, payload."""
    positive = rows.where("calories > 0")
    return positive.select("user", "day", F.to_json(F.struct(F.date_format("day", "yyyy-MM-dd").alias("id"), F.col("calories").alias("kcalConsumed"))).alias("payload"))
