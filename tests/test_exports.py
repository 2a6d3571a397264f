"""Exports, imports, whole statistics, label columns and the nearest values, on small fixtures by hand or against loops."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larder.functions import scalars as S
from larder.operators import documents as D
from larder.operators import edits as E
from larder.operators import labeltables as T
from larder.operators import nutrition as N
from larder.operators import series as Z
from larder.sources import exchange as X

DAY = date(2024, 1, 1)


def test_diary_lines(spark):
    totals = spark.createDataFrame([(1, DAY, "calories", 1234.5), (1, DAY, "fat", 0.0), (1, DAY, "salt", 9.0)], "user int, day date, nutrient string, total double")
    later = DAY + timedelta(1)
    days = spark.createDataFrame([(1, DAY), (1, DAY), (2, DAY)], "user int, day date")
    stats = spark.createDataFrame([(1, DAY, "waist", 80.0), (1, later, "weight", 70.0), (3, DAY, "waist", 1.0), (4, DAY, "weight", None)], "user int, day date, stat string, value double")
    fields = [X.CsvField("calories", "kcal"), X.CsvField("fat", "g"), X.CsvField("sugars", "g"), X.CsvField("waist", "inch", "cm")]
    assert X.csv_header(fields) == "Date;calories (kcal);fat (g);sugars (g);waist (inch)"
    got = {(r.user, r.day): r.line for r in X.csv_lines(totals, days, stats, fields).collect()}
    assert got == {(1, DAY): "01/01/2024;1234.5;0;;31.5", (1, later): "02/01/2024;0;;;", (2, DAY): "01/01/2024;0;;;"}
    assert X.csv_lines(totals.where("false"), days.where("false"), stats.where("false"), fields).collect() == []


def test_a_whole_statistic(spark):
    rows = [(1, DAY, 10.0), (1, DAY + timedelta(3), 13.0), (1, DAY + timedelta(5), 0.0), (2, DAY, 7.0), (3, DAY, None), (3, DAY + timedelta(1), float("nan"))]
    series = spark.createDataFrame(rows, "user int, day date, value double")
    got = sorted((tuple(r[c] for c in ("user", "index", "value", "moving", "average", "slope", "intercept")) for r in Z.statistic(series, ["user"], period=2).collect()), key=lambda r: r[:2])
    assert got == [(1, 0, 10.0, 10.0, 11.5, 1.0, 10.0), (1, 1, None, 10.0, 11.5, 1.0, 10.0), (1, 2, None, None, 11.5, 1.0, 10.0), (1, 3, 13.0, 13.0, 11.5, 1.0, 10.0), (2, 0, 7.0, 7.0, 7.0, None, None)]
    pounds = Z.statistic(series, ["user"], F.lit("kg"), F.lit("lb")).where("user = 2").first()
    assert pounds.value == 15.43


def test_the_column_that_is_shown(spark):
    columns = {1: [(0, "serving", 3), (1, "100", 1), (2, "100", 1)], 2: [(0, None, 1), (1, "serving", 9), (2, None, 2)], 3: [(0, "serving", 2), (1, "serving", 2)], 4: [(3, "100", 1)]}
    rows = [(image, column, basis, f"k{i}") for image, own in columns.items() for column, basis, n in own for i in range(n)]
    values = spark.createDataFrame(rows, "image_id int, column int, basis string, key string")
    assert {r.image_id: r.column for r in T.best_columns(values).collect()} == {1: 1, 2: 2, 3: 0, 4: 3}
    before = spark.createDataFrame([(1, "serving"), (2, "100"), (3, None)], "image_id int, basis string")
    assert {r.image_id: r.column for r in T.best_columns(values, before).collect()} == {1: 0, 2: 2, 3: 0, 4: 3}
    typed = spark.createDataFrame([(1, "12,5 g", " g "), (2, "", "ml"), (3, None, "ml"), (4, "x", "ml")], "image_id int, portion string, unit string")
    assert [(r.image_id, r.amount, r.unit) for r in T.reviewed_serving(typed).orderBy("image_id").collect()] == [(1, 12.5, "g"), (4, None, "ml")]


def test_dragged_items(spark):
    cases = [([1, 2, 3, 4], a, b) for a in range(-1, 5) for b in range(-1, 5)] + [([], 0, 0), ([1], 0, 0), (None, 0, 0)]

    def dragged(items, a, b):
        if items is None or not (0 <= a < len(items) and 0 <= b < len(items)):
            return items
        rest = items[:a] + items[a + 1 :]
        return rest[:b] + [items[a]] + rest[b:]

    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, xs array<int>, a int, b int")
    got = {r.i: r.m for r in rows.select("i", D.moved(F.col("xs"), F.col("a"), F.col("b")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [dragged(*c) for c in cases]


FOOD = "id long, barcode string, name string, portion double, nutrition map<string,double>, archived boolean, hidden boolean"


def test_the_reserved_food(spark):
    foods = spark.createDataFrame([(4, "1", "a", 100.0, {"fat": 1.0}, False, False)], FOOD)
    more, quick = E.with_quick_add(foods)
    row = more.where("barcode = 'quick-add'").first()
    assert (quick, row.id, row.portion, row.nutrition, row.archived, more.count()) == (5, 5, 1.0, {"calories": 1.0}, True, 2)
    assert E.with_quick_add(more)[1] == 5 and E.with_quick_add(more)[0].count() == 2 and E.with_quick_add(foods.where("false"))[1] == 1
    rows = spark.createDataFrame([(1, 100.0, "kcal"), (1, -30.25, "kcal"), (1, 418.4, "kJ"), (2, None, "kcal"), (2, float("nan"), "kcal")], "day int, energy double, unit string")
    items = E.quick_added(rows, quick, F.col("energy"), F.col("unit"))
    totals = {(r.day, r.nutrient): r.total for r in N.total_nutrition(items, more, ["day"], "disclose").collect()}
    assert totals == {(1, "calories"): 200.0, (1, "burned-calories"): 30.25, (1, "kilojoules"): pytest.approx(836.8, abs=0.01), (1, "burned-kilojoules"): pytest.approx(126.57, abs=0.01)}


def test_imported_foods(spark):
    foods = spark.createDataFrame([(1, "custom_7", "old", 1.0, None, False, False), (2, "custom_7", "second", 1.0, None, False, True), (3, "custom_8", "gone", 1.0, None, True, False)], FOOD)
    item = {"name": "n", "unit": "g", "portion": "50.5g", "uniqueId": "7", "nutrition": {"fat": "1"}}
    texts = [json.dumps({"version": 1, "foodList": [item, item | {"uniqueId": "8"}, item | {"uniqueId": None, "portion": 3}, {"name": "no unit", "portion": "1"}]}), json.dumps({"version": 3, "foodList": [item]}), "no json"]
    new = X.food_lists(spark.createDataFrame([(t,) for t in texts], "json string"))
    found = E.imported(foods, new, F.lit("2024-01-02").cast("date"))
    assert sorted((r.barcode or "", r.id or 0, r.hidden, r.portion, r.date_time) for r in found.collect()) == [("", 0, True, 3.0, date(2024, 1, 2)), ("custom_7", 1, False, 50.5, date(2024, 1, 2)), ("custom_8", 0, True, 50.5, date(2024, 1, 2))]


def test_uploads(spark):
    foods = [("0 1", "a&b é", None, 100.0, "g", {"kilojoules": 10.0, "fat": 1.5, "own": 3.0}), ("2", "x", "B", 30.0, "ml", {"calories": 7.25}), ("3", "y", "C", 100.0, "g", {})]
    rows = spark.createDataFrame(foods, "barcode string, name string, brand string, portion double, unit string, nutrition map<string,double>")
    one, two, three = (r.u for r in rows.select(X.product_upload("u", "p'", country="de").alias("u")).collect())
    start = "user_id=u&password=p'&lang=en&product_name_en="
    assert one == f"code=0%201&{start}a%26b%20%C3%A9&nutrition_data_per=100g&nutriment_energy=10&nutriment_energy_unit=kJ&nutriment_fat=1.5&nutriment_fat_unit=g&countries=de"
    assert two == f"code=2&{start}x&brands=B&nutrition_data_per=100g&serving_size=30%20ml&nutriment_energy=7.25&nutriment_energy_unit=kcal&countries=de"
    assert three == f"code=3&{start}y&brands=C&nutrition_data_per=100g&countries=de"
    per = rows.select(X.product_upload("u", "p", per_serving=True).alias("u")).collect()
    assert "nutrition_data_per=serving&serving_size=100%20g" in per[0].u


def test_backups_of_layouts(spark):
    texts = [json.dumps(x) for x in ({"version": 33, "foodList": [{"id": 1, "barcode": ""}]}, {"_version": 1, "foodList": [{"id": 2, "barcode": "b", "dateTime": "2024-03-01T10:00:00Z"}]}, {"foodList": []}, {"diary": [{"id": 9}]})]
    rows = X.backup_store(spark.createDataFrame([(t,) for t in texts], "json string"), "foodList", "id bigint, barcode string, dateTime timestamp").collect()
    assert sorted((r.layout, r.id, r.barcode, r.dateTime and r.dateTime.day) for r in rows) == [(27, 2, "b", 1), (33, 1, None, None)]
    stores = {"foodList": spark.createDataFrame([(1, None)], "id int, name string"), "diary": spark.createDataFrame([], "id int")}
    assert [(r.store, r.json) for r in X.backup_lines(stores, 34).collect()] == [("version", "34"), ("foodList", '{"id":1}')]


def test_plain_numbers(spark):
    numbers = [-1.005, 0.0, 1234567.1, 5.0, None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n double").select("i", S.plain_number(F.col("n")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == ["-1", "0", "1234567.1", "5", None]


def test_nearest_of_a_hot_key(spark):
    rng = random.Random(1)
    left = [("hot", i, float(rng.randrange(1000))) for i in range(1500)] + [("cold", 5000 + i, float(i)) for i in range(5)] + [("none", 9000, 1.0)]
    right = [("hot", i, float(rng.choice([rng.randrange(1000), 500, -50]))) for i in range(40)] + [("cold", 1, 2.0)]
    schema = "g string, id long, place double"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.id: r.nearest for r in Z.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"], "place").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {i: min(((abs(p - q), j) for g2, j, q in right if g2 == g), default=(0, None))[1] for g, i, p in left}
    assert found == want
