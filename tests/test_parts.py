"""Scalars, sources, sinks, goals and the stream, on small fixtures."""

import json
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from larder.functions import scalars as S
from larder.operators import goals as G
from larder.operators import labeltables
from larder.operators import nutrition as N
from larder.sources import exchange, fooddata
from larder.sources import views as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("x", "places", "want"), [(-2.5, 0, -2.0), (2.5, 0, 3.0), (1.005, 2, 1.0), (-0.001, 2, 0.0), (None, 2, None)])
def test_half_up(spark, x, places, want):
    assert value(spark, S.half_up(F.lit(x).cast("double"), places)) == want


@pytest.mark.parametrize(("a", "b"), list(S.UNIT_FACTORS))
def test_units_go_and_come_back(spark, a, b):
    there = S.convert_unit(F.lit(7.0), F.lit(a), F.lit(b))
    assert value(spark, S.convert_unit(there, F.lit(b), F.lit(a))) == pytest.approx(7.0)
    assert value(spark, S.convert_unit(F.lit(7.0), F.lit(a), F.lit("furlong"))) is None


def test_texts(spark):
    assert value(spark, S.serving_amount(F.lit("1 1/3 cup"))) == 0.333
    assert value(spark, S.leading_number(F.lit("200g"))) == 200.0
    assert value(spark, S.normalise_label(F.lit("  Größe / Äpfel-Saft  "))) == "grosse apfel saft"
    assert value(spark, S.html_unescape(S.html_escape(F.lit("a<b> & \"c\" 'd'")))) == "a<b> & \"c\" 'd'"


FOODS = "id long, portion double, nutrition map<string,double>"
ITEMS = "day int, food_id long, portion double, quantity double"


def test_modes(spark):
    foods = spark.createDataFrame([(1, 100.0, {"calories": 50.0, "fat": -1.0}), (2, 1.0, {"calories": -1.0, "kilojoules": -4.0})], FOODS)
    items = spark.createDataFrame([(1, 1, 200.0, 1.0), (1, 2, 30.0, 1.0), (1, 9, 5.0, 1.0)], ITEMS)
    totals = {m: {r.nutrient: r.total for r in N.total_nutrition(items, foods, ["day"], m).collect()} for m in N.MODES}
    assert totals["ignore"]["calories"] == 100.0
    assert totals["disclose"] == {"calories": 100.0, "burned-calories": 30.0, "kilojoules": 418.4, "burned-kilojoules": 120.0}
    assert totals["subtract"]["calories"] == totals["ignore"]["calories"] - totals["disclose"]["burned-calories"]
    assert all("fat" not in t for t in totals.values())


def test_auto_adjust_against_a_loop(spark):
    start = date(2024, 1, 1)
    rows = [("u", start + timedelta(days=n), 1900.0 + 37 * n % 400, 2000.0) for n in range(30) if n % 4]
    actual = spark.createDataFrame(rows, "user string, day date, total double, goal double")
    for trailing in (3, 10):
        got = {r.day: r.adjusted for r in G.auto_adjust(actual, ["user"], trailing=trailing).collect()}
        for _, day, _, goal in rows:
            over = sum(t - g for _, other, t, g in rows if 0 < (day - other).days <= trailing)
            assert got[day] == max(0.0, float(int(goal - over / 2 + 0.5)))


def test_food_list_and_backup(spark, tmp_path):
    food = {"name": "a", "unit": "g", "portion": "200g", "uniqueId": "7", "nutrition": {"fat": "1.5", "salt": ""}, "categories": ["x"]}
    (tmp_path / "list.json").write_text(json.dumps({"version": 1, "foodList": [food, {"name": "no unit", "portion": 1}]}))
    (tmp_path / "old.json").write_text(json.dumps({"version": 2, "foodList": [food]}))
    row = exchange.read_food_list(spark, str(tmp_path / "*.json")).collect()
    assert [(r.name, r.portion, r.nutrition, r.barcode, r.hidden) for r in row] == [("a", 200.0, {"fat": 1.5}, "custom_7", True)]
    (tmp_path / "backup").mkdir()
    (tmp_path / "backup" / "b.json").write_text(json.dumps({"foodList": [{"id": 1, "barcode": ""}, {"id": 2, "barcode": "5"}]}))
    rows = exchange.read_backup(spark, str(tmp_path / "backup"), "foodList", "id bigint, barcode string").collect()
    assert {(r.id, r.barcode) for r in rows} == {(1, None), (2, "5")}


def test_csv_and_secrets(spark, tmp_path):
    exchange.write_csv(spark.createDataFrame([(1, "a"), (2, None)], "id int, name string").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text().splitlines() == ["id;name", "1;a", "2;"]
    settings = F.lit('{"off-password": "a\\"b,c", "usda-key":5, "theme":"dark"}')
    assert json.loads(value(spark, exchange.redact_settings(settings))) == {"off-password": "", "usda-key": "", "theme": "dark"}


def test_products_branches(spark):
    def found(prefer_100g=False, **more):
        row = json.dumps({"code": "0123", "product_name": "x", "brands": "B, C"} | more)
        rows = fooddata.products(spark.createDataFrame([(row,)], "json string"), prefer_100g=prefer_100g).collect()
        return {(r.portion, r.unit) for r in rows}, {r.nutrient: r.value for r in rows}

    both = {"energy_serving": "100", "fat_serving": "", "energy_100g": 418.4, "energy-kcal_100g": "99.5", "fat_100g": "2", "salt_100g": None}
    assert found(serving_size="1/2 cup", nutriments=both) == ({(0.5, "cup")}, {"calories": 24.0, "kilojoules": 100.0})
    assert found(True, serving_size="30 ml", nutriments=both) == ({(100.0, "ml")}, {"calories": 99.5, "kilojoules": 418.4, "fat": 2.0})
    assert found(serving_size="a slice", nutriments=both)[0] == {(100.0, "g")}
    assert found(serving_size="12,5 G", nutriments={"energy-kcal_serving": "7.9", "energy_serving": 1, "sodium_serving": 0.5}) == ({(12.5, "g")}, {"calories": 7.0, "kilojoules": 1.0, "sodium": 500.0})
    assert found(quantity="1 Bottle", nutriments={"energy-kcal": 5, "energy": 20, "fat": 3}) == ({(1.0, "Bottle")}, {"calories": 5.0, "kilojoules": 20.0})
    assert found(quantity="", nutriments=both | {"energy_100g": None})[1] == {"fat": 2.0}
    prepared = {"energy_prepared_100g": "10", "fat_prepared_100g": 1, "fat_100g": 9, "alcohol_prepared_100g": 5}
    assert found(serving_size="(5 cl)", nutriments=prepared) == ({(100.0, "ml")}, {"calories": 2.0, "kilojoules": 10.0, "fat": 1.0, "alcohol": pytest.approx(3.9465)})
    assert found(nutriments=None) == found(nutriments={}) == found(quantity="none", nutriments={"energy": 1}) == (set(), {})


def test_foods_branches(spark):
    energy = {"nutrientName": "Energy", "unitName": "KCAL", "value": 239}

    def found(prefer_100g=False, nutrients=(energy,), **more):
        row = json.dumps({"fdcId": 1, "description": "x", "foodNutrients": list(nutrients)} | more)
        rows = fooddata.usda_foods(spark.createDataFrame([(row,)], "json string"), prefer_100g=prefer_100g).collect()
        return {(r.portion, r.unit) for r in rows}, {r.nutrient: r.value for r in rows}

    measure = lambda text, grams: {"disseminationText": text, "gramWeight": grams}
    kj = {"nutrientName": "Energy", "unitName": "kJ", "value": 1000}
    iu = {"nutrientName": "Vitamin D (D2 + D3), International Units", "unitName": "IU", "value": 40}
    assert found(servingSize=3, servingSizeUnit="cup", nutrients=(kj, energy, iu)) == ({(100.0, "g")}, {"calories": 239.0, "kilojoules": 1000.0})
    assert found(nutrients=(kj,)) == (set(), {}) and found(nutrients=()) == (set(), {})
    assert found(servingSize=50, servingSizeUnit="ml")[0] == {(50.0, "ml")} and found(True, servingSize=50, servingSizeUnit="ml")[0] == {(100.0, "ml")}
    assert found(foodMeasures=[measure("1 cup", 244), measure("2 tbsp", 30)]) == ({(2.0, "tbsp (\u200e30\u2009g)")}, {"calories": 72.0, "kilojoules": 301.0})
    assert found(foodMeasures=[measure(fooddata.UNSPECIFIED, 100)])[0] == {(100.0, "g")}
    assert found(foodMeasures=[measure("1 cup", 244), measure("big", 300), measure(fooddata.UNSPECIFIED, 100)])[0] == {(300.0, "g")}
    assert found(foodMeasures=[])[0] == {(100.0, "g")}


def test_stream_equals_batch(spark, tmp_path):
    from larder.streaming.rollup import daily_totals, stream_daily_totals

    events = V.table(spark, SMALL, "events")
    folder = tmp_path / "events"
    events.repartition(3).write.parquet(str(folder))
    stream = stream_daily_totals(spark, str(folder), events.schema, late="0 days")
    q = stream.writeStream.format("memory").queryName("rollup").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.day, r.event_type): (r.n, r.total) for r in spark.table("rollup").collect()}
    assert got == {(r.day, r.event_type): (r.n, r.total) for r in daily_totals(events).collect()}


def test_small_texts(spark):
    assert value(spark, S.language_tag(F.lit("EN-gb"))) == "en-GB" and value(spark, S.language_tag(F.lit("de"))) == "de"
    assert value(spark, S.goal_unit(F.lit("waist"), F.lit(False))) == "cm" and value(spark, S.goal_unit(F.lit("fat"), F.lit(True))) == "%"
    assert value(spark, S.spoken_numbers(F.array(F.lit(1.5), F.lit(-2.0)), ",")) == "1,5, −2"
    assert value(spark, S.age_in_years(F.lit("2000-01-02").cast("date"), F.lit("2020-01-01").cast("date"))) == 19
    assert value(spark, S.effective_weight_goal(F.lit(2000.0), F.lit(80), F.lit(70))) == 1600.0
    assert value(spark, exchange.backup_version(F.lit(None).cast("int"), F.lit(3))) == 27


def test_ring_backup_keeps_other_days(spark, tmp_path):
    folder = str(tmp_path / "ring")
    for day, name in (("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-08", "c")):
        exchange.write_ring_backup(spark.createDataFrame([(name,)], "name string"), folder, F.lit(day).cast("date"))
    assert {(r.weekday, r.name) for r in spark.read.json(folder).collect()} == {(1, "c"), (2, "b")}
    rows = spark.createDataFrame([("u", date(2024, 1, 1), 5.0), ("u", date(2024, 1, 2), -1.0)], "user string, day date, calories double")
    assert [json.loads(r.payload) for r in exchange.activity_payload(rows).collect()] == [{"id": "2024-01-01", "kcalConsumed": 5.0}]


def test_nearest_against_all_pairs(spark):
    from larder.operators.series import nearest

    left = [(n % 2, n, float(n * 7 % 13)) for n in range(40)]
    right = [(n % 2, n, float(n * 5 % 11) + 0.5) for n in range(30)]
    schema = "g int, id long, place double"
    got = {r.id: r.nearest for r in nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"], "place").collect()}
    assert got == {i: min((abs(p - q), j) for h, j, q in right if h == g)[1] for g, i, p in left}


def test_alignment_costs_least():
    """Every order-keeping choice of pairs is tried; none costs less than the one that is found."""
    rng = np.random.default_rng(5)

    def cost(names, rows, of):
        pairs = [(k, j) for j, k in enumerate(of) if k is not None]
        assert pairs == sorted(pairs) and len({k for k, _ in pairs}) == len(pairs)
        far = [abs(names[k] - rows[j]) / 10 for k, j in pairs]
        assert all(f <= labeltables.REACH for f in far)
        return sum(f * f for f in far) + len(names) + len(rows) - 2 * len(pairs)

    def least(names, rows):
        if not len(names) or not len(rows):
            return len(names) + len(rows)
        far = abs(names[0] - rows[0]) / 10
        paired = far * far + least(names[1:], rows[1:]) if far <= labeltables.REACH else math.inf
        return min(paired, 1 + least(names[1:], rows), 1 + least(names, rows[1:]))

    for n, m in ((0, 0), (0, 3), (3, 0), (1, 1), (4, 5), (5, 3), (5, 5)):
        names, rows = np.sort(rng.uniform(0, 60, n)), np.sort(rng.uniform(0, 60, m))
        assert cost(names, rows, labeltables.aligned(names, rows, 10.0)) == pytest.approx(least(names, rows))


def test_labels_without_use(spark):
    """No line, blank lines, null texts, and words without a number give no value; a clashing extra column does no harm."""
    schema = "image_id long, text string, cx double, cy double, h double, angle double, key string"
    rows = [(1, None, 0.0, 0.0, 20.0, 0.0, "k"), (1, " ", 0.0, 9.0, 20.0, None, "k"), (2, "Fat", 0.0, 0.0, 20.0, None, "k"), (2, "Fat", 0.0, 0.0, 20.0, None, "k")]
    for some in ([], rows):
        lines = spark.createDataFrame(some, schema)
        assert labeltables.parse_labels(lines).collect() == []
        assert labeltables.table_bounds(lines).collect() == []


def test_serving_is_told_by_values(spark):
    """The second column has no head: its values are a fifth of the first's, so it is a serving of 20."""
    texts = [("per 100 g", 300, 0)]
    for k, (name, value) in enumerate((("Fat", 10), ("Sugars", 20), ("Protein", 30))):
        texts += [(name, 40, 30 * k + 30), (f"{value} g", 300, 30 * k + 30), (f"{value // 5} g", 700, 30 * k + 30)]
    lines = spark.createDataFrame([(1, t, float(x), float(y), 20.0, 0.0) for t, x, y in texts], "image_id long, text string, cx double, cy double, h double, angle double")
    found = {(r["column"], r.key): (r.basis, r.amount, r.value) for r in labeltables.parse_labels(lines).collect()}
    assert found[0, "fat"] == ("100", 100.0, 10.0) and found[1, "fat"] == ("serving", 20.0, 2.0) and len(found) == 6
