"""Numbers over partitions, goals as of a day, and changes of documents, each against a plain loop or by hand."""

import html
import random
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from larder.functions import scalars as S
from larder.operators import documents as D
from larder.operators import edits as E
from larder.operators import goals as G
from larder.operators import labels as B
from larder.operators import labeltables as T
from larder.operators.numbering import numbered
from larder.plans import registry
from larder.plans import texts as plans
from larder.sources import migrations as M


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


# Numbers


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_are_consecutive_in_order(spark, partitions):
    rng = random.Random(partitions)
    names = [rng.choice(["", "b", "ß", "a" * 9, None]) for _ in range(40)] + [f"n{rng.randrange(10**6)}" for _ in range(500)]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int").repartition(partitions)
    found = numbered(rows, ["name", "i"], after=100).collect()
    want = sorted(((n is not None, n or "", i) for i, n in enumerate(names)))
    assert [(r.name is not None, r.name or "", r.i) for r in sorted(found, key=lambda r: r.number)] == want
    assert sorted(r.number for r in found) == list(range(101, 101 + len(names)))


def test_numbers_of_equal_rows_and_of_none(spark):
    rows = spark.createDataFrame([("x",)] * 50, "name string")
    assert sorted(r.number for r in numbered(rows, ["name"]).collect()) == list(range(1, 51))
    assert numbered(rows.where("false"), ["name"]).collect() == []


def test_no_task_numbers_all_rows(spark):
    new = spark.range(1000).select(F.lit(None).cast("long").alias("id"), F.col("id").cast("string").alias("name"))
    found = E.insert_all(spark.createDataFrame([(5, "old")], "id long, name string"), new)
    assert sorted(r.id for r in found.collect()) == [5, *range(6, 1006)]
    # The one window without a key runs over a count for each partition.
    alone = [line for line in plan(found).split("== Physical Plan ==")[1].split("== Initial Plan ==")[-1].splitlines() if "SinglePartition" in line]
    assert len(alone) <= 1


def test_remote_foods_are_resolved_or_inserted(spark):
    schema = "id long, barcode string, name string, archived boolean, hidden boolean"
    foods = spark.createDataFrame([(1, "11", "a", False, True), (2, "11", "b", False, False), (3, "12", "c", True, False), (4, None, "d", None, False)], schema)
    chosen = [(1, "11", "a", False, True), (None, "11", "new name", False, False), (None, "12", "z", False, False), (None, "12", "y", False, False), (None, None, "q", False, False), (None, None, "q", False, False)]
    after, resolved = E.resolve_or_insert(foods, spark.createDataFrame(chosen, schema))
    got = {r.id: (r.barcode, r.name, r.hidden) for r in after.collect()}
    assert got == {1: ("11", "a", False), 2: ("11", "b", False), 3: ("12", "c", False), 4: (None, "d", False), 5: (None, "q", False), 6: (None, "q", False), 7: ("12", "y", False)}
    assert sorted((r.id, r.name) for r in resolved.collect()) == [(1, "a"), (1, "new name"), (5, "q"), (6, "q"), (7, "y"), (7, "z")]
    after, resolved = E.resolve_or_insert(foods.where("false"), spark.createDataFrame([], schema))
    assert after.collect() == resolved.collect() == []


# Goals

GOALS = "user long, stat string, seq int, effective_from date, shared boolean, percent boolean, goal array<double>"


def test_goals_against_a_loop(spark):
    rng, start = random.Random(3), date(2024, 1, 1)
    goals, days = [], []
    for user in range(12):
        for stat in ("calories", "fat")[: rng.randrange(3)]:
            for seq in range(rng.randrange(1, 5)):
                goals.append((user, stat, seq, rng.choice([None, start + timedelta(rng.randrange(40))]), True, False, [float(seq)] * 7))
        days += [(user, start + timedelta(rng.randrange(-3, 45))) for _ in range(20)]
    found = G.goal_asof(spark.createDataFrame(days, "user long, day date"), spark.createDataFrame(goals, GOALS), ["user"])
    want = {}
    for user, day in days:
        for u, stat, seq, begins, *_ in goals:
            if u == user and (begins is None or begins <= day):
                want[user, day, stat] = seq  # the later in the list wins
    rows = found.collect()
    assert {(r.user, r.day, r.stat): r.seq for r in rows} == want and len(rows) == len(want)


def test_goals_of_many_users_without_pairs(spark):
    users = spark.range(100_000).select(F.col("id").alias("user"))
    week = F.array(*[F.lit(1.0)] * 7)
    goals = users.select("user", F.lit("calories").alias("stat"), F.lit(0).alias("seq"), F.lit(None).cast("date").alias("effective_from"), F.lit(True).alias("shared"), F.lit(False).alias("percent"), week.alias("goal"))
    found = G.day_goal(users.select("user", F.lit("2024-01-01").cast("date").alias("day")), goals, ["user"])
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert found.count() == 100_000


def test_goals_set_twice_on_a_day(spark):
    goals = spark.createDataFrame([(1, "fat", 0, None, 1.0), (1, "fat", 1, date(2024, 1, 1), 2.0)], "user long, stat string, seq int, effective_from date, first double")
    new = spark.createDataFrame([(1, "fat", None, 9.0), (1, "fat", date(2024, 2, 1), 8.0), (2, "fat", date(2024, 1, 1), 7.0)], "user long, stat string, effective_from date, first double")
    found = E.set_goal(goals, new, ["user", "stat"])
    assert sorted((r.user, r.seq, r.first) for r in found.collect()) == [(1, 0, 9.0), (1, 1, 2.0), (1, 2, 8.0), (2, 0, 7.0)]
    left = E.delete_goal(found, found.where("seq = 0"), ["user", "stat"])
    assert sorted((r.user, r.seq) for r in left.collect()) == [(1, 1), (1, 2)]


# Documents


def test_deep_merge_against_a_recursion(spark):
    left = {"a": {"b": {"c": 1, "d": None}, "only": "l"}, "m": {"k": {"x": 1}, "l": {"x": 5}}, "xs": [{"n": 1}, {"n": 2}], "day": date(2024, 1, 1), "kind": 7}
    right = {"a": {"b": {"c": None, "d": 4, "e": 5}}, "m": {"k": {"y": 2}, "z": {"y": 3}}, "xs": [{"n": 9}], "day": date(2025, 1, 1), "kind": "now a text", "new": True}
    ltype = "a struct<b:struct<c:int,d:int>,only:string>, m map<string,struct<x:int>>, xs array<struct<n:int>>, day date, kind int"
    rtype = "a struct<b:struct<c:int,d:int,e:int>>, m map<string,struct<y:int>>, xs array<struct<n:int>>, day date, kind string, new boolean"
    rows = spark.createDataFrame([(left, right), (left, None), (None, right), (None, None)], f"l struct<{ltype}>, r struct<{rtype}>")
    both, ours, theirs, none = (r.m.asDict(True) if r.m else None for r in rows.select(D.merge_columns(rows, "l", "r").alias("m")).collect())
    assert both == {
        "a": {"b": {"c": 1, "d": 4, "e": 5}, "only": "l"}, "m": {"k": {"x": 1, "y": 2}, "l": {"x": 5, "y": None}, "z": {"x": None, "y": 3}},
        "xs": [{"n": 9}, {"n": 2}], "day": date(2025, 1, 1), "kind": "now a text", "new": True,
    }
    assert ours["a"]["b"] == {"c": 1, "d": None, "e": None} and ours["kind"] == "7" and ours["xs"] == left["xs"] and ours["new"] is None
    assert theirs["a"] == {"b": right["a"]["b"], "only": None} and theirs["m"]["k"] == {"x": None, "y": 2} and none is None


def loop(items, edits):
    items = list(items)
    for _, op, place, item, group, to in sorted(edits, key=lambda e: e[0]):
        if op == "add":
            items.append(item)
        elif op == "update" and place is not None and place >= 0:
            items[place : place + 1] = [item]
        elif op == "remove" and place is not None and place >= 0:
            del items[place : place + 1]
        elif op == "move":
            items = [(i, to if c == group else c) for i, c in items]
    return items


def test_edits_against_a_loop(spark):
    rng = random.Random(5)
    item = lambda: (rng.randrange(100), rng.randrange(3))
    entries = {e: [item() for _ in range(rng.randrange(4))] for e in range(40)}
    log = []
    for e in range(50):  # ten entries are not there before
        for seq in range(rng.randrange(9)):
            log.append((e, seq, rng.choice(["add", "update", "remove", "move"]), rng.choice([None, -1, 0, 1, 2, 9]), item(), rng.randrange(3), rng.randrange(3)))
    kind = "struct<id:int,category:int>"
    rows = spark.createDataFrame(list(entries.items()), f"entry int, items array<{kind}>")
    edits = spark.createDataFrame(log, f"entry int, seq int, op string, place int, item {kind}, group int, to int")
    got = {r.entry: [tuple(i) for i in r["items"]] for r in D.apply_edits(rows, edits).collect()}
    want = {e: loop(entries.get(e, []), [x[1:] for x in log if x[0] == e]) for e in {*entries, *(x[0] for x in log)}}
    assert got == want
    assert D.apply_edits(rows.where("false"), edits.where("false")).collect() == []


def test_goals_are_nested_once(spark):
    flat = {"fat-show-in-diary": "true", "fat": '["1","2"]', "fat-minimum-goal": "false", "first-day-of-week": "1", "waist": '["80"]', "waist-show-in-stats": "true", "odd": "1"}
    row = spark.createDataFrame([("3", None, None, flat, ["fat"], None), ("9", None, None, flat, ["fat"], None), (None, {"dark-mode": "true"}, None, None, None, None)], D.OLD_SETTINGS)
    old, new, bare = D.migrated_settings(row, ["fat", "salt"]).collect()
    stats = {k: v.asDict(True) for k, v in old.stats.items()}
    assert stats["fat"] == {"show_in_diary": True, "show_in_stats": None, "goal_list": [{"shared_goal": None, "auto_adjust": None, "minimum_goal": False, "percent_goal": None, "goal": ["1", "2"]}]}
    assert set(stats) == {"fat", "waist"} and stats["waist"]["show_in_stats"] is None and old.body_visibility == {"waist": True}
    assert old.general == {"first-day-of-week": "1"} and old.order == ["fat", "salt"] and old.migrated
    assert new.stats is None and new.order == ["fat"] and not new.migrated
    assert bare.appearance == {"mode": "dark"} and bare.stats is None and bare.schemaVersion == "9"


def test_migrations_change_nothing_twice(spark):
    schema = "version int, id long, name string, brand string, portion string, unit string, nutrition map<string,double>, barcode string, originalBarcode string, image_url string"
    rows = [
        (None, 1, "a%20b", None, "12.5 g", None, {"carbs": 1.0, "carbohydrates": 9.0, "sugar": 2.0}, "0123", None, "undefined"),
        (30, 2, "a%20b", "x%u2603", "7", "ml", {"protein": 1.0}, "fdcId_9", None, ""),
        (34, 3, "c", None, "7", "ml", None, "0123", None, None),
        (29, 4, None, None, None, None, {}, None, None, None),
        (29, 5, "d", "%E9", "100", "g", None, "", None, "u"),
    ]
    once = M.migrate_foods(spark.createDataFrame(rows, schema))
    a, b, c, e, f = once.orderBy("id").collect()
    assert (a.name, a.portion, a.unit, a.nutrition, a.barcode, a.originalBarcode, a.image_url) == ("a b", 125.0, "g", {"carbohydrates": 1.0, "sugars": 2.0}, "123", "0123", None)
    assert (b.name, b.portion, b.nutrition, b.barcode, b.originalBarcode) == ("a%20b", 7.0, {"protein": 1.0}, "fdcId_9", "9")
    assert (c.barcode, c.originalBarcode) == ("0123", None) and (e.name, e.portion, e.nutrition) == (None, None, {}) and (f.brand, f.portion, f.unit) == ("é", 100.0, "g")
    again = M.migrate_foods(once.withColumn("portion", F.col("portion").cast("string")))
    assert sorted(map(str, again.select(once.columns).collect())) == sorted(map(str, once.collect()))


def test_flat_entries_become_days(spark):
    at = lambda day, hour: datetime(2024, 1, day, hour)
    schema = f"user int, version int, date_time timestamp_ntz, category int, portion string, quantity double, food_id long, recipe_id long, calories double, items array<{M.ITEM}>, stats map<string,double>"
    rows = [
        (1, 29, at(1, 9), 1, "150.7 g", None, 5, None, None, None, None), (1, 29, at(1, 8), 0, "Quick Add", None, None, None, 250.0, None, None),
        (1, 29, at(2, 8), 0, "2 slices", 3.0, None, 6, None, None, None), (2, 30, at(1, 23), None, None, None, None, None, None, [], {"weight": 1.0}),
    ]
    weights = spark.createDataFrame([(1, at(1, 7), 80.0), (1, at(1, 20), 81.0), (1, at(5, 0), 9.0)], "user int, date_time timestamp_ntz, weight double")
    found = {(r.user, r.day.day): r for r in M.migrate_diary(spark.createDataFrame(rows, schema), weights, 99).collect()}
    assert set(found) == {(1, 1), (1, 2), (2, 1)}
    assert [tuple(i) for i in found[1, 1]["items"]] == [(99, "food", 1.0, None, 250.0, 0), (5, "food", 150.0, "g", 1.0, 1)]
    assert found[1, 1].stats == {"weight": 81.0} and [tuple(i) for i in found[1, 2]["items"]] == [(6, "recipe", 2.0, "slices", 3.0, 0)] and not found[1, 2].stats
    assert found[2, 1]["items"] == [] and found[2, 1].stats == {"weight": 1.0}


def test_activities_are_added_once(spark):
    at = datetime(2024, 1, 1, 8)
    fetched = spark.createDataFrame([(1, at.date(), at, 300.0, None)] * 2 + [(1, at.date(), at, 300.0, "run"), (1, at.date(), None, 5.0, "x")], "user int, day date, date_time timestamp_ntz, calories double, name string")
    stored = spark.createDataFrame([(1, at.date(), at, 0, -300.0, "run"), (1, at.date(), None, 0, -5.0, "y"), (2, at.date(), at, 0, -300.0, None)], "user int, day date, date_time timestamp_ntz, category int, quantity double, description string")
    assert {(r.quantity, r.description) for r in E.new_activities(fetched, stored).collect()} == {(-300.0, None), (-5.0, "x")}
    assert E.new_activities(fetched, stored).count() == 2 and "NestedLoop" not in plan(E.new_activities(fetched, stored))


# Labels and character references


def test_character_references_against_the_standard(spark):
    rng = random.Random(1)
    texts = ["a&#233;b", "&#x2603;", "&amp;lt;", "&notit;", "&copy 2", "&CounterClockwiseContourIntegral;", "&nosuch;", "&", "&#0;", "&#x80;", "&#1114112;", "&#x1F600;", "&ampamp;", "&#xD800;", "&#;", "&fjlig;", "&#00000000065;", "", None]
    texts += ["".join(rng.choice(["&", "#", "x", "amp", "lt", ";", "65", "a", "not", "in", "é", "&#65", "&copy", " "]) for _ in range(rng.randrange(9))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.d for r in rows.select("i", S.html_unescape(F.col("t")).alias("d")).collect()}
    assert all(got[i] == (None if t is None else html.unescape(t)) for i, t in enumerate(texts))


def test_pages_are_decoded_as_in_sql(spark, tmp_path):
    """References that are cut off, or that the SQL does not name, stay as they are."""
    texts = ["a &amp", "a &am", "&ampx", "&amp;lt; &amp;amp;", "&eacute; &copy &#38; &#x27;", "&lt;&gt;&quot;&#39;&nbsp;&copy;&middot;&amp;", "&#039;", "&&amp;;", "&AMP; &notit;", "&", "", None]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.decoded for r in registry.QUERIES["html_unescape"](spark, str(tmp_path)).collect()}
    sql = registry.ORACLES["html_unescape"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(duckdb.sql(sql).fetchall())


def plain_match(text):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    best = (0.0, None)
    for key, names in B.synonyms().items():
        for name in names:
            if text == name:
                score = 1.0
            elif f" {name} " in f" {text} ":
                score = 0.9
            elif len(name) >= 4 and abs(len(text) - len(name)) <= 3:
                score = 1 - distance(text, name) / max(len(text), len(name))
            elif len(name) >= 5:
                words, n = text.split(" "), name.count(" ") + 1
                runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
                score = 0.95 * max([1 - distance(r, name) / max(len(r), len(name)) for r in runs], default=0)
            else:
                score = 0.0
            if score + len(name) / 1000 > best[0] + 1e-9:
                best = (score + len(name) / 1000, key)
    return best[1] if best[0] >= 0.75 else None


def test_label_names_against_a_plain_match(spark):
    rng, names = random.Random(2), [n for own in B.synonyms().values() for n in own]
    texts = []
    for _ in range(150):
        name = list(rng.choice(names))
        for _ in range(rng.randrange(3)):
            name[rng.randrange(len(name))] = rng.choice("abcdei")
        texts.append(" ".join([*rng.sample(["qq", "zz", "nahr", "wert", "pro"], rng.randrange(4)), "".join(name), *rng.sample(["xx", "yy"], rng.randrange(3))]))
    texts = [" ".join(t.split()) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.k for r in rows.select("i", B.label_key(F.col("t")).alias("k")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != plain_match(t)] == []


def test_names_with_more_edits_than_lengths_are_apart(spark):
    """As long as its name but for three letters, a text may have four edits; a higher least likeness tells the same names from there on."""
    texts = ["kohlednhydrat xx", "qq srhrfach ungesattite fettsauren", "saturated fatty acids", "acids", "zz vrzadigde vetzuren", "total sugers and fibre", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("t", B.label_key(F.col("t")).alias("k"), B.nearest_name(F.col("t")).alias("m"), B.nearest_name(F.col("t"), least=0.85).alias("w")).collect()
    assert all(r.k == plain_match(r.t) for r in found) and found[0].k == "carbohydrates"
    likely = lambda m: m if m and (m.likeness or 0) >= 0.85 else None
    assert [likely(r.m) for r in found] == [likely(r.w) for r in found] and likely(found[1].w).key == "polyunsaturated-fat"


def test_each_text_of_labels_is_read_once(spark):
    """However many lines have it; and the labels of a table that is one split are in several tasks."""
    texts = ["Fat", "3,5 g", "per 100 g", "#~#"]
    lines = spark.range(4000).select((F.col("id") % 500).alias("image_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("text"), F.lit(0.0).alias("cx"), F.col("id").cast("double").alias("cy"), F.lit(20.0).alias("h"), F.lit(0.0).alias("angle"))
    read = {r.text: (r.name and r.name.key, [t.value for t in r.tokens], r.is_head) for r in T.read_texts(lines).collect()}
    assert read == {"Fat": ("fat", [], False), "3,5 g": (None, [3.5], False), "per 100 g": (None, [100.0], True), "#~#": (None, [], False)}
    assert T.read_texts(lines).count() == 4 and "regexp_extract_all" not in plan(T.grouped_lines(lines))
    assert plans._photo(spark, SMALL, [("Fat", 0, 0)]).rdd.getNumPartitions() > 1


def test_further_names_are_a_parameter(spark):
    rows = spark.createDataFrame([(1, "telitett zsirsavak")], "id int, text string")
    assert [r.key for r in B.synonym_match(rows, {"saturated-fat": ("telitett zsirsavak",)}).collect()] == ["saturated-fat"]
    assert len(B.synonyms()) == 35
