"""Documents with nested fields: deep merges, ordered edits of an array, and settings with keys of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructField, StructType

# Deep merges


def merged_type(left: DataType, right: DataType) -> DataType:
    """Type of a deep merge: the fields of both sides, the left's first; where only one side is nested, the right's type."""
    if isinstance(left, StructType) and isinstance(right, StructType):
        there = {f.name: f.dataType for f in right.fields}
        fields = [StructField(f.name, merged_type(f.dataType, there[f.name]) if f.name in there else f.dataType) for f in left.fields]
        return StructType(fields + [StructField(f.name, f.dataType) for f in right.fields if f.name not in left.fieldNames()])
    if isinstance(left, MapType) and isinstance(right, MapType):
        return MapType(right.keyType, merged_type(left.valueType, right.valueType))
    if isinstance(left, ArrayType) and isinstance(right, ArrayType):
        return ArrayType(merged_type(left.elementType, right.elementType))
    return right


def deep_merge(left: Column, right: Column, left_type: DataType, right_type: DataType) -> Column:
    """Both sides' fields at any depth; where both have one that is not nested, the right's wins.  A null field is one that is not there;
    where one side is nested and the other is not, the right is taken as it is.

    The merge is written out from the two types, so it is one expression without a function call for a row.  Structs are
    merged field by field, maps key by key, arrays place by place; dates and other plain values are replaced.
    """
    kind, nested = merged_type(left_type, right_type), (StructType, MapType, ArrayType)
    if isinstance(left_type, StructType) and isinstance(right_type, StructType):
        ours, theirs = ({f.name: f.dataType for f in t.fields} for t in (left_type, right_type))

        def field(name: str) -> Column:
            if name in ours and name in theirs:
                return deep_merge(left[name], right[name], ours[name], theirs[name])
            return left[name] if name in ours else right[name]

        both = F.struct(*[field(name).alias(name) for name in kind.fieldNames()])
        return F.when(left.isNotNull() | right.isNotNull(), both)
    if isinstance(left_type, MapType) and isinstance(right_type, MapType):
        sides = [F.coalesce(c, F.create_map().cast(t)) for c, t in ((left, left_type), (right, right_type))]
        both = F.map_zip_with(*sides, lambda _, a, b: deep_merge(a, b, left_type.valueType, right_type.valueType))
    elif isinstance(left_type, ArrayType) and isinstance(right_type, ArrayType):
        sides = [F.coalesce(c, F.array().cast(t)) for c, t in ((left, left_type), (right, right_type))]
        both = F.zip_with(*sides, lambda a, b: deep_merge(a, b, left_type.elementType, right_type.elementType))
    elif left_type == right_type:
        return F.coalesce(right, left)
    else:
        return right if isinstance(left_type, nested) or isinstance(right_type, nested) else F.coalesce(right, left.cast(right_type))
    return F.when(left.isNotNull() | right.isNotNull(), both)


def merge_columns(rows: DataFrame, left: str, right: str) -> Column:
    return deep_merge(F.col(left), F.col(right), rows.schema[left].dataType, rows.schema[right].dataType)


# Ordered edits of an array

#: What an edit may do, and what of its fields it uses.
EDITS = {"add": "item", "update": "place, item", "remove": "place", "move": "group, to"}


def edited(items: Column, edits: Column) -> Column:
    """An entry's items after ``edits`` (op, place, item, group, to), each applied to what the ones before it left.

    add puts an item at the end; update replaces the item at a place (from 0; at the end or beyond, it is added); remove
    drops the one at a place; move gives all items of a group another one.  A place beyond the end removes nothing, and
    one that is null or negative changes nothing.
    """

    def step(now: Column, edit: Column) -> Column:
        place = edit["place"]
        before, behind = F.slice(now, F.lit(1), F.least(place, F.size(now))), F.slice(now, place + 2, F.greatest(F.size(now) - place - 1, F.lit(0)))
        own = F.array(edit["item"])
        moved = F.transform(now, lambda x: F.when(x["category"] == edit["group"], x.withField("category", edit["to"])).otherwise(x))
        there = place >= 0
        return (
            F.when(edit["op"] == "add", F.concat(now, own))
            .when((edit["op"] == "update") & there, F.concat(before, own, behind))
            .when((edit["op"] == "remove") & there, F.concat(before, behind))
            .when(edit["op"] == "move", moved)
            .otherwise(now)
        )

    return F.aggregate(edits, items, step)


def moved(items: Column, start: Column, to: Column) -> Column:
    """Items with the one at place ``start`` (from 0) dragged to place ``to``, of the others' places counted without it; a place that is not there changes nothing."""
    own, rest = F.get(items, start), F.filter(items, lambda _, i: i != start)
    there = start.between(0, F.size(items) - 1) & to.between(0, F.size(items) - 1)
    return F.when(there, F.concat(F.slice(rest, F.lit(1), to), F.array(own), F.slice(rest, to + 1, F.size(items)))).otherwise(items)


def apply_edits(entries: DataFrame, log: DataFrame, key: str = "entry") -> DataFrame:
    """Entries (key, items) after a log of edits (key, seq, op, place, item, group, to), each entry's in the order of seq.

    An edit of an entry that is not there begins one without items.  The log is grouped by entry in one shuffle; an entry's
    edits are one row, as its items are.
    """
    edit = F.struct("seq", "op", "place", "item", "group", "to")
    logs = log.groupBy(key).agg(F.array_sort(F.collect_list(edit)).alias("_edits"))
    none = F.array().cast(entries.schema["items"].dataType)
    met = entries.join(logs, key, "full")
    items = F.when(F.col("_edits").isNull(), F.col("items")).otherwise(edited(F.coalesce("items", none), F.col("_edits")))
    return met.withColumn("items", items).select(entries.columns)


# Settings

_FLAGS = {"show-in-diary": "show_in_diary", "show-in-stats": "show_in_stats"}
_GOAL_FLAGS = {"shared-goal": "shared_goal", "auto-adjust": "auto_adjust", "minimum-goal": "minimum_goal", "percent-goal": "percent_goal"}
_GENERAL = ("first-day-of-week", "average-goal-base")
BODY_STATS = ("weight", "neck", "waist", "hips", "body fat")


def nested_goals(flat: Column, nutriments: Column) -> Column:
    """struct(general map, stats map) of the old settings' flat goal keys, a map of JSON texts.

    ``fat-show-in-diary`` belongs to the stat ``fat``, as do ``fat-shared-goal`` and the other flags of its goal, which
    become the first of its list of goals, and ``fat`` itself, the goal's values.  Stats are those that have a flag, and
    of the other keys the given nutriments and the body stats; what is neither, or a general setting, is dropped.
    """
    suffixes = "|".join([*_FLAGS, *_GOAL_FLAGS])
    stat_of = lambda k: F.regexp_replace(k, f"-({suffixes})$", "")
    named = F.array_union(nutriments, F.array(*map(F.lit, BODY_STATS)))
    own = F.filter(F.map_keys(flat), lambda k: ~k.isin(*_GENERAL) & (k.rlike(f"-({suffixes})$") | F.array_contains(named, k)))
    stats = F.array_distinct(F.transform(own, stat_of))
    flag = lambda key: F.try_element_at(flat, key) == "true"

    def stat(name: Column) -> Column:
        flags = [flag(F.concat(name, F.lit(f"-{suffix}"))).alias(field) for suffix, field in _GOAL_FLAGS.items()]
        values = F.when(F.array_contains(named, name), F.try_element_at(flat, name))
        goal = F.struct(*flags, F.from_json(values, "array<string>").alias("goal"))
        there = F.lit(False)
        for column in [*[goal[field] for field in _GOAL_FLAGS.values()], goal["goal"]]:
            there = there | column.isNotNull()
        shown = [flag(F.concat(name, F.lit(f"-{suffix}"))).alias(field) for suffix, field in _FLAGS.items()]
        return F.struct(*shown, F.when(there, F.array(goal)).alias("goal_list"))

    general = F.map_filter(flat, lambda k, _: k.isin(*_GENERAL))
    return F.struct(general.alias("general"), F.map_from_entries(F.transform(stats, lambda s: F.struct(s, stat(s)))).alias("stats"))


def body_visibility(stats: Column) -> tuple[Column, Column]:
    """Which body stats are shown in statistics, as settings of their own, and the stats without that flag."""
    is_body = lambda k: k.isin(*BODY_STATS)
    shown = F.map_filter(F.transform_values(stats, lambda k, v: is_body(k) & (v["show_in_stats"] == F.lit(True))), lambda _, v: F.coalesce(v, F.lit(False)))
    left = F.transform_values(stats, lambda k, v: F.when(is_body(k), v.withField("show_in_stats", F.lit(None).cast("boolean"))).otherwise(v))
    return shown, left


SETTINGS_VERSION = 9
#: Old settings: what of them a migration reads.
OLD_SETTINGS = StructType([
    StructField("schemaVersion", StringType()), StructField("theme", MapType(StringType(), StringType())), StructField("appearance", MapType(StringType(), StringType())),
    StructField("goals", MapType(StringType(), StringType())), StructField("order", ArrayType(StringType())), StructField("show_brands", BooleanType()),
])


def migrated_settings(rows: DataFrame, nutriments: list[str]) -> DataFrame:
    """Old settings (the columns of OLD_SETTINGS; others stay) as the present version has them.

    The theme becomes the appearance, its dark mode a mode; a saved order gets the nutriments that it lacks; goals are
    nested; body stats' visibility moves out of the goals; brands are shown unless that is set; first day and base of
    averages are set if neither is.  Settings of the present version are left as they are, but for goals that are still
    flat: they have no ``migrated`` key.
    """
    old = F.coalesce(F.col("schemaVersion").try_cast("int"), F.lit(0)) < SETTINGS_VERSION
    look = F.coalesce("appearance", "theme")
    mode = F.when(F.try_element_at(look, F.lit("dark-mode")) == "true", "dark").otherwise("light")
    moded = F.map_concat(F.map_filter(look, lambda k, _: ~k.isin("dark-mode", "mode")), F.create_map(F.lit("mode"), mode))
    look = F.when(F.map_contains_key(look, "dark-mode"), moded).otherwise(look)
    every = F.array(*map(F.lit, nutriments))
    order = F.when(F.col("order").isNotNull(), F.array_union("order", every))
    flat = F.col("goals")
    defaults = F.when(F.map_contains_key(flat, _GENERAL[0]) | F.map_contains_key(flat, _GENERAL[1]), flat).otherwise(F.map_concat(flat, F.create_map(F.lit(_GENERAL[0]), F.lit("0"), F.lit(_GENERAL[1]), F.lit("week"))))
    rows = rows.withColumns({
        "migrated": old, "appearance": F.when(old, look).otherwise(F.col("appearance")), "order": F.when(old, order).otherwise(F.col("order")),
        "show_brands": F.when(old, F.coalesce("show_brands", F.lit(True))).otherwise(F.col("show_brands")),
        "schemaVersion": F.when(old, F.lit(str(SETTINGS_VERSION))).otherwise(F.col("schemaVersion")),
        "_nested": F.when(old & F.col("goals").isNotNull() & ~F.map_contains_key(flat, "migrated"), nested_goals(defaults, F.coalesce("order", every))),
    })
    shown, stats = body_visibility(F.col("_nested.stats"))
    rows = rows.withColumns({"general": F.col("_nested.general"), "stats": stats, "body_visibility": shown})
    return rows.drop("theme", "_nested", "goals")
