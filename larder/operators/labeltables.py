"""Whole nutrition labels: text lines with places on a photo become columns of values.

A label is a few dozen lines.  They are grouped once by label; from there on each step is an expression over the label's
arrays, so the one shuffle is that grouping.  Arrays are exploded by the outer forms and filtered as arrays: a filter on
rows would be pushed below and would work out the arrays a second time.  Only the alignment of names with rows of values, a small dynamic programme,
is a function on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import half_up, leading_number, normalise_label, rotated
from larder.operators.labels import header, label_match, label_tokens, nearest_name, repaired_energy, repaired_kcal
from larder.sources.shared import staged

# The usual order of a table's nutrients; nutrients that always come right after another; those given in grams.
USUAL_ORDER = ("energy", "fat", "saturated-fat", "carbohydrates", "sugars", "fiber", "proteins", "salt")
FOLLOWS = {"saturated-fat": "fat", "sugars": "carbohydrates"}
IN_GRAMS = ("fat", "saturated-fat", "trans-fat", "monounsaturated-fat", "polyunsaturated-fat", "carbohydrates", "sugars", "fiber", "proteins", "salt", "lactose", "sucrose", "glucose", "fructose", "alcohol")
#: A name over two lines must be this likely; a name and a row of values further apart than this many line heights are no pair.
WRAPPED, REACH = 0.85, 1.6
_HEAD = r"(?i)\b(?:per|pour|pro|por|je|par|para|avg|average|amount|serving|serve|portion|porcion|porzione)\b|\b100\s?(?:g|ml)\b"
_SERVING = r"(?:serving size|serve size|portion size|taille de la portion|portionsgrosse|tamano de la porcion|porcion|porzione).*?([0-9]+(?:[.,][0-9]+)?)\s?(g|ml)\b"


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _median(values: Column) -> Column:
    """The upper median, null of nothing."""
    return _let(F.array_sort(values), lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int")))


def _by(items: Column, *fields: str) -> Column:
    """Structs in the order of some of their fields, then of all."""
    keyed = F.transform(items, lambda x: F.struct(*[x[f].alias(f"by_{f}") for f in fields], x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda k: k["x"])


def _is_new(values: Column, value: Column, i: Column) -> Column:
    """Whether a value is not among the first i; array_position, which would say so too, is slow where it finds one."""
    return value.isNotNull() & ~F.coalesce(F.array_contains(F.slice(values, F.lit(1), i), value), F.lit(False))


def _once(items: Column, field: str) -> Column:
    """The first struct of each value of a field."""
    both = F.struct(items.alias("items"), F.transform(items, lambda x: x[field]).alias("values"))
    return _let(both, lambda b: F.filter(b["items"], lambda x, i: _is_new(b["values"], x[field], i)))


def clusters(items: Column, item_type: str, field: str, tolerance: Column, by_mean: bool) -> Column:
    """array of struct(items, at): islands along a field, each item within a tolerance of the island's mean, or of its last item."""
    empty = F.array().cast(f"array<struct<items: array<{item_type}>, at: double>>")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        count = F.size(last["items"])
        at = (last["at"] * count + x[field]) / (count + 1) if by_mean else x[field]
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.array_append(last["items"], x).alias("items"), at.alias("at"))))
        alone = F.array_append(done, F.struct(F.array(x).alias("items"), x[field].alias("at")))
        return F.when((F.size(done) > 0) & (F.abs(x[field] - last["at"]) <= tolerance), joined).otherwise(alone)

    return F.aggregate(_by(items, field), empty, add)


def aligned(names: np.ndarray, rows: np.ndarray, height: float) -> list[int | None]:
    """For each row of values the place of its name, or None: pairs keep the order of both, and cost the square of their
    distance in line heights, while anything left alone costs 1."""
    n, m = len(names), len(rows)
    far = np.abs(np.subtract.outer(np.asarray(names, float), np.asarray(rows, float))) / max(height, 1e-9)
    pair = np.where(far > REACH, np.inf, far**2).tolist()  # single numbers are quicker to get from lists
    rest = [[float(n - i + m - j) for j in range(m + 1)] for i in range(n + 1)]  # the least cost of what is below a name and a row
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            rest[i][j] = min(pair[i][j] + rest[i + 1][j + 1], 1 + rest[i + 1][j], 1 + rest[i][j + 1])
    out: list[int | None] = [None] * m
    i = j = 0
    while i < n and j < m:
        if rest[i][j] == pair[i][j] + rest[i + 1][j + 1]:
            out[j] = i
            i, j = i + 1, j + 1
        elif rest[i][j] == 1 + rest[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _aligner():
    @F.pandas_udf("array<int>")
    def names_of_rows(names: pd.Series, rows: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([aligned(a, b, h) for a, b, h in zip(names, rows, height, strict=True)])

    return names_of_rows


def with_inferred(keys: Column) -> Column:
    """Keys of a panel's rows, with those that only their neighbours tell: the parent of a nutrient that always follows it,
    the one nutrient that is missing between two, and salt after proteins at the end.  A known nutrient is not inferred."""
    order = F.array(*map(F.lit, USUAL_ORDER))
    parents = F.create_map(*[F.lit(x) for pair in FOLLOWS.items() for x in pair])
    places = F.create_map(*[F.lit(x) for place, key in enumerate(USUAL_ORDER, 1) for x in (key, place)])
    known = lambda part: F.filter(part, lambda k: k.isNotNull())

    def told(around: Column, i: Column) -> Column:
        last, coming, below = around["last"], around["coming"], F.get(keys, i + 1)
        place = lambda k: F.try_element_at(places, k)
        between = F.when(place(coming) - place(last) == 2, F.get(order, place(last)))
        final = F.when((last == "proteins") & coming.isNull() & (i == F.size(keys) - 1), "salt")
        found = F.coalesce(F.try_element_at(parents, F.coalesce(below, F.lit(""))), between, final)
        return _let(found, lambda f: F.when(~F.coalesce(F.array_contains(known(keys), f), F.lit(False)), f))

    def candidate(key: Column, i: Column) -> Column:
        last, coming = F.get(F.reverse(known(F.slice(keys, F.lit(1), i))), F.lit(0)), F.get(known(F.slice(keys, i + 2, F.size(keys))), F.lit(0))
        return F.when(key.isNull(), _let(F.struct(last.alias("last"), coming.alias("coming")), lambda around: told(around, i)))

    first = lambda g, i: F.when(F.array_position(g, F.get(g, i)) == i + 1, F.get(g, i))
    return _let(F.transform(keys, candidate), lambda g: F.transform(keys, lambda k, i: F.coalesce(k, first(g, i))))


_LINE = "struct<text: string, x: double, y: double, w: double, h: double, cx: double, cy: double, angle: double>"
_TOKEN = "struct<y: double, x: double, value: double, unit: string, digits: string, line: int>"


def read_texts(lines: DataFrame) -> DataFrame:
    """text, name, tokens, is_head: what the texts of lines say, each different text read once.

    Labels repeat their texts, and reading one takes longer than all else that is done with its line.  The table is staged, so
    Spark knows its size and sends a small one to all tasks; of a large one a text that many lines have is split as a skewed join.
    """
    texts = lines.select("text").distinct().repartition(lines.sparkSession.sparkContext.defaultParallelism)  # few bytes, but much work
    texts = texts.select("text", label_match(F.col("text")).alias("name"), label_tokens(F.col("text")).alias("tokens"))
    is_head = F.col("name").isNull() & F.col("text").rlike(_HEAD) & ~F.col("text").rlike(r"(?i)[0-9]\s?(?:kj|kcal)\b")
    return staged(texts.withColumn("is_head", is_head), "label-texts")


def grouped_lines(lines: DataFrame) -> DataFrame:
    """A row per label: height, all its lines straightened by the median angle, names (wrapped ones joined), values and heads.

    Blank lines count for nothing.  A line without ``w`` is taken as half its height wide for each letter.
    """
    width = F.col("w") if "w" in lines.columns else F.col("h") * F.length("text") / 2
    read = lines.where(F.trim("text") != "").select(
        "image_id", "text", F.col("cx").cast("double"), F.col("cy").cast("double"), F.col("h").cast("double"), F.coalesce(F.col("angle").cast("double"), F.lit(0.0)).alias("angle"), F.coalesce(width.cast("double"), F.lit(0.0)).alias("w"),
    )
    read = read.join(read_texts(read), "text")
    one = read.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("cy", "cx", "text", "w", "h", "angle", "name", "tokens", "is_head"))).alias("raw"))
    one = one.withColumns({"angle": _median(F.transform("raw", lambda x: x["angle"])), "height": _median(F.transform("raw", lambda x: x["h"]))})

    def straight(line: Column) -> Column:
        x, y = rotated(line["cx"], line["cy"], -F.col("angle"))
        return line.withField("x", x).withField("y", y)

    one = one.withColumn("raw", F.transform("raw", straight))
    place = lambda x: F.struct(*[x[f].alias(f) for f in ("text", "x", "y", "w", "h", "cx", "cy", "angle")])

    def tokens(line: Column, i: Column) -> Column:
        wanted = F.filter(line["tokens"], lambda t: t["value"].isNotNull() & ~t["unit"].isin("%", "ml") & ~line["is_head"])
        return F.transform(wanted, lambda t: F.struct(line["y"].alias("y"), (line["x"] + (t["at"] - 0.5) * line["w"]).alias("x"), t["value"].alias("value"), t["unit"].alias("unit"), t["digits"].alias("digits"), i.alias("line")))

    def named(line: Column, i: Column) -> Column:
        return F.struct(line["y"].alias("y"), (line["x"] - line["w"] / 2).alias("x"), line["name"]["key"].alias("key"), i.alias("line"))

    def wrapped(line: Column, i: Column) -> Column:
        """A line that names nothing and has no value, with the next such line right below it."""
        loose = lambda o: o["name"].isNull() & (F.size(o["tokens"]) == 0) & ~o["is_head"]
        left = lambda o: o["x"] - o["w"] / 2
        near = lambda o: (o["y"] > line["y"]) & (o["y"] - line["y"] < line["h"] * 1.6) & (F.abs(left(o) - left(line)) < line["h"] * 3)
        below = F.when(loose(line), F.get(_by(F.filter("raw", lambda o: loose(o) & near(o)), "y"), F.lit(0)))

        def joined(b: Column) -> Column:
            match = F.when(b.isNotNull(), _let(normalise_label(F.concat_ws(" ", line["text"], b["text"])), lambda t: nearest_name(t, least=WRAPPED)))
            key = _let(match, lambda m: F.when(m["likeness"] >= WRAPPED, m["key"]))
            return F.struct(((line["y"] + b["y"]) / 2).alias("y"), F.least(left(line), left(b)).alias("x"), key.alias("key"), i.alias("line"))

        return _let(below, joined)

    names = F.filter(F.concat(F.transform("raw", named), F.transform("raw", wrapped)), lambda n: n["key"].isNotNull())
    return one.select(
        "image_id", "height", F.transform("raw", place).alias("lines"), F.transform("raw", lambda x: x["is_head"]).alias("heads"), _by(names, "y").alias("names"), F.flatten(F.transform("raw", tokens)).alias("values"),
    )


def _is_energy(token: Column) -> Column:
    return token["unit"].isin("kj", "kcal")


def panels(labels: DataFrame) -> DataFrame:
    """A row per panel of a label, with its names, rows of values and their keys.

    Names whose left edges line up, at least two, begin a panel that ends where the next begins; without any, the label is
    one panel.  Energy is known by its unit, so its name is kept only where no value has such a unit.
    """
    by_unit = F.exists("values", _is_energy)
    labels = labels.withColumn("names", F.filter("names", lambda n: (n["key"] != "energy") | ~by_unit))
    edges = clusters(F.col("names"), "struct<y: double, x: double, key: string, line: int>", "x", F.col("height") * 3, by_mean=False)
    starts = F.transform(F.filter(edges, lambda c: F.size(c["items"]) >= 2), lambda c: c["items"][0]["x"] - F.col("height"))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    spans = F.transform("starts", lambda s, i: F.struct(F.when(i == 0, low).otherwise(s).alias("lo"), F.coalesce(F.get("starts", i + 1), high).alias("hi")))
    spans = F.when(F.size("starts") == 0, F.array(F.struct(low.alias("lo"), high.alias("hi")))).otherwise(spans)
    each = labels.withColumn("starts", starts).withColumn("spans", spans).select("*", F.posexplode_outer("spans").alias("panel", "span")).drop("starts", "spans")
    inside = lambda x: (x["x"] >= F.col("span.lo")) & (x["x"] < F.col("span.hi"))
    each = each.withColumns({"names": F.filter("names", inside), "values": F.filter("values", inside)})
    rows = lambda wanted: clusters(F.filter("values", wanted), _TOKEN, "y", F.col("height") * 0.5, by_mean=True)
    each = each.withColumns({"rows": rows(lambda t: ~_is_energy(t)), "energy_rows": rows(_is_energy)})
    each = each.withColumn("of", _aligner()(F.transform("names", lambda n: n["y"]), F.transform("rows", lambda r: r["at"]), F.col("height")))
    keys = F.transform("of", lambda k: F.get("names", k)["key"])
    each = each.withColumn("keys", keys).withColumn("keys", F.transform("keys", lambda k, i: F.when(_is_new(F.col("keys"), k, i), k)))
    return each.withColumn("keys", with_inferred(F.col("keys")))


def _cells(each: DataFrame) -> DataFrame:
    """Adds ``cells``: struct(key, value, unit, digits, x, y), with a g that was read as a 9 taken off again."""
    matched = F.filter(F.transform("rows", lambda r, i: F.struct(F.get("keys", i).alias("key"), r["items"].alias("items"))), lambda r: r["key"].isNotNull())
    each = each.withColumn("matched", matched)
    tokens = F.flatten(F.transform("matched", lambda r: r["items"]))
    inline = _let(tokens, lambda ts: (F.size(ts) >= 4) & (F.size(F.filter(ts, lambda t: t["unit"] != "")) * 2 >= F.size(ts)))

    def of_row(r: Column, inline: Column) -> Column:
        in_grams = F.exists(r["items"], lambda t: t["unit"] == "g") | (inline & r["key"].isin(*IN_GRAMS))

        def cell(t: Column) -> Column:
            nine = (t["unit"] == "") & t["digits"].rlike("[0-9]9$") & in_grams
            cut = F.replace(F.regexp_replace(t["digits"], "9$", ""), F.lit(","), F.lit(".")).try_cast("double")
            value, unit = F.when(nine, cut).otherwise(t["value"]), F.when(nine, "g").otherwise(t["unit"])
            return F.struct(r["key"].alias("key"), value.alias("value"), unit.alias("unit"), t["digits"].alias("digits"), t["x"].alias("x"), t["y"].alias("y"))

        return F.transform(_by(r["items"], "x"), cell)

    def energy(r: Column) -> Column:
        return F.transform(r["items"], lambda t: F.struct(F.when(t["unit"] == "kj", "kilojoules").otherwise("calories").alias("key"), t["value"].alias("value"), t["unit"].alias("unit"), t["digits"].alias("digits"), t["x"].alias("x"), t["y"].alias("y")))

    return each.withColumn("cells", F.concat(_let(inline, lambda y: F.flatten(F.transform("matched", lambda r: of_row(r, y)))), F.flatten(F.transform("energy_rows", energy))))


def _value(cells: Column, key: str | Column) -> Column:
    return F.get(F.filter(cells, lambda c: c["key"] == key), F.lit(0))["value"]


def _fitting_energy(cells: Column) -> Column:
    read = F.struct(cells.alias("cells"), _value(cells, "kilojoules").alias("kj"), _value(cells, "calories").alias("kcal"))
    both = lambda r: r["kj"].isNotNull() & r["kcal"].isNotNull()
    fixed = _let(_let(read, lambda r: r.withField("kcal", F.when(both(r), repaired_kcal(r["kj"], r["kcal"])))), lambda r: r.withField("kj", F.when(both(r), repaired_energy(r["kj"], r["kcal"]))))
    fitting = lambda r, c: F.when(c["key"] == "calories", r["kcal"]).when(c["key"] == "kilojoules", r["kj"])
    return _let(fixed, lambda r: F.transform(r["cells"], lambda c: c.withField("value", F.coalesce(fitting(r, c), c["value"]))))


def ratio(of: Column, to: Column, least: int, above: float = 1.0) -> Column:
    """The median of one column's values through another's for nutrients of both, null of fewer than ``least``."""
    shared = F.transform(F.filter(to, lambda c: c["value"] > above), lambda c: _value(of, c["key"]) / c["value"])
    return _let(F.filter(shared, lambda r: r.isNotNull()), lambda r: F.when(F.size(r) >= least, _median(r)))


def _columns(each: DataFrame) -> DataFrame:
    """A row per label with ``columns``: struct(column, cells, basis, amount, unit), and the size of a serving that the label states."""
    cell_type = "struct<key: string, value: double, unit: string, digits: string, x: double, y: double>"
    found = F.filter(clusters(F.col("cells"), cell_type, "x", F.col("height") * 1.2, by_mean=False), lambda c: F.size(c["items"]) >= 2)
    each = _cells(each).withColumn("centres", F.transform(found, lambda c: _median(F.transform(c["items"], lambda x: x["x"]))))
    far = lambda x, c: F.abs(x - c["x"])
    nearest = lambda c: F.array_min(F.transform("centres", lambda x, i: F.when(far(x, c).isNotNull(), F.struct(far(x, c).alias("far"), i.alias("i")))))["i"]
    # What the label states is looked for here, so the grouping by column need not carry all lines with each.
    stated = lambda group: F.regexp_extract(F.lower(F.array_join(F.transform("lines", lambda line: line["text"]), "\n")), _SERVING, group)
    each = each.withColumns({"stated": stated(1), "stated_unit": stated(2)})
    each = each.select("image_id", "panel", "height", "lines", "stated", "stated_unit", "cells", F.posexplode_outer("centres").alias("column", "x"), "centres")
    each = each.withColumn("cells", F.filter("cells", lambda c: nearest(c) == F.col("column")))
    top = F.array_min(F.transform("cells", lambda c: c["y"]))
    over = lambda line: F.abs(line["x"] - F.col("x")) < F.greatest(line["w"] / 2, F.col("height") * 2)
    above = lambda low, high: _by(F.filter("lines", lambda line: over(line) & (line["y"] < F.col("top") + F.col("height") * low) & (line["y"] > F.col("top") - F.col("height") * high)), "y")
    text = F.array_join(F.transform(F.reverse(above(-0.3, 6)), lambda line: line["text"]), " ")
    hundred = F.filter(F.reverse(above(1, 15)), lambda line: line["text"].rlike(r"(?i)\b100\s?(?:g|ml)\b"))
    each = each.withColumn("top", top).withColumn("text", text)
    each = each.withColumn("text", F.when(F.col("text").rlike(r"(?i)[0-9]\s*(?:g|ml)\b|serv|porti|porci|porzi"), F.col("text")).otherwise(F.get(hundred, F.lit(0))["text"]))
    basis, amount, unit = header(F.when(F.col("text").rlike(r"(?i)\b100\s?(?:g|ml)\b"), F.regexp_extract("text", r"(?i)\b100\s?(?:g|ml)\b", 0)).otherwise(F.col("text")))
    each = each.withColumn("head", F.struct(basis.alias("basis"), amount.alias("amount"), unit.alias("unit")))
    # The nth columns of all panels are one column; of a nutrient that two panels have, the first panel's value stays.
    each = each.select("image_id", "panel", "column", "cells", "head", "stated", "stated_unit").repartition("image_id")  # one shuffle for both groupings
    merged = each.groupBy("image_id", "column").agg(
        F.array_sort(F.collect_list(F.struct("panel", "cells"))).alias("parts"), F.min_by("head", F.when(F.col("head.basis").isNotNull(), F.col("panel"))).alias("head"), F.first("stated").alias("stated"), F.first("stated_unit").alias("stated_unit"),
    )
    cells = F.flatten(F.transform("parts", lambda p: _by(p["cells"], "y", "x")))
    merged = merged.withColumn("cells", _let(_once(cells, "key"), _fitting_energy))
    column = F.struct("column", "cells", F.col("head.basis").alias("basis"), F.col("head.amount").alias("amount"), F.col("head.unit").alias("unit"))
    return merged.groupBy("image_id").agg(
        F.filter(F.array_sort(F.collect_list(column)), lambda c: F.size(c["cells"]) >= 2).alias("columns"), F.first(F.replace("stated", F.lit(","), F.lit(".")).try_cast("double")).alias("stated"), F.first("stated_unit").alias("stated_unit"),
    )


def _set(column: Column, when: Column, basis: Column | str, amount: Column, unit: Column) -> Column:
    """The column with what is known of it where a condition holds."""
    pick = lambda new, field: F.when(F.coalesce(when, F.lit(False)), new).otherwise(column[field])
    return column.withField("basis", pick(basis, "basis")).withField("amount", pick(amount, "amount")).withField("unit", pick(unit, "unit"))


def with_bases(labels: DataFrame) -> DataFrame:
    """Columns without a readable header get basis and amount from the stated serving and from the other column's values."""
    stated, unit = F.col("stated"), F.col("stated_unit")
    step = lambda frame, change: frame.withColumn("columns", F.transform("columns", change))
    labels = step(labels, lambda c: _set(c, (c["basis"] == "serving") & c["amount"].isNull() & stated.isNotNull(), c["basis"], stated, unit))
    first = lambda wanted: F.get(F.filter("columns", wanted), F.lit(0))
    hundred = first(lambda c: c["basis"] == "100")

    def without_line(c: Column) -> Column:
        """A slash before the amount that was read as a 1 is taken off where the values say so."""
        close = lambda a, told: F.abs(a - told) <= told * 0.08
        cut = F.regexp_replace(c["amount"].cast("string"), "^1", "").try_cast("double")
        wrong = _let(ratio(c["cells"], hundred["cells"], 3) * 100, lambda told: ~close(c["amount"], told) & close(cut, told))
        return _let(F.coalesce((c["basis"] == "serving") & wrong, F.lit(False)), lambda w: _set(c, w, c["basis"], cut, c["unit"]))

    labels = step(labels, without_line)
    two = F.size("columns") == 2

    def by_known(c: Column) -> Column:
        known = first(lambda o: o["amount"].isNotNull())
        amount = F.when(two & c["amount"].isNull(), half_up(known["amount"] * ratio(c["cells"], known["cells"], 2), 1))
        near = lambda a: F.abs(a - 100) < 1
        return _let(amount, lambda a: _set(c, a > 0, F.when(near(a), "100").otherwise("serving"), F.when(near(a), 100.0).otherwise(a), known["unit"]))

    labels = step(labels, by_known)

    def by_serving(c: Column) -> Column:
        serving = first(lambda o: o["basis"] == "serving")
        larger = two & c["basis"].isNull() & (ratio(c["cells"], serving["cells"], 3, 0.0) > 1.2)
        return _let(larger, lambda w: _set(c, w, F.lit("100"), F.lit(100.0), F.coalesce(serving["unit"], F.nullif(unit, F.lit("")), F.lit("g"))))

    labels = step(labels, by_serving)
    return step(labels, lambda c: _set(c, (F.size("columns") == 1) & c["basis"].isNull() & stated.isNotNull(), F.lit("serving"), stated, unit))


def repaired_decimal(value: Column, digits: Column, expected: Column, other: Column) -> Column:
    """A value without a decimal mark that is far off what the other column says, if its digits with a mark somewhere, or
    without a 9 that was a g, come near; ``other`` are the other column's digits, which must have a mark."""
    off = lambda v: F.abs(v - expected) / expected
    exact = lambda d: F.coalesce(d.rlike("[.,]|^0[0-9]"), F.lit(False))
    cut = lambda d: F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.concat(F.substring(d, F.lit(1), i), F.lit("."), F.substring(d, i + 1, F.length(d))).try_cast("double"))
    short = F.when(digits.rlike("[0-9]9$"), F.substring(digits, F.lit(1), F.length(digits) - 1)).otherwise(digits)
    wrong = F.coalesce(~exact(digits) & exact(other) & (expected > 0) & (off(value) > 0.4), F.lit(False))
    readings = F.transform(F.filter(F.concat(cut(digits), cut(short)), lambda v: v.isNotNull()), lambda v: F.struct(off(v).alias("off"), v.alias("v")))
    return F.when(wrong, _let(F.array_min(readings), lambda b: F.when(b["off"] <= 0.15, b["v"]).otherwise(value))).otherwise(value)


def with_decimals(labels: DataFrame) -> DataFrame:
    """Values of 100 and of a serving are held against each other; values below half a unit in both are left alone."""
    of = lambda basis: F.get(F.filter("columns", lambda c: (c["basis"] == basis) & (c["amount"] > 0)), F.lit(0))
    labels = labels.withColumns({"hundred": of("100"), "serving": of("serving")})

    def column(c: Column) -> Column:
        for_100 = c["column"] == F.col("hundred.column")
        mate = F.when(for_100, F.col("serving")).when(c["column"] == F.col("serving.column"), F.col("hundred"))
        factor = F.when(for_100, 100 / F.col("serving.amount")).otherwise(F.col("serving.amount") / 100)

        def cell(x: Column) -> Column:
            other = F.get(F.filter(mate["cells"], lambda o: o["key"] == x["key"]), F.lit(0))
            same = lambda o: (o["unit"] == x["unit"]) & ((o["value"] >= 0.5) | (x["value"] >= 0.5))
            told = lambda o: _let(o["value"] * factor, lambda e: repaired_decimal(x["value"], x["digits"], e, o["digits"]))
            return x.withField("value", _let(other, lambda o: F.when(same(o), told(o)).otherwise(x["value"])))

        return c.withField("cells", F.transform(c["cells"], cell))

    return labels.withColumn("columns", F.transform("columns", column)).drop("hundred", "serving")


def parse_labels(lines: DataFrame) -> DataFrame:
    """image_id, column, basis, amount, key, value, unit from lines (image_id, text, cx, cy, h, angle and, if known, w).

    Columns of an unknown basis with less than half the values of the fullest one are stray numbers, where some basis is known.
    """
    labels = with_decimals(with_bases(_columns(panels(grouped_lines(lines)))))
    most = F.array_max(F.transform("columns", lambda c: F.size(c["cells"])))
    known = F.exists("columns", lambda c: c["basis"].isNotNull())
    kept = F.filter("columns", lambda c: ~known | c["basis"].isNotNull() | (F.size(c["cells"]) * 2 >= most))
    flat = labels.select("image_id", F.explode_outer(kept).alias("c")).select("image_id", "c.column", "c.basis", "c.amount", F.explode_outer("c.cells").alias("cell"))
    return flat.where("cell is not null").select("image_id", "column", "basis", "amount", "cell.key", "cell.value", "cell.unit")


def table_bounds(lines: DataFrame) -> DataFrame:
    """image_id, x0, y0, x1, y1: the box on the photo around the paired names, the values beside them and the heads above;
    none for fewer than three lines."""
    each = panels(grouped_lines(lines))
    used = F.transform(F.filter("of", lambda k: k.isNotNull()), lambda k: F.get("names", k))
    one = each.groupBy("image_id").agg(F.flatten(F.collect_list(used)).alias("used"), F.flatten(F.collect_list("values")).alias("values"), F.first("lines").alias("lines"), F.first("heads").alias("heads"), F.first("height").alias("height"))
    heights = F.transform("used", lambda n: n["y"])
    one = one.withColumns({"top": F.array_min(heights), "bottom": F.array_max(heights)}).where("top is not null")
    beside = F.filter("values", lambda v: v["y"].between(F.col("top") - F.col("height") * 2, F.col("bottom") + F.col("height")))
    heading = F.filter(F.transform("lines", lambda line, i: F.when(F.get("heads", i) & line["y"].between(F.col("top") - F.col("height") * 4, F.col("bottom")), i)), lambda i: i.isNotNull())
    places = F.array_distinct(F.concat(F.transform("used", lambda n: n["line"]), F.transform(beside, lambda v: v["line"]), heading))
    one = one.withColumn("box", F.transform(places, lambda i: F.get("lines", i))).where(F.size("box") >= 3)
    half = lambda line, a, b: line["w"] / 2 * F.abs(a(line["angle"])) + line["h"] / 2 * F.abs(b(line["angle"]))
    edge = lambda pick, centre, sign, a, b: half_up(pick(F.transform("box", lambda line: line[centre] + sign * half(line, a, b))), 2)
    return one.select(
        "image_id", edge(F.array_min, "cx", -1, F.cos, F.sin).alias("x0"), edge(F.array_min, "cy", -1, F.sin, F.cos).alias("y0"),
        edge(F.array_max, "cx", 1, F.cos, F.sin).alias("x1"), edge(F.array_max, "cy", 1, F.sin, F.cos).alias("y1"),
    )


def best_columns(values: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """image_id, column, basis, n (values): the column of each label that is shown first, from its values (image_id, column, basis, key).

    The fullest one per 100 g or ml; without such a column the fullest of the first column's basis; of equal ones the
    first.  ``before`` (image_id, basis) is what was shown before more was read: the first column of that basis is kept.
    """
    counted = values.groupBy("image_id", "column", "basis").agg(F.count("*").alias("n"))
    each = counted.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("column", "basis", "n"))).alias("all"))
    hundred = F.exists("all", lambda c: F.coalesce(c["basis"] == "100", F.lit(False)))
    basis = F.when(hundred, "100").otherwise(F.get("all", F.lit(0))["basis"])
    each = each.withColumn("wanted", basis)
    own = F.filter("all", lambda c: c["basis"].eqNullSafe(F.col("wanted")))
    best = F.array_min(F.transform(own, lambda c: F.struct((-c["n"]).alias("less"), c["column"].alias("column"), c["basis"].alias("basis"), c["n"].alias("n"))))
    chosen = F.struct(best["column"].alias("column"), best["basis"].alias("basis"), best["n"].alias("n"))
    if before is not None:
        shown = before.where("basis is not null").select("image_id", F.col("basis").alias("shown"))
        each = each.join(shown, "image_id", "left")
        same = F.try_element_at(F.filter("all", lambda c: c["basis"] == F.col("shown")), F.lit(1))
        chosen = F.coalesce(same, chosen)
    return each.select("image_id", chosen.alias("c")).select("image_id", "c.*")


def reviewed(values: DataFrame, edits: DataFrame, basis: DataFrame) -> DataFrame:
    """A label's values as the user confirmed them: the column of the chosen basis, with edits (image_id, key, text) that are
    numbers in place of what was read; an edit that is none leaves the nutrient out."""
    chosen = values.join(basis.select("image_id", "basis"), ["image_id", "basis"], "left_semi")
    typed = edits.select("image_id", "key", leading_number(F.col("text")).alias("_typed"), F.lit(True).alias("_edited"))
    both = chosen.select("image_id", "key", "value").join(typed, ["image_id", "key"], "full")
    return both.select("image_id", "key", F.when(F.col("_edited"), F.col("_typed")).otherwise(F.col("value")).alias("value")).where("value is not null")


def reviewed_serving(typed: DataFrame) -> DataFrame:
    """image_id, amount, unit: the serving that the user confirmed, from the texts (portion, unit) of the review; none where the portion is empty."""
    return typed.where("coalesce(portion, '') <> ''").select("image_id", leading_number(F.col("portion")).alias("amount"), F.trim("unit").alias("unit"))
