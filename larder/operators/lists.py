"""Lists of foods: filters, search, order, pages, and changes to them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalars import fold_accents


def archived_filter(rows: DataFrame, only_archived: bool) -> DataFrame:
    archived = F.coalesce("archived", F.lit(False))
    return rows.where(archived if only_archived else ~archived)


def hidden_filter(rows: DataFrame, any_category_filter: bool) -> DataFrame:
    """Hidden rows show only while some category filter is on."""
    return rows if any_category_filter else rows.where(~F.coalesce("hidden", F.lit(False)))


def text_search(rows: DataFrame, query: str, fold: bool = True, regex: bool = False) -> DataFrame:
    """Every word of the query is in the name or the brand, whatever its case and accents; nameless rows pass."""
    form = fold_accents if fold else (lambda c: c)
    name, brand = form(F.col("name")), form(F.coalesce("brand", F.lit("")))
    met: Column = F.lit(True)
    for word in query.split():
        plain = word if not fold else word.translate(str.maketrans(dict(zip(*_table(), strict=True))))
        pattern = "(?i)" + (plain if regex else re.escape(plain))
        met = met & (name.rlike(pattern) | brand.rlike(pattern))
    return rows.where(F.col("name").isNull() | met)


def _table() -> tuple[str, str]:
    from larder.functions import scalars

    return scalars.ACCENTED, scalars.PLAIN


def has_all(rows: DataFrame, labels: list[str]) -> DataFrame:
    return rows.where(F.size(F.array_except(F.array(*map(F.lit, labels)), F.coalesce("categories", F.array().cast("array<string>")))) == 0)


def uncategorised(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("categories").isNull() | (F.size("categories") == 0))


def alphabetical(rows: DataFrame) -> DataFrame:
    """By name; nameless rows are not in that index."""
    return rows.where("name is not null").orderBy("name", "id")


def recent(rows: DataFrame) -> DataFrame:
    return rows.where("date_time is not null").orderBy(F.desc("date_time"), "id")


def page(rows: DataFrame, number: int, size: int = 20) -> DataFrame:
    return rows.offset(number * size).limit(size)


def lookup(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The record with the smallest id for each key of ``keys`` (one column, ``key``); null where there is none."""
    first = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.min("id").alias("id"))
    return keys.join(first, "key", "left")


def upsert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace those with their key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def partial_update(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Fields of ``changes`` that are there replace the row's."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    merged = rows.join(new, key, "left")
    return merged.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else c for c in rows.columns])


def rename_key(nutrition: Column, old: str, new: str) -> Column:
    return F.transform_keys(nutrition, lambda k, _: F.when(k == old, F.lit(new)).otherwise(k))


def drop_key(nutrition: Column, name: str) -> Column:
    return F.map_filter(nutrition, lambda k, _: k != name)


def rename_label(categories: Column, old: str, new: str) -> Column:
    return F.transform(categories, lambda c: F.when(c == old, F.lit(new)).otherwise(c))


def drop_label(categories: Column, label: str) -> Column:
    """Null where no label is left."""
    left = F.array_remove(categories, label)
    return F.when(F.size(left) > 0, left)
