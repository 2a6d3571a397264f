"""License scan by diagonal voting, in DataFrame functions only.

Every document's rolling word k-grams (k of 2 and 4) are hashed and joined to the places of the same k-grams in license
templates.  A hit at word ``at`` of the document and word ``place`` of the template votes for the diagonal ``at - place``:
an unchanged copy puts all its votes on one diagonal, words put in or left out move the rest to a neighbouring one.
Neighbouring diagonals are merged to spans, and a span is accepted for the share of the template's words that its
verified k-grams cover.  A hit is verified by its words, so no result rests on a hash.

Documents are read once and never shuffled: the templates' k-grams, some thousand, are broadcast, and only hits, and one
marker row for each document, are written to the shared folder and grouped by document.

Edge cases: a null or empty text has no word, no label and score 0; repeated rows, and rows without doc_id, are each
scanned on their own; a text of any length is one array of words, used where it is.  Only ``doc_id`` and ``text`` are
read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import staged

#: Words of a k-gram; templates of fewer words than the larger one use the smaller one.
SHORT, LONG = 2, 4
#: Diagonals at most so many words apart are merged.
SHIFT = 6
#: A span of a template of at least ``WHOLE_BELOW`` words needs this share of them; of a shorter template all words are needed.
MIN_COVER = 0.6
WHOLE_BELOW = 10
#: A span may be so many times as long as its template.
MAX_STRETCH = 2.0
#: Runs of digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: A phrase whose every place is reported and counted.
    base: bool = False


# The phrases of the base scan, then notices as licenses prescribe them.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("mpl-2.0", "mozilla public license v 2 0"),
    Template("epl", "eclipse public license"),
    Template("bsd", "bsd 2 clause license"),
    Template("bsd", "bsd 3 clause license"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("reserved", "all rights reserved"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
)


def words(text: Column) -> Column:
    """A-Z in lower case, cut into words.

    ``lower`` folds letters beyond ASCII too, which leaves words where they are and makes none of them a word of ASCII
    letters, but for the Kelvin sign, which becomes a plain k and is hidden first.
    """
    text = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\ufffd"))
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _gram_hash(k: int, at: Column) -> Column:
    return F.xxhash64(F.lit(k), *[F.get("words", at + i) for i in range(k)])


def _marker_hash() -> Column:
    return F.xxhash64(F.lit(0), F.lit("a document"))


def _template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """key, template, place, k, gram (its words): of all templates, and of the marker, which is template -1."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(t.text).alias("text")) for i, t in enumerate(templates)])
    found = spark.range(1).select(F.inline(rows)).withColumn("words", words(F.col("text")))
    found = found.withColumn("k", F.when(F.size("words") < LONG, SHORT).otherwise(LONG))
    found = found.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))).alias("place"))
    key = F.when(F.col("k") == SHORT, _gram_hash(SHORT, F.col("place"))).otherwise(_gram_hash(LONG, F.col("place")))
    grams = found.select(key.alias("key"), "template", "place", "k", F.slice("words", F.col("place") + 1, F.col("k")).alias("gram"))
    return grams.union(spark.range(1).select(_marker_hash(), F.lit(-1), F.lit(0), F.lit(0), F.array().cast("array<string>")))


def _template_words(template: Template) -> int:
    return len(re.findall(WORD, template.text.lower()))


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """row, doc_id, n_words, template, at, place, k: every verified k-gram; and of each document a marker, template -1."""
    if short := [t.text for t in templates if _template_words(t) < SHORT]:
        raise ValueError(f"a template needs at least {SHORT} words: {short}")
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    found = found.select("*", F.posexplode_outer("words").alias("at", "word"))
    grams = [_gram_hash(SHORT, F.col("at")), _gram_hash(LONG, F.col("at"))]
    keys = F.when(F.col("at") > 0, F.array(*grams)).when(F.col("at") == 0, F.array(*grams, _marker_hash())).otherwise(F.array(_marker_hash()))
    found = found.select("row", "doc_id", "words", "at", F.explode(keys).alias("key"))
    same = F.slice("words", F.coalesce("at", F.lit(0)) + 1, F.col("k")) == F.col("gram")
    met = found.join(F.broadcast(_template_grams(docs.sparkSession, templates)), "key").where(same)
    return met.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "template", F.col("at").cast("long").alias("at"), "place", "k")


def _facts(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """template, label, base, length (in words)."""
    facts = [F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(_template_words(t)).alias("length")) for i, t in enumerate(templates)]
    return spark.range(1).select(F.inline(F.array(*facts)))


def diagonals(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """row, template, diagonal, votes, begin, end (in words of the document), places: hits summed by diagonal; with the template's facts."""
    votes = found.where("template >= 0").groupBy("row", "template", "k", (F.col("at") - F.col("place")).alias("diagonal"))
    summed = votes.agg(F.count("*").alias("votes"), F.min("at").alias("begin"), (F.max("at") + F.max("k")).alias("end"), F.collect_list("place").alias("places"))
    return summed.join(F.broadcast(_facts(found.sparkSession, templates)), "template")


def spans(voted: DataFrame) -> DataFrame:
    """row, template, label, begin, end, cover, accepted: neighbouring diagonals merged, judged by the words that they cover."""
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > SHIFT) | (F.col("length") < WHOLE_BELOW), F.lit(True))
    merged = voted.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("long")).over(own))
    covered = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))
    merged = merged.groupBy("row", "template", "label", "length", "span").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list(covered)))).alias("covered")
    )
    cover = F.col("covered") / F.col("length")
    enough = F.when(F.col("length") < WHOLE_BELOW, cover == 1).otherwise((cover >= MIN_COVER) & (F.col("end") - F.col("begin") <= MAX_STRETCH * F.col("length")))
    return merged.select("row", "template", "label", "begin", "end", cover.alias("cover"), enough.alias("accepted"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """What was found in each document, and the spans it rests on.

    The first has doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, which is the largest
    share of any template that a span covers; the second row (of ``hits``), doc_id, template, label, begin, end, cover.
    """
    found = staged(docs.sparkSession, hits(docs, templates), "hits")
    voted = staged(docs.sparkSession, diagonals(found, templates), "diagonals")
    judged = spans(voted)
    nothing = {"doc_id": docs.schema["doc_id"].dataType, "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_label": "string", "label": "string", "cover": "double"}

    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("row", *[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in nothing.items()])

    documents = found.where("template = -1")
    whole = voted.where(F.col("base") & (F.col("votes") == F.col("length") - F.col("k") + 1))
    parts = part(documents, doc_id=F.col("doc_id"), n_words=F.col("n_words"))
    parts = parts.union(part(whole, n_base=F.lit(1), first_word=F.col("diagonal"), last_word=F.col("diagonal"), base_label=F.col("label"), label=F.col("label"), cover=F.lit(1.0)))
    parts = parts.union(part(judged, label=F.when(F.col("accepted"), F.col("label")), cover=F.col("cover")))

    def listed(column: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(column)), ",")

    result = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.coalesce(F.sum("n_base"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), listed("base_label").alias("base_labels"),
        listed("label").alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    places = judged.where("accepted").join(documents.select("row", "doc_id"), "row")
    return result.drop("row"), places.select("row", "doc_id", "template", "label", "begin", "end", "cover")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
