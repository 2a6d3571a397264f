"""License scans, centroid clustering and ranked search against plain versions, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import lexical, licenses, vafile

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
CLASH = ["row", "template", "at", "key", "words", "label", "n", "terms", "counts", "query", "rank", "score", "vec", "cells", "cluster", "copies"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


# License scans


def plain_base(text):
    words, places = plain_words(text), []
    for label, phrase in (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


ODD = [
    (1, None), (2, ""), (3, "..."), (4, "MIT"), (5, "The MIT, License! mit LICENSE mit license"), (5, "The MIT, License! mit LICENSE mit license"), (None, "CC-BY 4.0"),
    (7, "MİT license Apache License GNU GENERAL public licenſe"), (8, "apache license " * 20_000), (9, "x" * 300_000), (10, "gnu gnu general public license general public license"),
]


@pytest.mark.parametrize("partitions", [1, 5])
def test_base_places(spark, partitions):
    rows = clashing(spark.createDataFrame(ODD, DOC).repartition(partitions))
    found = licenses.scan(rows)[0].collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found)
    assert got == sorted((i or 0, *plain_base(t)) for i, t in ODD)
    assert all(set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 for r in found)
    assert licenses.scan(rows.where("false"))[0].collect() == []


def test_base_places_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted((r.doc_id, *plain_base(r.text)) for r in docs.collect())
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs)[0].collect()) == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="mitMIT licenseLICENSEKİßK-.é1", max_size=30), min_size=1, max_size=8))
def test_words_are_cut_alike(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", licenses.words(F.col("t")).alias("w"))
    for r in rows.collect():
        want = plain_words(texts[r.i])
        assert len(r.w) == len(want) and all(a == b for a, b in zip(r.w, want, strict=True) if b.isascii())
        assert all(not a.isascii() for a, b in zip(r.w, want, strict=True) if not b.isascii())


def changed(words, rng, share):
    out = []
    for w in words:
        kind = rng.random()
        if kind < share / 3:
            continue
        out += [rng.choice("abcdefgh") * 3] if kind < share * 2 / 3 else [w, "added"] if kind < share else [w]
    return out


def test_notices_are_found_with_changes(spark):
    rng = random.Random(4)
    long = [t for t in licenses.TEMPLATES if len(t.text.split()) >= 25]
    noise = lambda n: [rng.choice(["of", "the", "software", "license", "public", "this", "any", "w1", "w2"]) for _ in range(n)]
    rows, want = [], {}
    for k, t in enumerate(long * 6):
        rows.append((k, " ".join(noise(60) + changed(t.text.split(), rng, 0.12) + noise(60))))
        want[k] = t.label
    rows += [(1000 + k, " ".join(noise(200))) for k in range(30)]
    found, places = licenses.scan(spark.createDataFrame(rows, DOC))
    got = {r.doc_id: r.labels.split(",") for r in found.collect()}
    assert np.mean([want[k] in got[k] for k in want]) >= 0.9
    assert not any(label in got[k] for k in got if k >= 1000 for label in ("bsd", "isc", "unlicense", "gpl", "mpl-2.0"))
    for r in places.where("label = 'isc'").collect():
        assert 45 <= r.begin <= 75 and r.cover >= licenses.MIN_COVER


def test_neighbouring_diagonals_are_merged(spark):
    t = licenses.Template("t", " ".join(f"w{i}" for i in range(30)))
    words = [f"w{i}" for i in range(30)]
    split = words[:10] + ["new"] * 3 + words[10:20] + words[22:]
    far = words[:14] + ["gap"] * 20 + words[14:]
    rows = [(1, " ".join(words)), (2, " ".join(split)), (3, " ".join(far)), (4, " ".join(words * 2))]
    found, places = licenses.scan(spark.createDataFrame(rows, DOC), (t,))
    got = {r.doc_id: (r.labels, round(r.score, 4)) for r in found.collect()}
    assert got == {1: ("t", 1.0), 2: ("t", round(28 / 30, 4)), 3: ("", round(16 / 30, 4)), 4: ("t", 1.0)}
    assert sorted((r.doc_id, r.begin, r.end) for r in places.collect()) == [(1, 0, 30), (2, 0, 31), (4, 0, 30), (4, 30, 60)]


def test_scan_is_native(spark):
    docs = spark.createDataFrame(ODD, DOC)
    for df in (licenses.hits(docs), licenses.scan(docs)[0]):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(ValueError):
        licenses.hits(docs, (licenses.Template("a", "one"),))


# Centroid clustering


def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [min(max(x, -vafile.LARGEST), vafile.LARGEST) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [(i, nearest(v), far(v, centroids[nearest(v)])) for i, v in kept], centroids


def vectors(kind, rng):
    if kind == "close":
        return [(i, [float(x) for x in rng.normal(0, 0.1, 64)]) for i in range(150)]
    if kind == "equal":
        return [(i % 40, [float(i % 3)] * 64) for i in range(90)]
    if kind == "few":
        return [(5, [0.5] * 64), (None, [-0.5] * 64), (7, [0.1] * 64)]
    odd = [(1, None), (2, []), (3, [0.1] * 63), (4, [0.1] * 63 + [None]), (5, [float("nan")] + [0.0] * 63), (6, [float("inf")] + [0.0] * 63), (7, [1e30, -1e30] + [0.0] * 62)]
    return odd + [(10 + i, [float(x) for x in rng.standard_cauchy(64)]) for i in range(60)]


@pytest.mark.parametrize("kind", ["close", "equal", "few", "odd"])
def test_clusters_against_a_plain_version(spark, kind):
    rows = vectors(kind, np.random.default_rng(1))
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    found, centroids = vafile.cluster(vafile.whole_vectors(df))
    want, ends = plain_clusters(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([tuple(r) for r in found.collect()], key=key) == sorted(want, key=key)
    assert centroids.tolist() == ends


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")
    found, centroids = vafile.cluster(vafile.whole_vectors(none))
    assert found.collect() == [] and len(centroids) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(1, 9), st.integers(1, 40))
def test_intervals_hold_the_distances(seed, dimensions, k, spread):
    rng = np.random.default_rng(seed)
    m = rng.integers(-spread, spread + 1, (50, dimensions))
    cells = vafile.Cells.cut(m[:20], m.min(0), m.max(0))
    centroids = rng.integers(-2 * spread, 2 * spread + 1, (k, dimensions))
    exact, near = vafile.exact_distances(m, centroids), cells.nearest(cells.packed(m), centroids)
    told = near >= 0
    assert (near[told] == exact.argmin(1)[told]).all()  # argmin takes the first of equal ones, too
    lower, upper = cells.tables(centroids)
    for d, cell in enumerate(cells.unpacked(cells.packed(m)).T):
        each = np.square(m[:, d, None] - centroids.T[d][None, :])
        assert (lower[d][cell] <= each).all() and (each <= upper[d][cell]).all()


def test_cells_tell_most_vectors(spark):
    whole = vafile.whole_vectors(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    _, centroids = vafile.cluster(whole)
    assert 0 <= vafile.overlapping(whole, centroids) < 0.1


# Ranked search


def plain_ranking(docs, items, k=20):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: [w.translate(LOWER) for w in pattern.findall(t or "")]
    known = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    documents, total = len(known), sum(n for *_, n in known)
    df = Counter(w for _, c, _ in known for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, counts, n in known:
            m = 100 - 25 + (25 * n * documents) // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1))) * ((1000000000 * counts[w]) // (1000 * counts[w] + 12 * m)) for w in terms(text) if w in counts)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return out


def ranked(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


@pytest.mark.parametrize(("shard", "block"), [(8192, 10_000), (7, 3)])
def test_ranking_against_a_plain_version(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical, "SHARD_ROWS", shard)
    rng = random.Random(shard)
    words = [f"w{min(int(rng.expovariate(0.12)), 60)}" for _ in range(4000)] + ["É", "é", "1", "x_y"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    docs += [(500, docs[0][1])] * 3 + [(None, docs[1][1]), (600, None), (601, ""), (602, "!?"), (603, "w1 " * 50_000), (604, "W1 É")]
    items = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(8)] + [(90, None), (91, ""), (92, "none of these"), (93, "w1 w1 É"), (None, "w2 w3"), (94, "w5 w6"), (94, "w5 w6")]
    df = clashing(spark.createDataFrame(docs, DOC).repartition(3))
    found = lexical.search(df, clashing(spark.createDataFrame(items, "item_id long, text string")))
    assert ranked(found) == sorted(plain_ranking(docs, items), key=str)
    assert lexical.search(df.where("false"), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert lexical.search(df, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_accumulators_are_limited():
    rng = np.random.default_rng(1)
    n = 5000
    term = np.concatenate([np.zeros(40, int), np.ones(200, int), np.full(n, 2)])
    place = np.concatenate([rng.choice(n, 40, replace=False), rng.choice(n, 200, replace=False), np.arange(n)])
    factor = np.concatenate([np.full(40, 400_000), np.full(200, 300_000), rng.integers(1000, 100_000, n)])
    shard = lexical.Shard(n, term, place, factor)
    query = [(0, 6000), (1, 3000), (2, 50)]
    found, scores, made = shard.scores(query, 20, 0)
    assert made == 40  # the second term's list can no longer bring a document among the best twenty
    whole = np.zeros(n, np.int64)
    np.add.at(whole, place, np.array([6000, 3000, 50])[term] * factor)
    best = np.lexsort((np.arange(n), -whole))[:20]
    assert sorted(zip(-scores, found, strict=True))[:20] == sorted(zip(-whole[best], best, strict=True))
    assert shard.scores(query, 20, int(whole.max()) * 9)[2] == 0  # others elsewhere are better than all here


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 20)), max_size=120), st.integers(1, 5))
def test_best(rows, k):
    scores, ids = np.array([s for s, _ in rows], np.int64), np.array([i for _, i in rows], np.int64)
    top = lexical.best(ids, scores, k)
    assert [(scores[i], ids[i]) for i in top] == [(-s, i) for s, i in sorted((-s, i) for s, i in rows)[:k]]


# Earlier operators: what does not depend on the layout, and sizes


def test_the_span_classifier_does_not_depend_on_the_layout(spark):
    from larder.llm import pii

    rows = [(i, f"mail a{i}@b{i % 7}.org or ring +44 20 {7000 + i} 1234, Mr John Smith{i}, key AKIA{i:016d} at 10.0.{i % 250}.7") for i in range(400)]
    found = pii.candidates(spark.createDataFrame(rows, DOC))
    fits = [pii.fit(found.repartition(n), train_spans=20) for n in (2, 7)]
    flat = [r.spans for r in found.limit(50).collect()]
    assert [list(fits[0].accepts(f)) for f in flat] == [list(fits[1].accepts(f)) for f in flat]


def test_the_language_model_follows_what_languages_have(spark):
    import pickle

    from larder.llm import langid

    rng, letters = random.Random(1), "abcdefghijklmnop"
    rows = [(lang * 50 + k, " ".join("".join(rng.choices(letters, k=6)) for _ in range(40)), f"l{lang:03d}") for lang in range(120) for k in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    entries = sum(len(e.lang) for e in model.entries.values())
    assert len(model.languages) > 100 and len(pickle.dumps(model)) < 60 * entries + 2_000_000
    dense = sum(e.table.size for e in model.entries.values()) * len(model.languages)
    assert entries < dense / 5
