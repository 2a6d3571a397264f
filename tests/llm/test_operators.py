"""Each training-data operator against a plain version, and on odd inputs."""

import hashlib
import itertools
import json
import random
import re
import tarfile
import time
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import common, decontam, htmltext, langid, lm, media, packing, pii, runs, simhash, tokenfile, tokens, warc

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (3, "one", "en", None, 3),
    (4, "the same text here, mail me at a.b@c.org today", "en", "a", 1),
    (5, "the same text here, mail me at a.b@c.org today", "en", "a", 1),
    (5, "the same text here, mail me at a.b@c.org today", "en", "a", 1),
    (None, "no id here but some words", "en", "a", 1),
    (7, "12 34 -- !!", "en", "a", 1),
    (8, "mot é̀ ünd \x00 null " + "long " * 30_000, "de", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, DOC)
    clashing = ["bits", "name", "component_id", "curve", "ids", "row", "word", "n", "c", "spans", "digest", "shard", "score", "held_out", "key", "count"]
    return rows.withColumns({c: F.lit("clash") for c in clashing})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@cache
def plain_tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def plain_ids(name, texts, end):
    t = plain_tokenizer(name)
    return [[*e.ids, end] for e in t.encode_batch(list(texts), add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Tokenizers


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBz é́İßΣς'st.,;|!\n\t\r \x1c\x85 　1٣²<|endoftext|>"), max_size=40))
def test_memo_tokenizer_is_exact(text):
    for name, cut in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")):
        texts = [text, "", text[::-1], text * 9]
        ids, sizes = zip(*tokens.memo_tokenizer(public_tokenizers.path(name), cut).encode(texts, 7), strict=True)
        want = plain_ids(name, texts, 7)
        assert np.concatenate(ids).tolist() == [i for x in want for i in x] and np.concatenate(sizes).tolist() == [len(x) for x in want]


def test_memo_tokenizer_of_documents(docs):
    texts = [r.text or "" for r in docs.collect()] + ["x" * 500 + " y", "Wort, wörter; ÉCOLE! a.b <|endoftext|> don't", "many words,  and\n\n more " * 60_000] * 2
    for name, cut in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")):
        ids, sizes = zip(*tokens.MemoTokenizer(public_tokenizers.path(name), cut).encode(texts, 7), strict=True)
        want = plain_ids(name, texts, 7)
        assert np.concatenate(sizes).tolist() == [len(x) for x in want]
        assert np.concatenate(ids).tolist() == [i for x in want for i in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=5), min_size=1, max_size=300))
def test_runs_are_found_by_hash(words):
    table, words = runs.Table(2), list(dict.fromkeys(words))
    half = words[: len(words) // 2]
    table.add(runs.hash_of(half), np.arange(len(half)))
    assert table.find(runs.hash_of(words)).tolist() == [k if k < len(half) else -1 for k in range(len(words))]
    text, codes, starts = runs.joined(["a" * 7, " ".join(words)])
    begin = [7 + 1 + sum(len(w) + 1 for w in words[:k]) for k in range(len(words))]
    assert (runs.hashes(codes, np.array(begin), np.array([b + len(w) for b, w in zip(begin, words, strict=True)])) == runs.hash_of(words)).all()


def test_token_file(spark, docs, odd):
    for rows in (docs, odd):
        texts = rows.select("doc_id", "text").toPandas().fillna({"text": ""})
        texts["h"] = rows.select(F.xxhash64("text").alias("h")).toPandas().h
        texts = texts.sort_values(["doc_id", "h"], na_position="first")
        want, start = [], 0
        for doc_id, ids in zip(texts.doc_id, plain_ids("byte_bpe_50k.json", texts.text, 0), strict=True):
            want.append((-1 if pd.isna(doc_id) else doc_id, start, len(ids), crc(ids)))
            start += len(ids)
        manifest = tokenfile.write_tokens(rows, public_tokenizers.path("byte_bpe_50k.json"))
        got = tokenfile.read_tokens(manifest).toPandas().fillna(-1)
        assert sorted(map(tuple, got[["doc_id", "start", "n_tokens", "ids_crc32"]].astype(int).to_numpy().tolist())) == sorted(tuple(map(int, w)) for w in want)
    part = manifest.collect()[-1]
    file = tokenfile.TokenFile(f"{part.path}.arrow")
    ids, mask = file.sequence((part.tokens - 1) // tokenfile.SEQUENCE)
    assert len(ids) == len(mask) == tokenfile.SEQUENCE
    assert mask.sum() == (part.tokens - 1) % tokenfile.SEQUENCE + 1
    assert ids[mask][-1] == tokenfile.END_ID


def test_packing(spark, docs, odd):
    for rows in (docs, odd):
        texts = rows.select("doc_id", "text").distinct().toPandas().fillna({"text": "", "doc_id": -1})
        ids = dict(zip(texts.doc_id, plain_ids("word_bpe_49k.json", texts.text, packing.END_ID), strict=True))
        got = packing.pack(rows, public_tokenizers.path("word_bpe_49k.json")).toPandas().fillna({"doc_id": -1})
        for doc_id, pieces in (got[got.doc_id != 5] if rows is odd else got).groupby("doc_id"):  # 5 is there twice
            at = 0
            for p in pieces.sort_values("start").itertuples():
                assert (p.start, p.ids_crc32, p.doc_tokens) == (at, crc(ids[doc_id][at : at + p.length]), len(ids[doc_id]))
                at += p.length
            assert at == len(ids[doc_id])
        for _, pieces in got.groupby("sequence_id"):
            at = 0
            for p in pieces.sort_values("offset").itertuples():
                assert p.offset == at and p.length > 0
                at += p.length
            assert at <= packing.SEQUENCE and at & (at - 1) == 0  # no padding is needed
    assert got.length.sum() == sum(len(ids[-1 if d is None else d]) for d, *_ in ODD)


def test_hilbert_key_is_a_curve():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    order = np.argsort(packing.hilbert_key(points, 3))
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()
    assert len(set(packing.hilbert_key(points, 3).tolist())) == 512


# SimHash


def plain_fingerprint(text):
    words = [w for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict) -> dict:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("cell", [1024, 7])
def test_near_duplicates(spark, docs, odd, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)  # 7: many buckets become grids
    rng = random.Random(1)
    base = " ".join(rng.choice("abcdefgh") * 3 for _ in range(400)).split()
    near = []
    for k in range(150):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = f"w{k}"
        near.append((10_000 + k, " ".join(words), "en", "s", 1))
    for rows in (docs.union(spark.createDataFrame(near, DOC)), odd.where("doc_id is not null")):
        texts = rows.select("doc_id", "text").toPandas()
        prints = {i: plain_fingerprint(t) for i, t in zip(texts.doc_id, texts.text, strict=True)}
        got = simhash.near_duplicates(rows).toPandas()
        assert len(got) == len(texts)
        assert {i: b & (1 << 64) - 1 for i, b in zip(got.doc_id, got.bits, strict=True)} == prints
        assert dict(zip(got.doc_id, got.component_id, strict=True)) == plain_components(prints)


def test_components_of_odd_graphs(spark):
    graphs = [[(i + 1, i) for i in range(40)], [(100 + i // 2, i) for i in range(30)] + [(100 + i // 2, i + 1) for i in range(1, 29)]]
    for links in graphs:
        found = simhash.components(spark, spark.createDataFrame(links, "a long, b long")).toPandas()
        assert set(found.root) == {0} and set(found.name) == {n for link in links for n in link} - {0}


def test_rows_without_id_share_a_component(spark):
    rows = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "x y z q")], "doc_id long, text string")
    assert Counter(r.component_id for r in simhash.near_duplicates(rows).collect()) == {3: 2, None: 1}


# Language


def test_language_of_held_out_documents(spark, docs):
    found = langid.identify(docs, langid.fit(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97
    assert found.score.between(0, 1).all()


def test_language_of_odd_rows(spark, odd, empty):
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd, langid.fit(odd)).collect()]
    assert len(got) == len(ODD) and {p for d, p in got if d in (1, 2, 7)} == {"und"} and dict(got)[3] != "und"
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(empty)).collect()} == {"und"}


def test_every_word_and_gram_of_the_sample_is_kept(spark):
    rng = random.Random(3)
    words = {lang: {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)} for lang, n in (("en", 60_000), ("xx", 300))}
    rows = [(k, " ".join(some), lang) for lang, all_ in words.items() for k, some in enumerate(itertools.batched(sorted(all_), 1000)) if zlib.crc32(str(k).encode()) % 4 != 2]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learnt = {w for _, text, _ in rows for w in text.split()}
    assert model.entries[0].table.size == len(learnt) and sum(e.table.size for e in model.entries.values()) > 200_000
    for size in langid.GRAM_SIZES:
        known = {g for w in learnt for g in langid.grams(w, size)}
        assert model.entries[size].table.size == len(known) and (model.entries[size].table.find(runs.hash_of(sorted(known))) >= 0).all()


def many_texts(n):
    """Labelled documents over the former sample of 2000 a language, a word of its own in each."""
    rng = random.Random(5)
    return [(k, f"the boat {''.join(rng.choices('bcdfghklmnprstvw', k=9))}", "en") for k in range(n)] + [(k, "das Haus am Fluss", "de") for k in range(n, 2 * n)]


def test_all_labelled_documents_are_learned_from(spark):
    rows = many_texts(3200)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    learnt = [text for k, text, lang in rows if lang == "en" and zlib.crc32(str(k).encode()) % 4 != 2]
    assert len(learnt) > 2200 and (model.entries[0].table.find(runs.hash_of([t.split()[2] for t in learnt])) >= 0).all()
    assert np.isclose(np.exp(-model.entries[0].floor[1]) * langid.SMOOTHING, 3 * len(learnt) + langid.SMOOTHING * model.entries[0].table.size)
    assert langid.Predictor(model).predict([learnt[7]])[2].tolist() == [3]


@pytest.mark.parametrize("most", [0, 3, 400])
def test_words_beyond_the_broadcast_are_joined(spark, docs, odd, monkeypatch, most):
    rows = docs.union(odd.select(docs.columns))
    want = sorted(map(tuple, langid.identify(rows, langid.fit(rows)).collect()), key=str)
    monkeypatch.setattr(langid, "BROADCAST_WORDS", most)
    model = langid.fit(rows)
    assert model.rest.count() > 0 and model.entries[0].table.size <= most
    got = sorted(map(tuple, langid.identify(rows, model).collect()), key=str)
    assert [(*x[:3], x[4]) for x in got] == [(*x[:3], x[4]) for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-4)
    assert langid.identify(rows.where("false"), model).count() == 0


def plain_model(rows):
    """log frequencies by size and n-gram, from (lang, size, n-gram, n)."""
    languages = sorted({r[0] for r in rows})
    logs = {}
    for size in (0, *langid.GRAM_SIZES):
        counts = {g: [langid.SMOOTHING + sum(r[3] for r in rows if r[:3] == (lang, size, g)) for lang in languages] for g in {r[2] for r in rows if r[1] == size}}
        whole = [sum(c) for c in zip(*counts.values(), strict=True)]
        logs[size] = {g: [np.log(x / w) for x, w in zip(c, whole, strict=True)] for g, c in counts.items()}
    return languages, logs


def plain_language(languages, logs, text):
    words = ["".join(g) for yes, g in itertools.groupby(text, str.isalpha) if yes]
    total, known = np.zeros(len(languages)), 0
    for word in map(str.lower, words):
        for size in (0, *langid.GRAM_SIZES):
            found = [logs[size][g] for g in ([word] if size == 0 else langid.grams(word, size)) if g in logs[size]]
            if found:
                total, known = total + np.mean(found, axis=0), known + (size != 1)
                break
    odds = np.exp((total - total.max()) / max(1, len(words)) ** 0.5)
    return (languages[odds.argmax()], odds.max() / odds.sum(), known) if words else ("und", 0.0, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcÉß \n1_", max_size=30), max_size=6), st.lists(st.tuples(st.sampled_from(["de", "en", "fr"]), st.text(alphabet="abcé", min_size=1, max_size=6)), min_size=1, max_size=12))
def test_language_against_a_plain_scorer(texts, sample):
    counts = Counter((lang, size, g) for lang, word in sample for size in (0, *langid.GRAM_SIZES) for g in ([word] if size == 0 else langid.grams(word, size)))
    rows = [(*k, n) for k, n in counts.items()]
    found = pa.table(dict(zip(("lang", "size", "gram", "n"), (pa.array(c) for c in zip(*rows, strict=True)), strict=True)))
    languages, logs = plain_model(rows)
    want = [plain_language(languages, logs, t) for t in texts]
    got = list(zip(*langid.Predictor(langid.Model(languages, found)).predict(texts), strict=True))
    for (lang, score, known), (lang2, score2, known2) in zip(got, want, strict=True):
        assert known == known2 and score == pytest.approx(score2, abs=1e-4) and (lang == lang2 or abs(score - 1 / 2) < 0.2)


def test_ties_and_long_texts_of_language():
    rows = {"lang": ["en", "fr", "en", "fr"], "size": [0, 0, 0, 0], "gram": ["the", "le", "x", "x"], "n": [9, 9, 3, 3]}
    own = langid.Predictor(langid.Model(["fr", "en"], pa.table(rows)))
    lang, score, known = own.predict(["x", "???", "le " * 400_000 + "the", "xyz", None])
    assert lang == ["en", "und", "fr", "en", "und"] and known.tolist() == [1, 0, 400_001, 0, 0] and score[0] == score[3] == 0.5 and score[2] > 0.99


# Language model


def test_base_score_and_model(spark, docs, odd, empty):
    for rows in (docs, odd):
        data = [(r.doc_id, r.text or "") for r in rows.select("doc_id", "text").collect()]
        split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b"\n"]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        counts = Counter(w for i, t in data if i is not None and not held(i) for w in split(t))
        whole, distinct = sum(counts.values()), len(counts)
        want = sorted((str(i), held(i), len(w := split(t)), sum(counts[x] > 0 for x in w), whole, round(sum(np.log10((counts[x] + 1) / (whole + distinct + 1)) for x in w), 6)) for i, t in data)
        got = lm.score(rows).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert lm.score(empty).collect() == []


def plain_tree(texts):
    """Kept contexts and the counts of what follows them, by the definition, from the shortest to the longest."""
    counts: dict[bytes, Counter] = {}
    for t in texts:
        history = b"\n" * lm.DEPTH + t
        for i in range(lm.DEPTH, len(history)):
            for d in range(lm.DEPTH + 1):
                counts.setdefault(history[i - d : i], Counter())[history[i]] += 1
    kept = {b"": counts[b""]}
    for context in sorted(counts, key=len):
        own, total = counts[context], counts[context].total()
        if context and total >= lm.MIN_COUNT:
            suffix = kept[next(context[k:] for k in range(1, len(context) + 1) if context[k:] in kept)]
            gain = sum(n * np.log(n / total / (suffix[s] / suffix.total())) for s, n in own.items())
            if gain >= lm.MIN_GAIN * len(own):
                kept[context] = own
    return kept


def plain_chance(kept, context: bytes, symbol: int) -> float:
    state = next(context[k:] for k in range(len(context) + 1) if context[k:] in kept)
    counts = kept[state]
    if not state:
        return (counts[symbol] + 1) / (counts.total() + 256)
    return (counts[symbol] + lm.PRIOR * plain_chance(kept, state[1:], symbol)) / (counts.total() + lm.PRIOR)


@pytest.mark.parametrize("least", [4, 256])
def test_suffix_tree_against_a_plain_one(spark, docs, monkeypatch, least):
    monkeypatch.setattr(lm, "MIN_COUNT", least)
    monkeypatch.setattr(lm, "MIN_GAIN", 1.0)
    train = docs.where("length(text) < 3000").limit(40).select("text")
    texts = [lm.stream((r.text or "").encode().lower().split()) for r in train.collect()]
    table, kept = lm.kept_contexts(train).toArrow(), plain_tree(texts)
    got = {int(r["context"]).to_bytes(8, "big")[8 - r["depth"] :]: {x["next"]: x["n"] for x in r["follow"]} for r in table.to_pylist()}
    assert got == kept and max(map(len, kept)) > 2
    some = [*texts[:3], b"\n", "zzz ünseen ☃ words\n".encode(), texts[0][:-1] * 3]
    want = []
    for text in some:
        history = b"\n" * lm.DEPTH + text
        want.append(sum(np.log10(plain_chance(kept, history[i - lm.DEPTH : i], history[i])) for i in range(lm.DEPTH, len(history))))
    assert lm.Tree(table).score(some) == pytest.approx(want, rel=1e-6)
    slices, tables = lm.sliced(table, 500)
    assert len(tables) > 2 and all(t.num_rows < table.num_rows for t in tables)
    assert sum(lm.Tree(t).score(some, slices, k) for k, t in enumerate(tables)) == pytest.approx(want, rel=1e-6)
    monkeypatch.setattr(lm, "_SYMBOLS_AT_ONCE", 100)
    assert lm.Tree(table).score(some) == pytest.approx(want, rel=1e-6)


def test_scores_do_not_depend_on_slices(spark, docs, monkeypatch):
    whole = {r.doc_id: r.score for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "sliced", lambda rows, f=lm.sliced: f(rows, 3000))
    assert {r.doc_id: pytest.approx(r.score, rel=1e-9) for r in lm.score(docs).collect()} == whole


def test_a_gram_is_looked_up_once(spark, docs, monkeypatch):
    """Scores are the same to the last bit whether all, some or no grams are remembered, and the tree is asked once for each."""
    table = lm.kept_contexts(docs.select("text")).toArrow()
    texts = [lm.stream((r.text or "").encode().lower().split()) for r in docs.limit(300).collect()]
    grams, asked, find = len(lm.grams_of(texts)[0]), [], lm.Tree._find
    monkeypatch.setattr(lm.Tree, "_find", lambda self, context, symbol: asked.append(len(symbol)) or find(self, context, symbol))
    tree = lm.Tree(table)
    asked.clear()
    whole = tree.score(texts)
    assert sum(asked) == grams < sum(map(len, texts)) / 3 and np.array_equal(tree.score(texts), whole) and sum(asked) == grams
    for some in (1, 500):
        monkeypatch.setattr(lm, "_REMEMBERED", some)
        tree = lm.Tree(table)
        assert np.array_equal(tree.score(texts), whole) and tree.memo.size <= some


def test_the_tree_grows_with_the_corpus(spark, docs):
    sizes = [lm.kept_contexts(docs.where(f"doc_id % {k} = 0").select("text")).count() for k in (8, 1)]
    assert sizes[1] > 2 * sizes[0]


# Media


def test_media(spark, odd, docs, empty):
    for rows in (docs, odd):
        got = media.media_columns(rows).toPandas()
        texts = rows.select("doc_id", "text").toPandas()
        assert len(got) == len(texts)
        for doc_id, group in texts.groupby("doc_id"):
            text = (group.text.iloc[0] or "").encode()
            payload = text + bytes(-len(text) % 64 or (0 if text else 64))
            mine = got[got.doc_id == doc_id].iloc[0]
            assert (mine.n_bytes, mine.payload_bytes) == (len(text), len(payload))
            assert (mine.payload_sha256, mine.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (mine.width, mine.height, mine.bits) == (64, len(payload) // 64, 8)
            image = media.png_encode(payload)
            assert (mine.media_bytes, mine.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
            whole = sum(payload) / 64
            stretches = [sum(payload[k * len(payload) // 64 : (k + 1) * len(payload) // 64]) for k in range(64)]
            assert mine.feature == "%016x" % sum(1 << (63 - k) for k, s in enumerate(stretches) if s > whole)
    shard = media.store(odd)[1].first().shard
    with tarfile.open(shard.removeprefix("file:")) as tar:
        for member in tar.getmembers():
            payload = media.png_decode(tar.extractfile(member).read())
            assert member.name == hashlib.sha256(payload).hexdigest() + ".png"
    assert media.media_columns(empty).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_hot_keys_are_joined_and_spread(spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    keys = [7] * 900 + list(range(100)) + [None, 5000]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, i long").repartition(3)
    groups = [(k, n, k * 10) for k, n in Counter(keys).items() if k is not None and k < 5000]
    joined = common.join_groups(rows, spark.createDataFrame(groups, "key long, n long, v long"), "key", broadcast_rows)
    assert joined.columns == ["key", "i", "v"]
    assert sorted((r.i, r.key, r.v) for r in joined.collect()) == [(i, k, k * 10 if k is not None and k < 5000 else None) for i, k in enumerate(keys)]


# WARC


def page_rows():
    big, other = "<p>" + "x" * 1500, "<p>" + "ü" * 500
    return [(1, "http://a/ b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (9, "u", big), (9, "u", big), (7, "u", other), (None, "u", other), (10, "u", "\x1f\x8b\x08WARC/1.1\r\n" * 200)]


@pytest.mark.parametrize(("range_bytes", "broadcast_groups"), [(97, 1000), (None, 1000), (None, 0)])
def test_warc(spark, range_bytes, broadcast_groups):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "size": F.lit(0)})
    got = warc.read_archives(warc.write_archives(pages.repartition(3), broadcast_groups), range_bytes).collect()
    largest: dict = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    want = []
    for i, _, h in rows:
        refers = largest.get(h) if largest.get(h) != i else None
        data = (h or "").encode()
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted(map(str, got)) == sorted(str(type(got[0])(*w)) for w in want) or sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_many_groups_of_copies_move_no_page(spark, monkeypatch):
    """Beyond the broadcast only digests are shuffled, and the archives are the same."""
    kept = {}
    pages = spark.range(3000).select("id", F.lit("u").alias("url"), F.concat(F.lit("p"), (F.col("id") % 700).cast("string"), F.lit("x" * 1200)).alias("html")).withColumnRenamed("id", "page_id").repartition(5)
    plain = warc.read_archives(warc.write_archives(pages)).collect()
    real = common.staged

    def spied(session, df, name):
        kept[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(session, df, name)

    monkeypatch.setattr(warc, "staged", spied)
    many = warc.read_archives(warc.write_archives(pages, 10)).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, plain)) and sum(r.record_type == "revisit" for r in many) == 2300
    assert "Exchange" not in kept["warc-manifest"] and "Join" not in kept["warc-manifest"]


def test_warc_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0


# Personal data

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(_BASE.items()):
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (2 if j % 2 else 1) for j, d in enumerate(reversed(n))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(n) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, "phone": 8 <= len(n) <= 15}[kind]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("019.@+-( )aé%_"), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_documents(spark, docs, odd):
    for rows in (docs, odd):
        got = pii.find(rows).toPandas()
        texts = rows.select("doc_id", "text").toPandas()
        assert len(got) == len(texts)
        for doc_id, text in zip(texts.doc_id, texts.text, strict=True):
            spans = plain_spans(text or "")
            mine = got[got.doc_id == doc_id] if doc_id == doc_id else got[got.doc_id.isna()]
            names = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
            assert mine.base_sha256.iloc[0] == hashlib.sha256(names.encode()).hexdigest()
            assert set(filter(None, names.split(","))) <= set(mine.spans.iloc[0].split(","))
            assert mine.n_card.iloc[0] == sum(k == 2 for k, *_ in spans)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + " " + "+" * 1000 + "1.1." * 50_000) is not None


def personal_rows(rng, words):
    """(text, planted kind and value or None): personal data of every added kind among words, and what only looks like it."""
    some = lambda n: " ".join(rng.choices(words, k=n))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    hexes = lambda n: "1a7" + "".join(rng.choices("0123456789abcdef", k=n - 3))
    name = lambda: rng.choice("Anders Brück Castel Dumont Evans Fischer Garcia Huber".split())

    def account():
        number = digits(18)
        return f"DE{98 - int(number + '131400') % 97:02d}{number}"

    real = {
        "local_phone": lambda: (rng.choice(["call me at", "my phone is", "Telefon"]), rng.choice([f"({digits(3)}) 555-{digits(4)}", f"212-555-{digits(4)}", f"030 {digits(4)} {digits(3)}"])),
        "national_id": lambda: (rng.choice(["her ssn is", "social security number"]), f"1{digits(2)}-4{digits(1)}-5{digits(3)}"),
        "bank_account": lambda: (rng.choice(["iban", "transfer it to the account"]), account()),
        "spelled_email": lambda: ("write to", f"{name().lower()} [at] mail [dot] org"),
        "secret": lambda: (rng.choice(["token =", "password:", "api key is"]), rng.choice([hexes(32), f"sk-{hexes(6).upper()}xY{hexes(20)}"])),
        "birth_date": lambda: (rng.choice(["born on", "geboren am", "date of birth"]), f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.19{rng.randint(40, 99)}"),
        "street_address": lambda: (rng.choice(["she lives at", "my address is"]), f"{rng.randint(1, 99)} {name()} Street"),
        "person": lambda: (rng.choice(["signed by", "contact"]), f"{rng.choice(['Mr.', 'Dr.', 'Frau'])} {rng.choice(['Anna', 'Peter', 'Maria'])} {name()}"),
    }
    decoys = [
        lambda: ("version", f"{digits(3)}.555.{digits(4)}="), lambda: ("invoice", f"9{digits(2)}-00-{digits(4)}"), lambda: ("part", f"XX{digits(2)}{digits(12)}/"),
        lambda: ("see page", f"{rng.randint(40, 99)}.{rng.randint(13, 40)}.{rng.randint(2100, 2990)}"), lambda: ("the file", f"aaaaaaaaaaaaaa1{'a' * rng.randint(2, 9)}"),
    ]
    out = []
    for kind, make in real.items():
        for _ in range(60):
            cue, value = make()
            out.append((f"{some(6)} {cue} {value} {some(6)}", (kind, value)))
    for make in decoys * 60:
        cue, value = make()
        out.append((f"{some(6)} {cue} {value} {some(6)}", None))
    rng.shuffle(out)
    return out


def test_added_spans_against_planted_ones(spark):
    rng = random.Random(12)
    rows = personal_rows(rng, "lorem ipsum dolor sit amet sed do tempor magna aliqua".split())
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.find(docs).collect()}
    want = {k: {f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"} if planted else set() for k, (text, planted) in enumerate(rows) for kind, value in [planted or ("", "")]}
    for kind in pii.MORE_KINDS:
        mine = {(k, s) for k, spans in want.items() for s in spans if s.startswith(kind)}
        found = {(k, s) for k, spans in got.items() for s in spans if s.startswith(kind)}
        assert len(mine & found) >= 0.9 * len(mine), (kind, len(mine & found), len(mine))
        assert len(mine & found) >= 0.9 * len(found), (kind, sorted(found - mine)[:5])


def test_reliabilities_are_found_by_em():
    """A kind's good labeler is trusted more than its coin-tossing one; other kinds do not matter."""
    rng = random.Random(2)
    counts: Counter = Counter()
    for _ in range(4000):
        y = 1 if rng.random() < 0.5 else -1
        vote = [y if rng.random() < right else -y for right in (0.95, 0.9, 0.85, 0.5, 0.9)]
        counts[pii.pattern_of(8, tuple(vote))] += 1
    model = pii.Classifier(dict(counts), [])
    right = model.reliability[8][1, :, 2]
    assert right[0] > right[2] > right[3] and abs(right[3] - 0.5) < 0.1 and list(model.reliability) == [8]
    assert not pii.Classifier({}, []).accepts([4, 0, 3, 0] + [0] * pii.FEATURES)[0]


def test_all_candidates_are_learned_from(spark, monkeypatch):
    """Over 2000 candidates of a kind, in the driver and in Spark jobs."""
    seen, summed = [], pii._summed
    monkeypatch.setattr(pii, "ROUNDS", 4)
    monkeypatch.setattr(pii, "_summed", lambda packs, of, *x: seen.append((of, summed(packs, of, *x))) or seen[-1][1])
    docs = spark.createDataFrame([(k, f"call {k % 9} or write to a{k}.b@c{k % 7}.org") for k in range(5000)] + [(None, None)], "doc_id long, text string").repartition(3)
    found = common.staged(spark, pii.candidates(docs), "candidates")
    local = pii.fit(found)
    assert seen[0][0] is pii._uses and seen[0][1].sum() == 5000 * pii.FEATURES
    monkeypatch.setattr(pii, "LOCAL_SPANS", 100)
    monkeypatch.setattr(pii, "_PACK", 64)
    by_jobs = pii.fit(found)
    assert len(seen) == 10 and local.weights.any() and (local.weights == by_jobs.weights).all()


def test_secrets_of_documents_are_found(spark, docs):
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for r in docs.collect():
        for m in re.finditer(r'token = "([0-9A-Fa-f]{24,})"', r.text or ""):
            assert f"secret:{m.start(1)}:{m.end(1)}" in got[r.doc_id].split(",")


# Decontamination


def test_leaks_against_containment(spark, docs):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark, space_passages=16).collect()}  # several spaces and blocks
    items = [(r.item_id, decontam.words_of(r.text)) for r in benchmark.collect()]
    want = set()
    for r in docs.collect():
        words = f" {' '.join(decontam.words_of(r.text or ''))} "
        want |= {(r.doc_id, i) for i, w in items if f" {' '.join(w)} " in words}
    assert want and want <= found and len(found - want) <= 0.02 * len(found) + 1


def test_paraphrases_at_random_offsets_are_found(spark, docs):
    """Recall of each kind of change, with the items in clean text of the corpus; and nothing else is found."""
    rng = random.Random(6)
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    texts = [(r.text or "").split() for r in docs.collect()]
    df = Counter(w for t in texts for w in set(t))
    items = [r.text for r in benchmark]
    hosts = [t for t in texts if 300 < len(t) and not any(" ".join(i.split()[:6]) in " ".join(t) for i in items)]
    planted, want = [], {}
    for r in benchmark:
        words = r.text.split()
        n = len(words)
        rare = set(sorted(range(n), key=lambda k: df[words[k]])[: n // 5])
        some, more = set(rng.sample(range(n), n // 4)), set(rng.sample(range(n), int(0.35 * n)))
        sentences = [" ".join(x) for x in decontam.sentences_of(r.text)]
        kinds = {
            "verbatim": words,
            "quarter replaced": [rng.choice(rng.choice(hosts)) if k in some else w for k, w in enumerate(words)],
            "third replaced": [rng.choice(rng.choice(hosts)) if k in more else w for k, w in enumerate(words)],
            "rarest replaced": [rng.choice(rng.choice(hosts)) if k in rare else w for k, w in enumerate(words)],
            "quarter deleted": [w for k, w in enumerate(words) if k not in some],
            "inserted": [x for w in words for x in ([w, rng.choice(rng.choice(hosts))] if rng.random() < 0.3 else [w])],
            "halves swapped": words[n // 2 :] + words[: n // 2],
            "sentences shuffled": " ".join(rng.sample(sentences, len(sentences))).split(),
        }
        for kind, copy in kinds.items():
            around, at = rng.choice(hosts), rng.randrange(200)
            want.setdefault(kind, set()).add((60_000 + len(planted), r.item_id))
            planted.append((60_000 + len(planted), " ".join(around[:at] + copy + around[at:]), "en", "s", 1))
    clean = [(50_000 + k, " ".join(t), "en", "s", 1) for k, t in enumerate(hosts)]
    rows = docs.union(spark.createDataFrame(planted + clean, DOC))
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(rows, spark.createDataFrame(benchmark)).collect() if r.doc_id >= 50_000}
    assert {kind: len(w & found) / len(w) >= 0.9 for kind, w in want.items()} == dict.fromkeys(want, True)
    assert want["verbatim"] <= found and len(found - set().union(*want.values())) <= 0.01 * len(planted)


def test_factorisation(spark):
    """The Spark jobs' directions and singular values are those of the whole matrix, and lose nothing of the benchmark's passages."""
    rng = np.random.default_rng(4)
    own, sample = (np.where(rng.random((n, decontam.PASSAGE)) < 0.5, 1 + rng.zipf(1.4, (n, decontam.PASSAGE)) % 1500, 0) for n in (150, 1200))
    weights = np.append(0, np.log(4000 / (1 + 3000 / np.arange(1, 1501))))
    matrix = np.zeros((len(own) + len(sample), len(weights)))
    for k, row in enumerate(np.concatenate([own, sample])):
        np.add.at(matrix[k], row, weights[row])
        length = np.linalg.norm(weights[row])
        matrix[k] *= (1 if k < len(own) else decontam.SAMPLE_WEIGHT) / length if length else 0
    basis, values = decontam.factored(spark, own, sample, weights, len(own) + decontam.MORE_DIRECTIONS)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6) and basis.shape[1] < len(matrix)
    assert np.allclose(values[:20], np.linalg.svd(matrix, compute_uv=False)[:20], rtol=1e-3)
    kept = np.linalg.norm(matrix[: len(own)] @ basis, axis=1) / np.maximum(np.linalg.norm(matrix[: len(own)], axis=1), 1e-9)
    assert kept.min() > 0.95


def test_every_passage_is_factored(spark, docs):
    """Pairs of words are those of all passages of all documents, also in parts; a document's id does not matter to what is found."""
    known = decontam.Benchmark([(1, " ".join(r.text for r in docs.limit(30).collect()), None)])
    words, size = decontam.Words(known.vocabulary), len(known.vocabulary)
    weights = np.append(0, 1.0 + np.arange(size) % 7)
    some = docs.limit(150).union(spark.createDataFrame([(1, "", "", "", 0), (2, None, "", "", 0), (3, known.vocabulary[0], "", "", 0)], DOC)).select("text")
    want = np.zeros((size + 1, size + 1))
    for numbers, sizes in words.of([r.text for r in some.collect()]):
        for own in np.split(numbers, np.cumsum(sizes)[:-1]):
            for at in range(0, max(len(own) - decontam.STEP, 1), decontam.STEP):
                row = np.bincount(own[at : at + decontam.PASSAGE], weights[own[at : at + decontam.PASSAGE]], size + 1)
                if length := np.linalg.norm(weights[own[at : at + decontam.PASSAGE]]):
                    held = np.flatnonzero(row)
                    want[np.ix_(held, held)] += np.outer(row[held], row[held]) / length**2
    got = np.zeros_like(want)
    for r in decontam.word_pairs(some, words, weights).collect():
        got[r.left, r.right] += r.n / decontam._UNIT
    assert np.allclose(got + got.T, want, atol=1e-5) and want.max() > 10
    pairs, parts = decontam.Pairs(weights, np.arange(size + 1)), []
    pairs.in_place, pairs.often = 5, np.zeros(25, np.int64)
    for numbers, sizes in words.of([r.text for r in some.collect()]):
        parts += pairs.add(numbers, sizes)
    split = np.zeros_like(want)
    for batch in (*parts, *pairs.rest()):
        for low, high, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            split[low, np.frombuffer(high, np.int32)] += np.frombuffer(n, np.int64) / decontam._UNIT
    assert np.allclose(split + split.T, want, atol=1e-5)

    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    few = docs.where("doc_id < 400")
    found = [{(r.doc_id, *r[1:]) for r in decontam.contaminated(d, benchmark).collect()} for d in (few, few.withColumn("doc_id", F.col("doc_id") + 7_000_000))]
    assert found[0] and {(d + 7_000_000, *r) for d, *r in found[0]} == found[1]


def test_near_passages_against_brute_force(spark):
    """What is near by the whole TF-IDF vectors is near in the latent space."""
    rng = np.random.default_rng(9)
    passages = rng.integers(1, 3000, (120, decontam.PASSAGE))
    weights = np.append(0, np.log(5000 / (1 + 3000 / np.arange(1, 3001))))
    space = decontam.Space(spark, passages, np.arange(120), rng.integers(1, 60, (500, decontam.PASSAGE)), weights)
    place = np.zeros(3001, np.int32)
    place[space.words] = np.arange(len(space.words))
    texts = [np.where(rng.random(decontam.PASSAGE) < 0.35, rng.integers(1, 3000, decontam.PASSAGE), passages[k]) for k in range(120)]
    found = {(t, i) for t, i, *_ in decontam.near_passages(np.concatenate(texts), np.array([len(t) for t in texts]), space, place)}
    full = lambda words: np.bincount(words, weights[words], 3001)
    a, b = (np.array([full(w) for w in x]) for x in (texts, passages))
    cosine = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    assert len(found & set(zip(*map(list, np.nonzero(cosine >= 0.45)), strict=True))) >= 0.98 * (cosine >= 0.45).sum() > 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), min_size=1, max_size=20))
def test_lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert decontam.lcs(a, decontam.masks_of(b), len(b)) == table[-1, -1]


def test_decontamination_of_odd_rows(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, "the same text here mail me at"), (2, None), (None, "the same text here"), (3, "!!")], "item_id long, text string").withColumn("cosine", F.lit(0))
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, benchmark).collect()} == {(4, 1), (5, 1)}
    assert decontam.contaminated(empty, benchmark).count() == 0
    assert decontam.contaminated(odd, benchmark.where("false")).count() == 0


# HTML


def article(html):
    import html as entities

    inner = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
    parts = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", " ", x.replace("<b>", "").replace("</b>", "")))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_main_text(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.main_text(pages, htmltext.fit(pages)).collect()}
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(n == len(t) for t, n in got.values())


def test_other_layouts(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    model, vectors = htmltext.fit(pages), htmltext._Vectors()
    main = [b.text for r in pages.limit(12).collect() for bs in [htmltext.read_blocks(r.html)] for b, y in zip(bs, htmltext.weak_labels(bs), strict=True) if y]
    good = wrong = kept = 0
    for k in range(0, len(main) - 6, 6):
        own = main[k : k + 6]
        html = (
            f"<html><body><header class='masthead'><a href=/>Site</a></header><div class=cookie-notice>We use cookies</div><nav><ul><li><a>{own[0][:9]}</a></ul></nav>"
            f"<div class='content'>{''.join(f'<p>{t}' for t in own)}</div><section class='comments'><p>first!</p><p>I agree with that</p></section>"
            f"<aside class='sidebar'><ul><li><a>related</a></li></ul></aside><form><button>Send</button></form><footer>legal</footer></body></html>"
        )
        blocks = htmltext.read_blocks(html)
        for block, yes in zip(blocks, model.label([vectors.of(blocks)])[0], strict=True):
            real = "div.content" in block.path
            good, wrong, kept = good + (yes and real), wrong + (yes and not real), kept + real
    assert good >= 0.95 * kept and wrong <= 0.1 * good


def test_pages_without_names(spark):
    """Without classes and ids, and with plain containers for all tags that have a meaning, blocks are labelled as before."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    model, vectors = htmltext.fit(pages), htmltext._Vectors()
    names = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
    tags = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside|section|form)\b")
    agree = []
    for row in pages.where("html is not null").collect():
        want = htmltext.weak_labels(htmltext.read_blocks(row.html))
        got = model.label([vectors.of(htmltext.read_blocks(tags.sub(r"<\1div", names.sub("", row.html))))])[0]
        agree.append(len(got) == len(want) and float(np.mean(got == np.array(want, bool))))
    assert np.mean(agree) >= 0.95


def plain_page(rng, words, container, paragraphs):
    """(html, article text) of a page whose class names are in none of the labeller's lists."""
    say = lambda n: (" ".join(rng.choices(words, k=n)) + ".").capitalize()
    body = [say(4), *(say(rng.randint(15, 40)) for _ in range(paragraphs))]
    html = (
        f"<html><head><title>t</title></head><body><div class=zq1><ul>{''.join(f'<li><a href=x>{rng.choice(words)}</a></li>' for _ in range(5))}</ul></div>"
        f"{container[0]}<h2>{body[0]}</h2>{''.join(f'<p>{b}</p>' for b in body[1:])}{container[1]}"
        f"<nav><a>home</a><a>back</a></nav><div class='footer'><p>{say(12)}</p></div></body></html>"
    )
    return html, "\n".join(body)


@pytest.mark.parametrize("container,paragraphs", [(("<div class=kx>", "</div>"), 8), (("<article>", "</article>"), 72), (("<div class=kx>", "</div>"), 72), (("<main>", "</main>"), 700)])
def test_pages_of_any_size_and_layout_are_learned_from(spark, container, paragraphs):
    """Pages without article elements, pages of many blocks, and pages beyond the training bytes."""
    rng = random.Random(4)
    words = [w for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).collect() for w in (r.text or "").split()]
    made = [plain_page(rng, words, container, paragraphs) for _ in range(40)]
    pages = spark.createDataFrame([(k, "u", html) for k, (html, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(pages, htmltext.fit(pages)).collect()}
    norm = lambda t: " ".join(t.split("\n")[0].split()) and [" ".join(x.split()) for x in t.split("\n")]
    right = [len(set(norm(got[k])) & set(norm(want))) / len(set(norm(got[k])) | set(norm(want))) for k, (_, want) in enumerate(made)]
    assert np.mean(right) >= 0.97


def test_long_and_repeated_pages(spark):
    page = "<main>" + "<p>some words of a page here.</p>" * 5000 + "</main><footer>legal</footer>"
    pages = spark.createDataFrame([(1, "u", page)] * 3 + [(2, "u", page + "x"), (None, "u", page)], "page_id long, url string, html string")
    assert len(htmltext.training_pages(pages)) == 2 and max(map(len, htmltext.training_pages(pages))) == htmltext.TRAIN_BYTES
    got = htmltext.main_text(pages, htmltext.fit(pages)).collect()
    assert len(got) == 5 and all(len(r.text.split("\n")) >= 4990 for r in got)


def test_blocks_of_odd_html():
    text = lambda h: [b.text for b in htmltext.read_blocks(h)]
    assert text("") == [] and text("a < b &amp; c &nbsp; d") == ["a < b & c d"]
    assert text("<p>a<p>b<script>x<p></script>c<!-- d --><div>e") == ["a", "bc", "e"]
    assert text("<p>a <!-- never ends") == ["a"] and text("<p>x<script>never ends") == ["x"]
    assert text("<head><title>t</title></head>x<br>y") == ["x y"] and text("<a title='>'>k</a>") == ["k"]


def test_embedded_elements_do_not_cut_the_text():
    text = lambda h: [b.text for b in htmltext.read_blocks(h)]
    assert text('<p>A <svg class="i"/> B</p><p>C</p>') == ["A B", "C"] and text("<p>A <math/> B</p><p>C</p>") == ["A B", "C"]
    assert text("<p>A <svg><title>t</title><style/><g><text>x</text></g></svg> B</p><p>C</p>") == ["A B", "C"]
    assert text("<p>A <svg><svg>x</svg>y</svg> B</p>") == ["A B"] and text("<div>A<object>x<object>y</object><p>z</p></object> B</div>") == ["A B"]
    for tag in ("object", "video", "audio", "canvas", "template", "svg", "math"):
        assert text(f"<div>A <{tag} id=k> B</div><p>C</p>") == ["A B", "C"]
        assert text(f"<p>A <{tag}>x</p><p>C</p><p>D <{tag}>y</{tag}> E</p>")[-1] in ("D E", "D y E")
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert text("<p>A <video><source src=a>no video here</video> B</p>") == ["A B"] and text("<p>x<script>'</svg>'</script>y<textarea>z</textarea>") == ["xy"]
    assert text("<div>A <svg>x<p>C</p><p>D</p></div></svg>") == ["A", "C", "D"]
    assert text("<p>x<object data=y/><p>rest") == ["x", "rest"] and text("<p>x<iframe src=y /><p>rest") == ["x", "rest"]
    assert text("<p>x<iframe src=y><p>rest") == ["x", "rest"] and text("<p>x<iframe>y</iframe>z<noscript>n</noscript>") == ["xz"]
    assert text("<article><p>one<audio src=x><p>two<p>three</article>") == ["one", "two", "three"]
    assert len(text("<p>a<iframe>" * 20_000)) == 20_000  # in linear time


@pytest.mark.parametrize("unit", ["<a ", "<span>x", "<b>x", "<div>x", '<a ">"', "<span></b>", "</script ", "<p><li>x</ul>", "<object>x", "<svg>x<p>", '<a "'])
def test_malformed_pages_take_linear_time(unit):
    took = []
    for size in (100_000, 400_000):
        html = unit * (size // len(unit)) + "'"
        began = time.process_time()
        blocks = htmltext.read_blocks(html)
        htmltext.weak_labels(blocks)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.3


def test_html_of_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags"), (3, "u", "no tags"), (None, "u", "<article><p>x</p></article>"), (5, "u", "<article>" + "<p>word here.</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = htmltext.main_text(pages, htmltext.fit(pages)).collect()
    assert len(got) == len(rows) and {r.n_chars for r in got if r.page_id in (1, 2)} == {0}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.main_text(none, htmltext.fit(none)).count() == 0


def test_gradients():
    """Back-propagation agrees with differences."""
    rng = np.random.default_rng(0)
    model = htmltext.Labeller(3, 2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, live = htmltext.padded([rng.normal(size=(n, 3)).astype(np.float32) for n in (4, 2)])
    y = np.where(live, rng.integers(0, 2, live.shape), 0).astype(np.float32)

    def loss():
        p = np.clip(model.forward(x, live)[0], 1e-6, 1 - 1e-6)
        return -np.where(live, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / live.sum()

    for name, g in model.gradients(x, live, y).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        model.p[name][at] += 1e-3
        up = loss()
        model.p[name][at] -= 2e-3
        down = loss()
        model.p[name][at] += 1e-3
        assert g[at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "12 34", "en", "s", 5), (90_003, "write to a.b@c.org please, reader of mine", "en", "s", 3)], DOC)
    docs = docs.union(odd).withColumn("bits", F.lit("clash"))
    kept, columns = docs, docs.columns
    frames = []
    for name, stage in pipeline.STAGES[:-1]:
        kept = common.staged(spark, stage(spark, kept, SMALL), name)
        assert kept.columns == columns
        frames.append(kept.toPandas())
    texts = docs.toPandas()
    lettered = texts[[bool(t) and any(c.isalpha() for c in t) for t in texts.text]]
    assert set(frames[0].doc_id) == set(lettered.doc_id)
    prints = {i: plain_fingerprint(t) for i, t in zip(lettered.doc_id, lettered.text, strict=True)}
    firsts = {i for i, c in plain_components(prints).items() if i == c}
    assert set(frames[1].doc_id) == firsts
    benchmark = [" ".join(decontam.words_of(t)) for t in pd.read_parquet(f"{SMALL}/benchmark.parquet").text]
    leaky = {i for i, t in zip(frames[1].doc_id, frames[1].text, strict=True) if any(f" {b} " in f" {' '.join(decontam.words_of(t))} " for b in benchmark)}
    assert leaky and not leaky & set(frames[2].doc_id) and len(frames[2]) >= len(frames[1]) - len(leaky) - 1
    assert not any(plain_spans(t) for t in frames[3].text) and (frames[3].n_chars == frames[3].text.str.len()).all()
    assert "<email>" in frames[3].set_index("doc_id").text[90_003]
    packed = pipeline.STAGES[-1][1](spark, kept, SMALL).toPandas()
    assert set(packed.doc_id) == set(frames[3].doc_id)
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()


def test_registered_queries():
    from larder.llm import queries

    names = set(queries.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n != "pipeline"} and "pipeline" in names
    assert json.dumps(queries.oracle_sql()) is not None


# The registered queries, end to end

CONTRACT = {
    "op1_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op2_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_suffix_tree_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_token_file": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_benchmark_decontamination": "doc_id bigint, item_id bigint",
    "op11_license_scans": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op12_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_ranked_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "pipeline": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """A folder of few rows with nulls and repeated rows, and one of empty tables."""
    some, none = (str(tmp_path_factory.mktemp(n)) for n in ("some", "none"))
    long = "a text that is long enough to be read as a language and has a few more words than others do"
    documents = [(1, None, "en"), (2, "", None), (3, f"{long} mail a.b@c.org", "en"), (4, f"{long} mail a.b@c.org", None), (4, f"{long} mail a.b@c.org", None), (None, long + " twice", "en"), (5, "12 %", "de"), (9, "ein Satz mit Wörtern und noch mehr Wörtern", "de")]
    rows = {
        "documents": spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in documents], DOC),
        "pages": spark.createDataFrame([(1, "u", None), (2, None, "<article><p>some words here.</p></article>"), (2, None, "<p>x</p>"), (3, "u", "y" * 1200), (4, "u", "y" * 1200)], "page_id long, url string, html string"),
        "benchmark": spark.createDataFrame([(1, "wholly other words of an item"), (2, None)], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(1, [0.1] * 64), (1, [0.1] * 64), (2, None), (3, [0.1] * 5), (None, [0.5] * 64)], "vec_id long, embedding array<float>"),
    }
    for name, table in rows.items():
        table.coalesce(1).write.parquet(f"{some}/{name}.parquet")
        table.where("false").write.parquet(f"{none}/{name}.parquet")
    return some, none


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_of_registered_queries(spark, folders, name):
    import __spark_entry__

    some, none = folders
    query = __spark_entry__.queries()[name]
    got = query(spark, some)
    want = [tuple(c.split()) for c in CONTRACT[name].split(", ")]
    assert [(c, t) for c, t in got.dtypes if c in dict(want)] == want
    rows = got.collect()
    assert query(spark, none).collect() == []
    if name in ("op1_html_extraction", "op8_warc"):
        assert len(rows) == 5
    elif name in ("op3_packing", "pipeline"):
        assert sum(r.length for r in rows) == sum({(r.doc_id, r.sequence_id, r.offset): r.length for r in rows}.values()) > 0
    elif name == "op12_centroid_clustering":
        assert len(rows) == 3 and {r.inertia for r in rows} == {0}
    elif name not in ("op10_benchmark_decontamination", "op13_ranked_lexical_search"):
        assert len(rows) == 8 and Counter(r.doc_id for r in rows)[4] == 2
    if name == "op6_language_id":
        assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 5)} == {"und"} and {r.held_out for r in rows if r.doc_id is None} == {False}
    if name == "op7_simhash_near_dedup":
        assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (1, 2)} == {("0" * 16, 1)}
    if name == "pipeline":
        assert {r.doc_id for r in rows} == {3, 9, None} or {r.doc_id for r in rows} == {3, 9}


def test_pipeline_judges_rows_not_ids(spark):
    import corpus_pipeline as pipeline

    text = "one text with enough words to be told apart from any other text here"
    other = "ganz anderer Inhalt steht in diesem Satz und er ist auch lang genug dafür"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, other, "de", "s", 1), (None, text, "en", "s", 1)], DOC)
    assert sorted((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, SMALL).collect()) == [(1, other), (1, text)]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    docs = docs.union(spark.createDataFrame([(None, f"{text} {item}", "en", "s", 1), (1, item, "en", "s", 1)], DOC))
    assert sorted(r.text for r in pipeline.decontamination(spark, docs, SMALL).collect()) == sorted([text] * 3 + [other])


def test_pipeline_factors_every_passage(spark, monkeypatch):
    """A document of 64 words has three passages, and all three are in the pipeline's latent space."""
    import corpus_pipeline as pipeline

    words = sorted({w for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() for w in decontam.words_of(r.text)})[:64]
    seen, factored = [], decontam.factored
    monkeypatch.setattr(decontam, "factored", lambda *x: seen.append(x[2]) or factored(*x))
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, " ".join(words[:9]), "en", "s", 1), (3, None, "en", "s", 1)], DOC)
    assert pipeline.decontamination(spark, docs, SMALL).count() == 3
    assert abs(sum(2 * r.n for r in seen[0].where("left = right").collect()) / decontam._UNIT - 4) < 1e-6


def test_pipeline_language_uses_its_prediction(spark):
    import corpus_pipeline as pipeline

    rows = [(k, "the house is near the old river and the boat", "en") for k in range(30)] + [(k, "das alte Haus steht nahe bei einem Fluss", "de") for k in range(30, 60)]
    odd = [(101, "das Haus bei einem Boot", None), (102, "你好世界", None), (103, "12 34", "en"), (104, None, "en"), (None, "the boat", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows + odd], DOC)
    kept = {r.doc_id: r.lang for r in pipeline.language(spark, docs, SMALL).collect() if r.doc_id is None or r.doc_id > 100}
    assert kept == {101: "de", None: "en"}


def test_pipeline_learns_from_all_documents(spark, monkeypatch):
    """The language stage keeps a text whose only word stands in one of over 2000 labelled documents, also by a join."""
    import corpus_pipeline as pipeline

    rows = many_texts(3200)
    learnt = [text.split()[2] for k, text, _ in rows if len(text.split()) == 3 and zlib.crc32(str(k).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows] + [(10_000 + k, w, None, "s", 1) for k, w in enumerate(learnt)] + [(20_000, "你好", None, "s", 1)], DOC)
    models, predictor = [], langid.predictor
    monkeypatch.setattr(langid, "predictor", lambda spark, model: models.append(model) or predictor(spark, model))
    want = sorted(map(tuple, pipeline.language(spark, docs, SMALL).collect()))
    assert (models[0].entries[0].table.find(runs.hash_of(learnt)) >= 0).all()
    assert len(want) == docs.count() - 1 and {r[2] for r in want if r[0] >= 10_000} == {"en"}
    monkeypatch.setattr(langid, "BROADCAST_WORDS", 5)
    assert sorted(map(tuple, pipeline.language(spark, docs, SMALL).collect())) == want and len(models) == 1
