"""Word-first language identification with back-off to character n-grams.

A known word counts with its log frequency in each language; an unseen word backs off to its known 4-grams, else its
3-grams, 2-grams and single characters.  The classifier is fitted on all labelled documents and keeps every word and n-gram
of them.  N-grams are counted from the distinct words and are broadcast (alphabets bound them), and so are up to
``BROADCAST_WORDS`` words, the most frequent ones.  Where there are more words, the others stay in a table: a text's words
that are not broadcast back off at first, and a join adds what the rarer known ones of them count more.  Prediction reads
whole texts, and only the text; words and n-grams are looked up by 64-bit hash, all those of many texts at once.

The score is a softmax over the languages' log likelihoods, divided by the square root of the number of words, so that
the length of a text alone does not make it certain.  ``known`` counts words that are known or have a known n-gram of
two or more characters: without one the prediction is a guess.

Edge cases: a null text or one without a letter is ``und`` with score 0; letters that no table knows, and ties, give the
alphabetically first language, the former with score 1/number of languages; a row without doc_id is never learned from
and is not held out; with no labelled row at all every text is ``und``.  Other columns are not read, so they cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import runs
from larder.llm.common import give_back, id_remainder, releasing, staged

HELD_OUT_MODULUS, HELD_OUT = 4, 2
#: Words that are broadcast with the model, 50 bytes each; beyond, the less frequent ones are joined.
BROADCAST_WORDS = 1_000_000
GRAM_SIZES = (4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"
#: Unseen words whose scores are kept; beyond, they are found anew.
MEMO_WORDS = 500_000
_CHARACTERS_AT_ONCE = 300_000
#: What a rarer word counts more is summed in these units, so sums do not depend on order.
_UNIT = 1 << 20
_EDGE = "\0"  # what stands for a word's border in an n-gram


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    folded = runs.folded(runs.joined([text])[1], letters=True)
    lower = folded.tobytes().decode("utf-32-le")
    return [lower[b:e] for b, e in zip(*(x.tolist() for x in runs.runs(folded > 0)), strict=True)]


def grams(word: str, size: int) -> list[str]:
    """Character n-grams of a word between border marks; single characters are without marks."""
    marked = word if size == 1 else f"{_EDGE}{word}{_EDGE}"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[str], int]]:
    """Some texts at a time, in order, and 1 for each; a long one in pieces, of which only the last counts."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > _CHARACTERS_AT_ONCE:
            yield held, len(held)
            held, size = [], 0
        if len(text) > 2 * _CHARACTERS_AT_ONCE:
            *first, last = runs.pieces(text, _CHARACTERS_AT_ONCE)
            for piece in first:
                yield [piece], 0
            yield [last], 1
            continue
        held.append(text)
        size += len(text)
    if held:
        yield held, len(held)


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            of.setdefault(lang, []).append(text)
        for lang, texts in of.items():
            for some, _ in _chunks(texts):
                codes = runs.folded(runs.joined(some)[1], letters=True)
                begin, end = runs.runs(codes > 0)
                keys, first, n = np.unique(runs.hashes(codes, begin, end), return_index=True, return_counts=True)
                lower = codes.tobytes().decode("utf-32-le")
                words = [lower[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(words, pa.string()), pa.array(n)], ["lang", "key", "word", "n"])


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for word, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for size in GRAM_SIZES:
                for gram in grams(word, size):
                    for own in counts:
                        total[own["lang"], size, gram] += own["n"]
        lang, size, gram = zip(*total, strict=True) if total else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(gram, pa.string()), pa.array(total.values(), pa.int64())], ["lang", "size", "gram", "n"])


class Entries:
    """Log frequencies of words, or of n-grams of a size, in each language.

    Most entries are of few languages, so only those are kept: for each language the log frequency of an entry that it
    does not have, and for each entry and language that has it how much more it is.  ``total`` and ``size`` are those of
    all entries, also of ones that are left in a table.
    """

    def __init__(self, keys: np.ndarray, entry: np.ndarray, lang: np.ndarray, count: np.ndarray, total: np.ndarray, size: int):
        self.table = runs.Table()
        if len(keys):
            self.table.add(keys, np.arange(len(keys)))
        total = total + SMOOTHING * size
        self.floor = np.log(SMOOTHING / np.maximum(total, SMOOTHING))
        self.first = np.searchsorted(entry, np.arange(len(keys) + 1))  # entries come in order
        self.lang, self.more = lang.astype(np.int32), np.log((count + SMOOTHING) / SMOOTHING).astype(np.float32)

    def sums(self, group: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
        """groups x languages: what entries ``rows``, each of a group, add up to."""
        languages, size = len(self.floor), self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        more = np.bincount(np.repeat(group, size) * languages + self.lang[at], self.more[at], groups * languages)
        return more.reshape(groups, languages) + np.bincount(group, minlength=groups)[:, None] * self.floor


class Model:
    """The entries of each size; 0 for whole words.

    ``rest`` holds the words that are not broadcast, if any: key, word, langs (lang, n).
    """

    def __init__(self, languages: list[str], found: pa.Table | None = None, words: pa.Table | None = None, totals: dict[str, int] | None = None, size: int = 0, rest: DataFrame | None = None):
        """``found``: lang, size, gram, n; ``words``: key, lang, n of words, where all ``size`` words have ``totals``."""
        self.languages, self.rest = sorted(languages), rest
        place = {lang: k for k, lang in enumerate(self.languages)}
        if found is not None:
            found = found.sort_by([("size", "ascending"), ("gram", "ascending"), ("lang", "ascending")])
        self.entries = {}
        for n in (0, *GRAM_SIZES):
            own = None if found is None else found.filter(pa.compute.equal(found.column("size"), n))
            encoded = pa.array([], pa.string()).dictionary_encode() if own is None else own.column("gram").combine_chunks().dictionary_encode()
            lang = np.array([] if own is None else [place[x] for x in own.column("lang").to_pylist()], np.int64)
            count = np.array([] if own is None else own.column("n").to_numpy(), np.float64)
            keys = runs.hash_of(encoded.dictionary.to_pylist()) if len(encoded) else np.zeros(0, np.uint64)
            self.entries[n] = Entries(keys, encoded.indices.to_numpy(zero_copy_only=False), lang, count, np.bincount(lang, count, len(place)), len(keys))
        if words is not None:
            lang = pa.compute.index_in(words.column("lang"), pa.array(self.languages)).to_numpy().astype(np.int64)
            key, count = words.column("key").to_numpy().view(np.uint64), words.column("n").to_numpy().astype(np.float64)
            order = np.lexsort((lang, key))
            keys, entry = np.unique(key[order], return_inverse=True)
            self.entries[0] = Entries(keys, entry, lang[order], count[order], np.array([totals.get(x, 0) for x in self.languages], np.float64), size)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}


class Predictor:
    """Scores many texts at once; keeps what it found for unseen words in a memo of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.table, self.memo, self.used = runs.Table(), np.zeros((1024, len(self.model.languages) + 1), np.float32), 0

    def _back_off(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word its mean log frequencies over the n-grams of the largest size that are known, and 1 if that is at least 2."""
        out = np.zeros((len(begin), len(self.model.languages) + 1), np.float32)
        left = np.arange(len(begin))
        for size in GRAM_SIZES:
            marks = int(size > 1)
            first = begin[left] - marks
            count = np.maximum(end[left] + marks - size + 1 - first, 0)
            word = np.repeat(left, count)
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            rows = self.model.entries[size].table.find(runs.hashes(codes, at, at + size))
            word, rows = word[rows >= 0], rows[rows >= 0]
            hits = np.bincount(word, minlength=len(begin))
            some = np.flatnonzero(hits)
            out[some, :-1] = self.model.entries[size].sums(np.searchsorted(some, word), rows, len(some)) / hits[some, None]
            out[some, -1] = marks
            left = left[hits[left] == 0]
        return out

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums over each text's words of their log frequencies, with the number of known ones; the number of words; keys of unseen words, and their texts."""
        _, codes, starts = runs.joined(["", *texts])  # a border before the first word
        codes = runs.folded(codes, letters=True)
        begin, end = runs.runs(codes > 0)
        sums = np.zeros((len(begin), len(self.model.languages) + 1))
        keys = runs.hashes(codes, begin, end)
        number = self.model.entries[0].table.find(keys)
        seen = np.flatnonzero(number >= 0)
        sums[seen, :-1], sums[seen, -1] = self.model.entries[0].sums(np.arange(len(seen)), number[seen], len(seen)), 1
        unseen = np.flatnonzero(number < 0)
        if self.used > MEMO_WORDS:
            self._forget()
        place = self.table.find(keys[unseen])
        missing = unseen[place < 0]
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            while self.used + len(new) > len(self.memo):
                self.memo = np.concatenate([self.memo, np.zeros_like(self.memo)])
            self.memo[self.used : self.used + len(new)] = self._back_off(codes, begin[missing[first]], end[missing[first]])
            self.table.add(new, np.arange(self.used, self.used + len(new)))
            self.used += len(new)
            place = self.table.find(keys[unseen])
        sums[unseen] = self.memo[place]
        counts = np.diff(np.searchsorted(begin, starts[1:]))
        text = np.repeat(np.arange(len(counts)), counts)
        return np.stack([np.bincount(text, column, len(counts)) for column in sums.T], axis=1), counts, keys[unseen], text[unseen]

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``_some``, of any number of texts of any length."""
        rows, counts = np.zeros((len(texts), len(self.model.languages) + 1)), np.zeros(len(texts), np.int64)
        unseen, of, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for some, whole in _chunks(texts):
            found = self._some(some)
            rows[at : at + len(some)] += found[0]
            counts[at : at + len(some)] += found[1]
            unseen.append(found[2])
            of.append(found[3] + at)
            at += whole
        return rows, counts, np.concatenate(unseen), np.concatenate(of)

    def decide(self, total: np.ndarray, count: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, known words) of texts of ``count`` words with these sums."""
        languages = self.model.languages
        if not languages:
            return [UNKNOWN] * len(total), np.zeros(len(total)), np.zeros(len(total), np.int64)
        logs, known = total[:, :-1], total[:, -1].astype(np.int64)
        odds = np.exp((logs - logs.max(1, keepdims=True)) / np.sqrt(np.maximum(count, 1))[:, None])
        best = odds.argmax(1)
        score = np.where(count > 0, odds.max(1) / odds.sum(1), 0.0)
        return [languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), count.tolist(), strict=True)], score, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, known words) of each text."""
        return self.decide(*self.sums(texts)[:2])

    def more(self, words: list[str], counts: list[list[dict]]) -> np.ndarray:
        """How much more than by back-off each word counts for the languages that have it ``n`` times, and for ``known``."""
        _, codes, starts = runs.joined(["", *words])
        codes = runs.folded(codes, letters=True)
        place, entries = {lang: k for k, lang in enumerate(self.model.languages)}, self.model.entries[0]
        out = -self._back_off(codes, starts[1:-1], starts[2:] - 1).astype(np.float64)
        out += np.append(entries.floor, 1)
        for row, own in zip(out, counts, strict=True):
            for x in own:
                row[place[x["lang"]]] += np.log((x["n"] + SMOOTHING) / SMOOTHING)
        return out


def fit(docs: DataFrame) -> Model:
    """Learn from all labelled documents that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), HELD_OUT_MODULUS) != HELD_OUT))
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    languages = [row.lang for row in labelled.select("lang").distinct().collect()]
    if not languages:
        return Model([])
    counted = labelled.mapInArrow(releasing(_word_batches), "lang string, key long, word string, n long").groupBy("key", "word", "lang").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("key").agg(F.min("word").alias("word"), F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("langs"))
    words = staged(docs.sparkSession, counted, "words")
    totals = {row.lang: row.n for row in words.select(F.inline("langs")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    size = words.count()
    often, rest = words, None
    if size > BROADCAST_WORDS:
        # Counts are as many as the root of the corpus at most.
        held, least = 0, None
        for row in words.groupBy("n").count().orderBy(F.desc("n")).collect():
            held += row["count"]
            if held > BROADCAST_WORDS:
                break
            least = row["n"]
        often, rest = (words.where(F.col("n") >= least), words.where(F.col("n") < least)) if least else (words.where("false"), words)
    grams_of = words.select("word", "langs").mapInArrow(releasing(_gram_batches), "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return Model(languages, grams_of.toArrow(), often.select("key", F.inline("langs")).toArrow(), totals, size, rest)


def predictor(spark: SparkSession, model: Model):
    """A function of a text column: struct(lang_pred, score, known)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known long")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Predictor(shared.value)
        for batch in texts:
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "known"), own.predict(batch.tolist()), strict=True)))
        del own
        give_back()

    return predict.asNondeterministic()  # so that it runs once, however often its result is used


def _sum_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Predictor(shared.value)
        for batch in batches:
            sums, counts, unseen, of = own.sums(batch.column(2).to_pylist())
            ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(sums)))).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), pa.array(unseen.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(sums), pa.list_(pa.float64())), pa.array(counts), rest], ["doc_id", "held_out", "sums", "words", "rest"])

    return run


def _more_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Predictor(shared.value)
        for batch in batches:
            more = np.rint(own.more(batch.column(1).to_pylist(), batch.column(2).to_pylist()) * _UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(more), pa.list_(pa.int64()))], ["key", "more"])

    return run


def _decide_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Predictor(shared.value)
        for batch in batches:
            sums, more = (np.array(batch.column(k).to_pylist(), np.float64).reshape(batch.num_rows, len(own.model.languages) + 1) for k in (2, 4))
            lang, score, known = own.decide(sums + more / _UNIT, batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(known)], ["doc_id", "held_out", "lang_pred", "score", "known"])

    return run


def _identify_by_join(docs: DataFrame, model: Model) -> DataFrame:
    """``identify`` where not all words are broadcast: the rarer words of the documents meet their table in a join."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    summed = docs.mapInArrow(releasing(_sum_batches(shared)), f"doc_id {kind}, held_out boolean, sums array<double>, words long, rest array<long>")
    summed = staged(spark, summed.withColumn("row", F.monotonically_increasing_id()), "sums")
    more = model.rest.select("key", "word", "langs").mapInArrow(releasing(_more_batches(shared)), "key long, more array<long>")
    # In a document a word is counted before it is joined.
    met = summed.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("n")).join(more, "key")
    of_row = met.groupBy("row").agg(F.array(*[F.sum(F.col("n") * F.col("more")[k]) for k in range(len(model.languages) + 1)]).alias("more"))
    none = F.array(*[F.lit(0).cast("long")] * (len(model.languages) + 1))
    both = summed.drop("rest").join(of_row, "row", "left").select("doc_id", "held_out", "sums", "words", F.coalesce("more", none).alias("more"))
    return both.mapInArrow(releasing(_decide_batches(shared)), f"doc_id {kind}, held_out boolean, lang_pred string, score double, known long")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known (words) of every document."""
    held_out = F.coalesce(id_remainder(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT, F.lit(False))
    if model.rest is not None:
        return _identify_by_join(docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text")), model)
    found = predictor(docs.sparkSession, model)(F.col("text").cast("string"))
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
