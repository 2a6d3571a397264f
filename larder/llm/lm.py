"""Language-model scores from a probabilistic suffix tree.

A text is the stream of its words joined by single spaces, then an end mark; symbols are bytes.  Every training text's
(context, next symbol) pairs up to ``DEPTH`` symbols of context are counted in Spark (with the next symbol a context fits
a 64-bit number).  A context stays in the tree if it is seen ``MIN_COUNT`` times and its next-symbol distribution diverges
from that of its longest kept suffix by at least ``MIN_GAIN`` nats for each symbol that follows it: its count times the
Kullback-Leibler divergence.  Both are absolute, so the tree grows with the corpus.  Distributions are smoothed with that
of the longest kept suffix; a text's symbols are scored by the longest kept suffix of what was read.

The tree is broadcast as tables of at most ``SLICE_ENTRIES`` (context, symbol) entries.  A larger one is cut into slices
by the two symbols before the next one, which decide where in the tree a symbol is looked up, and the documents are read
once for each slice; every symbol is scored in exactly one of them.

The base score needs the exact count of every word.  Words with at least ``HEAVY_SHARE`` of all tokens (at most
1 / HEAVY_SHARE of them) are broadcast; the others are looked up by a join on the word.

Edge cases: a null text is empty and consists of the end token; with no training document every count is 0 and every
byte has probability 1/256; a row without doc_id is not learned from and is not held out; repeated rows are scored each
on their own; very long texts are scored in stretches that first read the DEPTH symbols before them.  Only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import runs
from larder.llm.common import id_remainder, staged, text_bytes

HELD_OUT_MODULUS, HELD_OUT = 7, 2
DEPTH = 5
MIN_COUNT = 256
MIN_GAIN = 8.0
SLICE_ENTRIES = 3_000_000
#: Weight of the suffix's distribution, in observations.
PRIOR = 4.0
HEAVY_SHARE = 5e-6
END = b"\n"  # not in any word
_PAD = END * DEPTH
_SYMBOLS_AT_ONCE = 1 << 18
#: A symbol's score depends on it and the DEPTH before it; so many such runs are remembered, then forgotten all at once.
_REMEMBERED = 1 << 19
_BUFFER = 1 << 20
_FLUSH = 300_000


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in text_bytes(batch.column(0)):
            counts.update(text.lower().split())
            counts[END] += 1
            if len(counts) > _FLUSH:
                yield flush()
    yield flush()


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (DEPTH context symbols, next symbol) of padded streams and their counts; the next symbol is the low byte."""
    symbols = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8)
    keys = np.zeros(len(symbols), np.uint64)
    for back in range(DEPTH + 1):
        keys[back:] |= symbols[: len(symbols) - back].astype(np.uint64) << np.uint64(8 * back)
    ends = np.cumsum([len(t) + DEPTH for t in texts])
    predicted = np.ones(len(symbols), bool)
    predicted[(np.append(0, ends[:-1])[:, None] + np.arange(DEPTH)).ravel()] = False
    return np.unique(keys[predicted], return_counts=True)


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, size = [], 0

    def merge():
        keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts, first)

    def out():
        keys, counts = merge()
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

    for batch in batches:
        for text in text_bytes(batch.column(0)):
            held.append(stream(text.lower().split()))
            size += len(held[-1])
            if size > _BUFFER:
                found.append(grams_of(held))
                held, size = [], 0
                if sum(len(k) for k, _ in found) > 2 * _FLUSH:
                    found[:] = [merge()]
                    if len(found[0][0]) > _FLUSH:
                        yield out()
    if held:
        found.append(grams_of(held))
    if found:
        yield out()


def count_words(train: DataFrame) -> DataFrame:
    """word, c over all training tokens, in the shared folder."""
    found = train.select("text").mapInArrow(_word_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    return staged(train.sparkSession, found, "words")


def _suffix(context, depth: int):
    """The last ``depth`` symbols of a context column (its low bytes)."""
    return context.bitwiseAND(F.lit((1 << 8 * depth) - 1))


def kept_contexts(train: DataFrame) -> DataFrame:
    """depth, context, total, suffix_depth (of its longest kept suffix), symbols and counts that follow, of each kept context."""
    spark = train.sparkSession
    grams = train.select("text").mapInArrow(_gram_batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    symbol = F.col("gram").bitwiseAND(F.lit(255))
    level = staged(spark, grams.select(F.shiftright("gram", 8).alias("context"), symbol.cast("int").alias("next"), "n"), "grams")
    levels = {}
    for depth in range(DEPTH, -1, -1):
        if depth < DEPTH:
            level = staged(spark, level.groupBy(_suffix(F.col("context"), depth).alias("context"), "next").agg(F.sum("n").alias("n")), f"grams{depth}")
        # At most 256 symbols follow a context, so its distribution is a short array, in the order of the symbols.
        follow = F.array_sort(F.collect_list(F.struct("next", "n"))).alias("follow")
        whole = level.groupBy("context").agg(F.sum("n").alias("total"), follow)
        levels[depth] = whole if depth == 0 else whole.where(F.col("total") >= MIN_COUNT)
    kept = [levels[0].select(F.lit(0).alias("depth"), "context", "total", F.lit(-1).alias("suffix_depth"), "follow")]
    best = levels[0].select(F.col("context").alias("suffix"), F.lit(0).alias("suffix_depth"), F.col("total").alias("suffix_total"), F.map_from_entries("follow").alias("suffix_follow"))
    for depth in range(1, DEPTH + 1):
        # Each context with its longest kept suffix, which its own suffix has found one level above.
        met = levels[depth].withColumn("suffix", _suffix(F.col("context"), depth - 1)).join(best, "suffix")
        p = lambda x: x["n"] / F.col("total")
        q = lambda x: F.element_at("suffix_follow", x["next"]) / F.col("suffix_total")
        gain = F.col("total") * F.aggregate("follow", F.lit(0.0), lambda s, x: s + p(x) * F.log(p(x) / q(x)))
        met = staged(spark, met.withColumn("kept", gain >= MIN_GAIN * F.size("follow")), f"tree{depth}")
        kept.append(met.where("kept").select(F.lit(depth).alias("depth"), "context", "total", "suffix_depth", "follow"))
        own = F.map_from_entries("follow")
        best = met.select(
            F.col("context").alias("suffix"), F.when(F.col("kept"), depth).otherwise(F.col("suffix_depth")).alias("suffix_depth"),
            F.when(F.col("kept"), F.col("total")).otherwise(F.col("suffix_total")).alias("suffix_total"), F.when(F.col("kept"), own).otherwise(F.col("suffix_follow")).alias("suffix_follow"),
        )
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


_ODD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def _key(high, low, bits: int) -> np.ndarray:
    """A key of two numbers, one to one, never 0 for a high number above 0."""
    key = (np.asarray(high).astype(np.uint64) << np.uint64(bits)) | np.asarray(low).astype(np.uint64)
    key = (key ^ (key >> _TURN)) * _ODD
    return key ^ (key >> _TURN)


class Tree:
    """Kept contexts in tables: a number for each, and log10 probabilities of the symbols that followed them."""

    def __init__(self, rows: pa.Table):
        """``rows`` as of ``kept_contexts``; a context's longest kept suffix must be among them."""
        rows = rows.sort_by([("depth", "ascending"), ("context", "ascending")])
        self.depth, context, total, suffix = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("depth", "context", "total", "suffix_depth"))
        follow = rows.column("follow").combine_chunks()
        sizes = follow.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        symbol, n = (follow.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("next", "n"))
        count = len(context)
        self.contexts, self.entries = runs.Table(), runs.Table()
        self.contexts.add(_key(self.depth + 1, context, 56), np.arange(count))
        of = np.repeat(np.arange(count), sizes)
        self.entries.add(_key(of + 1, symbol, 8), np.arange(len(of)))
        self.parent = np.where(suffix < 0, -1, self.contexts.find(_key(np.maximum(suffix, 0) + 1, context & ((1 << 8 * np.maximum(suffix, 0)) - 1), 56)))
        self.miss = np.log10(PRIOR / (total + PRIOR))  # what a symbol that did not follow loses on its way to the suffix
        whole = int(total[0]) if count else 0
        self.unseen = -np.log10(whole + 256.0)
        self.memo: runs.Table | None = None
        self.log10 = np.zeros(len(of))
        for depth in range(DEPTH + 1):
            own = np.flatnonzero(self.depth[of] == depth)
            k = of[own]
            if depth == 0:
                self.log10[own] = np.log10((n[own] + 1) / (whole + 256.0))
            else:
                below = 10 ** self._find(self.parent[k], symbol[own])
                self.log10[own] = np.log10((n[own] + PRIOR * below) / (total[k] + PRIOR))

    def _find(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol behind its context."""
        out = np.zeros(len(context))
        left = np.arange(len(context))
        while len(left):
            at = context[left]
            entry = np.where(at >= 0, self.entries.find(_key(at + 1, symbol[left], 8)), -2)
            hit = entry >= 0
            out[left[hit]] += self.log10[entry[hit]]
            root = entry == -2
            out[left[root]] += self.unseen
            left, at = left[entry == -1], at[entry == -1]
            out[left] += np.where(self.depth[at] > 0, self.miss[at], 0)
            context[left] = self.parent[at]
        return out

    def score(self, streams: list[bytes], slices: np.ndarray | None = None, own: int = 0) -> np.ndarray:
        """log10 probability of each stream, or of its symbols whose two symbols before them are in the slice ``own``."""
        out = np.zeros(len(streams))
        held, size, at = [], 0, 0
        for k, stream in enumerate(streams):
            if len(stream) > _SYMBOLS_AT_ONCE:  # alone, in stretches
                out[at:k] = self._score(held, slices, own)
                for begin in range(0, len(stream), _SYMBOLS_AT_ONCE):
                    before = (_PAD + stream[:begin])[-DEPTH:] if begin < DEPTH else stream[begin - DEPTH : begin]
                    out[k] += self._score([stream[begin : begin + _SYMBOLS_AT_ONCE]], slices, own, before)[0]
                held, size, at = [], 0, k + 1
                continue
            held.append(stream)
            size += len(stream)
            if size > _SYMBOLS_AT_ONCE:
                out[at : k + 1] = self._score(held, slices, own)
                held, size, at = [], 0, k + 1
        out[at : at + len(held)] = self._score(held, slices, own)
        return out

    def _score(self, streams: list[bytes], slices: np.ndarray | None, own: int, before: bytes = _PAD) -> np.ndarray:
        if not streams:
            return np.zeros(0)
        symbols = np.frombuffer(b"".join(before + s for s in streams), np.uint8)
        sizes = np.array([len(s) for s in streams])
        of = np.repeat(np.arange(len(streams)), sizes)
        place = np.arange(len(of)) + (of + 1) * DEPTH
        grams = np.zeros(len(symbols), np.uint64)  # each with the DEPTH symbols before it
        for back in range(DEPTH + 1):
            grams[back:] |= symbols[: len(symbols) - back].astype(np.uint64) << np.uint64(8 * back)
        if slices is not None:
            mine = slices[(grams[place] >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)] == own
            of, place = of[mine], place[mine]
        return np.bincount(of, self._remembered(grams[place]), len(streams))

    def _remembered(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol, looked up in the tree once for each different gram."""
        if self.memo is None:
            self.memo, self.scores = runs.Table(), np.zeros(_REMEMBERED)
        known = self.memo.find(_key(1, grams, 56))
        out = self.scores[known]
        left = np.flatnonzero(known < 0)
        if len(left):
            new, of = np.unique(grams[left], return_inverse=True)
            scores = self._look_up(new)
            out[left] = scores[of]
            if self.memo.size + len(new) > _REMEMBERED:
                self.memo = runs.Table()
            new, scores = new[:_REMEMBERED], scores[:_REMEMBERED]
            numbers = np.arange(self.memo.size, self.memo.size + len(new))
            self.scores[numbers] = scores
            self.memo.add(_key(1, new, 56), numbers)
        return out

    def _look_up(self, grams: np.ndarray) -> np.ndarray:
        window = grams >> np.uint64(8)
        context = np.zeros(len(grams), np.int64)
        left = np.arange(len(grams))
        for depth in range(DEPTH, 0, -1):
            found = self.contexts.find(_key(depth + 1, window[left] & np.uint64((1 << 8 * depth) - 1), 56)).astype(np.int64)
            context[left[found >= 0]] = found[found >= 0]
            left = left[found < 0]
        context[left] = 0 if len(self.depth) else -1
        return self._find(context, (grams & np.uint64(255)).astype(np.int64))


def sliced(rows: pa.Table, most: int = SLICE_ENTRIES) -> tuple[np.ndarray | None, list[pa.Table]]:
    """The tree's slices: which one each pair of last symbols is in (None if there is one slice), and the contexts of each.

    A slice has all contexts that end with its pairs, and all of fewer than two symbols.
    """
    sizes = pa.compute.list_value_length(rows.column("follow")).to_numpy()
    if sizes.sum() <= most:
        return None, [rows]
    depth, pair = rows.column("depth").to_numpy(), rows.column("context").to_numpy() & 0xFFFF
    weight = np.bincount(pair[depth >= 2], sizes[depth >= 2], 1 << 16)
    slices = (np.cumsum(weight) // most).astype(np.int64)
    return slices, [rows.filter(pa.array((depth < 2) | (slices[pair] == k))) for k in range(int(slices.max()) + 1)]


def _slice_batches(shared, own: int):
    """row, score: of each document what the slice's symbols add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, slices = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            scores = tree.score([stream(t.lower().split()) for t in text_bytes(batch.column(2))], slices, own)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(scores))), pa.array(scores)], ["row", "score"])
            row += len(scores)

    return run


def _score_batches(shared):
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, slices, logs, end_log, end_known = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                streams, out = [], []
                for text in text_bytes(some.column(2)):
                    words = text.lower().split()
                    streams.append(stream(words))
                    counted = Counter(words)
                    known, base, rare, times = end_known, end_log, [], []
                    for word, n in counted.items():
                        if (log := logs.get(word)) is None:
                            rare.append(word)
                            times.append(n)
                        else:
                            known += n
                            base += n * log
                    out.append((len(words) + 1, known, base, rare, times))
                n_tokens, known, base, rare, times = zip(*out, strict=True)
                columns = [np.arange(row, row + len(out)), some.column(0), some.column(1), n_tokens, known, base, tree.score(streams, slices, 0), rare, times]
                row += len(out)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    held_out = F.coalesce(id_remainder(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    train = rows.where("not held_out and doc_id is not null")
    counts = count_words(train)
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    slices, tables = sliced(kept_contexts(train).toArrow())
    whole = float(tokens + distinct + 1)
    heavy = counts.where(F.col("c") >= HEAVY_SHARE * tokens).toArrow() if tokens else pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    logs = dict(zip(heavy.column("word").to_pylist(), np.log10((heavy.column("c").to_numpy() + 1) / whole).tolist(), strict=True))
    ends = counts.where(F.col("word") == F.lit(END)).select("c").first()
    end_count = ends.c if ends else 0
    shared = spark.sparkContext.broadcast((Tree(tables[0]), slices, logs, float(np.log10((end_count + 1) / whole)), int(end_count > 0)))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<long>"
    scored = staged(spark, rows.mapInArrow(_score_batches(shared), schema), "scored")
    others = [rows.mapInArrow(_slice_batches(spark.sparkContext.broadcast((Tree(t), slices)), k), "row long, score double") for k, t in enumerate(tables) if k]
    for other in others:
        scored = scored.join(staged(spark, other, "slice").withColumnRenamed("score", "more"), "row").withColumn("score", F.col("score") + F.col("more")).drop("more")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    looked_up = rare.join(counts.where(F.col("c") < HEAVY_SHARE * tokens), "word", "left")
    more = looked_up.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10((c + 1) / F.lit(whole))).alias("more_base"))
    both = scored.drop("words", "times").join(more, "row", "left")
    return both.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
