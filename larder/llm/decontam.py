"""Benchmark decontamination by latent semantic retrieval.

TF-IDF passages of all documents and of the benchmark are factored by a randomised SVD.  Words are the benchmark's; their
document frequencies are counted over all documents, and so is, in a second pass, how the passages' words occur together:
the matrix A'A, of which each pair of words is a row, so the SVD's products A'A X are Spark jobs over the words and not over
the passages.  It is summed in integers, so it does not depend on ids, order or partitions.  The documents' passages weigh
less than the benchmark's, so the kept directions hold the benchmark's passages and, before them, what is common in the
corpus; folding in divides by singular values above one, so what is common counts little and never nothing.  Every passage of every whole document is folded in and compared with the benchmark's by
cosine, and by how much of the other passage it holds.  Near ones are verified on the words around them: longest common
subsequences of the item's short parts, so reordered sentences count, must cover most of the item, or half of it together
with the item's answer (its ``answer`` column, else its last sentence), and rare words must be among what is found.

``SPACE`` benchmark passages share a latent space, whose rank exceeds their number, so nothing of them is lost however
many items there are.  The benchmark is broadcast in blocks of at most ``BLOCK_SPACES`` spaces (about 25 MB each), one
search of the documents for each block; frequencies and pairs for all blocks are counted in one pass each.

Edge cases: items without a word match nothing; a null text is empty and matches nothing; items with equal texts all
match; repeated rows give one result row; rows without doc_id or items without item_id are left out of the result; an
empty table gives none.  Only ``doc_id``, ``text``, ``item_id`` and ``answer`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import runs
from larder.llm.common import releasing, staged

STEP = 16
#: A passage is two neighbouring stretches of STEP words.
PASSAGE = 2 * STEP
#: Benchmark passages in a latent space, and directions beyond their number.
SPACE = 384
MORE_DIRECTIONS = 96
#: Spaces that are searched at once.
BLOCK_SPACES = 4
#: The documents' passages count in the factorisation with this weight; if they are more than so many, with as much as those.
CORPUS = 4096
SAMPLE_WEIGHT = 0.1
POWER_STEPS = 2
#: A passage is near if its cosine is at least this and it holds at least this share of the benchmark's passage.
MIN_COSINE = 0.3
MIN_HELD = 0.25
#: Shares of an item's words that the check asks for: without its answer, with its answer, and of its words' weights.
STRONG_LCS = 0.65
WEAK_LCS = 0.5
MIN_ANSWER = 0.75
MIN_WEIGHT = 0.45
_PART = 12
_CHARACTERS_AT_ONCE = 300_000
#: A passage's share of a pair of words is counted in these units; sums of 3e10 passages fit 64 bits.
_UNIT = 1 << 28
#: Pairs of the most frequent words, so many, are summed in place; a task holds at most so many others before it merges them.
_IN_PLACE = 2048
_PAIRS_AT_ONCE = 1_000_000
_PASSAGES_AT_ONCE = 8192
_PAIRS_IN_ROW = 512
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    folded = runs.folded(runs.joined([text])[1])
    lower = folded.tobytes().decode("utf-32-le")
    return [lower[b:e] for b, e in zip(*(x.tolist() for x in runs.runs(folded > 0)), strict=True)]


def sentences_of(text: str) -> list[list[str]]:
    return [w for s in _SENTENCE_END.split(text.strip()) if (w := words_of(s))]


def answer_of(text: str, answer: str | None) -> list[str]:
    return words_of(answer) if answer else (sentences_of(text) or [[]])[-1]


def parts_of(sentences: list[list[str]]) -> list[list[str]]:
    """An item's words in parts of about ``_PART`` words, which end with its sentences."""
    out: list[list[str]] = []
    for words in sentences:
        count = max(1, round(len(words) / _PART))
        out += [words[k * len(words) // count : (k + 1) * len(words) // count] for k in range(count)]
    return out


class Words:
    """Numbers, from 1, of given words in texts; 0 is any other word."""

    def __init__(self, words: list[str]):
        self.table = runs.Table()
        self.table.add(runs.hash_of(words), np.arange(1, len(words) + 1))

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        _, codes, starts = runs.joined(texts)
        codes = runs.folded(codes)
        begin, end = runs.runs(codes > 0)
        return np.maximum(self.table.find(runs.hashes(codes, begin, end)), 0), np.diff(np.searchsorted(begin, starts))

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, sizes) of some texts at a time, in order."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > _CHARACTERS_AT_ONCE:
                yield self._some(held)
                held, size = [], 0
            if len(text) > 2 * _CHARACTERS_AT_ONCE:
                found = np.concatenate([self._some([p])[0] for p in runs.pieces(text, _CHARACTERS_AT_ONCE)])
                yield found, np.array([len(found)])
                continue
            held.append(text)
            size += len(text)
        if held:
            yield self._some(held)


def stretches_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch's text, its place there and whether it is followed; places of the words that have a number, and their stretches.

    A stretch that is followed, or a text's only one, begins a passage.
    """
    stretches = -(-sizes // STEP)
    before = np.cumsum(stretches) - stretches  # stretches of the texts before each
    text = np.repeat(np.arange(len(sizes)), stretches)
    held = np.flatnonzero(words)
    text_of_held = np.searchsorted(np.cumsum(sizes), held, side="right")
    stretch = before[text_of_held] + (held - (np.cumsum(sizes) - sizes)[text_of_held]) // STEP
    return text, np.arange(len(text)) - before[text], np.append(text[1:] == text[:-1], False)[: len(text)], held, stretch


def passage_sums(words: np.ndarray, sizes: np.ndarray, directions: np.ndarray, most: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the words' directions over the passages of texts of ``sizes`` words; each one's text and first word.

    Only words that have a direction are looked up, and only passages whose words' ``most`` add up to ``least``.
    """
    text, nth, follows, held, stretch = stretches_of(words, sizes)
    numbers = words[held]
    bound = np.bincount(stretch, most[numbers], len(text))
    bound += np.where(follows, np.append(bound[1:], 0)[: len(text)], 0)
    keep = np.flatnonzero((follows | (nth == 0)) & (bound >= least))
    right = follows[keep]
    # Sums over the stretches of these passages.
    row = np.full(len(text), -1)
    row[keep] = row[keep[right] + 1] = 0
    row[row == 0] = np.arange(np.count_nonzero(row == 0))
    sums = np.zeros((int(row.max(initial=-1)) + 1, directions.shape[1]), np.float32)
    own = row[stretch]
    own, numbers = own[own >= 0], numbers[own >= 0]
    if len(own):
        first = np.flatnonzero(np.append(True, np.diff(own) > 0))
        own, counts = own[first], np.diff(np.append(first, len(numbers)))
        for k in range(STEP):  # the k-th such word of every stretch
            more = counts > k
            own, first, counts = own[more], first[more], counts[more]
            sums[own] += directions[numbers[first + k]]
    both = sums[row[keep]]
    both[right] += sums[row[keep[right] + 1]]
    return both, text[keep], nth[keep] * STEP


def lcs(words: list[int], masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence, with one bit for each word of the shorter side (Hyyrö 2004)."""
    every = (1 << size) - 1
    row = every
    for w in words:
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & every
    return size - row.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


class Item:
    """What verifying needs of a benchmark item; words are numbers."""

    def __init__(self, item_id: int, parts: list[list[int]], answer: list[int], weights: np.ndarray):
        self.item_id, self.size = item_id, sum(map(len, parts))
        self.parts = [(masks_of(p), len(p)) for p in parts]
        self.answer = (masks_of(answer), len(answer))
        self.weight = {w: float(weights[w]) for p in parts for w in p}
        self.whole = sum(self.weight.values())

    def check(self, around: np.ndarray) -> tuple[float, float] | None:
        """(share of the item, share of its answer) in the words around a near passage, if they are enough."""
        around = [w for w in around.tolist() if w]
        if self.whole and sum(self.weight.get(w, 0.0) for w in set(around)) < MIN_WEIGHT * self.whole:
            return None
        share = sum(lcs(around, *part) for part in self.parts) / self.size
        if share < WEAK_LCS:
            return None
        said = lcs(around, *self.answer) / self.answer[1] if self.answer[1] else 0.0
        return (share, said) if share >= STRONG_LCS or said >= MIN_ANSWER else None


class Benchmark:
    """A benchmark's items by word numbers, which all its blocks share, and its passages."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        read = [(item_id, parts_of(sentences_of(text)), answer_of(text, answer)) for item_id, text, answer in rows]
        self.vocabulary = sorted({w for _, parts, answer in read for part in (*parts, answer) for w in part})
        number = {w: k + 1 for k, w in enumerate(self.vocabulary)}
        self.items = [(i, [[number[w] for w in p] for p in parts], [number[w] for w in answer]) for i, parts, answer in read]
        rows, of = [], []
        for k, (_, parts, _) in enumerate(self.items):
            words = [w for p in parts for w in p]
            for at in range(0, max(len(words) - STEP, 1), STEP):
                rows.append(words[at : at + PASSAGE] + [0] * (PASSAGE - len(words[at : at + PASSAGE])))
                of.append(k)
        self.passages, self.item_of = np.array(rows, np.int32).reshape(-1, PASSAGE), np.array(of, np.int64)


def _frequency_batches(shared):
    """Rows (word, n): documents with the word; of word 0, their passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size = shared.value
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            for numbers, sizes in words.of(batch.column(0).to_pylist()):
                text = np.repeat(np.arange(len(sizes)), sizes)
                found = np.bincount(np.unique(text * (size + 1) + numbers) % (size + 1), minlength=size + 1)
                found[0] = np.maximum(-(-sizes // STEP) - 1, sizes > 0).sum()
                df += found
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["word", "n"])

    return run


class Pairs:
    """Sums over passages of how much of each holds two words: half of A'A, which is this and its transpose.

    A passage is a row of A of length 1; a word's number in ``by_use`` is its place in the order of frequency.
    """

    def __init__(self, weights: np.ndarray, by_use: np.ndarray):
        self.weights, self.by_use, self.words = weights, by_use, np.argsort(by_use)
        self.in_place = min(_IN_PLACE, len(weights))
        self.often = np.zeros(self.in_place**2, np.int64)
        self.others: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, words: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts the texts' passages; gives rows once there are many."""
        text, nth, follows, held, stretch = stretches_of(words, sizes)
        begin = np.searchsorted(stretch, np.arange(len(text) + 1))
        every = np.flatnonzero(follows | (nth == 0))
        for at in range(0, len(every), _PASSAGES_AT_ONCE):
            own = every[at : at + _PASSAGES_AT_ONCE]
            first = begin[own]
            self._add(words, held, first, begin[own + 1 + follows[own]] - first)
            if sum(len(k) for k, _ in self.others) > _PAIRS_AT_ONCE:
                self.others = [self._merged()]
                if len(self.others[0][0]) > _PAIRS_AT_ONCE // 2:
                    yield from self._rows(*self.others.pop(), len(self.words))

    def _add(self, words: np.ndarray, held: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        of = np.repeat(np.arange(len(first)), count)
        begin = np.cumsum(count) - count
        numbers = words[held[np.arange(len(of)) + (first - begin)[of]]]
        scale = self.weights[numbers]
        norm = np.sqrt(np.bincount(of, scale * scale, len(first)))[of]
        scale = np.divide(scale, norm, out=np.zeros_like(scale), where=norm > 0)
        use = self.by_use[numbers]
        rare = use >= self.in_place
        self._add_often(of[~rare], use[~rare], scale[~rare], len(first))
        # A rare word with all words of its passage, other rare ones before it left out.
        own = np.flatnonzero(rare)
        size = count[of[own]]
        other = np.arange(size.sum()) + np.repeat(begin[of[own]] - np.cumsum(size) + size, size)
        own = np.repeat(own, size)
        once = ~rare[other] | (other >= own)
        own, other = own[once], other[once]
        n = np.rint(scale[own] * scale[other] * np.where(own == other, _UNIT / 2, _UNIT)).astype(np.int64)
        x, y = use[own].astype(np.int64), use[other]
        self.others.append((np.minimum(x, y) * len(self.words) + np.maximum(x, y), n))

    def _add_often(self, of: np.ndarray, use: np.ndarray, scale: np.ndarray, passages: int) -> None:
        # A column for each passage, those with most words first, so that the k-th words are a row's begin.
        count = np.bincount(of, minlength=passages)
        order = np.argsort(-count, kind="stable")
        column = np.empty(passages, np.int64)
        column[order] = np.arange(passages)
        row = np.arange(len(of)) - (np.cumsum(count) - count)[of]
        words, scales = np.zeros((PASSAGE, passages), np.int32), np.zeros((PASSAGE, passages))
        words[row, column[of]], scales[row, column[of]] = use, scale
        for k in range(int(count.max(initial=0))):
            some = int(np.count_nonzero(count > k))
            x, y = words[: k + 1, :some], words[k, :some]
            n = scales[: k + 1, :some] * (scales[k, :some] * _UNIT)
            n[k] /= 2
            np.add.at(self.often, (np.minimum(x, y) * self.in_place + np.maximum(x, y)).ravel(), np.rint(n).astype(np.int64).ravel())

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.others, strict=True))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    def _rows(self, keys: np.ndarray, n: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
        """For keys in order rows of a word with some of those that are not more frequent, by their places in ``by_use``."""
        low, high = keys // width, (keys % width).astype(np.int32)
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1])[: len(low)] | (np.arange(len(low)) % _PAIRS_IN_ROW == 0))
        ends = np.append(first, len(low))
        packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (high, n)]
        for at in range(0, len(first), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(low[first[at : at + 1000]].astype(np.int32)), *(x.slice(at, 1000) for x in packed)], ["low", "high", "n"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        held = np.flatnonzero(self.often)
        yield from self._rows(held, self.often[held], self.in_place)
        if self.others:
            yield from self._rows(*self._merged(), len(self.words))


def _pair_batches(shared):
    """Rows are texts, or passages by their words' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, by_use = shared.value
        pairs = Pairs(weights, by_use)
        for batch in batches:
            column = batch.column(0)
            lists = pa.types.is_list(column.type)
            for numbers, sizes in [(column.flatten().to_numpy(), column.value_lengths().to_numpy())] if lists else words.of(column.to_pylist()):
                yield from pairs.add(numbers, sizes)
        yield from pairs.rest()

    return run


def _pair_sums(shared):
    """Rows of ``Pairs`` in the order of ``low``; gives left, right, n: the sum of each pair, by word numbers, the smaller first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, weights, by_use = shared.value
        words, own, sums = np.argsort(by_use), -1, np.zeros(len(weights), np.int64)

        def out():
            met = np.flatnonzero(sums)
            pair = np.sort([np.full(len(met), words[own]), words[met]], axis=0).astype(np.int32)
            rows = pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(sums[met])], ["left", "right", "n"])
            sums[met] = 0
            return rows

        for batch in batches:
            for low, high, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if low != own and own >= 0:
                    yield out()
                own = low
                sums[np.frombuffer(high, np.int32)] += np.frombuffer(n, np.int64)
        if own >= 0:
            yield out()

    return run


def word_pairs(rows: DataFrame, words: Words | None, weights: np.ndarray, df: np.ndarray | None = None) -> DataFrame:
    """left, right, n: half of A'A, in units, over all passages of ``rows``, a column of texts or of passages as arrays of numbers."""
    by_use = np.zeros(len(weights), np.int32)
    by_use[np.argsort(-df if df is not None else weights, kind="stable")] = np.arange(len(weights))
    shared = rows.sparkSession.sparkContext.broadcast((words, weights, by_use))
    # Pairs are shuffled some hundred in a row; summed one by one they would cost more than to count them.
    counted = rows.mapInArrow(releasing(_pair_batches(shared)), "low int, high binary, n binary").repartition("low").sortWithinPartitions("low")
    return counted.mapInArrow(releasing(_pair_sums(shared)), "left int, right int, n long")


def _product_batches(shared):
    """Rows (word, other, value) of A'A, best in the order of words; gives rows of A'A X, a word's perhaps in parts."""

    def products(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        rows = pa.Table.from_batches(held)
        other, value = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        words, of = np.unique(rows.column(0).to_numpy(), return_inverse=True)
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            mine = (of >= at) & (of < at + 256)
            block = np.zeros((len(some), len(x)))
            block[of[mine] - at, other[mine]] = value[mine]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(block @ x), pa.list_(pa.float64()))], ["word", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > _PAIRS_AT_ONCE // 4:
                yield from products(held)
                held = []
        if held:
            yield from products(held)

    return run


def factored(spark: SparkSession, own: np.ndarray, corpus: np.ndarray | DataFrame, weights: np.ndarray, rank: int, weight: float = SAMPLE_WEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Right singular directions (a row for each word place) and singular values of the weighted passages, by Spark jobs.

    ``corpus`` is passages as an array, or their pairs as of ``word_pairs``; ``weight`` is that of each of its passages.
    """
    parts = []
    for some, square in ((own, 1.0), (corpus, weight**2)):
        if not isinstance(some, DataFrame):
            some = word_pairs(spark.createDataFrame([(r,) for r in some.tolist()], "words array<int>").repartition(max(1, -(-len(some) // 2048))), None, weights)
        parts.append(some.select("left", "right", (F.lit(square / _UNIT) * F.col("n")).alias("value")))
    half = parts[0].unionByName(parts[1]).groupBy("left", "right").agg(F.sum("value").alias("value"))
    sides = [F.struct(F.col(a).alias("word"), F.col(b).alias("other"), ((1 + (F.col(a) == F.col(b)).cast("int")) * F.col("value")).alias("value")) for a, b in (("left", "right"), ("right", "left"))]
    both = F.when(F.col("left") == F.col("right"), F.array(sides[0])).otherwise(F.array(*sides))
    met = half.select(F.inline(both))
    met = staged(spark, met.repartition("word").sortWithinPartitions("word"), "met")

    def product(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)
        y = np.zeros_like(x)
        for row in met.mapInArrow(releasing(_product_batches(shared)), "word int, y array<double>").toLocalIterator():  # a row or two for each word
            y[row.word] += row.y
        return y

    basis = np.random.default_rng(11).standard_normal((len(weights), min(rank, len(weights))))
    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(product(basis))[0]
    squares, turn = np.linalg.eigh(basis.T @ product(basis))
    return basis @ turn[:, ::-1], np.sqrt(np.maximum(squares[::-1], 0))


class Space:
    """Some of the benchmark's passages: their words, each one's folded-in direction, and the passages' directions."""

    def __init__(self, spark: SparkSession, passages: np.ndarray, item_of: np.ndarray, corpus: np.ndarray | DataFrame, weights: np.ndarray, weight: float = SAMPLE_WEIGHT):
        """``corpus`` and ``weight`` as of ``factored``, by the numbers of all words."""
        self.item_of = item_of
        self.words, own = np.unique(np.append(0, passages.ravel()), return_inverse=True)  # place 0 is no word
        own = own[1:].reshape(-1, PASSAGE)
        if isinstance(corpus, DataFrame):
            place = spark.createDataFrame(list(zip(self.words.tolist(), range(len(self.words)), strict=True)), "word int, place int")
            for side in ("left", "right"):
                corpus = corpus.join(F.broadcast(place.withColumnRenamed("word", side)), side).drop(side).withColumnRenamed("place", side)
            # Words' order here is that of their numbers, so a pair is still one row.
        else:
            there = np.minimum(np.searchsorted(self.words, corpus), len(self.words) - 1)
            corpus = np.where(self.words[there] == corpus, there, 0)
        basis, values = factored(spark, own, corpus, weights[self.words], len(own) + MORE_DIRECTIONS, weight)
        self.directions = (weights[self.words][:, None] * basis / np.maximum(values, 1)).astype(np.float32)
        self.targets = self.directions[own].sum(1)
        self.length = np.linalg.norm(self.targets, axis=1)
        self.targets /= np.maximum(self.length, 1e-9)[:, None]
        # The most that a word can add to what a passage holds of any of these.
        self.most = np.maximum(self.directions @ (self.targets / np.maximum(self.length, 1e-9)[:, None]).T, 0).max(1, initial=0)


def near_passages(words: np.ndarray, sizes: np.ndarray, space: Space, place: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(text, item, first word, cosine) of the texts' passages that are near one of the space's."""
    sums, text, first = passage_sums(place[words], sizes, space.directions, space.most, MIN_HELD * 0.999)
    norm = np.linalg.norm(sums, axis=1)
    for at in range(0, len(sums), 4096):
        part = np.arange(at, min(at + 4096, len(sums)))
        along = sums[part] @ space.targets.T
        p, q = np.nonzero(along >= np.maximum(MIN_COSINE * norm[part, None], MIN_HELD * space.length[None, :]))
        cosine = along[p, q] / norm[part[p]]
        yield from zip(text[part[p]].tolist(), space.item_of[q].tolist(), first[part[p]].tolist(), cosine.tolist(), strict=True)


_FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long"


def _search_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size, items, spaces = shared.value
        places = []
        for space in spaces:
            places.append(np.zeros(size + 1, np.int32))
            places[-1][space.words] = np.arange(len(space.words))
        for batch in batches:
            doc_ids, at, verified = batch.column(0).to_pylist(), 0, []
            for numbers, sizes in words.of(batch.column(1).to_pylist()):
                ends = np.cumsum(sizes)
                near: dict[tuple[int, int], dict[int, float]] = {}
                for space, place in zip(spaces, places, strict=True):
                    for text, item, first, cosine in near_passages(numbers, sizes, space, place):
                        found = near.setdefault((text, item), {})
                        found[first] = max(cosine, found.get(first, 0.0))
                for (text, k), found in near.items():
                    item, own = items[k], numbers[ends[text] - sizes[text] : ends[text]]
                    best = None
                    for first, cosine in sorted(found.items()):
                        begin = max(0, first - item.size)
                        shares = item.check(own[begin : first + PASSAGE + item.size])
                        if shares and (best is None or shares > best[3:5]):
                            best = (doc_ids[at + text], item.item_id, cosine, *shares, begin)
                    if best:
                        verified.append(best)
                at += len(sizes)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            columns = zip(*verified, strict=True) if verified else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs", "answer", "first_word"])

    return run


def _read_benchmark(benchmark: DataFrame) -> Benchmark:
    """Items with at least one word; a row for each comes to the driver."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    rows = rows.distinct().orderBy("item_id", "text", "answer").toLocalIterator()
    return Benchmark([tuple(r) for r in rows if r.text and words_of(r.text)])


def contaminated(docs: DataFrame, benchmark: DataFrame, space_passages: int = SPACE) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, first_word: the best place of each item in each document that leaks it."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = _read_benchmark(benchmark)
    found = spark.createDataFrame([], _FOUND)
    documents = rows.count() if known.items else 0
    if not documents:
        return found
    words, size = Words(known.vocabulary), len(known.vocabulary)
    counting = _frequency_batches(spark.sparkContext.broadcast((words, size)))
    counted = rows.select("text").mapInArrow(releasing(counting), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = np.zeros(size + 1)
    for row in counted.toLocalIterator():  # a row for each benchmark word
        df[row.word] = row.n
    weights = np.log((documents + len(known.items) + 1) / (df + 1))
    weights[0] = 0
    corpus = staged(spark, word_pairs(rows.select("text"), words, weights, df), "pairs")
    weight = SAMPLE_WEIGHT * np.sqrt(min(1.0, CORPUS / max(df[0], 1)))  # df[0]: passages of all documents
    passages = len(known.passages)
    bounds = list(range(0, passages, space_passages))
    for at in range(0, len(bounds), BLOCK_SPACES):
        spaces = [Space(spark, known.passages[b : b + space_passages], known.item_of[b : b + space_passages], corpus, weights, weight) for b in bounds[at : at + BLOCK_SPACES]]
        items = {k: Item(*known.items[k], weights) for k in sorted({k for s in spaces for k in s.item_of.tolist()})}
        shared = spark.sparkContext.broadcast((words, size, items, spaces))
        found = found.unionByName(rows.mapInArrow(releasing(_search_batches(shared)), _FOUND))
    best = F.max_by(F.struct("cosine", "lcs", "answer", "first_word"), F.struct("lcs", "cosine", "answer", "first_word"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
