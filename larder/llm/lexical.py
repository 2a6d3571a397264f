"""Ranked lexical search by accumulator-limited term-at-a-time processing over document shards.

Documents are read once and turned to postings of the queries' terms.  Counts over all documents (N, L and each term's
df) are Spark aggregations of those postings, after which every weight is fixed.  Each batch of documents is then a shard
that serves all queries: a query's terms are processed rarest first, each adding its whole posting list to accumulators;
before a term, if what all remaining terms can add at most (their weights times the largest factor in their lists) cannot
reach the k-th best partial score, no more accumulators are created, and the remaining terms update the existing ones
exactly.  A task keeps each query's k best so far, whose last score is a bound for its later shards as well.  A shard's k
best hold all of the whole's k best that it has, so the final ranking ranks k rows for each query and task.

Nothing is shuffled but term counts and those rows; a task holds one batch of postings and one accumulator for each of
its documents.  Queries reach the driver in blocks of ``BLOCK_ITEMS`` items and about ``BLOCK_BYTES`` of text, whose terms
are broadcast; each block is one more pass over the documents.

Edge cases: an item or document with a null text, or without a term, matches nothing and is not counted; a term that an
item repeats counts each time; repeated documents are ranked each on their own, equal ones in any order; a repeated item
gets its ranking as often as it is there; a row without doc_id comes after those with one; with fewer matching documents
than ``k``, all are given.  Only doc_id, item_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import staged, text_bytes

TOP = 20
BLOCK_ITEMS = 10_000
BLOCK_BYTES = 16 << 20
#: Documents of a shard; a task's memory follows it.
SHARD_ROWS = 8192
_UNKNOWN = np.iinfo(np.int64).max

#: Bytes of UTF-8 outside of terms become spaces, A-Z lower case.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and everything beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def factors(counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term's occurrences weigh in documents of these lengths."""
    m = 100 - 25 + (25 * lengths * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all its terms), terms and counts (those of the vocabulary), for every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in found:
            rows, lengths, ends, own, counts = [], [], [0], [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                if words := terms(text):
                    rows.append(i)
                    lengths.append(len(words))
                    for word, count in Counter(words).items():
                        if (term := known.get(word)) is not None:
                            own.append(term)
                            counts.append(count)
                    ends.append(len(own))
            ends = pa.array(ends, pa.int32())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64())]
            columns += [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (own, counts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n long, terms array<int>, counts array<int>")


class Shard:
    """Posting lists of one batch of documents."""

    def __init__(self, documents: int, term: np.ndarray, place: np.ndarray, factor: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.documents, term = documents, term[order]
        self.place, self.factor = place[order], factor[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self.slices = dict(zip(term[first].tolist(), zip(first.tolist(), np.append(first[1:], len(term)).tolist(), strict=True), strict=True))
        self.largest = dict(zip(term[first].tolist(), np.maximum.reduceat(self.factor, first).tolist() if len(first) else [], strict=True))

    def scores(self, query: list[tuple[int, int]], k: int, reached: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of documents that may be among the k best, and how many accumulators were made.

        ``query``: (term, weight times its repeats), rarest first; ``reached``: a score that k documents elsewhere have, or 0.
        """
        query = [(t, w) for t, w in query if w and t in self.slices]
        rest = np.cumsum([w * self.largest[t] for t, w in query][::-1])[::-1].tolist()
        sums, made, number, creating = np.zeros(self.documents, np.int64), np.zeros(self.documents, bool), 0, True
        for (term, w), possible in zip(query, rest, strict=True):
            if creating:
                bound = reached
                if number >= k and sums.max() > possible:
                    bound = max(bound, int(np.partition(sums[made], number - k)[number - k]))
                creating = possible >= bound  # an equal score may still win by its doc_id
                if not creating and not number:
                    break
            begin, end = self.slices[term]
            place, gain = self.place[begin:end], w * self.factor[begin:end]
            if creating:
                made[place] = True
                number = int(made.sum())
            else:
                held = made[place]
                place, gain = place[held], gain[held]
            sums[place] += gain  # a document is in a list once
        found = np.flatnonzero(sums)
        return found, sums[found], number


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score, equal ones by id."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= limit)
        return near[best(ids[near], scores[near], k)] if len(near) < len(scores) else np.lexsort((ids, -scores))[:k]
    return np.lexsort((ids, -scores))[:k]


def _ranked(found: DataFrame, queries: list[list[tuple[int, int]]], documents: int, total: int, k: int) -> DataFrame:
    """query, doc_id, score: each task's k best of each query."""
    shared = found.sparkSession.sparkContext.broadcast(queries)

    def batches(shards: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in shards:
            for start in range(0, whole.num_rows, SHARD_ROWS):
                batch = whole.slice(start, SHARD_ROWS)
                ids = batch.column(0).fill_null(_UNKNOWN).to_numpy(zero_copy_only=False)
                lists, counts = batch.column(2), batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()[: len(ids) + 1]))
                lengths = batch.column(1).to_numpy(zero_copy_only=False)
                shard = Shard(len(ids), lists.flatten().to_numpy(zero_copy_only=False), place, factors(counts, lengths[place], documents, total))
                for q, query in enumerate(shared.value):
                    old_ids, old = held.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    at, scores, _ = shard.scores(query, k, int(old[-1]) if len(old) == k else 0)
                    if len(at):
                        new_ids, new = np.concatenate([old_ids, ids[at]]), np.concatenate([old, scores])
                        top = best(new_ids, new, k)
                        held[q] = new_ids[top], new[top]
        for q, (doc_ids, scores) in held.items():
            known = pa.array(doc_ids, mask=doc_ids == _UNKNOWN)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, np.int32)), known, pa.array(scores)], ["query", "doc_id", "score"])

    return found.mapInArrow(batches, "query int, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list]:
    """Distinct items with how often each is there, in blocks that the driver can hold."""
    distinct = staged(items.sparkSession, items.groupBy("item_id", "text").agg(F.count("*").alias("copies")), "items")
    size = distinct.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    number = max(1, -(-size["items"] // BLOCK_ITEMS), -(-size["bytes"] // BLOCK_BYTES))
    for block in range(number):
        rows = distinct.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == block)
        if found := rows.collect():
            yield found


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for rows in _blocks(items):
        wanted = [Counter(terms((r.text or "").encode())) for r in rows]
        vocabulary = {term: i for i, term in enumerate(sorted(set().union(*wanted)))}
        found = staged(spark, postings(docs, vocabulary), "postings")
        size = found.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
        if not size["documents"]:
            return result
        holding = dict(found.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        queries = []
        for query in wanted:
            own = sorted(vocabulary[term] for term in query)
            repeats = {vocabulary[term]: count for term, count in query.items()}
            own.sort(key=lambda term: holding.get(term, 0))
            queries.append([(term, repeats[term] * weight(size["documents"], holding[term])) for term in own if term in holding])
        ranked = _ranked(found, queries, size["documents"], size["total"], k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        keys = spark.createDataFrame([(q, r.item_id, r.copies) for q, r in enumerate(rows)], f"query int, item_id {kind}, copies long")
        top = top.join(F.broadcast(keys), "query").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        result = result.union(staged(spark, top.select("item_id", "rank", "doc_id", "score"), "ranked"))
    return result


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
