"""Ranked lexical search the other way round: items are the index, documents stream through it.

1. The items' terms make postings (item, term, repeats).  They are cut into blocks of about ``BLOCK`` postings by a
   hash of the item; a block's inverted index has a bounded size, whatever the items' number, and is broadcast.
2. Each document is taken apart once a block; its length and its counts of indexed terms are written.  Numbers of
   documents and of terms and the terms' document frequencies are aggregated from these rows.
3. The counts stream through the index: each task keeps a heap of the best ``k`` documents for each item and hands
   out the heaps at its end.
4. Heaps are merged in two steps, first those of some tasks, then what is left of each item.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.

Defined cases: a null text has no terms, in items and documents; items that share an id are one item with the
terms of all; items without an id are left out; documents without an id count in the statistics but are not
ranked; rows that repeat a document's id are ranked each by itself; equal scores go by lesser id; other columns
are ignored; no items or no documents give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotrail.llm.grams import parts
from geotrail.llm.shared import forget, written

#: Postings of a broadcast block of items: some ten MB of a worker's memory.
BLOCK = 1 << 18
#: Scores that a task holds at a time, and the documents of its first step, when every score enters a heap.
SCORES, FIRST = 1 << 21, 64
#: Groups of tasks whose heaps are merged first.
GROUPS = 64
_SCALE = 1_000_000_000

#: Bytes as terms have them: letters in lower case, bytes of longer characters as they are, all others a space.
_AS_TERM = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_AS_TERM).split()


def postings(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats) of items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 1):
            found = [Counter(terms(t)) for t in texts]
            owner = np.repeat(np.arange(len(texts)), [len(c) for c in found])
            words, counts = [w for c in found for w in c], [n for c in found for n in c.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["item_id", "term", "repeats"])

    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    return named.mapInArrow(run, "item_id long, term binary, repeats long").groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


class Index:
    """The inverted index of some items: term numbers, and for each term the items that have it, with repeats."""

    def __init__(self, rows: list):
        self.items = sorted({r.item_id for r in rows})
        place = {item: k for k, item in enumerate(self.items)}
        self.terms = {t: k for k, t in enumerate(sorted({bytes(r.term) for r in rows}))}
        told = np.array(sorted((self.terms[bytes(r.term)], place[r.item_id], r.repeats) for r in rows), np.int64).reshape(-1, 3)
        self.item, self.repeats = told[:, 1].copy(), told[:, 2].copy()
        #: Postings of term t: first[t]:first[t + 1].
        self.first = np.searchsorted(told[:, 0], np.arange(len(self.terms) + 1))


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts): each document's number of terms, and of those of the broadcast vocabulary it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch, texts in parts(batches, 1):
            total, at, number, count = [], [0], [], []
            for text in texts:
                words = terms(text)
                found = sorted((k, n) for w, n in Counter(words).items() if (k := known.get(w)) is not None)
                total.append(len(words))
                number += (k for k, _ in found)
                count += (n for _, n in found)
                at.append(len(number))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, kind)) for v, kind in ((number, pa.int32()), (count, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Heaps:
    """The best k (score, document) of each item so far; of equal scores the lesser documents."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        #: The least that still enters: a greater score, or this one with a lesser document.
        self.score, self.doc = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """scores[document, item]; those of 0 never enter."""
        better = (scores > self.score) | ((scores == self.score) & (docs[:, None] < self.doc))
        row, column = np.nonzero(better)
        for doc, item, score in zip(docs[row].tolist(), column.tolist(), scores[row, column].tolist(), strict=True):
            heap, entry = self.heaps[item], (score, -doc)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        for item in np.unique(column).tolist():
            if len(heap := self.heaps[item]) == self.k:
                self.score[item], self.doc[item] = heap[0][0], -heap[0][1]


def _best(counts: DataFrame, index, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the heaps of each task over rows of ``term_counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        heaps, step, most = Heaps(len(ix.items), k), FIRST, max(1, SCORES // max(1, len(ix.items)))
        each = np.diff(ix.first)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            m = np.array([25 + 75 * n * documents // length for n in batch.column(1).to_pylist()], np.int64)
            begins = batch.column(2).offsets.to_numpy()
            term, tf = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            at = 0
            while at < len(ids):
                end = min(len(ids), at + min(step, most))
                own = slice(begins[at], begins[end])
                doc = np.repeat(np.arange(end - at), np.diff(begins[at : end + 1]))
                worth = weights[term[own]] * (_SCALE * tf[own] // (1000 * tf[own] + 8 * m[at + doc]))
                # each entry once for each posting of its term
                n = each[term[own]]
                entry = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(entry)) + np.repeat(ix.first[term[own]] - np.cumsum(n) + n, n)
                scores = np.zeros((end - at) * len(ix.items), np.int64)
                np.add.at(scores, doc[entry] * len(ix.items) + ix.item[place], worth[entry] * ix.repeats[place])
                heaps.offer(ids[at:end].astype(np.int64), scores.reshape(end - at, len(ix.items)))
                at, step = end, step * 2
        told = [(item, -doc, score) for item, heap in zip(ix.items, heaps.heaps, strict=True) for score, doc in heap]
        columns = zip(*told, strict=True) if told else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return counts.filter("doc_id is not null").select("doc_id", "n", "terms", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def _block(spark: SparkSession, docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """The heaps of one block of items, written; None where no document has a term."""
    index = Index(rows)
    shared = spark.sparkContext.broadcast(index)
    words = spark.sparkContext.broadcast(index.terms)
    counts = written(term_counts(docs, words))
    documents, length = counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    best = None
    if documents:
        frequency = np.zeros(len(index.terms), np.int64)
        for term, df in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():
            frequency[term] = df
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
        best = written(_best(counts, shared, weights, documents, length, k))
    forget(counts)
    return best


def rank(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents (doc_id, text) of the highest scores above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    told = written(postings(items))
    blocks = max(1, -(-told.count() // block))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    best = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        own = told.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a block's postings
        found = _block(spark, rows, own, k) if own else None
        best = best if found is None else best.unionByName(found)
    forget(told)
    order = [F.desc("score"), F.asc("doc_id")]
    some = Window.partitionBy("item_id", "__group").orderBy(*order)
    grouped = best.withColumn("__group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    left = grouped.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("__group", "rank")
    all_of = Window.partitionBy("item_id").orderBy(*order)
    return left.withColumn("rank", F.row_number().over(all_of)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
