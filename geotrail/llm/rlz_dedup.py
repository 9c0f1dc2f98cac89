"""Substring dedup by relative Lempel-Ziv parsing.

A word window of ``WINDOW`` words that also starts in a document of lesser id is a duplicate.  The
reference blocks are indexed by anchors: of the short word grams of a window the one with the least hash,
so equal windows have equal anchors.  An anchor's reference block is the first document that has it.

1. Anchors of all documents are counted; those of two documents or more, with their first document, are
   joined back.  Counting is aggregated before the shuffle, and the join deals anchors with many places over tasks.
2. Each document sends the runs of words around its shared anchors to their reference blocks, and as a
   block the runs around the anchors that it has first.  Runs for a much copied block are dealt over
   several tasks, each with the block.
3. A run is parsed greedily into factors of its block: from the first window that the block has, the longest
   match there, by the block's sorted suffixes where a window stands in it more than once; the next factor begins
   after it.  Only the windows across a factor's end are looked up as well, so that what straddles two factors is found.
4. Windows that their block doesn't hold may still be in a document between the two, if their anchor has a third
   place: these are indexed themselves, by 128-bit hashes, with their first document.

Factors and windows so found are the duplicate spans; ``remove`` takes their words out of the documents.
Words are met by hashes and then compared themselves, but for step 4.  Rows are told apart by id and text.

Defined cases: a null text has no words; ids that repeat are one document in several rows: rows of one id
don't make duplicates of each other, and each has its own spans; rows without an id neither give nor get
duplicates; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.grams import Words, as_bytes, mix, parts, windows
from geotrail.llm.shared import forget, spread_join, written

#: Words of a window and of an anchor: long enough that documents rarely share one by chance.
WINDOW, ANCHOR = 13, 8
#: Shared anchors whose runs one task parses against a block: some 0.5 MB of text; most blocks that are parsed in parts.
SALT, MOST = 1 << 13, 1 << 20

_LOW = np.uint64((1 << 24) - 1)


def window_anchors(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of ``window`` items, where its anchor starts: the leftmost least of its grams."""
    width = window - gram + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)
    done = 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    at = np.arange(n, dtype=np.uint64)
    return (at + (((least[:n] & _LOW) - at) & _LOW)).astype(np.int64)


def by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` tells rows of one id apart by their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, row, at): the anchors of rows (doc_id, row, text) and the words where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 2):
            words = Words(texts)
            if len(words.hashes) < WINDOW:
                continue
            grams = windows(words.hashes, ANCHOR)
            at = window_anchors(grams, WINDOW, ANCHOR)
            n = np.diff(words.first)
            inside = np.ones(len(at), bool)
            for end in words.first[1:-1]:  # windows across two texts
                inside[max(0, end - WINDOW + 1) : end] = False
            owner = np.repeat(np.arange(len(texts)), n)
            place = np.unique(at[inside])
            doc = owner[place]
            ids = [batch.column(k).take(pa.array(doc)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(grams[place].view(np.int64)), *ids, pa.array((place - words.first[doc]).astype(np.int32))], names=["anchor", "doc_id", "row", "at"])

    return docs.mapInArrow(run, "anchor long, doc_id long, row long, at int")


def runs(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(block, doc_id, row, refers, seek, at, words): what rows (doc_id, row, text) send to reference blocks.

    ``shared``: (doc_id, row, told array<struct<at, block, more>>), ``more`` for anchors of more than two places; ``seek`` says
    that what the block lacks may be elsewhere.  ``at`` is the first word's number in its text.
    """
    rows = docs.join(shared, ["doc_id", "row"]).select("doc_id", "row", "text", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 2):
            words, out = Words(texts), [[], [], [], [], [], [], []]
            ids, keys, told = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for k, (doc, key) in enumerate(zip(ids, keys, strict=True)):
                own = words.hashes[words.first[k] : words.first[k + 1]]
                anchor = window_anchors(windows(own, ANCHOR), WINDOW, ANCHOR)
                if not len(anchor):
                    continue
                block = np.full(len(own), -1, np.int64)
                known, more = np.zeros(len(own), bool), np.zeros(len(own), bool)
                pairs = told[k].values
                at = pairs.field("at").to_numpy()
                block[at], known[at], more[at] = pairs.field("block").to_numpy(), True, pairs.field("more").to_numpy(zero_copy_only=False)
                of, has, seek = block[anchor], known[anchor], more[anchor]
                edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (has[1:] != has[:-1]) | (seek[1:] != seek[:-1])]))
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(of)], strict=True):
                    if has[a]:
                        values = (int(of[a]), doc, key, int(of[a]) != doc, bool(seek[a]), a, words.text(words.first[k] + a, words.first[k] + b - 1 + WINDOW))
                        for column, v in zip(out, values, strict=True):
                            column.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["block", "doc_id", "row", "refers", "seek", "at", "words"])

    return rows.mapInArrow(run, "block long, doc_id long, row long, refers boolean, seek boolean, at int, words binary")


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many first items of two arrays are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        same = a[at : at + step] == b[at : min(n, at + step)] if at + step <= n else a[at:n] == b[at:n]
        if not same.all():
            return at + int(np.argmin(same))
        at, step = at + step, step * 4
    return n


class Block:
    """An indexed reference block: the words of some runs, the windows that start in them, and their sorted suffixes."""

    def __init__(self, texts: list[bytes]):
        self.words = Words(texts)
        self.hashes = self.words.hashes
        first = self.words.first
        #: For each word the end of its run.
        self.ends = np.repeat(first[1:], np.diff(first))
        grams = windows(self.hashes, WINDOW)
        fits = np.flatnonzero(np.arange(len(grams)) + WINDOW <= self.ends[: len(grams)])
        #: A place of each window, and the windows with more than one.
        self.place = dict(zip(grams[fits].tolist(), fits.tolist(), strict=True))
        some, count = np.unique(grams[fits], return_counts=True)
        self.many = set(some[count > 1].tolist())
        self._sorted: np.ndarray | None = None

    def suffixes(self) -> np.ndarray:
        """All places, sorted by the words from there to the end of their run: prefixes of doubling length are ranked."""
        if self._sorted is None:
            n = len(self.hashes)
            at, k = np.arange(n), 1
            rank = np.unique(self.hashes, return_inverse=True)[1] + 1
            while k < n:
                after = np.where(at + k < self.ends, rank[np.minimum(at + k, n - 1)], 0)
                told, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
                rank += 1
                if len(told) == n or k > int((self.ends - at).max()):
                    break
                k *= 2
            self._sorted = np.argsort(rank, kind="stable")
        return self._sorted

    def longest(self, run: np.ndarray, gram: int) -> tuple[int, int]:
        """(length, place) of the longest match with the start of ``run``, whose first window the block has."""
        p = self.place[gram]
        if gram not in self.many:
            return _alike(run, self.hashes[p : self.ends[p]]), p
        order = self.suffixes()
        low, high, best = 0, len(order), (0, 0)
        while low < high:
            middle = (low + high) // 2
            p = int(order[middle])
            own = self.hashes[p : self.ends[p]]
            n = _alike(run, own)
            best = max(best, (n, p))
            if n == len(run):
                break
            if n == len(own) or own[n] < run[n]:
                low = middle + 1
            else:
                high = middle
        return best


def parse(words: Words, block: Block) -> tuple[list[tuple[int, int]], list[int], list[int], int]:
    """(factors, found, lacking, lookups) of runs against a block, places over all runs.

    factors: (first word, end), in order and apart; found: first words of windows across a factor's end that the block holds
    too; lacking: first words of all other windows.  Lookups are far fewer than windows where runs are copied.
    """
    grams = windows(words.hashes, WINDOW).tolist()
    place, compared = block.place, block.words
    factors, found, lacking, lookups = [], [], [], 0
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        i, looked = a, a  # windows before ``looked`` have been looked up
        while i + WINDOW <= b:
            lookups += 1
            gram = grams[i]
            n = 0
            if gram in place:
                n, p = block.longest(words.hashes[i:b], gram)
                if words.text(i, i + n) != compared.text(p, p + n):  # words that differ but share a hash
                    n = next((k for k in range(n) if words.text(i + k, i + k + 1) != compared.text(p + k, p + k + 1)), n)
            if n < WINDOW:
                if i >= looked:
                    lacking.append(i)
                i += 1
                continue
            factors.append((i, i + n))
            looked = min(i + n, b - WINDOW + 1)
            for k in range(i + n - WINDOW + 1, looked):
                lookups += 1
                p = place.get(grams[k])
                (found if p is not None and words.text(k, k + WINDOW) == compared.text(p, p + WINDOW) else lacking).append(k)
            i += n
    return factors, found, lacking, lookups


def _parsed(sent: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, row, at, upto, g, h): factors as word ranges, and windows that the block lacks and that are sought, with their hashes.

    ``asked``: (block, n), the anchors of other documents that refer to a block.  Blocks with over ``SALT``, and over
    1/``MOST`` of all, are parsed in parts: fewer than MOST by that, so their numbers of parts are broadcast.
    """
    limit = max((asked.agg(F.sum("n")).first()[0] or 0) // MOST, SALT)
    salts = F.broadcast(asked.filter(F.col("n") > limit).select("block", F.ceil(F.col("n") / limit).cast("int").alias("salts")))
    rows = sent.join(salts, "block", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("doc_id", "row", "at"), F.col("salts")).cast("int")
    salt = F.when(F.col("refers"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    dealt = rows.select("block", F.explode(salt).alias("salt"), "doc_id", "row", "refers", "seek", "at", "words")

    def run(table: pa.Table) -> pa.Table:
        refers = table["refers"].to_numpy(zero_copy_only=False)
        text = as_bytes(table["words"].combine_chunks())
        mine = np.flatnonzero(refers)
        doc, row, at, seek = (table[c].to_numpy(zero_copy_only=False)[mine] for c in ("doc_id", "row", "at", "seek"))
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        block = Block([t for t, r in zip(text, refers, strict=True) if not r]) if len(mine) else None
        for first in range(0, len(mine), 512):
            words = Words([text[k] for k in mine[first : first + 512]])
            factors, found, lacking, _ = parse(words, block)
            spans = np.array(factors + [(k, k + WINDOW) for k in found], np.int64).reshape(-1, 2)
            left = np.array(lacking, np.int64)
            left = left[seek[first + np.searchsorted(words.first, left, "right") - 1].astype(bool)]
            second = windows(mix(words.hashes + np.uint64(77)), WINDOW)[left] if len(left) else np.zeros(0, np.uint64)
            hashes = windows(words.hashes, WINDOW)[left] if len(left) else np.zeros(0, np.uint64)
            start, upto = np.concatenate([spans[:, 0], left]), np.concatenate([spans[:, 1], left + WINDOW])
            owner = np.searchsorted(words.first, start, "right") - 1
            off = at[first + owner] - words.first[owner]
            blank = np.zeros(len(spans), np.uint64)
            for column, v in zip(out, (doc[first + owner], row[first + owner], start + off, upto + off, np.concatenate([blank, hashes]), np.concatenate([blank, second])), strict=True):
                column.append(v)
        empty = np.zeros(0, np.int64)
        ids, rows_, a, b, g, h = (np.concatenate([empty, *(x.view(np.int64) for x in column)]) if column else empty for column in out)
        return pa.table({"doc_id": ids, "row": rows_, "at": a.astype(np.int32), "upto": b.astype(np.int32), "g": g, "h": h})

    return dealt.groupBy("block", "salt").applyInArrow(run, "doc_id long, row long, at int, upto int, g long, h long")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, upto): word ranges of ``docs`` (doc_id, text) that are covered by duplicate windows."""
    rows = by_row(docs).filter("doc_id is not null")
    found = anchors(rows)
    first = written(found.groupBy("anchor").agg(F.min("doc_id").alias("block"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("block < last").select("anchor", "block", "n"))
    joined = spread_join(found, first, ["anchor"], F.xxhash64("doc_id", "row", "at"))
    shared = written(joined.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "block", (F.col("n") > 2).alias("more"))).alias("told")))
    asked = written(shared.select("doc_id", F.explode("told").alias("t")).filter("t.block < doc_id").groupBy("t.block").agg(F.count("*").alias("n")))
    told = written(_parsed(runs(rows, shared), asked))
    forget(first, shared, asked)
    lacking = told.filter("g <> 0 or h <> 0")
    between = lacking.groupBy("g", "h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("least < last")
    later = spread_join(lacking, written(between.select("g", "h", "least", "n")), ["g", "h"], F.xxhash64("doc_id", "row", "at")).filter("least < doc_id").select("doc_id", "row", "at", "upto")
    return told.filter("g = 0 and h = 0").select("doc_id", "row", "at", "upto").unionByName(later)


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of ``docs`` outside their spans, joined by one space."""
    each = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "upto")).alias("spans"))
    rows = by_row(docs).join(each, ["doc_id", "row"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for k, text in enumerate(as_bytes(batch.column(1))):
                word = text.split()
                out = np.zeros(len(word) + 1, np.int64)
                if batch.column(2)[k].is_valid:
                    pairs = batch.column(2)[k].values
                    np.add.at(out, pairs.field("at").to_numpy(), 1)
                    np.add.at(out, pairs.field("upto").to_numpy(), -1)
                gone = np.cumsum(out)[:-1] > 0
                total.append(len(word))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(word if not removed[-1] else [w for w, g in zip(word, gone, strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def removed_digest(text: str, gone: list[bool]) -> str:
    """The digest of one text without some words; for tests."""
    return hashlib.sha256(b" ".join(w for w, g in zip(text.encode().split(), gone, strict=True) if not g)).hexdigest()
