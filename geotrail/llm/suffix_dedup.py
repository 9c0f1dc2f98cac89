"""Exact substring dedup by a distributed, common-prefix-aware merge sort of suffixes.

A byte string of ``LENGTH`` bytes that starts in two places of the corpus is a duplicate.  Of such a
string's short grams the one with the least hash is its anchor, so equal strings have equal anchors at
equal distances, and only the suffixes that start at anchors are sorted (about one in 180 bytes).

1. Anchors are counted (aggregated before the shuffle); those that occur once are dropped.
2. Each task writes the suffixes at its anchors, as far as a duplicate can reach, as sorted runs that are
   front-coded: the length of the prefix shared with the suffix before, and the rest.  Equal suffixes of a
   run with equal text before them are settled there, and only one goes on.
3. Runs meet by buckets of anchors.  A loser tree merges them: what is known of a common prefix, from front
   coding or from earlier matches, is never compared again, and the merge leaves each suffix's common
   prefix with the one before.
4. Suffixes with one anchor stand together.  Two of them hold a duplicate at distance o before the anchor
   if their common prefix is at least LENGTH - o and their common text before the anchor at least o.

Anchors that occur over ``HOT`` times take another exact way, so that no bucket holds them all: the strings that
they stand for are counted by 128-bit hashes of mixed eights of bytes, aggregated before the shuffle, and joined back.

Texts that repeat with a period of at most ``PERIOD`` have no anchor inside: a run of at least a period more
than LENGTH is its own duplicate, and its first period of starts stands for it elsewhere.

Rows are told apart by id and text.

Defined cases: a null text is an empty one; each of several rows of one id has its own spans; equal rows are
duplicates of each other; rows without an id neither give nor get duplicates; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.grams import eights, mix, parts, windows
from geotrail.llm.rlz_dedup import by_row, window_anchors
from geotrail.llm.shared import forget, spread_join, written

#: Bytes of a duplicate string and of an anchor's gram; the longest period of a gram that is no anchor.
LENGTH, GRAM, PERIOD = 400, 48, 24
#: Bytes of suffixes in a sorted run and in a bucket; suffixes of one anchor that are compared pair by pair.
RUN_BYTES, BUCKET_BYTES, FEW = 16 << 20, 4 << 20, 128
#: Occurrences of an anchor from which its strings are counted by hash.
HOT = 20_000
#: Bytes of text whose grams are hashed at a time, small enough for a core's cache; bytes of texts cut at a time.
PART, KEPT_BYTES = 1 << 17, 1 << 22

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 24) - 1)


def _periodic(raw: np.ndarray) -> np.ndarray:
    """Which grams repeat with a period of at most PERIOD."""
    out = np.zeros(max(0, len(raw) - GRAM + 1), bool)
    for d in range(1, PERIOD + 1):
        same = raw[d:] == raw[:-d]
        full = same[: len(same) & ~7].view(np.uint64) == np.uint64(0x0101010101010101)
        both = full[:-1] & full[1:]  # a run of GRAM - PERIOD has two whole words
        if not both.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], both.view(np.int8), [0]])))
        for a, b in zip((edge[::2] * 8).tolist(), (edge[1::2] * 8 + 8).tolist(), strict=True):
            while a > 0 and same[a - 1]:
                a -= 1
            while b < len(same) and same[b]:
                b += 1
            if b - a >= GRAM - d:
                out[a : b + d - GRAM + 1] = True
    return out


def least_period(text: bytes) -> int:
    return next(d for d in range(1, len(text) + 1) if text[d:] == text[:-d])


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(owner, anchor hash, place, first and last start of the strings it stands for), places within texts.

    Place -1: all strings from the first to the last start are duplicates of one another already.
    """
    flat = b"".join(texts)
    raw = np.frombuffer(flat, np.uint8)
    empty = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return empty, empty.view(np.uint64), empty, empty, empty
    gram = windows(raw.astype(np.uint64) + np.uint64(1), GRAM)
    masked = np.where(_periodic(raw), _TOP, gram & ~_LOW)
    at = window_anchors(masked, LENGTH, GRAM)
    begin = np.cumsum([0, *map(len, texts)])
    size = np.diff(begin)
    inside = np.zeros(len(at) + 1, np.int64)
    for a, n in zip(begin[:-1].tolist(), size.tolist(), strict=True):
        if n >= LENGTH:
            inside[a] += 1
            inside[a + n - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    owner = np.searchsorted(begin, starts, "right") - 1
    place = at[starts]
    dull = masked[place] == _TOP
    group = np.where(dull, -1, place)
    cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(starts) else empty
    last = np.concatenate([cut[1:], [len(starts)]]) - 1 if len(cut) else empty
    who, key, where, lo, hi = [], [], [], [], []
    for a, b in zip(cut[dull[cut]].tolist(), last[dull[cut]].tolist(), strict=True):
        x, y, k = int(starts[a]), int(starts[b]), int(owner[a])
        d = least_period(flat[x : x + LENGTH])
        for s in range(x, min(y, x + d - 1) + 1):
            who.append(k)
            key.append(int(gram[s]))
            where.append(s)
            lo.append(s)
            hi.append(s)
        if y - x >= d:
            who.append(k)
            key.append(0)
            where.append(begin[k] - 1)
            lo.append(x)
            hi.append(y)
    plain = ~dull[cut]
    owners = np.concatenate([owner[cut][plain], np.array(who, np.int64)])
    off = begin[owners]
    both = lambda x, y: np.concatenate([x, np.array(y, np.int64)]) - off
    keys = np.concatenate([gram[place[cut][plain]], np.array(key, np.uint64)])
    return owners, keys, both(place[cut][plain], where), both(starts[cut][plain], lo), both(starts[last][plain], hi)


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, row, at, lo, hi) of rows (doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 2, PART):
            owner, key, at, lo, hi = anchors_of(texts)
            ints = [pa.array(x.astype(np.int32)) for x in (at, lo, hi)]
            ids = [batch.column(k).take(pa.array(owner)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *ids, *ints], names=["anchor", "doc_id", "row", "at", "lo", "hi"])

    return docs.mapInArrow(run, "anchor long, doc_id long, row long, at int, lo int, hi int")


def common_prefix(a: bytes, b: bytes, n: int = 0) -> int:
    """Length of the common prefix of a and b, known to be at least n."""
    step = 16
    while True:
        x, y = a[n : n + step], b[n : n + step]
        if x != y:
            break
        if len(x) < step:
            return n + len(x)
        n, step = n + step, step * 4
    size = min(len(x), len(y))
    differ = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
    return n + size - (differ.bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merges sorted runs of (common prefix with the one before, string, item) with a loser tree.

    A player's common prefix is always that with the last winner, so unequal ones decide without a look at
    the strings, and equal ones leave only what follows to compare.
    """
    k = 1
    while k < len(runs):
        k *= 2
    told: list[tuple[bytes, tuple] | None] = [None] * k
    prefix = [0] * k
    losers = [0] * k

    def step(i: int) -> None:
        got = next(runs[i], None) if i < len(runs) else None
        if got is None:
            told[i] = None
        else:
            prefix[i], told[i] = got[0], got[1:]

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser."""
        a, b = told[i], told[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if prefix[i] != prefix[j]:
            return (i, j) if prefix[i] > prefix[j] else (j, i)
        n = common_prefix(a[0], b[0], prefix[i])
        if a[0][n : n + 1] <= b[0][n : n + 1]:
            prefix[j] = n
            return i, j
        prefix[i] = n
        return j, i

    for i in range(k):
        step(i)
    winners = list(range(k))
    width = k
    while width > 1:
        nxt = []
        for p in range(0, width, 2):
            win, lose = play(winners[p], winners[p + 1])
            losers[(width + p) // 2] = lose
            nxt.append(win)
        winners, width = nxt, width // 2
    win = winners[0]
    while told[win] is not None:
        yield prefix[win], *told[win]
        step(win)
        node = (win + k) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2


_RUN = "bucket int, doc_id array<long>, row array<long>, at array<int>, lo array<int>, hi array<int>, shared array<int>, rest array<binary>, before array<binary>, settled array<struct<doc_id:long,row:long,lo:int,hi:int>>"
_SETTLED = pa.list_(pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
_SPAN = "doc_id long, row long, first int, end int"


def _sorted_runs(docs: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Front-coded sorted runs by bucket; ``settled`` holds the strings from lo to hi that a run has twice."""
    rows = docs.join(shared, ["doc_id", "row"]).select("doc_id", "row", "text", "told")
    n = np.uint64(buckets)

    def coded(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        found.sort(key=lambda x: x[:3])
        out, at = [], 0
        while at < len(found):
            end = at
            own: list[list] = [[], [], [], [], [], [], [], []]
            settled = []
            last = b""
            while end < len(found) and found[end][0] == found[at][0]:
                bucket, right, left, doc, row, place, lo, hi = found[end]
                again = end + 1
                while again < len(found) and found[again][:3] == (bucket, right, left):
                    again += 1
                if again > end + 1:
                    settled += [{"doc_id": x[3], "row": x[4], "lo": x[6], "hi": x[7]} for x in found[end:again]]
                n_same = common_prefix(last, right)
                for column, v in zip(own, (doc, row, place, lo, hi, n_same, right[n_same:], left), strict=True):
                    column.append(v)
                last, end = right, again
            out.append((found[at][0], *own, settled))
            at = end
        types = (pa.int32(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 4, *[pa.list_(pa.binary())] * 2, _SETTLED)
        for few in range(0, len(out), 64):
            columns = zip(*out[few : few + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "doc_id", "row", "at", "lo", "hi", "shared", "rest", "before", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch, texts in parts(batches, 2):
            for k, (doc, row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True)):
                told = batch.column(3)[k].values
                bucket = (told.field("anchor").to_numpy().view(np.uint64) % n).astype(np.int64).tolist()
                for b, at, lo, hi in zip(bucket, *(told.field(c).to_pylist() for c in ("at", "lo", "hi")), strict=True):
                    if hi + LENGTH <= len(text):
                        found.append((b, text[at : hi + LENGTH], text[lo:at][::-1], doc, row, at, lo, hi))
                        size += hi - lo + LENGTH
            if size > RUN_BYTES:
                yield from coded(found)
                found, size = [], 0
        if found:
            yield from coded(found)

    return rows.mapInArrow(run, _RUN)


def duplicates_of(group: list[tuple]) -> Iterator[tuple]:
    """(document, first byte, end) for suffixes of one anchor, sorted: (common prefix, right, left, document, at, lo, hi)."""
    if len(group) <= FEW:
        reached: list[set[tuple[int, int]]] = [set() for _ in group]  # nearest and farthest distance of shared strings
        for i, (_, _, left, _, at, lo, hi) in enumerate(group):
            reach, near, far, own = 1 << 30, at - hi, at - lo, reached[i]
            for j in range(i + 1, len(group)):
                shared, _, other, _, at_j, lo_j, hi_j = group[j]
                if shared < reach:
                    reach = shared
                low, high = max(LENGTH - reach, near, at_j - hi_j), min(far, at_j - lo_j)
                if low <= high and left[:low] == other[:low]:
                    found = (low, min(high, common_prefix(left, other, low)))
                    own.add(found)
                    reached[j].add(found)
        for (_, _, _, doc, at, _, _), found in zip(group, reached, strict=True):
            for low, high in found:
                yield doc, at - high, at - low + LENGTH
        return
    m = len(group)
    right = np.array([g[0] for g in group])
    order = sorted(range(m), key=lambda k: group[k][2])
    left = np.zeros(m, np.int64)
    for a, b in zip(order, order[1:], strict=False):
        left[b] = common_prefix(group[a][2], group[b][2])
    order_a = np.array(order)
    nearest, farthest = np.array([g[4] - g[6] for g in group]), np.array([g[4] - g[5] for g in group])
    low, high = int(nearest.min()), int(farthest.max())
    hit = np.zeros((m, high - low + 2), bool)
    before = np.zeros(m, np.int64)
    for o in range(low, high + 1):
        active = np.flatnonzero((nearest <= o) & (o <= farthest))
        before[order_a] = np.cumsum(left[order_a] < o)
        key = np.cumsum(right < LENGTH - o) * (m + 1) + before
        _, inverse, count = np.unique(key[active], return_inverse=True, return_counts=True)
        hit[active[count[inverse] > 1], o - low] = True
    for k in np.flatnonzero(hit.any(1)).tolist():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[k].view(np.int8)])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            yield group[k][3], group[k][4] - (low + b - 1), group[k][4] - (low + a) + LENGTH


def _run_items(row: dict) -> Iterator[tuple[int, bytes, tuple]]:
    last = b""
    documents = zip(row["doc_id"], row["row"], strict=True)
    for shared, rest, *item in zip(row["shared"], row["rest"], row["before"], documents, row["at"], row["lo"], row["hi"], strict=True):
        last = last[:shared] + rest
        yield shared, last, tuple(item)


def _merged(runs: DataFrame) -> DataFrame:
    """(doc_id, row, first, end) of the duplicates that a bucket's runs hold."""

    def run(table: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], []]
        group: list[tuple] = []

        def done() -> None:
            if len(group) > 1:
                for document, first, end in duplicates_of(group):
                    for column, v in zip(out, (*document, first, end), strict=True):
                        column.append(v)
            group.clear()

        players = [_run_items(row) for batch in table.drop_columns(["settled"]).to_batches(1) for row in batch.to_pylist()]
        for shared, right, item in merge(players):
            if shared < GRAM:
                done()
            group.append((shared, right, *item))
        done()
        kinds = {"doc_id": pa.int64(), "row": pa.int64(), "first": pa.int32(), "end": pa.int32()}
        merged = pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), out, strict=True)})
        settled = [chunk.flatten() for chunk in table["settled"].chunks]
        own = [pa.table({"doc_id": x.field("doc_id"), "row": x.field("row"), "first": x.field("lo"), "end": pc.add(x.field("hi"), pa.scalar(LENGTH, pa.int32()))}) for x in settled]
        return pa.concat_tables([merged, *own])

    return runs.groupBy("bucket").applyInArrow(run, _SPAN)


def _hashed_strings(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(g, h, doc_id, row, first): hashes of all strings that the anchors in ``shared`` stand for.

    Bytes go in by eights from each place on, mixed: a plain polynomial over bytes has strings of two letters that
    collide by their build.
    """
    rows = docs.join(shared, ["doc_id", "row"]).select("doc_id", "row", "text", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 2, PART):
            for k, (doc, row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True)):
                told = batch.column(3)[k].values
                for lo, hi in zip(told.field("lo").to_pylist(), told.field("hi").to_pylist(), strict=True):
                    if hi + LENGTH <= len(text):
                        each = eights(text[lo : hi + LENGTH])[: hi - lo + LENGTH - 7]
                        g, h = (windows(mix(each + np.uint64(n)), LENGTH - 7).view(np.int64) for n in (1, 77))
                        ids = [pa.array(np.full(len(g), x)) for x in (doc, row)]
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(h), *ids, pa.array(np.arange(lo, hi + 1, dtype=np.int32))], names=["g", "h", "doc_id", "row", "first"])

    return rows.mapInArrow(run, "g long, h long, doc_id long, row long, first int")


def _by_hash(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, row, first, end) of the strings of hot anchors that occur twice."""
    found = _hashed_strings(docs, shared)
    twice = found.groupBy("g", "h").agg(F.count("*").alias("n")).filter("n > 1").select("g", "h")
    return found.join(twice, ["g", "h"]).select("doc_id", "row", "first", (F.col("first") + LENGTH).alias("end"))


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, first, end): byte ranges of ``docs`` (doc_id, text) whose every byte a duplicate string covers."""
    rows = by_row(docs).filter("doc_id is not null")
    found = written(anchors(rows))
    twice = written(found.filter("at >= 0").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    alone = found.filter("at < 0").select("doc_id", "row", F.col("lo").alias("first"), (F.col("hi") + LENGTH).alias("end"))
    shared = spread_join(found.filter("at >= 0"), twice, ["anchor"], F.xxhash64("doc_id", "row", "at")).withColumn("hot", F.col("n") > HOT)
    shared = written(shared.groupBy("doc_id", "row", "hot").agg(F.collect_list(F.struct("anchor", "at", "lo", "hi")).alias("told")))
    forget(twice)
    few, many = shared.filter("not hot").drop("hot"), shared.filter("hot").drop("hot")
    size = few.agg(F.sum(F.aggregate("told", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"] + LENGTH))).first()[0] or 0
    spans = _merged(_sorted_runs(rows, few, max(1, -(-size // BUCKET_BYTES)))).unionByName(alone)
    return spans.unionByName(_by_hash(rows, many)) if many.limit(1).count() else spans


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): the bytes of ``docs`` outside their spans."""
    each = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    rows = by_row(docs).join(each, ["doc_id", "row"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 1, KEPT_BYTES):
            total, removed, n_spans, kept = [], [], [], []
            for k, text in enumerate(texts):
                total.append(len(text))
                if not batch.column(2)[k].is_valid:
                    removed.append(0)
                    n_spans.append(0)
                    kept.append(text)
                    continue
                pairs = batch.column(2)[k].values
                step = np.zeros(len(text) + 1, np.int32)
                np.add.at(step, pairs.field("first").to_numpy(), 1)
                np.add.at(step, pairs.field("end").to_numpy(), -1)
                gone = np.cumsum(step)[:-1] > 0
                removed.append(int(gone.sum()))
                n_spans.append(int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            longs = [pa.array(x, pa.int64()) for x in (total, removed, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
