"""N-gram Jaccard join with a MinHash LSH forest.

A text has a label of ``DEPTH`` minhashes in each tree; a tree is the trie of its labels, kept as a sorted
table.  Ranges of it are dealt over the cluster and walked: the common prefixes of neighbours tell the
trie's nodes and how many texts stand under them.

1. In the ``FIRST`` trees every text's matched prefix, at first its whole label, is shortened as far as no more
   than ``CROWD`` texts have it in common, at most to the length at which a pair at the threshold is met with the
   target chance (``shortest``).  Prefixes that stay longer miss more; each text's own chance follows from its prefixes.
2. Texts that haven't reached the target get ``MORE`` trees, among themselves, with prefixes shortened until the
   one that lacks most reaches it, crowd or not.
3. Under each node so found, every text is compared with the node's least text by signature; texts of a node that
   are then still apart are compared in blocks.  What is like enough is joined to groups.

Groups are verified exactly: their shingle sets meet in blocks of at most ``BLOCK`` texts,
each pair of blocks in a task, which counts the pairs at the threshold and keeps a spanning forest of
them.  No task emits the pairs of a group, and none holds more than two blocks.

Classes are the components of the verified links.  Copies (equal word sequences) count as one text:
they share its class and links, and ``n_links`` counts the other different texts of the class that
are at the threshold.

Defined cases: a null text is an empty one; a text without words is in a class of its own; one of fewer
than ``WIDTH`` words has its whole word sequence as its only shingle; rows without an id, and empty
texts, have no links and their own id as class; rows with one id and different texts are different
texts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.llm.components import components
from geotrail.llm.grams import Words, mix, parts, windows
from geotrail.llm.shared import packed, spread_join, swept, written

#: Words of a shingle, the least similarity of a link, the chance to meet a pair at it.
WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Minhashes of a label, first trees, texts with one prefix from which it isn't shortened further there, further trees.
DEPTH, FIRST, CROWD, MORE = 16, 24, 128, 40
#: Minhashes of a sketch (of the first labels); standard deviations below the threshold at which two sketches are unlike.
SKETCH, SIGMAS = 256, 7
#: Rows of a sorted range, texts of a block, shingles that are multiplied at a time.
RANGE, BLOCK, COLUMNS = 1 << 19, 256, 8192


def missed(depth: int, trees: int = 1, similarity: float = THRESHOLD) -> float:
    """Logarithm of the chance that a pair shares a prefix of this depth in none of the trees."""
    return trees * math.log1p(-(similarity**depth)) if similarity**depth < 1 else -math.inf


def shortest(target: float = RECALL, trees: int = FIRST, similarity: float = THRESHOLD, so_far: float = 0.0) -> int:
    """The longest prefix at which pairs are met with the target chance in so many trees; ``so_far`` is what ``missed`` tells of others."""
    return next((d for d in range(DEPTH, 0, -1) if so_far + missed(d, trees, similarity) <= math.log(1 - target)), 1)


def unlike(threshold: float = THRESHOLD) -> float:
    """Share of equal minhashes under which two texts aren't verified; a linked pair falls below it with a chance of about 1e-12."""
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / SKETCH)


def _seeds(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    times, plus = rng.integers(0, 1 << 31, first + n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, first + n, np.uint32)
    return times[first:], plus[first:]


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes of a word sequence, in order."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))


def text_digest(text: bytes) -> bytes:
    """The digest of a word sequence."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def labels_of(texts: list[bytes], first: int, trees: int, width: int = WIDTH) -> tuple[list[bytes | None], list[int]]:
    """Each text's labels in some trees, DEPTH bytes a tree (a byte of each minhash), and its number of shingles."""
    words = Words(texts)
    sets = [shingles(words.hashes[a:b], width) for a, b in zip(words.first, words.first[1:], strict=False)]
    full = [k for k, s in enumerate(sets) if len(s)]
    n, sizes, out = trees * DEPTH, [len(s) for s in sets], [None] * len(texts)
    if full:
        times, plus = _seeds(first * DEPTH, n)
        flat = (np.concatenate([sets[k] for k in full]) >> np.uint64(32)).astype(np.uint32)
        begins = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
        least = np.empty((n, len(full)), np.uint32)
        for at in range(0, len(full), 256):
            few = flat[begins[at] : begins[at + 256] if at + 256 < len(full) else None]
            own = begins[at : at + 256] - begins[at]
            for i in range(n):
                h = few * times[i]
                h += plus[i]
                least[i, at : at + 256] = np.minimum.reduceat(h, own)
        label = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T.copy()
        for place, k in enumerate(full):
            out[k] = label[place].tobytes()
    return out, sizes


def signatures(docs: DataFrame, trees: int, width: int = WIDTH) -> DataFrame:
    """(doc_id, raw, digest, labels, size) of docs (doc_id, text); raw is the text's hash, the digest its word sequence's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 1):
            labels, sizes = labels_of(texts, 0, trees, width)
            digests = [None if x is None else text_digest(t) for x, t in zip(labels, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(labels, pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "raw", "digest", "labels", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", raw_hash().alias("raw"))
    return rows.mapInArrow(run, "doc_id long, raw long, digest binary, labels binary, size int")


def raw_hash() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def _more_labels(docs: DataFrame, wanted: DataFrame, first: int, trees: int, width: int) -> DataFrame:
    """(id, labels) in further trees of the texts ``wanted`` (id, doc_id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 1):
            labels, _ = labels_of(texts, first, trees, width)
            right = pa.array([text_digest(t) == d for t, d in zip(texts, batch.column(2).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.binary())], names=["id", "labels"]).filter(right)

    rows = wanted.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select("id", "text", "digest")
    return rows.mapInArrow(run, "id long, labels binary").dropDuplicates(["id"])


def _prefix_hash(label: np.ndarray, depth: int) -> np.ndarray:
    """A hash of tree and prefix of rows (tree byte, label bytes)."""
    cut = np.zeros((len(label), 24), np.uint8)
    cut[:, : depth + 1] = label[:, : depth + 1]
    a, b, c = cut.view(np.uint64).T
    return mix(mix(mix(a + np.uint64(depth)) ^ b) + c).view(np.int64)


def walk(label: np.ndarray, ids: np.ndarray, crowd: int, short: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(kind, node, tree, id, depth, texts under the node) of a sorted range of rows (tree byte, label bytes).

    Kind 0: the shortest prefix that at most ``crowd`` texts share, or the whole label.  Where the range begins and
    ends inside such a node others may share it: these texts, at most twice ``crowd`` unless their labels are equal,
    are told at all depths as kind 1, and the range's outermost nodes at all depths as kind 2.
    """
    n = len(label)
    same = np.cumprod(label[1:] == label[:-1], axis=1, dtype=np.uint8).sum(1) if n > 1 else np.zeros(0, np.int64)
    left, tree = np.arange(n), label[:, 0]
    open_ended, under = np.zeros(n, bool), {}
    for depth in range(short, DEPTH + 1):
        node = np.concatenate([[0], np.cumsum(same <= depth)])
        size = np.bincount(node)
        under[depth] = size[node]
        outer = np.unique(node[[0, -1]])
        first = np.searchsorted(node, outer)
        yield 2, _prefix_hash(label[first], depth), tree[first], ids[first], depth, size[outer]
        fits = (size[node[left]] <= crowd) | (depth == DEPTH)
        told, left = left[fits], left[~fits]
        at_edge = np.isin(node[told], outer)
        open_ended[told[at_edge]] = True
        told = told[~at_edge]
        if depth == short:
            told = told[size[node[told]] > 1]
        if len(told):
            yield 0, _prefix_hash(label[told], depth), tree[told], ids[told], depth, size[node[told]]
    at = np.flatnonzero(open_ended)
    for depth in range(short, DEPTH + 1) if len(at) else ():
        yield 1, _prefix_hash(label[at], depth), tree[at], ids[at], depth, under[depth][at]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (tree byte, label bytes) and ids of batches (tree, label, id)."""
    for batch in batches:
        if batch.num_rows:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, DEPTH)
            yield np.concatenate([batch.column(0).to_numpy().view(np.uint8)[:, None], raw], 1), batch.column(2).to_numpy()


def _by_tree(texts: DataFrame, first: int, trees: int) -> DataFrame:
    """(tree, label, id) of texts (id, labels)."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct((t + first).cast("byte").alias("tree"), F.substring(F.col("labels"), t * DEPTH + 1, F.lit(DEPTH)).alias("label")))
    return texts.select("id", F.inline(cut)).select("tree", "label", "id")


def trie_nodes(texts: DataFrame, trees: int, crowd: int, short: int) -> DataFrame:
    """(node, id, depth, n) of texts (id, labels): each text's prefix in each tree, and how many texts have it.

    Texts alone under a prefix of ``short`` minhashes have no row for it.
    """
    n = max(math.ceil(texts.count() * trees / RANGE), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # equal labels are told apart by id, so a crowd of them is dealt over ranges too
    dealt = _by_tree(texts, 0, trees).repartitionByRange(n, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(_labelled(batches))  # a range has about RANGE rows of 25 bytes
        if rows:
            label, ids = (np.concatenate(x) for x in zip(*rows, strict=True))
            for kind, node, tree, told, depth, size in walk(label, ids, crowd, short):
                k = len(node)
                arrays = [pa.array(np.full(k, kind, np.int32)), pa.array(node), pa.array(tree.astype(np.int32)), pa.array(told), pa.array(np.full(k, depth, np.int32)), pa.array(size.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "node", "tree", "id", "depth", "n"])

    told = written(dealt.mapInArrow(run, "kind int, node long, tree int, id long, depth int, n long"))
    inner = told.filter("kind = 0").select("node", "id", "depth", "n")
    # nodes across ranges: the sums of the ranges' outermost nodes are their numbers of texts
    outer = told.filter("kind = 2").groupBy("node").agg(F.sum("n").alias("all"))
    edge = told.filter("kind = 1").join(outer, "node", "left").withColumn("n", F.coalesce("all", "n")).filter((F.col("n") <= crowd) | (F.col("depth") == DEPTH))
    best = edge.groupBy("id", "tree").agg(F.min_by(F.struct("node", "depth", "n"), "depth").alias("b"))
    return inner.unionByName(best.select("b.node", "id", "b.depth", "b.n").filter(f"depth > {short} or n > 1"))


def _prefixes(texts: DataFrame, first: int, trees: int, depth: int) -> DataFrame:
    """(node, id) of texts (id, labels): each text's prefix of one length in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, ids in _labelled(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_prefix_hash(label, depth)), pa.array(ids)], names=["node", "id"])

    return _by_tree(texts, first, trees).mapInArrow(run, "node long, id long")


def forest_nodes(docs: DataFrame, texts: DataFrame, target: float, threshold: float, width: int) -> DataFrame:
    """(node, id): under which trie nodes the texts (id, doc_id, digest, labels) look for others, nodes of one text left out."""
    short, goal = shortest(target, FIRST, threshold), math.log(1 - target)
    nodes = written(trie_nodes(texts.select("id", "labels"), FIRST, CROWD, short))
    more = F.element_at(F.array(*(F.lit(missed(d, 1, threshold) - missed(short, 1, threshold)) for d in range(short, DEPTH + 1))), F.col("depth") - short + 1)
    chance = nodes.groupBy("id").agg((F.sum(more) + missed(short, FIRST, threshold)).alias("missed")).filter(F.col("missed") > goal)
    lacking = written(chance.join(texts.select("id", "doc_id", "digest"), "id"))
    most = lacking.agg(F.max("missed")).first()[0]
    found = nodes.filter("n > 1").select("node", "id")
    if most is None:
        return found
    further = _prefixes(_more_labels(docs, lacking, FIRST, MORE, width), FIRST, MORE, shortest(target, MORE, threshold, most))
    return written(found.unionByName(further))


def _like(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sketches agree in ``least`` of their minhashes."""
    left, right = texts.select(F.col("id").alias("a"), F.col("sketch").alias("la")), texts.select(F.col("id").alias("b"), F.col("sketch").alias("lb"))
    told = pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((x == y).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return told.mapInArrow(run, "a long, b long")


def _apart(members: DataFrame, texts: DataFrame, least: float, threshold: float) -> DataFrame:
    """(a, b): groups with like texts under one node, of members (node, id, root, main, n, rest).

    Texts outside a node's main group meet all of its texts, in blocks: a task holds two blocks and emits at most
    one row for each of their texts.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c, k: F.pmod(F.xxhash64("id", F.lit(k)), blocks(c)).cast("int")
    rows = members.join(texts.select("id", "sketch", "size"), "id")
    one = lambda i, j, left: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(left).alias("left"))
    every = lambda c, f: F.transform(F.sequence(F.lit(0), blocks(c) - 1), f)
    as_left = F.when(F.col("root") != F.col("main"), every("n", lambda j: one(own("rest", 1), j, True)))
    dealt = rows.select("node", "id", "root", "sketch", "size", F.inline(F.concat(F.coalesce(as_left, F.array().cast("array<struct<i:int,j:int,left:boolean>>")), every("rest", lambda i: one(i, own("n", 2), False)))))
    sorted_rows = dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").select("node", "i", "j", "left", "root", "size", "sketch")

    def compared(left: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(x) or not len(y):
            return []
        alike = np.array([(sketch[k] == sketch[y]).mean(1) for k in x]) >= least
        low, high = np.minimum(size[x][:, None], size[y][None, :]), np.maximum(size[x][:, None], size[y][None, :])
        a, b = np.nonzero(alike & (root[x][:, None] != root[y][None, :]) & (low >= threshold * high))
        up: dict[int, int] = {}
        out = []

        def top(v: int) -> int:
            while up.get(v, v) != v:
                v = up[v]
            return v

        for p, q in np.unique(np.stack([root[x][a], root[y][b]], 1), axis=0).tolist():
            s, t = top(p), top(q)
            if s != t:
                up[max(s, t)] = min(s, t)
                out.append((p, q))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            node, i, j, left, root, size = (table[c].to_numpy() for c in ("node", "i", "j", "left", "root", "size"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
            cut = np.flatnonzero((node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            out = [e for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(node)], strict=True) for e in compared(left[a:b], root[a:b], size[a:b], sketch[a:b])]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        key = lambda batch, k: tuple(batch.column(c)[k].as_py() for c in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
                yield done(pa.Table.from_batches(held))
                held = []
            held.append(batch)
        if held:
            yield done(pa.Table.from_batches(held))

    return sorted_rows.mapInArrow(run, "a long, b long")


def candidate_groups(nodes: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, root) for texts (id, sketch, size) that are like some other text under a node (node, id).

    Sets whose sizes differ by more than the threshold can't be that similar, so they aren't compared in blocks.
    """
    least = unlike(threshold)
    shared = written(nodes.groupBy("node").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).filter("least < most").select("node", "least", "n"))
    under = written(spread_join(nodes, shared, ["node"], F.col("id")).select("node", "least", "id"))
    stars = under.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    first = components(written(_like(stars, texts, least)))
    placed = under.join(first, "id", "left").select("node", "id", F.coalesce("root", "id").alias("root"))
    size = placed.groupBy("node", "root").agg(F.count("*").alias("n"))
    main = size.groupBy("node").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("roots")).filter("roots > 1")
    main = written(main.select("node", "main", "n", (F.col("n") - F.col("most")).alias("rest")))
    late = written(_apart(spread_join(placed, main, ["node"], F.col("id")), texts, least, threshold).distinct())
    above = components(late).select(F.col("id").alias("root"), F.col("root").alias("top"))
    ends = late.select(F.col("a").alias("id")).union(late.select("b")).distinct()
    named = first.unionByName(ends.join(first, "id", "left_anti").withColumn("root", F.col("id")))
    return named.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) of members (root, id, block, blocks, shingles binary).

    Rows with n null are the links of a spanning forest; the others say that ``a`` has n links in this task.
    """
    pairs = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(block, k) as i, greatest(block, k) as j))")
    dealt = members.select("root", "id", "block", "shingles", F.inline(pairs))

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        ids, block = table["id"].to_numpy(), table["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        size = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, column = np.unique(flat, return_inverse=True)
        common = np.zeros((len(left), len(right)), np.float64)
        place = np.zeros(len(sets), np.int64)
        place[left] = np.arange(len(left))
        other = np.zeros(len(sets), np.int64)
        other[right] = np.arange(len(right))
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        cuts = np.searchsorted(column, np.arange(0, column[-1] + COLUMNS + 1, COLUMNS))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[owner[a:b], column[a:b] - k * COLUMNS] = 1
            common += has[left] @ has[right].T
        joint = size[left][:, None] + size[right][None, :] - common
        linked = common >= threshold * joint - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        n = linked.sum(1)
        a, b, count = [ids[left]], [ids[left]], [n]
        if i != j:
            a, b, count = [*a, ids[right]], [*b, ids[right]], [*count, linked.sum(0)]
        forest = _forest(linked, left, right)
        a, b = np.concatenate([*a, ids[forest[:, 0]]]), np.concatenate([*b, ids[forest[:, 1]]])
        counts = pa.array([*np.concatenate(count).tolist(), *[None] * len(forest)], pa.int64())
        return pa.table({"a": a, "b": b, "n": counts})

    return dealt.groupBy("root", "i", "j").applyInArrow(run, "a long, b long, n long")


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A star for each component of a block pair's links: its first text with each other one."""
    rows = {int(x): k for k, x in enumerate(left)}
    cols = {int(x): k for k, x in enumerate(right)}
    unseen, out = set(rows) | set(cols), []
    while unseen:
        todo = [min(unseen)]
        first = todo[0]
        unseen.discard(first)
        while todo:
            x = todo.pop()
            near: set[int] = set()
            if x in rows:
                near.update(right[np.flatnonzero(linked[rows[x]])].tolist())
            if x in cols:
                near.update(left[np.flatnonzero(linked[:, cols[x]])].tolist())
            near &= unseen
            unseen -= near
            todo.extend(near)
            out.extend((first, y) for y in near)
    return np.array(out, np.int64).reshape(-1, 2)


def _shingled(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (doc_id, digest, ...) with the shingles of the document that has this digest."""
    rows = wanted.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    keep = [c for c in wanted.columns if c not in ("doc_id", "digest")]
    rows = rows.select("digest", "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 1):
            words = Words(texts)
            right = [text_digest(t) == d for t, d in zip(texts, batch.column(0).to_pylist(), strict=True)]
            sets = [shingles(words.hashes[a:b], width).tobytes() for a, b in zip(words.first, words.first[1:], strict=False)]
            out = pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sets, pa.binary())], names=[*keep, "shingles"])
            yield out.filter(pa.array(right))

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[2:])
    return rows.mapInArrow(run, f"{types}, shingles binary")


def _classified(docs: DataFrame, width: int, threshold: float, target: float) -> DataFrame:
    """(doc_id, raw, root, n_links, n_copies) for each row of docs, written; root is null for rows without an id or words."""
    with swept(docs.sparkSession) as keep:
        signed = written(signatures(docs, FIRST, width).withColumn("row", F.monotonically_increasing_id()))
        known = signed.filter("doc_id is not null and digest is not null")
        texts = written(known.groupBy("digest").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("labels").alias("labels"), F.first("size").alias("size")))
        with swept(docs.sparkSession) as keep_groups:
            nodes = forest_nodes(docs, texts, target, threshold, width)
            groups = keep_groups(written(candidate_groups(nodes, texts.select("id", F.substring("labels", 1, SKETCH).alias("sketch"), "size"), threshold)))
        sizes = written(groups.groupBy("root").agg(F.count("*").alias("n")))
        placed = spread_join(groups, sizes, ["root"], F.col("id")).join(texts.select("id", "doc_id", "digest"), "id")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        placed = placed.select("doc_id", "digest", "id", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
        members = _shingled(docs, placed, width).dropDuplicates(["id"])
        checked = written(_verified(members, threshold))
        links = checked.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
        classes = components(checked.filter("n is null").select("a", "b"))
        told = texts.select("id", "digest", "n_copies").join(classes, "id", "left").join(links, "id", "left")
        told = told.select("digest", F.col("n_copies").alias("n"), F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        rows = spread_join(known.select("doc_id", "raw", "digest", "row"), written(told), ["digest"], F.col("row"))
        out = rows.select("doc_id", "raw", "root", "n_links", F.col("n").alias("n_copies"))
        alone = signed.filter("doc_id is null or digest is null")
        alone = alone.select("doc_id", "raw", F.lit(None).cast("long").alias("root"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
        return keep(written(out.unionByName(alone)))


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for each row of ``docs`` (doc_id, text); a class is named by its least id."""
    rows = _classified(docs, width, threshold, target)
    first = written(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")))
    told = spread_join(rows.filter("root is not null"), first, ["root"], F.xxhash64("doc_id", "raw")).select("doc_id", "class_id", "n_links", "n_copies")
    return told.unionByName(rows.filter("root is null").select("doc_id", F.col("doc_id").alias("class_id"), "n_links", "n_copies"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, of those with the least id; of repeated rows without words one, and all rows without an id."""
    rows = _classified(docs.select("doc_id", "text"), WIDTH, THRESHOLD, RECALL).filter("doc_id is not null")
    key = F.struct("doc_id", "raw")
    classes = rows.groupBy(F.coalesce("root", F.lit(-1)), F.when(F.col("root").isNull(), key)).agg(F.min(key).alias("key"))
    kept = classes.select("key.doc_id", F.col("key.raw").alias("raw"))
    same = packed(docs, "doc_id", "text").select("doc_id", raw_hash().alias("raw"), "__row").join(kept, ["doc_id", "raw"])
    first = F.row_number().over(Window.partitionBy("doc_id", "raw").orderBy("raw"))
    one = same.withColumn("first", first).filter("first = 1").select("__row.*")
    return one.unionByName(docs.filter("doc_id is null"))
