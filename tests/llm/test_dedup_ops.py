import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from geotrail.llm import lsh_forest, rlz_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


def planted(seed=1, n=60, size=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k))
    shared = [prose(rng.randint(60, 120)) for _ in range(4)]
    texts = [None, "", " ", "word", "For " * 900, "x" + "For " * 300 + "y", "For For " + "ab " * 140 + "z", "ab " * 140 + "q", "For " * 101]
    for k in range(n):
        t = prose(rng.randint(5, size))
        if k % 3 == 0:
            w = t.split()
            at = rng.randint(0, len(w))
            t = " ".join(w[:at] + [rng.choice(shared)] + w[at:])
        if k % 7 == 0:
            t += "\n" + t[len(t) // 3 :] + " é 🙂"
        texts.append(t)
    texts += texts[20:26] + [prose(5) + " " + shared[0] * 3]
    for k in range(12):  # near copies
        w = texts[30].split()
        w[rng.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    hot = texts[31].split()[:120]
    for k in range(40):  # one passage among many different texts
        texts.append(prose(10) + " " + " ".join(hot) + " " + prose(10))
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i * 3, t, "own") for i, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, spans string").repartition(5)


def brute_bytes(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + length, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(r)]
        spans = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    texts = planted()
    df = frame(spark, texts)
    got = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.remove(df, suffix_dedup.duplicate_spans(df))).collect()}
    for i, want in enumerate(brute_bytes(texts)):
        r = got[i * 3]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, want, r)
    assert len(got) == len(texts) + 1 and sum(r.n_removed > 0 for r in got.values()) > 40
    assert suffix_dedup.duplicate_spans(df.limit(0)).count() == 0
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    again = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.remove(df, suffix_dedup.duplicate_spans(df))).collect()}
    assert again == got


def test_suffix_merge_and_groups():
    rng = random.Random(4)
    strings = sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 30))) for _ in range(300))
    runs = [strings[k::7] for k in range(7)]
    coded = [iter([(suffix_dedup.common_prefix(a, b), b, (k,)) for a, b in zip([b"", *r], r)]) for k, r in enumerate(runs)]
    got = list(suffix_dedup.merge(coded))
    assert [g[1] for g in got] == strings
    assert all(g[0] == suffix_dedup.common_prefix(a, g[1]) for a, g in zip([b"", *strings], got))
    base = bytes(rng.choices(b"abcdefgh", k=1200))
    group = []
    for k in range(40):
        text = bytearray(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(1200)] = 33
        lo, hi = rng.randint(250, 500), rng.randint(500, 600)
        group.append((bytes(text)[600 : hi + 400], bytes(text)[lo:600][::-1], k, 600, lo, hi))
    group.sort()
    group = [(suffix_dedup.common_prefix(a[0], b[0]), *b) for a, b in zip([(b"",), *group], group)]

    def covered():
        out = defaultdict(set)
        for doc, a, b in suffix_dedup.duplicates_of(group):
            out[doc].update(range(a, b))
        return out

    few = suffix_dedup.FEW
    try:
        suffix_dedup.FEW = 1000
        pairs = covered()
        suffix_dedup.FEW = 2
        assert covered() == pairs and pairs
    finally:
        suffix_dedup.FEW = few


def brute_words(texts, ids, n=13):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in sorted(zip(ids, words), key=lambda x: x[0]):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, w in zip(ids, words):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def test_rlz_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rlz_dedup, "SALT", 20)
    texts = planted(2)
    random.Random(5).shuffle(texts)
    df = frame(spark, texts)
    got = {r.doc_id: r for r in rlz_dedup.digest(rlz_dedup.remove(df, rlz_dedup.duplicate_spans(df))).collect()}
    for i, want in enumerate(brute_words(texts, range(len(texts)))):
        r = got[i * 3]
        assert (r.n_words, r.n_removed, r.kept_sha256) == want, (i, want, r)
    assert len(got) == len(texts) + 1
    assert rlz_dedup.duplicate_spans(df.limit(0)).count() == 0


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    words = [tuple((t or "").split()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(set)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
                if words[i] != words[j]:
                    links[i].add(words[j])
                    links[j].add(words[i])
    return [root(i) for i in range(len(texts))], [len(links[i]) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    texts = planted(3)
    rng = random.Random(8)
    for base in (40, 44, 50):
        for changes in (1, 2, 4, 8, 12, 30):
            w = texts[base].split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"w{rng.random()}"
            texts.append(" ".join(w))
    for k in range(60):
        w = texts[45].split() * 2
        w[rng.randrange(len(w))] = f"v{k}"
        texts.append(" ".join(w))
    monkeypatch.setattr(lsh_forest, "BLOCK", 16)
    df = frame(spark, texts)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(df).collect()}
    classes, links = brute_classes(texts)
    assert len(got) == len(texts) + 1
    for i in range(len(texts)):
        assert got[i * 3].class_id == classes[i] * 3 and got[i * 3].n_links == links[i], (i, classes[i], links[i], got[i * 3])
    kept = sorted(r.doc_id for r in lsh_forest.deduplicate(df).filter("doc_id is not null").collect())
    assert kept == sorted({3 * c for c in classes})
    assert lsh_forest.near_duplicates(df.limit(0)).count() == 0


def test_forest_walk_tells_ranges_together():
    """Sorted labels cut at any places give the nodes of the whole trie."""
    rng = np.random.default_rng(2)
    label = np.concatenate([np.zeros((900, 1), np.uint8), rng.integers(0, 2, (900, 16)).astype(np.uint8)], 1)
    label[:300, 1:14] = 1  # a crowd
    label[:60] = 1
    label[:60, 0] = 0
    label = label[np.lexsort(label.T[::-1])]
    ids = np.arange(900)
    for crowd in (1, 5, 40):
        for cuts in ([0, 900], [0, 1, 450, 460, 899, 900], list(range(0, 901, 90))):
            told, outer, edge = {}, Counter(), defaultdict(list)
            for a, b in zip(cuts, cuts[1:]):
                for kind, node, tree, who, depth, size in lsh_forest.walk(label[a:b], ids[a:b], crowd, 4):
                    for x, i, n in zip(node.tolist(), who.tolist(), size.tolist()):
                        if kind == 0:
                            told[i] = depth
                        elif kind == 1:
                            edge[i].append((depth, x, n))
                        else:
                            outer[x] += n
            for i, chain in edge.items():
                assert i not in told
                told[i] = min(d for d, x, n in chain if outer.get(x, n) <= crowd or d == 16)
            for i in range(900):
                under = lambda d: int((label[:, : d + 1] == label[i, : d + 1]).all(1).sum())
                want = next((d for d in range(4, 17) if under(d) <= crowd), 16)
                assert told.get(i, 4) == want and (i in told or under(4) == 1), (crowd, cuts, i)


def test_forest_recall(spark):
    """Pairs at similarities of 0.80 to 0.85, and a crowd around the threshold: what the forest joins, and what it should."""
    rng = random.Random(11)
    texts = []
    for k in range(150):
        w = [f"{k}x{rng.random()}" for _ in range(240)]
        texts += [" ".join(w), " ".join(w[: -rng.randint(34, 43)] + [f"{rng.random()}" for _ in range(rng.randint(2, 4))])]
    crowd = [f"c{k}" for k in range(200)]
    for k in range(400):  # a crowd under the threshold, and some over it
        texts.append(" ".join(crowd[: rng.randint(120, 200)] + [f"{rng.random()}" for _ in range(rng.randint(0, 30))]))
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    classes, links = brute_classes(texts)
    pairs = [k for k in range(0, 300, 2) if links[k]]
    assert len(pairs) > 140 and sum(got[k].n_links for k in pairs) >= 0.99 * len(pairs)
    assert sum(got[i].n_links for i in got) >= 0.99 * sum(links)
    assert sum(got[i].class_id == classes[i] for i in got) >= 0.99 * len(texts) and sum(links) > 200


def test_forest_recall_of_the_given_tables(spark):
    """Ids divisible by 20 against all rows of the given documents, by brute force over shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(docs).collect()}
    words = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    hit = miss = 0
    for i in sets:
        if i % 20 == 0:
            for j in sets:
                if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12:
                    hit, miss = hit + (got[i].class_id == got[j].class_id), miss + (got[i].class_id != got[j].class_id)
    assert hit and hit >= 0.99 * (hit + miss)
