"""Substring dedup of repeated ids, of words whose plain polynomial hashes are equal, of long and repetitive texts; factors."""

import hashlib
import random

import numpy as np
import pytest

from geotrail.llm import grams, rlz_dedup, shared, suffix_dedup


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def plain_words(rows, n=13):
    """(n_words, n_removed, digest) of (doc_id, text) rows."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if doc is not None and first[tuple(w[k : k + n])] < doc:
                gone[k : k + n] = [True] * n
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def told_words(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3)
    kept = rlz_dedup.digest(rlz_dedup.remove(df, rlz_dedup.duplicate_spans(df))).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in kept), key=str)


def prose(rng, k, of=200):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(k))


def test_rows_of_one_id_keep_their_own_spans(spark):
    rng = random.Random(1)
    a, b, c = prose(rng, 200), prose(rng, 200), prose(rng, 90)
    rows = [(1, a), (2, a), (2, b), (3, b + " " + c), (3, c), (4, c), (4, c), (None, a), (5, None)]
    assert told_words(spark, rows) == plain_words(rows)
    sizes = {(r[0], r[1]): r[2] for r in told_words(spark, rows)}
    assert sizes[2, 200] in (0, 200) and sum(r[2] for r in told_words(spark, rows) if r[0] == 2) == 200


def test_words_with_equal_polynomials(spark):
    rng = random.Random(2)
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    raw = f"{one} {two}".encode()
    at, to = np.array([0, 2049]), np.array([2048, 4097])
    values = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    assert len(set(grams._ranges(values, at, to).tolist())) == 1 and len(set(grams.word_hashes(raw, at, to).tolist())) == 2
    for size in (64, 512, 1024, 1016, 4096):
        a, b = thue_morse(size), thue_morse(size, "b", "a")
        assert len(set(grams.Words([f"{a} {b} {a}x {a}".encode()]).hashes.tolist())) == 3
    head, tail = prose(rng, 8), prose(rng, 8)
    rows = [(1, f"{head} {one} {tail}"), (2, f"{head} {two} {tail}"), (3, f"{head} {one} {tail}")]
    assert told_words(spark, rows) == plain_words(rows) and [r[2] for r in told_words(spark, rows)] == [0, 0, 17]


def test_word_hashes_tell_lengths_and_zeros_apart():
    words = [b"a" * k for k in range(1, 40)] + [b"a" * k + b"\0" for k in range(1, 20)] + [b"\0" * k for k in range(1, 20)] + [b"q" * 1024, b"q" * 1025, b"q" * 5000]
    assert len(set(grams.Words([b" ".join(words)]).hashes.tolist())) == len(words)


def test_a_wrong_hash_is_found_by_comparing_words(monkeypatch):
    monkeypatch.setattr(grams, "word_hashes", lambda flat, starts, ends: np.array([len(flat[a:b].strip(b"xy")) for a, b in zip(starts, ends, strict=True)], np.uint64))
    block = rlz_dedup.Block([b" ".join(b"a" * k for k in range(1, 31))])
    run = [b"a" * k for k in range(1, 31)]
    run[20] += b"x"
    factors, found, lacking, _ = rlz_dedup.parse(grams.Words([b" ".join(run)]), block)
    assert factors == [(0, 20)] and not found and lacking == list(range(8, 18))


@pytest.mark.parametrize("seed", range(6))
def test_factors_are_greedy_apart_and_complete(seed):
    rng = random.Random(seed)
    of = [3, 40, 400][seed % 3]
    source = [prose(rng, 300, of).encode(), b"For " * 80, prose(rng, 60, of).encode()]
    block = rlz_dedup.Block(source)
    pieces = []
    for _ in range(12):
        words = rng.choice(source).split()
        a = rng.randrange(len(words))
        pieces += words[a : a + rng.randint(5, 60)] + ([b"new"] if rng.random() < 0.5 else [])
    runs = [b" ".join(pieces), b"For " * 50, b"", b" ".join(pieces[:14]), prose(rng, 12, of).encode()]
    words = grams.Words(runs)
    factors, found, lacking, lookups = rlz_dedup.parse(words, block)
    held = {tuple(w[k : k + 13]) for w in (t.split() for t in source) for k in range(len(w) - 12)}
    want, all_windows = set(), 0
    for k, t in enumerate(runs):
        w = t.split()
        all_windows += max(0, len(w) - 12)
        want |= {words.first[k] + i for i in range(len(w) - 12) if tuple(w[i : i + 13]) in held}
    got = {k for a, b in factors for k in range(a, b - 12)}
    assert got.isdisjoint(found) and got | set(found) == want
    assert len(lacking) == len(set(lacking)) and set(lacking) == {f + i for f, t in zip(words.first, runs, strict=False) for i in range(len(t.split()) - 12)} - want
    assert all(b <= c for (_, b), (c, _) in zip(factors, factors[1:], strict=False))
    joined = [b" " + b" ".join(t.split()) + b" " for t in source]
    ends = {int(e) for e in words.first}
    for a, b in factors:  # as long as can be
        assert any(b" " + words.text(a, b) + b" " in t for t in joined)
        assert b in ends or not any(b" " + words.text(a, b + 1) + b" " in t for t in joined)
    copied = grams.Words([source[0]])
    assert rlz_dedup.parse(copied, block)[3] == 1 and lookups <= all_windows


def test_repetitive_blocks_are_sorted_once():
    block = rlz_dedup.Block([b"a " * 20000 + b"b " * 20000])
    factors, found, _, lookups = rlz_dedup.parse(grams.Words([b"a " * 15000 + b"b " * 900 + b"c " + b"b " * 25000]), block)
    assert factors == [(0, 15900), (15901, 35901), (35901, 40901)] and len(found) == 12 and lookups < 100


def plain_bytes(rows, n=400):
    raw = [(t or "").encode() for _, t in rows]
    seen, twice = set(), set()
    for (doc, _), r in zip(rows, raw, strict=True):
        for k in range(len(r) - n + 1 if doc is not None else 0):
            (twice if r[k : k + n] in seen else seen).add(r[k : k + n])
    out = []
    for (doc, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - n + 1 if doc is not None else 0):
            if r[k : k + n] in twice:
                gone[k : k + n] = True
        kept = np.frombuffer(r, np.uint8)[~gone[:-1]].tobytes()
        out.append((doc, len(r), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8)) > 0) + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def told_bytes(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3)
    kept = suffix_dedup.digest(suffix_dedup.remove(df, suffix_dedup.duplicate_spans(df))).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in kept), key=str)


@pytest.mark.parametrize("hot", [20000, 2])
def test_bytes_of_rows_of_one_id(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(3)
    a, b, c = prose(rng, 300), prose(rng, 300), prose(rng, 200)
    d, e = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, a), (2, a), (2, b), (3, c + b[:500]), (4, c), (4, c), (None, a), (5, None), (6, f"{d} {prose(rng, 30)}"), (7, f"{e} {prose(rng, 30)}")]
    assert told_bytes(spark, rows) == plain_bytes(rows)
    assert sum(r[2] for r in told_bytes(spark, rows) if r[0] == 2) < len(a) + 700


def test_long_texts_and_dealt_joins(spark, monkeypatch):
    """Texts of over a megabyte, and every join with its limits lowered."""
    for module in (rlz_dedup, suffix_dedup):
        monkeypatch.setattr(module, "spread_join", lambda rows, keyed, keys, by: shared.spread_join(rows, keyed, keys, by, most=16, least=1))
    monkeypatch.setattr(rlz_dedup, "SALT", 20)
    rng = random.Random(4)
    passage = prose(rng, 150)
    rows = [(k, f"{prose(rng, 20)} {passage if k % 2 else ''} {prose(rng, 20)}") for k in range(30)]
    rows += [(40, prose(rng, 230_000, 5000) + " " + passage), (41, prose(rng, 100_000, 5000)), (42, passage[:700])]
    assert len(rows[30][1]) > 1 << 20
    assert told_words(spark, rows) == plain_words(rows)
    assert told_bytes(spark, rows) == plain_bytes(rows)
