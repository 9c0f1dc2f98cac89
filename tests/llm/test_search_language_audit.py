"""Lexical search, language identification and the filter audit against brute force, and their defined cases."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrail.llm import filter_audit as fa
from geotrail.llm import language_id as li
from geotrail.llm import lexical_search as ls
from geotrail.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_search", "op13_audit"])
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF), db.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(cols).collect()), key=str) == sorted(want.project(", ".join(cols)).fetchall(), key=str)


# --- search


def plain_terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_rank(docs, items, k):
    bags = [(doc, plain_terms(text)) for doc, text in docs]
    n_docs, length = sum(bool(t) for _, t in bags), sum(len(t) for _, t in bags)
    df = Counter(t for _, words in bags for t in set(words))
    own = {}
    for item, text in items:
        if item is not None:
            own.setdefault(item, []).extend(plain_terms(text))
    out = []
    for item, words in own.items():
        scored = []
        for doc, bag in bags:
            if doc is None:
                continue
            tf, m = Counter(bag), 100 - 75 + (75 * len(bag) * n_docs // length if length else 0)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words if tf[t])
            if score > 0:
                scored.append((-score, doc))
        out += [(item, r, doc, -score) for r, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


DOCS = [
    (1, "Alpha beta, BETA! gamma"), (2, "alpha"), (3, None), (4, ""), (5, "Äpfel äpfel ÄPFEL x1"), (6, "alpha"), (6, "alpha"), (6, "delta beta"), (None, "alpha beta epsilon"),
    (7, "zeta " * 40000 + "beta"), (8, "İx beta gamma"), (-9, "alpha"),
]
ITEMS = [(10, "ALPHA beta beta"), (11, None), (12, "Äpfel X1"), (10, "gamma zeta"), (None, "alpha"), (13, "nowhere"), (14, "beta gamma İx")]


def test_search_defined_cases(spark):
    docs = spark.createDataFrame([(*d, 5, "r") for d in DOCS], "doc_id long, text string, score int, rank string")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    for k, block in ((10, ls.BLOCK), (2, 3)):
        assert sorted(map(tuple, ls.rank(docs, items, k, block).collect())) == plain_rank(DOCS, ITEMS, k)
    assert ls.rank(docs.limit(0), items).count() == 0 == ls.rank(docs, items.limit(0)).count()
    assert ls.rank(docs.filter("text = ''"), items).count() == 0


def test_heaps_keep_the_best_in_any_order():
    rng = np.random.default_rng(3)
    docs, scores = rng.permutation(5000), rng.integers(0, 40, (5000, 7))
    for step in (1, 64, 5000):
        heaps = ls.Heaps(7, 10)
        for at in range(0, 5000, step):
            heaps.offer(docs[at : at + step], scores[at : at + step])
        for item in range(7):
            want = sorted((-s, d) for s, d in zip(scores[:, item].tolist(), docs.tolist(), strict=True) if s)[:10]
            assert sorted((-s, -d) for s, d in heaps.heaps[item]) == want


def test_search_many_copies(spark):
    docs = [(k, "same words here" if k % 3 == 0 else f"word{k % 50} here") for k in range(3000)]
    items = [(k, f"word{k} same") for k in range(60)]
    got = ls.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == plain_rank(docs, items, 10)


# --- language


def plain_counts(text):
    kept = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    if not kept.strip():
        return Counter()
    kept = " " + " ".join(kept.split()) + " "
    return Counter(g for n in (1, 2, 3) for k in range(len(kept) - n + 1) if (g := kept[k : k + n]) != " ")


def number(gram):
    out = 0
    for c in gram:
        out = out << 21 | (ord(c) + 1)
    return out


def test_gram_counts(monkeypatch):
    texts = ["", "1 2 --", "a", "Ab--cD9e", "Größe, ÉTÉ\n\tñu", "İstanbul \U0001d400x", "x" * 50 + " " * 9 + "y"]
    for piece in (li.PIECE, 1, 2, 7):
        monkeypatch.setattr(li, "PIECE", piece)
        for text in texts:
            grams, counts = li.gram_counts(text)
            assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {number(g): n for g, n in plain_counts(text).items()}, (piece, text)
            assert (np.diff(grams) > 0).all()


def test_marks_belong_to_letters():
    assert len(li.gram_counts("कि")[0]) and not len(li.gram_counts("ि 12")[0])


def test_predictions_equal_plain_profiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    total = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            total.setdefault(r.lang, Counter()).update(plain_counts(r.text))
    ranked = lambda c: [g for _, _, g in sorted((-n, number(g), g) for g, n in c.items())[: li.KEPT]]
    places = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in total.items()}
    got = {r.doc_id: r for r in QUERIES["op12_language"](spark, SF).collect()}
    right = tested = 0
    for r in rows:
        own = ranked(plain_counts(r.text))
        away = {lang: sum(abs(p[g] - k) if g in p else li.KEPT for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(away), key=away.get)
        told = got[r.doc_id]
        assert told.lang_pred == (best if own else "und") and told.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert math.isclose(told.score, 1 - away[best] / (li.KEPT * len(own)) if own else 0, abs_tol=1e-6)
        tested, right = tested + told.held_out, right + (told.held_out and told.lang_pred == r.lang)
    assert tested > 20 and right / tested > 0.97


def test_language_defined_cases(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "der hut und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "123 --", None), (None, "die katze", None), (1, "the cat and the hat", "en")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    told = li.predict(docs, li.learn(docs)).collect()
    assert [(r.doc_id, r.lang_pred) for r in told] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de"), (1, "en")]
    assert all(0 <= r.score <= 1 for r in told) and told[0].score == told[6].score
    nothing = li.learn(docs.limit(0))
    assert {r.lang_pred for r in li.predict(docs, nothing).collect()} == {"und"} and li.predict(docs.limit(0), nothing).count() == 0
    assert [r.h for r in docs.select(li.held_out().alias("h")).collect()] == [bool(i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows]


def test_language_sums_are_handed_out(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"wort{chr(97 + k % 26)} {chr(97 + k // 26)}abc", "de" if k % 2 else "en") for k in range(200)], "doc_id long, text string, lang string")
    whole = li.learn(docs)
    monkeypatch.setattr(li, "HELD", 20)
    parts = li.learn(docs.repartition(5))
    assert whole.languages == parts.languages and (whole.grams == parts.grams).all() and (whole.ranks == parts.ranks).all()


def test_very_long_text(spark):
    long = "und die katze " * 120000
    docs = spark.createDataFrame([(1, "der hut und die katze", "de"), (2, "the cat and the hat", "en"), (3, long, None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in li.predict(docs, li.learn(docs)).collect()] == ["de", "en", "de"]


# --- audit


def plain_audit(rows, labels):
    """rows: (doc_id, lang, text); labels: (doc_id, quality, toxic)."""
    fails = []
    for doc, lang, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        f["E"] = doc is not None and any(d is not None and d < doc and (t or "") == text for d, _, t in rows)
        known = [x for x in labels if doc is not None and x[0] == doc]
        fails.append((lang or "", {c for c in f if f[c]}, any(x[1] == 1 for x in known), any(x[2] == 1 for x in known)))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, c in enumerate(order):
                gone = [x for x in own if c in x[0] and not x[0] & set(order[:k])]
                shapley[c] += len(gone)
                out[part, order, k + 1] = [
                    sum(not x[0] & set(order[: k + 1]) for x in own), len(gone), sum(c in x[0] and bool(x[0] & set(order[:k])) for x in own), sum(x[0] == {c} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone),
                ]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


AUDITED = [
    (9, "en", "same text"), (4, "de", "same text"), (7, None, "same text"), (2, "en", "same text"), (2, "de", "same text"), (2, "en", "same text"), (5, "en", None), (3, "en", ""), (8, "", "A B C"),
    (None, "en", "same text"), (None, None, "x # y"), (1, "fr", " ".join(f"w{k}" for k in range(100))), (6, "fr", " ".join(f"w{k % 79}" for k in range(99)) + " z"), (10, "fr", "É" * 9 + "Q"), (11, "fr", "É" * 8 + "QQ"), (12, "fr", "w " * 70000),
]
LABELS = [(2, 1, 0), (4, 1, 1), (4, 0, 0), (9, 1, 0), (7, None, 1), (None, 1, 1), (8, 0, 1)]


def told_by(report):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in report.collect()}


@pytest.mark.parametrize("order", [1, -1])
def test_audit_takes_back(spark, tmp_path, order):
    """A file a micro-batch, with lesser ids coming later; a second run goes on with new files only."""
    rows = AUDITED[::order]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    write = lambda some: [spark.createDataFrame([(*r, 1) for r in some[k : k + 3]], "doc_id long, lang string, text string, mask int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in") for k in range(0, len(some), 3)]
    write(rows[:9])
    home, stream = f"{tmp_path}/home", lambda: fa.file_stream(spark, f"{tmp_path}/in", 100)
    assert told_by(fa.audit(stream(), labels, home)) == plain_audit(rows[:9], LABELS)
    write(rows[9:])
    assert told_by(fa.audit(stream(), labels, home)) == plain_audit(rows, LABELS)
    assert len(list((tmp_path / "home/counters").glob("batch=*"))) > 5


def test_audit_of_copies_and_of_nothing(spark, tmp_path, monkeypatch):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = [(k, "en" if k % 4 else "de", "copied" if k % 3 else f"own {k}") for k in range(300, 0, -1)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(6).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(fa, "HELD", 10)  # tasks hand out what they hold
    assert told_by(fa.audit(fa.file_stream(spark, f"{tmp_path}/in", 2), labels)) == plain_audit(rows, LABELS)
    spark.createDataFrame([], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/none")
    assert fa.audit(fa.file_stream(spark, f"{tmp_path}/none"), labels).count() == 0


def test_changes_are_few_for_many_copies(spark):
    rows = spark.range(20000).select(F.lit(b"k" * 32).alias("digest"), F.col("id").alias("doc_id"), F.lit("en").alias("part"), F.lit(1).alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    told = fa.summed(rows.repartition(4)).collect()
    assert len(told) == 4 and sum(r.least + r.rest for r in told) == 20000
