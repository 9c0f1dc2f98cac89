"""The pipeline's stages and the learned operators against brute force, on odd tables."""

import hashlib
import math
import re
import warnings
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geotrail.llm import mixing, quality, queries, secret_scan
from tests.llm.test_dedup_ops import brute_classes
from tests.llm.test_native_ops import brute_base, brute_counts

SF = "/root/testdata/sf0.001"
OWN = "__p __hashes __places __tokens __text __row __spans __base __counts __quality __words __kept __rows __first __rate id digest node".split()


def odd(spark, docs=None):
    """Documents with null, empty, repeated and very long texts, a null id, and columns with the operators' own names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet") if docs is None else docs
    long = " ".join(f"word{k % 977} and more, of {k}" for k in range(30_000))
    rows = [(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, long, "en", "s", len(long)), (9004, "same text " * 3, "en", "s", 30), (9004, "same text " * 3, "en", "s", 30), (None, "no id " * 80, None, None, 5)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    return more.select("*", *(F.lit(k).alias(c) for k, c in enumerate(OWN)))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def dicts(df):
    return [r.asDict() for r in df.collect()]


def brute_features(t):
    words, chars, symbols, lines, repeats = brute_counts(t)
    upper, marks = len(re.findall("[A-Z]", t or "")), len(re.findall("[!?]", t or ""))
    w, c = max(words, 1), max(chars, 1)
    return {"symbols_per_char": symbols / c, "upper_per_char": upper / c, "marks_per_word": marks / w, "repeats_per_word": repeats / w, "chars_per_word": chars / w, "dup_lines_per_word": lines / w, "words": float(words)}


def brute_kept(t, rules):
    words, _, _, _, repeats = brute_counts(t)
    f = brute_features(t)
    holds = lambda rule: all((f[c.feature] > c.threshold) == c.above for c in rule)
    return not (words < 50 or 100 * repeats > 50 * words or any(map(holds, rules)))


def test_quality_stage(spark):
    docs = odd(spark)
    rules = quality.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = queries.stage_quality(spark, docs, SF)
    assert got.columns == docs.columns
    assert rows_of(got) == sorted((tuple(r) for r in docs.collect() if brute_kept(r.text, rules)), key=str)
    assert queries.stage_quality(spark, docs.limit(0), SF).collect() == []


def brute_learn(rows, cuts):
    """Sequential covering as its docstring says, row by row."""
    names = [n for n in cuts if cuts[n]]
    holds = lambda r, rule: all((r[c.feature] > c.threshold) == c.above for c in rule)
    count = lambda rows: (sum(1 - r["poor"] for r in rows), sum(r["poor"] for r in rows))
    worth = lambda g, p: (p - g) / (p + g) if p + g else -1.0
    rules = []
    while len(rules) < quality.RULES:
        left = [r for r in rows if not any(holds(r, x) for x in rules)]
        rule, scores = [], []
        while len(rule) < quality.CONDITIONS:
            now = [r for r in left if holds(r, rule)]
            good, poor = count([r for r in now if r["grow"]])
            if not good or not poor:
                break
            gain, after = {}, {}
            for n in names:
                for t in cuts[n]:
                    for above in (False, True):
                        c = quality.Condition(n, above, t)
                        g, p = after[c] = count([r for r in now if r["grow"] and (r[n] > t) == above])
                        if p >= quality.COVER:
                            gain[c] = p * (math.log2(p / (g + p)) - math.log2(poor / (good + poor)))
            if not gain or max(gain.values()) <= 0:
                break
            tied = [c for c in gain if gain[c] >= max(gain.values()) * (1 - 1e-9)]
            same = sorted(c.threshold for c in tied if (c.feature, c.above) == (tied[0].feature, tied[0].above))
            rule.append(quality.Condition(tied[0].feature, tied[0].above, same[len(same) // 2]))
            scores.append(count([r for r in left if not r["grow"] and holds(r, rule)]))
            if not after[rule[-1]][0]:
                break
        while len(rule) > 1 and worth(*scores[-2]) >= worth(*scores[-1]):
            rule.pop()
            scores.pop()
        if not rule or scores[-1][1] < max(1, quality.COVER // 3) or scores[-1][1] < quality.PRECISION * sum(scores[-1]):
            break
        rules.append(tuple(rule))
    return rules


def test_quality_list_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    table = quality.labelled(docs, labels, quality.SAMPLE)
    rows = dicts(table)
    names = [c for c in table.columns if c not in ("poor", "grow")]
    assert brute_learn(rows, quality._thresholds(table, names)) == quality.learn(docs, labels) != []
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = sorted(tuple(round(x, 9) for x in brute_features(texts[i.doc_id]).values()) for i in labels.select("doc_id").distinct().collect() if texts.get(i.doc_id) and brute_kept(texts[i.doc_id], []))
    assert sorted(tuple(round(r[n], 9) for n in names) for r in rows) == want


def test_windows_with_few_bits_of_hash(spark, monkeypatch):
    """Hashes that share their high bits, and texts of more windows than places, are told apart all the same."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["a b c d " * 60, " ".join(f"w{k % 7}" for k in range(90))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in (54, 5):  # ten bits of hash; 31 places
        monkeypatch.setattr(quality, "PLACE_BITS", bits)
        monkeypatch.setattr(quality, "PLACES", (1 << bits) - 1)
        got = {r.doc_id: r["__counts"].n_repeat_words for r in quality.measure(df).collect()}
        assert got == {k: brute_counts(t)[4] for k, t in enumerate(texts)}


def test_quality_ties_and_clashes(spark):
    """Rows that tie in every feature: no threshold tells them apart, so there is no rule."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(60))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, labels) == []
    half = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" ##########" * 5))).otherwise(F.col("text")))
    (rule,) = quality.learn(half, labels)
    assert [c.feature for c in rule] == ["symbols_per_char"] and rule[0].above


def test_near_duplicate_stage(spark):
    docs = odd(spark)
    got = queries.stage_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    rows = sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    classes, _ = brute_classes([r.text for r in rows])
    want = sorted(rows[c].doc_id for c in set(classes) if (rows[c].text or "").split())
    empty = sorted(r.doc_id for r in rows if not (r.text or "").split())
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(want + empty) and got.filter("doc_id is null").count() == 1
    assert queries.stage_near_duplicates(spark, docs.limit(0), SF).collect() == []


def test_one_id_with_different_texts_keeps_both(spark):
    prose = lambda s: " ".join(f"{s}{k}" for k in range(80))
    rows = [(1, prose("a")), (1, prose("b")), (2, prose("c")), (3, prose("c")), (3, prose("c"))]
    got = queries.stage_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert rows_of(got) == sorted([(1, prose("a")), (1, prose("b")), (2, prose("c"))], key=str)


def brute_markov(t, model):
    n, out = len(secret_scan.ALPHABET) + 1, []
    known = {(m.start(2), m.end()) for m in re.finditer(r"""(?:(?a:(?i:password|passwd|secret|token|api_?key)))(["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6}
    known |= {(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t)} | {(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", t)}
    for m in re.finditer(secret_scan.TOKEN, t):
        if (m.start(), m.end()) not in known:
            code = [secret_scan.ALPHABET.find(c) + 1 for c in m[0]]
            if sum(round(model[a * n + b], 4) for a, b in zip(code, code[1:])) > secret_scan.MARGIN:
                out.append((m.start(), 3, m.end()))
    return out


@pytest.fixture(scope="module")
def secrets(spark):
    return secret_scan.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_secret_spans_equal_brute_force(spark, secrets):
    docs = odd(spark)
    texts = [r.text or "" for r in docs.select("text").collect()] + [hashlib.sha256(b"x").hexdigest().upper() * 2, "QmFzZTY0IHRleHQgdGhhdCBpcyByYW5kb20 x", "internationalization_of_everything", "token=abcdefgh " * 2000, "é" * 70_000 + " 9fK2mQx7ZpLw4TvB8sRd1NyC " + "ü " * 70_000]
    rows = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")
    got = secret_scan.digest(secret_scan.scan(rows, secrets)).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        want = sorted(brute_base(texts[r.doc_id]) + brute_markov(texts[r.doc_id], secrets))
        assert r.spans == ",".join(f"{secret_scan.ORDER[k]}:{a}:{b}" for a, k, b in want), texts[r.doc_id][:200]
    assert secret_scan.digest(secret_scan.scan(rows.limit(0), secrets)).collect() == []
    assert len(secret_scan.train(rows.limit(0))) == len(secrets)


def test_secret_stage(spark, secrets):
    docs = odd(spark)
    got = queries.stage_secrets(spark, docs, SF)
    assert got.columns == docs.columns
    model = secret_scan.train(docs.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        text, at = "", 0
        for a, _, b in sorted(brute_base(r.text) + brute_markov(r.text or "", model)):
            if b > at:
                text, at = (text if a < at else text + r.text[at:a] + "[SECRET]"), b
        new = r.asDict()
        if r.text is not None:
            new["text"] = text + r.text[at:]
            new["n_chars"] = len(new["text"])
        want.append(tuple(new.values()))
    assert rows_of(got) == sorted(want, key=str)
    assert queries.stage_secrets(spark, docs.limit(0), SF).collect() == []


def brute_posterior(t, model):
    t = t or ""
    share = lambda marks: sum(c in marks for c in t) / max(len(t), 1)
    level = lambda name, x: f"{name} {math.floor(math.log2(x * 64 + 1))}"
    words = re.split(r"[\x20\x09-\x0D]+", t.lower())
    seen = {*words, level("symbols", share("#*$%&|<>")), level("upper", share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), level("marks", share("!?")), level("length", len(t) / 4096)}
    log = np.array(model.prior) + sum((np.array(v) for w, v in model.evidence.items() if w in seen), np.zeros(len(model.domains)))
    p = np.exp(np.maximum(log - log.max(), -60))
    return sum(w != "" for w in words), p / p.sum()


def nnls_residual(a, b):
    """The least |a x - b| over x >= 0, by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(10 * a.shape[1]):
        w = a.T @ (b - a @ x)
        if free.all() or w[~free].max() <= 1e-9 * np.abs(b).max() * np.abs(a).max():
            break
        free[np.argmax(np.where(free, -np.inf, w))] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                break
            bad = free & (s <= 0)
            step = (x[bad] / (x[bad] - s[bad])).min()
            x = x + step * (s - x)
            free &= x > 1e-12
        x = s
    return np.linalg.norm(a @ x - b)


@pytest.mark.parametrize("share", [[0.6, 0.3, 0.1], [0.05, 0.05, 0.9], [0.98, 0.01, 0.01]])
def test_fit_equals_nonnegative_least_squares(spark, share):
    rng = np.random.default_rng(7)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 150), rng.integers(1, 500, 150)
    df = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(t, p))], "doc_id long, __tokens long, __p array<double>")
    targets = [float(t.sum()) * x for x in share]
    fit = mixing.fit(df, targets)
    rate = np.array([r["__rate"] for r in sorted(mixing.mix(df, fit).collect(), key=lambda r: r.doc_id)])
    own = np.linalg.norm((rate * t) @ p - targets)
    assert (rate >= 0).all() and own <= nnls_residual((p * t[:, None]).T, np.array(targets)) + 1e-4 * t.sum() and fit.met()
    assert np.allclose(fit.reached, (rate * t) @ p, rtol=1e-6, atol=1e-6 * t.sum())


def test_targets_out_of_reach_are_told(spark):
    df = spark.createDataFrame([(i, 10, [0.5, 0.5]) for i in range(10)], "doc_id long, __tokens long, __p array<double>")
    with pytest.warns(UserWarning, match="missed"):
        fit = mixing.fit(df, [90.0, 10.0])
    assert not fit.met() and np.allclose(fit.reached, [50, 50])  # the least-squares answer
    high = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 10_000, [0.0, 1.0])], "doc_id long, __tokens long, __p array<double>")
    got = {r.doc_id: r["__copies"] for r in mixing.mix(high, mixing.fit(high, [9000.0, 1001.0])).collect()}
    assert got[0] == 9000 and got[1] in (0, 1)  # a count of copies in one row


def test_op1_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op1_mix(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = mixing.train(docs.select("doc_id", "text"), queries._domains(spark, SF))
    rows = docs.collect()
    assert len(got) == len(rows)
    totals = np.zeros(len(model.domains))
    for r in rows:
        n, p = brute_posterior(r.text, model)
        q = got[r.doc_id]
        assert q.n_tokens == n and abs(q.posterior - p.max()) < 1e-5 and (q.domain == model.domains[int(p.argmax())] or np.ptp(np.sort(p)[-2:]) < 1e-6)
        assert abs(q.copies - q.rate) <= 1 and (q.copies > 0 or q.rate < 1)
        totals += q.rate * n * p
    budget = sum(q.n_tokens for q in got.values())
    assert np.abs(totals - mixing.weights_to_targets(model, queries.WEIGHTS, budget)).max() < 1e-3 * budget


def test_mix_stage(spark):
    docs = odd(spark)
    got = queries.stage_mix(spark, docs, SF)
    assert got.columns == [*docs.columns, "copies"] and got.filter("copies < 1").count() == 0
    twice = [r.copies for r in got.filter("doc_id = 9004").collect()]
    assert len(twice) in (0, 2) and len(set(twice)) <= 1
    told, have = Counter(tuple(r)[:-1] for r in got.collect()), Counter(map(tuple, docs.collect()))
    mixed = queries._mixed(docs.select("doc_id", "text"), mixing.train(docs.select("doc_id", "text"), queries._domains(spark, SF))).collect()
    assert told <= have and sorted((str(r.doc_id), r.copies) for r in got.collect()) == sorted((str(r.doc_id), r["__copies"]) for r in mixed if r["__copies"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert queries.stage_mix(spark, docs.limit(0), SF).collect() == []
    again = queries.stage_mix(spark, got, SF)
    assert again.columns == got.columns  # a column of that name is replaced


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(), special_tokens={})


def _ranks():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe_stage(spark):
    docs = odd(spark).withColumn("copies", F.lit(3).cast("long"))
    got, own = queries.stage_bpe(spark, docs, SF).collect(), encoding()
    want = Counter((r.doc_id, 3, tuple(own.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.copies, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), r.decoded_sha256) for r in got) == want
    assert queries.stage_bpe(spark, docs.limit(0), SF).collect() == []


def test_pipeline(spark, monkeypatch):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    docs, told = spark.read.parquet(f"{SF}/documents.parquet"), []
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, f=corpus_pipeline.written: told.append((df.columns, (out := f(df)).collect())) or out)
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(set(docs.columns) <= set(columns) for columns, _ in told) and len(told) == 4
    assert [len(rows) for _, rows in told] == sorted((len(rows) for _, rows in told), reverse=True)
    assert sorted((r.doc_id, r.copies, r.decoded_sha256) for r in got) == sorted((r.doc_id, r.copies, hashlib.sha256(r.text.encode()).hexdigest()) for r in told[-1][1])


def test_tables_go_when_nothing_reads_them(spark):
    from geotrail.llm import shared

    before = set(shared._FOLDERS)
    with shared.swept(spark) as keep:
        kept, gone = keep(shared.written(spark.range(3))), shared.written(spark.range(4))
    (folder,) = set(shared._FOLDERS) - before
    assert kept.count() == 3 and shared._PATHS[kept] == folder
    with pytest.raises(Exception, match="exist"):
        gone.count()
    shared.forget(kept)
    assert set(shared._FOLDERS) == before
