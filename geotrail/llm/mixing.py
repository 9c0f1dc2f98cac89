"""Mixing sources to target weights by soft membership.

A labelled table trains a classifier (softmax regression on telling words and the text's shape) that gives
every document a posterior over the domains; document rates are then fitted by projected gradient so that the domains'
expected token totals meet their targets.  With p a document's posteriors and t its tokens, the
least-squares step, scaled by the Gram matrix of the domains over the documents whose rate isn't zero,
changes a rate by p . lambda and cuts it at zero.  An iteration is one aggregation of a few sums over all documents; rates are never collected.

All in DataFrame expressions.  The classifier is fitted on a bounded sample of labelled rows
(``sample``, by hash of the id) and a vocabulary of ``words`` words; posteriors, totals and rates cover
every document and whole texts.

Defined cases: a null text is an empty one, of no tokens, whose rate follows its posteriors alike; a
document labelled twice is labelled by its least label; domains without labelled rows get no mass and
their weight goes to the others; without labels all documents keep rate 1 and one domain; equal rows get
equal rates and copies; columns of any other name stay (the operator's own begin with two underscores: rows with
such columns go through ``shared.packed``); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.llm.shared import fixed, forget, written

SPLIT = r"[\x20\x09-\x0D]+"
#: Labelled rows and words to fit on; iterations and the share of a target by which they may miss it.
SAMPLE, WORDS, ITERATIONS, CLOSE = 8000, 160, 25, 1e-6
#: Nats by which a word must speak for a domain; steps and penalty of the regression.
GAIN, STEPS, PENALTY = 8.0, 400, 1e-3
#: Most domains of a model; a model of more raises an error, as an iteration sums a product for each pair of domains.
MOST_DOMAINS = 64


class Model(NamedTuple):
    domains: list[str]
    prior: list[float]
    evidence: dict[str, list[float]]  # word -> weight for each domain


class Fit(NamedTuple):
    """Steps of projected gradient, and the domains' token totals: wanted, and reached after the last step."""

    steps: list[list[float]]
    targets: list[float]
    reached: list[float]

    def met(self) -> bool:
        return max((abs(a - b) for a, b in zip(self.targets, self.reached, strict=True)), default=0.0) <= CLOSE * max(sum(self.targets), 1.0)


def _evidence(text: Column) -> Column:
    """A text's distinct lower-case words, with words for its shape."""
    chars = F.length(text)
    share = lambda marks: (chars - F.length(F.translate(text, marks, ""))) / F.greatest(chars, F.lit(1))
    level = lambda name, c: F.concat(F.lit(f"{name} "), F.floor(F.log2(c * 64 + 1)).cast("string"))
    shape = F.array(level("symbols", share("#*$%&|<>")), level("upper", share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), level("marks", share("!?")), level("length", chars / 4096))
    return F.concat(F.split(F.lower(text), SPLIT, -1), shape)


def _text(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, text_col: str = "text") -> Model:
    """Softmax regression on the words that tell the domains of ``labels`` (doc_id, domain) apart best."""
    known = labels.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", _text(docs, text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` short rows
    rows = written(rows.select("domain", F.array_distinct(_evidence(F.col("text"))).alias("words")))
    size = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if len(size) > MOST_DOMAINS:
        raise ValueError(f"over {MOST_DOMAINS} domains")
    domains = sorted(size)
    if not domains:
        return Model(["all"], [0.0], {})
    whole = sum(size.values())
    counts = rows.select("domain", F.explode("words").alias("word")).filter("word != ''").groupBy("domain", "word").agg(F.count("*").alias("n"))
    counts = counts.withColumn("all", F.sum("n").over(Window.partitionBy("word")))
    n_domain = F.create_map(*(x for d in domains for x in (F.lit(d), F.lit(float(size[d])))))[F.col("domain")]
    inside, outside = (F.col("n") + 0.5) / (n_domain + 1), (F.col("all") - F.col("n") + 0.5) / (F.lit(float(whole)) - n_domain + 1)
    ranked = written(counts.withColumn("gain", F.col("n") * F.log(inside / outside)).filter(F.col("gain") > GAIN).select("domain", "word", "gain"))
    best = lambda d: ranked.filter(F.col("domain") == d).orderBy(F.desc("gain"), "word").limit(max(1, words // len(domains)))
    vocabulary = sorted({r.word for d in domains for r in best(d).collect()})  # at most `words`, each task keeps its own best
    place = F.create_map(*(x for i, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(i)))) if vocabulary else None
    hits = F.transform(F.array_intersect("words", F.array(*(F.lit(w) for w in vocabulary))), lambda w: place[w]) if vocabulary else F.array()
    told = rows.select("domain", hits.alias("hits")).collect()  # at most `sample` rows of at most `words` numbers
    seen, right = np.zeros((len(told), len(vocabulary) + 1)), np.zeros((len(told), len(domains)))
    for i, r in enumerate(told):
        seen[i, [*r.hits, len(vocabulary)]] = 1
        right[i, domains.index(r.domain)] = 1
    weight = _softmax_regression(seen, right)
    forget(rows, ranked)
    return Model(domains, weight[-1].tolist(), {w: weight[i].tolist() for i, w in enumerate(vocabulary)})


def _softmax_regression(seen: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weights of features by class: accelerated gradient descent with a quadratic penalty."""
    n, k = seen.shape
    weight = ahead = np.zeros((k, right.shape[1]))
    pace = 2.0 / max(1.0, float(seen.sum(1).max()))
    for step in range(STEPS):
        log = seen @ ahead
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - pace * (seen.T @ (p - right) / n + PENALTY * ahead)
        ahead = new + step / (step + 3) * (new - weight)
        weight = new
    return np.round(weight, 6)


def posteriors(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``__tokens`` (words of the text) and ``__p`` (array of posteriors, in the model's order)."""
    text, k = _text(df, text_col), len(model.domains)
    df = fixed(df, __words=_evidence(text))
    tokens = (F.size(F.array_remove("__words", "")) - 4).cast("long")
    start = F.array(*(F.lit(x) for x in model.prior))
    if model.evidence:
        table = F.create_map(*(x for w, v in model.evidence.items() for x in (F.lit(w), F.array(*(F.lit(y) for y in v)))))
        hits = F.array_intersect("__words", F.array(*(F.lit(w) for w in model.evidence)))
        log = F.aggregate(hits, start, lambda acc, w: F.zip_with(acc, table[w], lambda a, b: a + b))
    else:
        log = start
    df = fixed(df, __tokens=tokens, __log=log)
    odds = F.transform("__log", lambda x: F.exp(F.greatest(x - F.array_max("__log"), F.lit(-60.0))))
    df = fixed(df, __odds=odds)
    whole = sum((F.col("__odds")[i] for i in range(1, k)), F.col("__odds")[0])
    return fixed(df, __p=F.transform("__odds", lambda x: x / whole)).drop("__words", "__log", "__odds")


def _rate(steps: list[list[float]]) -> Column:
    """A document's rate after the steps, from ``__p``."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col("__p")[j] * x for j, x in enumerate(step[1:], 1)), F.col("__p")[0] * step[0]))
    return rate


def fit(rows: DataFrame, targets: list[float], iterations: int = ITERATIONS) -> Fit:
    """The steps of projected gradient over rows (__tokens, __p); targets are token totals of the domains.

    A step moves every rate against the gradient of the squared misses and cuts it at 0.  Steps are scaled by the curvature over the
    rates above 0, and shortened when the totals get farther off.  Where that doesn't meet the targets in ``iterations``
    steps, as many more go on from the nearest totals so far, each kept only if it comes nearer; where scaled ones don't,
    plain ones by the curvature over all rates do, if they are small enough.  Targets that can't be reached, or
    aren't by then, give a warning; ``reached`` says by how much.
    """
    k = len(targets)
    t, p = F.col("__tokens"), F.col("__p")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    close = CLOSE * max(sum(targets), 1.0)

    def at(steps: list[list[float]]) -> tuple[float, np.ndarray, np.ndarray, list[list[float]]]:
        """The squared miss, the misses, the curvature over the rates above 0, and the steps."""
        told = fixed(rows, __rate=_rate(steps))
        rate, free = F.col("__rate"), (F.col("__rate") > 0).cast("int")
        now = told.agg(*(F.sum(rate * t * p[j]).alias(f"s{j}") for j in range(k)), *(F.sum(free * t * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
        miss, gram = np.array([float(now[f"s{j}"] or 0.0) for j in range(k)]) - np.array(targets), np.zeros((k, k))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = now[f"g{i}_{j}"] or 0.0
        return float(miss @ miss), miss, gram, steps

    def then(here: tuple, step: np.ndarray) -> list[list[float]]:
        return [*here[3], [round(float(x), 12) for x in step]]

    def scaled(here: tuple) -> np.ndarray:
        return np.linalg.pinv(here[2], rcond=1e-9, hermitian=True) @ here[1]

    here = best = at([])
    whole = max(float(np.linalg.eigvalsh(here[2]).max(initial=0.0)), 1e-9)  # all rates are 1 at first
    share, last = 1.0, math.inf
    for _ in range(iterations):
        off = np.abs(here[1]).max(initial=0.0)
        if off <= close:
            break
        share, last = (share / 2 if off > last else min(1.0, share * 1.5)), off
        here = at(then(here, share * scaled(here)))
        best = min(best, here, key=lambda x: x[0])
    share, careful, bold = 1.0, 1.0, True
    for _ in range(iterations):
        if np.abs(best[1]).max(initial=0.0) <= close:
            break
        here = at(then(best, share * scaled(best) if bold else careful * best[1] / whole))
        if here[0] < best[0]:
            best = here
            share, careful, bold = (min(1.0, share * 2), careful, True) if bold else (share, careful * 2, True)
        elif bold:
            share, bold = share / 4, False
        else:
            careful /= 4
    out = Fit(best[3], list(targets), [float(x) for x in best[1] + np.array(targets)])
    if not out.met():
        warnings.warn(f"mixing: targets {[round(x) for x in targets]} missed, reached {[round(x) for x in out.reached]}", stacklevel=2)
    return out


def weights_to_targets(model: Model, weights: dict[str, float], budget: float) -> list[float]:
    """Token totals of the model's domains from weights by domain; weights of unknown domains go to the others."""
    got = [max(0.0, weights.get(d, 0.0)) for d in model.domains]
    whole = sum(got)
    return [budget * (w / whole if whole else 1 / len(got)) for w in got]


def mix(rows: DataFrame, fit: Fit) -> DataFrame:
    """Rows of ``posteriors`` with ``__rate`` and ``__copies``: the rate rounded up or down by a hash of the id and the tokens.

    Copies are a count: nothing is repeated, however high a rate is.
    """
    rate = F.round(_rate(fit.steps), 9)
    rows = fixed(rows, __rate=rate)
    chance = F.pmod(F.xxhash64("doc_id", "__tokens", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("__rate")
    return fixed(rows, __copies=(whole + (chance < F.col("__rate") - whole).cast("int")).cast("long"))
