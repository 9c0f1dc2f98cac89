"""Quality rules: counts, fixed base rules, and decision lists learned by sequential covering.

All in DataFrame expressions: a text's counts are array expressions of its own row, so the corpus is not
shuffled.  ``learn`` grows conjunctions of thresholds from labelled statistics (counts by feature and
bin, one small aggregation a step), prunes them on rows that it did not grow on, and goes on with the
rows that no rule covers yet; ``verdict`` is the ordered conditional expression.

The list is fitted on a bounded sample of labelled rows (``sample``, by hash of the id); counts, base
rules and verdicts cover every row and whole texts.

Defined cases: a null text is an empty one (no words, so the base rules reject it); a document labelled
twice counts as poor if any label says so, null labels are left out; without labels or without a rule
that holds on pruning rows only the base rules decide; equal rows give equal results; columns of any
other name stay.  Windows are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.shared import fixed, forget, written

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
#: Words of a window; bits of a window's place among the numbers that are sorted.
WINDOW, PLACE_BITS = 3, 24
PLACES = (1 << PLACE_BITS) - 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
#: Labelled rows to fit on, bins of a feature, conditions of a rule, rules of a list, and what a rule must reach.
SAMPLE, BINS, CONDITIONS, RULES, PRECISION, COVER = 20_000, 16, 3, 8, 0.95, 10


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float


Rule = tuple[Condition, ...]


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(chars))


def _at(k: Column) -> Column:
    """The place that a number of ``__sorted`` holds in its low bits."""
    return k.bitwiseAND(F.lit(PLACES)).cast("int")


def _prefix(k: Column) -> Column:
    return F.shiftright(k, PLACE_BITS)


def measure(df: DataFrame, text_col: str = "text", out: str = "__counts") -> DataFrame:
    """``df`` with a struct of counts of each whole text.

    Windows are sorted as numbers, the high bits of their hash and their place; where two hashes share only the high
    bits, or places need more bits, pairs of hash and place are sorted instead.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    df = fixed(df, __words=F.array_remove(F.split(text, SPLIT, -1), ""), __lines=lines)
    word = lambda i: F.get("__words", i)
    first = F.slice("__words", 1, F.greatest(F.size("__words") - 2, F.lit(0)))
    df = fixed(df, __hashes=F.transform(first, lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2))))
    df = fixed(df, __sorted=F.sort_array(F.transform("__hashes", lambda h, i: h.bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("long")))))
    near = lambda k: _prefix(F.get("__sorted", k))
    twice = F.filter("__sorted", lambda x, k: (_prefix(x) == near(k - 1)) | (_prefix(x) == near(k + 1)))
    df = fixed(df, __twice=twice)
    hashed = lambda k: F.get("__hashes", _at(k))
    mixed = F.transform("__twice", lambda x, k: (_prefix(x) == _prefix(F.get("__twice", k - 1))) & (hashed(x) != hashed(F.get("__twice", k - 1))))
    pairs = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    own = F.exists(mixed, lambda x: F.coalesce(x, F.lit(False))) | (F.size("__hashes") > PLACES)
    df = fixed(df, __pairs=F.when(own, pairs))
    beside = lambda k: F.get("__pairs", k)["h"]
    exact = F.transform(F.filter("__pairs", lambda x, k: (x["h"] == beside(k - 1)) | (x["h"] == beside(k + 1))), lambda x: x["i"])
    df = fixed(df, __places=F.sort_array(F.when(F.col("__pairs").isNotNull(), exact).otherwise(F.transform("__twice", _at))))
    steps = F.transform("__places", lambda i, k: F.least(F.coalesce(F.get("__places", k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
    counts = {
        "n_words": F.size("__words"), "word_chars": F.length(text) - _count(text, r"[\x20\x09-\x0D]"), "n_symbols": _count(text, "[#*$%&|<>]"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")), "n_repeat_words": F.aggregate(steps, F.lit(0), lambda a, x: a + x),
        "n_upper": _count(text, "[A-Z]"), "n_marks": _count(text, "[!?]"),
    }
    told = fixed(df, **{out: F.struct(*(counts[k].cast("long").alias(k) for k in COUNTS))})
    return told.drop("__words", "__lines", "__hashes", "__sorted", "__twice", "__pairs", "__places")


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def features(c: Column) -> dict[str, Column]:
    """What conditions look at: shares of a text, and its length."""
    words, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
    return {
        "symbols_per_char": c["n_symbols"] / chars, "upper_per_char": c["n_upper"] / chars, "marks_per_word": c["n_marks"] / words,
        "repeats_per_word": c["n_repeat_words"] / words, "chars_per_word": c["word_chars"] / words, "dup_lines_per_word": c["n_dup_lines"] / words,
        "words": c["n_words"].cast("double"),
    }


def _holds(rule: Rule, columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & ((columns[c.feature] > c.threshold) if c.above else (columns[c.feature] <= c.threshold))
    return out


def verdict(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """Number of the first rule that holds, from 1; null when none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_holds(rule, columns), F.lit(k)).otherwise(out)
    return out


def labelled(docs: DataFrame, labels: DataFrame, sample: int, text_col: str = "text") -> DataFrame:
    """Features of at most ``sample`` labelled documents that pass the base rules; poor: 1 or 0, grow: for growing or pruning."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("poor"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = measure(docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id"))  # at most `sample` rows of two numbers
    return rows.filter(~base_failed(F.col("__counts"))).select(
        "poor", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grow"), *(v.alias(k) for k, v in features(F.col("__counts")).items())
    )


def _thresholds(rows: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Midpoints between neighbouring quantiles of either class."""
    at = [k / BINS for k in range(BINS + 1)]
    told = rows.groupBy("poor").agg(*(F.percentile_approx(n, at, 1000).alias(n) for n in names)).collect()
    out = {}
    for n in names:
        seen = sorted({v for r in told for v in (r[n] or [])})
        out[n] = [(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)]
    return out


def _statistics(rows: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> dict:
    """(grow, feature, bin) -> [good, poor]; a bin is the number of thresholds below the value."""
    bins = F.array(*(F.struct(F.lit(n).alias("feature"), sum((F.col(n) > t).cast("int") for t in cuts[n]).alias("bin")) for n in names if cuts[n]))
    told = rows.select("grow", "poor", F.explode(bins).alias("b")).groupBy("grow", "b.feature", "b.bin").agg(F.sum(1 - F.col("poor")).alias("good"), F.sum("poor").alias("poor"))
    return {(r.grow, r.feature, r.bin): (r.good, r.poor) for r in told.collect()}


def _choices(told: dict, names: list[str], cuts: dict[str, list[float]], grow: bool) -> dict[Condition, tuple[int, int]]:
    out = {}
    for n in names:
        each = [told.get((grow, n, b), (0, 0)) for b in range(len(cuts[n]) + 1)]
        whole = [sum(x) for x in zip(*each, strict=True)]
        below = [0, 0]
        for t, x in zip(cuts[n], each, strict=False):
            below = [below[0] + x[0], below[1] + x[1]]
            out[Condition(n, False, t)] = tuple(below)
            out[Condition(n, True, t)] = (whole[0] - below[0], whole[1] - below[1])
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """An ordered list of rules, each of which says that a text is poor."""
    import math

    rows = written(labelled(docs, labels, sample))
    names = [c for c in rows.columns if c not in ("poor", "grow")]
    cuts = _thresholds(rows, names)
    if not any(cuts.values()):
        forget(rows)
        return []
    rules: list[Rule] = []
    column = {n: F.col(n) for n in names}
    while len(rules) < RULES:
        left = rows
        for rule in rules:
            left = left.filter(~_holds(rule, column))
        grown: list[tuple[Condition, int, int]] = []
        while len(grown) < CONDITIONS:
            told = _statistics(left.filter(_holds(tuple(c for c, _, _ in grown), column)), names, cuts)
            choices, held = _choices(told, names, cuts, True), _choices(told, names, cuts, False)
            good, poor = (sum(v[k] for (g, f, _), v in told.items() if g and f == next(n for n in names if cuts[n])) for k in (0, 1))
            if not good or not poor:
                break
            before = math.log2(poor / (good + poor))
            gain = {c: p * (math.log2(p / (g + p)) - before) for c, (g, p) in choices.items() if p >= COVER}
            if not gain or max(gain.values()) <= 0:
                break
            best = max(gain.values())
            tied = [c for c in gain if gain[c] >= best * (1 - 1e-9)]
            same = sorted((c for c in tied if (c.feature, c.above) == (tied[0].feature, tied[0].above)), key=lambda c: c.threshold)
            chosen = same[len(same) // 2]  # the middle of the gap
            grown.append((chosen, *held[chosen]))
            if not choices[chosen][0]:
                break
        while len(grown) > 1 and _worth(*grown[-2][1:]) >= _worth(*grown[-1][1:]):
            grown.pop()
        if not grown:
            break
        _, good, poor = grown[-1]
        if poor < max(1, COVER // 3) or poor < PRECISION * (good + poor):
            break
        rules.append(tuple(c for c, _, _ in grown))
    forget(rows)
    return rules


def _worth(good: int, poor: int) -> float:
    return (poor - good) / (poor + good) if poor + good else -1.0


def judge(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``df`` with a struct ``__quality``: the counts, base_failed, the rule that rejects, and kept."""
    rows = measure(df, text_col)
    c = F.col("__counts")
    rule, failed = verdict(rules, features(c)), base_failed(c)
    told = F.struct(*(c[k].alias(k) for k in COUNTS), failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept"))
    return fixed(rows, __quality=told).drop("__counts")
