"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

All in DataFrame expressions.  Positions come from the pieces between matches (``split`` and
``regexp_extract_all`` walk the same matches), so nothing leaves a text's own row.  The models are
transition counts of labelled samples: values that the fixed patterns found and hashes written in hex
and base64 count as random, other identifier-like tokens as ordinary; a token is a secret when its
log-likelihood ratio passes ``MARGIN``.

The models are fitted on a bounded sample of documents (``sample``, by hash of the id); every whole text
is scanned.

Defined cases: a null text is an empty one; a token that a fixed pattern reported is not reported again;
equal rows give equal results; columns of any other name stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.shared import block_folds, fixed, folds_before, larger

#: Fixed patterns, the group that holds the value, and its least length, in the order of their kinds.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
ORDER = [*KINDS, "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Tokens that the models judge; documents to fit on; nats by which random must win; smoothing.
TOKEN, SAMPLE, MARGIN, SMOOTH = r"[A-Za-z0-9+/_=-]{20,}", 4000, 6.0, 0.5
ORDINARY = r"[A-Za-z0-9+/_=-]{8,}"
#: Prefix sums over arrays go by blocks of this many.
BLOCK = 64

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _lengths(a: Column) -> Column:
    return F.transform(a, F.length)


def _with_matches(df: DataFrame, name: str, pattern: str, group: int) -> DataFrame:
    """Adds ``{name}``: array<struct<start, end, value_start, size>> of all matches in ``__text``."""
    text, hit = F.col("__text"), F.col("__text").rlike(pattern)
    all_of = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    numbers = lambda c: F.when(hit, _lengths(c)).otherwise(F.array().cast("array<int>"))
    df = fixed(df, __n=numbers(all_of(0)), __v=numbers(all_of(group)) if group else F.lit(None), __g=numbers(F.split(text, pattern, -1)))
    if not group:
        df = df.withColumn("__v", F.col("__n"))
    df = fixed(df, __s=F.zip_with(F.slice("__g", 1, F.size("__n")), "__n", lambda g, n: g + n))
    df = fixed(df, __b=block_folds(F.col("__s"), BLOCK))
    df = fixed(df, __o=folds_before(F.col("__s"), F.col("__b"), BLOCK))

    def span(n: Column, i: Column) -> Column:
        start, size = F.get("__o", i) + F.get("__g", i), F.get("__v", i)
        return F.struct(start.alias("start"), (start + n).alias("end"), (start + n - size).alias("value_start"), size.alias("size"))

    return fixed(df, **{name: F.transform("__n", span)}).drop("__n", "__v", "__g", "__s", "__b", "__o")


def _at_least(least: int):
    return lambda s: s["size"] >= least


def base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``__text`` and arrays of the fixed patterns' spans, ``__assign``, ``__access`` and ``__hex``."""
    df = fixed(df, __text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for kind, (pattern, group, least) in KINDS.items():
        df = _with_matches(df, f"__{kind}", pattern, group)
        df = df.withColumn(f"__{kind}", F.filter(f"__{kind}", _at_least(least)))
    return df


def _transitions(tokens: DataFrame, weight: str) -> DataFrame:
    """Counts of (from, to) characters of ``token``, each token once; 0 is any character not in the alphabet."""
    coded = tokens.select("label", F.expr(f"transform(filter(split(token, ''), c -> c != ''), c -> instr('{ALPHABET}', c))").alias("c"))
    pairs = coded.select("label", F.explode(F.zip_with(F.expr("slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c) - 1)"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return pairs.groupBy("p.a", "p.b", "label").agg(F.count("*").alias(weight))


def labelled_tokens(docs: DataFrame, sample: int, text_col: str = "text") -> DataFrame:
    """Distinct tokens (token, label) of at most ``sample`` documents, and ``sample // 2`` hashes as random ones."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    rows = base_spans(docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id"))  # at most `sample` ids
    cut = lambda s: F.substring(F.col("__text"), s["value_start"] + 1, s["size"])
    values = F.concat(*(F.transform(f"__{k}", cut) for k in KINDS))
    rows = rows.select("__text", values.alias("random"))
    random = rows.select(F.explode("random").alias("token"))
    plain = rows.select(F.explode(F.array_except(F.regexp_extract_all("__text", F.lit(ORDINARY), F.lit(0)), "random")).alias("token")).filter(~F.col("token").rlike(KINDS["hex"][0]))
    ids = docs.sparkSession.range(max(1, sample // 8))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = ids.select(F.explode(F.array(F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)), F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.substring(F.base64(F.unhex(digest)), 1, 30))).alias("token"))
    told = random.unionByName(made).distinct().withColumn("label", F.lit(1))
    return told.unionByName(plain.distinct().withColumn("label", F.lit(0))).filter(F.length("token") > 1)


def train(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> list[float]:
    """Log-likelihood ratios of all transitions, row by row: (alphabet + 1)^2 numbers."""
    import math

    n = len(ALPHABET) + 1
    count = [[[SMOOTH] * n for _ in range(n)] for _ in range(2)]
    for r in _transitions(labelled_tokens(docs, sample, text_col), "n").collect():  # at most 2 * n * n rows
        count[r.label][r.a][r.b] += r.n
    out = []
    for a in range(n):
        whole = [sum(count[k][a]) for k in (0, 1)]
        out += [math.log(count[1][a][b] / whole[1]) - math.log(count[0][a][b] / whole[0]) for b in range(n)]
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token's transitions: random over ordinary."""
    n = len(ALPHABET) + 1
    table = F.array(*(F.lit(round(x, 4)) for x in model))
    coded = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    step = F.aggregate(
        coded, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] >= 0, F.get(table, s["last"] * n + c)).otherwise(0.0)).alias("sum")),
    )
    return step["sum"]


def scan(df: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """``df`` with ``__base`` and ``__spans``: array<struct<start, kind, end>> in order, kinds by number in ORDER."""
    names = df.columns
    rows = _with_matches(base_spans(df, text_col), "__token", TOKEN, 0)
    as_spans = lambda k: F.transform(f"__{ORDER[k]}", lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    place = lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))
    known = F.flatten(F.array(*(F.transform(f"__{k}", lambda s: place(s["value_start"], s["end"])) for k in KINDS)))
    rows = fixed(rows, __base=F.sort_array(F.concat(*(as_spans(k) for k in range(len(KINDS))))).cast(_SPAN), __places=F.array_except(F.transform("__token", lambda s: place(s["start"], s["end"])), known))
    cut = F.transform("__places", lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("start"), F.split(p, ":")[1].cast("int").alias("end")))
    rows = fixed(rows, __new=cut)
    secret = F.filter("__new", lambda s: ratio(F.substring(F.col("__text"), s["start"] + 1, s["end"] - s["start"]), model) > MARGIN)
    found = F.transform(secret, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    return fixed(rows, __spans=F.sort_array(F.concat("__base", found)).cast(_SPAN)).select(*names, "__base", "__spans")


def told(spans: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(told("__base"), 256).alias("base_sha256"), told("__spans").alias("spans"))


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``scanned`` with each span of its texts replaced by ``mark``, touching or nested spans by one; the span columns go."""
    rows = fixed(scanned, __ends=F.transform("__spans", lambda s: s["end"]))
    rows = fixed(rows, __upto=block_folds(F.col("__ends"), BLOCK, larger))
    rows = fixed(rows, __at=folds_before(F.col("__ends"), F.col("__upto"), BLOCK, larger))
    text = F.col(text_col)

    def piece(s: Column, i: Column) -> Column:
        """What stands between the spans before and this one, and the mark; nothing where they overlap."""
        at = F.get("__at", i)
        return F.when(s["start"] < at, "").otherwise(F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark)))

    done = F.concat(F.array_join(F.transform("__spans", piece), ""), F.substring(text, F.array_max("__ends") + 1, F.length(text)))
    return rows.withColumn(text_col, F.when(F.size("__spans") > 0, done).otherwise(text)).drop("__base", "__spans", "__ends", "__upto", "__at")
