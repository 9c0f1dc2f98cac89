"""The operators' registered queries over whole tables, their SQL, and the pipeline's stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.llm import bpe, chat, filter_audit, html, language_id, lexical_search, lsh_forest, media, mixing, quality, rlz_dedup, secret_scan, suffix_dedup
from geotrail.llm.shared import packed, written

__all__ = ["ORACLES", "QUERIES", "written"]

#: The rank file; its place and the pattern of its pre-tokens come from the installed package of vocabularies.
RANKS = "byte_bpe_50k.tiktoken"
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shares of the token budget by domain, a domain being a label of quality and toxicity.
WEIGHTS = {"quality 1, toxic 0": 0.95, "quality 0, toxic 0": 0.03, "quality 1, toxic 1": 0.01, "quality 0, toxic 1": 0.01}


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(", toxic "), F.col("toxic").cast("string"))
    return _table(spark, sf_dir, "labels").select("doc_id", name.alias("domain"))


def _mixed(docs: DataFrame, model: mixing.Model, *keep: str) -> DataFrame:
    """The columns of ``keep`` with __tokens, __p, __rate and __copies; as many expected tokens as there are, shared out by WEIGHTS."""
    scored = mixing.posteriors(docs, model)
    told = written(scored.select("doc_id", *keep, "__tokens", "__p"))
    budget = float(told.agg(F.sum("__tokens")).first()[0] or 0)
    return mixing.mix(told, mixing.fit(told, mixing.weights_to_targets(model, WEIGHTS, budget)))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents: doc_id, n_tokens, the most likely domain and its posterior, rate, copies."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, _domains(spark, sf_dir))
    best = F.array_max("__p")
    names = F.array(*(F.lit(d) for d in model.domains))
    likely = F.get(names, F.array_position("__p", best).cast("int") - 1)
    return _mixed(docs, model).select(
        "doc_id", F.col("__tokens").alias("n_tokens"), likely.alias("domain"), F.round(best, 6).alias("posterior"),
        F.round("__rate", 6).alias("rate"), F.col("__copies").alias("copies"),
    )


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return suffix_dedup.digest(suffix_dedup.remove(docs, suffix_dedup.duplicate_spans(docs)))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.mux(_table(spark, sf_dir, "documents")))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op5_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rlz_dedup.digest(rlz_dedup.remove(docs, rlz_dedup.duplicate_spans(docs)))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], turns.schema)
    return chat.digest(chat.format_chats(turns.unionByName(own)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    told = quality.judge(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))
    q = F.col("__quality")
    return told.select("doc_id", *(q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs)))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), bpe.load_ranks(public_tokenizers.path(RANKS)), PATTERN)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.filter(~language_id.held_out()))
    told = language_id.predict(docs, profiles)
    return told.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.file_stream(spark, f"{sf_dir}/documents.parquet"), _table(spark, sf_dir, "labels"))


#: What the mixing stage adds to the columns of documents; a column of that name is replaced.
COPIES = "copies"


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject, as they are.

    A null or empty text is rejected (no words); equal rows get one verdict; other columns, of any name, are
    kept; an empty table gives an empty result.
    """
    told = quality.judge(packed(docs, "doc_id", "text"), quality.learn(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels")))
    return told.filter("__quality.kept").select("__row.*")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, as it is.

    Texts without words are in no class and all stay, as do rows without an id; of repeated rows one stays; other
    columns, of any name, are kept; an empty table gives an empty result.
    """
    return lsh_forest.deduplicate(docs)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret of their texts replaced by a mark; n_chars follows.

    A null text stays null, with its n_chars; equal rows are changed alike; other columns, of any name, are
    kept; an empty table gives an empty result.
    """
    rows = packed(docs, "doc_id", "text")
    clean = secret_scan.redact(secret_scan.scan(rows, secret_scan.train(docs.select("doc_id", "text"))))
    size = F.coalesce(F.length("text").cast("long"), F.col("__row")["n_chars"]) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": size}
    return clean.select(*(new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, as they are, with the number of their copies in a column ``copies``.

    A document is never repeated as a row, however many copies its rate asks for; those of no copies go.  A null
    or empty text weighs nothing and gets the copies its posteriors give; equal rows get equal copies; other
    columns, of any name but ``copies``, are kept; an empty table gives an empty result.
    """
    rows = packed(docs, "doc_id", "text")
    mixed = _mixed(rows, mixing.train(docs.select("doc_id", "text"), _domains(spark, sf_dir)), "__row").filter("__copies > 0")
    return mixed.select(*(F.col("__row")[c].alias(c) for c in docs.columns if c != COPIES), F.col("__copies").alias(COPIES))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded documents: doc_id, copies, ids, their number and the hex digest of the bytes decoded from them.

    Each row is encoded once; copies are 1 where the column isn't there.  A null text has no tokens; equal rows
    give equal results; other columns are left out; an empty table gives an empty result.  Ids are written before they
    are decoded, so that a task has one Python worker at a time.
    """
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    copies = F.col(COPIES).cast("long") if COPIES in docs.columns else F.lit(1).cast("long")
    rows = docs.select("doc_id", "text", copies.alias(COPIES))
    back = bpe.decode(written(bpe.encode(rows, ranks, PATTERN, keep=(COPIES,))), ranks, PATTERN)
    return back.select("doc_id", COPIES, "ids", "n_tokens", F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_suffix": op2_suffix,
    "op3_media": op3_media,
    "op4_html": op4_html,
    "op5_rlz": op5_rlz,
    "op6_chat": op6_chat,
    "op7_quality": op7_quality,
    "op8_secrets": op8_secrets,
    "op9_jaccard": op9_jaccard,
    "op10_bpe": op10_bpe,
    "op11_search": op11_search,
    "op12_language": op12_language,
    "op13_audit": op13_audit,
}

#: Marks that the chat template escapes, as DuckDB writes them.
_ESCAPED = r"""regexp_replace(replace(t, '\', '\\'), '([\[<])((?:/?(?:SYS|INST|TURN)|TEXT|SEP)\]|/?s>)', '\1\\\2', 'g')"""

#: Terms of a text, as DuckDB writes them.
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

ORACLES: dict[str, str] = {
    "op5_rlz": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (g) WHERE first < doc_id),
w AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT w.doc_id, count(*) AS n, count(c.j) AS gone, string_agg(t, ' ' ORDER BY w.j) FILTER (c.j IS NULL) AS kept
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.j = w.j GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op6_chat": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, length({_ESCAPED}) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN NOT opens THEN 5 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7
    ELSE 19 + length(role) END)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id""",
    "op11_search": f"""
WITH dt AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
it AS (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS reps FROM it GROUP BY item_id, t),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS total FROM dt),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM dt) u WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t) f, s),
p AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total))) AS worth FROM tf JOIN w USING (t), s),
c AS (SELECT item_id, r, doc_id, sum(reps * worth)::BIGINT AS score FROM p JOIN q USING (t) WHERE item_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY item_id, r, doc_id HAVING sum(reps * worth) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c) o WHERE rank <= 10""",
    "op13_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e FROM d),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
  AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
k AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step]) - bits[step] AS before FROM o, (SELECT unnest(range(1, 6)) AS step) i),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before)::INT = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before::INT = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before::INT > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & before::INT = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before::INT = 0), 0)::BIGINT AS toxic_lost
  FROM m, k GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r""",
}
