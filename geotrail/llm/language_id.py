"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of 1 to 3 letters, in order.  A language's profile comes from the
n-grams of all its labelled training texts, counted in tasks, summed by Spark and cut to ``KEPT`` by rank.  A document's
profile is compared to each language's: every n-gram of the document costs the distance between its two ranks, or
``KEPT`` where the language lacks it.  The language of the least sum is predicted.

Texts are lower-cased; whatever is no letter (or mark on one) separates words, and a word's ends count as characters.

Defined cases: a null text and one without a letter are ``und`` with score 0, and teach nothing; rows without a
language or an id aren't learned from; equal texts get equal predictions; of equally near languages the first by
name is taken; without a training text all are ``und``; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of a profile, and the most languages: their profiles are broadcast, some 10 MB at most.
KEPT, MOST_LANGUAGES = 400, 1000
#: What a text is called that has no language.
UNKNOWN = "und"
#: Characters of a text that are counted at a time, and a task's distinct n-grams before they are handed out.
PIECE, HELD = 1 << 18, 1 << 20
#: Bits of a character in an n-gram's number; a character is its code point plus one.
_BITS = 21
_SPACE = 33


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its character as profiles have it: in lower case, or a space; negative for marks."""
    out = np.full(0x110000, _SPACE, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0]) + 1
        elif unicodedata.category(x)[0] == "M":
            out[c] = -(c + 1)
    return out


def _characters(text: str) -> np.ndarray:
    """A text's characters, a space at each end and one between words; empty where it has no letter."""
    told = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    if not (told > _SPACE).any():
        return np.zeros(0, np.int64)
    told = np.concatenate([[_SPACE], np.abs(told), [_SPACE]])
    space = told == _SPACE
    space[1:] &= space[:-1]
    space[0] = False
    return told[~space]


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once, in order, with the sum of its counts."""
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as numbers, in order, and how often each stands there; a lone space is none."""
    told = _characters(text)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(told), PIECE):
        part = told[at : at + PIECE + 2]
        n = min(PIECE, len(told) - at)
        two = part[:-1] << _BITS | part[1:]
        three = part[:-2] << 2 * _BITS | two[1:]
        found.append(np.unique(np.concatenate([part[:n][part[:n] != _SPACE], two[:n], three[:n]]), return_counts=True))
    if len(found) == 2:
        return found[1]
    return _summed(np.concatenate([g for g, _ in found]), np.concatenate([c for _, c in found]))


def _ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ``KEPT`` most frequent n-grams, the most frequent first, equal ones by number."""
    return grams[np.argsort(-counts, kind="stable")[:KEPT]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams by language: ranks[k, i] of grams[k] in languages[i], ``KEPT`` where it isn't in the profile."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    def distances(self, text: str) -> np.ndarray | None:
        """The mean out-of-place distance from each language, as a share of the greatest; None for a text without letters."""
        own = _ranked(*gram_counts(text))
        if not len(own) or not self.languages:
            return None
        place = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = (self.grams[place] == own)[:, None] & (self.ranks[place] < KEPT)
        off = np.where(known, np.abs(self.ranks[place] - np.arange(len(own))[:, None]), KEPT)
        return off.sum(axis=0) / (KEPT * len(own))


def learn(docs: DataFrame) -> Profiles:
    """The profiles of the languages of ``docs`` (text, lang), from all rows that have both.

    Tasks add up their n-grams and hand the sums out when they hold many, so a language with most rows is summed before
    it is shuffled; n-grams of a language are then summed by n-gram, and only the ``KEPT`` first of each language leave Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                grams, counts = _summed(np.concatenate([g for g, _ in found]), np.concatenate([c for _, c in found]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                grams, counts = gram_counts(text.as_py())
                held.setdefault(lang.as_py(), []).append((grams, counts))
                size += len(grams)
                if size > HELD:
                    held = {k: [_summed(np.concatenate([g for g, _ in v]), np.concatenate([c for _, c in v]))] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD // 2:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = counts.withColumn("place", place).filter(F.col("place") < KEPT).select("lang", "gram", "place")
    told = top.limit(KEPT * MOST_LANGUAGES + 1).collect()
    if len(told) > KEPT * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted({r.lang for r in told})
    column = {lang: k for k, lang in enumerate(languages)}
    grams = np.unique(np.array([r.gram for r in told], np.int64))
    ranks = np.full((len(grams), len(languages)), KEPT, np.int64)
    for r in told:
        ranks[np.searchsorted(grams, r.gram), column[r.lang]] = r.place
    return Profiles(languages, grams, ranks)


def predict(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with lang_pred and score, one less the distance from the language taken, of docs (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), "text")
    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        for batch in batches:
            lang, score = [], []
            for text in batch.column(last):
                away = told.distances(text.as_py()) if text.is_valid else None
                best = None if away is None else int(np.argmin(away))
                lang.append(UNKNOWN if best is None else told.languages[best])
                score.append(0.0 if best is None else round(1 - float(away[best]), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:last], "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:last])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether an id is kept for testing: a fifth of them, by checksum; none without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
