"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to ``chunk`` code points are encoded where they stand.  Longer ones are cut into
overlapping chunks that become rows of their own and are dealt over the cluster: each chunk is
pre-tokenised alone, neighbours are stitched at the first pre-token boundary that both see inside
their overlap (from there on both readings agree), and the pieces between two stitches, each made of
whole pre-tokens, are encoded as separate rows.  Decoding concatenates the tokens' raw bytes.

A boundary counts for stitching only where every edition of the Unicode tables has one (``sure``), as the
pre-tokeniser here and the encoder needn't have the same: where space follows something else, and between
letters, numbers and other characters, in any script.

Defined cases: a null text is an empty one and has no tokens; equal rows give equal results, each row
its own; chunks that don't agree inside their overlap (a run longer than the overlap, which is one
pre-token or made of characters that editions of Unicode tell apart) stay in one piece; other columns are
ignored but for those named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code points of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 32768, 1024
#: A chunk's last boundaries may come from the cut itself: the longest look-ahead is a contraction.
MARGIN = 4

@lru_cache(maxsize=4)
def _codec(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def load_ranks(path: str) -> bytes:
    """The rank file's bytes; it has a fixed size (under 1 MB), so it travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _ids(texts, ranks: bytes, pattern: str) -> list[bytes]:
    codec = _codec(ranks, pattern)
    return [np.asarray(codec.encode_to_numpy(t or "", disallowed_special=()), dtype="<u4").tobytes() for t in texts]


def _shared(spark: SparkSession, ranks: bytes):
    return spark.sparkContext.broadcast(ranks)


def _encode_column(df: DataFrame, keep: list[str], text: str, shared, pattern: str) -> DataFrame:
    """``keep`` and the column ``ids`` (little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = pa.array(_ids(part.column(part.num_columns - 1).to_pylist(), shared.value, pattern), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*keep, "ids"])

    picked = df.select(*keep, F.col(text).alias("__text"))
    types = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{types}, ids binary")


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the pre-tokens of ``text`` start, and its length."""
    import regex

    return [m.start() for m in regex.finditer(pattern, text)] + [len(text)]


@lru_cache(maxsize=1 << 14)
def _kind(char: str) -> str:
    """Z white space, L letter, N number, O other; blank where editions of Unicode may differ, or a contraction may begin."""
    if char in " \t\n\r":
        return "Z"
    first, now = unicodedata.ucd_3_2_0.category(char)[0], unicodedata.category(char)[0]
    if first != now or now in "ZC" or char == "'":
        return ""
    return now if now in "LN" else "O"


def sure(text: str, at: int) -> bool:
    """Whether any reading has a boundary before ``text[at]``: white space begins there, or another kind of characters."""
    a, b = _kind(text[at - 1]), _kind(text[at])
    return bool(a and b) and a != b and a != "Z"


def _chunks(longs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    step = chunk - overlap

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last = max(1, -(-(len(text) - overlap) // step)) - 1
                for k in range(last + 1):
                    part = text[k * step : k * step + chunk] if k < last else text[k * step :]
                    yield pa.RecordBatch.from_pydict({"digest": [key], "k": pa.array([k], pa.int32()), "part": [part], "last": [k == last]})

    return longs.select("digest", "text").mapInArrow(run, "digest string, k int, part string, last boolean")


def _pretokenised(chunks: DataFrame, overlap: int, chunk: int, pattern: str) -> DataFrame:
    """Adds the boundaries in the overlaps with the chunk before and after, counted from the overlap's start."""
    step = chunk - overlap

    def run(batches):
        for batch in batches:
            head, tail = [], []
            for k, part, last in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                at = [b for b in boundaries(part, pattern) if 0 < b < len(part) and (b < overlap or b >= step) and sure(part, b)]
                head.append([b for b in at if b < overlap - MARGIN] if k else [])
                tail.append([] if last else [b - step for b in at if step <= b < chunk - MARGIN])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["digest", "k", "part", "last", "head", "tail"])

    return chunks.mapInArrow(run, "digest string, k int, part string, last boolean, head array<int>, tail array<int>")


def _encode_long(longs: DataFrame, shared, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(digest, ids) of distinct long texts (digest, text)."""
    step = chunk - overlap
    cut = _pretokenised(_chunks(longs, chunk, overlap).repartition("digest", "k"), overlap, chunk, pattern)
    one = Window.partitionBy("digest").orderBy("k")
    meet = F.array_min(F.array_intersect("tail", F.lead("head").over(one)))
    stitched = cut.withColumn("end", F.when(~F.col("last"), meet)).withColumn("begin", F.when(F.col("k") > 0, F.coalesce(F.lag("end").over(one), F.lit(0))).otherwise(0))
    # `begin` and `end` count from the overlap's start: the chunk's own start, or its last `overlap`; without an end the next chunk goes on.
    upto = F.when(F.col("last"), F.length("part")).otherwise(step + F.coalesce("end", F.lit(0)))
    cutout = F.col("part").substr(F.col("begin") + 1, F.greatest(upto - F.col("begin"), F.lit(0)))
    opens = F.coalesce(F.lag("end").over(one).isNotNull().cast("int"), F.lit(0))
    pieces = stitched.withColumn("piece", cutout).withColumn("opens", opens).withColumn("n", F.sum("opens").over(one)).select("digest", "n", "k", "piece")
    whole = pieces.groupBy("digest", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("piece"))
    # dealt anew: a document's pieces stand together after the window
    encoded = _encode_column(whole.repartition("digest", "n"), ["digest", "n"], "piece", shared, pattern)

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        return pa.table({"digest": [table["digest"][0].as_py()], "ids": [b"".join(table["ids"].to_pylist())]})

    return encoded.groupBy("digest").applyInArrow(joined, "digest string, ids binary")


def encode(df: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row (id, the columns of ``keep``, ids binary, n_tokens long) for each row of ``df``; ids are little-endian unsigned 32-bit integers."""
    if not MARGIN < overlap < chunk // 2:
        raise ValueError("overlap must be over 4 and under half a chunk")
    shared = _shared(df.sparkSession, ranks)
    more = F.struct(*(F.col(f"`{c}`").alias(c) for c in keep), F.lit(0).cast("byte").alias("__")).alias("more")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), more)
    short = _encode_column(rows.filter(F.length("text") <= chunk), ["id", "more"], "text", shared, pattern)
    longs = rows.filter(F.length("text") > chunk).withColumn("digest", F.sha2("text", 256))
    distinct = longs.groupBy("digest").agg(F.first("text").alias("text"))
    whole = longs.select("id", "more", "digest").join(_encode_long(distinct, shared, pattern, chunk, overlap), "digest").select("id", "more", "ids")
    out = short.unionByName(whole)
    return out.select(F.col("id").alias(id_col), *(F.col("more")[c].alias(c) for c in keep), "ids", _n_tokens("ids").alias("n_tokens"))


def _n_tokens(ids: str) -> Column:
    return F.expr(f"octet_length({ids}) div 4").cast("long")


def decode(df: DataFrame, ranks: bytes, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """Adds the column ``bytes``: the raw bytes of each row's tokens, concatenated."""
    shared, names = _shared(df.sparkSession, ranks), df.columns
    place = names.index(ids_col)

    def run(batches):
        codec = None
        for batch in batches:
            codec = codec or _codec(shared.value, pattern)
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                raw = [codec.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*names, "bytes"])

    types = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{types}, bytes binary")


def digest(df: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the hex digests of each document's ids and of the bytes decoded from them."""
    back = decode(encode(df, ranks, pattern), ranks, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
