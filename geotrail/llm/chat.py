"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one
block whose texts stand in an array; blocks are written between markers and concatenated:

* system ``[SYS]..[/SYS]``, user ``[INST]..[/INST]``, assistant ``<s>..</s>``, any other role
  ``[TURN]role[TEXT]..[/TURN]``; texts of one block are separated by ``[SEP]``.
* A marker inside a text (or role) gets a backslash after its first character, after all backslashes
  there were doubled, so markers in the output are always the template's and ``unescape`` is exact.

The output has ``mask``, the code point ranges of the formatted string that are assistant texts, the part a
model is trained on, and ``segments`` (text, loss), the pieces that the string was put together from.

Defined cases: a null text or role is an empty one; a null conversation id is a conversation of its
own; turns that share a number are ordered by role, then text, a null number first; repeated rows are
repeated turns; other columns, of any name, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.shared import block_folds, fixed, folds_before

MARKS = r"(?:/?(?:SYS|INST|TURN)|TEXT|SEP)\]|/?s>"
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "<s>"}
#: Segments of a block whose lengths are summed before others are.
SUMS = 64
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
BLOCK = r"(?s)(\[SYS\]|\[INST\]|<s>|\[TURN\])(.*?)(?:\[/SYS\]|\[/INST\]|</s>|\[/TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([\[<])({MARKS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"([\[<])\\({MARKS})", "$1$2"), F.lit("\\\\"), F.lit("\\"))


def _by_role(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = other
    for name, mark in marks.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _segments(block: Column) -> Column:
    """A block's pieces (text, loss): opening mark, texts with separators between them, closing mark."""
    mark = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
    role = block["role"]
    opening = mark(_by_role(role, OPEN, F.concat(F.lit("[TURN]"), escape(role), F.lit("[TEXT]"))))
    closing = mark(_by_role(role, CLOSE, F.lit("[/TURN]")))
    told = F.flatten(
        F.transform(
            block["texts"],
            lambda t, i: F.when(i > 0, F.array(mark(F.lit("[SEP]")), F.struct(t.alias("text"), (role == "assistant").alias("loss")))).otherwise(F.array(F.struct(t.alias("text"), (role == "assistant").alias("loss")))),
        )
    )
    return F.concat(F.array(opening), told, F.array(closing))


def merge_turns(df: DataFrame) -> DataFrame:
    """(conv_id, blocks array<struct<role, texts array<string>>>): adjacent turns of one role merged."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    told = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    n = F.size("turns")
    role = lambda i: F.get("turns", i)["role"]
    told = fixed(told, starts=F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i) != role(i - 1))))
    block = lambda s, k: F.struct(
        role(s).alias("role"), F.transform(F.slice(F.col("turns"), s + 1, F.coalesce(F.get("starts", k + 1), n) - s), lambda t: t["text"]).alias("texts")
    )
    return told.select("conv_id", F.transform("starts", block).alias("blocks"))


def format_chats(df: DataFrame) -> DataFrame:
    """(conv_id, formatted string, segments array<struct<text, loss>>, mask array<struct<start, end>>) of rows (conv_id, turn, role, text)."""
    blocks = merge_turns(df).withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), F.transform(b["texts"], escape).alias("texts"))))
    told = fixed(blocks.select("conv_id", F.flatten(F.transform("blocks", _segments)).alias("segments")), lengths=F.transform("segments", lambda s: F.length(s["text"])))
    told = fixed(told, sums=block_folds(F.col("lengths"), SUMS))
    told = fixed(told, starts=folds_before(F.col("lengths"), F.col("sums"), SUMS))
    spans = F.transform("segments", lambda s, i: F.struct(F.get("starts", i).alias("start"), (F.get("starts", i) + F.get("lengths", i)).alias("end"), s["loss"].alias("loss")))
    mask = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    return told.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", mask.alias("mask"))


def loss_spans(chats: DataFrame) -> DataFrame:
    """(conv_id, start, end): the loss mask, a row for each range."""
    return chats.select("conv_id", F.inline("mask"))


def masked(formatted: Column, mask: Column) -> Column:
    """The texts of ``formatted`` under the mask, as they were, with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns, as they were, from a formatted string."""
    opened = F.regexp_extract_all(formatted, F.lit(BLOCK), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(BLOCK), F.lit(2))

    def turns(mark: Column, body: Column) -> Column:
        other = mark == "[TURN]"
        named = unescape(F.regexp_extract(body, r"(?s)^(.*?)\[TEXT\]", 1))
        role = F.when(mark == "[SYS]", "system").when(mark == "[INST]", "user").when(mark == "<s>", "assistant").otherwise(named)
        texts = F.split(F.when(other, F.regexp_replace(body, r"(?s)^.*?\[TEXT\]", "")).otherwise(body), r"\[SEP\]", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.zip_with(opened, bodies, turns))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted conversations and their masks."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
