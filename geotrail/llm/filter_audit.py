"""An audit of how filters interact, kept by a stream that takes back what later rows prove wrong.

Five filters fail a text: A, under 100 words; B, under 80 distinct words in 100; C, over 10 capitals A-Z in 100 characters;
D, any of ``#$%&*|``; E, the same text as a row of lesser doc_id.  A to D are a text's own; E needs all rows.

1. A stream reads the files in available-now micro-batches.  Each text becomes its mask of A to D and its digest, and
   gets its labels.  A task adds up rows of one text before they are shuffled: those of its least id, and all others.
2. State by digest holds the least id so far and the rows that have it.  Rows of greater ids fail E at once.  When a lesser
   id arrives, the rows that were counted as passing E are taken back and counted as failing it.
3. Each micro-batch writes the changes of its counters (part, mask, labels), a small table under the batch's number, so
   that a repeated batch replaces itself.  Their sum is the state of the audit.
4. All orders of the filters are read off the counters.

Defined cases: a null text is empty; rows without an id have no lesser one, are nobody's lesser one and have no labels; rows
that repeat a least id are all passed by E; a language of null is the part ''; of several labels of an id the
greatest counts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from geotrail.llm.grams import parts
from geotrail.llm.shared import shared_dir

FILTERS = "ABCDE"
#: The bit of E in a mask; A is bit 0.
REPEATED = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Texts that a task holds while it adds up, some 100 MB; micro-batches of a whole table.
HELD, BATCHES = 1 << 16, 4
_CAPITALS = bytes(range(65, 91))
_TAILS = bytes(range(128, 192))
_MARKS = re.compile(rb"[#$%&*|]")

COUNTER = "part string, mask int, good int, toxic int, n long"
_TOLD = "digest binary, doc_id long, part string, mask int"
_SUMMED = "digest binary, doc_id long, mask int, part string, good int, toxic int, least long, rest long"


def mask(text: bytes) -> int:
    """The filters A to D that a text fails."""
    words = text.split()
    characters = len(text.translate(None, _TAILS))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * characters, _MARKS.search(text) is not None)
    return sum(1 << k for k, f in enumerate(fails) if f)


def masked(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, part, mask) of docs (doc_id, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, 2):
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, batch.column(0), batch.column(1), pa.array(map(mask, texts), pa.int32())], names=["digest", "doc_id", "part", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, _TOLD)


def labelled(told: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with good and toxic, 1 where ``labels`` (doc_id, quality, toxic) says so; those without an id are dealt by their text."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(flag("quality")("__good"), flag("toxic")("__toxic"))
    known = known.withColumn("__named", F.lit(True))
    named = told.select("*", F.coalesce("doc_id", F.xxhash64("digest")).alias("__id"), F.col("doc_id").isNotNull().alias("__named"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return named.join(known, ["__id", "__named"], "left").select(*told.columns, zero("__good").alias("good"), zero("__toxic").alias("toxic"))


def summed(rows: DataFrame) -> DataFrame:
    """One row a task for each text, part and labels: the least id there, the number of rows that have it, and of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        lone: dict[tuple, int] = {}
        own = uuid.uuid4().bytes  # a key of this task's, for rows without an id

        def out() -> pa.RecordBatch:
            told = [(digest, doc, m, *of, n, rest) for digest, (doc, m, counts) in held.items() for of, (n, rest) in counts.items()]
            told += [(own, None, of[0], *of[1:], n, 0) for of, n in lone.items()]
            columns = zip(*told, strict=True) if told else [()] * 8
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "doc_id", "mask", "part", "good", "toxic", "least", "rest"])

        for batch in batches:
            for digest, doc, part, m, good, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of = (part, good, toxic)
                if doc is None:
                    lone[m, *of] = lone.get((m, *of), 0) + 1
                    continue
                entry = held.get(digest)
                if entry is None:
                    held[digest] = [doc, m, {of: [1, 0]}]
                    continue
                if doc < entry[0]:
                    entry[0] = doc
                    for n in entry[2].values():
                        n[1] += n[0]
                        n[0] = 0
                n = entry[2].setdefault(of, [0, 0])
                n[doc > entry[0]] += 1
            if len(held) > HELD:
                yield out()
                held.clear()
                lone.clear()
        yield out()

    return rows.select("digest", "doc_id", "part", "mask", "good", "toxic").mapInArrow(run, _SUMMED)


class LeastIds(StatefulProcessor):
    """State by text: the least id and the rows that have it; gives the changes of the counters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("least", "doc_id long, rows array<struct<part: string, good: int, toxic: int, n: long>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        told = list(rows)
        change: dict[tuple, int] = {}

        def add(m: int, of: tuple, n: int) -> None:
            change[m, *of] = change.get((m, *of), 0) + n

        if told[0].doc_id is None:
            for r in told:
                add(r.mask, (r.part, r.good, r.toxic), r.least)
        else:
            m, old = told[0].mask, self.state.get()
            least = min(r.doc_id for r in told)
            passing: dict[tuple, int] = {}
            if old is not None and old[0] <= least:
                least = old[0]
                passing = {tuple(r)[:3]: r[3] for r in old[1]}
            elif old is not None:
                for part, good, toxic, n in old[1]:
                    add(m, (part, good, toxic), -n)
                    add(m | REPEATED, (part, good, toxic), n)
            before = dict(passing)
            for r in told:
                of = (r.part, r.good, r.toxic)
                add(m | REPEATED, of, r.rest)
                if r.doc_id > least:
                    add(m | REPEATED, of, r.least)
                else:
                    add(m, of, r.least)
                    passing[of] = passing.get(of, 0) + r.least
            passing = {of: n for of, n in passing.items() if n}
            if old is None or old[0] != least or passing != before:
                self.state.update((least, [(*of, n) for of, n in passing.items()]))
        for (m, part, good, toxic), n in change.items():
            if n:
                yield Row(part=part, mask=m, good=good, toxic=toxic, n=n)

    def close(self) -> None:
        pass


#: How the state is kept: on disk in RocksDB, whose memory is bounded for all stores of an executor, and no space taken in advance.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def counters(stream: DataFrame, labels: DataFrame, home: str) -> DataFrame:
    """Runs ``stream`` (doc_id, lang, text) to its present end; the counters (part, mask, good, toxic, n) below ``home``.

    A later run over the same ``home`` goes on where this one ended and takes the new files only.
    """
    spark = labels.sparkSession
    changes = summed(labelled(masked(stream), labels)).groupBy("digest").transformWithState(LeastIds(), COUNTER, "Append", "None")

    def batch(df: DataFrame, number: int) -> None:
        sums = df.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{home}/counters/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        query = changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    query.awaitTermination()
    spark.createDataFrame([], COUNTER).write.mode("overwrite").parquet(f"{home}/counters/batch=-1")  # where no file came
    return spark.read.schema(COUNTER).parquet(f"{home}/counters").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def _orders() -> list[dict]:
    """Each step of each order of the filters: its letter's bit and those of the letters before it."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "own": own, "before": before})
            before |= own
    return out


def report(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of counters."""
    slots = lambda name, rows: F.array(*(F.coalesce(F.sum(F.when(rows & (F.col("mask") == m), F.col("n"))), F.lit(0)).cast("long") for m in range(MASKS))).alias(name)
    each = counts.groupBy("part").agg(slots("every", F.lit(True)), slots("goods", F.col("good") == 1), slots("toxics", F.col("toxic") == 1))
    steps = F.from_json(F.lit(json.dumps(_orders())), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    rows = each.select("*", F.inline(steps))
    own, before = F.col("own"), F.col("before")

    def total(numbers: str, of) -> Column:
        """The sum over masks of which ``of`` holds."""
        picked = F.transform(numbers, lambda n, m: F.when(of(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)

    has = lambda m, bits: m.bitwiseAND(bits) != 0
    here = lambda m: has(m, own) & ~has(m, before)
    #: A mask's filter removes it in the orders that have it first of the mask's filters.
    firsts = F.transform("every", lambda n, m: F.when(has(m, own), n * F.floor(F.lit(120) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step", total("every", lambda m: ~has(m, own.bitwiseOR(before))).alias("kept"), total("every", here).alias("removed"),
        total("every", lambda m: has(m, own) & has(m, before)).alias("redundant"), total("every", lambda m: m == own).alias("unique_fails"),
        total("goods", here).alias("good_lost"), total("toxics", here).alias("toxic_lost"), F.aggregate(firsts, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def file_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """A stream over the Parquet files of a table, a file or a folder, in about ``batches`` micro-batches."""
    table = spark.read.parquet(path)
    each = max(1, -(-len(table.inputFiles()) // batches))
    # a pattern, as a stream takes no single file by its plain name
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).parquet(f"{path}*")


def audit(stream: DataFrame, labels: DataFrame, home: str | None = None) -> DataFrame:
    """The report over all rows of a stream; its counters and state stay below ``home``, else in a new shared folder."""
    return report(counters(stream, labels, home or f"{shared_dir(labels.sparkSession)}/{uuid.uuid4().hex}"))
