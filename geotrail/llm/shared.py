"""Intermediate tables in the folder that all machines of a cluster share, and small helpers for plans."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of this machine by application, where none is set and the session runs on this machine alone.
_LOCAL: dict[str, str] = {}
#: Folders of the tables of ``written`` that are still there, and which table is where.
_FOLDERS: dict[str, None] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder of this machine in local mode and an error elsewhere."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-')}")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _FOLDERS[path] = None
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _FOLDERS.pop(folder, None)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later step reads."""
    for df in tables:
        _delete(df.sparkSession, _PATHS.pop(df))


@contextmanager
def swept(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables of ``written`` made inside, but for those handed to what it gives."""
    before, kept = set(_FOLDERS), []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    yield keep
    left = {_PATHS[t] for t in kept}
    for folder in [f for f in _FOLDERS if f not in before and f not in left]:
        _delete(spark, folder)


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns that the optimizer can't write out again where later steps name them.

    A filter or a lambda that names an expensive column would otherwise get its whole expression, once for
    each element.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def add(x: Column, y: Column) -> Column:
    return x + y


def larger(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def block_folds(numbers: Column, size: int, fold: Callable[[Column, Column], Column] = add) -> Column:
    """The fold from 0 of each block of ``size`` numbers of an array."""
    n = F.floor((F.size(numbers) + size - 1) / size).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(F.slice(numbers, b * size + 1, F.lit(size)), F.lit(0), fold))
    return F.when(n > 0, each).otherwise(F.array().cast("array<int>"))


def folds_before(numbers: Column, blocks: Column, size: int, fold: Callable[[Column, Column], Column] = add) -> Column:
    """For each number of an array the fold from 0 of those before it: by whole blocks (``block_folds``), then the rest."""

    def before(_: Column, i: Column) -> Column:
        whole = F.floor(i / size).cast("int")
        return F.aggregate(F.slice(numbers, whole * size + 1, i - whole * size), F.aggregate(F.slice(blocks, F.lit(1), whole), F.lit(0), fold), fold)

    return F.transform(numbers, before)


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: Column, most: int = 4096, least: int = 4096) -> DataFrame:
    """``rows`` joined to ``keyed`` (one row a key, with ``n``, its number of rows); a key with many rows is dealt over many tasks.

    Keys with more than 1/``most`` of all rows, fewer than ``most`` by that, are broadcast with their number of
    parts; their rows go to a part by a hash of ``by``, and their one row on the other side to every part.
    """
    limit = max((keyed.agg(F.sum("n")).first()[0] or 0) // most, least)
    hot = F.broadcast(keyed.filter(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    right = keyed.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"]).drop("__part")


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and ``__row``, a struct of all columns: no other name can clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"))
