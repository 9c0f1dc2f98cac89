"""Folders for what queries and operators write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this machine by application, where none is set and the session runs on this machine alone.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below one of this machine in local mode, an error elsewhere."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        home = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return f"{home}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: computed once, its lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` by ``key`` over some tasks for each core, however few bytes they have: for rows that mean work outside Spark, as files do."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *key)
