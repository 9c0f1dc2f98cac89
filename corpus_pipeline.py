"""A corpus pipeline of the operators in ``geotrail.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geotrail.llm import queries as Q
from geotrail.llm.shared import forget, swept, written

#: Stage functions by name, in order.
STAGES = [
    ("quality rules", Q.stage_quality),
    ("n-gram Jaccard join", Q.stage_near_duplicates),
    ("secret scans", Q.stage_secrets),
    ("mixing sources to target weights", Q.stage_mix),
    ("byte-level BPE encoding and decoding", Q.stage_bpe),
]

#: Learned rules and least squares can't be stated in SQL; tests/llm/test_stages.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's rows and its own tables go once the next stage's rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with swept(spark) as keep:
            new = keep(written(stage(spark, docs, sf_dir)))
        if k:
            forget(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
