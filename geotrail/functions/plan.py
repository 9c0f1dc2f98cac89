"""Helpers that keep plans as they are meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns that are computed once: filters and later expressions don't write them out again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
