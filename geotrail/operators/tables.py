"""Work lists and journey tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_files(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files that history (file, is_complete, line, and ``place`` for its order) doesn't record as complete; a name's first row decides."""
    first = history.groupBy("file").agg(F.min_by("is_complete", "place").alias("done"))
    return files.join(first.filter("done").select("file"), "file", "left_anti")


def upsert_journeys(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Journeys (date, user_id, time_id, distance, journey_time) with distance and time of ``updates`` where it has the journey; new ones added."""
    key = ["user_id", "time_id"]
    both = target.alias("t").join(updates.alias("u"), key, "full_outer")
    new = lambda c: F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")).alias(c)
    return both.select(F.coalesce("t.date", "u.date").alias("date"), *key, new("distance"), new("journey_time"))
