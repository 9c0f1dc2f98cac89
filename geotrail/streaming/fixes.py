"""Live fixes and readings with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geotrail.functions.geo import BOX
from geotrail.operators.fixes import MAX_MPS
from geotrail.operators.follow import Last, follow
from geotrail.operators.tables import upsert_journeys
from geotrail.sources.commits import CommitLog

FIX = "user_id long, event_id long, ts timestamp, lon double, lat double, speed double, altitude double"
LANDMARK = "user_id long, ts timestamp, name string, lon double, lat double, address string, comment string"


def fix_stream(spark: SparkSession, source: str, schema: str = FIX, max_files: int = 1, kafka: dict[str, str] | None = None) -> DataFrame:
    """Unbounded fixes (or other rows of a schema) from a folder of Parquet files, or from a Kafka topic with JSON values where its reader is on the class path."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).option("subscribe", source).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("f")).select("f.*")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)


def landmark_stream(spark: SparkSession, source: str, max_files: int = 1, kafka: dict[str, str] | None = None) -> DataFrame:
    """Unbounded landmarks that users set, from a folder or topic of their own."""
    return fix_stream(spark, source, LANDMARK, max_files, kafka)


JOURNEY = "kind string, user_id long, day string, time_id long, event_id long, t long, lon double, lat double, distance double, journey_time double"
#: A fix as it waits, and the last of a user's released fixes: its day, when that began, and the last accepted place (0, 0 before the first) and way.
_FIX = {"user_id": np.int64, "event_id": np.int64, "t": np.int64, "day": object, "lon": float, "lat": float}
_LAST = {"user_id": np.int64, "day": object, "first": np.int64, "moved": bool, "lon": float, "lat": float, "t": np.int64, "total": float}
_STATE = ", ".join(f"{part}_{c} array<{ {np.int64: 'long', object: 'string', float: 'double', bool: 'boolean'}[kind] }>" for part, kinds in (("fix", _FIX), ("last", _LAST)) for c, kind in kinds.items())
#: Groups that users are dealt into by hash: calls into Python and states are as many, whatever the number of users; a state is what its users send within ``late``.
GROUPS = 1024
#: Files of a date in a version: tasks would write one in each date otherwise, tasks times dates of them.
FILES = 8
#: Milliseconds after a user's last fix at which the state goes: the day is over then.
IDLE = 24 * 3600 * 1000
#: How the state is kept: on disk, without taking space in advance; a batch's commit writes what changed.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query with its state in ``STORE``; the session's own settings stay as they are."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def released(rows: pd.DataFrame, last: pd.DataFrame, max_mps: float, box: tuple) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The journey and path rows of many users' fixes, each user's in order, after their last ones; and their last ones then.

    Where a user's day goes on, its last accepted fix stands before the others as one that is sure.
    """
    rows = rows.sort_values(["user_id", "t", "event_id", "lon", "lat"], ignore_index=True)
    on = last.merge(rows.drop_duplicates("user_id")[["user_id", "day"]], on=["user_id", "day"])
    rows = pd.concat([on.assign(event_id=0, told=True), rows.assign(first=0, moved=False, total=0.0, told=False)])
    rows = rows.sort_values(["user_id", "told"], ascending=[True, False], kind="stable", ignore_index=True)
    user, days, told = rows["user_id"].to_numpy(), rows["day"].to_numpy(), rows["told"].to_numpy(bool)
    at, x, y = rows["t"].to_numpy(np.int64), rows["lon"].to_numpy(float), rows["lat"].to_numpy(float)
    opens = np.concatenate([[True], (user[1:] != user[:-1]) | (days[1:] != days[:-1])])
    taken, _, step, _ = follow(opens, at, x, y, Last(), max_mps, rows["moved"].to_numpy(bool))
    number = np.cumsum(opens) - 1
    way = pd.Series(step + rows["total"].to_numpy(float)).groupby(number).cumsum().to_numpy()
    begun = np.where(told, rows["first"].to_numpy(np.int64), at)[opens][number]
    opening, inside = np.flatnonzero(opens & ~told), taken & ~told & (box[0] <= x) & (x <= box[1]) & (box[2] <= y) & (y <= box[3])
    path = np.flatnonzero(inside)
    pick, place = np.concatenate([opening, path]), np.arange(len(opening) + len(path)) >= len(opening)
    out = pd.DataFrame({
        "kind": np.where(place, "path", "journey"), "user_id": user[pick], "day": days[pick], "time_id": begun[pick] // 1000, "event_id": rows["event_id"].to_numpy(np.int64)[pick], "t": at[pick], "lon": np.where(place, x[pick], np.nan), "lat": np.where(place, y[pick], np.nan),
        "distance": np.where(place, way[pick], 0.0), "journey_time": np.where(place, (at[pick] - begun[pick]) / 1e6, 0.0),
    })
    end = np.append(np.flatnonzero(user[1:] != user[:-1]), len(user) - 1)
    final = np.maximum.accumulate(np.where(taken, np.arange(len(taken)), -1))[end]
    moved = final >= np.flatnonzero(opens)[number[end]]
    new = {"user_id": user[end], "day": days[end], "first": begun[end], "moved": moved, "lon": np.where(moved, x[final], 0.0), "lat": np.where(moved, y[final], 0.0), "t": at[np.where(moved, final, end)], "total": way[end]}
    return out, pd.concat([last[~last["user_id"].isin(user[end])], pd.DataFrame(new)])


def _journeys(max_mps: float, box: tuple):
    """What fixes and state of a group of users become in a batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Releases what the watermark has passed; no fix that comes later can be earlier.  Sets the timeout for what is left, or for the end of a user's state."""
        kept = iter(state.get if state.exists else [[]] * (len(_FIX) + len(_LAST)))
        rows, last = (pd.DataFrame({c: np.array(next(kept), kind) for c, kind in kinds.items()}) for kinds in (_FIX, _LAST))
        rows = pd.concat([rows, *(f[list(_FIX)].astype(_FIX) for f in frames if len(f))])
        passed = state.getCurrentWatermarkMs()
        due = rows["t"] <= passed * 1000
        if due.any():
            out, last = released(rows[due], last, max_mps, box)
            yield out
        rest, last = rows[~due], last[last["t"] // 1000 + IDLE > passed]
        if len(rest) or len(last):
            state.update(tuple(part[c].tolist() for part in (rest, last) for c in part.columns))
            state.setTimeoutTimestamp(int(min([*-(-rest["t"] // 1000), *(last["t"] // 1000 + IDLE)])))
        elif state.exists:
            state.remove()

    return run


def stream_journeys(fixes: DataFrame, max_mps: float = MAX_MPS, box: tuple = BOX, late: str = "1 hour") -> DataFrame:
    """The rules of ``operators.fixes.journeys`` live: a ``journey`` row where a day begins, a ``path`` row for each accepted fix in the box.

    A path row's distance and journey_time are the journey's so far.  Fixes may come in any order within ``late``: each user's
    wait in the state until the watermark passes them and are then taken in order, so that the rows are those of the
    batch operators.  Fixes behind the watermark are dropped and counted by the query's progress
    (numRowsDroppedByWatermark), as are those without a user, time or place by nobody.  The state is what users send
    within ``late`` and one row each, which goes a day after the user's last fix; it is kept by ``GROUPS`` of users.  Start its queries with ``start``.
    """
    told = fixes.filter("user_id is not null and ts is not null and lon is not null and lat is not null").withWatermark("ts", late)
    told = told.select("user_id", F.coalesce("event_id", F.lit(0)).alias("event_id"), "ts", F.unix_micros("ts").alias("t"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    return told.withColumn("group", F.pmod(F.xxhash64("user_id"), F.lit(GROUPS))).groupBy("group").applyInPandasWithState(_journeys(max_mps, box), JOURNEY, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def journey_updates(rows: DataFrame) -> DataFrame:
    """The last state of each journey among rows of ``stream_journeys``, as journeys(date, user_id, time_id, distance, journey_time)."""
    last = rows.groupBy("user_id", "time_id").agg(F.max_by(F.struct("day", "distance", "journey_time"), F.struct("t", "distance")).alias("r"))
    return last.select(F.to_date("r.day").alias("date"), "user_id", "time_id", "r.distance", "r.journey_time")


def stream_sink(rows: DataFrame, target: str, checkpoint: str):
    """A query that appends path rows and upserts journeys below ``target``; each batch once, and whole or not at all for readers.

    Journeys are stored by date: a batch writes a new version, named by its number, of the dates that it touches, each from
    the date's live version, opens no other date, and then commits.  A commit is one small file that names the live version of
    each date; ``read_journeys`` and ``read_paths`` go by the last one.  A batch that is repeated before its commit writes the
    same folders again, and does nothing after it.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        log = CommitLog(spark, f"{target}/journeys/_log")
        live = log.read(before=number)
        if log.last() == number:
            return
        df = df.persist()
        try:
            df.filter("kind = 'path'").write.mode("overwrite").parquet(f"{target}/path/batch={number}")
            new = journey_updates(df).persist()
            touched = sorted(str(r.date) for r in new.select("date").distinct().collect())  # days of one batch
            if touched:
                old = _stored(spark, target, {day: live[day] for day in touched if day in live})
                told = (new if old is None else upsert_journeys(old, new)).withColumn("version", F.lit(number))
                told = told.repartition("date", F.pmod(F.xxhash64("user_id"), F.lit(FILES)))
                told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "version").parquet(f"{target}/journeys")
            log.write(number, live | dict.fromkeys(touched, number))
            log.drop(lambda day, version: f"{target}/journeys/date={day}/version={version}")
            new.unpersist()
        finally:
            df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _stored(spark: SparkSession, target: str, live: dict[str, int]) -> DataFrame | None:
    paths = [f"{target}/journeys/date={day}/version={version}" for day, version in live.items()]
    if not paths:
        return None
    schema = "user_id long, time_id long, distance double, journey_time double, date date, version int"
    return spark.read.schema(schema).option("basePath", f"{target}/journeys").parquet(*paths).select("date", "user_id", "time_id", "distance", "journey_time")


def read_journeys(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """Journeys (date, user_id, time_id, distance, journey_time) that ``stream_sink`` has committed; with ``before`` as an earlier batch left them."""
    return _stored(spark, target, CommitLog(spark, f"{target}/journeys/_log").read(before))


def read_paths(spark: SparkSession, target: str) -> DataFrame | None:
    """The path rows of all committed batches."""
    last = CommitLog(spark, f"{target}/journeys/_log").last()
    return None if last is None else spark.read.parquet(f"{target}/path").filter(F.col("batch") <= last).drop("batch", "kind")


def landmark_sink(landmarks: DataFrame, target: str, checkpoint: str):
    """A query that appends landmarks as landmark(date_time, user_id, name, lon, lat, address, comment), by day, each once."""
    rows = landmarks.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_time"), "user_id", "name", "lon", "lat", "address", "comment", F.to_date("ts").alias("day"))
    return rows.writeStream.format("parquet").partitionBy("day").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_daily(fixes: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Fixes by user and tumbling window (a day, or a minute for rates); what is later than ``late`` is dropped."""
    told = fixes.withWatermark("ts", late).groupBy("user_id", F.window("ts", length).alias("w")).agg(F.count("*").alias("fixes"))
    return told.select("user_id", F.col("w.start").alias("start"), "fixes")


def stream_obd_rate(readings: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Replies a second."""
    told = readings.withWatermark("ts", late).groupBy(F.window("ts", "1 second").alias("w")).agg(F.count("*").alias("replies"))
    return told.select(F.col("w.start").alias("start"), "replies")


def stream_obd_mean(readings: DataFrame, pid: int, length: str = "10 seconds", slide: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Sliding mean of one PID's readings."""
    told = readings.filter(F.col("pid") == pid).withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w")).agg(F.avg("value").alias("mean"))
    return told.select(F.col("w.start").alias("start"), "mean")


def stream_drives(fixes: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Drives: a user's fixes without a silence of ``gap``."""
    told = fixes.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("fixes"))
    return told.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "fixes")
