"""Vehicle fixes (user_id, ts, lon, lat, ...): cleaning, journeys, distances and headings.

``ts`` is a timestamp; a day is a day of the session's time zone.  Where fixes share a time, ``event_id``
(if there) and then the position order them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.geo import BOX, haversine_m
from geotrail.operators.follow import Last, follow

#: Metres a second above which a fix is an outlier.
MAX_MPS = 100.0


def in_box(lon: Column, lat: Column, box: tuple = BOX) -> Column:
    return lon.between(box[0], box[1]) & lat.between(box[2], box[3])


def geofence(df: DataFrame, box: tuple = BOX) -> DataFrame:
    """Fixes inside an inclusive box (least and greatest longitude, then latitude)."""
    return df.filter(in_box(F.col("lon"), F.col("lat"), box))


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("ts"))


def _order(df: DataFrame) -> list[str]:
    return ["ts", *(["event_id"] if "event_id" in df.columns else []), "lon", "lat"]


def _daily(df: DataFrame):
    return Window.partitionBy("user_id", "day").orderBy(*_order(df))


def drop_repeats(df: DataFrame) -> DataFrame:
    """Drops a fix at the place of the one before it, by user and day."""
    df = with_day(df)
    w = _daily(df)
    seen = df.withColumn("__lon", F.lag("lon").over(w)).withColumn("__lat", F.lag("lat").over(w))
    same = F.coalesce((F.col("lon") == F.col("__lon")) & (F.col("lat") == F.col("__lat")), F.lit(False))
    return seen.filter(~same).drop("__lon", "__lat", "day")


def drop_short_tracks(df: DataFrame, min_points: int = 100, key: str = "file") -> DataFrame:
    """Rows of tracks with more than ``min_points`` rows; counts are aggregated before they are shuffled."""
    long = df.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > min_points).select(key)
    return df.join(long, key, "left_semi")


def _fold(max_mps: float, box: tuple):
    """The rules for one fix after another; every outcome is a count, an accepted one also a distance."""

    def step(s: Column, f: Column) -> Column:
        moved = F.coalesce(s["moved"], F.lit(False))
        away = F.when(moved, haversine_m(s["lon"], s["lat"], f["lon"], f["lat"])).otherwise(0.0)
        repeat = (f["lon"] == s["lon"]) & (f["lat"] == s["lat"])
        fast = ~repeat & moved & (away > max_mps * ((f["t"] - s["t"]) / 1e6))
        taken = ~repeat & ~fast
        inside = taken & in_box(f["lon"], f["lat"], box)
        total = s["total"] + F.when(taken, away).otherwise(0.0)
        count = lambda c: c.cast("int")
        pick = lambda c, a, b: F.when(c, a).otherwise(b)
        return F.struct(
            (moved | taken).alias("moved"), pick(taken, f["lon"], s["lon"]).alias("lon"), pick(taken, f["lat"], s["lat"]).alias("lat"), pick(taken, f["t"], s["t"]).alias("t"),
            total.alias("total"), pick(inside, total, s["distance"]).alias("distance"), pick(inside, f["t"], s["end"]).alias("end"),
            (s["accepted"] + count(taken)).alias("accepted"), (s["repeated"] + count(repeat)).alias("repeated"), (s["fast"] + count(fast)).alias("fast"), (s["outside"] + count(taken & ~inside)).alias("outside"),
            inside.alias("inside"),
        )

    return step


def _start(first: Column) -> Column:
    zero = lambda name, kind: F.lit(0).cast(kind).alias(name)
    return F.struct(
        F.lit(False).alias("moved"), zero("lon", "double"), zero("lat", "double"), zero("t", "long"), zero("total", "double"), zero("distance", "double"), first.alias("end"),
        *(zero(n, "int") for n in ("accepted", "repeated", "fast", "outside")), F.lit(False).alias("inside"),
    )


def _days(df: DataFrame, extra: list[str]) -> DataFrame:
    """One row for each user and day with its fixes in order."""
    tie = F.col("event_id") if "event_id" in df.columns else F.lit(0).cast("long")
    fix = F.struct(F.unix_micros("ts").alias("t"), tie.alias("tie"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), *extra)
    return with_day(df).groupBy("user_id", "day").agg(F.sort_array(F.collect_list(fix)).alias("fixes"))


def journeys(df: DataFrame, max_mps: float = MAX_MPS, box: tuple = BOX) -> DataFrame:
    """One journey for each user and day: first time, distance, duration, and what became of the fixes.

    In order of time: a fix at the last accepted place is ignored (as is a first one at exactly 0, 0); one
    that would need more than ``max_mps`` from there is rejected and moves nothing; others are accepted and
    add to the way, also outside the box, but distance and duration are those of the last accepted fix
    inside it.  A user's day stands in one row, so the fold needs no second shuffle.
    """
    first = F.col("fixes")[0]["t"]
    told = _days(df, []).select("user_id", "day", first.alias("__first"), F.aggregate("fixes", _start(first), _fold(max_mps, box)).alias("s"))
    return told.select(
        "user_id", "day", F.floor(F.col("__first") / 1000).cast("long").alias("time_id"), F.col("s.distance").alias("distance"), ((F.col("s.end") - F.col("__first")) / 1e6).alias("journey_time"),
        F.col("s.accepted").alias("accepted"), F.col("s.repeated").alias("repeated"), F.col("s.fast").alias("fast"), F.col("s.outside").alias("outside"),
    )


def _followed(df: DataFrame, max_mps: float, box: tuple, extra: list[str]) -> DataFrame:
    """The fixes (user_id, day, event_id, t, lon, lat, extra columns) of each user and day in order, with what the rules of ``journeys`` say.

    Adds ``first`` (the day's first time), ``inside`` (accepted, in the box), ``fast`` and ``way``.  Rows come sorted
    and only the last accepted fix is carried from one batch to the next, so time grows with the rows and a day of any
    length needs no memory of its own.  A fix without a time or place is neither accepted nor fast.
    """
    tie = F.col("event_id") if "event_id" in df.columns else F.lit(0).cast("long")
    rows = with_day(df).select("user_id", "day", tie.alias("event_id"), F.unix_micros("ts").alias("t"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), *extra)
    order = ["user_id", "day", "t", "event_id", "lon", "lat"]
    dealt = rows.repartition("user_id", "day").sortWithinPartitions(*order)
    west, east, south, north = box

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, first = Last(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # days are numbered from the one that the batch before ended with, 0
            edge = np.zeros(batch.num_rows, bool)
            for key in (batch.column(0), batch.column(1)):
                edge[1:] |= _differ(key.slice(1), key.slice(0, batch.num_rows - 1))
            edge[0] = before is None or before != (batch.column(0)[0], batch.column(1)[0])
            day = np.cumsum(edge)
            t, lon, lat = (batch.column(k) for k in (3, 4, 5))
            opening = np.flatnonzero(edge)
            firsts = t.take(pa.array(opening)).to_pylist()
            fine = np.flatnonzero(t.is_valid().to_numpy(False) & lon.is_valid().to_numpy(False) & lat.is_valid().to_numpy(False))
            if edge[0]:
                last = Last()
            x, y = lon.to_numpy(False)[fine], lat.to_numpy(False)[fine]
            taken, fast, step = (np.zeros(batch.num_rows, k) for k in (bool, bool, float))
            taken[fine], fast[fine], step[fine], _ = follow(np.diff(day[fine], prepend=0) > 0, t.take(pa.array(fine)).to_numpy(), x, y, last, max_mps)
            so_far = np.cumsum(step)
            base = np.concatenate([[-last.total], so_far[opening] - step[opening]])
            way = so_far - base[day]
            inside = taken.copy()
            inside[fine] &= (west <= x) & (x <= east) & (south <= y) & (y <= north)
            since = pa.array([first, *firsts], pa.int64()).take(pa.array(day))
            yield pa.RecordBatch.from_arrays([*batch.columns, since, pa.array(inside), pa.array(fast), pa.array(way)], names=[*batch.schema.names, "first", "inside", "fast", "way"])
            before, first = (batch.column(0)[-1], batch.column(1)[-1]), since[-1].as_py()
            if not len(fine) or day[fine[-1]] < day[-1]:  # the last day here has no whole fix yet
                last = last if not edge.any() else Last()
            last.total = float(way[-1])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return dealt.mapInArrow(run, f"{kinds}, first long, inside boolean, fast boolean, way double")


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays aren't equal; nulls are equal to each other."""
    null = pc.xor(a.is_null(), b.is_null()).to_numpy(False)
    return pc.fill_null(pc.not_equal(a, b), False).to_numpy(False) | null


def clean_path(df: DataFrame, max_mps: float = MAX_MPS, box: tuple = BOX) -> DataFrame:
    """The accepted fixes inside the box with the way so far: (user_id, day, journey_time_id, event_id, ts, lon, lat, ...)."""
    extra = [c for c in ("speed", "altitude") if c in df.columns]
    told = _followed(df, max_mps, box, extra).filter("inside")
    return told.select("user_id", "day", F.floor(F.col("first") / 1000).cast("long").alias("journey_time_id"), "event_id", F.timestamp_micros("t").alias("ts"), "lon", "lat", *extra, "way")


def speed_outliers(df: DataFrame, max_mps: float = MAX_MPS) -> DataFrame:
    """(user_id, day, event_id, outlier): whether a fix is too fast from the last accepted one."""
    return _followed(df, max_mps, BOX, []).select("user_id", "day", "event_id", F.col("fast").alias("outlier"))


def segments(df: DataFrame, columns: tuple = ("x", "y"), key: str = "file", order: str = "line") -> DataFrame:
    """Consecutive points of each track as (key, line, x0, y0, x1, y1): the line is the first point's."""
    w = Window.partitionBy(key).orderBy(order)
    ends = [F.lead(c).over(w).alias(f"{c}1") for c in columns]
    pairs = df.select(key, order, *(F.col(c).alias(f"{c}0") for c in columns), *ends, F.lead(order).over(w).alias("__next"))
    return pairs.filter(F.col("__next").isNotNull()).drop("__next")


def running_distance(df: DataFrame) -> DataFrame:
    """Adds ``way``: metres so far by user and day, without an outlier rule."""
    df = with_day(df)
    w = _daily(df)
    step = F.coalesce(haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat"), F.lit(0.0))
    df = df.withColumn("__step", step)
    return df.withColumn("way", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__step", "day")


def last_positions(df: DataFrame, n: int = 20) -> DataFrame:
    """The last n fixes of each user, ``place`` 1 being the last; only n rows a user and task are shuffled."""
    late = [F.desc(c) for c in _order(df)]
    return df.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*late))).filter(F.col("place") <= n)


def average_heading(df: DataFrame, n: int) -> DataFrame:
    """Adds ``bearing`` of the step to each fix and ``heading``, the mean direction of the last n steps; degrees from north."""
    df = with_day(df)
    w = _daily(df)
    lat0, lat1 = F.radians(F.lag("lat").over(w)), F.radians("lat")
    turn = F.radians(F.col("lon") - F.lag("lon").over(w))
    bearing = F.atan2(F.sin(turn) * F.cos(lat1), F.cos(lat0) * F.sin(lat1) - F.sin(lat0) * F.cos(lat1) * F.cos(turn))
    df = df.withColumn("__b", bearing)
    last = w.rowsBetween(-(n - 1), 0)
    mean = F.atan2(F.avg(F.sin("__b")).over(last), F.avg(F.cos("__b")).over(last))
    turned = lambda c: F.pmod(F.degrees(c) + 360.0, F.lit(360.0))
    return df.withColumn("heading", turned(mean)).withColumn("bearing", turned(F.col("__b"))).drop("__b", "day")


def order_track(df: DataFrame) -> DataFrame:
    """Rows of a file together and in the order of their lines."""
    return df.repartition("file").sortWithinPartitions("file", "line")


def union_tracks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Logs of three columns with logs of five."""
    return old.unionByName(new, allowMissingColumns=True)
