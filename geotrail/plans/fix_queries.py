"""Queries over fixes: cleaning, journeys, windows, time forms, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions import geo
from geotrail.functions.sensors import time_formats
from geotrail.operators import fixes as fx
from geotrail.operators.tables import pending_files, upsert_journeys
from geotrail.plans import adapters as ad
from geotrail.plans.catalog import query
from geotrail.sources.scratch import scratch
from geotrail.sources import text
from geotrail.streaming import fixes as live

_DAY = "CAST(ts AS DATE)"
_US = "epoch_us(ts)"
HAVERSINE = "2e0 * 6371000e0 * atan2(sqrt({a}), sqrt(greatest(1e0 - ({a}), 0e0)))"


def haversine(lon0: str, lat0: str, lon1: str, lat1: str) -> str:
    half = lambda d: f"sin(({d}) / 2e0) * sin(({d}) / 2e0)"
    a = f"({half(f'radians({lat1}) - radians({lat0})')} + cos(radians({lat0})) * cos(radians({lat1})) * {half(f'radians({lon1}) - radians({lon0})')})"
    return HAVERSINE.format(a=a)


_FOLD = f"""
WITH RECURSIVE o AS (
  SELECT *, {_DAY} AS day, {_US} AS t, row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id, lon, lat) AS k FROM ({ad.FIXES}) f),
s AS (
  SELECT user_id, day, event_id, lon AS flon, lat AS flat, t AS first, t AS ft, k, lon, lat, t, 0e0 AS total, true AS taken, false AS fast,
    lon BETWEEN 123e0 AND 133e0 AND lat BETWEEN 31e0 AND 39e0 AS inside FROM o WHERE k = 1
  UNION ALL

    SELECT user_id, day, event_id, flon, flat, first, ft, k, CASE WHEN taken THEN flon ELSE lon END, CASE WHEN taken THEN flat ELSE lat END, CASE WHEN taken THEN ft ELSE t END,
    total + CASE WHEN taken THEN away ELSE 0e0 END, taken, fast, taken AND flon BETWEEN 123e0 AND 133e0 AND flat BETWEEN 31e0 AND 39e0
  FROM (SELECT *, NOT same AND away <= 100e0 * ((ft - t) / 1e6) AS taken, NOT same AND away > 100e0 * ((ft - t) / 1e6) AS fast FROM (
    SELECT s.user_id, s.day, o.event_id, o.lon AS flon, o.lat AS flat, s.first, o.t AS ft, o.k, s.lon, s.lat, s.t, s.total,
      o.lon = s.lon AND o.lat = s.lat AS same, {haversine("s.lon", "s.lat", "o.lon", "o.lat")} AS away
    FROM s JOIN o ON o.user_id = s.user_id AND o.day = s.day AND o.k = s.k + 1) a) b)
"""


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.fixes(spark, sf_dir)


def _ms(c: str) -> str:
    return f"CAST(epoch_us({c}) // 1000 AS BIGINT)"


@query(f"""{_FOLD}
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CAST(first // 1000 AS BIGINT) AS time_id,
  round(coalesce(arg_max(total, k) FILTER (inside), 0e0), 3) AS distance, round(coalesce((arg_max(ft, k) FILTER (inside) - first) / 1e6, 0e0), 3) AS journey_time,
  CAST(count_if(taken) AS BIGINT) AS accepted, CAST(count_if(NOT taken AND NOT fast) AS BIGINT) AS repeated, CAST(count_if(fast) AS BIGINT) AS fast, CAST(count_if(taken AND NOT inside) AS BIGINT) AS outside
FROM s GROUP BY user_id, day, first""")
def a1_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fx.journeys(_fixes(spark, sf_dir))
    count = lambda c: F.col(c).cast("long").alias(c)
    return told.select("user_id", F.col("day").cast("string").alias("day"), "time_id", F.round("distance", 3).alias("distance"), F.round("journey_time", 3).alias("journey_time"), *map(count, ("accepted", "repeated", "fast", "outside")))


@query(f"""{_FOLD}
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CAST(first // 1000 AS BIGINT) AS journey_time_id, event_id, CAST(ft // 1000 AS BIGINT) AS ms, round(flon, 6) AS lon, round(flat, 6) AS lat, round(total, 3) AS way
  FROM s WHERE inside""")
def a2_clean_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fx.clean_path(_fixes(spark, sf_dir))
    return told.select("user_id", F.col("day").cast("string").alias("day"), "journey_time_id", "event_id", F.unix_millis("ts").alias("ms"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("way", 3).alias("way"))


@query(f"SELECT event_id, user_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({ad.FIXES}) f WHERE lon BETWEEN 123e0 AND 133e0 AND lat BETWEEN 31e0 AND 39e0")
def f1_geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.geofence(_fixes(spark, sf_dir)).select("event_id", "user_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""SELECT event_id, user_id FROM (SELECT *, lag(lon) OVER w AS a, lag(lat) OVER w AS b FROM ({ad.FIXES}) f
  WINDOW w AS (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id)) q
WHERE NOT coalesce(a = lon AND b = lat, false)""")
def f2_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.drop_repeats(_fixes(spark, sf_dir)).select("event_id", "user_id")


@query(f"{_FOLD} SELECT user_id, event_id, fast AS outlier FROM s")
def f3_speed_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.speed_outliers(_fixes(spark, sf_dir)).select("user_id", "event_id", "outlier")


@query("""SELECT l_orderkey AS file, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5""")
def f4_drop_short_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("file"))
    return fx.drop_short_tracks(rows, 5).groupBy("file").agg(F.count("*").alias("n"))


@query(f"""SELECT file, line, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM (
SELECT file, line, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ({ad.PLACED}) p WINDOW w AS (PARTITION BY file ORDER BY line)) q
  WHERE x1 IS NOT NULL""")
def w1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.segments(ad.tracks(spark, sf_dir)).select("file", "line", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"""SELECT event_id, round(sum(step) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS way FROM (
SELECT *, {_DAY} AS day, coalesce({haversine("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")}, 0e0) AS step FROM ({ad.FIXES}) f
  WINDOW w AS (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id)) q""")
def w2_running_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.running_distance(_fixes(spark, sf_dir)).select("event_id", F.round("way", 3).alias("way"))


@query(f"""SELECT user_id, event_id, CAST(place AS BIGINT) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM ({ad.FIXES}) f) q WHERE place <= 20""")
def w3_last_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.last_positions(_fixes(spark, sf_dir)).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH b AS (SELECT *, {_DAY} AS day, atan2(sin(turn) * cos(lat1), cos(lat0) * sin(lat1) - sin(lat0) * cos(lat1) * cos(turn)) AS b FROM (
 SELECT *, radians(lag(lat) OVER w) AS lat0, radians(lat) AS lat1, radians(lon - lag(lon) OVER w) AS turn FROM ({ad.FIXES}) f
    WINDOW w AS (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id)) q),
c AS (SELECT event_id, b, avg(sin(b)) OVER w AS s, avg(cos(b)) OVER w AS c FROM b
  WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS 4 PRECEDING))
SELECT event_id, round(cos(b), 6) + 0e0 AS bearing_cos, round(sin(b), 6) + 0e0 AS bearing_sin, CASE WHEN s * s + c * c > 1e-12 THEN round(c / sqrt(s * s + c * c), 5) + 0e0 END AS heading_cos,
  CASE WHEN s * s + c * c > 1e-12 THEN round(s / sqrt(s * s + c * c), 5) + 0e0 END AS heading_sin FROM c""")
def w6_average_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fx.average_heading(_fixes(spark, sf_dir), 5)
    day = fx.with_day(told)
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(-4, 0)
    b = F.radians("bearing")
    length = F.avg(F.sin(b)).over(w) * F.avg(F.sin(b)).over(w) + F.avg(F.cos(b)).over(w) * F.avg(F.cos(b)).over(w)
    heading, whole = F.radians("heading"), lambda c, digits: F.round(c, digits) + 0.0
    return day.select(
        "event_id", whole(F.cos(b), 6).alias("bearing_cos"), whole(F.sin(b), 6).alias("bearing_sin"),
        *(F.when(length > 1e-12, whole(f(heading), 5)).alias(n) for f, n in ((F.cos, "heading_cos"), (F.sin, "heading_sin"))),
    )


@query(f"SELECT file, line, round(x, 6) AS x, round(y, 6) AS y FROM ({ad.PLACED}) p")
def o1_order_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.order_track(ad.tracks(spark, sf_dir)).select("file", "line", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"SELECT event_id, round(lon, 6) AS lon, CASE WHEN event_id % 2 = 0 THEN NULL ELSE speed END AS speed FROM ({ad.FIXES}) f")
def o2_union_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixes(spark, sf_dir).withColumn("lon", F.round("lon", 6))
    old, new = rows.filter("event_id % 2 = 0").select("event_id", "lon"), rows.filter("event_id % 2 = 1").select("event_id", "lon", "speed")
    return fx.union_tracks(old, new)


@query(f"SELECT a.event_id, round({haversine('a.lon', 'a.lat', '127e0', '37.5e0')}, 3) AS metres FROM ({ad.FIXES}) a")
def m1_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixes(spark, sf_dir).select("event_id", F.round(geo.haversine_m("lon", "lat", 127.0, 37.5), 3).alias("metres"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seconds, strftime(ts, '%Y-%m-%d-%H-%M-%S-%g') AS log,
CAST(strftime(ts, '%Y%m%d%H%M%S%g') AS BIGINT) AS packed FROM events""")
def m21_time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixes(spark, sf_dir).select("event_id", time_formats("ts").alias("t")).select("event_id", "t.*")


@query(f"""SELECT {_ms('ts')} AS ms, round(lon, 6) AS lon, round(lat, 6) AS lat, CASE WHEN event_id % 3 = 0 THEN NULL ELSE speed END AS speed, false AS bad
  FROM ({ad.FIXES}) f
UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM events WHERE event_id % 5 = 0""")
def s1_s2_path_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes written as logs of 3 or 5 columns by day, and read again; every fifth stands there once more as a cut line."""
    rows, home = _fixes(spark, sf_dir), scratch(spark)
    rows = rows.withColumn("speed", F.when(F.col("event_id") % 3 > 0, F.col("speed")))
    text.write_path_log(rows, home)
    cut = F.concat(F.substring(text.path_line(rows), 1, 30), F.lit(","))
    rows.filter("event_id % 5 = 0").select(cut.alias("value"), F.date_format("ts", "yyyyMMdd").alias("day")).write.mode("append").partitionBy("day").text(home)
    bad = F.col("_bad").isNotNull()
    good = lambda c: F.when(~bad, c)
    told = text.read_path_log(spark, home, keep_bad=True)
    return told.select(good(F.unix_millis("ts")).alias("ms"), good(F.round("lon", 6)).alias("lon"), good(F.round("lat", 6)).alias("lat"), good(F.col("speed")).alias("speed"), bad.alias("bad"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a work history of their customers' files, in the order of their keys: written and read again."""
    orders, home = spark.read.parquet(f"{sf_dir}/orders.parquet"), scratch(spark)
    rows = orders.select(F.concat(F.lit("file"), "o_custkey").alias("file"), (F.col("o_orderstatus") == "F").alias("is_complete"), (F.col("o_orderkey") % 100).alias("line"), "o_orderkey")
    text.write_history(rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"), home)
    return text.read_history(spark, home)


@query("SELECT 'file' || o_custkey AS file, o_orderstatus = 'F' AS is_complete, CAST(o_orderkey % 100 AS INT) AS line FROM orders")
def s15_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("file", "is_complete", "line")


@query("""WITH h AS (SELECT 'file' || o_custkey AS file, arg_min(o_orderstatus = 'F', o_orderkey) AS done FROM orders GROUP BY 1)
SELECT 'file' || c_custkey AS file FROM customer WHERE 'file' || c_custkey NOT IN (SELECT file FROM h WHERE done)""")
def j1_pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("file"), "c_custkey").alias("file"))
    return pending_files(files, _history(spark, sf_dir))


@query("""WITH t AS (SELECT o_custkey AS user_id, o_orderkey AS time_id, o_totalprice AS d FROM orders WHERE o_orderkey % 3 < 2),
  u AS (SELECT o_custkey AS user_id, o_orderkey AS time_id, o_totalprice * 2 AS d FROM orders WHERE o_orderkey % 3 > 0)
SELECT user_id, time_id, coalesce(u.d, t.d) AS distance FROM t FULL JOIN u USING (user_id, time_id)""")
def j10_upsert_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    row = lambda times: orders.select(F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("time_id"), (F.col("o_totalprice") * times).alias("distance"), F.lit(1.0).alias("journey_time"))
    return upsert_journeys(row(1).filter("time_id % 3 < 2"), row(2).filter("time_id % 3 > 0")).select("user_id", "time_id", "distance")


def spans(rows: DataFrame, parts: int = 3, shuffled_s: int = 0) -> list[DataFrame]:
    """Rows in equal spans of time, in order; or of arrival, up to ``shuffled_s`` seconds after their time."""
    arrival = F.unix_micros("ts") + (F.pmod(F.xxhash64("event_id"), F.lit(shuffled_s)) * 1_000_000 if shuffled_s else F.lit(0))
    low, high = rows.agg(F.min(arrival), F.max(arrival)).first()
    if low is None:
        return [rows]
    part = F.least(F.floor((arrival - low) / max(1.0, (high - low) / parts)), F.lit(parts - 1))
    return [rows.filter(part == k) for k in range(parts)]


def closed(rows: DataFrame) -> DataFrame:
    """Fixes and one of user -1, two days after the last: a stream's watermark passes all others."""
    end = rows.agg(F.max("ts").alias("ts")).filter("ts is not null")
    last = end.select(*(F.col("ts") + F.expr("interval 2 days") if c == "ts" else F.lit(0.0 if t == "double" else -1).cast(t).alias(c) for c, t in rows.dtypes))
    return rows.unionByName(last.toDF(*rows.columns))


def _streamed(spark: SparkSession, rows: DataFrame, build, parts: int = 3, shuffled_s: int = 0) -> DataFrame:
    """Streams rows through ``build`` into a table, a span after the other, and reads that."""
    home = scratch(spark)
    for part in spans(rows, parts, shuffled_s):
        part.write.mode("append").parquet(f"{home}/in")
        out = build(spark.readStream.schema(rows.schema).parquet(f"{home}/in"))
        writer = out.writeStream.format("parquet").option("checkpointLocation", f"{home}/check").option("path", f"{home}/out").outputMode("append").trigger(availableNow=True)
        live.start(writer, spark).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{home}/out")


@query(f"""{_FOLD}
SELECT user_id, CAST(first // 1000 AS BIGINT) AS time_id, round(coalesce(arg_max(total, k) FILTER (inside), 0e0), 3) AS distance, round(coalesce((arg_max(ft, k) FILTER (inside) - first) / 1e6, 0e0), 3) AS journey_time
  FROM s GROUP BY user_id, day, first""")
def x1_stream_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys from a stream of all fixes, which come in five batches up to 50 minutes after their time.

    A last fix of no user's, two days on, moves the watermark over all others.
    """
    rows = _streamed(spark, closed(_fixes(spark, sf_dir)), live.stream_journeys, 5, 3000)
    return live.journey_updates(rows).select("user_id", "time_id", F.round("distance", 3).alias("distance"), F.round("journey_time", 3).alias("journey_time"))


@query("""WITH m AS (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) AS upto FROM events)
SELECT user_id, CAST(epoch_ms(date_trunc('day', ts)) AS BIGINT) AS start_ms, count(*) AS fixes FROM events, m WHERE date_trunc('day', ts) < upto
  GROUP BY 1, 2""")
def x3_stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed days of a stream of all fixes: the last day stays open behind the watermark."""
    return _streamed(spark, _fixes(spark, sf_dir), live.stream_daily).select("user_id", F.unix_millis("start").alias("start_ms"), "fixes")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS upto FROM events)
SELECT user_id, CAST(epoch_ms(date_trunc('minute', ts)) AS BIGINT) AS start_ms, count(*) AS fixes FROM events, m WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= upto
  GROUP BY 1, 2""")
def x3_stream_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by closed minute, of fixes that come up to 50 minutes after their time."""
    rows = _streamed(spark, _fixes(spark, sf_dir), lambda s: live.stream_daily(s, length="1 minute"), 3, 3000)
    return rows.select("user_id", F.unix_millis("start").alias("start_ms"), "fixes")


@query("""WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS begins FROM events),
r AS (SELECT user_id, ts, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
  m AS (SELECT max(ts) - INTERVAL 1 HOUR AS upto FROM events)
SELECT user_id, CAST(epoch_us(min(ts)) // 1000 AS BIGINT) AS start_ms, count(*) AS fixes FROM r, m GROUP BY user_id, k, upto
  HAVING max(ts) + INTERVAL 30 MINUTE <= upto""")
def x5_stream_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, _fixes(spark, sf_dir), live.stream_drives).select("user_id", F.unix_millis("start").alias("start_ms"), "fixes")
