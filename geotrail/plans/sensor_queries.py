"""Queries over NMEA and OBD-II logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.sensors import FORMULAS, nmea_checksum
from geotrail.operators import sensors as sn
from geotrail.plans import adapters as ad
from geotrail.plans.catalog import query
from geotrail.plans.fix_queries import _streamed
from geotrail.sources.scratch import scratch
from geotrail.sources import text
from geotrail.streaming import fixes as live

_PIDS = """SELECT l_orderkey AS k, l_linenumber AS n, ts, l_partkey, q, 4 + l_partkey % 96 AS pid, k % 256 AS v, (k % 256) * 256 + s % 256 AS w
  FROM (SELECT l_orderkey, l_linenumber, l_shipdate AS ts, l_partkey, l_quantity AS q, l_orderkey AS k, l_suppkey AS s FROM lineitem) t WHERE q < 49"""
#: The formulas as DuckDB writes them: // divides towards zero.
_VALUE = "CASE " + " ".join(f"WHEN pid IN ({', '.join(str(int(p, 16)) for p in pids)}) THEN {formula.replace('/', '//')}" for formula, pids in FORMULAS.items()) + " ELSE v END"


@query(f"SELECT CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CAST(pid AS INT) AS pid, CAST({_VALUE} AS INT) AS value FROM ({_PIDS}) p")
def m22_u2_decode_obd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.decode_obd(ad.obd_lines(spark, sf_dir)).select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "pid", "value")


@query(f"""SELECT CAST(pid AS INT) AS pid, count(*) AS replies, CAST(min({_VALUE}) AS INT) AS low, round(avg({_VALUE}), 6) AS mean, CAST(max({_VALUE}) AS INT) AS high
  FROM ({_PIDS}) p GROUP BY pid
UNION ALL SELECT -1, count(*) FILTER (l_quantity = 50), NULL, NULL, NULL FROM lineitem""")
def a11_obd_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.obd_stats(ad.obd_lines(spark, sf_dir)).select("pid", "replies", "low", F.round("mean", 6).alias("mean"), "high")


#: Fixes at whole 1/10000 minutes as GGA and RMC sentences of their user's log, at whole hours of their day, so that clock times recur.
#: Each 7th event has a GGA and each 11th an RMC sentence with a wrong checksum.
_MIN = "CAST(floor(({c} - floor({c})) * 600000e0) AS BIGINT)"


def nmea_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.fixes(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    part = lambda c, width: F.format_string(f"%0{width}d%02d.%04d", F.floor(c), F.floor((F.col(c) - F.floor(c)) * 600000 / 10000), F.floor((F.col(c) - F.floor(c)) * 600000) % 10000)
    clock = F.date_format("ts", "HHmmss.S")
    rmc = F.concat(F.lit("GPRMC,"), clock, F.lit(",A,"), part("lat", 2), F.lit(",N,"), part("lon", 3), F.lit(",E,"), F.format_string("%.2f", "speed"), F.format_string(",%d.0,", F.col("event_id") % 360), F.date_format("ts", "ddMMyy"), F.lit(",6.0,W,A"))
    gga = F.concat(F.lit("GPGGA,"), clock, F.lit(","), part("lat", 2), F.lit(",N,"), part("lon", 3), F.lit(",E,1,06,1.1,"), F.format_string("%.2f", F.col("altitude")), F.lit(",M,21.0,M,,"))
    body = lambda text, line, wrong: F.struct(text.alias("body"), (F.col("event_id") * 2 + line).alias("line"), (F.col("event_id") % wrong == 0).alias("wrong"))
    both = rows.select("user_id", F.inline(F.array(body(gga, 0, 7), body(rmc, 1, 11))))
    check = nmea_checksum("body").bitwiseXOR(F.when(F.col("wrong"), 1).otherwise(0))
    return both.select(F.col("user_id").alias("device"), "line", F.concat(F.lit("$"), "body", F.lit("*"), F.format_string("%02X", check)).alias("raw"))


@query(f"""SELECT user_id AS device, CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT) AS ms, round(floor(lon) + {_MIN.format(c='lon')} / 600000e0, 8) AS lon, round(floor(lat) + {_MIN.format(c='lat')} / 600000e0, 8) AS lat,
  round(speed * 1852e0 / 3600e0, 6) AS speed, CAST(event_id % 360 AS DOUBLE) AS course, CASE WHEN event_id % 7 > 0 THEN round(altitude, 2) END AS altitude
FROM ({ad.FIXES}) f WHERE event_id % 11 > 0""")
def u1_f6_j8_decode_nmea(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes from the logs of all users, a device each, over all days."""
    told = sn.decode_nmea(nmea_lines(spark, sf_dir), ("device",))
    return told.select("device", F.unix_millis("ts").alias("ms"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.round("speed", 6).alias("speed"), "course", "altitude")


@query(f"""SELECT 'GP' AS talker, kind, strftime(date_trunc('hour', ts), '%H%M%S.0') AS utc, printf('%.2f', CASE WHEN kind = 'RMC' THEN speed ELSE altitude END) AS told, user_id % 8 AS log,
  CASE WHEN kind = 'RMC' THEN 12 ELSE 14 END AS n FROM ({ad.FIXES}) f, (SELECT unnest(['GGA', 'RMC']) AS kind) k
  WHERE event_id % CASE WHEN kind = 'RMC' THEN 11 ELSE 7 END > 0""")
def s7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written as text and read again: their whole sentences."""
    home = scratch(spark)
    lines = nmea_lines(spark, sf_dir).select((F.col("device") % 8).alias("log"), "line", F.col("raw").alias("value"))
    lines.repartition("log").sortWithinPartitions("log", "line").select("log", "value").write.partitionBy("log").text(home)
    told = sn.sentences(text.read_nmea(spark, home))
    value = F.when(F.col("kind") == "RMC", F.get("fields", F.lit(6))).otherwise(F.get("fields", F.lit(8)))
    return told.select("talker", "kind", F.get("fields", F.lit(0)).alias("utc"), value.alias("told"), F.col("log").cast("long").alias("log"), F.size("fields").alias("n"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = ad.fixes(spark, sf_dir).select("event_id", "ts", F.concat(F.lit("41 0C "), F.lpad(F.hex(e % 256), 2, "0"), F.lit(" "), F.lpad(F.hex(e * 7 % 256), 2, "0")).alias("line"))
    return sn.decode_obd(raw).withColumn("event_id", F.lit(0))


@query("""WITH m AS (SELECT max(ts) - INTERVAL 10 SECOND AS upto FROM events)
SELECT CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS start_ms, count(*) AS replies FROM events, m GROUP BY 1, date_trunc('second', ts), upto
  HAVING date_trunc('second', ts) + INTERVAL 1 SECOND <= upto""")
def x4_stream_obd_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed seconds of a stream of readings."""
    return _streamed(spark, _readings(spark, sf_dir), live.stream_obd_rate).select(F.unix_millis("start").alias("start_ms"), "replies")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 10 SECOND AS upto FROM events),
r AS (SELECT ts, ((event_id % 256) * 256 + event_id * 7 % 256) // 4 AS value, to_timestamp(floor(epoch(ts) / 5) * 5 - 5 * k)::TIMESTAMP AS s
  FROM events, (SELECT unnest([0, 1]) AS k) q)
SELECT CAST(epoch_ms(s) AS BIGINT) AS start_ms, round(avg(value), 4) AS mean FROM r, m GROUP BY s, upto HAVING s + INTERVAL 10 SECOND <= upto""")
def x4_stream_obd_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _streamed(spark, _readings(spark, sf_dir), lambda s: live.stream_obd_mean(s, 12))
    return told.select(F.unix_millis("start").alias("start_ms"), F.round("mean", 4).alias("mean"))
