"""Tables of the library's kinds derived from the driver's tables by arithmetic that any SQL engine repeats.

Each text runs as it is in Spark and in DuckDB (floats are written with an exponent, so both read doubles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.functions.geo import mercator_x, mercator_y

#: Mercator units of a place, as SQL.
MX = "(({lon}) + 180e0) / 360e0 * 1048576e0"
MY = "(ln(tan(radians({lat}) / 2e0 + pi() / 4e0)) / (2e0 * pi()) + 0.5e0) * 1048576e0"

FIXES = """
SELECT event_id, user_id, ts,
  124e0 + (user_id % 80) * 0.1e0 + floor(value / 20e0) * 0.01e0 + CASE WHEN event_id % 97 = 0 THEN 60e0 ELSE 0e0 END AS lon,
  33e0 + (user_id % 50) * 0.1e0 + floor(value / 20e0) * 0.01e0 AS lat,
  value AS speed, value * 2e0 AS altitude
FROM events"""

TRACKS = """
SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS line,
  l_quantity AS q FROM lineitem"""

PLACED = f"""
SELECT file, CAST(line AS BIGINT) AS line, lon, lat, {MX.format(lon="lon")} AS x, {MY.format(lat="lat")} AS y
FROM (SELECT file, line, 127e0 + line * 0.0002e0 AS lon, 33e0 + file * 0.0003e0 + q * 0.000004e0 AS lat FROM ({TRACKS}) t) p"""

#: Five tracks along each road: their points meet in merge cells.
ROADS = f"""
SELECT file, CAST(line AS BIGINT) AS line, lon, lat, {MX.format(lon="lon")} AS x, {MY.format(lat="lat")} AS y
FROM (SELECT file, line, 127e0 + line * 0.0002e0 AS lon, 33e0 + floor(file / 5e0) * 0.0003e0 + q * 0.000001e0 AS lat FROM ({TRACKS}) t) p"""

INVENTORY = """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'image' ELSE 'height' END AS layer, CAST(p_size % 18 AS INT) AS level,
  CAST(p_partkey * 7919 % CAST(pow(2, p_size % 18) AS BIGINT) AS BIGINT) AS x, CAST(p_partkey * 104729 % CAST(pow(2, p_size % 18) AS BIGINT) AS BIGINT) AS y,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 3e0) AS BIGINT) END AS bytes
FROM part"""

#: A height map for each part: over the fixes first, then eastwards and northwards of them.
DEM = """
SELECT 10 AS level, CAST((873 + p_partkey % 12 + 12 * CAST(floor(p_partkey / 108e0) AS BIGINT)) % 1024 AS BIGINT) AS x,
  CAST((617 + CAST(floor(p_partkey / 12e0) AS BIGINT) % 9 + 9 * CAST(floor(p_partkey / 9216e0) AS BIGINT)) % 1024 AS BIGINT) AS y, max(p_partkey) AS k
FROM part GROUP BY 2, 3"""

LANDMARKS = """
SELECT s_name AS name, 126e0 + s_suppkey % 30 * 0.1e0 AS lon, 34e0 + s_suppkey % 40 * 0.1e0 AS lat FROM supplier
UNION ALL SELECT c_name, 126e0 + c_custkey % 33 * 0.1e0, 34e0 + c_custkey % 47 * 0.1e0 FROM customer"""

#: Lines of an OBD log; PID and data from numbers.
OBD = """
SELECT l_orderkey, l_linenumber, l_shipdate AS ts, CASE WHEN l_quantity = 50 THEN 'STOPPED' WHEN l_quantity = 49 THEN 'NO DATA'
  ELSE concat(CASE WHEN l_quantity = 48 THEN '>' ELSE '' END, '41 ', lpad(hex(CAST(4 + l_partkey % 96 AS BIGINT)), 2, '0'), ' ', lpad(hex(CAST(l_orderkey % 256 AS BIGINT)), 2, '0'), ' ', lpad(hex(CAST(l_suppkey % 256 AS BIGINT)), 2, '0')) END AS line
FROM lineitem"""


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """``text`` over tables of ``sf_dir``; without naming them all, those that it mentions."""
    names = tables or tuple(t for t in ("events", "lineitem", "part", "supplier", "customer", "orders") if t in text.replace("(", " ").replace(")", " ").split())
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    for t in names:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **found)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return sql(spark, sf_dir, FIXES).withColumn("ts", F.col("ts").cast("timestamp"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, TRACKS)
    rows = rows.select("file", F.col("line").cast("long").alias("line"), (127 + F.col("line") * 0.0002).alias("lon"), (33 + F.col("file") * 0.0003 + F.col("q") * 0.000004).alias("lat"))
    return rows.withColumn("x", mercator_x("lon")).withColumn("y", mercator_y("lat"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, TRACKS)
    rows = rows.select("file", F.col("line").cast("long").alias("line"), (127 + F.col("line") * 0.0002).alias("lon"), (33 + F.floor(F.col("file") / 5) * 0.0003 + F.col("q") * 0.000001).alias("lat"))
    return rows.withColumn("x", mercator_x("lon")).withColumn("y", mercator_y("lat"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, INVENTORY)


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LANDMARKS)


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height maps of 16 x 16 cells whose heights follow from the cell's number."""
    cell = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((F.col("k") * 31 + i * 17) % 4001 - 50).cast("float"))
    return sql(spark, sf_dir, DEM).select("level", "x", "y", F.lit(16).alias("width"), F.lit(16).alias("height"), cell.alias("z"))


def obd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, OBD)
