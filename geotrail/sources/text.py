"""Text logs: paths, landmarks, NMEA lines, work histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrail.functions.sensors import log_time


def _line() -> Column:
    """A number that orders a file's lines and needn't be dense.

    It is the place of the split plus the row's number in its task, which is less than a split has bytes.
    """
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file's name and ``line``."""
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), _line().alias("line"), "value")


def parse_path_lines(lines: DataFrame) -> DataFrame:
    """Lines (file, line, value) of 3 or 5 columns as path logs; ``_bad`` holds what isn't one."""
    part = F.transform(F.split("value", ","), lambda c: F.trim(c))
    told = lines.withColumn("__p", part)
    number = lambda i: F.get("__p", i).try_cast("double")
    told = told.select(
        "file", "line", log_time(F.get("__p", F.lit(0))).alias("ts"), number(F.lit(1)).alias("lon"), number(F.lit(2)).alias("lat"),
        number(F.lit(3)).alias("speed"), number(F.lit(4)).alias("altitude"), F.size("__p").alias("__n"), "value",
    )
    fine = F.col("ts").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull() & ((F.col("__n") == 3) | ((F.col("__n") == 5) & F.col("speed").isNotNull() & F.col("altitude").isNotNull()))
    return told.withColumn("_bad", F.when(~fine, F.col("value"))).drop("__n", "value")


def read_path_log(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """path_log(file, line, ts, lon, lat, speed, altitude); malformed lines are dropped, or kept in ``_bad``."""
    told = parse_path_lines(_lines(spark, path))
    return told if keep_bad else told.filter("_bad is null").drop("_bad")


def path_line(df: DataFrame) -> Column:
    """A row as a log line, with speed and altitude where the table has them."""
    at = F.format_string("%s, %.15f, %.15f", F.date_format("ts", "yyyy-MM-dd-HH-mm-ss-SSS"), "lon", "lat")
    if not {"speed", "altitude"} <= set(df.columns):
        return at
    more = F.format_string(", %f, %f", F.col("speed").cast("double"), F.col("altitude").cast("double"))
    return F.concat(at, F.when(F.col("speed").isNull() | F.col("altitude").isNull(), "").otherwise(more))


def write_path_log(df: DataFrame, path: str) -> None:
    """The same text, a directory for each day."""
    df.select(path_line(df).alias("value"), F.date_format("ts", "yyyyMMdd").alias("day")).write.mode("append").partitionBy("day").text(path)


LANDMARK = T.StructType([T.StructField("name", T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """landmarks(name, lon, lat); rows of under three columns, or without numbers, are dropped."""
    return spark.read.csv(path, schema=LANDMARK, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).filter("lon is not null and lat is not null")


def write_landmarks(df: DataFrame, path: str) -> None:
    df.select("name", F.format_string("%.15f", "lon").alias("lon"), F.format_string("%.15f", "lat").alias("lat")).write.mode("overwrite").csv(path)


def read_nmea(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """nmea(raw) with the columns that folders name; in batch also ``file``, its address, and ``line``, which orders its lines."""
    if stream:
        return spark.readStream.text(path).withColumnRenamed("value", "raw")
    text = spark.read.text(path)
    return text.select(*(c for c in text.columns if c != "value"), F.col("_metadata.file_path").alias("file"), _line().alias("line"), F.col("value").alias("raw"))


def parse_history_lines(lines: DataFrame, place: str = "line") -> DataFrame:
    """Lines (value, and a column that orders them) ``file, complete|processing[, line]`` as history(file, is_complete, line, place)."""
    told = lines.withColumn("__p", F.transform(F.split("value", ","), lambda c: F.trim(c))).filter(F.size("__p") >= 2)
    part = lambda i: F.get("__p", F.lit(i))
    return told.select(part(0).alias("file"), (part(1) == "complete").alias("is_complete"), F.coalesce(part(2).try_cast("int"), F.lit(0)).alias("line"), F.col(place).alias("place"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """history(file, is_complete, line, place); several files follow one another in the order of their names."""
    return parse_history_lines(_lines(spark, path).withColumn("at", F.struct("file", "line")), "at")


def write_history(df: DataFrame, path: str) -> None:
    state = F.when(F.col("is_complete"), "complete").otherwise("processing")
    df.select(F.concat_ws(", ", "file", state, F.col("line").cast("string")).alias("value")).write.mode("overwrite").text(path)
