"""NMEA and OBD-II logs as tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.plan import fixed
from geotrail.functions.sensors import nmea_checksum, nmea_degrees, nmea_parts, nmea_time, obd_numbers, obd_reading
from geotrail.sources.scratch import written

#: Metres a second of a knot.
KNOT = 1852.0 / 3600.0


#: Lines of a log that are put in order in one task; a longer log is cut into chunks.
CHUNK = 1 << 18


def _checked(df: DataFrame, raw: str, damaged: bool = False) -> DataFrame:
    """Valid lines with ``__parts`` (body, sent); lines are taken apart once, and only whole ones are summed.

    With ``damaged`` also lines that begin as an RMC sentence but aren't valid, their ``__parts`` null.
    """
    whole, begun = F.col("__parts.sent") != "", F.col(raw).rlike(r"^\$\w\wRMC,")
    told = fixed(df, __parts=nmea_parts(raw)).filter(whole | begun if damaged else whole)
    told = fixed(told, __sum=F.when(whole, nmea_checksum("__parts.body")))
    right = F.coalesce(F.col("__sum") == F.conv(F.nullif(F.col("__parts.sent"), F.lit("")), 16, 10).try_cast("int"), F.lit(False))
    if damaged:
        return told.filter(right | begun).withColumn("__parts", F.when(right, F.col("__parts"))).drop("__sum")
    return told.filter(right).drop("__sum")


def valid_sentences(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Whole NMEA lines with the right checksum."""
    return _checked(df, raw).drop("__parts")


def sentences(df: DataFrame, raw: str = "raw", damaged: bool = False) -> DataFrame:
    """Adds talker, kind and fields (without the address) of valid lines; with ``damaged`` also of broken RMC lines, their fields null."""
    told = fixed(_checked(df, raw, damaged), __f=F.split("__parts.body", ",", -1))
    head = F.coalesce(F.get("__f", F.lit(0)), F.substring(raw, 2, 5))
    return fixed(told, talker=F.substring(head, 1, 2), kind=F.substring(head, 3, 3), fields=F.slice("__f", 2, F.size("__f"))).drop("__f", "__parts")


def _timed(told: DataFrame, keys: tuple, chunk: int) -> DataFrame:
    """RMC and GGA sentences as (keys, __file, __chunk, __line, rmc, talker, utc, altitude, fix)."""
    field = lambda i: F.get("fields", F.lit(i))
    rmc, columns = F.col("kind") == "RMC", set(told.columns)
    fix = F.struct(
        field(0).alias("utc"), nmea_time(field(8), field(0)).alias("ts"), nmea_degrees(field(4), field(5)).alias("lon"), nmea_degrees(field(2), field(3)).alias("lat"),
        (field(6).try_cast("double") * KNOT).alias("speed"), field(7).try_cast("double").alias("course"),
    )
    file = F.coalesce(F.col("file").cast("string"), F.lit("")) if "file" in columns else F.lit("")
    line = F.col("line").cast("long") if "line" in columns else F.monotonically_increasing_id()
    rows = told.filter(rmc | (F.col("kind") == "GGA")).select(
        *keys, file.alias("__file"), line.alias("__line"), rmc.alias("rmc"), "talker", field(0).alias("utc"), F.when(~rmc, field(8).try_cast("double")).alias("altitude"),
        F.when(rmc & (field(1) == "A"), fix).alias("fix"),
    )
    return rows.withColumn("__chunk", F.floor(F.col("__line") / chunk))


def rmc_with_altitude(told: DataFrame, keys: tuple = (), chunk: int = CHUNK) -> DataFrame:
    """Position, speed and course of RMC sentences, with the altitude of the GGA sentence of the same epoch.

    ``told``: rows of ``sentences``, with damaged ones, in log order: by ``file`` and ``line`` where the table has
    them, else in the order of its rows.  What shares ``keys`` (devices) is one log; without keys each file is one, and
    named in the result.  A GGA sentence has a time but no date, so its place decides: it belongs to the next RMC
    sentence, or in logs where RMC comes first to the one before it, if that tells the same time and the same talker
    tells no other altitude in between.  A damaged RMC sentence ends its epoch all the same.  Of several talkers the
    greatest altitude counts.

    A long log is cut into chunks of ``chunk`` lines, each ordered in a task of its own; a chunk's first and last RMC
    sentences, one row a chunk, are carried to its neighbours.  Which kind comes first is counted inside chunks, over the log.
    The sentences with their neighbours are written once below the session's shared folder, as both read them, so that work starts when called.
    """
    log = [*keys] if keys else ["__file"]
    part = [*keys, "__file", "__chunk"]
    timed = _timed(told, keys, chunk).withColumn("__rmc", F.when(F.col("rmc"), F.struct(F.col("__file").alias("file"), F.col("__line").alias("line"), "utc")))
    names = ", ".join(f"`{c}`" for c in part)
    beside = lambda f: F.expr(f"{f}(__rmc, 1) ignore nulls over (partition by {names} order by __line)")
    talks = Window.partitionBy(*part, "rmc", "talker").orderBy("__line")
    near = written(timed.select("*", beside("lead").alias("next"), beside("lag").alias("last"), F.lead("__line").over(talks).alias("__after"), F.lag("__line").over(talks).alias("__before")))
    gga, same = ~F.col("rmc"), lambda c: F.coalesce(F.col(f"{c}.utc") == F.col("utc"), F.lit(False))

    # one row a chunk: its ends, the talkers that tell altitudes outside its RMC sentences, and which kind comes first
    ends = near.groupBy(*part).agg(
        F.min_by("__rmc", F.when(F.col("rmc"), F.col("__line"))).alias("first"), F.max_by("__rmc", F.when(F.col("rmc"), F.col("__line"))).alias("final"),
        F.collect_set(F.when(gga & F.col("last").isNull(), F.col("talker"))).alias("head"), F.collect_set(F.when(gga & F.col("next").isNull(), F.col("talker"))).alias("tail"),
        (F.count_if(gga & same("next") & ~same("last")) - F.count_if(gga & same("last") & ~same("next"))).alias("leads"),
    )
    chunks = Window.partitionBy(*log).orderBy(*(c for c in ("__file", "__chunk") if c not in log))
    order = ", ".join(f"`{c}`" for c in ("__file", "__chunk") if c not in log)
    carry = lambda f, c: F.expr(f"{f}({c}, 1) ignore nulls over (partition by {', '.join(f'`{k}`' for k in log)} order by {order})")
    ends = ends.select(
        *(F.col(c).alias(f"__end{k}") for k, c in enumerate(part)), carry("lead", "first").alias("later"), carry("lag", "final").alias("earlier"),
        F.coalesce(F.lead("head").over(chunks), F.array().cast("array<string>")).alias("ahead"), F.coalesce(F.lag("tail").over(chunks), F.array().cast("array<string>")).alias("behind"),
        (F.sum("leads").over(Window.partitionBy(*log)) >= 0).alias("gga_first"),
    )
    meets = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__end{k}")) for k, c in enumerate(part)))
    near = near.join(ends, meets)
    more = F.when(F.col("next").isNull(), F.col("__after").isNotNull() | F.array_contains("ahead", F.col("talker"))).otherwise(F.coalesce(F.col("__after") < F.col("next.line"), F.lit(False)))
    less = F.when(F.col("last").isNull(), F.col("__before").isNotNull() | F.array_contains("behind", F.col("talker"))).otherwise(F.coalesce(F.col("__before") > F.col("last.line"), F.lit(False)))
    near = near.withColumn("__more", more).withColumn("__less", less).withColumn("next", F.coalesce("next", "later")).withColumn("last", F.coalesce("last", "earlier"))
    own = F.when(F.col("rmc"), F.col("__rmc")).when(F.col("gga_first"), F.when(same("next") & ~F.col("__more"), F.col("next"))).otherwise(F.when(same("last") & ~F.col("__less"), F.col("last")))
    epochs = near.select(*keys, own.alias("own"), "fix", "altitude").filter("own is not null").select(*keys, F.col("own.file").alias("file"), F.col("own.line").alias("line"), "fix", "altitude")
    seconds = epochs.groupBy(*keys, "file", "line").agg(F.first("fix", ignorenulls=True).alias("fix"), F.max("altitude").alias("altitude")).filter("fix is not null")
    return seconds.select(*keys, *(["file"] if "file" in told.columns and not keys else []), "fix.*", "altitude")


def decode_nmea(raw: DataFrame, keys: tuple = ()) -> DataFrame:
    """Fixes from raw lines (keys, file, line, raw): valid RMC sentences with a time and a place, in ``rmc_with_altitude``'s logs."""
    return rmc_with_altitude(sentences(raw, damaged=True), keys).filter("ts is not null and lon is not null and lat is not null").drop("utc")


def decode_obd(raw: DataFrame) -> DataFrame:
    """Readings (ts, pid, value) of reply lines (ts, line); lines without ``41 `` give none."""
    told = fixed(raw.filter(F.col("line").contains("41 ")).select("ts", "line"), after=F.regexp_extract("line", r"^.*?41 (.*)$", 1))
    pid = F.coalesce(F.conv(F.nullif(F.regexp_extract("after", r"^([0-9A-Fa-f]{2})", 1), F.lit("")), 16, 10).try_cast("int"), F.lit(0))
    told = fixed(told.select("ts", "after"), pid=pid, n=obd_numbers(F.expr("substring(after, 4)")))
    return told.select("ts", "pid", obd_reading("pid", "n.v", "n.w").alias("value"))


def obd_stats(raw: DataFrame) -> DataFrame:
    """Replies, least, mean and greatest value by PID, and under PID -1 the number of ``STOPPED`` lines."""
    by_pid = decode_obd(raw).groupBy("pid").agg(F.count("*").alias("replies"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    nothing = F.lit(None)
    stopped = raw.agg(F.count_if(F.col("line").contains("STOPPED")).alias("replies")).select(F.lit(-1).alias("pid"), "replies", nothing.cast("int").alias("low"), nothing.cast("double").alias("mean"), nothing.cast("int").alias("high"))
    return by_pid.unionByName(stopped)
