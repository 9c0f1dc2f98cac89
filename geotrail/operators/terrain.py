"""Heights from tables of height maps dem(level, x, y, width, height, z array<float>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.functions.geo import UNIT_LEVEL, mercator_x, mercator_y
from geotrail.functions.tiles import sample_dem, tile_at, uv_in_ancestor
from geotrail.operators.tiles import fallback_tile

#: Metres of a stored step, and the least upper bound of a tile.
FACTOR, LEAST_TOP = 0.05, 2.0


def elevation(points: DataFrame, dem: DataFrame, level: int, factor: float = FACTOR) -> DataFrame:
    """Adds ``elevation`` to points (x, y in units): from the point's own tile, else the nearest above it; null without one.

    Height maps are joined once the tile is known, so they don't travel with the search; only maps that a point falls into
    are, and they are shuffled, never broadcast: their heights make them larger than a plan can tell.
    """
    size = float(1 << (UNIT_LEVEL - level))
    asked = points.withColumn("__t", tile_at("x", "y", level))
    found = fallback_tile(dem.select("level", "x", "y"), asked.select("__t.level", "__t.x", "__t.y"))
    found = found.filter("found_level is not null").select(F.struct("level", "x", "y").alias("__t"), *(F.col(f"found_{c}").alias(f"__f{c}") for c in ("level", "x", "y")))
    told = asked.join(found, "__t", "left")
    key = ["__flevel", "__fx", "__fy"]
    maps = dem.select(*(F.col(c).alias(f"__f{c}") for c in ("level", "x", "y")), F.col("width").alias("__w"), F.col("height").alias("__h"), F.col("z").alias("__z"))
    maps = maps.join(found.select(*key).distinct(), key, "left_semi")
    told = told.join(maps.hint("merge"), key, "left")
    u, v = F.col("x") / size - F.col("__t.x"), 1 - (F.col("y") / size - F.col("__t.y"))
    uv = uv_in_ancestor("__t.level", "__t.x", "__t.y", u, v, "__flevel", "__fx", "__fy")
    told = told.withColumn("elevation", sample_dem("__z", "__w", "__h", uv["u"], uv["v"], factor))
    return told.select(*points.columns, "elevation")


def dem_bounds(dem: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(level, x, y, min_h, max_h) of each height map in metres; the top is at least 2."""
    low, high = F.array_min("z").cast("double") * factor, F.array_max("z").cast("double") * factor
    return dem.select("level", "x", "y", low.alias("min_h"), F.greatest(F.lit(LEAST_TOP), high).alias("max_h"))


def max_height_by_ancestor(dem: DataFrame, level: int) -> DataFrame:
    """(level, x, y, max_h): the greatest height under each cell of a coarser level."""
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level") - level)).alias(c)
    below = dem_bounds(dem.filter(F.col("level") >= level)).select(F.lit(level).alias("level"), up("x"), up("y"), "max_h")
    return below.groupBy("level", "x", "y").agg(F.max("max_h").alias("max_h"))


def tracks_to_3d(path_log: DataFrame, dem: DataFrame, level: int) -> DataFrame:
    """Path logs (file, line, ts, lon, lat) as 3D tracks (file, line, ts, x, y, z): y is the ground height, 0 without one."""
    flat = path_log.select("file", "line", "ts", mercator_x("lon").alias("x"), mercator_y("lat").alias("y"))
    told = elevation(flat, dem, level)
    return told.select("file", "line", "ts", "x", F.coalesce("elevation", F.lit(0.0)).alias("y"), F.col("y").alias("z"))
