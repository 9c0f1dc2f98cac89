"""Tables of tiles: nearest data, neighbours, what to fetch, counts over the pyramid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.functions.geo import UNIT_LEVEL
from geotrail.functions.tiles import ancestor_tiles, request_key, tile_at, tile_key

#: Bytes below which a file holds nothing, and the level from which that is final (fixed values).
SMALL = {"image": 3000, "height": 200}
FINAL_LEVEL = 15


def tile_status(df: DataFrame, layer: str = "layer") -> DataFrame:
    """Adds ``status``: missing, refetch (small, coarse level), empty (small, fine level) or ok."""
    limit = F.when(F.col(layer) == "image", SMALL["image"]).otherwise(SMALL["height"])
    small = F.col("bytes") < limit
    status = F.when(F.col("bytes").isNull(), "missing").when(small & (F.col("level") < FINAL_LEVEL), "refetch").when(small, "empty").otherwise("ok")
    return df.withColumn("status", status)


def fallback_tile(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (level, x, y) once each, with the nearest tile at or above it in ``tiles``: found_level, found_x, found_y.

    Only distinct wanted tiles are written out over their ancestors.  ``tiles`` is shuffled, never broadcast: its files are
    small for its rows, so that a plan takes it for less than it is.
    """
    asked = wanted.select("level", "x", "y").distinct()
    up = asked.select("level", "x", "y", F.explode(ancestor_tiles("level", "x", "y")).alias("a"))
    up = up.withColumn("key", tile_key("a.level", "a.x", "a.y"))
    have = tiles.select(tile_key("level", "x", "y").alias("key")).distinct()
    best = up.join(have.hint("merge"), "key").groupBy("level", "x", "y").agg(F.max_by("a", "a.level").alias("best"))
    found = best.select("level", "x", "y", F.col("best.level").alias("found_level"), F.col("best.x").alias("found_x"), F.col("best.y").alias("found_y"))
    return asked.join(found, ["level", "x", "y"], "left")


def tile_neighbors(tiles: DataFrame) -> DataFrame:
    """(level, x, y, side, n_level, n_x, n_y): the finest tile of the table just across each edge, null when none."""
    size = F.pow(F.lit(2.0), UNIT_LEVEL - F.col("level"))
    left, south = F.col("x") * size, F.col("y") * size
    probe = lambda name, x, y: F.struct(F.lit(name).alias("side"), x.alias("px"), y.alias("py"))
    probes = F.array(probe("north", left, south + size + 0.5), probe("south", left, south - 0.5), probe("west", left - 0.5, south + 0.5), probe("east", left + size + 0.5, south + 0.5))
    asked = tiles.select("level", "x", "y").distinct().select("level", "x", "y", F.inline(probes))
    inside = F.col("px").between(0, (1 << UNIT_LEVEL) - 0.25) & F.col("py").between(0, (1 << UNIT_LEVEL) - 0.25)
    asked = asked.withColumn("p", F.when(inside, tile_at("px", "py", UNIT_LEVEL)))
    found = fallback_tile(tiles, asked.filter("p is not null").select("p.level", "p.x", "p.y"))
    found = found.select(F.struct("level", "x", "y").alias("p"), "found_level", "found_x", "found_y")
    told = asked.join(found, "p", "left")
    own = (F.col("found_level") == F.col("level")) & (F.col("found_x") == F.col("x")) & (F.col("found_y") == F.col("y"))
    other = lambda c: F.when(~own, F.col(f"found_{c}")).alias(f"n_{c}")
    return told.select("level", "x", "y", "side", other("level"), other("x"), other("y"))


def fetch_plan(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each tile of ``wanted`` (layer, kind, level, x, y) that is not in ``inventory`` (layer, level, x, y, bytes) or must be fetched again."""
    key = ["layer", "level", "x", "y"]
    asked = wanted.select(*key, "kind").distinct()
    told = tile_status(asked.join(inventory.groupBy(*key).agg(F.max("bytes").alias("bytes")), key, "left")).filter(F.col("status").isin("missing", "refetch"))
    return told.withColumn("request", request_key("kind", F.lit(0), F.lit(None).cast("string"), "level", "x", "y")).dropDuplicates(["request"])


def cell_counts(points: DataFrame, levels: list[int]) -> DataFrame:
    """(level, x, y, n): points (x, y in units) under each cell; points are counted once, at the finest level, and the counts rolled up."""
    deep = max(levels)
    fine = points.select(tile_at("x", "y", deep).alias("t")).groupBy("t.x", "t.y").agg(F.count("*").alias("n"))
    up = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / (1 << (deep - k))).alias("x"), F.floor(F.col("y") / (1 << (deep - k))).alias("y")) for k in levels))
    return fine.select("n", F.explode(up).alias("c")).groupBy("c.level", "c.x", "c.y").agg(F.sum("n").alias("n"))


def tile_coverage(inventory: DataFrame) -> DataFrame:
    """Files and bytes by layer and level, with totals (nulls)."""
    return inventory.rollup("layer", "level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def distinct_cells(points: DataFrame, level: int) -> DataFrame:
    return points.select(tile_at("x", "y", level).alias("t")).select("t.level", "t.x", "t.y").distinct()


def cells_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("level", "x", "y").subtract(b.select("level", "x", "y"))


def cells_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("level", "x", "y").intersect(b.select("level", "x", "y"))
