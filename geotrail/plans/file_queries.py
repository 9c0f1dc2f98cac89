"""Queries that write the library's file formats from the driver's tables and read them again."""

from __future__ import annotations

import struct
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.plans import adapters as ad
from geotrail.plans.catalog import query
from geotrail.plans.fix_queries import _FOLD, closed, spans
from geotrail.sources.scratch import dealt, scratch
from geotrail.sources import binary
from geotrail.sources.tables import write_tables
from geotrail.streaming import fixes as live


#: Bytes of rows that are Python's objects at a time.
_AT_ONCE = 1 << 20


def _written(rows: DataFrame, name: Callable, content: Callable) -> str:
    """The folder to which a file was written for each row; rows are dealt over tasks, their lists of numbers are arrays."""

    def values(column: pa.Array) -> list:
        if pa.types.is_list(column.type) and not pa.types.is_nested(column.type.value_type):
            return [v.values.to_numpy(zero_copy_only=False) for v in column]
        return column.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = namedtuple("row", batch.schema.names)
            some = max(1, int(_AT_ONCE * batch.num_rows / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, some):
                told = [row(*r) for r in zip(*map(values, batch.slice(at, some).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name(r) for r in told], pa.string()), pa.array([content(r) for r in told], pa.binary())], names=["file", "content"])

    home = scratch(rows.sparkSession)
    binary.write_files(dealt(rows, *(c for c, kind in rows.dtypes if not kind.startswith("array"))).mapInArrow(run, "file string, content binary"), home)
    return home


@query(f"""SELECT 'track' || file || '.3dpath' AS file, row_number() OVER (PARTITION BY file ORDER BY line) - 1 AS line, CAST(line AS BIGINT) AS ts, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, 0e0 AS y, CAST(CAST(y AS FLOAT) AS DOUBLE) AS z
  FROM ({ad.PLACED}) p""")
def s3_s4_track3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as binary 3D files and back; places are 32-bit floats there."""
    rows = ad.tracks(spark, sf_dir).select(F.concat(F.lit("track"), "file", F.lit(".3dpath")).alias("file"), "line", F.col("line").alias("ts"), F.col("x").cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"), F.col("y").cast("float").alias("z"))
    home = scratch(spark)
    binary.write_3dpath(rows, home)
    told = binary.read_3dpath(spark, home)
    return told.select("file", "line", "ts", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z")))


_TILE = """level, x, y, 16 AS width, 16 AS height, CAST(list_sum(list_transform(range(0, 256), lambda i: (k * 31 + i * 17) % 4001 - 50)) AS DOUBLE) AS total, CAST((k * 31 + 255 * 17) % 4001 - 50 AS DOUBLE) AS last"""


def _map_digest(told: DataFrame) -> DataFrame:
    return told.select("level", "x", "y", "width", "height", F.aggregate("z", F.lit(0.0), lambda a, v: a + v).alias("total"), F.get("z", F.lit(255)).cast("double").alias("last"))


@query(f"SELECT {_TILE} FROM ({ad.DEM}) d")
def s8_s10_dem_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height maps as files and back."""
    home = scratch(spark)
    binary.write_dem_tiles(ad.dem(spark, sf_dir), home)
    return _map_digest(binary.read_dem_tiles(spark, home))


def _lerc(r) -> bytes:
    """A tile of four blocks: floats, floats, packed 12-bit steps, packed 12-bit steps."""
    z = np.asarray(r.z, "<f4").reshape(16, 16)
    blocks = b""
    for i in (0, 8):
        for j in (0, 8):
            part = z[i : i + 8, j : j + 8]
            if not i:
                blocks += b"\0" + part.tobytes()
                continue
            low = part.min()
            bits = "".join(format(int(v), "012b") for v in (part - low).ravel())
            words = b"".join(int(bits[k : k + 32], 2).to_bytes(4, "little") for k in range(0, len(bits), 32))
            blocks += b"\1" + struct.pack("<f", low) + bytes([12 | 2 << 6, 64]) + words
    return binary.LERC_TAG + struct.pack("<iiIId", 11, 8, 16, 16, 0.5) + struct.pack("<IIIf", 0, 0, 0, 1.0) + struct.pack("<IIIf", 2, 2, len(blocks), 1e6) + blocks


@query(f"SELECT {_TILE} FROM ({ad.DEM}) d")
def s9_lerc_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height maps as compressed elevation tiles, decoded."""
    row = lambda r: (1 << r.level) - r.y - 1
    home = _written(ad.dem(spark, sf_dir), lambda r: f"{r.level}/{row(r):04d}/{row(r):04d}_{r.x:04d}.lerc", _lerc)
    return _map_digest(binary.read_lerc_tiles(spark, home))


@query(f"""SELECT CAST(file AS INT) AS num, 3 AS shape_type, count(*) AS n, round(min(x), 6) AS west, round(max(y), 6) AS north, round(arg_max(x, line), 6) AS last_x
  FROM ({ad.PLACED}) p GROUP BY file""")
def s11_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as polylines of one shape file each, and back."""

    def shape(r) -> bytes:
        body = struct.pack("<i4dii", 3, r.x.min(), r.y.min(), r.x.max(), r.y.max(), 1, len(r.x)) + struct.pack("<i", 0) + np.column_stack([r.x, r.y]).astype("<f8").tobytes()
        return b"\0" * 100 + struct.pack(">ii", r.file, len(body) // 2) + body

    lines = ad.tracks(spark, sf_dir).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "x", "y"))).alias("p")).select("file", "p.x", "p.y")
    told = binary.read_shapes(spark, _written(lines, lambda r: f"{r.file}.shp", shape))
    return told.select("num", "shape_type", F.size("points").cast("long").alias("n"), F.round(F.get("box", F.lit(0)), 6).alias("west"), F.round(F.get("box", F.lit(3)), 6).alias("north"), F.round(F.element_at("points", -1)["x"], 6).alias("last_x"))


@query(f"SELECT name AS text, round(lon, 9) AS lon, round(lat, 9) AS lat, CAST(length(name) AS INT) AS font_size FROM ({ad.LANDMARKS}) l")
def s12_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks as POI tiles of one degree's tenth each, and back."""
    text = lambda s: struct.pack("<H", len(s)) + s.encode()
    record = lambda p: struct.pack("<ddf", p["lon"], p["lat"], 5.0) + text("key") + text(p["name"]) + text("font") + struct.pack("<BBII", len(p["name"]), 4, 1, 2) + b"image\0\0\0\0\0"
    cell = lambda c: F.floor(F.col(c) * 10).alias(f"c{c}")
    tiles = ad.landmarks(spark, sf_dir).groupBy(cell("lon"), cell("lat")).agg(F.collect_list(F.struct("name", "lon", "lat")).alias("points"))
    home = _written(tiles, lambda r: f"{r.clon}_{r.clat}.poi_base", lambda r: struct.pack("<Ii", 0x02000003, len(r.points)) + b"".join(map(record, r.points)))
    return binary.read_poi(spark, home).select("text", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "font_size")


@query("SELECT p_name || p_partkey AS key, CAST(p_size % 16 AS INT) AS level, p_partkey % 9 AS x, CAST(p_partkey AS DOUBLE) + 5 AS top FROM part")
def s13_model_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as model-index tiles, 256 neighbouring keys to a row of tiles, and back."""
    text = lambda s: struct.pack("<B", len(s)) + s.encode()
    model = lambda p: struct.pack("<IB", 3, 1) + text(f"{p['p_name']}{p['p_partkey']}") + struct.pack("<ddf6d", 127, 37, 0, *(p["p_partkey"] + k for k in range(6))) + b"\2" + text("d.xdo") + text("i.jpg")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    keys = (F.col("p_size") % 16).cast("int").alias("level"), (F.col("p_partkey") % 9).alias("x"), F.floor(F.col("p_partkey") / 256).alias("y")
    tiles = part.groupBy(*keys).agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("models"))
    home = _written(tiles, lambda r: f"{r.level}/{r.y}/{r.y}_{r.x}.facility_build", lambda r: struct.pack("<iiii", r.level, r.x, r.y, len(r.models)) + b"".join(map(model, r.models)))
    return binary.read_model_index(spark, home).select("key", "level", "x", F.get("box", F.lit(5)).alias("top"))


@query(f"""SELECT name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({ad.LANDMARKS}) l UNION ALL SELECT name, round(lon, 6) AS lon, round(lat, 6) AS lat
  FROM ({ad.LANDMARKS}) l""")
def s6_write_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks appended twice to a stored table."""
    home = scratch(spark)
    for _ in range(2):
        write_tables({"landmarks": ad.landmarks(spark, sf_dir)}, home)
    return spark.read.parquet(f"{home}/landmarks").select("name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""{_FOLD}
SELECT user_id, CAST(first // 1000 AS BIGINT) AS time_id, round(coalesce(arg_max(total, k) FILTER (inside), 0e0), 3) AS distance FROM s
  GROUP BY user_id, day, first""")
def x2_s16_stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of all fixes into stored tables: journeys as the last batch left them."""
    home = scratch(spark)
    rows = closed(ad.fixes(spark, sf_dir))
    for part in spans(rows, 2):
        part.write.mode("append").parquet(f"{home}/in")
        source = live.fix_stream(spark, f"{home}/in", schema=", ".join(f"{n} {t}" for n, t in rows.dtypes), max_files=100_000)
        live.start(live.stream_sink(live.stream_journeys(source), f"{home}/out", f"{home}/check"), spark).awaitTermination()
    return live.read_journeys(spark, f"{home}/out").select("user_id", "time_id", F.round("distance", 3).alias("distance"))


@query(f"""SELECT strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS date_time, f.user_id, event_type AS name, round(lon, 6) AS lon, round(lat, 6) AS lat, CASE WHEN f.event_id % 3 > 0 THEN props END AS address, 'event ' || f.event_id AS comment
  FROM ({ad.FIXES}) f JOIN events USING (event_id)""")
def x2_s16_landmark_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of landmarks, one where each fix is, appended to a stored table."""
    home, events = scratch(spark), spark.read.parquet(f"{sf_dir}/events.parquet")
    told = events.select("event_id", F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("address"), F.concat(F.lit("event "), "event_id").alias("comment"))
    rows = ad.fixes(spark, sf_dir).join(told, "event_id").select("user_id", "ts", "name", "lon", "lat", "address", "comment")
    for part in spans(rows, 2):
        part.write.mode("append").parquet(f"{home}/in")
        live.landmark_sink(live.landmark_stream(spark, f"{home}/in", max_files=100_000), f"{home}/out", f"{home}/check").start().awaitTermination()
    return spark.read.parquet(f"{home}/out").select("date_time", "user_id", "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "address", "comment")
