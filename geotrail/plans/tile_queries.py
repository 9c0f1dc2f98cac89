"""Queries over map tiles and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotrail.functions import geo, tiles
from geotrail.functions.sql_names import DEFINITIONS, register_sql
from geotrail.operators import terrain
from geotrail.operators import tiles as tl
from geotrail.plans import adapters as ad
from geotrail.plans.catalog import query
from geotrail.sources.scratch import scratch
from geotrail.sources.binary import write_files
from geotrail.sources.tables import read_tile_inventory

LONLAT = f"SELECT event_id, lon, lat, {ad.MX.format(lon='lon')} AS x, {ad.MY.format(lat='lat')} AS y FROM ({ad.FIXES}) f"


def _at(c: str, level) -> str:
    return f"CAST(floor({c} / pow(2, 20 - {level})) AS BIGINT)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.fixes(spark, sf_dir).withColumn("x", geo.mercator_x("lon")).withColumn("y", geo.mercator_y("lat"))


@query(f"""SELECT event_id, round(x, 5) AS x, round(y, 5) AS y, round(x / 1048576e0 * 360e0 - 180e0, 9) AS lon, round(degrees(2e0 * atan(exp((y / 1048576e0 - 0.5e0) * 2e0 * pi())) - pi() / 2e0), 9) AS lat
  FROM ({LONLAT}) p""")
def m2_m3_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).withColumn("p", geo.mercator_xy("lon", "lat"))
    return rows.withColumn("q", geo.mercator_lonlat("p.x", "p.y")).select("event_id", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"), F.round("q.lon", 9).alias("lon"), F.round("q.lat", 9).alias("lat"))


@query(f"SELECT event_id, round(x - 897024e0, 5) AS rx, round(y - 634880e0, 5) AS ry, round(x, 5) AS x FROM ({LONLAT}) p")
def m4_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).withColumn("r", geo.to_relation("x", "y"))
    return rows.select("event_id", F.round("r.x", 5).alias("rx"), F.round("r.y", 5).alias("ry"), F.round(geo.to_global("r.x", "r.y")["x"], 5).alias("x"))


@query(f"SELECT event_id, CAST(event_id % 20 AS INT) AS level, {_at('x', '(event_id % 20)')} AS x, {_at('y', '(event_id % 20)')} AS y FROM ({LONLAT}) p")
def m5_tile_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.fixes(spark, sf_dir)
    return rows.select("event_id", tiles.lonlat_tile("lon", "lat", F.col("event_id") % 20).alias("t")).select("event_id", "t.*")


_RECT = f"SELECT event_id, x AS x0, y AS y0, x + event_id % 700 AS x1, y + event_id % 300 AS y1 FROM ({LONLAT}) p"
_BITS = "length(ltrim(bin(xor(CAST(floor({a}) AS BIGINT), CAST(floor({b}) AS BIGINT))), '0'))"
_LEVEL = f"20 - greatest({_BITS.format(a='x0', b='x1')}, {_BITS.format(a='y0', b='y1')})"


@query(f"""WITH r AS (SELECT *, x1 < 1048576 AND y1 < 1048576 AND x0 >= 0 AND y0 >= 0 AS fine, {_LEVEL} AS l FROM ({_RECT}) q)
SELECT event_id, CAST(CASE WHEN fine THEN l ELSE -1 END AS INT) AS level, CASE WHEN fine THEN {_at('x0', 'l')} ELSE -1 END AS x, CASE WHEN fine THEN {_at('y0', 'l')} ELSE -1 END AS y,
CASE WHEN fine AND 9 <= l THEN {_at('x0', 9)} ELSE -1 END AS x9, CASE WHEN fine AND 9 <= l THEN {_at('y0', 9)} ELSE -1 END AS y9 FROM r""")
def m6_m7_enclosing_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).select("event_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("event_id") % 700).alias("x1"), (F.col("y") + F.col("event_id") % 300).alias("y1"))
    own, nine = tiles.enclosing_tile("x0", "y1", "x1", "y0"), tiles.tile_location("x0", "y1", "x1", "y0", 9)
    return rows.select("event_id", own.alias("t"), nine.alias("n")).select("event_id", "t.level", "t.x", "t.y", F.col("n.x").alias("x9"), F.col("n.y").alias("y9"))


_KEYED = f"SELECT event_id, CAST(event_id % 20 AS INT) AS level, {_at('x', '(event_id % 20)')} AS x, {_at('y', '(event_id % 20)')} AS y FROM ({LONLAT}) p"


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m5_tile_at(spark, sf_dir)


@query(f"SELECT event_id, (level::BIGINT << 48) + (y << 24) + x AS key, level AS l2, x AS x2, y AS y2, (1::BIGINT << level) - y - 1 AS flipped FROM ({_KEYED}) t")
def m9_m11_tile_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiles(spark, sf_dir).withColumn("key", tiles.tile_key("level", "x", "y")).withColumn("u", tiles.tile_unkey("key"))
    return rows.select("event_id", "key", F.col("u.level").alias("l2"), F.col("u.x").alias("x2"), F.col("u.y").alias("y2"), tiles.flip_y("level", "y").alias("flipped"))


@query(f"""SELECT event_id, x * pow(2, 20 - level) AS west, y * pow(2, 20 - level) AS south, (x + 1) * pow(2, 20 - level) - 897024e0 AS right_r, (y + 1) * pow(2, 20 - level) - 634880e0 AS top_r
  FROM ({_KEYED}) t""")
def m8_tile_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiles(spark, sf_dir).withColumn("g", tiles.tile_rect("level", "x", "y")).withColumn("r", tiles.tile_rect("level", "x", "y", "relation"))
    return rows.select("event_id", F.col("g.left").alias("west"), F.col("g.bottom").alias("south"), F.col("r.right").alias("right_r"), F.col("r.top").alias("top_r"))


@query(f"""SELECT event_id, CASE WHEN level > 0 THEN x // 2 END AS px, CASE WHEN level > 0 THEN y // 2 END AS py, x * 2 + 1 AS cx, y * 2 AS cy, x * 2 AS dx, y * 2 + 1 AS dy, CAST(level + 1 AS BIGINT) AS n_up, x // CAST(pow(2, level // 2) AS BIGINT) AS ax
  FROM ({_KEYED}) t""")
def m10_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiles(spark, sf_dir).select("event_id", "level", tiles.parent_tile("level", "x", "y").alias("p"), tiles.child_tiles("level", "x", "y").alias("c"), tiles.ancestor_tiles("level", "x", "y").alias("a"))
    return rows.select(
        "event_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("c")[1]["x"].alias("cx"), F.col("c")[1]["y"].alias("cy"), F.col("c")[2]["x"].alias("dx"), F.col("c")[2]["y"].alias("dy"),
        F.size("a").cast("long").alias("n_up"), F.get("a", F.floor(F.col("level") / 2).cast("int"))["x"].alias("ax"),
    )


@query(f"""WITH t AS (SELECT event_id, level, x, (1::BIGINT << level) - y - 1 AS r FROM ({_KEYED}) t)
SELECT event_id, printf('%d/%04d/%04d_%04d.jpg', level, r, r, x) AS path, printf('http://tiles.invalid/%d/%d/%d', level, r, x) AS url FROM t""")
def m12_m25_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiles(spark, sf_dir)
    return rows.select("event_id", tiles.tile_path("image", "level", "x", "y").alias("path"), tiles.tile_url("http://tiles.invalid/%d/%d/%d", "level", "x", "y").alias("url"))


@query(f"""SELECT event_id, (i << 44) | (l << 40) | (y << 20) | x AS qgid, i AS idx, l AS level, x AS x2, y AS y2, l = 3 AND x = 7 AND y = 5 AS same
  FROM (SELECT event_id, event_id % 300 AS i, event_id % 16 AS l, event_id % 977 AS x, event_id % 643 AS y FROM events) q""")
def m13_qgid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", tiles.qgid_pack(e % 16, e % 977, e % 643, e % 300).alias("qgid")).withColumn("u", tiles.qgid_unpack("qgid"))
    seven = tiles.qgid_pack(F.lit(3), F.lit(7), F.lit(5), F.lit(99))
    return rows.select("event_id", "qgid", F.col("u.idx").alias("idx"), F.col("u.level").cast("long").alias("level"), F.col("u.x").alias("x2"), F.col("u.y").alias("y2"), tiles.same_cell("qgid", seven).alias("same"))


@query(f"""SELECT event_id, round((x - ax * n) / n, 9) AS u1, round(1e0 - (y - ay * n) / n - 1e0 / n, 9) AS v1, round((x - ax * n) / n + 1e0 / n, 9) AS u2, round(1e0 - (y - ay * n) / n, 9) AS v2,
round((x + 0.25e0) / n - ax, 9) AS pu, round(1e0 - ((y + 1 - 0.75e0) / n - ay), 9) AS pv FROM (SELECT *, floor(x / n) AS ax, floor(y / n) AS ay
  FROM (SELECT *, pow(2e0, level - level // 2) AS n FROM ({_KEYED}) t) q) r""")
def m17_m18_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("level") / 2).cast("int")
    rows = _tiles(spark, sf_dir).withColumn("h", half).withColumn("a", F.get(tiles.ancestor_tiles("level", "x", "y"), F.col("level") - F.col("h")))
    rows = rows.select("event_id", tiles.child_uv("a.level", "a.x", "a.y", "level", "x", "y").alias("c"), tiles.uv_in_ancestor("level", "x", "y", F.lit(0.25), F.lit(0.75), "a.level", "a.x", "a.y").alias("p"))
    near = lambda c, n: F.round(c, 9).alias(n)
    return rows.select("event_id", *(near(f"c.{n}", n) for n in ("u1", "v1", "u2", "v2")), near("p.u", "pu"), near("p.v", "pv"))


@query(f"""SELECT p_partkey, layer_id * 100 + 3 AS kind, (level::BIGINT << 48) + (y << 24) + x AS tile, named IS NULL AS unnamed, min(p_partkey) OVER (PARTITION BY named) AS first_of_name FROM (
  SELECT p_partkey, p_partkey % 2 AS layer_id, CASE WHEN p_partkey % 5 > 0 THEN p_brand || p_partkey % 7 END AS named, CAST(p_size % 18 AS INT) AS level,
    CAST(p_partkey * 7919 % CAST(pow(2, p_size % 18) AS BIGINT) AS BIGINT) AS x, CAST(p_partkey * 104729 % CAST(pow(2, p_size % 18) AS BIGINT) AS BIGINT) AS y FROM part) q""")
def m24_request_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a request for each part; hashes are compared by the parts that share one: those that share a file's name."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    level = (F.col("p_size") % 18).cast("int")
    n = F.pow(F.lit(2.0), level).cast("long")
    name = F.when(F.col("p_partkey") % 5 > 0, F.concat("p_brand", (F.col("p_partkey") % 7).cast("string")))
    key = tiles.request_key(F.col("p_partkey") % 2, F.lit(3), name, level, F.col("p_partkey") * 7919 % n, F.col("p_partkey") * 104729 % n)
    first = F.min("p_partkey").over(Window.partitionBy("k.name"))
    return part.select("p_partkey", key.alias("k")).select("p_partkey", "k.kind", "k.tile", (F.col("k.name") == 0).alias("unnamed"), first.alias("first_of_name"))


@query(f"""WITH p AS (SELECT *, {_at('x', 12)} AS c, {_at('y', 12)} AS r, CAST(floor(x) AS BIGINT) AS ux, CAST(floor(y) AS BIGINT) AS uy FROM ({LONLAT}) f),
b AS (
  SELECT *, greatest(CASE WHEN xor(ux, ux + event_id % 5000) = 0 THEN 0 ELSE length(bin(xor(ux, ux + event_id % 5000))) END,
    CASE WHEN xor(uy, uy + 3) = 0 THEN 0 ELSE length(bin(xor(uy, uy + 3))) END) AS up, ux < 0 OR ux + event_id % 5000 >= 1048576 AS outside FROM p)
SELECT event_id, round(6371000e0 * 2e0 * asin(sqrt(pow(sin(radians(37.5e0 - lat) / 2e0), 2) + cos(radians(lat)) * cos(radians(37.5e0)) * pow(sin(radians(127e0 - lon) / 2e0), 2))), 2) AS metres,
  round(x, 4) AS mx, c, r, (12::BIGINT << 48) + (r << 24) + c AS key, 4096 - r - 1 AS flipped, 12 AS l2, c AS c2, r AS r2,
  c * 256e0 AS west, r * 256e0 AS south, c * 256e0 + 256e0 AS east, r * 256e0 + 256e0 AS north,
  CAST(CASE WHEN outside THEN -1 ELSE 20 - up END AS INT) AS around, CASE WHEN outside THEN -1 ELSE ux >> up END AS around_x, CASE WHEN outside THEN -1 ELSE uy >> up END AS around_y
    FROM b""")
def u5_sql_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions by their names in SQL; they and the table go when the query is analysed."""
    told = {n: spark.catalog.functionExists(n) for n in DEFINITIONS}
    register_sql(spark)
    try:
        return spark.sql("""WITH p AS (SELECT *, tile_column(lon, 12) AS c, tile_row(lat, 12) AS r, mercator_x(lon) AS mx, floor(mercator_x(lon)) AS ux, floor(mercator_y(lat)) AS uy FROM {fixes}),
        t AS (SELECT *, tile_key(12, c, r) AS key, tile_unkey(tile_key(12, c, r)) AS u, tile_rect(12, c, r) AS b, enclosing_tile(ux, uy + 3, ux + event_id % 5000, uy) AS a FROM p)
        SELECT event_id, round(haversine_m(lon, lat, 127.0D, 37.5D), 2) AS metres, round(mx, 4) AS mx, c, r, key, flip_y(12, r) AS flipped, u.level AS l2, u.x AS c2, u.y AS r2,
          b.left AS west, b.bottom AS south, b.right AS east, b.top AS north, a.level AS around, a.x AS around_x, a.y AS around_y FROM t""", fixes=ad.fixes(spark, sf_dir))
    finally:
        for name, kept in told.items():
            if not kept:
                spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


_STATUS = """CASE WHEN bytes IS NULL THEN 'missing' WHEN bytes < CASE WHEN layer = 'image' THEN 3000 ELSE 200 END THEN CASE WHEN level < 15 THEN 'refetch' ELSE 'empty' END ELSE 'ok' END"""


@query(f"SELECT layer, level, x, y, bytes, {_STATUS} AS status FROM ({ad.INVENTORY}) i")
def f5_tile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.tile_status(ad.inventory(spark, sf_dir))


_WANTED = f"SELECT DISTINCT 16 AS level, {_at('x', 16)} AS x, {_at('y', 16)} AS y FROM ({LONLAT}) p"


def _wanted(spark: SparkSession, sf_dir: str, level: int = 16) -> DataFrame:
    return _points(spark, sf_dir).select(tiles.tile_at("x", "y", level).alias("t")).select("t.*")


@query(f"""WITH w AS ({_WANTED}), t AS (SELECT DISTINCT level, x, y FROM ({ad.INVENTORY}) i)
SELECT w.level, w.x, w.y, max(t.level) AS found_level, arg_max(t.x, t.level) AS found_x, arg_max(t.y, t.level) AS found_y
FROM w LEFT JOIN t ON t.level <= 16 AND t.x = w.x // CAST(pow(2, 16 - t.level) AS BIGINT) AND t.y = w.y // CAST(pow(2, 16 - t.level) AS BIGINT)
  GROUP BY w.level, w.x, w.y""")
def j3_fallback_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.fallback_tile(ad.inventory(spark, sf_dir), _wanted(spark, sf_dir))


@query(f"""WITH t AS (SELECT DISTINCT level, x, y FROM ({ad.INVENTORY}) i), s AS (SELECT *, pow(2e0, 20 - level) AS n FROM t),
p AS (SELECT level, x, y, 'north' AS side, x * n AS px, y * n + n + 0.5e0 AS py FROM s UNION ALL SELECT level, x, y, 'south', x * n, y * n - 0.5e0
  FROM s
 UNION ALL SELECT level, x, y, 'west', x * n - 0.5e0, y * n + 0.5e0 FROM s UNION ALL SELECT level, x, y, 'east', x * n + n + 0.5e0, y * n + 0.5e0
    FROM s),
l AS (SELECT p.*, k.level AS kl, CAST(floor(px / pow(2, 20 - k.level)) AS BIGINT) AS kx, CAST(floor(py / pow(2, 20 - k.level)) AS BIGINT) AS ky
  FROM p, (SELECT unnest(range(0, 21))::INT AS level) k WHERE px >= 0 AND py >= 0 AND px < 1048576 AND py < 1048576),
f AS (SELECT l.level, l.x, l.y, side, max(kl) AS fl, arg_max(kx, kl) AS fx, arg_max(ky, kl) AS fy FROM l
  JOIN t ON t.level = kl AND t.x = kx AND t.y = ky GROUP BY ALL)
SELECT p.level, p.x, p.y, p.side, CASE WHEN o THEN fl END AS n_level, CASE WHEN o THEN fx END AS n_x, CASE WHEN o THEN fy END AS n_y FROM (
SELECT p.*, fl, fx, fy, NOT (fl = p.level AND fx = p.x AND fy = p.y) AS o FROM p LEFT
  JOIN f ON f.level = p.level AND f.x = p.x AND f.y = p.y AND f.side = p.side) p""")
def j4_tile_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.tile_neighbors(ad.inventory(spark, sf_dir))


@query(f"""WITH w AS (SELECT DISTINCT 'image' AS layer, 9 AS level, {_at('x', 9)} AS x, {_at('y', 9)} AS y FROM ({LONLAT}) p UNION SELECT layer, level, x, y
  FROM ({ad.INVENTORY}) i),
i AS (SELECT layer, level, x, y, max(bytes) AS bytes FROM ({ad.INVENTORY}) i GROUP BY ALL)
SELECT layer, level, x, y, status FROM (SELECT layer, level, x, y, {_STATUS} AS status FROM w LEFT JOIN i USING (layer, level, x, y)) q
  WHERE status IN ('missing', 'refetch')""")
def j6_fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = ad.inventory(spark, sf_dir)
    asked = _wanted(spark, sf_dir, 9).select(F.lit("image").alias("layer"), "level", "x", "y").unionByName(inventory.select("layer", "level", "x", "y"))
    return tl.fetch_plan(asked.withColumn("kind", (F.col("layer") == "height").cast("int")), inventory).select("layer", "level", "x", "y", "status")


@query(f"""SELECT level, x, y, count(*) AS n
  FROM (SELECT l AS level, CAST(floor(x / pow(2, 20 - l)) AS BIGINT) AS x, CAST(floor(y / pow(2, 20 - l)) AS BIGINT) AS y
  FROM ({LONLAT}) p, (SELECT unnest([4, 8, 12, 15])::INT AS l) k) q GROUP BY ALL""")
def a9_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.cell_counts(_points(spark, sf_dir), [4, 8, 12, 15])


@query(f"SELECT layer, level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({ad.INVENTORY}) i GROUP BY ROLLUP (layer, level)")
def a10_tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.tile_coverage(ad.inventory(spark, sf_dir))


@query(f"SELECT DISTINCT 11 AS level, {_at('x', 11)} AS x, {_at('y', 11)} AS y FROM ({LONLAT}) p")
def o3_distinct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.distinct_cells(_points(spark, sf_dir), 11)


_CELLS = f"SELECT DISTINCT 11 AS level, {_at('x', 11)} AS x, {_at('y', 11)} AS y FROM ({LONLAT}) p WHERE event_id % 2 = {{}}"


@query(f"""SELECT *, 'diff' AS kind FROM (({_CELLS.format(0)}) EXCEPT ({_CELLS.format(1)})) a UNION ALL SELECT *, 'common'
  FROM (({_CELLS.format(0)}) INTERSECT ({_CELLS.format(1)})) b""")
def o4_cell_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir)
    a, b = (tl.distinct_cells(rows.filter(F.col("event_id") % 2 == k), 11) for k in (0, 1))
    return tl.cells_diff(a, b).withColumn("kind", F.lit("diff")).unionByName(tl.cells_common(a, b).withColumn("kind", F.lit("common")))


@query(f"SELECT layer, level, x, y, max(bytes) AS bytes FROM ({ad.INVENTORY}) i WHERE bytes IS NOT NULL GROUP BY layer, level, x, y")
def s14_tile_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory's files, of both layers, written in their sizes and listed again."""
    known = ad.inventory(spark, sf_dir).filter("bytes is not null").groupBy("layer", "level", "x", "y").agg(F.max("bytes").alias("bytes"))
    name = F.when(F.col("layer") == "image", tiles.tile_path("image", "level", "x", "y")).otherwise(tiles.tile_path("height", "level", "x", "y"))
    home = scratch(spark)
    write_files(known.select(F.concat_ws("/", "layer", name).alias("file"), F.repeat(F.lit("."), F.col("bytes").cast("int")).cast("binary").alias("content")), home)
    told = [read_tile_inventory(spark, f"{home}/{layer}", layer, tiles.LAYERS[layer][2]) for layer in ("image", "height")]
    return told[0].unionByName(told[1]).select("layer", "level", "x", "y", "bytes")


_DEMS = f"SELECT level, x, y, list_transform(range(0, 256), lambda i: (k * 31 + i * 17) % 4001 - 50) AS z FROM ({ad.DEM}) d"


@query(f"SELECT level, x, y, round(list_min(z) * 0.05e0, 4) AS min_h, round(greatest(2e0, list_max(z) * 0.05e0), 4) AS max_h FROM ({_DEMS}) d")
def a3_dem_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.dem_bounds(ad.dem(spark, sf_dir)).select("level", "x", "y", F.round("min_h", 4).alias("min_h"), F.round("max_h", 4).alias("max_h"))


@query(f"SELECT 8 AS level, x // 4 AS x, y // 4 AS y, round(max(greatest(2e0, list_max(z) * 0.05e0)), 4) AS max_h FROM ({_DEMS}) d GROUP BY 2, 3")
def a4_max_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.max_height_by_ancestor(ad.dem(spark, sf_dir), 8).select("level", "x", "y", F.round("max_h", 4).alias("max_h"))


_CELL = "CAST(floor(least(greatest({u}, 0e0), 1e0) * 15) AS BIGINT)"
_HEIGHT = f"""SELECT event_id, x AS px, y AS py, round(z[{_CELL.format(u='1e0 - (y / 1024e0 - ty)')} * 16 + {_CELL.format(u='x / 1024e0 - tx')} + 1] * 0.05e0, 4) AS elevation
  FROM (
SELECT p.*, {_at('p.x', 10)} AS tx, {_at('p.y', 10)} AS ty FROM ({LONLAT}) p) p LEFT JOIN (SELECT x AS dx, y AS dy, z
  FROM ({_DEMS}) d) d ON dx = tx AND dy = ty"""


@query(f"SELECT event_id, elevation FROM ({_HEIGHT}) h")
def m19_j5_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of all fixes: their tiles at level 12 fall back to the maps at level 10."""
    told = terrain.elevation(_points(spark, sf_dir).select("event_id", "x", "y"), ad.dem(spark, sf_dir), 12)
    return told.select("event_id", F.round("elevation", 4).alias("elevation"))


@query(f"SELECT event_id AS line, round(px, 5) AS x, coalesce(elevation, 0e0) AS y, round(py, 5) AS z FROM ({_HEIGHT}) h")
def u3_tracks_to_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ad.fixes(spark, sf_dir).select(F.lit("f").alias("file"), F.col("event_id").alias("line"), "ts", "lon", "lat")
    return terrain.tracks_to_3d(log, ad.dem(spark, sf_dir), 12).select("line", F.round("x", 5).alias("x"), F.round("y", 4).alias("y"), F.round("z", 5).alias("z"))
