"""Queries over tracks: matching, merging, the road graph, projections of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotrail.functions import geo
from geotrail.operators import fixes as fx
from geotrail.operators import graph, match
from geotrail.operators.graph_store import GraphStore
from geotrail.plans import adapters as ad
from geotrail.plans.catalog import query
from geotrail.sources.scratch import scratch
from geotrail.sources import text

#: Places and segments of tracks, each computed once.
_SEG = f"""placed AS MATERIALIZED ({ad.PLACED}),
seg AS MATERIALIZED (
 SELECT * FROM (SELECT file, line, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM placed
    WINDOW w AS (PARTITION BY file ORDER BY line)) q
  WHERE x1 IS NOT NULL),
pts AS MATERIALIZED (
  SELECT file, line, x, y, degrees(2e0 * atan(exp((y / 1048576e0 - 0.5e0) * 2e0 * pi())) - pi() / 2e0) AS lat,
    CAST(floor(x / 8) AS BIGINT) AS cx, CAST(floor(y / 8) AS BIGINT) AS cy FROM placed)"""
#: Cells of 8 units that the box around a segment touches, 2 units added on each side.
_CELLS = """cells AS MATERIALIZED (
  SELECT seg.*, cx, cy FROM seg,
    unnest(range(CAST(floor((least(x0, x1) - 2) / 8) AS BIGINT), CAST(floor((greatest(x0, x1) + 2) / 8) AS BIGINT) + 1)) a(cx),
    unnest(range(CAST(floor((least(y0, y1) - 2) / 8) AS BIGINT), CAST(floor((greatest(y0, y1) + 2) / 8) AS BIGINT) + 1)) b(cy))"""
#: All pairs of points and other tracks' segments within 30 m; the nearest segment of each other track.
_NEAR = f"""{_SEG},
{_CELLS},
feet AS (
  SELECT *, x0 + t * dx AS foot_x, y0 + t * dy AS foot_y FROM (
 SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) ELSE 0e0 END AS t
      FROM (
      SELECT p.file, p.line, p.x, p.y, p.lat, c.file AS seg_file, c.line AS seg_line, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy
      FROM pts p JOIN cells c ON c.cx = p.cx AND c.cy = p.cy AND c.file <> p.file) q) r),
near AS MATERIALIZED (
  SELECT file, line, seg_file, seg_line, foot_x, foot_y, distance FROM (
 SELECT *, sqrt((x - foot_x) * (x - foot_x) + (y - foot_y) * (y - foot_y)) * (2e0 * pi() * 6378137e0 / 1048576e0 * cos(radians(lat))) AS distance
      FROM feet) q
  WHERE distance <= 30e0),
best AS MATERIALIZED (

    SELECT file, line, seg_file, min(distance) AS distance, arg_min(foot_x, (round(distance, 6), seg_line)) AS foot_x, arg_min(foot_y, (round(distance, 6), seg_line)) AS foot_y
  FROM near GROUP BY file, line, seg_file),
mean AS MATERIALIZED (

    SELECT p.file, p.line, coalesce(n, 0) AS n, (p.x + coalesce(sx, 0e0)) / (coalesce(n, 0) + 1) AS x, (p.y + coalesce(sy, 0e0)) / (coalesce(n, 0) + 1) AS y
  FROM pts p LEFT JOIN (SELECT file, line, sum(foot_x) AS sx, sum(foot_y) AS sy, count(*) AS n FROM best GROUP BY file, line) f USING (file, line))"""


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = ad.tracks(spark, sf_dir)
    return points, match.nearest_segments(points, fx.segments(points), 30.0)


@query(f"WITH {_NEAR} SELECT file, line, seg_file, round(distance, 3) AS distance FROM best")
def j2_m16_nearest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)[1].select("file", "line", "seg_file", F.round("distance", 3).alias("distance"))


@query(f"""WITH p AS (
 SELECT file, line, x AS ax, y AS ay, lead(x) OVER w AS cx, lead(y) OVER w AS cy, lead(x, 2) OVER w AS x, lead(y, 2) OVER w AS y FROM ({ad.PLACED}) q
    WINDOW w AS (PARTITION BY file ORDER BY line)),
t AS (SELECT *, greatest(0e0, least(1e0, ((x - ax) * (cx - ax) + (y - ay) * (cy - ay)) / ((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)))) AS t FROM p
  WHERE x IS NOT NULL),
f AS (SELECT file, line, x, y, ax + t * (cx - ax) AS fx, ay + t * (cy - ay) AS fy FROM t)
SELECT file, line, round(fx, 4) AS foot_x, round(fy, 4) AS foot_y,
  round(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) * (2e0 * pi() * 6378137e0 / 1048576e0 * cos(2e0 * atan(exp((y / 1048576e0 - 0.5e0) * 2e0 * pi())) - pi() / 2e0)), 3) AS distance
    FROM f""")
def m16_point_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment of a track with the point after it."""
    w = Window.partitionBy("file").orderBy("line")
    rows = ad.tracks(spark, sf_dir).select("file", "line", *(F.lead(c, k).over(w).alias(f"{c}{k}") for k in range(3) for c in ("x", "y"))).filter("x2 is not null")
    at = geo.point_segment("x2", "y2", "x0", "y0", "x1", "y1", geo.mercator_lat("y2"))
    told = rows.select("file", "line", at.alias("p"))
    return told.select("file", "line", F.round("p.x", 4).alias("foot_x"), F.round("p.y", 4).alias("foot_y"), F.round("p.distance", 3).alias("distance"))


@query(f"WITH {_NEAR} SELECT file, line, n, round(x, 4) AS x, round(y, 4) AS y FROM mean")
def a12_consensus_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, near = _near(spark, sf_dir)
    return match.consensus_points(points, near).select("file", "line", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {_NEAR}, covered AS (SELECT DISTINCT file, line FROM best WHERE seg_file < file),
f AS (SELECT m.*, c.file IS NULL AS free FROM mean m LEFT JOIN covered c USING (file, line)),
b AS (SELECT *, CAST(free AND NOT coalesce(lag(free) OVER (PARTITION BY file ORDER BY line), false) AS INT) AS begins FROM f),
r AS (SELECT *, sum(begins) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT file, line, CAST(run AS BIGINT) AS run, round(x, 4) AS x, round(y, 4) AS y FROM r WHERE free""")
def w5_integrate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ad.tracks(spark, sf_dir)
    return match.integrate_paths(points, fx.segments(points)).select("file", "line", "run", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def w5_integrate_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that the tracks integrated so far leave; each track depends on all before it, which SQL can't say."""
    points = ad.tracks(spark, sf_dir)
    return match.integrate_in_order(points, fx.segments(points)).select("file", "line", "run", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


#: Points with their merge cells, vertices, and edges between cells.
_GRID = f"grid AS MATERIALIZED (SELECT file, line, x, y, CAST(floor(x / 0.5e0) AS BIGINT) AS gx, CAST(floor(y / 0.5e0) AS BIGINT) AS gy FROM ({ad.ROADS}) p)"
_VERTEX = f"""{_GRID},
vertex AS MATERIALIZED (SELECT gx, gy, avg(x) AS px, avg(y) AS pz, count(*) AS acc_cnt FROM grid GROUP BY gx, gy)"""


@query(f"WITH {_VERTEX} SELECT gx, gy, round(px, 5) AS px, round(pz, 5) AS pz, acc_cnt FROM vertex")
def a5_merge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_points(ad.roads(spark, sf_dir)).select("gx", "gy", F.round("px", 5).alias("px"), F.round("pz", 5).alias("pz"), "acc_cnt")


_EDGE = """step AS (
 SELECT *, lx < gx OR (lx = gx AND ly < gy) AS o FROM (SELECT *, lag(gx) OVER w AS lx, lag(gy) OVER w AS ly FROM grid
    WINDOW w AS (PARTITION BY file ORDER BY line)) q
  WHERE lx IS NOT NULL AND NOT (lx = gx AND ly = gy)),
edge AS MATERIALIZED (
  SELECT a_x, a_y, b_x, b_y, count(*) AS cnt FROM (

      SELECT CASE WHEN o THEN lx ELSE gx END AS a_x, CASE WHEN o THEN ly ELSE gy END AS a_y, CASE WHEN o THEN gx ELSE lx END AS b_x, CASE WHEN o THEN gy ELSE ly END AS b_y
      FROM step) s
  GROUP BY a_x, a_y, b_x, b_y)"""


@query(f"WITH {_GRID}, {_EDGE} SELECT a_x, a_y, b_x, b_y, cnt FROM edge")
def a6_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = graph.merge_edges(ad.roads(spark, sf_dir))
    return told.select(F.col("a.gx").alias("a_x"), F.col("a.gy").alias("a_y"), F.col("b.gx").alias("b_x"), F.col("b.gy").alias("b_y"), "cnt")


@query()
def a5_a6_merge_by_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices merged within half a unit, with their degrees; leaders are elected one after the other, which SQL can't say."""
    vertices, members = graph.merge_by_radius(ad.roads(spark, sf_dir))
    degree = graph.vertex_degree(graph.member_edges(members), "a", "b")
    told = vertices.join(degree, "id", "left")
    return told.select(F.round("id.x", 6).alias("x"), F.round("id.y", 6).alias("y"), F.round("px", 5).alias("px"), F.round("pz", 5).alias("pz"), "acc_cnt", F.coalesce("tr_cnt", F.lit(0)).cast("long").alias("tr_cnt"))


#: The coarsest cell with at most 200 points over each finest cell that ``finest`` has.
_LEAVES = """f AS MATERIALIZED (SELECT fx, fy, count(*) AS m FROM finest GROUP BY fx, fy),
u AS MATERIALIZED (
  SELECT fx, fy, m, l AS level, fx // CAST(pow(2, 15 - l) AS BIGINT) AS x, fy // CAST(pow(2, 15 - l) AS BIGINT) AS y
  FROM f, (VALUES (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) k(l)),
n AS MATERIALIZED (SELECT level, x, y, CAST(sum(m) AS BIGINT) AS n FROM u GROUP BY level, x, y),
leaf AS MATERIALIZED (SELECT fx, fy, min(u.level) AS level FROM u JOIN n USING (level, x, y) WHERE n <= 200 OR u.level = 15 GROUP BY fx, fy)"""


@query(f"""WITH finest AS (SELECT CAST(floor(x / 32e0) AS BIGINT) AS fx, CAST(floor(y / 32e0) AS BIGINT) AS fy FROM ({ad.PLACED}) p), {_LEAVES}
SELECT leaf.fx, leaf.fy, leaf.level, u.x, u.y, n.n
FROM leaf JOIN u ON u.fx = leaf.fx AND u.fy = leaf.fy AND u.level = leaf.level JOIN n ON n.level = u.level AND n.x = u.x AND n.y = u.y""")
def a8_adaptive_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adaptive_cells(ad.tracks(spark, sf_dir))


#: The road graph: vertices in their cells, numbered, and edges between their ids.
_V = f"""{_VERTEX}, {_EDGE},
placed AS MATERIALIZED (SELECT *, CAST(floor(px / 32e0) AS BIGINT) AS fx, CAST(floor(pz / 32e0) AS BIGINT) AS fy FROM vertex),
finest AS (SELECT fx, fy FROM placed), {_LEAVES},
v AS (
 SELECT p.*, level, p.fx // CAST(pow(2, 15 - level) AS BIGINT) AS x, p.fy // CAST(pow(2, 15 - level) AS BIGINT) AS y FROM placed p
    JOIN leaf USING (fx, fy)),
q AS MATERIALIZED (
  SELECT *, (idx << 44) | (level::BIGINT << 40) | (y << 20) | x AS qgid FROM (
    SELECT *, row_number() OVER (PARTITION BY level, x, y ORDER BY gx, gy) - 1 AS idx FROM v) i),
e AS MATERIALIZED (
  SELECT least(a.qgid, b.qgid) AS src, greatest(a.qgid, b.qgid) AS dst, cnt, a.px AS ax, a.pz AS az, b.px AS bx, b.pz AS bz, a.qgid < b.qgid AS asis
  FROM edge JOIN q a ON a.gx = a_x AND a.gy = a_y JOIN q b ON b.gx = b_x AND b.gy = b_y)"""


#: Each vertex with its degree: the edges that begin and those that end there.
_DEGREES = f"""WITH {_V},
s AS (SELECT src AS qgid, count(*) AS n FROM e GROUP BY src), t AS (SELECT dst AS qgid, count(*) AS n FROM e GROUP BY dst)
SELECT q.qgid, level, x, y, idx, round(px, 5) AS px, round(pz, 5) AS pz, acc_cnt, coalesce(s.n, 0) + coalesce(t.n, 0) AS tr_cnt FROM q LEFT JOIN s ON s.qgid = q.qgid LEFT JOIN t ON t.qgid = q.qgid"""


def _vertices(vertices: DataFrame) -> DataFrame:
    return vertices.select("qgid", "level", "x", "y", F.col("idx").cast("long").alias("idx"), F.round("px", 5).alias("px"), F.round("pz", 5).alias("pz"), "acc_cnt", "tr_cnt")


@query(_DEGREES)
def u4_w4_a7_road_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vertices(graph.build_road_graph(ad.roads(spark, sf_dir))[0])


@query(_DEGREES)
def u4_j1_s15_grown_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph from a store that grows by a third of the files at a time; files that come again are pending no more."""
    store, tracks = GraphStore(spark, scratch(spark)), ad.roads(spark, sf_dir)
    for k in range(3):
        store.add(tracks.filter(F.col("file") % 3 <= k))
    return _vertices(store.graph()[0])


@query(f"""WITH {_GRID}, {_EDGE} SELECT gx, gy, CAST(sum(n) AS BIGINT) AS tr_cnt FROM (
  SELECT a_x AS gx, a_y AS gy, count(*) AS n FROM edge GROUP BY a_x, a_y UNION ALL SELECT b_x, b_y, count(*) FROM edge GROUP BY b_x, b_y) d GROUP BY gx, gy""")
def a7_vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = graph.vertex_degree(graph.merge_edges(ad.roads(spark, sf_dir)), "a", "b")
    return told.select("id.gx", "id.gy", "tr_cnt")


@query(f"""WITH {_V.replace(ad.ROADS, ad.PLACED)} SELECT src, dst, cnt, round(CASE WHEN asis THEN ax ELSE bx END, 5) AS x0, round(CASE WHEN asis THEN az ELSE bz END, 5) AS y0,
  round(CASE WHEN asis THEN bx ELSE ax END, 5) AS x1, round(CASE WHEN asis THEN bz ELSE az END, 5) AS y1 FROM e""")
def j7_edge_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all tracks with both ends' places; each track has a way of its own, so that all their steps are edges."""
    vertices, edges = graph.build_road_graph(ad.tracks(spark, sf_dir))
    return graph.edge_geometry(edges, vertices).select("src", "dst", "cnt", *(F.round(c, 5).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"""WITH {_SEG},
{_CELLS},
feet AS (
 SELECT *, x0 + t * dx AS foot_x, y0 + t * dy AS foot_y
    FROM (SELECT *, greatest(0e0, least(1e0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) AS t FROM (
 SELECT p.file, p.line, p.x, p.y, p.lat, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM pts p
      JOIN cells c ON c.cx = p.cx AND c.cy = p.cy AND c.file <> p.file) q) r),
near AS (SELECT file, line, sqrt((x - foot_x) * (x - foot_x) + (y - foot_y) * (y - foot_y)) * (2e0 * pi() * 6378137e0 / 1048576e0 * cos(radians(lat))) AS distance
  FROM feet)
SELECT file, line, round(min(distance), 3) AS distance FROM near WHERE distance <= 30e0 GROUP BY file, line""")
def j9_near_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest edge of each point that doesn't touch the point's own vertex: all segments are edges, their far ends below all files."""
    points = ad.tracks(spark, sf_dir)
    edges = fx.segments(points).select(F.col("file").alias("src"), (-(F.col("file") * 100000 + F.col("line"))).alias("dst"), "x0", "y0", "x1", "y1")
    near = match.near_edge(points.withColumn("except_id", F.col("file")), edges, 30.0)
    return near.select("file", "line", F.round("distance", 3).alias("distance"))


#: Krueger's series in the third flattening of WGS84, as SQL.
_N = "0.0016792203863837047e0"
_UTM = f"""z AS (

    SELECT event_id, lon, lat, CAST(floor((lon + 180e0) / 6e0) AS INT) % 60 + 1 AS zone, sin(radians(lat)) AS s, radians(lon - ((floor((lon + 180e0) / 6e0) % 60 + 1) * 6e0 - 183e0)) AS d
    FROM ({ad.FIXES}) f),
c AS (SELECT *, atanh(s) - 0.08181919084262157e0 * atanh(0.08181919084262157e0 * s) AS q FROM z),
h AS (SELECT *, (exp(q) - exp(-q)) / 2e0 AS t FROM c),
u AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1e0 + t * t)) AS eta FROM h),
k AS (SELECT unnest([1, 2, 3, 4]) AS j, unnest([
  {_N} / 2e0 - 2e0 / 3e0 * pow({_N}, 2) + 5e0 / 16e0 * pow({_N}, 3) + 41e0 / 180e0 * pow({_N}, 4), 13e0 / 48e0 * pow({_N}, 2) - 3e0 / 5e0 * pow({_N}, 3) + 557e0 / 1440e0 * pow({_N}, 4),
  61e0 / 240e0 * pow({_N}, 3) - 103e0 / 140e0 * pow({_N}, 4), 49561e0 / 161280e0 * pow({_N}, 4)]) AS a),
p AS (
  SELECT event_id, any_value(lon) AS lon, any_value(lat) AS lat, any_value(zone) AS zone,
    any_value(eta) + sum(a * cos(2 * j * xi) * (exp(2 * j * eta) - exp(-2 * j * eta)) / 2e0) AS e, any_value(xi) + sum(a * sin(2 * j * xi) * (exp(2 * j * eta) + exp(-2 * j * eta)) / 2e0) AS n
  FROM u, k GROUP BY event_id)"""


@query(f"""WITH {_UTM} SELECT event_id, round(CASE WHEN lon > 180e0 THEN lon - 360e0 ELSE lon END, 7) AS lon, round(lat, 7) AS lat, zone,
  round(500000e0 + 0.9996e0 * 6378137e0 / (1e0 + {_N}) * (1e0 + pow({_N}, 2) / 4e0 + pow({_N}, 4) / 64e0) * e, 2) AS easting,
  round(0.9996e0 * 6378137e0 / (1e0 + {_N}) * (1e0 + pow({_N}, 2) / 4e0 + pow({_N}, 4) / 64e0) * n, 2) AS northing FROM p""")
def m14_m15_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to UTM and back."""
    rows = ad.fixes(spark, sf_dir).withColumn("u", geo.utm_forward("lat", "lon"))
    rows = rows.withColumn("g", geo.utm_inverse("u.easting", "u.northing", "u.zone", F.col("lat") < 0))
    return rows.select("event_id", F.round("g.lon", 7).alias("lon"), F.round("g.lat", 7).alias("lat"), "u.zone", F.round("u.easting", 2).alias("easting"), F.round("u.northing", 2).alias("northing"))


@query(f"""WITH p AS (

    SELECT file, line, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y, lead(x) OVER w - first_value(x) OVER w AS x1, lead(y) OVER w - first_value(y) OVER w AS y1
  FROM ({ad.PLACED}) t WINDOW w AS (PARTITION BY file ORDER BY line))
SELECT file, round(sum(x * coalesce(y1, 0e0) - coalesce(x1, 0e0) * y) / 2e0, 1) + 0e0 AS area FROM p GROUP BY file""")
def m23_polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed area of each track closed to a ring, summed from the track's first point, where products are small."""
    w = Window.partitionBy("file").orderBy("line")
    ends = [end(c).over(w).alias(f"{c}{k}") for c in ("x", "y") for k, end in enumerate((F.first, F.lead))]
    rings = ad.tracks(spark, sf_dir).select("file", "x", "y", *ends)
    x, y, x1, y1 = (F.coalesce(c, o) - F.col(o) for c, o in (("x", "x0"), ("y", "y0"), ("x1", "x0"), ("y1", "y0")))
    return rings.groupBy("file").agg((F.round(F.sum(x * y1 - x1 * y) / 2, 1) + 0.0).alias("area"))


@query(f"SELECT name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({ad.LANDMARKS}) l WHERE lon BETWEEN 126e0 AND 129e0 AND lat BETWEEN 34e0 AND 38e0")
def s5_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks written as text, read again and fenced."""
    path = scratch(spark)
    text.write_landmarks(ad.landmarks(spark, sf_dir), path)
    told = fx.geofence(text.read_landmarks(spark, path), (126.0, 129.0, 34.0, 38.0))
    return told.select("name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
