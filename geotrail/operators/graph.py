"""A road graph from tracks (file, line, x, y in units): merged vertices, undirected edges, adaptive cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.geo import UNIT_LEVEL
from geotrail.functions.tiles import qgid_pack
from geotrail.sources.scratch import scratch, written

#: Units of a merge cell; coarsest and finest level of adaptive cells (4 bits hold a level), points of a cell.
MERGE, START_LEVEL, LAST_LEVEL, CAP = 0.5, 6, 15, 200


def _cell(cell: float):
    return [F.floor(F.col(c) / cell).alias(n) for c, n in (("x", "gx"), ("y", "gy"))]


def merge_points(track: DataFrame, cell: float = MERGE) -> DataFrame:
    """One vertex for each grid cell with points: (gx, gy, px, pz, acc_cnt), the mean place and number of its points."""
    cells = track.select("x", "y", *_cell(cell))
    return cells.groupBy("gx", "gy").agg(F.avg("x").alias("px"), F.avg("y").alias("pz"), F.count("*").alias("acc_cnt"))


def merge_edges(track: DataFrame, cell: float = MERGE) -> DataFrame:
    """Undirected edges between the cells of consecutive points of a file, with counts; none from a cell to itself.

    (a, b, cnt): a and b are struct<gx, gy>, a the lesser.
    """
    w = Window.partitionBy("file").orderBy("line")
    here = track.select("file", "line", F.struct(*_cell(cell)).alias("here"))
    pairs = here.withColumn("last", F.lag("here").over(w)).filter("last is not null and last <> here")
    return pairs.select(F.least("last", "here").alias("a"), F.greatest("last", "here").alias("b")).groupBy("a", "b").agg(F.count("*").alias("cnt"))


#: Tiles that leaders are elected in, in radii; cells that leaders are sought in, a little over a radius so that rounding loses none.
TILE, REACH = 128, 1.001
#: What a round says of a row: a leader that other tiles or later rounds need, an open point, one that isn't a leader but whose own may be open, a decided one.
_LEADER, _OPEN, _TAKEN, _DONE = range(4)


def _dealt(rows: DataFrame, radius: float) -> DataFrame:
    """Rows (file, line, x, y, kind) by tile; what may matter to points of a neighbouring tile stands there too, not as its ``own``."""
    at = lambda dx, dy: F.struct(*(F.floor((F.col(c) + d * REACH * radius) / (TILE * radius)).alias(n) for c, n, d in (("x", "tx", dx), ("y", "ty", dy))))
    around = F.when(F.col("kind") == _TAKEN, F.array(at(0, 0))).otherwise(F.array_distinct(F.array(*(at(i, j) for i in (0, 1) for j in (0, -1, 1)))))
    told = rows.select("*", at(0, 0).alias("home"), F.explode(around).alias("tile")).withColumn("own", F.col("tile") == F.col("home"))
    return told.select("tile.tx", "tile.ty", "own", *(F.when(F.col("own"), F.col(c)).alias(c) for c in ("file", "line")), "x", "y", "kind")


def _elected(rows: DataFrame, radius: float, schema: str) -> DataFrame:
    """One round over rows of ``_dealt``: a sweep along each tile's places, that holds what it knows of two columns of cells."""
    cell, squared, size = REACH * radius, radius * radius, TILE * radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, column, here, verdict = None, None, None, None
        lead, wait = [{}, {}], [{}, {}]  # by row, of the column before and this one: leaders [x, y, told], undecided (x, y)
        for batch in batches:
            tx, ty, own, _, _, x, y, kind = (c.to_numpy(zero_copy_only=False) if k not in (3, 4) else None for k, c in enumerate(batch.columns))
            cells = zip(np.floor(x / cell).tolist(), np.floor(y / cell).tolist(), strict=True)
            edge = (np.floor((x + cell) / size) != tx) | (np.floor((y - cell) / size) != ty) | (np.floor((y + cell) / size) != ty)
            said, lx, ly, needed = np.full(len(x), -1, np.int32), x.copy(), y.copy(), []
            for k, (t, (cx, cy), px, py, mine, was) in enumerate(zip(zip(tx.tolist(), ty.tolist(), strict=True), cells, x.tolist(), y.tolist(), own.tolist(), kind.tolist(), strict=True)):
                if (t, px, py) != here:
                    if t != tile or cx != column:
                        beside = t == tile and cx - 1 == column
                        lead, wait = ([lead[1], {}], [wait[1], {}]) if beside else ([{}, {}], [{}, {}])
                        tile, column = t, cx
                    here, verdict = (t, px, py), (-1, px, py)
                    if was == _LEADER:
                        lead[1].setdefault(cy, []).append([px, py, True])
                    elif not mine:
                        wait[1].setdefault(cy, []).append((px, py))
                    else:
                        near = sorted((d, q[0], q[1], q) for side in lead for r in (cy - 1, cy, cy + 1) for q in side.get(r, ()) if (d := (px - q[0]) * (px - q[0]) + (py - q[1]) * (py - q[1])) <= squared)
                        waits = any((px - q[0]) * (px - q[0]) + (py - q[1]) * (py - q[1]) <= squared for side in wait for r in (cy - 1, cy, cy + 1) for q in side.get(r, ()))
                        if waits:
                            verdict = (_TAKEN if near or was == _TAKEN else _OPEN, px, py)
                            if verdict[0] == _OPEN:
                                wait[1].setdefault(cy, []).append((px, py))
                            new = [q for *_, q in near if not q[2]]
                        elif near:
                            verdict, new = (_DONE, near[0][1], near[0][2]), []
                        else:
                            verdict, one = (_DONE, px, py), [px, py, False]
                            lead[1].setdefault(cy, []).append(one)
                            new = [one] if edge[k] else []
                        for q in new:
                            q[2] = True
                            needed.append((q[0], q[1]))
                if mine and was != _LEADER:
                    said[k], lx[k], ly[k] = verdict
            pick, m = np.flatnonzero(said >= 0), len(needed)
            qx, qy = np.array(needed, float).reshape(m, 2).T
            both = lambda a, b, kind: pa.array(np.concatenate([a[pick], b]), kind)
            names = [pa.concat_arrays([batch.column(c).take(pa.array(pick)), pa.nulls(m, batch.column(c).type)]) for c in (3, 4)]
            yield pa.RecordBatch.from_arrays([*names, both(x, qx, pa.float64()), both(y, qy, pa.float64()), both(said, np.full(m, _LEADER, np.int32), pa.int32()), both(lx, qx, pa.float64()), both(ly, qy, pa.float64())], names=["file", "line", "x", "y", "kind", "lx", "ly"])

    return rows.repartition("tx", "ty").sortWithinPartitions("tx", "ty", "x", "y").mapInArrow(run, schema)


def merge_by_radius(track: DataFrame, radius: float = MERGE) -> tuple[DataFrame, DataFrame]:
    """Vertices and the vertex of each point, merged within a radius instead of by grid cells: (vertices, members).

    vertices: (id, px, pz, acc_cnt), the mean place and number of a leader's points; members: (file, line, id).  Leaders are
    elected: going by least place (x, then y), a place leads unless an earlier leader is within the radius, and then it belongs to the
    nearest leader (of equally near ones the first).  Points are dealt to tiles, sorted there by Spark and swept once, in
    order; what waits for a point across a tile's edge is decided in rounds, to which only the open points and the leaders
    near them go on.  There are at most as many rounds as tiles in a chain of places that wait for one another.  The result doesn't
    depend on tiles, nor on the points' order; points at one place are one, and points without a place are none.  A task
    holds the leaders and open places of two columns of a tile's cells; a tile with very many points is one task's.
    """
    spark = track.sparkSession
    home, kinds = scratch(spark), dict(track.select("file", "line").dtypes)
    schema = f"file {kinds['file']}, line {kinds['line']}, x double, y double, kind int, lx double, ly double"
    told = lambda: spark.read.schema(f"{schema}, round int").parquet(home)
    rows = _dealt(track.filter("x is not null and y is not null").select("file", "line", "x", "y", F.lit(_OPEN).alias("kind")), radius)
    number = 0
    while True:
        _elected(rows, radius, schema).write.parquet(f"{home}/round={number}")
        left = told().filter((F.col("round") == number) & F.col("kind").isin(_OPEN, _TAKEN))
        if left.isEmpty():
            break
        again = _dealt(told().filter(((F.col("round") == number) & F.col("kind").isin(_OPEN, _TAKEN)) | (F.col("kind") == _LEADER)).select("file", "line", "x", "y", "kind"), radius)
        rows = again.join(_dealt(left, radius).filter("own").select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")
        number += 1
    members = told().filter(F.col("kind") == _DONE).select("file", "line", "x", "y", F.struct(F.col("lx").alias("x"), F.col("ly").alias("y")).alias("id"))
    vertices = members.groupBy("id").agg(F.avg("x").alias("px"), F.avg("y").alias("pz"), F.count("*").alias("acc_cnt"))
    return vertices, members.select("file", "line", "id")


def member_edges(members: DataFrame) -> DataFrame:
    """Undirected edges (a, b, cnt) between the vertices of consecutive points of a file, from ``merge_by_radius``'s members."""
    here = members.withColumn("last", F.lag("id").over(Window.partitionBy("file").orderBy("line"))).filter("last is not null and last <> id")
    return here.select(F.least("last", "id").alias("a"), F.greatest("last", "id").alias("b")).groupBy("a", "b").agg(F.count("*").alias("cnt"))


def vertex_degree(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, tr_cnt): the number of different vertices that each vertex has an edge to."""
    ends = edges.select(F.col(src).alias("id"), F.col(dst).alias("other")).union(edges.select(F.col(dst), F.col(src)))
    return ends.distinct().groupBy("id").agg(F.count("*").alias("tr_cnt"))


def adaptive_cells(points: DataFrame, start: int = START_LEVEL, cap: int = CAP, last: int = LAST_LEVEL) -> DataFrame:
    """Leaves (level, x, y, n) over the points' finest cells (fx, fy): the coarsest cell with at most ``cap`` points.

    (fx, fy, level, x, y, n).  Points are counted once, at the finest level, before they are shuffled; a coarsest cell has at
    most 4 ** (last - start) finest ones, whose counts are summed up level by level in one task.
    """
    size = float(1 << (UNIT_LEVEL - last))
    fine = points.groupBy(F.floor(F.col("x") / size).alias("fx"), F.floor(F.col("y") / size).alias("fy")).agg(F.count("*").alias("m"))
    up = lambda k: [F.shiftright(c, last - k) for c in ("fx", "fy")]
    total = lambda k: F.sum("m").over(Window.partitionBy(*up(start), *up(k)))
    leaf = lambda k: F.struct(F.lit(k).alias("level"), up(k)[0].alias("x"), up(k)[1].alias("y"), total(k).alias("n"))
    picked = F.coalesce(*(F.when(total(k) <= cap, leaf(k)) for k in range(start, last)), leaf(last))
    return fine.select("fx", "fy", picked.alias("c")).select("fx", "fy", "c.level", "c.x", "c.y", "c.n")


def vertex_index(vertices: DataFrame) -> DataFrame:
    """Adds ``idx``, a vertex's number inside its cell (level, x, y), and ``qgid``.

    A cell has ``CAP`` vertices, or, at the last level, no more than merge cells: 4,096 of half a unit.
    """
    w = Window.partitionBy("level", "x", "y").orderBy("gx", "gy")
    return vertices.withColumn("idx", F.row_number().over(w) - 1).withColumn("qgid", qgid_pack("level", "x", "y", "idx"))


def edge_geometry(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges (src, dst, cnt) with the places of both ends: (src, dst, cnt, x0, y0, x1, y1)."""
    end = lambda key, x, y: vertices.select(F.col("qgid").alias(key), F.col("px").alias(x), F.col("pz").alias(y))
    return edges.join(end("src", "x0", "y0"), "src").join(end("dst", "x1", "y1"), "dst").select("src", "dst", "cnt", "x0", "y0", "x1", "y1")


def assemble(merged: DataFrame, steps: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) from rows of ``merge_points`` and of ``merge_edges``: vertices with their adaptive cell, qgid and degree, edges by qgid.

    Vertices and edges are written once below the session's shared folder, as each is read several times.
    """
    size = float(1 << (UNIT_LEVEL - LAST_LEVEL))
    merged = written(merged)
    placed = merged.withColumn("fx", F.floor(F.col("px") / size)).withColumn("fy", F.floor(F.col("pz") / size))
    leaves = adaptive_cells(merged.select(F.col("px").alias("x"), F.col("pz").alias("y")), cap=cap)
    vertices = written(vertex_index(placed.join(leaves.select("fx", "fy", "level", "x", "y"), ["fx", "fy"])))
    ids = vertices.select(F.struct("gx", "gy").alias("cell"), "qgid")
    name = lambda end, key: ids.select(F.col("cell").alias(end), F.col("qgid").alias(key))
    edges = steps.join(name("a", "src"), "a").join(name("b", "dst"), "b").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "cnt")
    edges = written(edges)
    degree = vertex_degree(edges).withColumnRenamed("id", "qgid")
    told = vertices.join(degree, "qgid", "left").select("qgid", "level", "x", "y", "idx", "px", "pz", "acc_cnt", F.coalesce("tr_cnt", F.lit(0)).cast("long").alias("tr_cnt"))
    return told, edges


def build_road_graph(track: DataFrame, cell: float = MERGE, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of tracks, as ``assemble`` has them; the tracks are read twice."""
    return assemble(merge_points(track, cell), merge_edges(track, cell), cap)
