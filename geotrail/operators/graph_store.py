"""A road graph that grows with new track files, stored by coarse cells of the map.

Vertices are kept as partial sums of their points (sx, sy, n by merge cell), edges as counts by pair of merge cells, under the
coarse cell of their first.  Adding files writes new versions of the cells that they touch and leaves the others'
files as they are.  What has been added stands in a work history, one a commit.  A commit names the live version of each
cell and the histories; it is written last, so readers see files added as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotrail.functions.geo import UNIT_LEVEL
from geotrail.operators import graph
from geotrail.operators.tables import pending_files
from geotrail.sources import text
from geotrail.sources.commits import CommitLog

#: Level of the coarse cells: there are 4 ** LEVEL at most, and their names pass through the driver.
LEVEL = 10
#: Files of a cell: tasks write some cells' files instead of one in each cell, so that files don't grow as tasks times cells do.
FILES = 16
_VERTEX = "gx long, gy long, sx double, sy double, n long"
_EDGE = "a_x long, a_y long, b_x long, b_y long, n long"
_CHANGE = "kind string, a_x long, a_y long, b_x long, b_y long, sx double, sy double, n long, cell string"
_KEYS = {"vertices": ["gx", "gy"], "edges": ["a_x", "a_y", "b_x", "b_y"]}


class GraphStore:
    """A graph below ``home``; ``cell``: units of a merge cell."""

    def __init__(self, spark: SparkSession, home: str, cell: float = graph.MERGE):
        self.spark, self.home, self.cell = spark, home, cell
        self.log = CommitLog(spark, f"{home}/_log")

    def folder(self, part: str, version: int) -> str:
        kind, _, name = part.partition("/")
        return f"{self.home}/{kind}/cell={name}/version={version}" if kind in _KEYS else f"{self.home}/{kind}/{version}"

    def history(self) -> DataFrame:
        """history(file, is_complete, line, place) of all files that have been added."""
        paths = [self.folder(part, version) for part, version in self.log.read().items() if part.startswith("history/")]
        if not paths:
            return self.spark.range(0).select(F.lit("").alias("file"), F.lit(True).alias("is_complete"), F.lit(0).alias("line"), F.lit(0).alias("place"))
        return text.parse_history_lines(self.spark.read.text(paths).withColumn("place", F.lit(0)), "place")

    def add(self, tracks: DataFrame) -> int:
        """Adds the files of ``tracks`` (file, line, x, y) that haven't been added; a file must come whole.  The number of files added."""
        tracks = tracks.withColumn("file", F.col("file").cast("string"))
        files = pending_files(tracks.select("file").distinct(), self.history()).persist()
        live, number = self.log.read(), (self.log.last() or 0) + 1
        aside = f"{self.home}/_changes/{number}"
        try:
            count = files.count()
            if not count:
                return 0
            self._changes(tracks.join(files, "file", "left_semi")).write.mode("overwrite").parquet(aside)
            rows = self.spark.read.schema(_CHANGE).parquet(aside)
            touched = {kind: [] for kind in _KEYS}
            for r in rows.select("kind", "cell").distinct().collect():  # coarse cells
                touched[r.kind].append(f"{r.kind}/{r.cell}")
            for kind, parts in touched.items():
                live |= self._grow(kind, rows.filter(F.col("kind") == kind), parts, live, number)
            text.write_history(files.select("file", F.lit(True).alias("is_complete"), F.lit(0).alias("line")), self.folder(f"history/{number}", number))
            self.log.write(number, live | {f"history/{number}": number})
            self.log.drop(self.folder)
            return count
        finally:
            files.unpersist()
            self.log.files.delete(self.log.path(aside), True)

    def _changes(self, tracks: DataFrame) -> DataFrame:
        """What tracks add: the sums of ``graph.merge_points`` and the counts of ``graph.merge_edges``, from one pass over them."""
        at = [F.floor(F.col(c) / self.cell).alias(n) for c, n in (("x", "gx"), ("y", "gy"))]
        here = tracks.select("file", "line", "x", "y", F.struct(*at).alias("here")).withColumn("last", F.lag("here").over(Window.partitionBy("file").orderBy("line")))
        none = lambda c: F.when(F.lit(False), F.col(c))
        row = lambda kind, *rest: F.struct(F.lit(kind).alias("kind"), *(c.alias(n) for c, n in zip(rest, ("a", "b", "x", "y"), strict=True)))
        point, step = row("vertices", F.col("here"), none("here"), F.col("x"), F.col("y")), row("edges", F.least("last", "here"), F.greatest("last", "here"), none("x"), none("y"))
        both = here.select(F.explode(F.array(point, F.when(F.col("last").isNotNull() & (F.col("last") != F.col("here")), step))).alias("r")).filter("r is not null")
        rows = both.select("r.kind", F.col("r.a.gx").alias("a_x"), F.col("r.a.gy").alias("a_y"), F.col("r.b.gx").alias("b_x"), F.col("r.b.gy").alias("b_y"), "r.x", "r.y")
        sums = rows.groupBy("kind", "a_x", "a_y", "b_x", "b_y").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
        coarse = F.concat_ws("_", *(F.floor(F.col(c) * self.cell / (1 << (UNIT_LEVEL - LEVEL))).cast("string") for c in ("a_x", "a_y")))
        return sums.withColumn("cell", coarse)

    def _grow(self, kind: str, rows: DataFrame, touched: list[str], live: dict[str, int], number: int) -> dict[str, int]:
        """Adds rows of ``_changes`` to the sums of the cells that they touch, as version ``number``; the new versions by part."""
        if not touched:
            return {}
        keys = _KEYS[kind]
        new = rows.withColumnsRenamed({"a_x": "gx", "a_y": "gy"}) if kind == "vertices" else rows
        old = self._read(kind, {part: live[part] for part in touched if part in live}, with_cell=True)
        told = [c for c in ("sx", "sy", "n") if kind == "vertices" or c == "n"]
        both = new.select("cell", *keys, *told)
        both = both if old is None else both.unionByName(old)
        dealt = both.withColumn("deal", F.pmod(F.xxhash64(*keys), F.lit(FILES))).repartition("cell", "deal")
        sums = dealt.groupBy("cell", "deal", *keys).agg(*(F.sum(c).alias(c) for c in told)).drop("deal").withColumn("version", F.lit(number))
        sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell", "version").parquet(f"{self.home}/{kind}")
        return dict.fromkeys(touched, number)

    def _read(self, kind: str, parts: dict[str, int], with_cell: bool = False) -> DataFrame | None:
        if not parts:
            return None
        schema = (_VERTEX if kind == "vertices" else _EDGE) + ", cell string, version int"
        rows = self.spark.read.schema(schema).option("basePath", f"{self.home}/{kind}").parquet(*(self.folder(*part) for part in parts.items()))
        return rows.drop("version") if with_cell else rows.drop("version", "cell")

    def read(self) -> tuple[DataFrame, DataFrame] | None:
        """Rows of ``graph.merge_points`` and ``graph.merge_edges`` of all files added; None before the first."""
        live = self.log.read()
        vertices, edges = (self._read(kind, {part: v for part, v in live.items() if part.startswith(kind)}) for kind in _KEYS)
        if vertices is None:
            return None
        merged = vertices.select("gx", "gy", (F.col("sx") / F.col("n")).alias("px"), (F.col("sy") / F.col("n")).alias("pz"), F.col("n").alias("acc_cnt"))
        edges = self.spark.createDataFrame([], _EDGE) if edges is None else edges
        end = lambda name: F.struct(F.col(f"{name}_x").alias("gx"), F.col(f"{name}_y").alias("gy")).alias(name)
        return merged, edges.select(end("a"), end("b"), F.col("n").alias("cnt"))

    def graph(self, cap: int = graph.CAP) -> tuple[DataFrame, DataFrame] | None:
        """(vertices, edges) of all files added, as ``graph.build_road_graph`` has them."""
        rows = self.read()
        return rows and graph.assemble(*rows, cap)
