"""Journeys, paths and landmarks as stored tables, and the inventory of tile files."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.sources.scratch import dealt, written
from geotrail.sources.tracks import place


def write_tables(tables: dict[str, DataFrame], target: str, jdbc: dict[str, str] | None = None) -> None:
    """Appends each table under its name: Parquet below ``target``, or tables of the database at a jdbc: address."""
    for name, df in tables.items():
        if target.startswith("jdbc:"):
            df.write.mode("append").jdbc(target, name, properties=jdbc or {})
        else:
            df.write.mode("append").parquet(f"{target}/{name}")


def tile_of_path(files: DataFrame, flipped: bool) -> DataFrame:
    """Files (path, length) named level/row/row_column.ext as tile_files(level, x, y, path, bytes); others are dropped."""
    part = lambda i: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)_(\d+)\.\w+$", i)
    told = files.filter(F.col("path").rlike(r"\d+/\d+/\d+_\d+\.\w+$")).select(part(1).cast("int").alias("level"), part(4).cast("long").alias("x"), part(3).cast("long").alias("row"), "path", F.col("length").alias("bytes"))
    y = F.pow(F.lit(2.0), F.col("level")).cast("long") - F.col("row") - 1 if flipped else F.col("row")
    return told.select("level", "x", y.alias("y"), "path", "bytes")


def list_files(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """(path, length, modified) of all files below a folder (of a file itself), or of those modified after ``since``.

    Folders are listed by tasks, level by level: a level's folders are rows that are dealt over tasks, and what they hold
    is written as rows, so the driver never has the files.  Names that begin with ``_`` or ``.`` are passed over.
    """
    found, folders = [], spark.createDataFrame([(path,)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = place(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                at = place(path)[1] if folder == path else folder
                inside = [one] if folder == path and (one := system.get_file_info(at)).is_file else system.get_file_info(fs.FileSelector(at))
                told = [f for f in inside if not f.base_name.startswith(("_", "."))]
                kinds = [pa.array([f.path for f in told], pa.string()), pa.array([f.type == fs.FileType.Directory for f in told], pa.bool_())]
                size, modified = pa.array([f.size for f in told], pa.int64()), pa.array([f.mtime for f in told], pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([*kinds, size, modified], names=["path", "folder", "length", "modified"])

    while not folders.isEmpty():
        level = written(dealt(folders, "path").mapInArrow(run, "path string, folder boolean, length long, modified timestamp"))
        found.append(level.filter("not folder").drop("folder"))
        folders = level.filter("folder").select("path")
    files = functools.reduce(DataFrame.unionByName, found)
    return files if since is None else files.filter(F.col("modified") > F.lit(since))


def read_tile_inventory(spark: SparkSession, path: str, layer: str, flipped: bool, suffix: str = "*", since: datetime | None = None) -> DataFrame:
    """tile_files(layer, level, x, y, path, bytes) of the files with a suffix, or of those modified after ``since``; only names and sizes are read."""
    files = list_files(spark, path, since)
    own = files if suffix == "*" else files.filter(F.col("path").endswith(f".{suffix}"))
    return tile_of_path(own.select("path", "length"), flipped).select(F.lit(layer).alias("layer"), "level", "x", "y", "path", "bytes")
