"""Binary tracks, height maps, shapes, POI and model-index tiles, decoded file by file in tasks.

Files are listed by tasks and dealt over the cluster by number and size, so the driver never has their names.  Damaged or foreign files give
no rows; the readers that take ``rejects=True`` return their names instead.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geotrail.sources.scratch import dealt, written
from geotrail.sources.tables import list_files
from geotrail.sources.tracks import SPLIT, TRACK, TrackFiles, place

MOST_CELLS = 10_000_000
#: Rows and bytes of decoded files that make a batch.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 32 << 20
#: Files and their bytes that a task reads.
TASK_FILES, TASK_BYTES = 2000, 64 << 20
POI_VERSIONS = (0x02000000, 0x02000001, 0x02000002, 0x02000003)
LERC_TAG = b"CntZImage "
DEM = "level int, x long, y long, width int, height int, z array<float>"
SHAPES = "file string, num int, shape_type int, box array<double>, parts array<int>, points array<struct<x:double,y:double>>"
POI = "file string, lon double, lat double, altitude float, key string, text string, font_name string, font_size int, font_weight int, font_color long, font_color_outer long, img_key string"
MODELS = "level int, x long, y long, ver long, type int, key string, lon double, lat double, altitude float, box array<double>, img_level int, data_file string, img_file string"


class Bytes:
    """A little-endian reader that raises on what isn't there."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("file too short")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, kinds: str) -> tuple:
        return struct.unpack("<" + kinds, self.take(struct.calcsize("<" + kinds)))

    def text(self, kind: str, most: int) -> str:
        """A text after its length; at most ``most`` bytes of it are stored."""
        return self.take(min(self.read(kind)[0], most)).split(b"\0")[0].decode("utf-8", "replace")


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, root) of the files below a folder whose names end with ``suffix`` (``*`` stands for any letters), dealt over tasks.

    Patterns and file systems that tasks can't reach by the address come as (path, content) through Spark's reader.
    """
    try:
        place(path)
        known = not re.search(r"[*?{\[]", path)
    except ValueError:
        known = False
    if not known:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
        return files.select("path", "content")
    files = list_files(spark, path).filter(F.regexp_extract("path", "[^/]*$", 0).rlike("^.*" + re.escape(suffix).replace(r"\*", ".*") + "$"))
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return files.select("path", F.lit(path).alias("root")).repartition(max(1, -(-n // TASK_FILES), -(-size // TASK_BYTES)), "path")


def decoded(files: DataFrame, decode: Callable[[str, bytes], list | None], schema: str, rejects: bool = False) -> DataFrame:
    """Rows of all files, (path, content) or (path, root) as ``_files`` has them; with ``rejects`` the names of those that can't be decoded.

    ``decode`` gives a file's columns, as lists or Arrow arrays; the columns of many files make a batch.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    whole = "content" in files.columns

    def contents(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        if whole:
            yield from ((path, content.as_py()) for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            return
        for path, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with place(root)[0].open_input_file(path) as f:
                yield path, f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, bad = [], 0, 0, []
        for batch in batches:
            for path, content in contents(batch):
                try:
                    columns = decode(path, content)
                except (ValueError, struct.error, IndexError):
                    bad.append(path)
                    continue
                if rejects:
                    continue
                held.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds))
                rows, size = rows + held[-1].num_rows, size + held[-1].nbytes
                if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows, size = [], 0, 0
        if rejects:
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["path"])
        elif held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return files.mapInArrow(run, "path string" if rejects else schema)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def read_3dpath(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """track3d(file, line, ts long, x, y, z); ``split``: bytes that a task reads. A file that is cut off gives no rows."""
    spark.dataSource.register(TrackFiles)
    return spark.read.format(TrackFiles.name()).option("split", split).load(path)


def encode_tracks(df: DataFrame) -> DataFrame:
    """(file, content) of track3d rows, one binary for each file."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line")
        out = np.zeros(len(rows), TRACK)
        for c in ("ts", "x", "y", "z"):
            out[c] = rows[c].to_numpy()
        return pd.DataFrame({"file": [rows["file"].iloc[0]], "content": [struct.pack("<I", len(rows)) + out.tobytes()]})

    return df.select("file", "line", "ts", "x", "y", "z").groupBy("file").applyInPandas(run, "file string, content binary")


def write_files(files: DataFrame, target: str) -> int:
    """Writes (file, content) rows below a folder of any file system that tasks can reach by its address; returns their number.

    ``target`` is a path or an address (file:, hdfs:, s3: ...).  On a cluster it must be shared: a local path then
    means a mounted one.  All files are written into a folder aside first; once all are there, tasks move them to their
    places, so that a job that breaks off while it computes and writes leaves nothing.  A task that is run again writes or moves the same.
    """
    aside = f"_{uuid.uuid4().hex}.parts"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, home = place(target)
        for batch in batches:
            some = f"{aside}/{uuid.uuid4().hex}"
            parts = [f"{some}/{k}" for k in range(batch.num_rows)]
            system.create_dir(f"{home}/{some}", recursive=True)
            for part, content in zip(parts, batch.column(1), strict=True):
                with system.open_output_stream(f"{home}/{part}") as f:
                    f.write(content.as_buffer() or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.string())], names=["file", "part"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, home = place(target)
        made: set[str] = set()
        for batch in batches:
            for name, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = f"{home}/{name.lstrip('/')}"
                folder = out.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                if system.get_file_info(f"{home}/{part}").type != fs.FileType.NotFound:  # else an earlier run has moved it
                    system.move(f"{home}/{part}", out)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    try:
        there = written(files.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(write, "file string, part string"))
        return dealt(there, "file").mapInArrow(move, "n long").agg(F.sum("n")).first()[0] or 0
    finally:
        from pyarrow import fs

        system, home = place(target)
        if system.get_file_info(f"{home}/{aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{home}/{aside}")


def write_3dpath(df: DataFrame, target: str) -> int:
    return write_files(encode_tracks(df), target)


def _tile(path: str) -> tuple[int, int, int]:
    """level, x, y from level/row/row_column.ext, rows counted from the north."""
    level, _, name = path.rsplit("/", 3)[-3:]
    row, column = name.split(".")[0].split("_")
    return int(level), int(column), (1 << int(level)) - int(row) - 1


def _one_map(path: str, width: int, height: int, z: np.ndarray) -> list:
    level, x, y = _tile(path)
    return [[level], [x], [y], [width], [height], pa.ListArray.from_arrays(pa.array([0, len(z)], pa.int32()), pa.array(z.astype(np.float32)))]


def decode_dem(path: str, data: bytes) -> list:
    b = Bytes(data)
    if b.take(3) != b"dem":
        raise ValueError("not a height map")
    width, height = b.read("II")
    if width * height > MOST_CELLS:
        raise ValueError("too large")
    return _one_map(path, width, height, np.frombuffer(b.take(4 * width * height), "<f4"))


def read_dem_tiles(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    return decoded(_files(spark, path, ".dem"), decode_dem, DEM, rejects)


def encode_dem_tiles(df: DataFrame) -> DataFrame:
    """(file, content) of height maps in the layout that ``read_dem_tiles`` reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for level, x, y, width, height, z in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                row = (1 << level) - y - 1
                names.append(f"{level}/{row:04d}/{row:04d}_{x:04d}.dem")
                contents.append(b"dem" + struct.pack("<II", width, height) + z.values.to_numpy().astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file", "content"])

    return dealt(df.select("level", "x", "y", "width", "height", "z"), "level", "x", "y").mapInArrow(run, "file string, content binary")


def write_dem_tiles(df: DataFrame, target: str) -> int:
    return write_files(encode_dem_tiles(df), target)


def _unpack(b: Bytes) -> np.ndarray:
    """Integers of a fixed number of bits, packed from the high bits of little-endian words; unused last bytes are left out."""
    (head,) = b.read("B")
    bits = head & 63
    (n,) = b.read({0: "I", 1: "H", 2: "B"}[head >> 6]) if head >> 6 < 3 else (-1,)
    if bits >= 32 or n < 0:
        raise ValueError("not packed integers")
    size = (n * bits + 7) // 8
    words = -(-size // 4)
    raw = b.take(size)
    spare = words * 4 - size
    # the last word's unused low bytes are the missing ones
    whole = np.frombuffer(raw[: (words - 1) * 4] + b"\0" * spare + raw[(words - 1) * 4 :] if words else b"", "<u4").astype(">u4")
    if not bits:
        return np.zeros(n, np.int64)
    bit = np.unpackbits(whole.view(np.uint8))[: n * bits].reshape(n, bits)
    return bit @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _z_block(b: Bytes, shape: tuple[int, int], error: float, top: float) -> np.ndarray:
    (head,) = b.read("B")
    kind = head & 63
    if kind == 2:
        return np.zeros(shape, np.float32)
    if kind == 0:
        return np.frombuffer(b.take(4 * shape[0] * shape[1]), "<f4").reshape(shape)
    if kind not in (1, 3) or head >> 6 == 3:
        raise ValueError("unknown block")
    (offset,) = b.read({0: "f", 1: "h", 2: "b"}[head >> 6])
    if kind == 3:
        return np.full(shape, offset, np.float32)
    return np.minimum(np.float32(offset) + _unpack(b).reshape(shape) * (2 * error), top).astype(np.float32)


def decode_lerc(path: str, data: bytes) -> list:
    """A tile of the first LERC format: version 11, type 8, with a constant count part."""
    b = Bytes(data)
    if b.take(len(LERC_TAG)) != LERC_TAG:
        raise ValueError("not such a tile")
    version, kind, height, width, error = b.read("iiIId")
    if (version, kind) != (11, 8) or max(width, height) > 20000 or not width * height or width * height > MOST_CELLS:
        raise ValueError("unknown version or size")
    down, across, size, count = b.read("IIIf")
    if down or across or size or count <= 0:
        raise ValueError("only a constant count part is read")
    down, across, size, top = b.read("IIIf")
    if not 0 < down <= height or not 0 < across <= width:
        raise ValueError("no tiles")
    z = np.zeros((height, width), np.float32)
    steps = lambda n, k: [(i * (n // k), (i + 1) * (n // k)) for i in range(k)] + ([(n - n % k, n)] if n % k else [])
    for i0, i1 in steps(height, down):
        for j0, j1 in steps(width, across):
            z[i0:i1, j0:j1] = _z_block(b, (i1 - i0, j1 - j0), error, top)
    return _one_map(path, width, height, z.ravel())


def read_lerc_tiles(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    return decoded(_files(spark, path, ".lerc"), decode_lerc, DEM, rejects)


def _lists(values: list[np.ndarray], kind: np.dtype) -> tuple[pa.Array, np.ndarray]:
    """The offsets of lists, and all their values."""
    return pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), np.concatenate([np.zeros(0, kind), *values])


def decode_shapes(path: str, data: bytes) -> list:
    numbers, kinds, boxes, parts, points, at = [], [], [], [], [], 100
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        b = Bytes(data[at + 8 : at + 8 + 2 * words])
        at += 8 + 2 * words
        (kind,) = b.read("i")
        if kind not in (3, 5):
            continue
        box = np.frombuffer(b.take(32), "<f8")
        n_parts, n_points = b.read("ii")
        parts.append(np.frombuffer(b.take(4 * n_parts), "<i4"))
        points.append(np.frombuffer(b.take(16 * n_points), "<f8").reshape(-1, 2))
        numbers.append(number)
        kinds.append(kind)
        boxes.append(box)
    at_box, box = _lists(boxes, np.float64)
    at_part, part = _lists(parts, np.int32)
    at_point, point = pa.array(np.cumsum([0, *map(len, points)]), pa.int32()), np.concatenate([np.zeros((0, 2)), *points])
    places = pa.StructArray.from_arrays([pa.array(point[:, 0].copy()), pa.array(point[:, 1].copy())], names=["x", "y"])
    return [[_name(path)] * len(numbers), numbers, kinds, pa.ListArray.from_arrays(at_box, pa.array(box)), pa.ListArray.from_arrays(at_part, pa.array(part)), pa.ListArray.from_arrays(at_point, places)]


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """shapes(file, num, shape_type, box, parts, points): polylines (3) and polygons (5)."""
    return decoded(_files(spark, path, ".shp"), decode_shapes, SHAPES)


def _columns(rows: Iterator[tuple], width: int) -> list:
    """Rows of varying length, which must be read one after the other, as columns; what follows a cut one is left out."""
    out: list[list] = [[] for _ in range(width)]
    try:
        for row in rows:
            for column, v in zip(out, row, strict=True):
                column.append(v)
    except ValueError:
        pass
    return out


def decode_poi(path: str, data: bytes) -> list:
    b = Bytes(data)
    version, n = b.read("Ii")
    if version not in POI_VERSIONS:
        raise ValueError("unknown version")

    def row() -> tuple:
        place = b.read("ddf")
        texts = b.text("H", 15), b.text("H", 63), b.text("H", 15)
        return _name(path), *place, *texts, *b.read("BBII"), b.take(10).split(b"\0")[0].decode("utf-8", "replace")

    return _columns((row() for _ in range(n)), 12)


def read_poi(spark: SparkSession, path: str) -> DataFrame:
    return decoded(_files(spark, path, ".poi_*"), decode_poi, POI)


def decode_models(path: str, data: bytes) -> list:
    b = Bytes(data)
    level, x, y, n = b.read("iiii")
    if not 0 <= level < 16:
        raise ValueError("unknown level")

    def row() -> tuple:
        version, kind = b.read("IB")
        key = b.text("B", 63)
        lon, lat, altitude, *box = b.read("ddf6d")
        (image_level,) = b.read("B")
        return level, x, y, version, kind, key, lon, lat, altitude, box, image_level, b.text("B", 63), b.text("B", 63)

    return _columns((row() for _ in range(n)), 13)


def read_model_index(spark: SparkSession, path: str) -> DataFrame:
    return decoded(_files(spark, path, ".facility_build"), decode_models, MODELS)
