"""Binary 3D tracks as a data source: reads are planned by bytes, large files are split at rows, small ones share a task."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRACK = np.dtype([("ts", "<u8"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("pad", "<f4")])
TRACK3D = "file string, line long, ts long, x float, y float, z float"
SUFFIX = ".3dpath"
#: Bytes that a task reads; rows of a batch.
SPLIT, ROWS = 64 << 20, 1 << 18


def place(address: str):
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", address))


def rows_of(name: str, first: int, raw: np.ndarray) -> pa.RecordBatch:
    file = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(raw), np.int32)), pa.array([name])).dictionary_decode()
    columns = [file, pa.array(np.arange(first, first + len(raw))), pa.array(raw["ts"].astype(np.int64)), *(pa.array(np.ascontiguousarray(raw[c])) for c in ("x", "y", "z"))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TRACK3D.split(", ")])


@dataclass
class Pieces(InputPartition):
    """(path, size, first row, row after the last) of what one task reads."""

    pieces: list[tuple[str, int, int, int]]


class TrackReader(DataSourceReader):
    def __init__(self, address: str, split: int):
        self.address, self.split = address, split

    def partitions(self) -> list[Pieces]:
        from pyarrow import fs

        system, path = place(self.address)
        found = system.get_file_info(path)
        if found.type == fs.FileType.Directory:
            files = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(SUFFIX)]
        else:
            files = [found] if found.is_file else []
        each = max(1, self.split // TRACK.itemsize)
        out, own, used = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            rows = max(0, f.size - 4) // TRACK.itemsize
            for first in range(0, rows, each):
                n = min(each, rows - first)
                if own and used + n > each:
                    out.append(Pieces(own))
                    own, used = [], 0
                own.append((f.path, f.size, first, first + n))
                used += n
        return [*out, Pieces(own)] if own or not out else out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.address)
        held, size = [], 0
        for path, whole, first, end in partition.pieces:
            with system.open_input_file(path) as f:
                (n,) = struct.unpack("<I", f.read(4))
                if whole < 4 + n * TRACK.itemsize:  # cut off
                    continue
                for at in range(first, min(end, n), ROWS):
                    f.seek(4 + at * TRACK.itemsize)
                    raw = f.read(min(ROWS, min(end, n) - at) * TRACK.itemsize)
                    held.append(rows_of(path.rsplit("/", 1)[-1], at, np.frombuffer(raw, TRACK)))
                    size += held[-1].num_rows
                    if size >= ROWS:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class TrackFiles(DataSource):
    """spark.read.format("tracks3d").load(path); option ``split``: bytes that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "tracks3d"

    def schema(self) -> str:
        return TRACK3D

    def reader(self, schema) -> TrackReader:
        return TrackReader(self.options["path"], int(self.options.get("split", SPLIT)))
