"""Media columns: Matroska audio as a binary column, and its packet table.

``mux`` stores each row's bytes as 8-bit PCM samples of a Matroska file; ``packets`` parses any such
file's variable-length EBML elements, clusters, lacing (none, Xiph, EBML, fixed) and cues into rows with
track, timestamp and byte range; ``features`` reads the samples back through these byte ranges.

Defined cases: a null text is an empty one, whose payload is one frame of padding; equal texts give
equal files; a file that breaks off or isn't Matroska gives the packets before the damage and
``complete`` false; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A frame's samples; frames of a block and blocks of a cluster (32 * 8 frames of 12 ms fit a 16-bit time).
FRAME, LACE, BLOCKS, RATE = 576, 8, 32, 48000
#: Element ids of the public Matroska specification (RFC 9559); fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, ENTRY, NUMBER, UID, KIND, LACING, CODEC, FRAME_NS = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, DEPTH, TIME, SIMPLE, GROUP, BLOCK = 0xE1, 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1
CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = (EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES)


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    keyframe: bool
    offset: int
    size: int


class Media(NamedTuple):
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ticks, track, the cluster's place in the file
    complete: bool


def _vint(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _uint(key: int, n: int) -> bytes:
    return _element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of a frame."""
    return data + b"\xff" * ((-len(data)) % FRAME if data else FRAME)


def mux_payload(payload: bytes) -> bytes:
    """A Matroska file with one 8-bit mono PCM track; laced blocks, a cue for each cluster."""
    frames, tick = len(payload) // FRAME, FRAME * 1000 // RATE
    head = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", float(frames * tick))) + _element(0x4D80, b"tables") + _element(0x5741, b"tables"))
    audio = _element(AUDIO, _element(SAMPLING, struct.pack(">d", float(RATE))) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    tracks = _element(TRACKS, _element(ENTRY, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _uint(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT") + _uint(FRAME_NS, tick * 1_000_000) + audio))
    parts, cues, place = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, frames, LACE * BLOCKS):
        body = [_uint(TIME, first * tick)]
        for at in range(first, min(frames, first + LACE * BLOCKS), LACE):
            n = min(LACE, frames - at)
            lead = b"\x81" + struct.pack(">h", (at - first) * tick) + (bytes((0x84, n - 1)) if n > 1 else b"\x80")
            body.append(_element(SIMPLE, lead + payload[at * FRAME : (at + n) * FRAME]))
        parts.append(_element(CLUSTER, b"".join(body)))
        cues.append(_element(CUE, _uint(CUE_TIME, first * tick) + _element(CUE_PLACE, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, place))))
        place += len(parts[-1])
    return head + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


def _head(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """An element's id, its body's start and end (-1: unknown size)."""
    width = 9 - data[at].bit_length()
    key, at = int.from_bytes(data[at : at + width], "big"), at + width
    size, at, unknown = read_vint(data, at)
    if width > 4 or at > end:
        raise ValueError("not an element")
    return key, at, -1 if unknown else at + size


def read_vint(data: bytes, at: int) -> tuple[int, int, bool]:
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("not a size")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return n, at + width, n == (1 << 7 * width) - 1


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Places and sizes of a block's frames."""
    if not kind:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        sizes = [(end - at) // n] * (n - 1)
        if (end - at) % n:
            raise ValueError("uneven fixed lacing")
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at, _ = read_vint(data, at)
        sizes = [size]
        for _ in range(n - 2):
            begun = at
            step, at, _ = read_vint(data, at)
            size += step - ((1 << 7 * (at - begun) - 1) - 1)
            sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laces beyond their block")
    places = np.cumsum([at, *sizes]).tolist()
    return list(zip(places, sizes, strict=False))


def parse(data: bytes) -> Media:
    """The tracks, packets and cues of a Matroska file."""
    media = Media([], [], [], True)
    try:
        _walk(data, 0, len(data), media, {"scale": 1_000_000, "time": 0, "base": 0})
    except (ValueError, IndexError):
        return media._replace(complete=False)
    return media


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _walk(data: bytes, at: int, end: int, media: Media, state: dict, inside: int = 0) -> int:
    """Reads elements up to ``end``; inside an element of unknown size up to the next one that can't be its child."""
    while at < end:
        key, body, stop = _head(data, at, end)
        if inside and key in TOP and (inside != SEGMENT or key in (EBML, SEGMENT)):
            return at
        if stop > end:
            raise ValueError("an element beyond its parent")
        last, at = end if stop < 0 else stop, body
        if key == SEGMENT:
            state["base"] = body
        if key in (SEGMENT, INFO, CLUSTER, CUES, TRACKS, GROUP, CUE_PLACE):
            at = _walk(data, body, last, media, state, key if stop < 0 else 0)
            continue
        if stop < 0:
            raise ValueError("unknown size")
        at = stop
        if key == ENTRY:
            media.tracks.append({})
            _walk(data, body, stop, media, state)
        elif key == AUDIO:
            _walk(data, body, stop, media, state)
        elif key == CUE:
            state["cue"] = [0, 0, 0]
            _walk(data, body, stop, media, state)
            media.cues.append(tuple(state["cue"]))
        elif key == SCALE:
            state["scale"] = _number(data, body, stop)
        elif key == TIME:
            state["time"] = _number(data, body, stop)
        elif key in (CUE_TIME, CUE_TRACK):
            state["cue"][key == CUE_TRACK] = _number(data, body, stop)
        elif key == CUE_CLUSTER:
            state["cue"][2] = state["base"] + _number(data, body, stop)
        elif key in (NUMBER, KIND, FRAME_NS, CHANNELS, DEPTH) and media.tracks:
            media.tracks[-1][{NUMBER: "number", KIND: "kind", FRAME_NS: "frame_ns", CHANNELS: "channels", DEPTH: "depth"}[key]] = _number(data, body, stop)
        elif key == CODEC and media.tracks:
            media.tracks[-1]["codec"] = data[body:stop].decode("ascii", "replace")
        elif key in (SIMPLE, BLOCK):
            _block(data, body, stop, key == SIMPLE, media, state)
    return at


def _block(data: bytes, at: int, end: int, simple: bool, media: Media, state: dict) -> None:
    track, at, _ = read_vint(data, at)
    if at + 3 > end:
        raise ValueError("a short block")
    flags = data[at + 2]
    begun = (state["time"] + struct.unpack_from(">h", data, at)[0]) * state["scale"]
    frame = next((t.get("frame_ns", 0) for t in media.tracks if t.get("number") == track), 0)
    for k, (place, size) in enumerate(_laces(data, at + 3, end, flags >> 1 & 3)):
        media.packets.append(Packet(track, begun + k * frame, simple and bool(flags & 0x80), place, size))


def mux(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = part.column(1).to_pylist()
                media = pa.array([mux_payload(pad(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), media], names=[id_col, "n_bytes", "media"])

    rows = df.select(id_col, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, n_bytes long, media binary")


def packets(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: a row for each frame, in the file's order, with its codec, time and byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                media = parse(data.as_py() or b"")
                codec = {t.get("number"): t.get("codec") for t in media.tracks}
                for at in range(0, len(media.packets), 10000):
                    part = media.packets[at : at + 10000]
                    track, time, keyframe, offset, size = (list(x) for x in zip(*part, strict=True))
                    arrays = [pa.array([key.as_py()] * len(part), key.type), pa.array(range(at, at + len(part)), pa.int64()), pa.array(track, pa.int64()), pa.array([codec.get(t) for t in track], pa.string()), pa.array(time, pa.int64()), pa.array(keyframe), pa.array(offset, pa.int64()), pa.array(size, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "k", "track", "codec", "timestamp_ns", "keyframe", "offset", "size"])

    rows = df.select(id_col, media_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, k long, track long, codec string, timestamp_ns long, keyframe boolean, offset long, size long")


def _feature(samples: np.ndarray, media: Media) -> str:
    """Level, power and zero crossings of 8-bit samples around 128, in whole numbers."""
    level = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    last = media.packets[-1].timestamp_ns // 1_000_000 if media.packets else 0
    return f"frames={len(media.packets)};cues={len(media.cues)};last_ms={last};sum={int(level.sum())};power={int((level * level).sum())};peak={int(np.abs(level).max(initial=0))};crossings={crossings}"


def features(df: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``mux`` read back: the payload from the packets' byte ranges, its digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                payloads, told = [], []
                for data in part.column(2).to_pylist():
                    media = parse(data)
                    payloads.append(b"".join(data[p.offset : p.offset + p.size] for p in media.packets if p.track == 1))
                    told.append(_feature(np.frombuffer(payloads[-1], np.uint8), media))
                arrays = [*part.columns, pa.array(payloads, pa.binary()), pa.array([zlib.crc32(x[-32:]) for x in payloads], pa.int64()), pa.array(told, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_bytes", "media", "payload", "tail_crc32", "feature"])

    rows = df.select(id_col, "n_bytes", "media")
    read = rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, n_bytes long, media binary, payload binary, tail_crc32 long, feature string")
    return read.select(
        id_col, "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
