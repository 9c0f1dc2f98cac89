"""Vectorised hashes of words, word windows and byte windows inside a task's batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text that are hashed at a time.
PART = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, PART + 4096)
        for k, r in enumerate((_R, _RINV)):
            full = np.full(size, r, np.uint64)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end]."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n values; n is far under 1,000, from where on sequences over two values can be made that collide."""
    at = np.arange(max(0, len(values) - n + 1))
    return _ranges(values, at, at + n)


#: Bytes of a word from which it is hashed as a whole; a word's first bytes that are kept, by its length.
LONG = 1024
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def eights(flat: bytes) -> np.ndarray:
    """The eight bytes from each place of ``flat`` on as numbers, zeros past its end."""
    return np.ndarray((len(flat),), "<u8", flat + bytes(8), strides=(1,))


def word_hashes(flat: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of flat[start:end]: eight bytes after the other are mixed in, so that words of any length collide by chance only."""
    chunks, left = eights(flat), ends - starts
    out = mix(left.astype(np.uint64) * _R)
    some, at = np.flatnonzero(left <= LONG), 0
    while len(some):
        told = chunks[starts[some] + at] & _FIRST[np.minimum(left[some] - at, 8)]
        out[some] = mix((out[some] ^ told) * _R)
        at += 8
        some = some[left[some] > at]
    for k in np.flatnonzero(left > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(flat[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


class Words:
    """The words ([^\\x20\\x09-\\x0D]+) of some texts, hashed; texts by number."""

    def __init__(self, texts: list[bytes]):
        self.flat = b" ".join(texts)
        raw = np.frombuffer(self.flat, np.uint8)
        space = np.ones(len(raw) + 2, bool)
        space[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = word_hashes(self.flat, self.starts, self.ends)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        #: Words of text k: first[k]:first[k + 1].
        self.first = np.searchsorted(self.starts, begins)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        return b" ".join(self.flat[self.starts[a] : self.ends[b - 1]].split()) if b > a else b""


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text or binary column's values; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], text: int, size: int = PART) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with about ``size`` bytes of text, and their texts."""
    for batch in batches:
        texts = as_bytes(batch.column(text))
        at = 0
        while at < len(texts):
            end, used = at, 0
            while end < len(texts) and (end == at or used + len(texts[end]) <= size):
                used += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end
