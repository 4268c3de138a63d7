"""Vectorised word and shingle hashing over Arrow string buffers.

Words are the runs of bytes outside ``\\x20 \\x09-\\x0D``; ASCII capitals hash like their
lower-case letters. A word's hash is a polynomial over per-byte random 64-bit values,
finished by a mixer; every worker derives the same table from a fixed seed.
Equality of words and shingles is equality of 64-bit hashes (2^-64 per pair compared).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_R = 0x9E3779B97F4A7C15 | 1


def _tables():
    values = np.random.RandomState(20240607).bytes(256 * 8)
    table = np.frombuffer(values, dtype="<u8").astype(np.uint64).copy()
    table[65:91] = table[97:123]
    is_word = np.ones(256, dtype=bool)
    is_word[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table, is_word


TABLE, IS_WORD = _tables()
_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(_R, -1, 1 << 64)
        for name, base in (("up", _R), ("down", inverse)):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; texts' ends also end words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = before[1:].copy()
    after[:-1] = inside[1:]
    after[-1] = False
    before = before[:-1]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of texts of about ``most`` bytes in all (one text at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def batch_words(column: pa.Array, kind: np.ndarray = IS_WORD):
    """Yields (first text, word hashes, word offsets per text) for blocks of a string column; ``kind`` tells the bytes of words."""
    data, offsets = buffers(column)
    for at, to in blocks(offsets):
        own, bounds = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, ends = word_bounds(own, bounds, kind)
        yield at, hash_words(own, starts, ends), np.searchsorted(starts, bounds)


_C = [np.uint64(x | 1) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xF58999998A7F6E51)]


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all windows of ``width`` words, or of the whole sequence where it is shorter."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < width:
        out = np.array([n], dtype=np.uint64)
        for k in range(n):
            out = mix(out * _C[0] + words[k : k + 1])
        return out
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = mix(out + words[k : n - width + 1 + k] * _C[k % len(_C)])
    return out
