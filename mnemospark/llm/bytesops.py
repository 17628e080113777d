"""Vectorised work on the bytes of many texts at once: words, hashes of words and of windows.

The texts of an Arrow column lie end to end in one buffer; numpy runs over that buffer in pieces of bounded size, so that
memory does not follow the size of a batch and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of a piece; a longer document is a piece of its own.
PIECE = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LENGTHS, _BLOCKS = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Bytes beyond which a string is hashed by itself.
_LONG = 512


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer (zeros behind the end); one place more than data has bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hashes of the strings data[start:end], which equal strings of equal seed share.

    Eight bytes at a time are taken up by a bijective step that is not linear: unlike a polynomial modulo a power of two, it
    has no strings that collide by construction, and strings of up to eight bytes and equal length never do.
    """
    eight, length = eights(data), ends - starts
    h = mix(length.astype(np.uint64) * _LENGTHS + np.asarray(seed).astype(np.uint64))
    live = np.flatnonzero(length <= _LONG)
    at, left = starts[live], length[live]
    while len(live):
        block = eight[at]
        part = left < 8
        block[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
        block ^= h[live]
        block *= _BLOCKS
        block ^= block >> np.uint64(29)
        h[live] = block
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > _LONG):
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), int(h[i])))
    return mix(h)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most size bytes each, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, in order, and the offsets of the texts among them.

    A word is a maximal run without ASCII white space; with lower, A-Z count as a-z. Offsets must start at 0.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return hashes(_LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, offsets)


def uint64s(raw: bytes | pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer() if isinstance(raw, pa.Scalar) else raw, np.uint64)
