"""Word shingles of whole texts as sets of 64-bit hashes, from the bytes of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PIECE = 1 << 19  # bytes of text hashed at once; a longer text is hashed alone, but whole

# Seeds of the hashes, fixed values.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random number for each byte, the same for A-Z as for a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < size:
        step = np.full(max(size, _PIECE + 1), int(_BASE) | 1, dtype=np.uint64)
        back = np.full(len(step), pow(int(_BASE) | 1, -1, 1 << 64), dtype=np.uint64)
        step[0] = back[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(step), np.cumprod(back)
    return _POWERS["up"], _POWERS["down"]


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the text it is in. ``ends`` are where the texts end in ``data``."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[0] = True
    first[ends] = True  # a text begins where the one before ends
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
    stops = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=total[1:])
    hashes = (total[stops] - total[starts]) * down[starts]
    hashes = mix(hashes + (stops - starts).astype(np.uint64) * _MIX[0])
    return hashes, np.searchsorted(ends, starts, side="right")


def _sets(data: np.ndarray, ends: np.ndarray, width: int) -> Iterator[np.ndarray]:
    words, owner = _words(data, ends)
    counts = np.bincount(owner, minlength=len(ends))
    last = np.cumsum(counts)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _MIX[1]) | np.uint64(1)
    rows = max(0, len(words) - width + 1)
    joined = np.zeros(rows, dtype=np.uint64)
    for k in range(width):
        joined += words[k:k + rows] * factors[k]
    joined = mix(joined)
    for count, end in zip(counts.tolist(), last.tolist()):
        if count >= width:
            found = np.sort(joined[end - count:end - width + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif count:
            whole = (words[end - count:end] * factors[:count]).sum(dtype=np.uint64)
            yield mix(np.array([whole + np.uint64(count)], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    Words are runs of characters other than ASCII white space, A-Z in lower case. A text of fewer
    words is one shingle; without words, or null, it has none.
    """
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, side="right")) - 1)
        to = min(to, len(column))
        piece = data[offsets[at]:offsets[to]]
        yield from _sets(piece, (offsets[at + 1:to + 1] - offsets[at]), width)
        at = to
