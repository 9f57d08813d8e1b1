"""Words and their hashes from the UTF-8 bytes of texts, in numpy.

Words are the runs of bytes that are no ASCII white space; all of it works on bytes, as
no byte of a longer character is ASCII. Hashes have 64 bits and are the same in every
process.
"""

from __future__ import annotations

import numpy as np


def among(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SPACE = among(b" \t\n\x0b\x0c\r")


def word_spans(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are no ``space``, by default ASCII white space."""
    solid = np.concatenate(([False], ~space[data], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


_BYTES = 1 << 21  # bytes whose running sum is held at once


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, from one running sum over the bytes.

    A hash does not depend on where the span stands, so long texts are taken in parts.
    """
    if len(data) > _BYTES and len(starts) > 1:
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(ends, starts[at] + _BYTES, "right")))
            first = starts[at]
            out[at:end] = span_hashes(data[first : ends[end - 1]], starts[at:end] - first, ends[at:end] - first)
            at = end
        return out
    up, down = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[data] * up[: len(data)], dtype=np.uint64)))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` hashes in a row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out
