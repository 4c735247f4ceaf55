"""Vectorised 64-bit identifiers of byte runs and words: arrays in, arrays out.

A prefix sum of mapped bytes times powers of an odd base gives the identifier of any run by one
subtraction and one product (arithmetic modulo 2^64, in which an odd base has an inverse).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: One pseudo-random value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^n and their inverses."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """n + 1 sums; the run [a, b) has (sums[b] - sums[a]) * inverse[a]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:-1], out=out[1:])
    return out


def run_ids(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """For each byte its value after lower-casing A-Z, 0 for a separator. A NUL that is none gets 255, which UTF-8 never has."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 255
    if lower:
        t[65:91] += 32
    t[np.frombuffer(separators, np.uint8)] = 0
    return t


def word_spans(data: np.ndarray, offsets: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes of all texts, (start, end) of their words, and for each text the index of its first word (n + 1)."""
    low = to[data]
    inside = low != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: (start, end, 64-bit identifier) and for each text the index of its first word (n + 1)."""
    low, starts, ends, first = word_spans(data, offsets, to)
    return starts, ends, run_ids(prefix_sums(low), starts, ends), first


def word_codes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """The number of each word among the distinct words, and these words; compared by content, not by identifier."""
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    kept = low[low != 0]
    kept[kept == 255] = 0
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(kept)).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary
