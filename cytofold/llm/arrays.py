"""Numpy helpers for whole Arrow batches of texts: words as 64-bit hashes.

White space is ASCII only (a word is a run of bytes outside 0x09-0x0D and 0x20),
so UTF-8 bytes can be looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Odd multipliers for combining hashes.
MIX = _rng.integers(1, 2**63, 512, dtype=np.uint64) * U64(2) + U64(1)
#: The low bytes of a 64-bit value, by their number.
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def blocks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows) in blocks of about ``most`` bytes; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, len(texts))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, extra_breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; row bounds and ``extra_breaks`` (true where a new piece starts) cut words too."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    fresh[1:] = ~inside[:-1]
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    if extra_breaks is not None:
        fresh |= extra_breaks
    starts = np.flatnonzero(inside & fresh)
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = fresh[1:] | ~inside[1:]
    return starts, np.flatnonzero(inside & last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes at a time; steps beyond the first concern longer spans only."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype=np.uint64, buffer=padded, strides=(1,))
    left = ends - starts
    out = mix(eight[starts] & LOW_BYTES[np.minimum(left, 8)] ^ (left.astype(np.uint64) * MIX[0]))
    rows, at = np.flatnonzero(left > 8), 8
    while len(rows):
        rest = left[rows] - at
        out[rows] = mix(out[rows] * MIX[1] ^ eight[starts[rows] + at] & LOW_BYTES[np.minimum(rest, 8)])
        rows, at = rows[rest > 8], at + 8
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, folded: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order (A-Z as a-z if ``folded``), and the offsets of each row in them."""
    starts, ends = spans(data, offsets)
    return hash_spans(LOWER[data] if folded else data, starts, ends), np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
