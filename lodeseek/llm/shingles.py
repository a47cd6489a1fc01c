"""Word shingles of texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodeseek.llm.common import mix64

_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
# A to Z as a to z; the white space \x20 and \x09 to \x0D parts words.
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of the step, 0 to n."""
    global _powers
    if len(_powers) <= n:
        size = 1 << max(10, int(n).bit_length())
        with np.errstate(over="ignore"):
            _powers = np.concatenate(
                ([np.uint64(1)], np.cumprod(np.full(size, _STEP, np.uint64), dtype=np.uint64))
            )
    return _powers


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the word at which each text begins (and the end)."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in raw])
    visible = ~_GAP[data]
    before = np.concatenate(([False], visible[:-1]))
    starts = np.flatnonzero(visible & ~before)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    stops = np.flatnonzero(before & ~visible)
    size = stops - starts
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    power = _power(int(size.max()))
    parts = _BYTE[data[visible]] * power[place]
    hashes = np.add.reduceat(parts, np.cumsum(size) - size)
    borders = np.concatenate(([0], np.searchsorted(starts, ends)))
    return mix64(hashes + size.astype(np.uint64)), borders


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles in order, and the shingle at which each text begins (and the end).

    A text of fewer words than ``width``, but some, has its whole sequence as one.
    """
    w, borders = words(texts)
    count = np.diff(borders)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(made)))
    if not ends[-1]:
        return np.empty(0, np.uint64), ends
    first = np.repeat(borders[:-1] - ends[:-1], made) + np.arange(ends[-1])
    length = np.repeat(np.minimum(count, width), made)
    out = length.astype(np.uint64) * _PLACE[63]
    for i in range(width):
        inside = length > i
        at = np.where(inside, first + i, 0)
        out += np.where(inside, w[at] * _PLACE[i], np.uint64(0))
    return mix64(out), ends
