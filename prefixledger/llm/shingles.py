"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a set holds the distinct runs of
``size`` words, or the whole sequence of a shorter text. Hashes depend on the words alone, so every
executor gives a shingle the same value. An empty or null text has an empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20_250_101))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LANE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**63)) | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    room = 1 << max(16, (n - 1).bit_length())
    if room not in _POWERS:
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(room, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if len(_POWERS) > 1:
            _POWERS.clear()
        _POWERS[room] = (out[0], out[1])
    return _POWERS[room]


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the concatenated texts, and for each text the number of words before it."""
    space = _SPACE[buf]
    before = np.empty(len(buf), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    first = offsets[:-1][offsets[:-1] < len(buf)]
    before[first] = True
    starts = np.flatnonzero(before & ~space)
    after = np.empty(len(buf), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = True
    ends = np.flatnonzero(after & ~space) + 1
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * power[: len(buf)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _LANE[63])
    return hashes, np.searchsorted(starts, offsets)


def _slices(column: pa.Array):
    """Parts of a string column of about SLICE_BYTES each: (first row, bytes, offsets from 0)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        stop = min(stop, len(column))
        yield row, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def shingle_sets(column: pa.Array, size: int = 5):
    """Yields, for every text in order, the sorted distinct shingle hashes."""
    for _, buf, offsets in _slices(column):
        if not len(buf):
            for _ in range(len(offsets) - 1):
                yield np.zeros(0, dtype=np.uint64)
            continue
        words, at = _words(buf, offsets)
        runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for lane in range(size):
            runs += words[lane : lane + len(runs)] * _LANE[lane]
        runs = mix(runs)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield mix((words[a:b] * _LANE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _LANE[32 + b - a])
            else:
                yield np.zeros(0, dtype=np.uint64)
