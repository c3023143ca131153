"""Elias-Fano code of a rising sequence of whole numbers, with a select structure.

Of ``n`` numbers below ``u`` the lowest ``log2(u / n)`` bits are stored as they are; the rest of
number ``i``, plus ``i``, is the place of a one in a bit vector of at most ``3 n`` bits. The place
of every 512th one is kept in 32 bits, so any number is found by reading one such stretch.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ones of the bit vector from one kept place to the next.
SAMPLE = 512
_HEAD = struct.Struct("<IIqQ")  # numbers, low bits of each, base, bytes of the bit vector
#: Numbers whose low bits are packed at a time; a multiple of 8.
_STEP = 1 << 16


def encode(values: np.ndarray) -> bytes:
    """``values`` (int64, rising, repeats allowed). The base is the first one."""
    n = len(values)
    base = int(values[0]) if n else 0
    if n and np.any(values[1:] < values[:-1]):
        raise ValueError("the numbers do not rise")
    v = values.astype(np.int64).view(np.uint64) - np.array([base], np.int64).view(np.uint64)
    top = int(v[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = int(ones[-1]) + 1 if n else 0
    if size >= 1 << 32 or n >= 1 << 32:
        raise ValueError("too many numbers for 32-bit places")
    bits = np.zeros(8 * -(-size // 8), np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    packed = b"".join(np.packbits(np.unpackbits(v[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low], bitorder="little").tobytes() for i in range(0, n, _STEP))
    return _HEAD.pack(n, low, base, len(high)) + packed + high + ones[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Numbers read from the bytes of ``encode``; nothing is decoded but what is asked for."""

    def __init__(self, data: bytes) -> None:
        self.n, self.low, base, n_high = _HEAD.unpack_from(data)
        self.base = np.array([base], np.int64).view(np.uint64)
        raw = np.frombuffer(data, np.uint8)
        a = _HEAD.size
        b = a + -(-self.n * self.low // 8)
        self.lows, self.high = raw[a:b], raw[b : b + n_high]
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), b + n_high)

    def __len__(self) -> int:
        return self.n

    def values(self, start: int, end: int) -> np.ndarray:
        """The numbers ``start`` to ``end - 1``, as int64."""
        end = min(end, self.n)
        if start >= end:
            return np.zeros(0, np.int64)
        block, after = start // SAMPLE, -(-end // SAMPLE)
        a = int(self.samples[block]) // 8
        b = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = 8 * a + np.flatnonzero(np.unpackbits(self.high[a:b], bitorder="little"))
        ones = ones[np.searchsorted(ones, int(self.samples[block])) :][start - block * SAMPLE : end - block * SAMPLE]
        rest = (ones - np.arange(start, end)).astype(np.uint64) << np.uint64(self.low)
        return (rest + self._low(start, end) + self.base).view(np.int64)

    def _low(self, start: int, end: int) -> np.ndarray:
        if not self.low:
            return np.zeros(end - start, np.uint64)
        a, b = start * self.low, end * self.low
        bits = np.unpackbits(self.lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].reshape(-1, self.low)
        out = np.zeros((end - start, 64), np.uint8)
        out[:, : self.low] = bits
        return np.packbits(out, axis=1, bitorder="little").view("<u8")[:, 0]

    def __getitem__(self, i: int) -> int:
        return int(self.values(i, i + 1)[0])

    def first_from(self, value: int) -> int:
        """The least ``i`` whose number is ``value`` or more (``n`` if none), by halving."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self[mid] < value else (lo, mid)
        return lo
