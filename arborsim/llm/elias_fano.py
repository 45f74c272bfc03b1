"""Elias-Fano coding of a non-decreasing sequence, with sampled select."""

from __future__ import annotations

import struct

import numpy as np

#: One position of a set bit is stored for so many of them.
SAMPLE = 64
HEAD = struct.Struct("<QQBI")


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """n values up to u take about n * (2 + log2(u / n)) bits, and half a bit each for select samples of 32 bits."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    u = int(v[-1]) + 1 if n else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n, dtype=np.int64)
    size = int(high[-1]) + 1 if n else 0
    if size >= 1 << 32:
        raise ValueError("too many values for one sequence: cut it")
    ones = np.zeros(size, np.uint8)
    ones[high] = 1
    lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return HEAD.pack(n, u, low, size) + high[::SAMPLE].astype("<u4").tobytes() + _pack(lows.ravel()) + _pack(ones)


class EliasFano:
    """Read access; ``select(i)`` is the i-th value, found from the sample before it."""

    def __init__(self, data: bytes):
        self.n, self.u, self.low, self.ones = HEAD.unpack_from(data)
        at = HEAD.size
        k = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", k, at)
        at += 4 * k
        k = -(-self.n * self.low // 8)
        self.lows = np.frombuffer(data, np.uint8, k, at)
        at += k
        k = -(-self.ones // 8)
        self.highs = np.frombuffer(data, np.uint8, k, at)
        self.size = at + k

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        a = i * self.low
        b = int.from_bytes(self.lows[a // 8 : (a + self.low + 7) // 8].tobytes(), "little")
        return (b >> (a % 8)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Words of the upper bits are skipped by their count of ones, and the last one is searched."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int.from_bytes(self.highs[byte : byte + 8].tobytes(), "little") >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 8
            word = int.from_bytes(self.highs[byte : byte + 8].tobytes(), "little")
        for _ in range(left):
            word &= word - 1  # without its lowest one
        at = 8 * byte + (word & -word).bit_length() - 1
        return ((at - i) << self.low) | self._low(i)

    def select_range(self, first: int, last: int) -> np.ndarray:
        """The values from the first-th up to, not with, the last-th, read between the samples around them."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.uint64)
        begin, until = first // SAMPLE * SAMPLE, -(-last // SAMPLE)
        at = int(self.samples[begin // SAMPLE])
        end = int(self.samples[until]) if until < len(self.samples) else self.ones
        bits = np.unpackbits(self.highs[at // 8 : -(-end // 8)], bitorder="little")[at % 8 : at % 8 + end - at]
        places = np.flatnonzero(bits)[first - begin : last - begin] + at
        high = (places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        a, b = first * self.low, last * self.low
        lows = np.unpackbits(self.lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low)
        return high | (lows.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def values(self) -> np.ndarray:
        return self.select_range(0, self.n)
