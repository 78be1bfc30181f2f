"""Rising sequences of integers in near-minimal space, with a select structure: Elias-Fano coding.

Of n values below u, the low log2(u / n) bits of each stand side by side; the high bits are a unary sequence with one
set bit for each value and one clear bit for each step of the high part, n + u / 2 ** low bits in all. ``select`` finds the i-th set bit
from a sample of every 256th, as 32-bit numbers, by counting bits from there.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QBQQ")
_ONES = np.array([i.bit_count() for i in range(256)], dtype=np.uint8)


class EliasFano:
    """``low``: n packed numbers of ``bits`` bits; ``high``: unary high parts, lowest bit of each byte first; ``samples``: places of every 256th set bit."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: not falling, unsigned 64-bit integers."""
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the values must not fall")
        u = int(values[-1]) + 1 if n else 1
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.concatenate([np.packbits((values[a : a + 65536, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, 65536)]) if bits and n else np.zeros(0, dtype=np.uint8)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(place[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[place] = 1
        if len(flags) >= 1 << 32:
            raise ValueError("a sequence has at most 2 ** 32 high bits")
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), place[::SAMPLE].astype("<u4"))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at[:, None] * self.bits + np.arange(self.bits)
        found = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.uint64)
        return (found << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i, from at most 256 set bits of the high part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        todo = i % SAMPLE  # set bits still to pass
        byte = place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := word.bit_count()) <= todo:
            todo -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(todo):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.bits | int(self._low(np.array([i]))[0])

    def values(self) -> np.ndarray:
        """All of them, as unsigned 64-bit integers."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        high = (place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits)
        return high | np.concatenate([self._low(np.arange(a, min(self.n, a + 65536))) for a in range(0, self.n, 65536)]) if self.n else np.zeros(0, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, low, high = _HEAD.unpack_from(data)
        at = _HEAD.size
        take = lambda kind, size, at: np.frombuffer(data, dtype=kind, count=size, offset=at)
        return cls(n, bits, take(np.uint8, low, at), take(np.uint8, high, at + low), take("<u4", -(-n // SAMPLE), at + low + high))
