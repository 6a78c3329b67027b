"""Elias-Fano coding of non-decreasing integers, with select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQB")
#: Every so many ones the position of one is kept, for select.
SAMPLE = 256
_BITS = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class EliasFano:
    """n values up to universe in about n * (2 + log2(universe / n)) bits.

    The low bits are packed; the high bits are a unary bit string in which the i-th one stands at
    ``high(i) + i``.  A sample of its ones' positions (32 bits each, one for 256 values) starts select.
    """

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        if len(v) and (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        n, universe = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return _HEAD.pack(self.n, self.universe, self.low_bits) + struct.pack("<3Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def frombytes(cls, data) -> "EliasFano":
        n, universe, low_bits = _HEAD.unpack_from(data, 0)
        sizes = struct.unpack_from("<3Q", data, _HEAD.size)
        at, parts = _HEAD.size + 24, []
        for size in sizes:
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(n, universe, low_bits, parts[0], parts[1], parts[2].view("<u4"))

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Value i, from the nearest sample on; no table of values is made."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        left += int(_BITS[self.high[byte] & ((1 << (at & 7)) - 1)])
        while (ones := int(_BITS[self.high[byte]])) <= left:
            left -= ones
            byte += 1
        bits, word = int(self.high[byte]), 0
        for _ in range(left):
            bits &= bits - 1
        word = (bits & -bits).bit_length() - 1
        top, value = (byte << 3) + word - i, 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return top << self.low_bits | value

    def decode(self) -> np.ndarray:
        """All values, for scans."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            values |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return values.astype(np.int64)
