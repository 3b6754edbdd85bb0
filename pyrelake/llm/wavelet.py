"""Wavelet matrix over token ids, as bytes.

Level by level, from the highest bit of an id to the lowest, the matrix stores that bit of every position as a bit
plane and reorders the positions stably by it (zeros first). Rank over the planes gives access to a position, the count of an id in a
prefix, and select the position of its k-th occurrence.

Format, little-endian: magic ``WVM1``, u32 levels, u64 length; then for each level u64 zeros, the plane (whole 64-bit
words), and a rank directory of u32 (ones before each block of 512 positions).
"""

from __future__ import annotations

import numpy as np

MAGIC, BLOCK = b"WVM1", 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray) -> bytes:
    a = np.ascontiguousarray(ids, np.uint32)
    levels = max(1, int(a.max()).bit_length()) if len(a) else 1
    narrow = a.astype(np.uint16) if levels <= 16 else a
    parts = [MAGIC, np.uint32(levels).tobytes(), np.uint64(len(a)).tobytes()]
    for level in range(levels - 1, -1, -1):
        bit = (narrow & narrow.dtype.type(1 << level)).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        plane = np.r_[plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)]
        ones = np.bitwise_count(plane.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        parts += [np.uint64(len(a) - int(ones.sum())).tobytes(), plane.tobytes(), np.r_[np.uint32(0), np.cumsum(ones, dtype=np.uint32)].astype("<u4").tobytes()]
        narrow = np.concatenate([narrow.take(np.flatnonzero(~bit)), narrow.take(np.flatnonzero(bit))])
    return b"".join(parts)


class WaveletMatrix:
    """Reads the bytes without unpacking them."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.levels, self.n = int(np.frombuffer(raw, "<u4", 1, 4)[0]), int(np.frombuffer(raw, "<u8", 1, 8)[0])
        blocks, at = -(-self.n // BLOCK), 16
        self.zeros, self.planes, self.ranks = [], [], []
        for _ in range(self.levels):
            self.zeros.append(int(np.frombuffer(raw, "<u8", 1, at)[0]))
            self.planes.append(np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at + 8))
            self.ranks.append(np.frombuffer(raw, "<u4", blocks + 1, at + 8 + blocks * BLOCK // 8))
            at += 8 + blocks * BLOCK // 8 + 4 * (blocks + 1)

    def _rank1(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        plane, start = self.planes[level], block * BLOCK // 8
        ones = int(self.ranks[level][block]) + int(_ONES[plane[start : start + rest // 8]].sum())
        return ones + (int(_ONES[plane[start + rest // 8] & ((1 << rest % 8) - 1)]) if rest % 8 else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(self.levels):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` occurs before position i."""
        if value >> self.levels:
            return 0
        start = 0
        for level in range(self.levels):
            a, b = self._rank1(level, start), self._rank1(level, i)
            start, i = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.levels - 1 - level) & 1 else (start - a, i - b)
        return i - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of ``value``; -1 if there are fewer."""
        low, high = 0, self.n
        if k < 0 or k >= self.count(value):
            return -1
        while low < high:
            mid = (low + high) // 2
            if self.rank(value, mid + 1) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def decode(self) -> np.ndarray:
        """All ids, by undoing the reorderings from the last level to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[~bit] = values[: self.zeros[level]]
            back[bit] = values[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            values = back
        return values.astype(np.uint32)
