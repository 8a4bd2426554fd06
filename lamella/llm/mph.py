"""A minimal perfect hash over 64-bit keys, built and queried in numpy batches.

Keys that meet no other key in a level's bit array take its bit; the rest go to the next level, under another seed.
A key's slot is the rank of its bit over all levels, so n keys get the slots 0..n-1 in about 3.5 bits a key, and a lookup reads one
bit per level. Keys outside the set get some slot or none: stored fingerprints tell them apart.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA, MAX_LEVELS = 1.6, 64


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective finalizer of 64-bit words, varied by a seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes  # packed bits, bits in each
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        self.bits = bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, sizes = np.asarray(keys).astype(np.uint64), [], []
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys repeat: a perfect hash needs distinct keys")
            m = max(64, -(-int(len(left) * GAMMA) // 8) * 8)
            at = (mix64(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(m)
            left = left[~alone[at]]
        return cls(levels, sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot per key; -1 for keys that no level holds."""
        keys = np.asarray(keys).astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, m in enumerate(self.sizes):
            if not len(open_):
                break
            at = (mix64(keys[open_], k) % np.uint64(m)).astype(np.int64)
            byte, bit = self.base[k] + (at >> 3), (at & 7).astype(np.uint8)
            v = self.bits[byte]
            hit = (v >> bit) & 1 == 1
            rank = self.before[byte] + np.bitwise_count(v & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes) + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, = struct.unpack_from("<I", raw)
        sizes, pos, levels = list(struct.unpack_from(f"<{n}Q", raw, 4)), 4 + 8 * n, []
        for m in sizes:
            levels.append(np.frombuffer(raw, np.uint8, m // 8, pos))
            pos += m // 8
        return cls(levels, sizes)
