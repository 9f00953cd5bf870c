"""Minimal perfect hashing of 64-bit keys by levels of bit arrays, with fingerprints, in numpy.

Each level hashes the keys that are left into a bit array; keys that are alone at their place set its bit and are done. The slot of
a key is the number of bits set before its own over all levels, so that n keys get the slots 0 to n - 1, and a lookup
takes a constant expected number of steps. A key that was never indexed is told apart by the fingerprint stored at its slot.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) of each key, with a seed for each level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Built from distinct int64 keys, or read from ``to_bytes``."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            ranks = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
            self.before.append(ranks[:-1] + total)
            total += int(ranks[-1])
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.unique(keys.astype(np.int64)).view(np.uint64), []
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys do not separate")
            places = (mixed(left, len(levels)) % np.uint64(max(64, int(GAMMA * len(left))))).astype(np.int64)
            alone = np.bincount(places, minlength=max(64, int(GAMMA * len(left)))) == 1
            levels.append(alone)
            left = left[~alone[places]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it (keys that were not indexed may also get some slot)."""
        keys = keys.astype(np.int64).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            places = (mixed(keys[left], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[places]
            out[left[hit]] = self.before[i][places[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = [len(x) for x in self.levels]
        return struct.pack(f"<I{len(sizes)}Q", len(sizes), *sizes) + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", data)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", data, 4), 4 + 8 * n, []
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels)
