"""A minimal perfect hash over pairs of longs, with the keys stored by slot.

Keys are dealt over a bit array about twice as long as they are many; those that are alone in their place keep it, the others are dealt
anew over a next, shorter array.  A key's slot is the number of set bits before its own.  Every key gets a slot of its own below the number of
keys; a pair that is no key may run into some slot as well, so a look-up compares both longs with those stored there.
"""

from __future__ import annotations

import numpy as np

from skeinwork.llm.shingles import mix

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def _place(p: np.ndarray, q: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = _U((level + 1) * _STEP % (1 << 64))
    h = mix(mix(p.astype(np.uint64) + seed) + q.astype(np.uint64) * _U(_STEP))
    return ((h >> _U(32)) * _U(size)) >> _U(32)


class PerfectHash:
    """The slots of distinct pairs (p, q), which do not depend on the order they are given in."""

    def __init__(self, p: np.ndarray, q: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.p, self.q = np.zeros(len(p), np.int64), np.zeros(len(q), np.int64)
        left, before = np.arange(len(p)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys are not distinct")
            size = -(-2 * len(left) // 64) * 64
            at = _place(p[left], q[left], len(self.levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self.levels.append((bits, ranks[:-1], size))
            before = int(ranks[-1])
            left = left[~alone[at.astype(np.int64)]]
        slots = self._slots(p, q)
        self.p[slots], self.q[slots] = p, q

    def __len__(self) -> int:
        return len(self.p)

    def _slots(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out, left = np.full(len(p), -1, np.int64), np.arange(len(p))
        for level, (bits, ranks, size) in enumerate(self.levels):
            at = _place(p[left], q[left], level, size)
            word, bit = bits[(at >> _U(6)).astype(np.int64)], at & _U(63)
            hit = ((word >> bit) & _U(1)).astype(bool)
            slot = ranks[(at >> _U(6)).astype(np.int64)] + np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            out[left[hit]] = slot[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def find(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 where it is no key."""
        out = self._slots(p, q)
        if len(self):
            out[(self.p[out] != p) | (self.q[out] != q)] = -1
        return out
