"""A table of distinct chunks met by a worker: each chunk is segmented once and found again by its hash."""

from __future__ import annotations

import sys
import types

import numpy as np

from .common import shipped


def per_process(key, make):
    """A value that outlives one task where Spark reuses its Python workers; functions that travel by value have no globals to keep it in."""
    kept = sys.modules.setdefault("_inkwell_kept", types.ModuleType("_inkwell_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class ChunkTable:
    """Direct-mapped from 64-bit hash to entry number. Memory is bounded: at `limit` entries it starts anew."""

    def __init__(self, encode, add, clear, bits: int = 20, limit: int = 400_000):
        self.encode, self.add, self.clear, self.limit = encode, add, clear, limit
        self.keys = np.zeros(1 << bits, np.uint64)
        self.entry = np.full(1 << bits, -1, np.int32)
        self.mask = np.uint64((1 << bits) - 1)
        self.size = 0

    def find(self, hashes: np.ndarray, chunk_at) -> np.ndarray:
        """The entry number of each hash. chunk_at(i) gives the chunk at place i, and is asked once for each new chunk."""
        if self.size > self.limit:
            self.entry.fill(-1)
            self.size = 0
            self.clear()
        slot = (hashes & self.mask).astype(np.int64)
        out = self.entry[slot]
        miss = np.flatnonzero((out < 0) | (self.keys[slot] != hashes))
        if len(miss):
            new, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            self.add(self.encode([chunk_at(i) for i in miss[first].tolist()]))
            numbers = np.arange(self.size, self.size + len(new), dtype=np.int32)
            self.size += len(new)
            out[miss] = numbers[back]
            at = (new & self.mask).astype(np.int64)
            self.keys[at], self.entry[at] = new, numbers  # of two for one slot the later stays; the other is segmented again
        return out


shipped(__name__)
