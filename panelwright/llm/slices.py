"""A bounded cache from slices of bytes to their codes, looked up and filled for whole arrays of slices.

A slice of at most WIDE bytes is three 64-bit words, the last of which also holds its length; words are compared
whole, so a hit is exact. Codes of all slices lie in one pool; an entry is the place and number of its codes. Slices
that are new to the table are coded once a block, together; longer ones are coded anew in every block. The table is
emptied when it is full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WIDE = 23
#: Zero bytes that must follow the data, so that the words of its last slice can be read.
PADDING = 32
#: Slices that are looked up together.
BLOCK = 1 << 17
SLOT_BITS = 20
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_HALF = np.uint64(32)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of each range, one range after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + count, count)


class Pool:
    """Parts of one array by number, gathered for arrays of numbers."""

    def __init__(self, parts: list[bytes]):
        self.values = np.frombuffer(b"".join(parts), np.uint8)
        self.count = np.fromiter(map(len, parts), np.int64, len(parts))
        self.first = np.cumsum(self.count) - self.count

    def joined(self, numbers: np.ndarray) -> bytes:
        return self.values[spread(self.first[numbers], self.count[numbers])].tobytes()


class SliceCodes:
    """make: the codes of some slices as unsigned 32-bit integers."""

    def __init__(self, make: Callable[[list[bytes]], list[np.ndarray]], slot_bits: int = SLOT_BITS):
        self.make, self.bits = make, slot_bits
        slots = 1 << slot_bits
        self.words = np.zeros((3, slots), np.uint64)
        self.first, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.held, self.entries = np.zeros(1 << 16, np.uint32), 0, 0

    def codes(self, data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all slices, number of codes of each). data ends with PADDING zeros."""
        parts, counts = [], []
        for lo in range(0, len(begins), BLOCK):
            first, count = self._block(data, begins[lo : lo + BLOCK], ends[lo : lo + BLOCK])
            parts.append(self.pool[spread(first, count)])
            counts.append(count)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(parts), np.concatenate(counts)

    def _block(self, data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.entries + BLOCK > 3 << (self.bits - 2):
            self.words[2], self.held, self.entries = 0, 0, 0
        sizes = ends - begins
        first, count = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        short = np.flatnonzero(sizes <= WIDE)
        at = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        words = [at[begins[short] + 8 * k] & _KEEP[np.clip(sizes[short] - 8 * k, 0, 8)] for k in range(3)]
        words[2] |= sizes[short].astype(np.uint64) << np.uint64(56)
        mixed = np.zeros(len(short), np.uint64)
        for word, factor in zip(words, _FACTORS):
            mixed = (mixed ^ word) * factor
            mixed ^= mixed >> _HALF
        start = (mixed * _FACTORS[0] >> np.uint64(64 - self.bits)).astype(np.int64)
        slots = self._find(words, start)
        while len(missing := np.flatnonzero(slots < 0)):
            new = missing[np.unique(mixed[missing], return_index=True)[1]]
            self._insert([w[new] for w in words], start[new], [data[a:b] for a, b in zip(begins[short[new]].tolist(), ends[short[new]].tolist())])
            slots[missing] = self._find([w[missing] for w in words], start[missing])
        first[short], count[short] = self.first[slots], self.count[slots]
        long = np.flatnonzero(sizes > WIDE)
        if len(long):
            slices = [data[a:b] for a, b in zip(begins[long].tolist(), ends[long].tolist())]
            number = {s: i for i, s in enumerate(dict.fromkeys(slices))}
            held = self.held
            places, counts = self._keep(self.make(list(number)))
            self.held = held  # these codes last until the next block
            which = np.fromiter(map(number.__getitem__, slices), np.int64, len(slices))
            first[long], count[long] = places[which], counts[which]
        return first, count

    def _find(self, words: list[np.ndarray], start: np.ndarray) -> np.ndarray:
        """The slot of each slice, -1 where it has none."""
        out, todo, slot = np.full(len(start), -1), np.arange(len(start)), start
        while len(todo):
            last = self.words[2][slot]
            hit = last == words[2][todo]
            for k in (0, 1):
                hit &= self.words[k][slot] == words[k][todo]
            out[todo[hit]] = slot[hit]
            on = ~hit & (last != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, words: list[np.ndarray], start: np.ndarray, slices: list[bytes]) -> None:
        places, counts = self._keep(self.make(slices))
        todo, slot = np.arange(len(start)), start
        while len(todo):
            free = np.flatnonzero(self.words[2][slot] == 0)
            own = free[np.unique(slot[free], return_index=True)[1]]
            for k in range(3):
                self.words[k][slot[own]] = words[k][todo[own]]
            self.first[slot[own]], self.count[slot[own]] = places[todo[own]], counts[todo[own]]
            on = np.ones(len(todo), bool)
            on[own] = False
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        self.entries += len(start)

    def _keep(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        while self.held + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.held : self.held + len(flat)] = flat
        places = self.held + np.cumsum(counts) - counts
        self.held += len(flat)
        return places, counts
