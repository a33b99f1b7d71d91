"""Canonical length-limited Huffman codes over token ids, vectorised over independent blocks."""

from __future__ import annotations

import numpy as np

#: Symbols of a block; each block's bit offset is a checkpoint from which decoding can start.
BLOCK = 512


def limit_for(n_used: int) -> int:
    """The code length limit: 16 bits, more only if so many symbols need longer codes."""
    return max(16, int(n_used - 1).bit_length() + 1 if n_used > 1 << 15 else 0)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """The code length of each symbol (0: unused) that is least in all, by package-merge under limit_for."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, flags = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit_for(len(used)) - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        weights = np.concatenate([leaves, packages])
        at = np.argsort(weights, kind="stable")
        level = weights[at]
        flags.append(at < len(leaves))
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(flags):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, equal lengths in the symbols' order."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.int64)
    longest = int(own.max(initial=1))
    steps = np.left_shift(np.int64(1), longest - own)
    out = np.zeros(len(lengths), np.uint32)
    out[order] = (np.cumsum(steps) - steps) >> (longest - own)
    return out


def pack(values: np.ndarray, widths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """values written with the given numbers of bits (at most 32), most significant first, and each one's bit offset."""
    widths = widths.astype(np.int64)
    ends = np.cumsum(widths)
    offsets = ends - widths
    if not len(values) or not ends[-1]:
        return b"", offsets
    word, shift = offsets >> 5, offsets & 31
    wide = values.astype(np.uint64) << (64 - shift - widths).astype(np.uint64)
    if not widths.all():
        wide[widths == 0] = 0
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] = np.add.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: -(-int(ends[-1]) // 8)], offsets


class Decoder:
    """Table-driven: one lookup of the longest code's width gives a symbol and its length."""

    def __init__(self, lengths: np.ndarray):
        self.longest = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = np.left_shift(1, self.longest - lengths[order].astype(np.int64))
        size = 1 << self.longest
        self.symbols = np.zeros(size, np.uint32)
        self.lengths = np.ones(size, np.int64)
        self.symbols[: spans.sum()] = np.repeat(order, spans)
        self.lengths[: spans.sum()] = np.repeat(lengths[order], spans)

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """n symbols whose blocks begin at the bit offsets checkpoints; all blocks advance together."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((block, len(at)), np.uint32)
        mask, keep = np.uint32((1 << self.longest) - 1), 32 - self.longest
        full = n - block * (len(at) - 1)
        for i in range(block):
            if i == full:
                at = at[:-1]
            if not len(at):
                break
            code = (windows.take(at >> 3) >> (keep - (at & 7)).astype(np.uint32)) & mask
            out[i, : len(at)] = self.symbols.take(code)
            at = at + self.lengths.take(code)
        return out.T.ravel()[:n]


def encode(ids: np.ndarray, lengths: np.ndarray, coded: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bits of ids and the checkpoints of its blocks."""
    data, offsets = pack(coded[ids], lengths[ids])
    return data, offsets[::block]
