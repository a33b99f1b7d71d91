"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by `pretokenize` (class arrays and a transition-function scan, no
regex). New slices of a run of texts are merged together, a pair of each slice a round, and cached; a
text's ids are its slices' cached ids joined. Byte offsets of the tokens are kept, so any token range decodes to its bytes alone.

Defined results: a null text encodes as the empty text (no ids, no bytes). Repeated rows give repeated
rows. Very long slices are merged with a heap in n log n. Only the named columns are read; other input
columns are kept by `encode` and dropped by `round_trip_digests`. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import file_bytes, map_arrow, sent_file, texts_of
from panelwright.llm.pretokenize import coded, unicode_classes
from panelwright.llm.slices import Pool, SliceCodes

#: Slices of at least so many bytes are merged with a heap.
LONG_SLICE = 96
NO_PAIR = np.int64(1 << 30)


class PairTable:
    """The rank of every pair of tokens whose bytes together are a token, looked up for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int64)[order], NO_PAIR)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], NO_PAIR)


def merged_together(pieces: list[bytes], table: PairTable) -> list[np.ndarray]:
    """Ids of each slice: in every round each slice merges its pair of lowest rank, the leftmost of equals."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    ids = table.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    pair = np.full(len(ids), NO_PAIR)
    pair[:-1] = np.where(owner[:-1] == owner[1:], table.find(ids[:-1], ids[1:]), NO_PAIR)
    while len(ids):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(pair << 32 | np.arange(len(ids)), first)
        done = best >> 32 == NO_PAIR
        if done.any():
            size = np.diff(np.append(first, len(ids)))
            for slice_, a, n in zip(owner[first[done]].tolist(), first[done].tolist(), size[done].tolist()):
                out[slice_] = ids[a : a + n]
            stay = np.repeat(~done, size)
            ids, owner, pair = ids[stay], owner[stay], pair[stay]
            moved = np.cumsum(stay) - 1
            at = moved[best[~done] & 0xFFFFFFFF]
        else:
            at = best & 0xFFFFFFFF
        ids[at] = pair[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        at = (np.cumsum(keep) - 1)[at]
        ids, owner, pair = ids[keep], owner[keep], pair[keep]
        for left in (at[at > 0] - 1, at[at + 1 < len(ids)]):
            pair[left] = np.where(owner[left] == owner[left + 1], table.find(ids[left], ids[left + 1]), NO_PAIR)
        pair[-1:] = NO_PAIR
    return out


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one slice, with a heap over a linked list of spans [start, end)."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap = []

    def offer(left: int) -> None:
        right = end[left]
        if right < n:
            rank = ranks.get(piece[left : end[right]])
            if rank is not None:
                heap.append((rank, left, end[right]))

    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = end[left]
        if not alive[left] or right >= n or end[right] != stop:
            continue
        alive[right] = 0
        end[left] = stop
        if stop < n:
            before[stop] = left
        for at in (left, before[left]):
            if at >= 0 and end[at] < n:
                rank = ranks.get(piece[at : end[end[at]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, end[end[at]]))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.pieces = Pool(pieces)
        self.decimals = Pool([b"%d " % i for i in range(size)])
        self.table = PairTable(ranks)
        self.slices = SliceCodes(self._make)

    def _make(self, slices: list[bytes]) -> list[np.ndarray]:
        whole = list(map(self.ranks.get, slices))
        out = [None if rank is None else np.array([rank], np.uint32) for rank in whole]
        apart = [i for i, rank in enumerate(whole) if rank is None and len(slices[i]) < LONG_SLICE]
        for i, ids in zip(apart, merged_together([slices[i] for i in apart], self.table)):
            out[i] = ids
        return [np.array(merged_long(slices[i], self.ranks), np.uint32) if ids is None else ids for i, ids in enumerate(out)]

    def encode(self, texts: list[str], classes: bytes | None = None) -> Iterable[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        return coded(texts, classes or unicode_classes(), self.slices)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token, and the length of all."""
        return np.concatenate([[0], np.cumsum(self.pieces.count[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.pieces.joined(ids)

    def decode_span(self, ids: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> bytes:
        """Bytes start to stop of the decoded text, from the tokens that cover them alone."""
        lo = max(0, int(np.searchsorted(offsets, start, "right")) - 1)
        hi = int(np.searchsorted(offsets, stop, "left"))
        return self.decode(ids[lo:hi])[start - int(offsets[lo]) :][: max(0, stop - start)]


@functools.cache
def codec_of(ranks: bytes) -> Codec:
    """The codec of a rank file's bytes, built once per worker."""
    return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})


def codec(rank_file: str) -> Codec:
    return codec_of(file_bytes(rank_file))


def encode(docs: DataFrame, rank_file: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """docs with the ids array<int> of each text and the byte offsets array<long> of its tokens (one more than ids)."""
    kept = [c for c in docs.columns if c not in (ids, offsets)]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    classes, sent = unicode_classes(), sent_file(docs.sparkSession, rank_file)

    def rows(batch):
        coder = codec_of(sent.value)
        found = list(coder.encode(texts_of(batch, text), classes))
        columns = [batch.column(c) for c in kept]
        columns += [pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([coder.offsets(x) for x in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, offsets])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return map_arrow(docs, rows, ", ".join([*fields, f"`{ids}` array<int>", f"`{offsets}` array<bigint>"]))


def decode(tokens: DataFrame, rank_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the text that its ids decode to; a null array gives null, bytes that aren't UTF-8 the replacement character."""
    kept = [c for c in tokens.columns if c != text]
    tokens = tokens.select(*[F.col(f"`{c}`") for c in kept])
    sent = sent_file(tokens.sparkSession, rank_file)

    def rows(batch):
        coder = codec_of(sent.value)
        found = [None if x is None else coder.decode(np.array(x, np.uint32)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.string())], names=[*kept, text])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema]
    return map_arrow(tokens, rows, ", ".join([*fields, f"`{text}` string"]))


def round_trip_digests(docs: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text encoded and its ids decoded again: counts and digests of both, for checks of whole corpora."""
    classes, sent = unicode_classes(), sent_file(docs.sparkSession, rank_file)

    def rows(batch):
        coder = codec_of(sent.value)
        counts, id_digests, byte_digests, sizes = [], [], [], []
        for ids in coder.encode(texts_of(batch, text), classes):
            data = coder.decode(ids)
            assert len(data) == int(coder.offsets(ids)[-1])
            counts.append(len(ids))
            sizes.append(len(data))
            id_digests.append(hashlib.sha256(coder.decimals.joined(ids)[:-1]).hexdigest())
            byte_digests.append(hashlib.sha256(data).hexdigest())
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "decoded_bytes"]
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(byte_digests), pa.array(sizes, pa.int64())], names=names)

    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs, rows, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_bytes bigint")
