"""Fill-in-middle transformation of whole texts, cut at unit boundaries that a compressed set of offsets selects.

A text's units are its lines. The offsets at which units end, and 0, are a set of code-point positions of up to millions; it is kept
as chunks of 65,536 positions, each in the smallest of three containers: a sorted array, a bitmap or runs. A cut after c units is
the set's member of rank c: a search in the cumulative cardinalities finds the container, a select in it the member. Only the
members that are asked for are ever decoded.

A null text is empty; an empty text, and one that holds a marker already, is left plain. A null doc_id draws like the empty
string. Rows that repeat a doc_id are drawn alike. An empty table gives no rows; other columns of the table aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import map_arrow

CHUNK = 1 << 16
MARKS = ("<P>", "<S>", "<M>")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").sum(axis=1)


@dataclass(frozen=True)
class Container:
    """The members of one chunk, as offsets in it."""

    kind: str  # array, bitmap or runs
    data: np.ndarray

    @classmethod
    def of(cls, members: np.ndarray) -> Container:
        """The smallest container: 2 bytes a member, 8,192 bytes, or 4 bytes a run."""
        breaks = np.flatnonzero(np.diff(members) != 1) + 1
        starts = np.concatenate(([0], breaks))
        if 4 * len(starts) < min(2 * len(members), CHUNK // 8):
            lengths = np.diff(np.concatenate((starts, [len(members)])))
            return cls("runs", np.column_stack((members[starts], lengths)).astype(np.int32))
        if 2 * len(members) <= CHUNK // 8:
            return cls("array", members.astype(np.uint16))
        bits = np.zeros(CHUNK, np.uint8)
        bits[members] = 1
        return cls("bitmap", np.packbits(bits, bitorder="little"))

    def select(self, rank: int) -> int:
        """The member of this rank, from 0."""
        if self.kind == "array":
            return int(self.data[rank])
        if self.kind == "runs":
            upto = np.cumsum(self.data[:, 1])
            run = int(np.searchsorted(upto, rank, side="right"))
            return int(self.data[run, 0] + rank - (upto[run] - self.data[run, 1]))
        upto = np.cumsum(_BYTE_BITS[self.data])
        byte = int(np.searchsorted(upto, rank, side="right"))
        left = rank - int(upto[byte] - _BYTE_BITS[self.data[byte]])
        return 8 * byte + int(np.flatnonzero(np.unpackbits(self.data[byte : byte + 1], bitorder="little"))[left])


@dataclass(frozen=True)
class BoundarySet:
    """A set of offsets: its chunks' numbers, their containers, and how many members there are up to the end of each."""

    keys: np.ndarray
    containers: list[Container]
    upto: np.ndarray

    @classmethod
    def of(cls, members: np.ndarray) -> BoundarySet:
        """members: ascending and distinct."""
        high = members >> 16
        keys, starts = np.unique(high, return_index=True)
        parts = np.split(members & (CHUNK - 1), starts[1:])
        return cls(keys, [Container.of(p) for p in parts], np.cumsum([len(p) for p in parts]))

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, rank: int) -> int:
        """The member of this rank, from 0: its container by the cumulative cardinalities, then its place there."""
        at = int(np.searchsorted(self.upto, rank, side="right"))
        before = int(self.upto[at - 1]) if at else 0
        return int(self.keys[at]) * CHUNK + self.containers[at].select(rank - before)


def line_boundaries(text: str) -> BoundarySet:
    """0 and the code-point offsets after each line feed, and the end of the text."""
    if text.isascii():
        points = np.frombuffer(text.encode(), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    last = [len(points)] if len(points) and points[-1] != 10 else []
    return BoundarySet.of(np.concatenate(([0], ends, last)).astype(np.int64))


def draws(seed: str, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the sha256 of `seed:doc_id`."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(docs: DataFrame, seed: str = "7", rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_end, middle_end, output): units, psm, spm or plain, both cuts as code points (null if plain) and the text.

    rate: percent of documents that are transformed; spm_rate: percent of those with the suffix first.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            ends = line_boundaries(text)
            n = len(ends) - 1
            h1, h2, h3, h4 = draws(seed, doc_id)
            if not text or h3 % 100 >= rate or any(mark in text for mark in MARKS):
                out.append((n, "plain", None, None, text))
                continue
            a, b = (ends.select(c) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            form = "spm" if h4 % 100 < spm_rate else "psm"
            shown = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
            out.append((n, form, a, b, shown))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "form", "prefix_end", "middle_end", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), rows, f"doc_id {kind}, n bigint, form string, prefix_end bigint, middle_end bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that output was made from: its parts stand between the first markers, as no transformed text holds one."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))).when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(output)


def transform_digests(docs: DataFrame) -> DataFrame:
    """Per document: units, form, lengths of prefix and middle, digests of the output and of the text rebuilt from it."""
    found = transform(docs)
    digest = lambda c: F.sha2(c, 256)
    return found.select(
        "doc_id", "n", "form", F.col("prefix_end").alias("prefix_chars"), (F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
