"""Token-id files: canonical length-limited Huffman codes from global counts.

A data set is a folder of part files in ascending key order. A part is a header with the code lengths
and then groups of about GROUP ids; a group holds its documents' keys and token counts, the bits, and a
bit-offset checkpoint for every block of ids, so that blocks decode on their own with one table lookup
a symbol, all blocks of a group together.

The write takes three passes: texts are encoded once into compressed ids on the shared folder; ids are
counted, a partial count per task; documents are dealt to parts by ranges of their key and written. The
driver holds one count per vocabulary entry and one manifest row per part.

Defined results: a null text is the empty text, whose document is the end id alone. Null keys come
first. Documents with equal keys stand in the order of a hash of their ids. Only key and text are read.
An empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import functools
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import huffman
from panelwright.llm.common import map_arrow, open_shared, sent_file, shared_path, stored, texts_of
from panelwright.llm.pretokenize import coded, unicode_classes
from panelwright.llm.slices import SliceCodes

MAGIC = b"PWHF1\n"
#: Ids of a group; a longer document makes its group longer.
GROUP = 1 << 20
#: Documents of a group at most.
GROUP_DOCUMENTS = 1 << 14
#: Ids of a part, about, where there are more than shuffle partitions hold.
PART_IDS = 1 << 26
_HEAD = struct.Struct("<6sIIB")
_GROUP = struct.Struct("<QQQQ")


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """The library's byte-level BPE model behind a cache of pre-tokens.

    With match_added, a text that holds one of the tokenizer's added tokens is cut at them first, as the library
    does by default; without it they are ordinary text, as with the library's encode_special_tokens.
    """

    def __init__(self, tokenizer: str | bytes, classes: bytes | None = None, match_added: bool = True):
        """tokenizer: a file, or its bytes."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer) if isinstance(tokenizer, bytes) else Tokenizer.from_file(tokenizer)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.classes = classes or unicode_classes()
        self.slices = SliceCodes(self._make)
        tokens = self.tokenizer.get_added_tokens_decoder() if match_added else {}
        self.added = {t.content: np.array([i], np.uint32) for i, t in tokens.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        #: Tokens that take white space in or ask for a word's bounds: texts that hold one are left to the library.
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens.values())

    def _make(self, slices: list[bytes]) -> list[np.ndarray]:
        letters, tokenize = self.letters, self.model.tokenize
        return [np.array([t.id for t in tokenize(s.decode("latin-1").translate(letters))], np.uint32) for s in slices]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = [self.cuts.split(t) if self.cuts else [t] for t in texts]  # text, token, text, ..., text
        if self.whole:
            cut = [parts if len(parts) == 1 else [] for parts in cut]
        plain = coded([part for parts in cut for part in parts[::2]], self.classes, self.slices)
        for text, parts in zip(texts, cut):
            if parts:
                yield np.concatenate([self.added[part] if i % 2 else next(plain) for i, part in enumerate(parts)])
            else:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def text_encoder(tokenizer: bytes, classes: bytes, match_added: bool = True) -> TextEncoder:
    return TextEncoder(tokenizer, classes, match_added)


def _pack_ids(ids: np.ndarray) -> bytes:
    return zlib.compress(ids.astype("<u4" if ids.max(initial=0) > 0xFFFF else "<u2").tobytes(), 1)


def _unpack_ids(data: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text", match_added: bool = True) -> DataFrame:
    """(key, n, packed, tie): each text's ids and end_id, compressed; tie orders documents of equal keys."""
    classes, sent = unicode_classes(), sent_file(docs.sparkSession, tokenizer_file)

    def rows(batch):
        coder = text_encoder(sent.value, classes, match_added)
        found = [np.append(x, np.uint32(end_id)) for x in coder.encode(texts_of(batch, text))]
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(x) for x in found], pa.int64()), pa.array([_pack_ids(x) for x in found], pa.binary())], names=[key, "n", "packed"])

    docs = docs.select(key, text)
    ids = map_arrow(docs, rows, f"`{key}` {docs.schema[key].dataType.simpleString()}, n bigint, packed binary")
    return stored(ids.withColumn("tie", F.xxhash64("packed")), "token-ids", compression="uncompressed")


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs over all documents; one row per task and id is summed."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data, n in zip(batch.column("packed").to_pylist(), batch.column("n").to_pylist()):
                own = np.bincount(_unpack_ids(data, n))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = ids.select("packed", "n").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _write_head(sink, lengths: np.ndarray) -> None:
    packed = zlib.compress(lengths.tobytes(), 6)
    sink.write(_HEAD.pack(MAGIC, len(lengths), len(packed), 1) + packed)


def _write_group(sink, keys: pa.Array, sizes: list[int], ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> None:
    bits, checkpoints = huffman.encode(ids, lengths, codes)
    table = pa.record_batch([keys, pa.array(sizes, pa.int64())], names=["key", "n"])
    buffer = io.BytesIO()
    with pa.ipc.new_stream(buffer, table.schema) as writer:
        writer.write_batch(table)
    head = zlib.compress(buffer.getvalue(), 1)
    marks = np.diff(checkpoints, prepend=0).astype("<u4").tobytes()
    sink.write(_GROUP.pack(len(head), len(marks), len(bits), len(ids)))
    for part in (head, marks, bits):
        sink.write(part)


def write(ids: DataFrame, folder: str, parts: int | None = None, key: str = "doc_id") -> list[tuple[int, str, int, int]]:
    """Writes the data set; (part, file, documents, ids) in order. Parts are written anew if their task is.

    Without parts there are as many as shuffle partitions, and more where a part would hold over PART_IDS ids.
    """
    spark = ids.sparkSession
    counts = id_counts(ids)
    lengths = huffman.code_lengths(counts)
    sent = spark.sparkContext.broadcast(lengths)  # a byte for each entry of the vocabulary
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // PART_IDS))

    def run(batches):
        lengths = sent.value
        codes = huffman.codes(lengths)
        part = TaskContext.get().partitionId()
        store, root = open_shared(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}.pwhf"
        attempt = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
        n_docs = n_ids = group_ids = 0
        keys, sizes, held, kind = [], [], [], None

        with store.open_output_stream(attempt) as sink:
            _write_head(sink, lengths)
            for batch in batches:
                kind = batch.column(key).type
                for k, n, data in zip(batch.column(key).to_pylist(), batch.column("n").to_pylist(), batch.column("packed").to_pylist()):
                    keys.append(k)
                    sizes.append(n)
                    held.append(_unpack_ids(data, n))
                    n_docs, n_ids, group_ids = n_docs + 1, n_ids + n, group_ids + n
                    if len(keys) >= GROUP_DOCUMENTS or group_ids >= GROUP:
                        _write_group(sink, pa.array(keys, kind), sizes, np.concatenate(held), lengths, codes)
                        keys, sizes, held, group_ids = [], [], [], 0
            if keys:
                _write_group(sink, pa.array(keys, kind), sizes, np.concatenate(held), lengths, codes)
        if n_docs:
            store.move(attempt, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "file", "n_docs", "n_ids"])
        else:
            store.delete_file(attempt)

    dealt = ids.repartitionByRange(parts, key, "tie").sortWithinPartitions(key, "tie")
    rows = dealt.select(key, "n", "packed").mapInArrow(run, "part int, file string, n_docs bigint, n_ids bigint").collect()
    return sorted(tuple(r) for r in rows)


def read_part(uri: str) -> Iterator[tuple[pa.Array, list[int], np.ndarray]]:
    """(keys, token counts, ids) of each group of a part file."""
    store, path = open_shared(uri)
    with store.open_input_stream(path) as source:
        magic, _, packed, _ = _HEAD.unpack(source.read(_HEAD.size))
        assert magic == MAGIC, uri
        decoder = huffman.Decoder(np.frombuffer(zlib.decompress(source.read(packed)), np.uint8))
        while head := source.read(_GROUP.size):
            a, b, c, n = _GROUP.unpack(head)
            with pa.ipc.open_stream(zlib.decompress(source.read(a))) as reader:
                table = reader.read_all()
            checkpoints = np.cumsum(np.frombuffer(source.read(b), "<u4").astype(np.int64))
            yield table["key"].combine_chunks(), table["n"].to_pylist(), decoder.decode(source.read(c), checkpoints, n)


def read_documents(spark, folder: str, manifest: list[tuple[int, str, int, int]], key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """(key of type kind, start, n_tokens, ids_crc32) of each document, from the files; start counts the ids before it."""
    base, rows = 0, []
    for _, name, _, n_ids in manifest:
        rows.append((f"{folder}/{name}", base))
        base += n_ids
    listed = spark.createDataFrame(rows, "file string, base bigint")
    listed = listed.repartition(max(1, len(rows)))

    def one(batch):
        for file, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
            for keys, sizes, ids in read_part(file):
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                checks = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([keys, pa.array(begins + start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(checks, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])
                start += len(ids)

    return map_arrow(listed, one, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def store_and_read(docs: DataFrame, tokenizer_file: str, end_id: int = 2, key: str = "doc_id", text: str = "text", match_added: bool = True) -> DataFrame:
    """docs written as token-id files in the shared folder and read back; match_added as in TextEncoder."""
    spark = docs.sparkSession
    folder = shared_path(spark, "token-files")
    manifest = write(encoded(docs, tokenizer_file, end_id, key, text, match_added), folder, None, key)
    return read_documents(spark, folder, manifest, key, docs.schema[key].dataType.simpleString())
