"""Media columns: documents stored as progressive JPEG files and read back as bytes and RGB tensors.

Defined results: a null text is the empty text; the payload is its UTF-8 bytes and then spaces up to a
positive multiple of UNIT. Equal texts give equal files, tensors and features, whatever batch they are in:
all arithmetic is on whole numbers. Rows that repeat repeat. `store` reads only key and text; `read` keeps all
columns. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import progressive_jpeg as jpeg
from panelwright.llm.common import chunks, map_arrow, stored, texts_of

UNIT = 192
#: Characters of texts, or bytes of files, that are coded together; a longer one stands alone.
TOGETHER = 1 << 20


def padded(text: str) -> bytes:
    data = text.encode()
    return data.ljust(UNIT * max(1, -(-len(data) // UNIT)))


def feature(tensor: np.ndarray) -> str:
    """Width, height, the sums of the three channels and a checksum of all samples."""
    red, green, blue = (int(tensor[:, :, i].sum(dtype=np.int64)) for i in range(3))
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{red}:{green}:{blue}:{zlib.crc32(np.ascontiguousarray(tensor)):08x}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media binary): the file of each text, whose payload is the text and padding."""

    def rows(batch):
        texts, media = texts_of(batch, text), []
        for a, b in chunks(texts, TOGETHER):
            media += jpeg.encode([padded(t) for t in texts[a:b]])
        sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(key), sizes, pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    docs = docs.select(key, text)
    return map_arrow(docs, rows, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes bigint, media binary")


def read(stored_media: DataFrame, media: str = "media", tensor: bool = True, payload: str = "payload") -> DataFrame:
    """stored_media with what its files hold: payload binary, feature string and, with tensor, width, height and tensor binary.

    The tensor is the full-resolution RGB samples, row by row. A null file gives nulls; files that aren't of `store` have a
    null payload. Columns of these names are replaced.
    """
    added = [payload, "feature", *(["width", "height", "tensor"] if tensor else [])]
    kept = [c for c in stored_media.columns if c not in added]

    def rows(batch):
        files = batch.column(media).to_pylist()
        for a, b in chunks([f or b"" for f in files], TOGETHER):
            part = [f for f in files[a:b] if f is not None]
            images, coefficients = jpeg.coefficients_of(part)
            found = iter(zip(images, jpeg.tensors(images, coefficients)))
            out = [[] for _ in added]
            for file in files[a:b]:
                image, samples = (None, None) if file is None else next(found)
                row = [None] * 5 if image is None else [jpeg.payload_of(image, coefficients), feature(samples), image.width, image.height, samples.tobytes() if tensor else None]
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in kept], *[pa.array(c, k) for c, k in zip(out, kinds)]], names=[*kept, *added])

    kinds = {payload: "binary", "feature": "string", "width": "int", "height": "int", "tensor": "binary"}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stored_media.schema if f.name in kept]
    return map_arrow(stored_media.select(*[F.col(f"`{c}`") for c in kept]), rows, ", ".join([*fields, *[f"`{c}` {kinds[c]}" for c in added]]))


def round_trip_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a media column in the shared folder, read back from it and digested, for checks of whole corpora."""
    files = stored(store(docs, key, text), "media", compression="zstd")
    found = read(files, tensor=False)
    return found.select(
        key,
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
