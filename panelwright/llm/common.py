"""What the training-data operators share: tables, shared folders, Arrow batches.

Every operator selects the columns it works on before it adds any of its own, so extra input
columns with clashing names never meet them.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch at most.
BATCH_BYTES = 1 << 22
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Columns of the documents table; every pipeline stage but the last returns these.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def unused(name: str, columns: Iterable[str]) -> str:
    """A column name that none of columns has or begins with: name after as many underscores as that takes."""
    own = f"_{name}"
    while any(c.lower().startswith(own.lower()) for c in columns):
        own = f"_{own}"
    return own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only if the session names none and runs on one machine."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="panelwright-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, partition_by: Iterable[str] = (), **options) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if a job has completed it, else build() written there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def open_shared(uri: str):
    """(pyarrow filesystem, path) of a URI or plain path, usable on any executor that mounts the store."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def file_bytes(uri: str) -> bytes:
    store, path = open_shared(uri)
    with store.open_input_file(path) as file:
        return file.read()


def sent_file(spark: SparkSession, uri: str) -> Broadcast:
    """The bytes of a file that the driver can read, for workers that need not: a tokenizer's vocabulary of a few megabytes."""
    return spark.sparkContext.broadcast(file_bytes(uri))


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once, unless their PYTHONPATH or working folder has it already."""
    root = str(Path(__file__).parents[2])
    if root in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) or getattr(spark.sparkContext, "_panelwright_sent", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='panelwright-')}/panelwright", "zip", root, "panelwright")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._panelwright_sent = True


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch.

    The session's batches are held to BATCH_BYTES from here on: what a worker and its executor hold at a time follows the
    bytes of texts, not their number. A longer text is a batch of its own.
    """
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get(_BATCH_BYTES, str(2 * BATCH_BYTES)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of all batches of a partition, one after another; they are held to BATCH_BYTES as in map_arrow."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get(_BATCH_BYTES, str(2 * BATCH_BYTES)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Python strings of a string column; null is the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def chunks(texts: list[str], most_chars: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about most_chars in all; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > most_chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)
