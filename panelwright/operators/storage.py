"""Tables between rounds of a loop: written once to the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made only where none is set and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="panelwright-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df evaluated once, its lineage cut at files that outlive executors and carry sizes for the planner."""
    path = f"{shared_root(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: Sequence[str], rows: int, n: int | None = None) -> DataFrame:
    """df dealt by keys to tasks of about `rows` rows each, so that a task's memory doesn't grow with df; n: its rows, if known."""
    n = df.count() if n is None else n
    few = min(df.sparkSession.sparkContext.defaultParallelism, -(-16 * n // rows))
    return df.repartition(max(1, few, -(-n // rows)), *keys)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once, unless their PYTHONPATH or working folder has it already."""
    root = str(Path(__file__).parents[2])
    if root in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) or getattr(spark.sparkContext, "_panelwright_sent", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='panelwright-')}/panelwright", "zip", root, "panelwright")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._panelwright_sent = True
