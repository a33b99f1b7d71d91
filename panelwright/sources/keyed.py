"""Tables of one row a key that batches are laid over: every batch writes its own rows, reading merges, levels are compacted.

A table is a list of runs, each a folder of rows with keys that don't repeat. A batch adds a run at level 0. When a level has
`fanout` runs they are merged into one run of the next, so a row is written again once a level and all runs but one are small.
Readers merge the small runs by key and lay them over the largest, which is filtered by a join with them: where they are small
enough to be broadcast, it isn't shuffled.

Lists of runs are numbered. One is added by a rename when its runs are complete; none is ever removed, so after a crash at any
step the last complete list still stands, and runs that no list names are left unread. Two writers at once get one number: the
second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.sets import single

FANOUT = 8


@dataclass(frozen=True)
class Run:
    """A folder of rows up to batch `batch`; rows of older runs whose group is in one of the `replaced` folders don't count."""

    name: str
    level: int
    batch: int
    replaced: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class State:
    """What a numbered list holds: runs from the oldest on."""

    keys: list[str]
    order: str | None
    group: str | None
    runs: list[Run]


def _versions(spark: SparkSession, root: str):
    return spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, root: str) -> int | None:
    """The number of root's last complete list of runs, or None."""
    fs, path = _versions(spark, root)
    found = [status.getPath().getName() for status in fs.globStatus(path(f"{root}/_current-*")) or []]
    return int(max(found).rpartition("-")[2]) if found else None


def _state(spark: SparkSession, root: str, number: int) -> State:
    kept = json.loads(spark.read.text(f"{root}/_current-{number:010d}").first()[0])
    return State(kept["keys"], kept["order"], kept["group"], [Run(**r) for r in kept["runs"]])


def _publish(spark: SparkSession, root: str, number: int, state: State) -> None:
    fs, path = _versions(spark, root)
    stage = f"{root}/_pointer-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(json.dumps(asdict(state))).alias("value")).coalesce(1).write.text(stage)
    pointer = path(f"{root}/_current-{number:010d}")
    if fs.exists(pointer) or not fs.rename(path(stage), pointer):
        raise RuntimeError(f"{root}: another writer has added version {number}")


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


def _last_rows(df: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """The row of each key that is the largest in order, then of the latest batch, then in its columns."""
    rest = [c for c in df.columns if c not in (*keys, "_batch")]
    place = [F.col(order).alias("_order")] if order else []
    last = df.groupBy(*keys).agg(F.max(F.struct(*place, "_batch", *rest)).alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def _laid_over(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """old, the larger side, with new's rows in place of those that they beat; it is joined as the streamed side alone."""
    a, b = old.alias("a"), new.alias("b")
    if order is None:
        return a.join(b, _same(keys), "left_anti").unionByName(new)
    place = lambda t: F.struct(F.col(f"{t}.{order}"), F.col(f"{t}._batch"))
    beaten = place("b") > place("a")
    kept = a.join(b, _same(keys) & beaten, "left_anti")
    lost = a.select(*keys, order, "_batch").alias("a").join(b, _same(keys) & ~beaten, "left_semi").select(*keys)
    return kept.unionByName(new.alias("a").join(lost.alias("b"), _same(keys), "left_anti"))


def _merged(spark: SparkSession, root: str, state: State, runs: Sequence[Run]) -> DataFrame:
    """The rows of consecutive runs that count, with their batch."""
    parts = []
    for i, run in enumerate(runs):
        rows = spark.read.parquet(f"{root}/{run.name}")
        gone = [name for later in runs[i + 1 :] for name in later.replaced]
        if gone:
            groups = spark.read.parquet(*[f"{root}/{name}" for name in gone]).distinct()
            rows = rows.alias("a").join(groups.alias("b"), _same([state.group]), "left_anti")
        parts.append(rows)
    top = max(range(len(runs)), key=lambda i: (runs[i].level, -i))
    small = [p for i, p in enumerate(parts) if i != top]
    if not small:
        return parts[top]
    deltas = _last_rows(reduce(DataFrame.unionByName, small), state.keys, state.order)
    return _laid_over(parts[top], deltas, state.keys, state.order)


def read_upserts(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table at root as of a version, the last one if none is given."""
    number = current_version(spark, root) if number is None else number
    if number is None:
        raise FileNotFoundError(f"{root} holds no complete version")
    state = _state(spark, root, number)
    return _merged(spark, root, state, state.runs).drop("_batch")


def write_upsert(new: DataFrame, root: str, keys: Sequence[str], replace: str | None = None, order: str | None = None, fanout: int = FANOUT) -> int:
    """new laid over the table at root, last write wins as in `upsert`; the new version's number.

    With a column `order` the row where it is largest wins, in whichever batch it came. Without, rows of new that repeat a key must
    be equal. With `replace`, existing rows of every group in new are dropped first. The batch writes its own rows, and may then
    compact levels that are full.
    """
    spark, batch = new.sparkSession, current_version(spark=new.sparkSession, root=root)
    state = _state(spark, root, batch) if batch is not None else State(list(keys), order, replace, [])
    if (state.keys, state.order) != (list(keys), order) or (replace and state.group not in (None, replace)):
        raise ValueError(f"{root} has keys {state.keys}, order {state.order} and groups {state.group}")
    number = 0 if batch is None else batch + 1
    rows = (single(new, keys) if order is None else new).withColumn("_batch", F.lit(number).cast("bigint"))
    run = Run(f"run-{uuid.uuid4().hex}", 0, number)
    _last_rows(rows, keys, order).write.parquet(f"{root}/{run.name}")
    if replace:
        groups = f"groups-{uuid.uuid4().hex}"
        spark.read.parquet(f"{root}/{run.name}").select(replace).distinct().write.parquet(f"{root}/{groups}")
        run = Run(run.name, 0, number, [groups])
    state = State(list(keys), order, replace or state.group, [*state.runs, run])
    _publish(spark, root, number, state)
    return _compacted(spark, root, number, state, fanout)


def _compacted(spark: SparkSession, root: str, number: int, state: State, fanout: int) -> int:
    """Merges every level that has fanout runs into one run of the next; the number of the last version."""
    level = 0
    while True:
        full = [r for r in state.runs if r.level == level]
        if len(full) < fanout:
            return number
        name = f"run-{uuid.uuid4().hex}"
        _merged(spark, root, state, full).write.parquet(f"{root}/{name}")
        run = Run(name, level + 1, full[-1].batch, [g for r in full for g in r.replaced])
        at = state.runs.index(full[0])  # the runs of a level are newer than those of the next, so they stand together
        state = State(state.keys, state.order, state.group, [*state.runs[:at], run, *state.runs[at + len(full) :]])
        number, level = number + 1, level + 1
        _publish(spark, root, number, state)
