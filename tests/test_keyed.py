"""Keyed tables of runs against dictionaries, and what batches write."""

import os
import random

import pytest
from pyspark.sql import functions as F

from panelwright.sources import keyed

SCHEMA = "k int, g int, at long, v string"


def size(path, names=None):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet") and (names is None or any(n in d for n in names)))


def rows(df):
    return sorted(map(tuple, df.select("k", "g", "at", "v").collect()), key=repr)


@pytest.mark.parametrize("order", [None, "at"])
@pytest.mark.parametrize("replace", [None, "g"])
def test_runs_are_a_dictionary(spark, tmp_path, order, replace):
    draw, root, held = random.Random(4), f"file://{tmp_path}/t", {}
    for batch in range(7):
        new = {}
        for i in range(40):
            k = draw.choice([None, *range(60)])
            row = (k, None if k is None else k % 9, draw.choice([None, draw.randrange(1000)]), f"{batch}-{i}")
            if k not in new or (order and (row[2] is not None, row[2] or 0, row) > (new[k][2] is not None, new[k][2] or 0, new[k])):
                new[k] = row
        if replace:
            groups = {r[1] for r in new.values()}
            held = {k: r for k, r in held.items() if r[1] not in groups}
        for k, r in new.items():
            if order is None or k not in held or (r[2] is not None, r[2] or 0) >= (held[k][2] is not None, held[k][2] or 0):
                held[k] = r
        keyed.write_upsert(spark.createDataFrame(list(new.values()), SCHEMA), root, ["k"], replace, order, fanout=2)
        assert rows(keyed.read_upserts(spark, root)) == sorted(held.values(), key=repr)
    state = keyed._state(spark, root, keyed.current_version(spark, root))
    levels = [r.level for r in state.runs]
    assert levels == sorted(levels, reverse=True) and len(levels) == len(set(levels)) == 3  # 7 batches, two runs a level


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    root, wrote = f"file://{tmp_path}/t", []
    for batch in range(12):
        before = size(f"{tmp_path}/t")
        start = 20_000 if batch == 0 else 200
        df = spark.range(start).select(((F.col("id") * 37 + batch * 11) % 20_000).cast("int").alias("k"), F.lit(0).alias("g"), F.lit(batch).cast("long").alias("at"), F.lit("x").alias("v"))
        keyed.write_upsert(df, root, ["k"], order="at", fanout=20)
        wrote.append(size(f"{tmp_path}/t") - before)
    assert max(wrote[1:]) < 0.3 * wrote[0] and max(wrote[1:]) < 1.5 * min(wrote[1:])
    found = keyed.read_upserts(spark, root)
    assert found.count() == 20_000 and found.filter("at = 11").count() == 200


def test_the_largest_run_is_not_shuffled(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    wide = spark.range(50_000).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("g"), F.lit(0).cast("long").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    keyed.write_upsert(wide, root, ["k"])
    keyed.write_upsert(wide.limit(10).withColumn("v", F.lit("new")), root, ["k"])
    found = keyed.read_upserts(spark, root)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    assert found.filter("v = 'new'").count() == 10 and found.count() == 50_000


def test_earlier_versions_and_other_options(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    one = spark.createDataFrame([(1, 1, 1, "a")], SCHEMA)
    with pytest.raises(FileNotFoundError):
        keyed.read_upserts(spark, root)
    first = keyed.write_upsert(one, root, ["k"])
    keyed.write_upsert(one.withColumn("v", F.lit("b")), root, ["k"])
    assert [r.v for r in keyed.read_upserts(spark, root, first).collect()] == ["a"]
    with pytest.raises(ValueError, match="keys"):
        keyed.write_upsert(one, root, ["k", "g"])
    with pytest.raises(ValueError, match="order"):
        keyed.write_upsert(one, root, ["k"], order="at")
