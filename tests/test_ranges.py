"""Ranks and quantiles in ranges against those of one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import windows as W


@pytest.fixture
def whole_partitions(spark):
    """Small ranges stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, n=900):
    draw = random.Random(6)
    data = [(draw.choice(["x", "y", None]), i, draw.choice([None, 1.5, draw.randrange(5) / 2, draw.gauss(0, 9)])) for i in range(n)] + [("one", i, 7.0) for i in range(400)]
    return spark.createDataFrame(data, "g string, e int, v double").repartition(5)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)


def test_ranks_and_tiers_in_ranges(spark, whole_partitions):
    df = rows(spark)
    same(W.numbered(df, ["g"], "v", "e", "n", large=10), W.numbered(df, ["g"], "v", "e", "n"))
    same(W.rank_tier(df, ["g"], "v", "e", large=10), W.rank_tier(df, ["g"], "v", "e"))


def test_one_repeated_value_is_ranked_by_several_tasks(spark, whole_partitions):
    hot = spark.range(20_000).select(F.lit(1).alias("g"), F.lit(3.0).alias("v"), F.col("id").alias("e")).repartition(4)
    ranges = W.in_ranges(hot, ["g"], [F.col("v").desc_nulls_last(), F.col("e").asc()]).groupBy("_range").count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 15_000
    found = W.numbered(hot, ["g"], "v", "e", "n", large=100)
    assert found.filter("n <> e + 1").isEmpty() and found.count() == 20_000


@pytest.mark.parametrize("large", [W.LARGE, 10])
def test_quantiles_are_exact(spark, monkeypatch, whole_partitions, large):
    monkeypatch.setattr(W.running, "__defaults__", (None, large))
    df = rows(spark)
    ps = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.9, "e": 1.0}
    held = {}
    for r in df.collect():
        if r.v is not None:
            held.setdefault(r.g, []).append(r.v)
    linear = {r.g: r for r in W.quantile_linear(df, ["g"], "v", ps, "n").collect()}
    nearest = {r.g: r for r in W.quantile_nearest(df, ["g"], "v", ps).collect()}
    assert set(linear) == set(held) == set(nearest)
    for g, values in held.items():
        values.sort()
        assert linear[g].n == len(values)
        for name, p in ps.items():
            assert linear[g][name] == pytest.approx(float(np.quantile(values, p)), abs=1e-9)
            assert nearest[g][name] == values[max(1, int(np.ceil(round(len(values) * p, 9)))) - 1]
