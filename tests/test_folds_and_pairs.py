"""Pairs with shared keys against counting all, and ridge folds against one fit a fold."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import forecast as M
from panelwright.operators import joins as J


def baskets(n=120, seed=2):
    """Entities with some of 400 keys; every second has key 0, some are alike, one has very many keys."""
    draw = random.Random(seed)
    held = {e: set(draw.sample(range(1, 400), draw.randrange(0, 14))) | ({0} if e % 2 else set()) for e in range(n)}
    for e in range(0, n - 3, 10):
        held[e] = set(held[e + 3])
    held[7] = set(range(300))
    return {e: ks for e, ks in held.items() if ks}


@pytest.mark.parametrize("least", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("block", [5, 1000])
def test_pairs_are_those_of_counting_all(spark, least, block):
    held = baskets()
    df = spark.createDataFrame([(e, k) for e, ks in held.items() for k in ks for _ in range(1 + (k == 0))], "e int, k int")
    want = sorted((a, b, len(held[a] & held[b])) for a, b in itertools.combinations(sorted(held), 2) if len(held[a] & held[b]) >= least)
    assert sorted(map(tuple, J.self_pairs(df, "e", "k", least, block).select("a", "b", "shared").collect())) == want


def test_prefixes_make_few_candidates_of_a_crowded_key(spark, monkeypatch):
    n = 3000
    own = spark.range(n).select(F.col("id").alias("e"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i")).select("e", (F.xxhash64((F.col("e") / 2).cast("int"), "i")).alias("k"))
    df = own.unionByName(spark.range(0, n, 2).select(F.col("id").alias("e"), F.lit(0).cast("long").alias("k")))  # half have key 0
    df = df.unionByName(spark.range(0, n, 3).select(F.col("id").alias("e"), F.lit(1).cast("long").alias("k")))
    candidates, whole = [], J._met_pairs

    def counted(pairs, block):
        met = whole(pairs, block)
        candidates.append(met.distinct().count())
        return met

    monkeypatch.setattr(J, "_met_pairs", counted)
    found = {(r.a, r.b): r.shared for r in J.self_pairs(df, "e", "k", 3).collect()}
    assert {p for p, s in found.items()} == {(2 * i, 2 * i + 1) for i in range(n // 2)}
    assert candidates == [n // 2]  # of over a million pairs that share key 0


def panel(spark, seed=5):
    draw = random.Random(seed)
    rows = [(e, p, draw.gauss(0, 1), draw.choice([None, 1.0, 5.0]), float(p > 2003), draw.gauss(2, 1)) for e in range(60) for p in range(2000, 2006)]
    return spark.createDataFrame(rows, "e int, p int, x double, y double, late double, t double").withColumn("t", F.col("t") + 3 * F.col("x"))


@pytest.mark.parametrize("most", [M.SUMS_OF_PRODUCTS, 2])
def test_folds_of_one_scan_equal_a_fit_a_fold(spark, monkeypatch, most):
    df = panel(spark).fillna(0.0)
    features, tests = ["x", "y", "late"], [2000, 2002, 2003, 2004, 2005]
    want = {}
    for test in tests[1:]:
        fit = M.ridge_fit(df.filter(F.col("p") < test), features, "t", 1.0)
        want |= {(r.e, r.p): r.v for r in df.filter(F.col("p") == test).select("e", "p", M.ridge_predict(fit).alias("v")).collect()}
    monkeypatch.setattr(M, "SUMS_OF_PRODUCTS", most)
    found = M.ridge_backtest(df, features, "t", "p", tests, 1.0, ["e", "p"]).collect()
    assert len(found) == len(want) == 240 and all(abs(want[r.e, r.p] - r.predicted) < 1e-9 for r in found)


def test_running_sums_are_the_sums_of_earlier_rows(spark):
    df = panel(spark)
    by_period = M.grams(df, ["x", "y"], "t", "p")
    matrix, vector = M.gram(df.filter("p < 2003"), ["x", "y"], "t")
    assert np.allclose(sum(by_period[p][0] for p in (2000, 2001, 2002)), matrix) and np.allclose(sum(by_period[p][1] for p in (2000, 2001, 2002)), vector)


def test_one_job_whatever_the_number_of_folds(spark):
    df = panel(spark).fillna(0.0).cache()
    df.count()

    def jobs(tests):
        name = f"folds-{len(tests)}"
        spark.sparkContext.setJobGroup(name, name)
        M.ridge_backtest(df, ["x", "y"], "t", "p", tests, 1.0, ["e", "p"]).collect()
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs([2005]) == jobs([2001, 2002, 2003, 2004, 2005])
    df.unpersist()
