"""Forests against a plain recursion with the same draws, over partitions, orders and folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import forest as X
from panelwright.operators import forecast as M

FEATURES = ["a", "b", "c", "d"]


def rows_of(n=240, seed=3):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = draw.random(), draw.choice([0.0, 1.0, 2.0]), draw.gauss(0, 1)
        out.append((i, 2000 + i % 4, a if draw.random() > 0.1 else None, b, c if draw.random() > 0.05 else float("nan"), 7.0, 3 * a + b + draw.gauss(0, 0.2)))
    return out


SCHEMA = "id int, period int, a double, b double, c double, d double, y double"


def plain(forest, keys, x, y, fold, tree, least):
    """{node: (feature, cut, mean)} of one tree, grown node by node."""
    weights = X.bootstrap_weights(keys, np.array([tree]), forest.seed)[:, 0]
    binned, units = forest.binned(x, fold), np.rint((y - forest.low[fold]) / forest.span[fold] * X.UNITS)
    found = {}

    def grow(node, at, level):
        n, s = weights[at].sum(), (weights[at] * units[at]).sum()
        if not n:
            return
        best = None
        if level < forest.depth:
            for feature in forest.candidates(np.array([tree]), np.array([node]))[0, 0]:
                for cut in range(forest.bins - 1):
                    left = at[binned[at, feature] <= cut]
                    ln, ls = weights[left].sum(), (weights[left] * units[left]).sum()
                    if ln >= least and n - ln >= least:
                        gain = ls**2 / ln + (s - ls) ** 2 / (n - ln)
                        if best is None or gain > best[0]:
                            best = (gain, feature, cut)
            if best is not None and best[0] <= s**2 / n * (1 + 1e-12) + 1e-6:
                best = None
        found[node] = (int(best[1]) if best else -1, best[2] if best else 0, forest.low[fold] + s / n / X.UNITS * forest.span[fold])
        if best:
            right = binned[at, best[1]] > best[2]
            grow(2 * node, at[~right], level + 1)
            grow(2 * node + 1, at[right], level + 1)

    grow(1, np.arange(len(y)), 0)
    return found


def test_trees_are_those_of_a_plain_recursion(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    prepared = X.prepared(df, FEATURES, "y", "period", ["id"])
    forest = X.grow(prepared, [2000, 2002, 2003], FEATURES, trees=5, depth=5, bins=16)
    assert forest.folds.tolist() == [2002, 2003]  # nothing is earlier than 2000
    kept = prepared.collect()
    for fold, period in enumerate(forest.folds):
        past = [r for r in kept if r.period < period]
        keys, x, y = np.array([r.key for r in past]), np.array([r.x for r in past]), np.array([r.y for r in past])
        assert np.allclose(forest.means[fold], np.nanmean(x, axis=0))
        for tree in range(5):
            want = plain(forest, keys, x, y, fold, tree, 3)
            assert len(want) > 8
            for node, (feature, cut, mean) in want.items():
                assert (forest.split[fold, tree, node], forest.value[fold, tree, node]) == (feature, pytest.approx(mean, abs=1e-9))
                assert feature < 0 or forest.cut[fold, tree, node] == cut
            assert set(np.flatnonzero(forest.split[fold, tree] >= 0)) == {n for n, (f, _, _) in want.items() if f >= 0}


@pytest.mark.parametrize("task_rows", [X.TASK_ROWS, 50])
def test_forests_are_a_function_of_their_rows(spark, monkeypatch, task_rows):
    monkeypatch.setattr(X, "TASK_ROWS", task_rows)
    rows = rows_of()
    found = []
    for n, seed in ((1, None), (3, 1), (8, 2)):
        own = rows[:]
        if seed:
            random.Random(seed).shuffle(own)
        df = spark.createDataFrame(own, SCHEMA).repartition(n)
        kept = M.forest_backtest(df, FEATURES, "y", "period", [2001, 2002, 2003], ["id"], trees=12)
        found.append(sorted((r.id, r.predicted) for r in kept.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 180


def test_folds_learn_from_earlier_periods_alone(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    later = df.withColumns({c: F.when(F.col("period") >= 2003, F.lit(1e6)).otherwise(F.col(c)) for c in ("y", "a")})
    run = lambda d: sorted((r.id, r.predicted) for r in M.forest_backtest(d, FEATURES, "y", "period", [2002, 2003], ["id"], trees=6).filter("period = 2002").collect())
    assert run(df) == run(later)


def test_forests_learn(spark):
    df = spark.createDataFrame(rows_of(1200, 8), SCHEMA)
    found = M.forest_backtest(df, FEATURES, "y", "period", [2003], ["id"], trees=40).toPandas()
    assert ((found.predicted - found.y) ** 2).mean() < 0.2 * found.y.var()


def test_forests_of_odd_rows(spark):
    same = spark.createDataFrame([(i, 0, 1.0, 1.0) for i in range(20)], "k int, p int, x double, y double")
    assert {r.predicted for r in M.forest_forecast(same, same, ["x"], "y", trees=3, keys=["k"]).collect()} == {1.0}
    none = same.filter("k < 0")
    assert M.forest_forecast(same, none, ["x"], "y", trees=3).count() == 0
    assert {r.predicted for r in M.forest_forecast(none, same, ["x"], "y", trees=3).collect()} == {None}
    unknown = same.withColumn("y", F.lit(None).cast("double"))
    assert {r.predicted for r in M.forest_forecast(unknown, same, ["x"], "y", trees=3).collect()} == {None}
