"""All models of a coming period side by side, intervals from named residuals, typicality of bounds."""

import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import forecast as M


def panel(spark):
    draw = random.Random(3)
    rows = [(e, e % 3, p, 10.0 + e + draw.random(), 20 + e, 1000.0) for e in range(1, 25) for p in range(2000, 2007) if not (e == 5 and p == 2006)]
    return spark.createDataFrame(rows, "entity int, grp int, period int, rate double, cases int, denom double")


def test_models_stand_side_by_side_and_see_no_target(spark):
    df = panel(spark)
    edges = spark.createDataFrame([(a, b) for a in range(1, 24) for b in (a + 1,)] + [(a + 1, a) for a in range(1, 24)], "src int, dst int")
    found = M.annual_forecast_models(df, "entity", "grp", "period", "rate", "cases", "denom", 2007, edges=edges)
    rows = {(r.entity, r.model): r.predicted for r in found.collect()}
    models = {m for _, m in rows}
    assert models == {*M.MODELS, "empirical_bayes", "analog", "ridge", "ridge_spatial", "top4_ensemble"}
    assert {e for e, _ in rows} == set(range(1, 25)) - {5} and len(rows) == 23 * len(models)
    last = {r.entity: r.rate for r in df.filter("period = 2006").collect()}
    for e in last:
        assert rows[e, "prior_year"] == last[e]
        want = (rows[e, "prior_year"] + rows[e, "linear_blend"] + rows[e, "ridge"] + rows[e, "ridge_spatial"]) / 4
        assert rows[e, "top4_ensemble"] == pytest.approx(want)
        assert abs(rows[e, "ridge"] - last[e]) < 3 and abs(rows[e, "analog"] - last[e]) < 4
    closed = {(r.entity, r.model): r.predicted for r in M.annual_forecast(df, "entity", "grp", "period", "rate", 2007, 3, 2).collect()}
    assert {k: v for k, v in rows.items() if k[1] in M.MODELS} == pytest.approx(closed)
    # Rows at or after the target change nothing.
    later = df.unionByName(df.filter("period = 2006").withColumns({"period": F.lit(2009), "rate": F.lit(1e6)}))
    again = M.annual_forecast_models(later.filter("period < 2007"), "entity", "grp", "period", "rate", "cases", "denom", 2007, edges=edges)
    assert {(r.entity, r.model): r.predicted for r in again.collect()} == pytest.approx(rows)
    assert "ridge_spatial" not in {r.model for r in M.annual_forecast_models(df, "entity", "grp", "period", "rate", "cases", "denom", 2007).select("model").distinct().collect()}


def test_intervals_take_residuals_of_another_name_and_refuse_mixed_ones(spark):
    residuals = spark.createDataFrame([("prior", 2000 + i % 4, "a", float(i), 0.0) for i in range(40)] + [("mixed", 2000, b, 1.0, 0.0) for b in "ab"], "model string, period int, how string, actual double, predicted double")
    forecasts = spark.createDataFrame([("latest", 100.0), ("other", 5.0)], "model string, predicted double")
    found = M.residual_intervals(forecasts, residuals, "period", 2003, 10, {"latest": "prior"}).collect()
    assert [(r.model, r.n_residuals, r.center) for r in found] == [("latest", 40, 119.5)]
    with pytest.raises(M.MixedResiduals, match="other"):
        M.residual_intervals(forecasts, residuals, "period", 2003, 10, {"latest": "prior"}, strict=True)
    with pytest.raises(M.MixedResiduals, match="mixed"):
        M.residual_intervals(forecasts, residuals, "period", 2003, 10, {"latest": "prior"}, ["how"])
    assert M.residual_intervals(forecasts, residuals.filter("model = 'prior'"), "period", 2003, 10, {"latest": "prior"}, ["how"]).count() == 1


def test_labels_of_intervals(spark):
    history = spark.createDataFrame([(1, float(i)) for i in range(1, 11)], "entity int, rate double")
    forecasts = spark.createDataFrame([(1, 5.0, 0.5, 10.5), (1, 5.0, 4.5, 5.5), (2, 1.0, 0.0, 2.0)], "entity int, rate double, low double, high double")
    got = sorted((r.entity, r.low, r.low_percentile, r.high_percentile, r.interval_severity, r.severity) for r in M.interval_typicality(forecasts, history, "entity", "rate", "low", "high", 3).collect())
    assert got == [(1, 0.5, 0.0, 100.0, "very low to very high", "typical"), (1, 4.5, 40.0, 50.0, "typical", "typical"), (2, 0.0, None, None, None, None)]
