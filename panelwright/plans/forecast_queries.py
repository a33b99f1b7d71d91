"""Queries of design matrices, forecasts, backtests, intervals and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import aggregates as A
from panelwright.operators import features as X
from panelwright.operators import forecast as M
from panelwright.operators import joins as J
from panelwright.operators import panel_models as P
from panelwright.operators.storage import settled
from panelwright.plans.base import query
from panelwright.plans.join_queries import _ANALOGS, _EDGES, analogs, edges
from panelwright.plans.views import SQL, Tables
from panelwright.plans.window_queries import R6, _rounded

# The backtest of the closed-form models as SQL; every later query of predictions builds on it.
_B = """h AS (SELECT grp, period, avg(rate) AS r FROM rates GROUP BY 1, 2),
tm AS (SELECT grp, period, CASE WHEN avg(r) OVER w > 0 THEN last_value(r) OVER w / avg(r) OVER w ELSE 1 END AS multiplier FROM h WINDOW w AS (PARTITION BY grp ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
b0 AS (SELECT grp, entity, period, rate, max(rate) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prior_year, avg(rate) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS trailing_mean,
  count(rate) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_history FROM rates),
b AS (SELECT b0.*, trailing_mean * multiplier AS trend_adjusted, (coalesce(prior_year, trailing_mean) + trailing_mean) / 2 AS linear_blend FROM b0 JOIN tm USING (grp, period)),
long AS (UNPIVOT (SELECT grp, entity, period, n_history, rate AS actual, prior_year, trailing_mean, trend_adjusted, linear_blend FROM b) ON prior_year, trailing_mean, trend_adjusted, linear_blend INTO NAME model VALUE raw),
preds AS (SELECT grp, entity, period, actual, model, greatest(raw, 0) AS predicted FROM long WHERE n_history >= 2)"""
_REGIME = "CASE WHEN grp % 3 = 0 THEN 'a' ELSE 'b' END"


def _base(t: Tables):
    return M.baselines(t.rates(), "entity", "grp", "period", "rate", 3)


def _preds(t: Tables):
    return M.backtest(_base(t), M.MODELS, ["grp", "entity", "period"], "rate", F.lit(True), 2)


def _regimes(t: Tables):
    return _preds(t).withColumn("regime", F.when(F.col("grp") % 3 == 0, "a").otherwise("b"))


@query(f"WITH {_B} SELECT entity, period, round(prior_year, 6) AS prior_year, round(trailing_mean, 6) AS trailing_mean, round(trend_adjusted, 6) AS trend_adjusted, round(linear_blend, 6) AS linear_blend, n_history FROM b", "rates")
def q143_baseline_forecasts(t: Tables):
    return _rounded(_base(t), *M.MODELS).select("entity", "period", *M.MODELS, "n_history")


@query(f"WITH {_B} SELECT entity, period, model, actual, round(predicted, 6) AS predicted, round(predicted - actual, 6) AS residual, round(abs(predicted - actual), 6) AS absolute_error FROM preds", "rates")
def q144_rolling_origin_backtest(t: Tables):
    return _rounded(_preds(t), "predicted", "residual", "absolute_error").drop("grp")


@query("""WITH s AS (SELECT grp, period, sum(rate) AS s, count(rate) AS n FROM rates GROUP BY 1, 2), e AS (SELECT period, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1),
g AS (SELECT grp, period, sum(s) OVER w / sum(n) OVER w AS gm FROM s WINDOW w AS (PARTITION BY grp ORDER BY period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)), a AS (SELECT period, sum(s) OVER w / sum(n) OVER w AS am FROM e WINDOW w AS (ORDER BY period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)),
o AS (SELECT entity, grp, period, avg(rate) OVER w AS m, count(rate) OVER w AS n FROM rates WINDOW w AS (PARTITION BY entity ORDER BY period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT entity, o.period, round((n * coalesce(m, 0) + 5 * gm) / (n + 5), 6) AS eb_group, round((n * coalesce(m, 0) + 5 * am) / (n + 5), 6) AS eb_all FROM o JOIN g ON g.grp = o.grp AND g.period = o.period JOIN a ON a.period = o.period""", "rates")
def q145_empirical_bayes_forecast(t: Tables):
    return _rounded(M.empirical_bayes(t.rates(), "entity", "grp", "period", "rate", 4, 5.0), "eb_group", "eb_all").select("entity", "period", "eb_group", "eb_all")


@query("""WITH g AS (SELECT grp, period, sum(cases) AS total, count(*) AS m FROM panel_gappy GROUP BY 1, 2), p AS (SELECT grp, period, m, sum(total) OVER (PARTITION BY grp ORDER BY period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING) AS past, max(total) OVER (PARTITION BY grp ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS last FROM g),
o AS (SELECT entity, grp, period, coalesce(sum(cases) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS own FROM panel_gappy)
SELECT entity, period, round(CASE WHEN past > 0 THEN own / past END * last, 6) AS share_forecast, round((own + 10.0 / m) / (coalesce(past, 0) + 10) * last, 6) AS shrunk_share_forecast FROM o JOIN p USING (grp, period)""", "panel_gappy")
def q146_capacity_share_forecast(t: Tables):
    found = M.capacity_share(t.panel_gappy(), "entity", "grp", "period", "cases", 4, 10.0)
    return _rounded(found, "share_forecast", "shrunk_share_forecast").select("entity", "period", "share_forecast", "shrunk_share_forecast")


def _matrix(t: Tables):
    return X.design_matrix(t.rates(), "entity", "grp", "period", "rate", "cases", "denom", ["cases"], ["grp"], 3)


@query("""WITH g AS (SELECT grp, period, sum(cases) / sum(denom) AS r FROM panel_gappy GROUP BY 1, 2), o AS (SELECT entity, grp, period, rate, cases, max(rate) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p, avg(rate) OVER w AS m, count(rate) OVER w AS n FROM rates WINDOW w AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT entity, o.period, rate AS target_rate, coalesce(p, 0) AS feature_prior_rate, (p IS NULL)::INT::DOUBLE AS feature_missing_prior_rate, round(m, 6) AS feature_trailing_mean, round(coalesce(g.r, 0), 8) AS feature_prior_group_rate, cases::DOUBLE AS feature_cases, (o.grp = 7)::INT::DOUBLE AS feature_grp_7
FROM o LEFT JOIN g ON g.grp = o.grp AND g.period + 1 = o.period WHERE n > 0""", "rates")
def q135_build_design_matrix(t: Tables):
    found = _rounded(_matrix(t)[0], "feature_trailing_mean").withColumn("feature_prior_group_rate", F.round("feature_prior_group_rate", 8))
    if "feature_grp_7" not in found.columns:  # columns follow the observed categories
        found = found.withColumn("feature_grp_7", F.lit(0.0))
    return found.select("entity", "period", "target_rate", "feature_prior_rate", "feature_missing_prior_rate", "feature_trailing_mean", "feature_prior_group_rate", "feature_cases", "feature_grp_7")


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS feature_o_orderstatus_F, (o_orderstatus = 'O')::INT::DOUBLE AS feature_o_orderstatus_O, (o_orderstatus = 'P')::INT::DOUBLE AS feature_o_orderstatus_P FROM orders")
def q136_one_hot_observed(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return X.one_hot(rows, "o_orderstatus", X.categories(rows, "o_orderstatus")).drop("o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, (l_discount > 0.05)::INT::DOUBLE AS feature_flag_deep, (l_tax < 0.02)::INT::DOUBLE AS feature_flag_low_tax FROM lineitem")
def q137_flag_indicators(t: Tables):
    flags = F.concat_ws(",", F.when(F.col("l_discount") > 0.05, "deep"), F.when(F.col("l_tax") < 0.02, "low_tax"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", flags.alias("flags"))
    return X.flag_indicators(rows, "flags", X.observed_flags(rows, "flags")).drop("flags")


@query("""SELECT l_orderkey, l_linenumber, ((l_quantity > 10)::INT + (l_tax > 0)::INT + 1)::INT AS n, round((CASE WHEN l_quantity > 10 THEN l_quantity / 50 ELSE 0 END + CASE WHEN l_tax > 0 THEN l_tax * 10 ELSE 0 END + l_discount * 10) / ((l_quantity > 10)::INT + (l_tax > 0)::INT + 1) * 100, 6) AS index FROM lineitem""")
def q138_composite_index(t: Tables):
    index, n = X.composite_index([F.when(F.col("l_quantity") > 10, F.col("l_quantity") / 50), F.when(F.col("l_tax") > 0, F.col("l_tax") * 10), F.col("l_discount") * 10])
    return t.lineitem.select("l_orderkey", "l_linenumber", n.alias("n"), R6(index).alias("index"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS z_l_quantity FROM lineitem")
def q139_standardize(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return _rounded(X.standardized(rows, X.moments(rows, ["l_quantity"])), "z_l_quantity").drop("l_quantity")


@query("SELECT 'l_quantity' AS \"column\" UNION ALL SELECT 'l_tax'")
def q140_select_varying_columns(t: Tables):
    rows = t.lineitem.withColumn("constant", F.lit(1.0))
    return t.spark.createDataFrame([(c,) for c in X.varying(rows, ["l_quantity", "constant", "l_tax"])], "column string")


@query("""WITH l AS (SELECT entity, max(period) AS p FROM rates GROUP BY 1 HAVING max(period) = 2001), r AS (SELECT entity, rate, period, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS n FROM rates JOIN l USING (entity))
SELECT r.entity, max(rate) FILTER (WHERE n = 1) AS prior_rate, round(avg(rate) FILTER (WHERE n <= 3), 6) AS trailing_mean, any_value(s_acctbal) AS denominator FROM r JOIN supplier ON s_suppkey = r.entity GROUP BY 1""", "rates")
def q141_project_design_rows(t: Tables):
    side = t.supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("denominator"))
    found = X.project_rows(t.rates(), "entity", "grp", "period", "rate", 2002, 3, side)
    return _rounded(found, "trailing_mean").select("entity", "prior_rate", "trailing_mean", "denominator")


def _test_periods(matrix) -> list[int]:
    """Every period of a design matrix that has at least two before it."""
    return sorted(r[0] for r in matrix.select("period").distinct().collect())[2:]


@query()
def q147_ridge_fit_predict(t: Tables):
    matrix, schema = _matrix(t)
    matrix = settled(matrix)
    return _rounded(M.ridge_backtest(matrix, schema.features, "target_rate", "period", _test_periods(matrix), 1.0, ["entity", "period"]), "predicted")


@query()
def q148_random_forest_forecast(t: Tables):
    matrix, schema = _matrix(t)
    matrix = settled(matrix)
    found = M.forest_backtest(matrix, schema.features, "target_rate", "period", _test_periods(matrix), ["entity", "period"])
    return found.select("entity", "period", "target_rate", R6("predicted").alias("predicted"))


def _analogs(t: Tables):
    return M.weighted_analogs(analogs(t), "fold")


@query(f"WITH {_ANALOGS} SELECT fold, test_id, round(sum(outcome / (distance + 1e-9)) / sum(1 / (distance + 1e-9)), 4) AS predicted FROM r WHERE rank <= 5 GROUP BY 1, 2", "panel_supplier")
def q149_analog_forecast(t: Tables):
    return _analogs(t).select("fold", "test_id", F.round("predicted", 4).alias("predicted"))


@query()
def q158_weighted_bootstrap_intervals(t: Tables):
    found = M.bootstrap_intervals(_analogs(t), ["fold", "test_id"])
    return _rounded(found.drop("analogs"), "predicted", "lower_95", "lower_80", "upper_80", "upper_95")


@query("""WITH tr AS (SELECT * FROM (SELECT entity, period, rate, avg(rate) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS m FROM rates) WHERE m IS NOT NULL),
p AS (SELECT a.entity, a.period, l.rate AS analog_forecast, o.period AS analog_period, round(abs(a.rate - o.rate) + abs(a.m - o.m), 9) AS distance FROM tr a JOIN tr o ON a.entity = o.entity AND o.period + 1 <= a.period JOIN rates l ON l.entity = o.entity AND l.period = o.period + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY distance, analog_period DESC) AS n FROM p) SELECT entity, period, analog_forecast, analog_period, round(distance, 6) AS distance FROM r WHERE n = 1""", "rates")
def q150_analog_own_history(t: Tables):
    return _rounded(M.own_history_analog(t.rates(), "entity", "period", "rate", 2), "distance")


@query(f"""WITH {_EDGES} SELECT a.entity, a.period, round(avg(b.rate), 6) AS predicted, count(b.rate) AS n FROM rates a LEFT JOIN edges ON src = a.entity LEFT JOIN rates b ON b.entity = dst AND b.period + 1 = a.period GROUP BY 1, 2""", "rates")
def q151_neighbor_forecast(t: Tables):
    found = J.neighbor_summary(t.rates(), edges(t), "entity", "period", "rate", 1)
    return found.select("entity", "period", R6("neighbor_mean").alias("predicted"), F.col("neighbor_n").alias("n"))


@query(f"WITH {_B} SELECT entity, period, round(avg(predicted), 6) AS predicted FROM preds WHERE model IN ('trailing_mean', 'trend_adjusted') GROUP BY 1, 2 HAVING count(*) = 2", "rates")
def q152_ensemble_mean(t: Tables):
    found = M.ensemble(_preds(t), ["trailing_mean", "trend_adjusted"], ["grp", "entity", "period"], "ensemble")
    return found.filter("model = 'ensemble'").select("entity", "period", R6("predicted").alias("predicted"))


_FUTURE = """w AS (SELECT grp, entity, period, rate FROM rates UNION ALL SELECT max_by(grp, period), entity, 2002, NULL FROM rates GROUP BY entity HAVING max(period) = 2001), h AS (SELECT grp, period, avg(rate) AS r FROM w GROUP BY 1, 2),
tm AS (SELECT grp, period, CASE WHEN avg(r) OVER x > 0 THEN last_value(r) OVER x / avg(r) OVER x ELSE 1 END AS multiplier FROM h WINDOW x AS (PARTITION BY grp ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
b0 AS (SELECT grp, entity, period, max(rate) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prior_year, avg(rate) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS trailing_mean,
  count(rate) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_history FROM w),
b AS (SELECT b0.*, trailing_mean * multiplier AS trend_adjusted, (coalesce(prior_year, trailing_mean) + trailing_mean) / 2 AS linear_blend FROM b0 JOIN tm USING (grp, period) WHERE b0.period = 2002 AND n_history >= 2),
future AS (UNPIVOT (SELECT entity, grp, n_history, prior_year, trailing_mean, trend_adjusted, linear_blend FROM b) ON prior_year, trailing_mean, trend_adjusted, linear_blend INTO NAME model VALUE predicted)"""


def _future(t: Tables):
    return M.annual_forecast(t.rates(), "entity", "grp", "period", "rate", 2002, 3, 2)


@query(f"WITH {_FUTURE} SELECT entity, model, round(predicted, 6) AS predicted, 2001::INT AS origin, 'forecast' AS update_mode FROM future", "rates")
def q153_annual_forecast(t: Tables):
    return _future(t).select("entity", "model", R6("predicted").alias("predicted"), "origin", "update_mode")


@query()
def q153_annual_forecast_models(t: Tables):
    """Nine models of the period after the last one, side by side; ridge and ensemble are beyond SQL, the baselines are those of q153."""
    rows = settled(t.rates())
    target = rows.agg(F.max("period")).first()[0] + 1
    found = M.annual_forecast_models(rows, "entity", "grp", "period", "rate", "cases", "denom", target, edges=edges(t))
    return _rounded(found, "predicted").drop("grp")


# Regimes and rate models as SQL: g asks for a row of every entity and period from first to last; windows see earlier periods.
def _sig(first: str, last: str, src: str = "rates") -> str:
    return f"""g AS (SELECT entity, grp, unnest(range({first}, {last} + 1))::INT AS period FROM (SELECT DISTINCT entity, grp FROM {src})),
asked AS (SELECT g.entity, g.grp, g.period, rate FROM g LEFT JOIN {src} s USING (entity, period) UNION ALL SELECT entity, grp, period, rate FROM {src} WHERE period < {first} OR period > {last}),
sig0 AS (SELECT entity, grp, period, rate, avg(rate) OVER w AS h_mean, count(rate) OVER w AS h_n, max(rate) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS h_prior,
  last_value(rate IGNORE NULLS) OVER w - first_value(rate IGNORE NULLS) OVER w AS h_trend FROM asked WINDOW w AS (PARTITION BY entity ORDER BY period RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)),
sig AS (SELECT * FROM sig0 WHERE h_n >= 2 AND h_prior IS NOT NULL AND period BETWEEN {first} AND {last})"""


_REGIMES = f"""{_EDGES}, near AS (SELECT a.period, src, dst FROM edges JOIN sig a ON a.entity = src JOIN sig b ON b.entity = dst AND b.period = a.period WHERE abs(a.h_mean - b.h_mean) <= 2 AND abs(a.h_prior - b.h_prior) <= 4 AND abs(a.h_trend - b.h_trend) <= 5),
reach AS (SELECT period, entity AS node, entity AS other FROM sig UNION SELECT r.period, r.node, n.dst FROM reach r JOIN near n ON n.period = r.period AND n.src = r.other),
comp AS (SELECT period, node, min(other) AS component FROM reach GROUP BY 1, 2), stats AS (SELECT c.period, component, avg(h_mean) AS regime_mean, avg(h_prior) AS regime_prior, min(h_mean) AS regime_min, max(h_mean) AS regime_max, stddev_pop(h_mean) AS regime_sd, count(*) AS members
  FROM comp c JOIN sig ON sig.entity = node AND sig.period = c.period GROUP BY 1, 2), regimes AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY round(regime_mean + 1e-9, 6), component) AS regime FROM stats)"""
_SAME = {"h_mean": 2, "h_prior": 4, "h_trend": 5}


def _regime_rows(links, rows, first: int, last: int):
    return P.spatial_regimes(rows, links, "entity", "grp", "period", "rate", 3, 2, _SAME, first, last)


#: Every period but the first: the folds of tests and the periods of regimes, which see earlier periods alone.
_FIRST, _LAST = "(SELECT min(period) + 1 FROM rates)", "(SELECT max(period) FROM rates)"
_COMING = "(SELECT max(period) + 1 FROM rates)"


def _rates_and_folds(t: Tables):
    """The panel, written once, and its second and last period."""
    rows = settled(t.rates())
    ends = rows.agg(F.min("period"), F.max("period")).first()
    return rows, ends[0] + 1, ends[1]


def _models_sql(src: str, horizon: str) -> str:
    """m: the rows of sig with a column for each rate model, from asked rows."""
    return f"""s AS (SELECT grp, period, sum(rate) AS s, count(rate) AS n FROM asked GROUP BY 1, 2), e AS (SELECT period, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1),
gm AS (SELECT grp, period, sum(s) OVER w / sum(n) OVER w AS group_mean FROM s WINDOW w AS (PARTITION BY grp ORDER BY period RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)),
am AS (SELECT period, sum(s) OVER w / sum(n) OVER w AS all_mean FROM e WINDOW w AS (ORDER BY period RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)),
marks AS (SELECT * FROM (SELECT entity, period, rate AS v, avg(rate) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM asked) WHERE v IS NOT NULL),
cand AS (SELECT a.entity, a.period + 1 AS period, l.v AS analog, row_number() OVER (PARTITION BY a.entity, a.period ORDER BY round(abs(a.v - o.v) + abs(a.m - o.m), 9), o.period DESC) AS r
  FROM marks a JOIN marks o ON o.entity = a.entity AND o.period < a.period JOIN marks l ON l.entity = o.entity AND l.period = o.period + {horizon} AND l.period <= a.period),
nb AS (SELECT src AS entity, period + 1 AS period, avg(rate) AS neighbor FROM edges JOIN {src} ON entity = dst WHERE rate IS NOT NULL GROUP BY 1, 2),
m AS (SELECT sig.entity, sig.grp, sig.period, sig.rate AS actual, h_prior AS latest, h_mean AS trailing_mean, (h_n * h_mean + 5 * group_mean) / (h_n + 5) AS eb_group, (h_n * h_mean + 5 * all_mean) / (h_n + 5) AS eb_all, analog,
  (h_n * h_mean + 5 * regime_mean) / (h_n + 5) AS eb_regime, neighbor FROM sig JOIN gm ON gm.grp = sig.grp AND gm.period = sig.period JOIN am ON am.period = sig.period LEFT JOIN (SELECT * FROM cand WHERE r = 1) c ON c.entity = sig.entity AND c.period = sig.period
  LEFT JOIN comp ON comp.node = sig.entity AND comp.period = sig.period LEFT JOIN regimes ON regimes.period = comp.period AND regimes.component = comp.component LEFT JOIN nb ON nb.entity = sig.entity AND nb.period = sig.period)"""


def _recursive(sql: str) -> str:
    """A query's views made part of a recursive list of common tables."""
    views = {"panel_supplier": SQL["panel_supplier"], "panel_gappy": SQL["panel_gappy"], "rates": SQL["rates"]}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in views.items()) + ", " + sql


def _even(c: str):
    """Rounded to six places, halves upward: means of rates of six places can lie halfway, which the two engines round apart."""
    return R6(F.col(c) + 1e-9)


_WHOLE = "whole AS (SELECT grp, entity, period, round(cases / denom * 1000, 6) AS rate FROM panel_supplier), pop AS (SELECT s_suppkey AS entity, s_acctbal AS population FROM supplier WHERE s_acctbal > 0)"
_ORIGIN = "(SELECT max(period) FROM (SELECT period FROM whole JOIN pop USING (entity) GROUP BY 1 HAVING count(DISTINCT entity) = (SELECT count(*) FROM pop)))"


@query(_recursive(f"""{_WHOLE}, o AS (SELECT {_ORIGIN}::INT AS origin), past AS (SELECT whole.* FROM whole, o WHERE period <= origin), {_sig("(SELECT origin + 1 FROM o)", "(SELECT origin + 1 FROM o)", "past")}, {_REGIMES}, {_models_sql("past", "2")},
future AS (UNPIVOT (SELECT entity, grp, latest, trailing_mean, eb_group, eb_all, analog, eb_regime FROM m) ON latest, trailing_mean, eb_group, eb_all, analog, eb_regime INTO NAME model VALUE raw)
SELECT entity, grp, origin, (origin + 2)::INT AS target, model, round(greatest(raw, 0) + 1e-9, 6) AS predicted, round(greatest(raw, 0) * population / 1000 + 1e-9, 4) AS predicted_cases FROM future JOIN pop USING (entity), o"""))
def q154_regional_annual_forecast(t: Tables):
    """Six models of the period two after the latest complete one."""
    rows = settled(t.panel_supplier().withColumn("rate", F.round(F.col("cases") / F.col("denom") * 1000, 6)).select("grp", "entity", "period", "rate"))
    population = t.supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("population"))
    origin = P.latest_common_period(rows, population.filter("population > 0"), "entity", "period")
    regimes = _regime_rows(edges(t), rows.filter(F.col("period") <= origin), origin + 1, origin + 1).withColumnRenamed("node", "entity")
    found = P.regional_forecast(rows, population, "entity", "grp", "period", "rate", origin + 2, 3, 2, 5.0, None, regimes, per=1000)
    return found.withColumns({"predicted": _even("predicted"), "predicted_cases": F.round(F.col("predicted_cases") + 1e-9, 4)})


def _stress(t: Tables, forest: bool):
    rows, first, last = _rates_and_folds(t)
    links = edges(t)  # both directions of pairs that are written already
    regimes = settled(_regime_rows(links, rows, first, last).withColumnRenamed("node", "entity").select("entity", "period", "regime_mean"))
    found = P.rate_stress(rows, "entity", "grp", "period", "rate", first, last, 3, 2, 5.0, regimes, links, forest)
    return found.withColumns({c: _even(c) for c in ("predicted", "residual")}).drop("grp")


@query()
def q155_incidence_stress_backtest(t: Tables):
    """All eight models of every fold, the forest among them."""
    return _stress(t, True)


@query(_recursive(f"""{_sig(_FIRST, _LAST)}, {_REGIMES}, {_models_sql("rates", "1")}, long AS (UNPIVOT (SELECT entity, grp, period, actual, latest, trailing_mean, eb_group, eb_all, analog, eb_regime, neighbor FROM m WHERE actual IS NOT NULL) ON latest, trailing_mean, eb_group, eb_all, analog, eb_regime, neighbor INTO NAME model VALUE raw)
SELECT entity, period, model, actual, round(greatest(raw, 0) + 1e-9, 6) AS predicted, round(actual - greatest(raw, 0) + 1e-9, 6) AS residual FROM long"""))
def q155_incidence_stress_closed_form(t: Tables):
    """The seven models that SQL can express."""
    return _stress(t, False)


@query("""WITH g AS (SELECT grp, period, sum(cases)::DOUBLE AS gt FROM panel_gappy GROUP BY 1, 2), e AS (SELECT period, sum(gt) AS tot FROM g GROUP BY 1), gm AS (SELECT grp, count(DISTINCT entity) AS gn FROM panel_gappy GROUP BY 1), am AS (SELECT sum(gn) AS an FROM gm),
h AS (SELECT p.entity, p.grp, p.period, cases::DOUBLE AS actual, count(cases) OVER w AS n, sum(cases) OVER w AS own, sum(gt) OVER w AS gs, sum(tot) OVER w AS als, max(cases) OVER (PARTITION BY entity ORDER BY p.period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prior_
  FROM panel_gappy p JOIN g ON g.grp = p.grp AND g.period = p.period JOIN e ON e.period = p.period WINDOW w AS (PARTITION BY entity ORDER BY p.period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)),
m AS (SELECT h.entity, h.period, actual, prior_::DOUBLE AS prior, own / n AS trailing_mean, own / gs * g.gt AS group_share, (own + 10.0 / gn) / (gs + 10) * g.gt AS eb_group_share, own / als * e.tot AS all_share, (own + 10.0 / an) / (als + 10) * e.tot AS eb_all_share
  FROM h JOIN g ON g.grp = h.grp AND g.period + 1 = h.period JOIN e ON e.period + 1 = h.period JOIN gm ON gm.grp = h.grp, am WHERE n >= 2 AND prior_ IS NOT NULL)
SELECT entity, period, model, actual, round(predicted + 1e-9, 6) AS predicted, round(actual - predicted + 1e-9, 6) AS residual FROM (UNPIVOT m ON prior, trailing_mean, group_share, eb_group_share, all_share, eb_all_share INTO NAME model VALUE predicted)""", "panel_gappy")
def q156_outcome_stress_backtest(t: Tables):
    rows = settled(t.panel_gappy())
    ends = rows.agg(F.min("period"), F.max("period")).first()
    found = P.count_stress(rows, "entity", "grp", "period", "cases", *ends, 4, 2, 10.0)
    return found.withColumns({c: _even(c) for c in ("predicted", "residual")}).drop("grp")


@query(_recursive(f"""{_sig(_FIRST, _COMING)}, {_REGIMES}, d AS (SELECT period, src AS node, count(*) AS degree FROM near GROUP BY 1, 2)
SELECT sig.period, sig.entity AS node, regime::INT AS regime, members, coalesce(degree, 0) AS degree, round(h_mean + 1e-9, 6) AS h_mean, h_prior, round(h_trend + 1e-9, 6) AS h_trend, round(regime_mean + 1e-9, 6) AS regime_mean, round(regime_prior + 1e-9, 6) AS regime_prior, round(regime_sd, 4) AS regime_sd
FROM sig JOIN comp ON comp.node = sig.entity AND comp.period = sig.period JOIN regimes r ON r.period = comp.period AND r.component = comp.component LEFT JOIN d ON d.period = sig.period AND d.node = sig.entity"""))
def q176_spatial_regimes(t: Tables):
    """Up to a period that no row has: regimes come from prior periods."""
    rows, first, last = _rates_and_folds(t)
    found = _regime_rows(edges(t), rows, first, last + 1).withColumns({c: _even(c) for c in ("h_mean", "h_trend", "regime_mean", "regime_prior")}).withColumn("regime_sd", F.round("regime_sd", 4))
    return found.select("period", "node", "regime", "members", "degree", "h_mean", "h_prior", "h_trend", "regime_mean", "regime_prior", "regime_sd")


@query(_recursive(f"""{_sig(_FIRST, _COMING)}, {_REGIMES}, x AS (SELECT comp.period, component, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes, count(r.entity) AS seen, sum(cases) AS cases, sum(denom) AS denom FROM comp LEFT JOIN rates r ON r.entity = node AND r.period = comp.period GROUP BY 1, 2)
SELECT r.period, regime::INT AS regime, nodes, members, round(regime_mean + 1e-9, 6) AS regime_mean, CASE WHEN seen = members THEN cases END::BIGINT AS actual_cases, CASE WHEN seen = members THEN denom END AS actual_population FROM regimes r JOIN x ON x.period = r.period AND x.component = r.component"""))
def q176_spatial_regime_summary(t: Tables):
    rows, first, last = _rates_and_folds(t)
    observed = rows.select("period", F.col("entity").alias("node"), "cases", "denom")
    found = P.regime_summary(_regime_rows(edges(t), rows, first, last + 1), observed, "cases", "denom")
    return found.select("period", "regime", "nodes", "members", _even("regime_mean").alias("regime_mean"), "actual_cases", "actual_population")


_QUANTILES = "q AS (SELECT model, quantile_cont(actual - predicted, 0.025) AS a, quantile_cont(actual - predicted, 0.1) AS b, quantile_cont(actual - predicted, 0.5) AS c, quantile_cont(actual - predicted, 0.9) AS d, quantile_cont(actual - predicted, 0.975) AS e, count(*) AS n_residuals FROM preds GROUP BY 1)"


@query("WITH " + _B + ", " + _QUANTILES + """, last AS (SELECT model, entity, predicted FROM preds WHERE period = 2001) SELECT model, entity, round(greatest(0, predicted + a), 6) AS lower_95, round(greatest(0, predicted + b), 6) AS lower_80, round(greatest(0, predicted + c), 6) AS center, round(greatest(0, predicted + d), 6) AS upper_80, round(greatest(0, predicted + e), 6) AS upper_95, n_residuals FROM last JOIN q USING (model)""", "rates")
def q157_residual_intervals(t: Tables):
    preds = _preds(t)
    found = M.residual_intervals(preds.filter("period = 2001").select("model", "entity", "predicted"), preds, "period", 2001, 10)
    return _rounded(found, "lower_95", "lower_80", "center", "upper_80", "upper_95").drop("predicted")


_SUMS = f"""p AS (SELECT *, {_REGIME} AS regime FROM preds), r AS (SELECT a.entity, a.period, a.model, any_value(a.actual) AS actual, any_value(a.predicted) AS predicted,
coalesce(sum(b.actual), 0) AS oa, coalesce(sum(b.predicted), 0) AS op, count(b.entity) AS o_n, coalesce(sum(b.actual) FILTER (WHERE b.regime = a.regime), 0) AS ra, coalesce(sum(b.predicted) FILTER (WHERE b.regime = a.regime), 0) AS rp, count(b.entity) FILTER (WHERE b.regime = a.regime) AS r_n
FROM p a LEFT JOIN p b ON a.model = b.model AND b.period < a.period GROUP BY 1, 2, 3)"""


@query(f"""WITH {_B}, {_SUMS} SELECT entity, period, model, CASE WHEN r_n >= 20 AND rp > 0 THEN 'regime' WHEN o_n >= 20 AND op > 0 THEN 'overall' ELSE 'none' END AS scope,
round(CASE WHEN r_n >= 20 AND rp > 0 THEN (ra + 50) / (rp + 50) WHEN o_n >= 20 AND op > 0 THEN (oa + 50) / (op + 50) ELSE 1 END, 6) AS multiplier FROM r""", "rates")
def q160_ratio_calibration(t: Tables):
    found = M.ratio_calibration(_regimes(t), "model", "regime", "period", 20, 50.0)
    return found.select("entity", "period", "model", "scope", R6("multiplier").alias("multiplier"))


@query(f"""WITH {_B}, {_SUMS}, g AS (SELECT *, 50 + CASE WHEN r_n >= 20 THEN ra WHEN o_n >= 20 THEN oa ELSE 0 END AS s, 50 + CASE WHEN r_n >= 20 THEN rp WHEN o_n >= 20 THEN op ELSE 0 END AS q FROM r), m AS (SELECT *, predicted * s / q AS post, predicted * s / q + predicted ** 2 * s / q ** 2 AS v FROM g)
SELECT entity, period, model, CASE WHEN r_n >= 20 THEN 'regime' WHEN o_n >= 20 THEN 'overall' ELSE 'prior' END AS scope, round(post, 5) AS posterior, round(greatest(post - 1.96 * sqrt(v), 0), 5) AS lower_95, round(post + 1.96 * sqrt(v), 5) AS upper_95 FROM m""", "rates")
def q159_bayes_gamma_poisson_update(t: Tables):
    found = M.gamma_poisson(_regimes(t), "model", "regime", "period", 20, 50.0)
    return found.select("entity", "period", "model", "scope", *[F.round(c, 5).alias(c) for c in ("posterior", "lower_95", "upper_95")])


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_acctbal > 5000 AND s_suppkey % 3 > 0 THEN 'promote' ELSE 'hold' END AS decision,
CASE WHEN s_suppkey % 2 = 1 THEN 'subgroup rows never pass' WHEN s_acctbal <= 5000 THEN 'rate error doesn''t improve' WHEN s_suppkey % 3 = 0 THEN 'case error doesn''t improve' ELSE 'both errors improve' END AS reason FROM supplier""")
def q161_promotion_gate(t: Tables):
    level = F.when(F.col("s_suppkey") % 2 == 0, "overall").otherwise("group")
    decision, reason = M.promotion_gate(level, F.col("s_acctbal") - 5000, F.col("s_suppkey") % 3)
    return t.supplier.select("s_suppkey", decision.alias("decision"), reason.alias("reason"))


@query(f"""WITH {_B}, f AS (SELECT entity, period, predicted, predicted * 0.98 AS lo, predicted * 1.02 AS hi FROM preds WHERE model = 'trailing_mean'), o AS (SELECT entity, period, rate AS actual FROM rates WHERE entity % 5 <> 0),
j AS (SELECT f.*, actual, actual - predicted AS residual, actual BETWEEN lo AND hi AS covered, CASE WHEN actual - predicted > 0.5 THEN 'above' WHEN actual - predicted < -0.5 THEN 'below' WHEN actual IS NOT NULL THEN 'near' END AS direction FROM f LEFT JOIN o USING (entity, period))
SELECT entity, period, round(residual, 6) AS residual, direction, CASE WHEN actual IS NULL THEN 'pending' WHEN period > 2000 THEN 'late_data' WHEN covered THEN 'expected' WHEN direction = 'above' THEN 'higher_than_expected' ELSE 'lower_than_expected' END AS interpretation FROM j""", "rates")
def q162_update_audit(t: Tables):
    f = _preds(t).filter("model = 'trailing_mean'").select("entity", "period", "predicted", (F.col("predicted") * 0.98).alias("lower_95"), (F.col("predicted") * 1.02).alias("upper_95"))
    o = t.rates().filter("entity % 5 <> 0").select("entity", "period", F.col("rate").alias("actual"))
    return M.update_audit(f, o, ["entity", "period"], F.col("period"), F.lit(2000), 0.5).select("entity", "period", R6("residual").alias("residual"), "direction", "interpretation")


@query(f"WITH {_B} SELECT entity, period, model, round(predicted - actual, 6) AS residual, CASE WHEN entity % 4 = 0 THEN 'conflicting' WHEN period < 2000 THEN 'old_definition' ELSE 'current' END AS regime FROM preds", "rates")
def q163_regime_residuals(t: Tables):
    flags = F.when(F.col("entity") % 4 == 0, "late,source_conflict").otherwise("late")
    return _preds(t).select("entity", "period", "model", R6("residual").alias("residual"), M.surveillance_regime(flags, F.col("period"), 2000).alias("regime"))


@query("""WITH f AS (SELECT entity, rate FROM rates WHERE period = 2001), h AS (SELECT entity, rate AS h FROM rates WHERE period <= 2000),
s AS (SELECT f.entity, f.rate, avg((h <= rate)::INT * 100) AS percentile, count(h) AS n_history, quantile_cont(h, 0.25) AS p25, quantile_cont(h, 0.75) AS p75 FROM f LEFT JOIN h ON f.entity = h.entity GROUP BY 1, 2)
SELECT entity, rate, round(percentile, 6) AS percentile, n_history, round(p25, 6) AS p25, round(p75, 6) AS p75, CASE WHEN percentile < 10 THEN 'very low' WHEN percentile < 25 THEN 'low' WHEN percentile < 75 THEN 'typical' WHEN percentile < 90 THEN 'high' WHEN percentile IS NOT NULL THEN 'very high' END AS severity,
round(CASE WHEN rate > p75 THEN rate - p75 WHEN rate < p25 THEN rate - p25 ELSE 0 END, 6) AS distance, CASE WHEN n_history >= 6 THEN 'strong' WHEN n_history >= 3 THEN 'moderate' ELSE 'weak' END AS evidence FROM s""", "rates")
def q164_forecast_typicality(t: Tables):
    rows = t.rates()
    return _rounded(M.typicality(rows.filter("period = 2001").select("entity", "rate"), rows.filter("period <= 2000"), "entity", "rate", 3), "percentile", "p25", "p75", "distance")


_SEVERITIES = ", ".join(f"CASE WHEN {p} < 10 THEN 'very low' WHEN {p} < 25 THEN 'low' WHEN {p} < 75 THEN 'typical' WHEN {p} < 90 THEN 'high' WHEN {p} IS NOT NULL THEN 'very high' END AS {n}" for p, n in (("lp", "ll"), ("up", "ul"), ("p", "severity")))


@query(f"""WITH z AS (SELECT max(period) AS z FROM rates), f AS (SELECT entity, rate, round(rate * 0.98, 6) AS lower_80, round(rate * 1.02, 6) AS upper_80 FROM rates, z WHERE period = z), h AS (SELECT entity, rate AS h FROM rates, z WHERE period < z),
s AS (SELECT f.entity, f.rate, lower_80, upper_80, avg((h <= lower_80)::INT * 100) AS lp, avg((h <= upper_80)::INT * 100) AS up, avg((h <= rate)::INT * 100) AS p, count(h) AS n_history FROM f LEFT JOIN h ON f.entity = h.entity GROUP BY 1, 2, 3, 4), l AS (SELECT *, {_SEVERITIES} FROM s)
SELECT entity, rate, lower_80, upper_80, round(lp, 6) AS lower_80_percentile, round(up, 6) AS upper_80_percentile, CASE WHEN ll = ul THEN ll ELSE ll || ' to ' || ul END AS interval_severity, severity, n_history FROM l""", "rates")
def q164_interval_typicality(t: Tables):
    rows = settled(t.rates())
    last = rows.agg(F.max("period")).first()[0]
    f = rows.filter(F.col("period") == last).select("entity", "rate", R6(F.col("rate") * 0.98).alias("lower_80"), R6(F.col("rate") * 1.02).alias("upper_80"))
    found = M.interval_typicality(f, rows.filter(F.col("period") < last), "entity", "rate", "lower_80", "upper_80", 3)
    return _rounded(found, "lower_80_percentile", "upper_80_percentile").select("entity", "rate", "lower_80", "upper_80", "lower_80_percentile", "upper_80_percentile", "interval_severity", "severity", "n_history")


@query("""WITH n AS (SELECT grp, count(DISTINCT entity) AS m FROM panel_supplier WHERE period <= 2000 GROUP BY 1), c AS (SELECT p.grp, period, sum(cases) AS total FROM panel_supplier p JOIN n ON n.grp = p.grp WHERE period <= 2000 GROUP BY p.grp, period, m HAVING count(DISTINCT entity) = m),
f AS (SELECT grp, sum(cases)::BIGINT AS forecast FROM panel_supplier WHERE period = 2001 GROUP BY 1), s AS (SELECT f.grp, forecast, count(total) AS n, min(total)::BIGINT AS least, quantile_cont(total, 0.5) AS median, max(total)::BIGINT AS most, avg((total <= forecast)::INT * 100) AS percentile FROM f LEFT JOIN c ON c.grp = f.grp GROUP BY 1, 2)
SELECT grp, forecast, n, least, median::DOUBLE AS median, most, round(percentile, 6) AS percentile, CASE WHEN n = 0 THEN 'no history' WHEN forecast > most THEN 'above maximum' WHEN forecast < least THEN 'below minimum' ELSE 'within range' END AS place FROM s""", "panel_supplier")
def q165_forecast_capacity(t: Tables):
    rows = t.panel_supplier()
    totals = A.complete_periods(rows.filter("period <= 2000"), "grp", "entity", "period", "cases")
    return _rounded(M.capacity(rows.filter("period = 2001"), totals, "grp", "cases"), "percentile")


@query("SELECT a.entity, a.cases AS predicted, b.cases AS actual, (a.cases - b.cases)::BIGINT AS error FROM panel_supplier a JOIN panel_supplier b ON a.entity = b.entity AND a.period = 1999 AND b.period = 2000", "panel_supplier")
def q166_observed_fit(t: Tables):
    part = lambda year, name: t.panel_supplier().filter(f"period = {year}").select("entity", F.col("cases").alias(name))
    return J.join_exact_cover(part(1999, "predicted"), part(2000, "actual"), ["entity"]).withColumn("error", F.col("predicted") - F.col("actual"))


@query("""WITH s AS (SELECT year, period, cases / sum(cases) OVER (PARTITION BY year) AS share FROM season), a AS (SELECT period, avg(share) AS m, quantile_cont(share, 0.5) AS med, min(share) AS lo, max(share) AS hi, quantile_disc(share, 0.1) AS l80, quantile_disc(share, 0.9) AS u80 FROM s GROUP BY 1)
SELECT period, round(m, 8) AS mean_share, round(med, 8) AS median_share, round(lo, 8) AS min_share, round(hi, 8) AS max_share, round(l80, 8) AS lower_80, round(u80, 8) AS upper_80, row_number() OVER (ORDER BY m DESC, period)::INT AS peak_rank, round(least(sum(m) OVER (ORDER BY period), 1), 6) AS cumulative FROM a""", "season")
def q167_seasonal_baseline(t: Tables):
    found = M.seasonal_baseline(t.season(), "year", "period", "cases").withColumn("cumulative", R6("cumulative"))
    return found.select("period", *[F.round(c, 8).alias(c) for c in ("mean_share", "median_share", "min_share", "max_share", "lower_80", "upper_80")], "peak_rank", "cumulative")


@query("""WITH curve AS (SELECT period AS month, round(sum(cases) / (SELECT sum(cases) FROM season), 6) AS share FROM season GROUP BY 1), a AS (SELECT entity, period, month, round(cases * share, 6) AS allocated FROM panel_nation, curve),
b AS (SELECT quantile_disc(allocated, 0.95) AS benchmark FROM a WHERE allocated > 0), s AS (SELECT a.*, benchmark, least(greatest(round_even(round(allocated / (benchmark * 1.1) * 10, 9), 0)::BIGINT, 1), 10) AS score FROM a, b)
SELECT entity, period, month, allocated, benchmark, score, CASE WHEN score <= 3 THEN 'low' WHEN score <= 6 THEN 'moderate' WHEN score <= 8 THEN 'high' ELSE 'very high' END AS category FROM s""", "panel_nation", "season")
def q168_seasonal_risk_score(t: Tables):
    total = t.season().agg(F.sum("cases").alias("total"))
    curve = t.season().groupBy(F.col("period").alias("month")).agg(F.sum("cases").alias("c")).crossJoin(total).select("month", R6(F.col("c") / F.col("total")).alias("share"))
    found = M.seasonal_scores(t.panel_nation().select("entity", "period", "cases"), curve, "cases", "share", 0.95, 1.1)
    return found.select("entity", "period", "month", "allocated", "benchmark", "score", "category")


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'a' ELSE event_type END AS kind_name, least(abs(value) / 100, 1) AS base, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 72 END AS hours, event_id % 3 + 1 AS n FROM events),
c AS (SELECT *, 1 - (1 - least(base * CASE kind_name WHEN 'a' THEN 1.0 WHEN 'view' THEN 0.6 ELSE 0.5 END * CASE WHEN hours IS NULL THEN 0.8 WHEN hours < 24 THEN 0.25 WHEN hours < 48 THEN 0.6 ELSE 1 END, 1)) ** n AS chance FROM e)
SELECT event_id, kind_name, round(chance, 6) AS chance, least(ceil(round(chance * 10, 9)), 10)::BIGINT AS score, CASE WHEN kind_name NOT IN ('a', 'view') OR hours < 36 OR base < 0.2 THEN 'not_met' WHEN hours IS NOT NULL THEN 'met' ELSE 'uncertain' END AS verdict FROM c""")
def q169_event_decision_score(t: Tables):
    k = F.col("event_id")
    rows = t.events.select("event_id", F.col("event_type").alias("kind"), F.least(F.abs("value") / 100, F.lit(1.0)).alias("base"), F.when(k % 5 != 0, k % 72).alias("hours"), (k % 3 + 1).alias("n"))
    found = M.decision_scores(rows, "base", "kind", "hours", "n", {"click": "a"}, {"a": 1.0, "view": 0.6})
    return found.select("event_id", "kind_name", R6("chance").alias("chance"), "score", "verdict")
