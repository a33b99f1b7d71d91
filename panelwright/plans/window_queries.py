"""Queries of ranks, lags, trailing statistics and quantiles over the panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import windows as W
from panelwright.plans.base import query
from panelwright.plans.views import Tables

R6 = lambda c: F.round(c, 6)


def _rounded(df, *names):
    return df.withColumns({n: R6(F.col(n)) for n in names})


_RANK = """ranked AS (SELECT *, CASE WHEN rate IS NOT NULL THEN row_number() OVER (PARTITION BY period, rate IS NULL ORDER BY rate DESC, entity) END AS rank,
  count(rate) OVER (PARTITION BY period) AS n_ranked FROM {src}), tiered AS (SELECT *, CASE WHEN n_ranked <= 1 THEN 1.0 ELSE (n_ranked - rank) / (n_ranked - 1) END AS percentile,
  CASE WHEN rank <= greatest(1, ceil(round(n_ranked * 0.1, 9))) THEN 'top_decile' WHEN rank <= greatest(1, ceil(round(n_ranked * 0.2, 9))) THEN 'top_quintile'
  WHEN rank <= greatest(1, ceil(round(n_ranked * 0.5, 9))) THEN 'top_half' ELSE 'lower_half' END AS tier FROM ranked)"""


@query(f"""WITH src AS (SELECT *, round(cases / denom * 100000, 6) AS rate FROM panel_nation), {_RANK.format(src="src")}
SELECT t.grp, t.entity, t.period, t.cases, t.denom, t.rate, t.rank::INT AS rank, round(t.percentile, 6) AS percentile, t.tier, p.rank::INT AS prior_rank, (p.rank - t.rank)::INT AS rank_change
FROM tiered t LEFT JOIN tiered p ON p.entity = t.entity AND p.period = t.period - 1""", "panel_nation")
def panel_rate_ranks(t: Tables):
    rates = t.panel_nation().withColumn("rate", R6(F.col("cases") / F.col("denom") * 100_000))
    ranked = W.prior_period(W.rank_tier(rates, ["period"], "rate", "entity"), ["entity"], "period", ["rank"])
    return ranked.select("grp", "entity", "period", "cases", "denom", "rate", "rank", R6("percentile").alias("percentile"), "tier", "prior_rank", (F.col("prior_rank") - F.col("rank")).alias("rank_change"))


@query(f"WITH {_RANK.format(src='rates')} SELECT entity, period, rank::INT AS rank, round(percentile, 6) AS percentile, tier FROM tiered", "rates")
def q072_rank_tier(t: Tables):
    return W.rank_tier(t.rates(), ["period"], "rate", "entity").select("entity", "period", "rank", R6("percentile").alias("percentile"), "tier")


@query("SELECT r.entity, r.period, r.rate, p.rate AS prior_rate, round(r.rate - p.rate, 6) AS change FROM rates r LEFT JOIN rates p ON p.entity = r.entity AND p.period = r.period - 1", "rates")
def q073_prior_period_lag(t: Tables):
    found = W.prior_period(t.rates(), ["entity"], "period", ["rate"])
    return found.select("entity", "period", "rate", "prior_rate", R6(F.col("rate") - F.col("prior_rate")).alias("change"))


@query("""SELECT entity, period, min(cases) OVER w AS trailing_min, round(avg(cases) OVER w, 6) AS trailing_mean, max(cases) OVER w AS trailing_max, count(cases) OVER w AS trailing_n,
cases BETWEEN min(cases) OVER w AND max(cases) OVER w AS trailing_in_band, count(cases) OVER w < 5 AS trailing_partial FROM panel_gappy
WINDOW w AS (PARTITION BY entity ORDER BY period RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)""", "panel_gappy")
def q074_trailing_stats(t: Tables):
    found = W.trailing_stats(t.panel_gappy(), ["entity"], "period", "cases", 5)
    return _rounded(found, "trailing_mean").drop("grp", "cases", "denom")


@query("SELECT entity, period, round(avg(rate) OVER w, 6) AS trailing_mean, count(rate) OVER w AS trailing_rows FROM rates WINDOW w AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", "rates")
def q075_trailing_mean_last_n(t: Tables):
    return _rounded(W.trailing_mean_rows(t.rates(), ["entity"], "period", "rate", 3), "trailing_mean").select("entity", "period", "trailing_mean", "trailing_rows")


@query("""WITH weekly AS (SELECT entity, isoyear(d) AS y, week(d) AS w, sum(qty) AS v FROM daily_supplier GROUP BY 1, 2, 3)
SELECT entity, y::INT AS y, w::INT AS w, v, round(avg(v) OVER h, 6) AS baseline, count(v) OVER h AS baseline_n, round(v - avg(v) OVER h, 6) AS anomaly
FROM weekly WINDOW h AS (PARTITION BY entity, w ORDER BY y RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)""", "daily_supplier")
def q076_same_season_anomaly(t: Tables):
    from panelwright.functions.expressions import iso_week, iso_year

    weekly = t.daily_supplier().groupBy("entity", iso_year(F.col("d")).alias("y"), iso_week(F.col("d")).alias("w")).agg(F.sum("qty").alias("v"))
    return _rounded(W.season_anomaly(weekly, ["entity"], "w", "y", "v"), "baseline", "anomaly")


@query("SELECT entity, period, round(cases / sum(cases) OVER (PARTITION BY period), 8) AS share, round(cases / sum(cases) OVER (PARTITION BY grp, period), 8) AS group_share FROM panel_supplier", "panel_supplier")
def q077_share_of_total(t: Tables):
    found = W.share_of_total(W.share_of_total(t.panel_supplier(), ["period"], "cases"), ["grp", "period"], "cases", "group_share")
    return found.select("entity", "period", F.round("share", 8).alias("share"), F.round("group_share", 8).alias("group_share"))


@query("""WITH s AS (SELECT year, period, cases / sum(cases) OVER (PARTITION BY year) AS share FROM season)
SELECT year::INT AS year, period::INT AS period, row_number() OVER (PARTITION BY year ORDER BY share DESC, period)::INT AS peak_rank, round(least(sum(share) OVER (PARTITION BY year ORDER BY period), 1), 6) AS cumulative FROM s""", "season")
def q078_rank_and_cumulative(t: Tables):
    shares = W.share_of_total(t.season(), ["year"], "cases", empty=0.0)
    return W.rank_and_cumulative(shares, ["year"], "period", "share").select("year", "period", "peak_rank", R6("cumulative").alias("cumulative"))


@query("""WITH g AS (SELECT a.entity, a.period, a.cases, b.cases AS prior_value, CASE WHEN b.cases <> 0 THEN (a.cases - b.cases) / b.cases * 100 END AS pct
FROM panel_gappy a LEFT JOIN panel_gappy b ON a.entity = b.entity AND a.period = b.period + 1)
SELECT entity, period, prior_value, cases - prior_value AS change, round(pct, 6) AS pct, round(CASE WHEN count(pct) OVER w = 3 THEN avg(pct) OVER w END, 6) AS mean_pct_3
FROM g WINDOW w AS (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""", "panel_gappy")
def q079_growth_features(t: Tables):
    return _rounded(W.growth(t.panel_gappy(), ["entity"], "period", "cases"), "pct", "mean_pct_3").drop("grp", "cases", "denom")


@query("""WITH h AS (SELECT entity, period, avg(rate) OVER w AS h_mean, min(rate) OVER w AS h_min, max(rate) OVER w AS h_max, stddev_pop(rate) OVER w AS h_sd,
first_value(rate) OVER w AS h_first, last_value(rate) OVER w AS h_last, count(rate) OVER w AS h_n, max(rate) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS h_prior
FROM rates WINDOW w AS (PARTITION BY entity ORDER BY period RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT entity, period, round(h_mean, 6) AS h_mean, h_min, h_max, round(h_sd, 4) AS h_sd, h_first, h_last, h_n, round(h_last - h_first, 6) AS h_trend FROM h WHERE h_n >= 2 AND h_prior IS NOT NULL""", "rates")
def q080_history_window_summary(t: Tables):
    found = W.history_summary(t.rates(), ["entity"], "period", "rate", 4, 2)
    return found.select("entity", "period", R6("h_mean").alias("h_mean"), "h_min", "h_max", F.round("h_sd", 4).alias("h_sd"), "h_first", "h_last", "h_n", R6("h_trend").alias("h_trend"))


@query("""WITH s AS (SELECT grp, period, sum(cases) AS s, count(cases) AS n FROM panel_gappy GROUP BY 1, 2), e AS (SELECT period, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1),
ew AS (SELECT period, sum(s) OVER w / sum(n) OVER w AS m FROM e WINDOW w AS (ORDER BY period RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT grp, s.period, round(sum(s) OVER w / sum(n) OVER w, 6) AS group_mean, round(m, 6) AS all_mean FROM s JOIN ew ON s.period = ew.period
WINDOW w AS (PARTITION BY grp ORDER BY s.period RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)""", "panel_gappy")
def q081_group_prior_means(t: Tables):
    return _rounded(W.pooled_prior_means(t.panel_gappy(), "grp", "period", "cases", 3), "group_mean", "all_mean")


@query("""WITH s AS (SELECT grp, period, CASE WHEN sum(denom) > 0 THEN sum(cases) / sum(denom) END AS r FROM panel_gappy GROUP BY 1, 2)
SELECT a.grp, a.period, round(a.r, 8) AS group_rate, round(b.r, 8) AS prior_group_rate, (b.r IS NULL)::INT AS prior_missing FROM s a LEFT JOIN s b ON a.grp = b.grp AND a.period = b.period + 1""", "panel_gappy")
def q082_group_rate_prior(t: Tables):
    found = W.group_rate(t.panel_gappy(), "grp", "period", "cases", "denom")
    return found.withColumns({c: F.round(c, 8) for c in ("group_rate", "prior_group_rate")})


@query("""WITH s AS (SELECT grp, period, sum(cases) / sum(denom) AS r FROM panel_gappy GROUP BY 1, 2)
SELECT grp, period, round(CASE WHEN avg(r) OVER w > 0 THEN last_value(r) OVER w / avg(r) OVER w ELSE 1 END, 6) AS multiplier FROM s WINDOW w AS (PARTITION BY grp ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""", "panel_gappy")
def q083_trend_multiplier(t: Tables):
    rates = W.group_rate(t.panel_gappy(), "grp", "period", "cases", "denom")
    return W.trend_multiplier(rates, "grp", "period", "group_rate", 3).select("grp", "period", R6("multiplier").alias("multiplier"))


@query("""SELECT a.entity, a.period, coalesce(sum(b.cases), 0)::BIGINT AS past_cases, coalesce(sum(b.denom), 0)::DOUBLE AS past_denom, count(b.entity) AS past_n
FROM panel_gappy a LEFT JOIN panel_gappy b ON a.grp = b.grp AND b.period < a.period GROUP BY 1, 2""", "panel_gappy")
def q084_expanding_prior_sums(t: Tables):
    return W.expanding_sums(t.panel_gappy(), ["grp"], "period", ["cases", "denom"], "past_").select("entity", "period", "past_cases", "past_denom", "past_n")


@query("SELECT entity, max(period) AS period, max_by(cases, period) AS cases, max_by(grp, period) AS grp, max_by(denom, period) AS denom FROM panel_gappy GROUP BY 1", "panel_gappy")
def q085_keep_latest_per_key(t: Tables):
    return W.keep_latest(t.panel_gappy(), ["entity"], "period")


@query("""SELECT entity, period, cases FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(cases - 85), period DESC) AS r FROM panel_gappy) WHERE r = 1""", "panel_gappy")
def q086_best_match_per_key(t: Tables):
    return W.best_per_key(t.panel_gappy(), ["entity"], [F.abs(F.col("cases") - 85), -F.col("period")]).select("entity", "period", "cases")


@query("SELECT entity, period, cases FROM panel_supplier ORDER BY entity, period", "panel_supplier")
def q087_stable_output_order(t: Tables):
    return t.panel_supplier().select("entity", "period", "cases").orderBy("entity", "period")


@query("""WITH e AS (SELECT grp AS model, avg(abs(cases - denom / 25)) AS mae, sqrt(avg((cases - denom / 25) ** 2)) AS rmse FROM panel_supplier GROUP BY 1)
SELECT model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, row_number() OVER (ORDER BY round(mae, 6), round(rmse, 6), model)::INT AS rank FROM e""", "panel_supplier")
def q088_rank_models(t: Tables):
    from panelwright.operators.aggregates import error_metrics, rank_models

    rows = t.panel_supplier().select(F.col("grp").alias("model"), F.col("cases").alias("actual"), (F.col("denom") / 25).alias("predicted"))
    return rank_models(_rounded(error_metrics(rows, [["model"]]), "mae", "rmse"), "model").select("model", "mae", "rmse", "rank")


@query("""WITH r AS (SELECT grp, period, row_number() OVER (PARTITION BY grp, period ORDER BY cases DESC, entity) AS a, row_number() OVER (PARTITION BY grp, period ORDER BY denom DESC, entity) AS b FROM panel_supplier)
SELECT grp, period, count(*) FILTER (WHERE a <= 3 AND b <= 3) AS top3, count(*) FILTER (WHERE a <= 5 AND b <= 5) AS top5 FROM r GROUP BY 1, 2""", "panel_supplier")
def q089_top_k_overlap(t: Tables):
    from panelwright.operators.aggregates import top_k_overlap

    return top_k_overlap(t.panel_supplier(), ["grp", "period"], "cases", "denom", "entity", [3, 5])


@query("""SELECT s_nationkey, s_suppkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier WHERE s_acctbal >= 0) WHERE rank <= 2""")
def q090_select_eligible_top_k(t: Tables):
    return W.top_k(t.supplier.filter("s_acctbal >= 0"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 2).select("s_nationkey", "s_suppkey", "rank")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def q091_dedupe_best(t: Tables):
    return W.best_per_key(t.orders, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.1) AS p10, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.975) AS p975 FROM lineitem GROUP BY 1")
def q092_quantile_nearest_rank(t: Tables):
    return W.quantile_nearest(t.lineitem, ["l_returnflag"], "l_quantity", {"p10": 0.1, "p50": 0.5, "p975": 0.975})


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.975), 6) AS p975 FROM lineitem GROUP BY 1")
def q093_quantile_linear(t: Tables):
    return _rounded(W.quantile_linear(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p975": 0.975}), "p10", "p50", "p975")


@query("""WITH z AS (SELECT max(period) AS z FROM rates), now AS (SELECT entity, rate FROM rates, z WHERE period = z), past AS (SELECT entity, rate AS past FROM rates, z WHERE period < z)
SELECT now.entity, rate, round(avg((past <= rate)::INT), 6) AS ecdf, count(past) AS ecdf_n FROM now LEFT JOIN past ON now.entity = past.entity GROUP BY 1, 2""", "rates")
def q094_ecdf_percentile(t: Tables):
    rates = t.rates()
    last = rates.agg(F.max("period")).first()[0]
    now, past = rates.filter(F.col("period") == last), rates.filter(F.col("period") < last)
    found = W.ecdf(now.select("entity", "rate"), past.select("entity", F.col("rate").alias("past")), ["entity"], "rate", "past")
    return _rounded(found, "ecdf")
