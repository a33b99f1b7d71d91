"""Queries of aggregations, roll-ups, metrics and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import aggregates as A
from panelwright.operators.storage import spread
from panelwright.plans.base import query
from panelwright.plans.views import Tables
from panelwright.plans.window_queries import _rounded

SOURCES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("""SELECT o_custkey, year(o_orderdate)::INT AS period, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) AS total FROM orders GROUP BY 1, 2""")
def q049_sum_by_status(t: Tables):
    rows = t.orders.select("o_custkey", F.year("o_orderdate").alias("period"), "o_orderstatus", F.lit(1).alias("one"))
    return A.sum_by_status(rows, ["o_custkey", "period"], "o_orderstatus", "one", ["F", "O", "P"])


@query("""WITH p AS (SELECT *, CASE source WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS place FROM multi_source WHERE (entity + period + length(source)) % 3 <> 0)
SELECT entity, period, first(total ORDER BY place, source) AS total, first(source ORDER BY place, source) AS source, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT total) = 1 THEN 'matched' ELSE 'conflict' END AS status,
string_agg(source || '=' || total, ';' ORDER BY place, source) AS summary, concat_ws(',', CASE WHEN count(DISTINCT total) > 1 THEN 'source_conflict' END, CASE WHEN min(place) > 0 THEN 'fallback_source' END) AS flags FROM p GROUP BY 1, 2""", "multi_source")
def q050_reconcile_sources(t: Tables):
    rows = t.multi_source().filter((F.col("entity") + F.col("period") + F.length("source")) % 3 != 0)
    return A.reconcile_sources(rows, ["entity", "period"], "source", "total", SOURCES)


@query("SELECT l_orderkey, count(*) AS n, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS l_linestatus FROM lineitem GROUP BY 1")
def q051_consistent_or_null(t: Tables):
    sizes = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus").join(sizes, "l_orderkey")
    return A.consistent(rows, ["l_orderkey"], "n", ["l_returnflag", "l_linestatus"])


_ROLL = """SELECT entity, {year}::INT AS year, {period}::INT AS period, count(*) FILTER (WHERE qty >= 30) AS days_over, round(sum(greatest(qty - 10, 0)), 6) AS degree_sum, sum(qty) AS total, round(avg(qty), 6) AS mean, count(DISTINCT d) AS days, {expected}::INT AS expected, 0::BIGINT AS n_missing,
round(count(DISTINCT d) / {expected}, 6) AS ratio, CASE WHEN count(DISTINCT d) < {expected} THEN 'partial_period' ELSE '' END AS flags FROM daily_supplier GROUP BY 1, 2, 3"""


def _daily(t: Tables):
    """Days of suppliers, dealt by supplier before anything is counted: days, weeks and distinct days need no further shuffle."""
    return t.daily_supplier(spread(t.lineitem.select("l_suppkey", "l_shipdate", "l_quantity"), ["l_suppkey"], 1 << 18))


@query(_ROLL.format(year="isoyear(d)", period="week(d)", expected="7"), "daily_supplier")
def q052_calendar_rollup_week(t: Tables):
    return _rounded(A.calendar_rollup(_daily(t), "entity", "d", "qty", "week", 30, 10.0), "degree_sum", "mean", "ratio")


@query(_ROLL.format(year="year(d)", period="month(d)", expected="max(day(last_day(d)))"), "daily_supplier")
def q052_calendar_rollup_month(t: Tables):
    return _rounded(A.calendar_rollup(_daily(t), "entity", "d", "qty", "month", 30, 10.0), "degree_sum", "mean", "ratio")


@query("""WITH r AS (SELECT entity, year(d) AS period, d, qty < 25 AS h FROM daily_supplier), i AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY d) - row_number() OVER (PARTITION BY entity, period, h ORDER BY d) AS g FROM r),
n AS (SELECT entity, period, h, g, count(*) AS n FROM i GROUP BY 1, 2, 3, 4) SELECT entity, period::INT AS period, max(CASE WHEN h THEN n ELSE 0 END) AS longest FROM n GROUP BY 1, 2""", "daily_supplier")
def q053_longest_run(t: Tables):
    rows = t.daily_supplier().withColumn("period", F.year("d"))
    return A.longest_run(rows, ["entity", "period"], "d", F.col("qty") < 25)


@query("""WITH weekly AS (SELECT entity, date_trunc('week', d)::DATE AS a, date_trunc('week', d)::DATE + 6 AS b, sum(qty) AS v, count(*) AS days_over, avg(qty) AS m FROM daily_supplier GROUP BY 1, 2, 3),
p AS (SELECT *, unnest(range(year(a), year(b) + 1)) AS year FROM weekly), f AS (SELECT *, least(b, make_date(year, 12, 31)) - greatest(a, make_date(year, 1, 1)) + 1 AS days FROM p)
SELECT entity, year::INT AS year, round(sum(v * days / 7), 6) AS v_sum, round(sum(m * days) / sum(days), 6) AS m_mean, max(least(days_over, days))::BIGINT AS days_over_max FROM f GROUP BY 1, 2""", "daily_supplier")
def q054_weighted_period_aggregate(t: Tables):
    start = F.to_date(F.date_trunc("week", "d"))
    weekly = t.daily_supplier().groupBy("entity", start.alias("a")).agg(F.sum("qty").alias("v"), F.count(F.lit(1)).alias("days_over"), F.avg("qty").alias("m")).withColumn("b", F.date_add("a", 6))
    found = A.weighted_period(A.week_fragments(weekly, "a", "b"), ["entity", "year"], ["v"], ["m"], ["days_over"], "share", "days")
    return _rounded(found, "v_sum", "m_mean")


@query("""SELECT entity, year(d)::INT AS period, count(*) FILTER (WHERE qty >= 30) AS n_over, count(*) FILTER (WHERE qty >= 30 AND month(d) BETWEEN 4 AND 9) AS n_over_season, round(avg(qty), 6) AS mean, max(qty) AS most,
round(avg(qty) FILTER (WHERE month(d) BETWEEN 4 AND 9), 6) AS season_mean, coalesce(sum(qty) FILTER (WHERE month(d) BETWEEN 4 AND 9), 0)::DOUBLE AS season_sum FROM daily_supplier GROUP BY 1, 2""", "daily_supplier")
def q055_season_aggregate(t: Tables):
    return _rounded(A.season_aggregate(t.daily_supplier(), "entity", "d", "qty", 30, (4, 9)), "mean", "season_mean")


@query("WITH m AS (SELECT entity, year(d) AS y, month(d) AS m, avg(qty) AS v FROM daily_supplier GROUP BY 1, 2, 3) SELECT entity, (y + 1)::INT AS y, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS most FROM m GROUP BY entity, m.y HAVING count(DISTINCT m) = 12", "daily_supplier")
def q056_complete_group_features(t: Tables):
    monthly = t.daily_supplier().groupBy("entity", F.year("d").alias("y"), F.month("d").alias("m")).agg(F.avg("qty").alias("v"))
    return _rounded(A.complete_groups(monthly, ["entity", "y"], "m", "v", 12, "y"), "mean", "least", "most")


_COMPLETE = "WITH m AS (SELECT grp, count(DISTINCT entity) AS m FROM panel_gappy GROUP BY 1), c AS (SELECT grp, period, sum(cases)::BIGINT AS total FROM panel_gappy JOIN m USING (grp) GROUP BY grp, period, m HAVING count(DISTINCT entity) = m)"


@query(_COMPLETE + " SELECT grp, period, total FROM c", "panel_gappy")
def q057_complete_years_aggregate(t: Tables):
    return A.complete_periods(t.panel_gappy(), "grp", "entity", "period", "cases")


@query(_COMPLETE + " SELECT grp, max(period) AS latest FROM c GROUP BY 1", "panel_gappy")
def q058_latest_complete_period(t: Tables):
    return A.latest_complete_period(t.panel_gappy(), "grp", "entity", "period", "cases")


@query("""WITH r AS (SELECT entity, period, source, total FROM multi_source UNION ALL SELECT entity, period, 'all', sum(total)::BIGINT + 1 FROM multi_source WHERE entity % 2 = 0 GROUP BY 1, 2)
SELECT *, false AS is_derived FROM r UNION ALL SELECT entity, period, 'all', sum(total)::BIGINT, true FROM multi_source WHERE entity % 2 = 1 GROUP BY 1, 2""", "multi_source")
def q059_derive_missing_total(t: Tables):
    given = t.multi_source().filter("entity % 2 = 0").groupBy("entity", "period").agg((F.sum("total") + 1).alias("total")).withColumn("source", F.lit("all"))
    return A.derive_missing_total(t.multi_source().unionByName(given), ["entity", "period"], "source", "total")


_ERR = "avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, CASE WHEN stddev_pop(cases) > 0 AND stddev_pop(predicted) > 0 THEN corr(cases, predicted) END AS r, count(*) AS n"


def _predicted(t: Tables):
    return t.panel_supplier().select("grp", "entity", "period", F.col("cases").alias("actual"), (F.col("denom") / 25).alias("predicted"))


@query(f"""WITH p AS (SELECT *, denom / 25 AS predicted, denom / 25 - cases AS e FROM panel_supplier), g AS (SELECT grp, period, grouping_id(grp, period) AS level, {_ERR} FROM p GROUP BY GROUPING SETS ((), (period), (grp)))
SELECT grp, period, level, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(r, 6) AS r, n FROM g""", "panel_supplier")
def q060_multi_level_metrics(t: Tables):
    return _rounded(A.error_metrics(_predicted(t), [["grp"], ["period"], []]), "mae", "rmse", "bias", "r")


@query("""SELECT period, grp, sum(cases)::BIGINT AS cases, sum(denom) AS denom, min(cases) AS least, max(cases) AS most, count(*) AS n, CASE WHEN grouping(grp) = 1 THEN 'all' ELSE 'group' END AS level, round(sum(cases) / sum(denom), 8) AS rate
FROM panel_supplier GROUP BY GROUPING SETS ((period), (period, grp))""", "panel_supplier")
def q061_rollup_two_levels(t: Tables):
    return A.rollup_levels(t.panel_supplier(), "period", "grp", "cases", "denom").withColumn("rate", F.round("rate", 8))


@query("SELECT period, s_acctbal > 4500 AS member, CASE WHEN s_acctbal > 4500 THEN 'rich' ELSE 'poor' END AS kind, sum(cases)::BIGINT AS cases, sum(denom) AS denom, round(sum(cases) / sum(denom), 8) AS rate, count(*) AS n FROM panel_supplier JOIN supplier ON entity = s_suppkey GROUP BY 1, 2, 3", "panel_supplier")
def q062_rollup_by_membership(t: Tables):
    member = t.supplier.select(F.col("s_suppkey").alias("entity"), (F.col("s_acctbal") > 4500).alias("member"))
    rows = t.panel_supplier().join(member.select("entity", F.when(F.col("member"), "rich").otherwise("poor").alias("kind")), "entity")
    found = A.rollup_by_membership(rows, member, "entity", "period", "member", "cases", "denom", ["kind"])
    return found.withColumn("rate", F.round("rate", 8))


@query("""WITH p AS (SELECT grp AS regime, period, denom / 25 - cases AS e FROM panel_supplier), c AS (SELECT *, CASE WHEN abs(e) <= 5 THEN 'close' WHEN e > 0 THEN 'over' ELSE 'under' END AS reading FROM p)
SELECT regime, period, count(*) AS n, round(avg(e), 6) AS bias, count(*) FILTER (WHERE reading = 'close') AS n_close, count(*) FILTER (WHERE reading = 'over') AS n_over, count(*) FILTER (WHERE reading = 'under') AS n_under, round(avg((reading = 'close')::INT), 6) AS share_close
FROM c GROUP BY GROUPING SETS ((regime, period), (regime))""", "panel_supplier")
def q063_yearly_plus_overall_summary(t: Tables):
    from panelwright.operators.forecast import reading_summary

    rows = _predicted(t).select(F.col("grp").alias("regime"), "period", (F.col("predicted") - F.col("actual")).alias("e"))
    reading = F.when(F.abs("e") <= 5, "close").when(F.col("e") > 0, "over").otherwise("under")
    return _rounded(reading_summary(rows.withColumn("reading", reading), "regime", "period", "e", "reading", ["close", "over", "under"], "close"), "bias", "share_close")


@query("""WITH p AS (SELECT grp, period, entity, cases AS a, denom AS b FROM panel_supplier), s AS (SELECT *, a / sum(a) OVER w AS sa, b / sum(b) OVER w AS sb,
rank() OVER (PARTITION BY grp, period ORDER BY a) + (count(*) OVER (PARTITION BY grp, period, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY grp, period ORDER BY b) + (count(*) OVER (PARTITION BY grp, period, b) - 1) / 2 AS rb,
row_number() OVER (PARTITION BY grp, period ORDER BY a DESC, entity) AS ka, row_number() OVER (PARTITION BY grp, period ORDER BY b DESC, entity) AS kb FROM p WINDOW w AS (PARTITION BY grp, period))
SELECT grp, period, round(sum(sa ** 2), 6) AS hhi_actual, round(sum(sb ** 2), 6) AS hhi_predicted, round(avg(abs(sa - sb)), 6) AS share_error, round(CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END, 5) AS spearman, count(*) AS n,
count(*) FILTER (WHERE ka <= 3 AND kb <= 3) AS top3, count(*) FILTER (WHERE ka <= 5 AND kb <= 5) AS top5 FROM s GROUP BY 1, 2""", "panel_supplier")
def q064_concentration_and_overlap(t: Tables):
    found = A.concentration(t.panel_supplier(), ["grp", "period"], "entity", "cases", "denom")
    return _rounded(found, "hhi_actual", "hhi_predicted", "share_error").withColumn("spearman", F.round("spearman", 5))


@query("SELECT grp, period, round(sum(cases / denom * 0.9 * denom), 4) AS lower, round(sum(cases / denom * 1.1 * denom), 4) AS upper, sum(cases)::BIGINT AS actual, true AS covered FROM panel_supplier GROUP BY 1, 2", "panel_supplier")
def q065_interval_sum_rollup(t: Tables):
    r = F.col("cases") / F.col("denom")
    rows = t.panel_supplier().withColumns({"lo": r * 0.9, "hi": r * 1.1})
    found = A.interval_rollup(rows, ["grp", "period"], {"lower": "lo", "upper": "hi"}, "denom", "cases")
    return found.withColumns({c: F.round(c, 4) for c in ("lower", "upper")})


@query("SELECT a.grp, a.period, round(CASE WHEN count(b.denom) = count(*) THEN sum(a.cases) / sum(b.denom) ELSE avg(a.cases / a.denom) END, 8) AS rate, count(*) AS n FROM panel_supplier a LEFT JOIN panel_gappy b USING (entity, period) GROUP BY 1, 2", "panel_supplier", "panel_gappy")
def q066_weighted_rate(t: Tables):
    known = t.panel_gappy().select("entity", "period", F.col("denom").alias("pop"))
    rows = t.panel_supplier().withColumn("r", F.col("cases") / F.col("denom")).join(known, ["entity", "period"], "left")
    return A.weighted_rate(rows, ["grp", "period"], "cases", "pop", "r").withColumn("rate", F.round("rate", 8))


@query("WITH y AS (SELECT grp, period, sum(cases) / sum(denom) AS r FROM panel_supplier GROUP BY 1, 2) SELECT grp, round(min(r), 8) AS least, round(avg(r), 8) AS mean, round(max(r), 8) AS most, round(stddev_pop(r), 7) AS sd, count(r) AS periods FROM y GROUP BY 1", "panel_supplier")
def q067_per_period_then_stats(t: Tables):
    found = A.per_period_then_stats(t.panel_supplier(), "grp", "period", "cases", "denom")
    return found.withColumns({c: F.round(c, 7 if c == "sd" else 8) for c in ("least", "mean", "most", "sd")})


@query("SELECT period, count(DISTINCT entity) AS entities, CASE WHEN count(DISTINCT entity) < 76 THEN 'partial_coverage' ELSE '' END AS flags FROM panel_gappy GROUP BY 1", "panel_gappy")
def q068_distinct_coverage_count(t: Tables):
    return A.distinct_coverage(t.panel_gappy(), "entity", "period", 76)


@query("SELECT sum(cases)::BIGINT AS actual, round(sum(denom / 25), 6) AS predicted, round(sum(denom / 25 - cases), 6) AS residual, round(avg(abs(denom / 25 - cases)), 6) AS mae, round(sqrt(avg((denom / 25 - cases) ** 2)), 6) AS rmse, count(*) FILTER (WHERE denom / 25 < cases) AS under, count(*) FILTER (WHERE denom / 25 > cases) AS over, count(*) FILTER (WHERE denom / 25 = cases) AS exact FROM panel_supplier", "panel_supplier")
def q069_fit_summary(t: Tables):
    return _rounded(A.fit_summary(_predicted(t), "actual", "predicted"), "predicted", "residual", "mae", "rmse")


@query("""WITH m AS (SELECT entity, period FROM panel_gappy WHERE cases >= 85), p AS (SELECT DISTINCT period FROM panel_gappy), h AS (SELECT period + 1 AS period FROM p),
j AS (SELECT coalesce(a.period, b.period + 1) AS period, a.entity AS now, b.entity AS was FROM m a FULL JOIN m b ON a.entity = b.entity AND a.period = b.period + 1)
SELECT p.period, count(now) AS size, CASE WHEN any_value(h.period) IS NOT NULL THEN count(*) FILTER (WHERE now IS NOT NULL AND was IS NOT NULL) END AS stayed, CASE WHEN any_value(h.period) IS NOT NULL THEN count(*) FILTER (WHERE now IS NOT NULL AND was IS NULL) END AS new,
CASE WHEN any_value(h.period) IS NOT NULL THEN count(*) FILTER (WHERE now IS NULL AND was IS NOT NULL) END AS left FROM p LEFT JOIN h ON h.period = p.period LEFT JOIN j ON j.period = p.period GROUP BY 1""".replace("AS left FROM", 'AS "left" FROM').replace("AS new,", 'AS "new",'), "panel_gappy")
def q070_persist_new_exited(t: Tables):
    return A.persistence(t.panel_gappy(), "entity", "period", F.col("cases") >= 85)


@query("""WITH z AS (SELECT max(period) AS z FROM panel_gappy), l AS (SELECT entity, regr_slope(cases, period - z) AS s, regr_intercept(cases, period - z) AS i FROM panel_gappy, z WHERE period BETWEEN z - 4 AND z GROUP BY 1 HAVING max(period) = max(z) AND count(*) >= 2)
SELECT entity, (z + y)::INT AS period, greatest(1, round_even(round(i + s * y, 6), 0)::BIGINT) AS cases FROM l, z, (SELECT unnest([1, 2, 3]) AS y)""", "panel_gappy")
def q071_project_linear_trend(t: Tables):
    rows = t.panel_gappy()
    last = rows.agg(F.max("period")).first()[0]
    return A.project_trend(rows, "entity", "period", "cases", last, 5, last + 3)
