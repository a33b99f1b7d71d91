"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import joins as J
from panelwright.operators import sets as S
from panelwright.operators.storage import settled
from panelwright.plans.base import query
from panelwright.plans.views import Tables
from panelwright.plans.window_queries import R6


@query("SELECT a.entity, a.period, a.cases, b.denom, CASE WHEN b.denom > 0 THEN round(a.cases / b.denom * 1000, 6) END AS rate, CASE WHEN b.denom > 0 THEN '' ELSE 'missing_denominator' END AS flags FROM panel_supplier a LEFT JOIN panel_gappy b USING (entity, period)", "panel_supplier", "panel_gappy")
def q031_join_denominator(t: Tables):
    found = J.join_denominator(t.panel_supplier().select("entity", "period", "cases"), t.panel_gappy(), ["entity", "period"], "cases", "denom", 1000)
    return found.withColumn("rate", R6("rate"))


@query("""SELECT p.entity, p.period, p.cases, w.qty AS qty, r.rate AS rate, (r.rate IS NULL)::INT AS missing_rate, b.cases AS old_cases, (b.entity IS NULL)::INT AS missing_old, s.s_acctbal, (s.s_suppkey IS NULL)::INT AS missing_static, g.total AS total, 0::INT AS missing_world
FROM panel_supplier p JOIN (SELECT entity, year(d) AS period, sum(qty) AS qty FROM daily_supplier GROUP BY 1, 2) w ON p.entity = w.entity AND p.period = w.period LEFT JOIN rates r ON r.entity = p.entity AND r.period = p.period
LEFT JOIN panel_gappy b ON b.entity = p.entity AND b.period + 1 = p.period LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = p.entity LEFT JOIN (SELECT period, sum(cases)::BIGINT AS total FROM panel_supplier GROUP BY 1) g ON g.period = p.period""", "panel_supplier", "rates", "daily_supplier")
def q032_build_feature_panel(t: Tables):
    spine = t.panel_supplier().select("entity", "period", "cases")
    weather = t.daily_supplier().groupBy("entity", F.year("d").alias("period")).agg(F.sum("qty").alias("qty"))
    old = t.panel_gappy().select("entity", "period", F.col("cases").alias("old_cases"))
    static = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"), "s_acctbal")
    world = t.panel_supplier().groupBy("period").agg(F.sum("cases").alias("total"))
    return J.feature_panel(spine, [weather], {"rate": t.rates().select("entity", "period", "rate")}, {"old": old}, {"static": static}, {"world": world}, "entity", "period")


@query("""SELECT a.entity, a.period, a.cases, b.total AS prior_total, b.source AS prior_source FROM panel_nation a LEFT JOIN (
SELECT entity, period + 1 AS period, total, source FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY total DESC, source) AS r FROM multi_source) WHERE r = 1) b USING (entity, period)""", "panel_nation", "multi_source")
def q033_lag_join(t: Tables):
    found = J.lag_join(t.panel_nation(), t.multi_source(), ["entity"], "period", ["total", "source"], 1, [F.desc("total"), F.col("source")])
    return found.select("entity", "period", "cases", F.col("total").alias("prior_total"), F.col("source").alias("prior_source"))


@query("""SELECT entity, period, a.cases, b.denom, concat_ws(',', CASE WHEN a.cases IS NULL THEN 'missing_cases' END, CASE WHEN b.denom IS NULL THEN 'missing_rates' END) AS flags
FROM (SELECT entity, period, cases FROM panel_gappy) a FULL JOIN (SELECT entity, period, denom FROM panel_supplier WHERE period % 2 = 0) b USING (entity, period)""", "panel_supplier", "panel_gappy")
def q034_full_outer_by_key(t: Tables):
    a, b = t.panel_gappy().select("entity", "period", "cases"), t.panel_supplier().filter("period % 2 = 0").select("entity", "period", "denom")
    return J.full_outer_by_key(a, b, ["entity", "period"], ("cases", "rates"))


@query("""WITH u AS (SELECT entity, 'a' AS t, cases AS v FROM panel_supplier WHERE period = 1996 AND entity % 2 = 0 UNION ALL SELECT entity, 'b', cases FROM panel_supplier WHERE period = 1997 AND entity % 3 = 0 UNION ALL SELECT entity, 'c', cases FROM panel_supplier WHERE period = 1998 AND entity % 5 <> 0)
SELECT entity, max(v) FILTER (WHERE t = 'a') AS a, max(v) FILTER (WHERE t = 'b') AS b, max(v) FILTER (WHERE t = 'c') AS c, array_to_string(list_sort(list(DISTINCT t)), ';') AS sources,
array_to_string(list_transform(list_filter(['a', 'b', 'c'], lambda x: NOT list_contains(list(DISTINCT t), x)), lambda x: 'missing_' || x), ',') AS flags FROM u GROUP BY entity""", "panel_supplier")
def q035_full_outer_many(t: Tables):
    part = lambda year, condition: t.panel_supplier().filter(f"period = {year} AND {condition}").select("entity", "cases")
    return J.full_outer_many({"a": part(1996, "entity % 2 = 0"), "b": part(1997, "entity % 3 = 0"), "c": part(1998, "entity % 5 <> 0")}, ["entity"], "cases")


@query("SELECT o_custkey AS c_custkey, o_orderkey, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def q036_join_complete_required(t: Tables):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.join_complete(orders, [t.customer.select("c_custkey", "c_mktsegment"), t.customer.select("c_custkey", "c_nationkey")], ["c_custkey"])


@query("""WITH curve AS (SELECT period AS month, sum(cases) / (SELECT sum(cases) FROM season) AS share FROM season GROUP BY 1)
SELECT entity, p.period, month::INT AS month, round(cases * share, 6) AS allocated FROM panel_nation p, curve""", "panel_nation", "season")
def q037_cross_allocate(t: Tables):
    curve = t.season().groupBy(F.col("period").alias("month")).agg(F.sum("cases").alias("c"))
    curve = curve.crossJoin(t.season().agg(F.sum("cases").alias("total"))).select("month", (F.col("c") / F.col("total")).alias("share"))
    found = J.cross_allocate(t.panel_nation().select("entity", "period", "cases"), curve, "cases", "share", "allocated")
    return found.select("entity", "period", "month", R6("allocated").alias("allocated"))


@query("SELECT entity, period, grp, cases, round(cases * 0.8::DOUBLE, 6) AS lower, round(cases * 1.2::DOUBLE, 6) AS upper FROM panel_supplier", "panel_supplier")
def q038_attach_interval_strict(t: Tables):
    rows = t.panel_supplier().select("entity", "period", "grp", "cases")
    bounds = rows.select("entity", "period", "grp", R6(F.col("cases") * 0.8).alias("lower"), R6(F.col("cases") * 1.2).alias("upper"))
    return J.attach_strict(rows, bounds, ["entity", "period", "grp"])


@query("SELECT a.entity, a.cases AS before, b.cases AS after FROM panel_supplier a JOIN panel_supplier b ON a.entity = b.entity AND a.period = 1996 AND b.period = 1997", "panel_supplier")
def q039_join_exact_cover(t: Tables):
    part = lambda year, name: t.panel_supplier().filter(f"period = {year}").select("entity", F.col("cases").alias(name))
    return J.join_exact_cover(part(1996, "before"), part(1997, "after"), ["entity"])


_EDGES = """pairs AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), half AS (SELECT a.s AS a, b.s AS b, count(*) AS shared FROM pairs a JOIN pairs b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 12),
edges AS (SELECT a AS src, b AS dst, shared FROM half UNION ALL SELECT b, a, shared FROM half)"""


def edges(t: Tables):
    from panelwright.operators.graph import mirror

    return mirror(half_edges(t))


def half_edges(t: Tables):
    """Each of the edges once, as (a, b, shared)."""
    return settled(J.self_pairs(t.lineitem, "l_suppkey", "l_partkey", 12))  # read by both directions


@query(f"""WITH {_EDGES}, n AS (SELECT src, period, avg(cases) AS m, max(cases) AS x, count(cases) AS n FROM edges JOIN panel_gappy ON dst = entity GROUP BY 1, 2)
SELECT entity, p.period, cases, round(m, 6) AS neighbor_mean, x AS neighbor_max, coalesce(n, 0) AS neighbor_n, (n IS NULL)::INT AS neighbor_missing FROM panel_gappy p LEFT JOIN n ON src = entity AND n.period + 1 = p.period""", "panel_gappy")
def q040_neighbor_join(t: Tables):
    found = J.neighbor_summary(t.panel_gappy(), edges(t), "entity", "period", "cases", 1)
    return found.select("entity", "period", "cases", R6("neighbor_mean").alias("neighbor_mean"), "neighbor_max", "neighbor_n", "neighbor_missing")


@query("""WITH days AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem UNION SELECT DISTINCT o_orderdate::DATE FROM orders), starts AS (SELECT y, make_date(y, 1, 4) - dayofweek(make_date(y, 1, 4))::INT AS s FROM (SELECT unnest(range(1990, 2010)) AS y)),
cal AS (SELECT d, max(y) AS y, ((d - max(s)) // 7 + 1)::INT AS w FROM days JOIN starts ON s <= d GROUP BY d),
scores AS (SELECT l_suppkey AS entity, y AS year, w AS week, sum(l_quantity) AS score FROM lineitem JOIN cal ON l_shipdate::DATE = d GROUP BY 1, 2, 3),
q AS (SELECT l_orderkey AS qid, l_suppkey AS entity, any_value(y) AS y, any_value(w) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN cal ON o_orderdate::DATE = d GROUP BY 1, 2),
m AS (SELECT qid, q.entity, w, y, year, score, row_number() OVER (PARTITION BY qid, q.entity ORDER BY (year = q.y)::INT DESC NULLS LAST, year DESC) AS r FROM q LEFT JOIN scores s ON s.entity = q.entity AND s.week = q.w)
SELECT qid, entity, w AS week, year::INT AS used_year, score, CASE WHEN year IS NULL THEN 'no_score' WHEN year <> y THEN 'latest_year_used' ELSE '' END AS flags FROM m WHERE r = 1""")
def q041_asof_latest_or_exact(t: Tables):
    from panelwright.functions.expressions import mmwr_week, mmwr_year

    d = F.to_date("l_shipdate")
    scores = t.lineitem.groupBy(F.col("l_suppkey").alias("entity"), mmwr_year(d).cast("int").alias("year"), mmwr_week(d).alias("week")).agg(F.sum("l_quantity").alias("score"))
    lines = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("entity")).distinct()
    asked = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("qid"), "entity", F.to_date("o_orderdate").alias("d"))
    return J.asof_week(asked, scores, "qid", "entity", "d", "year", "week", "score")


@query("WITH pairs AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT a.s AS a, b.s AS b, count(*) AS shared FROM pairs a JOIN pairs b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 2")
def q042_self_pair_join(t: Tables):
    return J.self_pairs(t.lineitem, "l_suppkey", "l_partkey", 2)


_MILES = "round(2 * 3958.8 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))), 6)"


@query(f"""WITH m AS (SELECT a.entity, b.entity AS station, {_MILES} AS miles FROM points a, points b WHERE a.entity % 2 = 0 AND b.entity % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY miles, station) AS rank FROM m)
SELECT entity, station, round(miles, 4) AS miles, rank::INT AS rank FROM r WHERE rank <= 3""", "points")
def q043_nearest_k_join(t: Tables):
    stations = t.points().filter("entity % 2 = 1").select(F.col("entity").alias("station"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    found = J.nearest_k(t.points().filter("entity % 2 = 0"), stations, 3)
    return found.withColumn("miles", F.round(R6("miles"), 4))


#: Every period but the first as a fold; features standardised by the fold's earlier rows and rounded, so that both engines rank alike.
_ANALOGS = """f AS (SELECT period AS fold, avg(p.cases) AS ma, stddev_pop(p.cases) AS sa, avg(p.denom) AS mb, stddev_pop(p.denom) AS sb FROM (SELECT DISTINCT period FROM panel_supplier) o JOIN (SELECT period AS q, cases, denom FROM panel_supplier) p ON q < period GROUP BY 1),
z AS (SELECT fold, entity AS id, period, cases AS outcome, round((cases - ma) / CASE WHEN sa > 1e-12 THEN sa ELSE 1 END, 4) AS f1, round((denom - mb) / CASE WHEN sb > 1e-12 THEN sb ELSE 1 END, 4) AS f2 FROM f JOIN panel_supplier ON period <= fold),
m AS (SELECT a.fold, a.id AS test_id, b.id AS train_id, b.period AS train_period, b.outcome, round(sqrt((a.f1 - b.f1) ** 2 + (a.f2 - b.f2) ** 2), 9) AS distance FROM z a JOIN z b ON b.fold = a.fold AND b.period < a.fold WHERE a.period = a.fold),
r AS (SELECT *, row_number() OVER (PARTITION BY fold, test_id ORDER BY distance, train_period, train_id) AS rank FROM m)"""


def analogs(t: Tables):
    """The five nearest analogs of every row of every period but the first among the rows of earlier periods."""
    rows = t.panel_supplier().select(F.col("entity").alias("id"), "period", F.col("cases").alias("outcome"), "cases", "denom")
    folds = rows.select(F.col("period").alias("fold")).distinct()
    past = rows.join(F.broadcast(folds), F.col("period") < F.col("fold"))  # a row per period
    moments = past.groupBy("fold").agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in ("cases", "denom")]).withColumnsRenamed({"cases": "_a", "denom": "_b"})
    scaled = lambda c, m: F.round((F.col(c) - F.col(f"{m}.m")) / F.when(F.col(f"{m}.s") > 1e-12, F.col(f"{m}.s")).otherwise(1.0), 4)
    ready = lambda df: df.join(F.broadcast(moments), "fold").select("fold", "id", "period", "outcome", scaled("cases", "_a").alias("f1"), scaled("denom", "_b").alias("f2"))
    return J.nearest_analogs(ready(rows.withColumn("fold", F.col("period"))), ready(past), ["f1", "f2"], "fold", "period", 5)


@query(f"WITH {_ANALOGS} SELECT fold, test_id, train_id, train_period, outcome, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 5", "panel_supplier")
def q044_nearest_analog_join(t: Tables):
    return analogs(t).withColumn("distance", R6("distance"))


@query("""WITH w AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + 40 AS b FROM orders), p AS (SELECT *, unnest(range(year(a), year(b) + 1)) AS year FROM w)
SELECT o_orderkey, year::INT AS year, (least(b, make_date(year, 12, 31)) - greatest(a, make_date(year, 1, 1)) + 1)::INT AS days, round((least(b, make_date(year, 12, 31)) - greatest(a, make_date(year, 1, 1)) + 1) / 41, 6) AS share FROM p""")
def q045_range_split_join(t: Tables):
    from panelwright.operators.aggregates import week_fragments

    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("a")).withColumn("b", F.date_add("a", 40))
    return week_fragments(rows, "a", "b").select("o_orderkey", "year", "days", R6("share").alias("share"))


@query("SELECT a.entity, a.period, coalesce(sum(b.cases), 0)::BIGINT AS past_sum, count(b.cases) AS past_n FROM panel_gappy a LEFT JOIN panel_gappy b ON a.entity = b.entity AND b.period < a.period GROUP BY 1, 2", "panel_gappy")
def q046_prior_rows_join(t: Tables):
    return J.prior_rows(t.panel_gappy(), ["entity"], "period", "cases").select("entity", "period", "past_sum", "past_n")


@query("SELECT entity, period, 'right' AS missing_on FROM (SELECT entity, period FROM panel_supplier EXCEPT SELECT entity, period FROM panel_gappy)", "panel_supplier", "panel_gappy")
def q047_anti_join_report(t: Tables):
    return J.missing_keys(t.panel_supplier(), t.panel_gappy(), ["entity", "period"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q048_semi_filter_allowed(t: Tables):
    allowed = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(allowed, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT entity, period, source, total FROM multi_source WHERE source = '1-URGENT' AND period = 1997", "multi_source")
def q030_select_branch(t: Tables):
    return J.select_branch(t.multi_source(), ["source", "period"], source="1-URGENT", period=1997)


@query("SELECT c_custkey AS key, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def q095_union_sources(t: Tables):
    parts = {"customer": t.customer.select(F.col("c_custkey").alias("key")), "supplier": t.supplier.select(F.col("s_suppkey").alias("key")), "part": t.part.select(F.col("p_partkey").alias("key"))}
    return S.union_sources(parts, apart=["part"])[0]


@query("SELECT entity, period, coalesce(g.cases * 2, p.cases)::BIGINT AS cases, CASE WHEN g.cases IS NULL THEN 0 ELSE 1 END::INT AS vintage FROM panel_supplier p LEFT JOIN panel_gappy g USING (entity, period)", "panel_supplier", "panel_gappy")
def q096_union_override(t: Tables):
    new = t.panel_gappy().select("entity", "period", (F.col("cases") * 2).alias("cases"))
    return S.union_override([t.panel_supplier().select("entity", "period", "cases"), new], ["entity", "period"])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def q097_distinct_rows(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity").dropDuplicates()


@query("SELECT p.period, count(*) FILTER (WHERE g.entity IS NOT NULL) AS n_both, count(*) FILTER (WHERE g.entity IS NULL) AS only_a, 0::BIGINT AS only_b FROM panel_supplier p LEFT JOIN panel_gappy g USING (entity, period) GROUP BY p.period", "panel_supplier", "panel_gappy")
def q098_set_overlap(t: Tables):
    return S.set_overlap(t.panel_supplier(), t.panel_gappy(), ["entity", "period"], ["period"])


@query("""WITH e AS (SELECT n_nationkey AS g, (n_nationkey % 7)::BIGINT AS expected FROM nation WHERE n_nationkey < 22), o AS (SELECT s_nationkey AS g, count(*) AS observed FROM supplier WHERE s_nationkey > 1 GROUP BY 1)
SELECT g, expected, observed, CASE WHEN observed IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN expected <> observed THEN 'mismatched' ELSE 'ok' END AS status FROM e FULL JOIN o USING (g)""")
def q099_expected_members_check(t: Tables):
    expected = t.nation.filter("n_nationkey < 22").select(F.col("n_nationkey").alias("g"), (F.col("n_nationkey") % 7).cast("bigint").alias("n"))
    return S.expected_members(t.supplier.filter("s_nationkey > 1").select(F.col("s_nationkey").alias("g")), expected, "g", "n")


@query("SELECT entity, period, CASE WHEN period >= 1998 THEN cases + 1 ELSE cases END::BIGINT AS cases FROM panel_supplier", "panel_supplier")
def q016_upsert_by_key(t: Tables):
    rows = t.panel_supplier().select("entity", "period", "cases")
    return S.upsert(rows.filter("period < 2000"), rows.filter("period >= 1998").withColumn("cases", F.col("cases") + 1), ["entity", "period"])


@query("SELECT grp, entity, period, cases FROM panel_supplier WHERE grp NOT IN (SELECT grp FROM panel_supplier WHERE grp % 2 = 0 AND period = 1999) OR (grp % 2 = 0 AND period = 1999)", "panel_supplier")
def q017_upsert_replace_groups(t: Tables):
    rows = t.panel_supplier().select("grp", "entity", "period", "cases")
    return S.replace_groups(rows, rows.filter("grp % 2 = 0 AND period = 1999"), "grp", ["entity", "period"])
