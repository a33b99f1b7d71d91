"""Queries of the cleaning, flag, date and number expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import expressions as X
from panelwright.plans.base import query
from panelwright.plans.views import Tables


@query("SELECT o_orderkey, lpad(o_custkey::VARCHAR, 7, '0') AS code, lpad((o_custkey % 100)::VARCHAR, 5, '0') AS short_code, NULL::VARCHAR AS bad_code FROM orders")
def q020_normalize_code(t: Tables):
    text = F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0 "))
    return t.orders.select("o_orderkey", X.normalize_code(text, 7).alias("code"), X.normalize_code(F.col("o_custkey") % 100).alias("short_code"), X.normalize_code(F.concat(F.lit("x"), F.col("o_orderkey"))).alias("bad_code"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN 0 ELSE o_custkey * 1000 END::BIGINT AS n, o_orderkey % 7 < 3 AS suppressed FROM orders")
def q021_parse_count_with_suppression(t: Tables):
    k = F.col("o_orderkey") % 7
    thousand = F.concat(F.col("o_custkey").cast("string"), F.lit(",000"))
    text = F.when(k == 0, " Suppressed ").when(k == 1, "-").when(k == 2, F.lit(None)).otherwise(thousand)
    rows = t.orders.select("o_orderkey", text.alias("c"))
    return rows.select("o_orderkey", X.parse_count(F.col("c")).alias("n"), X.is_suppressed(F.col("c")).alias("suppressed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS i, CASE WHEN o_orderkey % 3 <> 2 THEN o_custkey + CASE WHEN o_orderkey % 3 = 1 THEN 0.5 ELSE 0 END END::DOUBLE AS f, o_orderkey % 2 = 0 AS b FROM orders")
def q022_parse_numbers(t: Tables):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat("o_custkey", F.lit(".0"))).when(k == 1, F.concat("o_custkey", F.lit(".5"))).otherwise(F.lit(" "))
    flag = F.when(F.col("o_orderkey") % 2 == 0, " YES").otherwise("no")
    return t.orders.select("o_orderkey", X.parse_int(text).alias("i"), X.parse_float(text).alias("f"), X.parse_bool(flag).alias("b"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unknown' ELSE replace(lower(trim(c_mktsegment || ' Seg')), ' ', '_') END AS status FROM customer")
def q023_normalize_status(t: Tables):
    return t.customer.select("c_custkey", X.normalize_status(F.when(F.col("c_custkey") % 9 == 0, "  ").otherwise(F.concat("c_mktsegment", F.lit(" Seg")))).alias("status"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def q024_slugify(t: Tables):
    return t.part.select("p_partkey", X.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("""SELECT n.s_suppkey, regexp_replace(replace(lower(n.s_name || ' & Co.'), '&', 'and'), '[^a-z0-9]+', '', 'g') AS key, m.s_suppkey AS matched
FROM supplier n LEFT JOIN supplier m ON regexp_replace(lower(m.s_name), '[^a-z0-9]+', '', 'g') || 'andco' = regexp_replace(replace(lower(n.s_name || ' & Co.'), '&', 'and'), '[^a-z0-9]+', '', 'g') AND m.s_suppkey % 5 < 4""")
def q025_name_match_key(t: Tables):
    known = t.supplier.filter("s_suppkey % 5 < 4").select(F.col("s_suppkey").alias("matched"), X.name_key(F.concat("s_name", F.lit(" and CO"))).alias("key"))
    return t.supplier.select("s_suppkey", X.name_key(F.concat("s_name", F.lit(" & Co."))).alias("key")).join(known, "key", "left").select("s_suppkey", "key", "matched")


@query("""SELECT c_custkey, CASE WHEN c_acctbal / 4000 >= 0.5 THEN 'warm' WHEN c_acctbal / 4000 <= -0.5 THEN 'cool' ELSE 'neutral' END AS phase,
CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 4000 THEN 'medium' ELSE 'high' END AS band,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'flagged' WHEN c_acctbal < 0 THEN 'early' ELSE 'standard' END AS regime FROM customer""")
def q026_categorize(t: Tables):
    balance = F.col("c_acctbal")
    regime = X.first_match([(F.col("c_mktsegment") == "BUILDING", "flagged"), (balance < 0, "early")], "standard")
    return t.customer.select("c_custkey", X.climate_phase(balance / 4000).alias("phase"), X.bucketize(balance, [(0, "low"), (4000, "medium")], "high").alias("band"), regime.alias("regime"))


@query("SELECT c_custkey, c_name FROM customer WHERE substr(lpad(c_nationkey::VARCHAR, 2, '0'), 1, 1) = '0' AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q027_filter_geography(t: Tables):
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & X.normalize_code(F.col("c_nationkey"), 2).startswith("0")).select("c_custkey", "c_name")


@query("SELECT c_custkey, least(greatest(c_acctbal / 5000, 0), 1) AS component FROM customer")
def q028_bounded_linear_scale(t: Tables):
    return t.customer.select("c_custkey", X.scaled(F.col("c_acctbal"), 5000.0).alias("component"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN round(s_acctbal / (s_suppkey % 5) * 1000, 6) END AS density, CASE WHEN s_suppkey % 5 > 0 THEN '' ELSE 'missing_denominator' END AS flags FROM supplier")
def q029_density_and_rate(t: Tables):
    area = F.col("s_suppkey") % 5
    flags = X.flag_when(F.array().cast("array<string>"), ~(area > 0), "missing_denominator")
    return t.supplier.select("s_suppkey", X.round6(X.rate(F.col("s_acctbal"), area, 1000)).alias("density"), X.flags_text(flags).alias("flags"))


_FLAGS_SQL = """WITH f AS (SELECT o_orderkey, list_filter(list_transform(string_split(replace(' late; ' || o_orderstatus || ',,late,' || o_orderpriority, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS a FROM orders)"""


def _flags(t: Tables):
    return t.orders.select("o_orderkey", X.flags_split(F.concat(F.lit(" late; "), "o_orderstatus", F.lit(",,late,"), "o_orderpriority")).alias("a"))


@query(_FLAGS_SQL + " SELECT o_orderkey, array_to_string(a, '|') AS flags, len(a)::INT AS n FROM f")
def q100_flags_split(t: Tables):
    return _flags(t).select("o_orderkey", F.concat_ws("|", "a").alias("flags"), F.size("a").alias("n"))


@query(_FLAGS_SQL + " SELECT o_orderkey, 'base,late,' || a[2] || ',' || a[4] AS flags FROM f")
def q101_flags_union(t: Tables):
    return _flags(t).select("o_orderkey", X.flags_text(X.flags_union(F.array(F.lit("base"), F.lit("late")), F.col("a"))).alias("flags"))


@query(_FLAGS_SQL + " SELECT o_orderkey % 50 AS bucket, array_to_string(list_sort(list(DISTINCT x)), ',') AS flags FROM (SELECT o_orderkey, unnest(a) AS x FROM f) GROUP BY 1")
def q102_flags_sorted_union(t: Tables):
    return _flags(t).groupBy((F.col("o_orderkey") % 50).alias("bucket")).agg(X.flags_text(X.flags_sorted_union(F.col("a"))).alias("flags"))


@query(_FLAGS_SQL + " SELECT o_orderkey, CASE WHEN a[2] IN ('O', 'F') THEN 'late,' || a[2] ELSE 'late' END AS flags FROM f")
def q103_flags_allowlist(t: Tables):
    return _flags(t).select("o_orderkey", X.flags_text(X.flags_allowed(F.col("a"), ["F", "O", "late"])).alias("flags"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'deep_discount' END, CASE WHEN year(l_shipdate) < 1997 THEN 'before_1997' END) AS flags FROM lineitem")
def q104_flag_when(t: Tables):
    flags = X.flag_when(F.array().cast("array<string>"), F.col("l_discount") > 0.05, "deep_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.flags_text(X.flag_when(flags, F.year("l_shipdate") < 1997, "before_1997")).alias("flags"))


@query("SELECT DISTINCT l_shipdate::DATE AS d, isoyear(l_shipdate)::INT AS iso_year, week(l_shipdate)::INT AS iso_week, date_trunc('week', l_shipdate)::DATE AS week_start FROM lineitem")
def q105_iso_week(t: Tables):
    d = F.to_date("l_shipdate")
    return t.lineitem.select(d.alias("d"), X.iso_year(d).alias("iso_year"), X.iso_week(d).alias("iso_week"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week_start")).distinct()


@query("""WITH days AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem), starts AS (
  SELECT y, make_date(y, 1, 4) - dayofweek(make_date(y, 1, 4))::INT AS s FROM (SELECT unnest(range(1990, 2010)) AS y)
), placed AS (SELECT d, max(y) AS y, max(s) AS s FROM days JOIN starts ON s <= d GROUP BY d)
SELECT d, y::INT AS mmwr_year, ((d - s) // 7 + 1)::INT AS mmwr_week, (s + (7 * ((d - s) // 7))::INT)::DATE AS week_start FROM placed""")
def q106_mmwr_week(t: Tables):
    days = t.lineitem.select(F.to_date("l_shipdate").alias("d")).distinct()
    found = days.select("d", X.mmwr_year(F.col("d")).cast("int").alias("mmwr_year"), X.mmwr_week(F.col("d")).alias("mmwr_week"))
    return found.withColumn("week_start", X.mmwr_date(F.col("mmwr_year"), F.col("mmwr_week")))


@query("""SELECT l_suppkey, year(l_shipdate)::INT AS y, month(l_shipdate)::INT AS m, any_value(day(last_day(l_shipdate)))::INT AS expected, count(DISTINCT l_shipdate::DATE) AS days,
round(count(DISTINCT l_shipdate::DATE) / any_value(day(last_day(l_shipdate))), 6) AS completeness FROM lineitem GROUP BY 1, 2, 3""")
def q107_days_in_month(t: Tables):
    d = F.to_date("l_shipdate")
    rows = t.lineitem.select("l_suppkey", F.year(d).alias("y"), F.month(d).alias("m"), d.alias("d")).groupBy("l_suppkey", "y", "m")
    found = rows.agg(F.first(X.days_in_month(F.col("d"))).alias("expected"), F.countDistinct("d").alias("days"))
    return found.withColumn("completeness", X.round6(F.col("days") / F.col("expected")))


@query("""WITH w AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 90)::INT AS b FROM orders)
SELECT o_orderkey, greatest(least(b, make_date(year(a), 12, 31)) - a + 1, 0)::INT AS in_year,
  len(list_filter(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: month(d) BETWEEN 4 AND 9))::INT AS in_season FROM w""")
def q108_overlap_days(t: Tables):
    a = F.to_date("o_orderdate")
    rows = t.orders.select("o_orderkey", a.alias("a"), F.date_add(a, (F.col("o_orderkey") % 90).cast("int")).alias("b"))
    year_end = F.make_date(F.year("a"), F.lit(12), F.lit(31))
    season = F.size(F.filter(F.sequence("a", "b"), lambda d: F.month(d).between(4, 9)))
    return rows.select("o_orderkey", X.overlap_days(F.col("a"), F.col("b"), F.make_date(F.year("a"), F.lit(1), F.lit(1)), year_end).alias("in_year"), season.alias("in_season"))


@query("""WITH s AS (SELECT l_suppkey, min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem GROUP BY 1), c AS (SELECT *, unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 90 DAY)) AS c FROM s)
SELECT l_suppkey, c::DATE AS chunk_start, least(c::DATE + 89, b)::DATE AS chunk_end FROM c""")
def q109_date_chunks(t: Tables):
    """The days from a supplier's first to its last shipment, in pieces of 90."""
    spans = t.lineitem.groupBy("l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    rows = spans.select("l_suppkey", "b", F.explode(F.sequence("a", "b", F.expr("interval 90 days"))).alias("chunk_start"))
    return rows.select("l_suppkey", "chunk_start", F.least(F.date_add("chunk_start", 89), F.col("b")).alias("chunk_end"))


@query("SELECT DISTINCT o_orderdate::DATE AS d, month(o_orderdate)::INT AS m, o_orderdate::DATE AS us, NULL::INT AS none FROM orders")
def q110_month_number(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select(F.to_date(d).alias("d"), X.month_number(F.date_format(d, "MMMM")).alias("m"), X.parse_date(F.date_format(d, "M/d/yyyy")).alias("us"), X.month_number(F.lit("Smarch")).alias("none")).distinct()


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 6) AS r6, round_even(l_extendedprice / 2, 0)::BIGINT AS even FROM lineitem")
def q111_q112_rounding(t: Tables):
    price = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.round6(price / 7).alias("r6"), X.half_even(price / 2).alias("even"))


@query("""SELECT a.entity AS a, b.entity AS b, round(2 * 3958.8 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2
+ cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))), 4) AS miles FROM points a JOIN points b ON b.entity = a.entity + 1""", "points")
def q113_haversine(t: Tables):
    a, b = t.points(), t.points().select(F.col("entity").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    rows = a.join(b, F.col("b") == F.col("entity") + 1)
    return rows.select(F.col("entity").alias("a"), "b", F.round(X.haversine_miles(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")), 4).alias("miles"))


@query("""SELECT o_orderkey, round(o_totalprice * 25.4, 4) AS mm, round(ln(o_totalprice + 1), 6) AS log_offset, round(o_totalprice / 1e6 * 100000, 6) AS per_100k,
CASE WHEN o_custkey % 10 <> 0 THEN round((o_custkey - o_custkey % 10) / (o_custkey % 10) * 100, 6) END AS pct,
round((o_custkey % 7 * o_totalprice + 5 * 1000) / (o_custkey % 7 + 5), 6) AS shrunk FROM orders""")
def q114_q116_rates(t: Tables):
    price, k = F.col("o_totalprice"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey",
        F.round(X.inches_to_mm(price), 4).alias("mm"),
        X.round6(F.log(price + 1)).alias("log_offset"),
        X.round6(X.rate(price, F.lit(1e6), 1e5)).alias("per_100k"),
        X.round6(X.pct_change(k, k % 10)).alias("pct"),
        X.round6(X.shrunk_mean(price, k % 7, F.lit(1000.0), 5.0)).alias("shrunk"),
    )


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def q117_sha256(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""WITH u AS (SELECT page_id, url || '?token=' || page_id || 'x&q=1' AS c FROM pages)
SELECT page_id, regexp_replace(c, '((?:api_?key|key|token|secret|password)=)[^&\\s]+', '\\1***', 'gi') AS masked, true AS before, false AS after FROM u""".replace("\\\\", "\\"))
def q119_mask_secrets(t: Tables):
    text = F.concat("url", F.lit("?token="), "page_id", F.lit("x&q=1"))
    return t.pages.select("page_id", X.mask_secrets(text).alias("masked"), X.has_secret(text).alias("before"), X.has_secret(X.mask_secrets(text)).alias("after"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'missing' WHEN page_id % 4 = 1 THEN 'local' WHEN page_id % 4 = 2 THEN 'other' ELSE 'url' END AS kind,
regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def q120_url_and_path_class(t: Tables):
    k = F.col("page_id") % 4
    text = F.when(k == 0, " ").when(k == 1, "data/raw.csv").when(k == 2, "s3://bucket/key").otherwise(F.col("url"))
    return t.pages.select("page_id", X.locator_kind(text).alias("kind"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))


@query("SELECT s_nationkey, array_to_string(list_sort(list(s_suppkey)), ',') AS members, count(*) AS n FROM supplier GROUP BY 1")
def q121_explode_delimited_list(t: Tables):
    joined = t.supplier.groupBy("s_nationkey").agg(F.concat_ws(",", F.collect_list(F.col("s_suppkey").cast("string"))).alias("listed"))
    each = joined.select("s_nationkey", F.explode(F.split("listed", ",").cast("array<bigint>")).alias("m"))
    return each.groupBy("s_nationkey").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("m")), lambda x: x.cast("string"))).alias("members"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 3 AND 12 THEN 2007 + p_size END::INT AS year FROM part WHERE p_size BETWEEN 3 AND 12")
def q009_decode_period_code(t: Tables):
    return t.part.select("p_partkey", X.decode_period(F.col("p_size"), 3, 12, 2007).alias("year")).filter("year IS NOT NULL")
