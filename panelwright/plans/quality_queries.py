"""Queries of contracts, audits and lineage, and of graphs and clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwright.functions.expressions import slugify
from panelwright.operators import graph as G
from panelwright.operators import joins as J
from panelwright.operators import lineage as L
from panelwright.operators import quality as Q
from panelwright.operators import windows as W
from panelwright.operators.storage import settled, shared_root
from panelwright.plans.base import query
from panelwright.plans.join_queries import _EDGES, edges, half_edges
from panelwright.plans.views import Tables
from panelwright.plans.window_queries import R6


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q126_assert_unique_key(t: Tables):
    return Q.duplicate_keys(t.lineitem, ["l_orderkey", "l_suppkey"])


@query("""SELECT 'balance' AS rule, count(*) FILTER (WHERE NOT c_acctbal >= 0) AS n_violations, count(*) AS n_rows FROM customer UNION ALL SELECT 'segment', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')), count(*) FROM customer
UNION ALL SELECT 'key', 0, count(*) FROM customer""")
def q127_validate_contract(t: Tables):
    return Q.contract_violations(t.customer, {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "key": F.col("c_custkey").isNotNull()})


@query("SELECT 'run' AS field, 1::BIGINT AS n_values, 'r1' AS value UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END FROM orders")
def q128_single_value_or_error(t: Tables):
    return Q.single_values(t.orders.withColumn("run", F.lit("r1")), ["run", "o_orderstatus"])


@query("""WITH m AS (SELECT page_id, url AS u0, CASE WHEN page_id % 5 = 0 THEN 'ftp://x' WHEN page_id % 5 = 1 THEN url || '?token=abc' ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN 'zz' ELSE sha256(html) END AS sum, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'get' END AS cmd, CASE WHEN page_id % 13 = 0 THEN -1 ELSE 1 END AS size FROM pages)
SELECT page_id, 'url' AS field, 'not an http url' AS message FROM m WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'url', 'secret-like value' FROM m WHERE page_id % 5 = 1 UNION ALL SELECT page_id, 'sum', 'not a sha-256' FROM m WHERE page_id % 7 = 0
UNION ALL SELECT page_id, 'cmd', 'no command' FROM m WHERE page_id % 11 = 0 UNION ALL SELECT page_id, 'size', 'negative or missing size' FROM m WHERE page_id % 13 = 0""")
def q129_provenance_audit(t: Tables):
    k = F.col("page_id")
    url = F.when(k % 5 == 0, "ftp://x").when(k % 5 == 1, F.concat("url", F.lit("?token=abc"))).otherwise(F.col("url"))
    rows = t.pages.select("page_id", F.lit("page").alias("name"), url.alias("url"), F.when(k % 7 == 0, "zz").otherwise(F.sha2("html", 256)).alias("sum"), F.when(k % 11 == 0, "").otherwise("get").alias("cmd"), F.when(k % 13 == 0, -1).otherwise(1).alias("size"))
    return Q.audit(rows, "page_id", Q.manifest_rules({"name": "name", "url": "url", "checksum": "sum", "bytes": "size", "command": "cmd"}))


_ROW_TEXT = "concat_ws(',', " + ", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")) + ")"
_ROW_SUMS = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT), 0)::VARCHAR" for i in range(4))


@query(f"""SELECT 'customer' AS source_id, 'https://example.org/customer' AS source_url, 'load customer' AS command, 'parquet' AS method, TIMESTAMP '2000-01-01 00:00:00' AS retrieved_at, count(*) AS row_count, sha256(concat_ws(',', {_ROW_SUMS})) AS rows_sha256
FROM (SELECT sha256({_ROW_TEXT}) AS h FROM customer)""")
def q130_provenance_record(t: Tables):
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return Q.provenance_record(rows, "customer", "https://example.org/customer", "load customer", "parquet", F.lit("2000-01-01 00:00:00").cast("timestamp"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'removed' WHEN o_totalprice <= 20000 THEN 'added' ELSE 'changed' END AS change FROM orders WHERE o_totalprice >= 300000 OR o_totalprice <= 20000 OR o_orderstatus = 'P'""")
def q130_changed_rows(t: Tables):
    """Two versions of the orders, compared by their trees of digests."""
    root = f"{shared_root(t.spark)}/lineage-{uuid.uuid4().hex}"
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    L.write_version(rows.filter("o_totalprice > 20000"), f"{root}/old", ["o_orderkey"], 64)
    later = F.when(F.col("o_orderstatus") == "P", "moved").otherwise(F.col("o_orderpriority"))
    L.write_version(rows.filter("o_totalprice < 300000").withColumn("o_orderpriority", later), f"{root}/new", ["o_orderkey"], 64)
    return L.changed_rows(t.spark, f"{root}/old", f"{root}/new", ["o_orderkey"])


@query("SELECT s_suppkey, s_name || '1' AS \"left\", s_name AS \"right\" FROM supplier WHERE s_suppkey % 4 = 0")
def q131_checksum_match(t: Tables):
    a = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.concat("s_name", F.lit("1"))).otherwise(F.col("s_name")).alias("c"))
    return Q.checksum_mismatches(a, t.supplier.select("s_suppkey", F.col("s_name").alias("c")), ["s_suppkey"], "c")


@query("""WITH f AS (SELECT entity, period, max(cases) OVER (PARTITION BY entity) AS x FROM panel_gappy), p AS (SELECT entity, period, max(cases) OVER (PARTITION BY entity) AS x FROM panel_gappy WHERE period <= 1998)
SELECT f.entity, f.period, 'leaky' AS "column", f.x::VARCHAR AS "full", p.x::VARCHAR AS past FROM f JOIN p USING (entity, period) WHERE f.x <> p.x""", "panel_gappy")
def q132_leakage_check(t: Tables):
    from pyspark.sql.window import Window

    def build(rows):
        safe = W.trailing_mean_rows(rows, ["entity"], "period", "cases", 3)
        return safe.withColumn("leaky", F.max("cases").over(Window.partitionBy("entity"))).select("entity", "period", "trailing_mean", "leaky")

    return Q.leakage(build, t.panel_gappy(), "entity", "period", 1998)


@query("""WITH c AS (SELECT (s_suppkey // 3 + 1) * 5 AS entity, s_suppkey AS station, s_acctbal FROM supplier), n AS (SELECT entity, count(*) AS candidates FROM c GROUP BY 1),
b AS (SELECT entity, string_agg(station, ',' ORDER BY r) AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s_acctbal DESC, station) AS r FROM c WHERE s_acctbal >= 6000) WHERE r <= 2 GROUP BY 1),
m AS (SELECT a.entity, b.entity AS station, round(2 * 3958.8 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))), 6) AS miles FROM points a, points b WHERE b.entity % 6 = 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY miles, station) AS r FROM m) WHERE r = 1)
SELECT p.entity, coalesce(candidates, 0) AS candidates, chosen, CASE WHEN chosen IS NOT NULL THEN 'ok' WHEN station IS NOT NULL THEN 'needs_fallback' ELSE 'error' END AS status, CASE WHEN chosen IS NULL THEN station END AS fallback, CASE WHEN chosen IS NULL THEN round(miles, 4) END AS miles
FROM points p LEFT JOIN n USING (entity) LEFT JOIN b USING (entity) LEFT JOIN f USING (entity)""", "points")
def q133_coverage_audit(t: Tables):
    candidates = t.supplier.select(((F.floor(F.col("s_suppkey") / 3) + 1) * 5).alias("entity"), F.col("s_suppkey").alias("station"), "s_acctbal")
    stations = t.points().filter("entity % 6 = 1").select(F.col("entity").alias("station"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    fallback = J.nearest_k(t.points(), stations, 1)
    found = Q.coverage_audit(t.points(), candidates, "entity", F.col("s_acctbal") >= 6000, [F.desc("s_acctbal"), F.col("station")], 2, fallback)
    return found.withColumn("miles", F.round(F.round("miles", 6), 4))


@query("SELECT 'orders' AS artifact, count(*) AS records FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'nation', count(*) FROM nation")
def q134_artifact_counts(t: Tables):
    return Q.artifact_counts({"orders": t.orders, "lineitem": t.lineitem, "nation": t.nation})


_NODES = "nodes AS (SELECT entity AS node, period, cases::DOUBLE AS v FROM panel_supplier)"
_SIMILAR = f"""{_EDGES}, {_NODES}, near AS (SELECT src, dst, a.period FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst AND a.period = b.period WHERE abs(a.v - b.v) <= 2)"""


def _similar(t: Tables, half):
    nodes = t.panel_supplier().select(F.col("entity").alias("node"), "period", F.col("cases").cast("double").alias("v"))
    nodes = settled(nodes)
    return nodes, settled(G.similar_edges(_ends(half), nodes, ["period"], {"v": 2}))  # each edge once; read by every round


def _ends(half):
    return half.select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def q173_normalize_edges(t: Tables):
    half = edges(t).select("src", "dst").filter("src < dst")
    return G.normalize_edges(half.unionByName(half).unionByName(half.select("src", F.col("src").alias("dst"))))


@query(f"WITH {_SIMILAR} SELECT period, src, dst FROM near", "panel_supplier")
def q174_filter_similar_edges(t: Tables):
    near = _similar(t, half_edges(t))[1]
    return near.unionByName(near.select("period", F.col("dst").alias("src"), F.col("src").alias("dst")))


_REACH = f"""WITH RECURSIVE {_SIMILAR}, reach AS (SELECT period, node, node AS other FROM nodes UNION SELECT r.period, r.node, n.dst FROM reach r JOIN near n ON n.period = r.period AND n.src = r.other)
SELECT period, node, min(other) AS component FROM reach GROUP BY 1, 2""".replace("WITH RECURSIVE", "WITH RECURSIVE panel_supplier AS (SELECT s_nationkey AS grp, l_suppkey AS entity, year(l_shipdate)::INT AS period, count(*) AS cases, sum(l_quantity) AS denom FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),")


@query(_REACH)
def q175_connected_components(t: Tables):
    nodes, near = _similar(t, half_edges(t))
    return G.components(nodes, near, ["period"], closed=True)


@query(_REACH)
def q175_components_repaired(t: Tables):
    """The components as they stood before each period's last month of shipments, repaired for the whole period."""
    earlier = t.lineitem.filter(F.month("l_shipdate") < 12).groupBy(F.col("l_suppkey").alias("node"), F.year("l_shipdate").alias("period")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    earlier = settled(earlier.join(t.supplier.select(F.col("s_suppkey").alias("node")), "node"))
    half = half_edges(t)
    before = settled(G.similar_edges(_ends(half), earlier, ["period"], {"v": 2}))
    nodes, near = _similar(t, half)
    return G.repaired_components(G.components(earlier, before, ["period"], closed=True), before, nodes, near, ["period"])


@query()
def q170_kmeans_1d(t: Tables):
    return G.kmeans_1d(t.panel_supplier().withColumn("v", F.col("cases").cast("double")), "period", "v", 5)


def _clusters(t: Tables):
    history = W.history_summary(t.rates(), ["entity"], "period", "rate", 4, 2).withColumn("v", R6("h_mean"))
    clusters = G.kmeans_1d(history, "period", "v", 4)
    labels = F.array(*[F.lit(x) for x in ("low", "medium", "high", "very_high")])
    return history.join(clusters, ["period", "v"]).withColumn("label", F.get(labels, F.col("cluster")))


@query()
def q171_incidence_clusters(t: Tables):
    return _clusters(t).select("entity", "period", "v", "cluster", "label")


@query()
def q171_incidence_cluster_summary(t: Tables):
    from panelwright.operators.panel_models import cluster_summary

    found = cluster_summary(_clusters(t), ["period", "cluster", "label"], "v", "cases", "denom")
    return found.withColumns({c: R6(F.col(c)) for c in ("mean", "sd", "rate")})


def _cells(t: Tables):
    """Square cells of a grid forty wide, one for each customer, as rings."""
    x, y = (F.col("c_custkey") % 40).cast("double"), F.floor(F.col("c_custkey") / 40).cast("double")
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return t.customer.select(F.col("c_custkey").alias("entity"), F.array(ring).alias("rings"))


@query("""WITH cells AS (SELECT c_custkey AS entity, c_custkey % 40 AS x, c_custkey // 40 AS y FROM customer)
SELECT a.entity AS a, b.entity AS b, 1::BIGINT AS shared FROM cells a JOIN cells b ON a.entity < b.entity AND (a.y = b.y AND b.x = a.x + 1 OR a.x = b.x AND b.y = a.y + 1)""")
def q172_edges_from_polygons(t: Tables):
    return J.self_pairs(G.ring_segments(_cells(t), "entity", "rings"), "entity", "segment")


@query()
def q177_simplify_polygons(t: Tables):
    steps = F.sequence(F.lit(0), F.lit(60))
    ring = F.transform(steps, lambda i: F.array(F.col("lon") + F.cos(i * 0.1047197551), F.col("lat") + F.sin(i * 0.1047197551)))
    rows = t.points().select("entity", ring.alias("ring")).withColumn("before", F.size("ring"))
    thin = G.thin_rings(rows, "ring", 0.35, 4)
    return thin.select("entity", "before", F.size("ring").alias("after"), F.to_json("ring").alias("ring"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def q024_slugify_nation(t: Tables):
    return t.part.select("p_partkey", slugify(F.col("p_name")).alias("slug"))
