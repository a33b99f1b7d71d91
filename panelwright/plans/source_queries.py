"""Queries of readers, writers and streams: files are derived from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwright.operators.storage import shared_root
from panelwright.plans.base import query
from panelwright.plans.views import Tables
from panelwright.sources import keyed as K
from panelwright.sources import readers as R
from panelwright.sources import sinks as S
from panelwright.streaming import streams


def _folder(t: Tables, name: str) -> str:
    return f"{shared_root(t.spark)}/{name}-{uuid.uuid4().hex}"


def _lines(t: Tables, df, name: str) -> str:
    path = _folder(t, name)
    df.write.text(path)
    return path


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def q001_read_delimited(t: Tables):
    path = _folder(t, "customers")
    t.customer.select(F.col("c_custkey").alias(" c_custkey "), "c_name", "c_mktsegment").write.option("header", True).option("sep", "|").csv(path)
    return R.read_delimited(t.spark, path, ["c_custkey", "c_name"], sep="|")


@query("SELECT l_orderkey::VARCHAR AS key, l_shipmode AS mode, total FROM (SELECT l_orderkey, l_returnflag AS l_shipmode, (l_partkey + l_suppkey)::BIGINT AS total FROM lineitem)")
def q002_read_headerless_delimited(t: Tables):
    line = F.concat_ws(",", F.when(F.col("l_linenumber") > 0, F.col("l_orderkey").cast("string")), "l_returnflag", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    noise = t.nation.select(F.concat(F.lit("Header,"), "n_name", F.lit(",,")).alias("value"))
    path = _lines(t, t.lineitem.select(line.alias("value")).unionByName(noise), "positional")
    return R.read_headerless(t.spark, path, 4, {"key": 0, "mode": 1}, {"total": [2, 3]})


@query("SELECT s_suppkey::VARCHAR AS a, s_nationkey::VARCHAR AS b, 'x' AS c, 'y' AS d FROM supplier")
def q003_read_fixed_token_text(t: Tables):
    good = t.supplier.select(F.concat_ws("   ", F.lit(""), "s_suppkey", "s_nationkey", F.lit("x"), F.lit("y ")).alias("value"))
    bad = t.nation.select(F.concat(F.lit("SEAS YR "), "n_name").alias("value")).unionByName(t.region.select(F.col("r_name").alias("value")))
    return R.read_tokens(t.spark, _lines(t, good.unionByName(bad), "tokens"), ["a", "b", "c", "d"], "SEAS")[0]


@query("SELECT d AS date, CASE WHEN v > -999 THEN v END AS value FROM (SELECT make_date(year, period, 1) AS d, CASE WHEN period = 2 THEN -999.9 ELSE cases END::DOUBLE AS v FROM season)", "season")
def q004_read_sentinel_series(t: Tables):
    value = F.when(F.col("period") == 2, F.lit(-999.9)).otherwise(F.col("cases").cast("double"))
    rows = t.season().select(F.make_date("year", "period", F.lit(1)).cast("string").alias("date"), value.cast("string").alias("value"))
    path = _folder(t, "series")
    rows.unionByName(t.region.select(F.lit("1999-01-15").alias("date"), F.lit("1").alias("value"))).write.option("header", True).csv(path)
    return R.read_sentinel_series(t.spark, path)[0]


@query("SELECT entity, period::INT AS period, sum(cases)::BIGINT AS value FROM panel_supplier GROUP BY 1, 2", "panel_supplier")
def q005_unpivot_period_columns(t: Tables):
    rows = t.panel_supplier()
    names = {r.period: f"{'Cases' if r.period % 2 else 'cases'}{r.period}" for r in rows.select("period").distinct().collect()}  # a column a year
    wide = rows.groupBy("entity").agg(*[F.sum(F.when(F.col("period") == y, F.col("cases"))).alias(n) for y, n in names.items()])
    return R.unpivot_periods(wide, ["entity"], r"cases(\d{4})").filter("value IS NOT NULL")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, i::INT AS i, (json_extract(props, '$.k')::BIGINT + i)::BIGINT AS v FROM events, (SELECT unnest([0, 1, 2]) AS i)")
def q006_flatten_json_records(t: Tables):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = t.events.select("event_id", k.alias("k"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("i"), (k + i).alias("v"))).alias("a"))
    text = rows.select("event_id", "k", F.to_json("a").alias("json"))
    records = R.flatten_records(text, "json", "array<struct<i:int,v:bigint>>")
    arrays = records.groupBy("event_id", "k").agg(F.sort_array(F.collect_list("i")).alias("i"), F.sort_array(F.collect_list("v")).alias("v"))
    return R.zip_parallel(arrays, ["i", "v"])[0]


@query("SELECT entity, d, max(value) FILTER (WHERE datatype = 'click') AS click, max(value) FILTER (WHERE datatype = 'view') AS view, max(value) FILTER (WHERE datatype = 'purchase') AS purchase FROM obs_eav GROUP BY 1, 2", "obs_eav")
def q007_pivot_observations(t: Tables):
    return R.pivot_observations(t.obs_eav().withColumn("seq", F.col("value")), ["entity", "d"], "datatype", "value", ["click", "view", "purchase"], "seq")


@query("SELECT s_nationkey AS grp, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS record, s_name AS NAME, s_suppkey::VARCHAR AS KEY, NULL::VARCHAR AS NONE FROM supplier")
def q008_read_array_table(t: Tables):
    rows = t.supplier.groupBy(F.col("s_nationkey").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("r"))
    body = F.transform("r", lambda x: F.array(x.s_suppkey.cast("string"), x.s_name))
    text = rows.select("grp", F.to_json(F.concat(F.array(F.array(F.lit("KEY"), F.lit("NAME"))), body)).alias("json"))
    return R.array_table(text, "grp", "json", ["NAME", "KEY", "NONE"])


@query("SELECT lpad(s_suppkey::VARCHAR, 5, '0') AS id, s_name AS name, s_nationkey::VARCHAR AS grp, 'Point' AS geometry FROM supplier WHERE s_nationkey IN (1, 3)")
def q010_read_geojson_features(t: Tables):
    key = F.when(F.col("s_suppkey") % 2 == 0, "GEOID").otherwise("geoid")
    props = F.map_from_arrays(F.array(key, F.lit("NAME"), F.lit("STATE")), F.array(F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_nationkey").cast("string")))
    feature = F.struct(props.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.5), F.lit(2.5)).alias("coordinates")).alias("geometry"))
    path = _lines(t, t.supplier.groupBy(F.floor(F.col("s_suppkey") / 100)).agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct("features")).alias("value")), "geojson")
    found = R.geojson_features(t.spark.read.text(path), "value", ["GEOID", "geoid"], ["NAME"], ["STATE"], ["1", "3"], 5)
    return found.drop("coordinates")


@query("""WITH l AS (SELECT doc_id, 'Total: ' || n_chars || ' 1,234 7' AS a FROM documents) SELECT doc_id, 1::INT AS line, 'total' AS label, (1999 + i)::INT AS period, CASE i WHEN 1 THEN n_chars WHEN 2 THEN 1234 ELSE 7 END::BIGINT AS value
FROM documents, (SELECT unnest([1, 2, 3]) AS i) WHERE n_chars >= 0""")
def q011_parse_text_table_lines(t: Tables):
    text = F.concat(F.lit("Report\n Total: "), F.col("n_chars").cast("string"), F.lit(" 1,234 7\nTotal: 5\n"))
    rows = t.documents.select("doc_id", text.alias("text"))
    return R.text_table_lines(rows, "doc_id", "text", {"Total: ": "total"}, 3, 2000)[0]


@query("SELECT doc_id, i::INT AS block, CASE i WHEN 1 THEN source ELSE lang END AS label, CASE i WHEN 1 THEN n_chars END::BIGINT AS chars, i::BIGINT AS rank FROM documents, (SELECT unnest([1, 2]) AS i)")
def q012_extract_labelled_blocks(t: Tables):
    text = F.concat(F.lit("head\nPart: "), "source", F.lit("\nchars: "), F.col("n_chars").cast("string"), F.lit(", rank: 1\nPart: "), "lang", F.lit("\nrank: 2\n"))
    return R.labelled_blocks(t.documents.select("doc_id", text.alias("text")), "doc_id", "text", "Part", ["chars", "rank"])


@query("SELECT s_suppkey, 'manual_entry,check_source' || CASE WHEN s_suppkey % 2 = 0 THEN ',late' ELSE '' END AS flags FROM supplier")
def q014_read_manual_observations(t: Tables):
    path = _folder(t, "manual")
    own = F.when(F.col("s_suppkey") % 2 == 0, "late, manual_entry").otherwise("")
    t.supplier.select("s_suppkey", own.alias("flags")).write.option("header", True).csv(path)
    rows = R.read_delimited(t.spark, path, ["flags"]).select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "flags")
    return R.manual_observations(rows, "flags", ["manual_entry", "check_source"])


@query("SELECT entity, period, cases FROM panel_supplier", "panel_supplier")
def q015_write_table(t: Tables):
    path = _folder(t, "panel")
    S.write_table(t.panel_supplier(), path, ["entity", "period", "cases"], ["entity", "period"], in_order=True)
    return t.spark.read.parquet(path)


@query("SELECT entity, period, CASE WHEN period >= 1998 THEN cases + 1 ELSE cases END::BIGINT AS cases FROM panel_supplier", "panel_supplier")
def q016_upsert_versions(t: Tables):
    root, rows = _folder(t, "versions"), t.panel_supplier().select("entity", "period", "cases")
    K.write_upsert(rows.filter("period < 2000"), root, ["entity", "period"])
    K.write_upsert(rows.filter("period >= 1998").withColumn("cases", F.col("cases") + 1), root, ["entity", "period"])
    return K.read_upserts(t.spark, root)


@query("SELECT entity, array_to_string(list_sort(list(DISTINCT period)), ',') AS periods, max(cases) AS max_score FROM panel_gappy GROUP BY 1", "panel_gappy")
def q018_write_json_export(t: Tables):
    root = _folder(t, "export")
    rows = t.panel_gappy().select("entity", "period", "cases", (F.col("cases") - 1).alias("lo"), (F.col("cases") + 1).alias("hi"), F.lit("a,,b").alias("flags"))
    S.write_export(rows, root, "entity", "period", "cases", ("lo", "hi"), "flags")
    back = t.spark.read.schema("entity bigint, periods array<int>, max_score bigint").json(f"{root}/metadata")
    return back.select("entity", F.array_join(F.transform("periods", lambda x: x.cast("string")), ",").alias("periods"), "max_score")


@query("SELECT n_nationkey, coalesce(string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey), '') AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def q019_attach_nested_records(t: Tables):
    found = S.attach_nested(t.nation.select("n_nationkey"), t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", ["s_suppkey", "s_name"], "members")
    return found.select("n_nationkey", F.array_join(F.transform("members", lambda m: F.concat(m.s_suppkey.cast("string"), F.lit(":"), m.s_name)), ",").alias("members"))


def _event_stream(t: Tables, df):
    path = _folder(t, "stream-in")
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def q122_stream_upsert(t: Tables):
    root = _folder(t, "stream-table")
    rows = _event_stream(t, t.events.select("user_id", "event_id", "value"))
    streams.stream_upsert(rows, root, ["user_id"], "event_id", _folder(t, "stream-state")).awaitTermination()
    return K.read_upserts(t.spark, root)


@query("""WITH w AS (SELECT event_type, date_trunc('week', ts)::DATE AS week_start, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1, 2) SELECT * FROM w""")
def q123_stream_calendar_rollup(t: Tables):
    """A row far ahead closes every week; its own week stays open and isn't given out."""
    last = t.events.select("event_type", "ts", "value")
    closing = t.events.limit(1).select("event_type", F.to_timestamp(F.lit("2100-01-01")).alias("ts"), F.lit(0.0).alias("value"))
    state, out = _folder(t, "stream-state"), _folder(t, "stream-out")
    rows = _event_stream(t, last.unionByName(closing))
    weeks = streams.stream_calendar_rollup(rows, "event_type", "ts", "value")
    weeks.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(weeks.schema).parquet(out).withColumn("total", F.round("total", 4))


@query("""WITH w AS (SELECT min(date_trunc('week', ts)) AS a, max(date_trunc('week', ts)) AS b FROM events), f AS (SELECT user_id, unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS week_start FROM (SELECT DISTINCT user_id FROM events), w)
SELECT f.user_id, week_start::DATE AS week_start, event_id, round(value - 50, 6) AS residual, CASE WHEN value IS NULL THEN 'pending' WHEN f.user_id > 100 THEN 'late_data' WHEN value BETWEEN 40 AND 60 THEN 'expected' WHEN value - 50 > 5 THEN 'higher_than_expected' ELSE 'lower_than_expected' END AS interpretation
FROM f LEFT JOIN events e ON e.user_id = f.user_id AND e.ts >= week_start AND e.ts < week_start + INTERVAL 7 DAY""")
def q124_stream_update_audit(t: Tables):
    """A forecast a user and week against the week's events, both as streams; rows far ahead close every week."""
    state, out = _folder(t, "stream-state"), _folder(t, "stream-out")
    rows = t.events.select("user_id", "event_id", F.col("value").alias("actual"), F.to_timestamp("ts").alias("seen"))
    ends = rows.agg(F.date_trunc("week", F.min("seen")).alias("a"), F.date_trunc("week", F.max("seen")).alias("b"))  # one row
    weeks = rows.select("user_id").distinct().crossJoin(F.broadcast(ends)).select("user_id", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week_start"))
    ahead = F.to_timestamp(F.lit("2100-01-01"))
    closing = t.spark.range(1)
    made = weeks.unionByName(closing.select(F.lit(-1).cast("bigint").alias("user_id"), ahead.alias("week_start")))
    forecasts = made.select("user_id", "week_start", F.lit(50.0).alias("predicted"), F.lit(40.0).alias("lower_95"), F.lit(60.0).alias("upper_95"))
    observed = rows.unionByName(closing.select(F.lit(-2).cast("bigint").alias("user_id"), F.lit(None).cast(rows.schema["event_id"].dataType).alias("event_id"), F.lit(0.0).alias("actual"), ahead.alias("seen")))
    audit = streams.stream_update_audit(_event_stream(t, observed), _event_stream(t, forecasts), ["user_id"], "week_start", "seen", "7 days", F.col("user_id"), F.lit(100), 5.0)
    audit = audit.select("user_id", F.to_date("week_start").alias("week_start"), "event_id", F.round("residual", 6).alias("residual"), "interpretation")
    audit.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(audit.schema).parquet(out)
