"""Small cases by hand, error paths, invariants, leakage and partition invariance."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import expressions as X
from panelwright.operators import aggregates as A
from panelwright.operators import forecast as M
from panelwright.operators import graph as G
from panelwright.operators import joins as J
from panelwright.operators import quality as Q
from panelwright.operators import sets as S
from panelwright.operators import windows as W
from panelwright.operators.features import MOST_CATEGORIES, categories, design_matrix
from panelwright.sources import keyed
from panelwright.sources import readers as R
from panelwright.streaming import streams


def panel(spark, rows=None):
    rows = rows or [("g1", "a", 2000, 5.0), ("g1", "a", 2001, 7.0), ("g1", "a", 2003, 9.0), ("g1", "b", 2000, 5.0), ("g1", "b", 2001, None), ("g2", "c", 2003, 0.0)]
    return spark.createDataFrame(rows, "grp string, entity string, period int, v double")


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_text_forms(spark):
    df = spark.createDataFrame([("1,234",), (" u ",), (None,), ("12.0",), ("x",), ("-",)], "c string")
    assert [r[0] for r in df.select(X.parse_count(F.col("c"))).collect()] == [1234, 0, 0, 12, None, 0]
    assert [r[0] for r in df.select(X.parse_int(F.col("c"))).collect()] == [None, None, None, 12, None, None]
    assert [r[0] for r in df.select(X.normalize_code(F.col("c"))).collect()] == [None, None, None, "00012", None, None]
    assert [r[0] for r in df.select(X.normalize_status(F.col("c"))).collect()][:3] == ["1,234", "u", "unknown"]


def test_epidemiological_weeks(spark):
    days = {"1998-01-03": (1997, 53), "1998-01-04": (1998, 1), "2000-01-01": (1999, 52), "2000-01-02": (2000, 1), "2008-12-31": (2008, 53), "2009-01-03": (2008, 53), "2020-02-29": (2020, 9)}
    df = spark.createDataFrame([(d,) for d in days], "s string").withColumn("d", F.to_date("s"))
    got = {r.s: (r.y, r.w) for r in df.select("s", X.mmwr_year(F.col("d")).alias("y"), X.mmwr_week(F.col("d")).alias("w")).collect()}
    assert got == days
    back = df.select(X.mmwr_date(X.mmwr_year(F.col("d")), X.mmwr_week(F.col("d"))).alias("a"), "d").collect()
    assert all(datetime.timedelta(0) <= r.d - r.a < datetime.timedelta(7) and r.a.weekday() == 6 for r in back)


def test_flags_keep_first_order(spark):
    df = spark.createDataFrame([("b; a,,b ",), (None,)], "f string").withColumn("x", X.flags_split(F.col("f")))
    assert [r[0] for r in df.select(X.flags_text(X.flags_union(F.array(F.lit("c"), F.lit("a")), F.col("x")))).collect()] == ["c,a,b", "c,a"]
    assert [r[0] for r in df.select(X.flags_text(X.flags_allowed(F.col("x"), ["a", "b"]))).collect()] == ["b,a", ""]


def test_half_even_scores(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "v double")
    assert [r[0] for r in df.select(X.half_even(F.col("v"))).collect()] == [0, 2, 2, 0]


def test_ranks_break_ties_by_entity_and_skip_nulls(spark):
    got = values(W.rank_tier(panel(spark), ["period"], "v", "entity"), "entity", "period", "rank", "percentile", "tier")
    assert ("a", 2000, 1, 1.0, "top_decile") in got and ("b", 2000, 2, 0.0, "lower_half") in got
    assert ("b", 2001, None, None, None) in got and ("a", 2001, 1, 1.0, "top_decile") in got
    labelled = W.rank_tier(panel(spark), ["period"], "v", "entity", none_label="none")
    assert ("c", 2003, "none") in values(labelled, "entity", "period", "tier")


def test_prior_means_the_calendar_predecessor(spark):
    got = values(W.prior_period(panel(spark), ["entity"], "period", ["v"]), "entity", "period", "prior_v")
    assert ("a", 2001, 5.0) in got and ("a", 2003, None) in got
    rows = values(W.trailing_mean_rows(panel(spark), ["entity"], "period", "v", 2), "entity", "period", "trailing_mean")
    assert ("a", 2003, 6.0) in rows


def test_quantile_definitions_differ(spark):
    df = spark.createDataFrame([(float(i),) for i in (4, 1, 3, 2)], "v double").withColumn("k", F.lit(0))
    assert W.quantile_nearest(df, ["k"], "v", {"p": 0.5}).first().p == 2.0
    assert W.quantile_linear(df, ["k"], "v", {"p": 0.5}).first().p == 2.5


def test_longest_run_is_over_rows(spark):
    rows = [("a", d, x) for d, x in [(1, True), (2, None), (5, True), (6, False), (7, True)]]
    df = spark.createDataFrame(rows, "e string, d int, h boolean")
    assert A.longest_run(df, ["e"], "d", F.col("h")).first().longest == 2


def test_reconciliation_prefers_known_sources(spark):
    rows = [("k", "z", 3), ("k", "b", 4), ("k", "y", 4), ("m", "a", 1), ("n", "y", 2), ("n", "z", 2)]
    df = spark.createDataFrame(rows, "k string, s string, n int")
    got = values(A.reconcile_sources(df, ["k"], "s", "n", ["a", "b"]), "k", "total", "source", "status", "summary", "flags")
    assert got == [("k", 4, "b", "conflict", "b=4;y=4;z=3", "source_conflict,fallback_source"), ("m", 1, "a", "single", "a=1", ""), ("n", 2, "y", "matched", "y=2;z=2", "fallback_source")]


def test_strict_joins_raise(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(J.KeyMismatch):
        J.attach_strict(a, b, ["k"])
    with pytest.raises(J.KeyMismatch):
        J.attach_strict(a, b.limit(1), ["k"])
    with pytest.raises(J.KeyMismatch):
        J.join_exact_cover(a, b, ["k"])
    with pytest.raises(J.KeyMismatch):
        J.select_branch(b, ["v"], k=1)
    with pytest.raises(Exception, match="lacks"):
        J.join_complete(a, [b], ["k"]).collect()
    with pytest.raises(Exception, match="disagree"):
        A.consistent(b, ["k"], "v", []).collect()
    with pytest.raises(R.MissingColumns):
        R.require_columns(a, ["k", "q"])
    with pytest.raises(R.MissingColumns):
        R.require_columns(a, [], [["x", "y"]])
    with pytest.raises(Q.ContractError):
        Q.require(Q.duplicate_keys(b, ["k"]), "keys repeat")


def test_complete_periods_need_every_member(spark):
    rows = [("g", "a", 1, 1), ("g", "b", 1, 2), ("g", "a", 2, 5), ("h", "c", 2, 7)]
    df = spark.createDataFrame(rows, "g string, e string, t int, n int")
    assert values(A.complete_periods(df, "g", "e", "t", "n"), "g", "t", "total") == [("g", 1, 3), ("h", 2, 7)]
    assert values(A.latest_complete_period(df, "g", "e", "t", "n"), "g", "latest") == [("g", 1), ("h", 2)]


def test_components_partition_nodes_and_hold_edges(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(40)] + [(1, i) for i in range(5)], "t int, node long")
    pairs = [(i, i + 1) for i in range(19)] + [(30, 35), (35, 31), (39, 38)]
    edges = spark.createDataFrame([(0, a, b) for a, b in pairs], "t int, src long, dst long")
    got = {(r.t, r.node): r.component for r in G.components(nodes, edges, ["t"]).collect()}
    assert all(got[0, i] == 0 for i in range(20)) and got[0, 35] == got[0, 31] == 30 and got[0, 39] == 38
    assert all(got[1, i] == i for i in range(5)) and len(got) == 45


def test_kmeans_assigns_the_nearest_centroid(spark):
    rng = np.random.default_rng(3)
    points = [(g, float(v)) for g in (1, 2) for v in np.round(np.concatenate([rng.normal(m, 0.3, 40) for m in (0, 5, 9)]), 3)]
    got = G.kmeans_1d(spark.createDataFrame(points, "g int, v double"), "g", "v", 3).collect()
    for g in (1, 2):
        cluster = {r.v: r.cluster for r in got if r.g == g}
        weights = [p for p in points if p[0] == g]
        centers = [np.mean([v for _, v in weights if cluster[v] == k]) for k in range(3)]
        assert centers == sorted(centers)
        assert all(abs(v - centers[cluster[v]]) == min(abs(v - c) for c in centers) for _, v in weights)


def test_ridge_satisfies_its_normal_equations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = 3 + x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), 4.0, float(b)) for a, b in zip(x, y)], "a double, b double, c double, k double, y double")
    names, means, sds, beta = M.ridge_fit(df, ["a", "b", "c", "k"], "y", 2.0)
    assert names == ["a", "b", "c"]
    z = np.column_stack([np.ones(200), (x - means) / sds])
    want = np.linalg.solve(z.T @ z + np.diag([0, 2.0, 2.0, 2.0]), z.T @ y)
    assert np.allclose(beta, want, atol=1e-8)
    got = [r[0] for r in df.select(M.ridge_predict((names, means, sds, beta), floor=False)).collect()]
    assert np.allclose(got, z @ want, atol=1e-8)


def test_bootstrap_bounds_are_ordered_and_inside_the_analogs(spark):
    rows = [(1, f"t{i}", r, float(v), 0.1 * r) for i in range(10) for r, v in enumerate((10, 20, 30, 40, 55), 1)]
    analogs = spark.createDataFrame(rows, "fold int, test_id string, rank int, outcome double, distance double")
    made = M.weighted_analogs(analogs, "fold")
    a = M.bootstrap_intervals(made, ["fold", "test_id"]).drop("analogs")
    for r in a.collect():
        assert 10 <= r.lower_95 <= r.lower_80 <= r.upper_80 <= r.upper_95 <= 55
    assert values(a, *a.columns) == values(M.bootstrap_intervals(made.repartition(7), ["fold", "test_id"]).drop("analogs"), *a.columns)


def test_features_and_predictions_see_no_future(spark):
    rng = np.random.default_rng(8)
    rows = [(f"g{e % 2}", f"e{e}", t, float(rng.integers(1, 50)), int(rng.integers(1, 9)), 100.0) for e in range(6) for t in range(1990, 2000) if (e + t) % 5]
    df = spark.createDataFrame(rows, "grp string, entity string, period int, v double, cases int, denom double")
    wild = df.withColumn("v", F.when(F.col("period") > 1995, F.col("v") * 1000).otherwise(F.col("v"))).withColumn("cases", F.when(F.col("period") > 1995, 999).otherwise(F.col("cases")))
    build = lambda d: M.empirical_bayes(M.baselines(d, "entity", "grp", "period", "v"), "entity", "grp", "period", "v", 4, 5.0).filter("period <= 1995").select("entity", "period", *M.MODELS, "eb_group", "eb_all")
    assert values(build(df), *build(df).columns) == values(build(wild), *build(df).columns)
    matrix = lambda d: design_matrix(d, "entity", "grp", "period", "v", "cases", "denom", [], ["grp"])[0].filter("period <= 1995")
    assert values(matrix(df), *matrix(df).columns) == values(matrix(wild), *matrix(df).columns)
    leaks = Q.leakage(lambda d: W.trailing_mean_rows(d, ["entity"], "period", "v", 3), df, "entity", "period", 1995)
    assert leaks.isEmpty()


@pytest.mark.parametrize("parts", ["1", "7", "50"])
def test_results_do_not_depend_on_partitions(spark, parts):
    rows = [(f"g{e % 3}", f"e{e}", t, float((e * 37 + t * 11) % 23)) for e in range(20) for t in range(8)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = panel(spark, rows)
    want = values(W.rank_tier(W.growth(df, ["entity"], "period", "v"), ["period"], "v", "entity"), "entity", "period", "rank", "pct")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        again = df.repartition(int(parts)).orderBy(F.rand(int(parts)))
        got = values(W.rank_tier(W.growth(again, ["entity"], "period", "v"), ["period"], "v", "entity"), "entity", "period", "rank", "pct")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_nearest_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform([30, -100], [45, -80], (30, 2)))]
    stations = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform([30, -100], [45, -80], (60, 2)))]
    a = spark.createDataFrame(places, "entity int, lat double, lon double")
    b = spark.createDataFrame(stations, "station int, s_lat double, s_lon double")
    got = {(r.entity, r["rank"]): r.station for r in J.nearest_k(a, b, 2, 250).collect()}

    def miles(p, s):
        x, y = np.radians(s[1] - p[1]) / 2, np.radians(s[2] - p[2]) / 2
        return 2 * X.EARTH_MILES * np.arcsin(np.sqrt(np.sin(x) ** 2 + np.cos(np.radians(p[1])) * np.cos(np.radians(s[1])) * np.sin(y) ** 2))

    want = {}
    for p in places:
        near = sorted((round(float(miles(p, s)), 6), s[0]) for s in stations)
        for rank, (d, s) in enumerate([x for x in near if x[0] <= 250][:2], 1):
            want[p[0], rank] = s
    assert got == want


def test_files_round_trip_with_odd_text(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿ a , b\n1, x\n".encode())
    assert R.read_delimited(spark, f"file://{tmp_path}/bom.csv", ["a", "b"]).columns == ["a", "b"]
    (tmp_path / "latin.csv").write_bytes("a|b\n1|é\n".encode("latin1"))
    assert R.read_delimited(spark, f"file://{tmp_path}/latin.csv", sep="|", encoding="ISO-8859-1").first().b == "é"
    (tmp_path / "t.txt").write_text("SEAS YR\n a 1\n b\n\n")
    rows, rejects = R.read_tokens(spark, f"file://{tmp_path}/t.txt", ["x", "y"], "SEAS")
    assert values(rows, "x", "y") == [("a", "1")] and rejects.count() == 1
    bad = spark.createDataFrame([(1, "[1]", [1, 2], [3]), (2, None, [1], [4])], "k int, j string, x array<int>, y array<int>")
    good, rejected = R.zip_parallel(bad.drop("j"), ["x", "y"])
    assert values(good, "k", "x", "y") == [(2, 1, 4)] and values(rejected, "k") == [(1,)]
    sums = Q.file_checksums(spark, f"file://{tmp_path}/t.txt").first()
    assert sums.bytes == 17 and len(sums.sha256) == 64


def test_upserts_are_idempotent_and_swap_versions(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    keyed.write_upsert(one, root, ["k"])
    for _ in range(2):
        keyed.write_upsert(two, root, ["k"])
    assert values(keyed.read_upserts(spark, root), "k", "v") == [(1, "a"), (2, "B"), (3, "c")]
    assert values(S.replace_groups(one.withColumn("g", F.lit(1)), two.limit(1).withColumn("g", F.lit(1)), "g", ["k"]), "k", "v") == [(2, "B")]


def test_stream_weeks_equal_batch_weeks(spark, tmp_path):
    rows = [(f"u{i % 3}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=7 * i), float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "u string, ts timestamp, v double")
    end = spark.createDataFrame([("z", datetime.datetime(2030, 1, 1), 0.0)], df.schema)
    df.unionByName(end).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    weeks = streams.stream_calendar_rollup(stream, "u", "ts", "v")
    weeks.writeStream.outputMode("append").format("memory").queryName("weeks").trigger(availableNow=True).start().awaitTermination()
    want = values(streams.batch_calendar_rollup(df, "u", "ts", "v"), "u", "week_start", "n", "total", "days")
    assert values(spark.table("weeks"), "u", "week_start", "n", "total", "days") == want


def test_categories_are_bounded(spark):
    df = spark.range(MOST_CATEGORIES + 1).select(F.col("id").alias("c"))
    with pytest.raises(ValueError):
        categories(df, "c")
    with pytest.raises(J.KeyMismatch):
        J.cross_allocate(df, spark.range(1001), "c", "id", "x")


def test_empty_panels_give_empty_results(spark):
    none = panel(spark).limit(0)
    assert W.rank_tier(none, ["period"], "v", "entity").count() == 0
    assert M.baselines(none, "entity", "grp", "period", "v").count() == 0
    assert A.persistence(none, "entity", "period", F.col("v") > 1).count() == 0
    assert G.components(none.select("period", F.col("entity").alias("node")), none.select("period", F.col("entity").alias("src"), F.col("grp").alias("dst")), ["period"]).count() == 0
