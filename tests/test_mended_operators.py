"""Repeats, late rows, crashes, high latitudes, hot keys and prior windows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import aggregates as A
from panelwright.operators import forecast as M
from panelwright.operators import graph as G
from panelwright.operators import joins as J
from panelwright.operators import panel_models as P
from panelwright.operators import quality as Q
from panelwright.operators import sets as S
from panelwright.operators import storage
from panelwright.operators import windows as W
from panelwright.sources import keyed
from panelwright.streaming import streams


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_last_row_of_a_batch_wins_and_unordered_repeats_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    batch = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 5, "only")], "k int, at int, v string")
    keyed.write_upsert(batch, root, ["k"], order="at")
    assert rows_of(keyed.read_upserts(spark, root), "k", "v") == [(1, "new"), (2, "only")]
    late = spark.createDataFrame([(2, 4, "late"), (1, 2, "same time"), (3, None, "no time")], "k int, at int, v string")
    keyed.write_upsert(late, root, ["k"], order="at")
    assert rows_of(keyed.read_upserts(spark, root), "k", "v") == [(1, "same time"), (2, "only"), (3, "no time")]
    with pytest.raises(Exception, match="different rows of key"):
        keyed.write_upsert(batch, f"{root}2", ["k"])
    assert rows_of(S.upsert(batch.limit(0), batch.filter("k = 2").unionByName(batch.filter("k = 2")), ["k"]), "k", "v") == [(2, "only")]


def test_a_crash_between_steps_leaves_the_last_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/table"
    keyed.write_upsert(spark.createDataFrame([(1, "a")], "k int, v string"), root, ["k"])

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename":
                raise OSError("lost")
            return getattr(self.fs, name)

    whole = keyed._versions
    monkeypatch.setattr(keyed, "_versions", lambda s, r: (Broken(whole(s, r)[0]), whole(s, r)[1]))
    with pytest.raises(OSError):
        keyed.write_upsert(spark.createDataFrame([(2, "b")], "k int, v string"), root, ["k"])
    monkeypatch.setattr(keyed, "_versions", whole)
    assert rows_of(keyed.read_upserts(spark, root), "k", "v") == [(1, "a")]
    keyed.write_upsert(spark.createDataFrame([(2, "b")], "k int, v string"), root, ["k"])
    assert rows_of(keyed.read_upserts(spark, root), "k", "v") == [(1, "a"), (2, "b")]


def test_late_rows_of_a_stream_dont_overwrite(spark, tmp_path):
    root, source, state = (f"file://{tmp_path}/{n}" for n in ("table", "in", "state"))
    big = 1 << 53
    for batch in ([(1, big + 2, "newest"), (2, 1, "a")], [(1, big + 1, "late"), (2, 2, "b"), (2, 1, "older")]):
        df = spark.createDataFrame(batch, "k int, at long, v string")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        streams.stream_upsert(stream, root, ["k"], "at", state).awaitTermination()
    assert rows_of(keyed.read_upserts(spark, root), "k", "v") == [(1, "newest"), (2, "b")]


def test_shares_of_history_keep_repeated_rows(spark):
    now = spark.createDataFrame([("a", 5.0)] * 3 + [("a", None), ("b", 1.0), (None, 2.0), ("a", 0.0)], "e string, v double")
    past = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 9.0), ("a", None), (None, 1.0)], "e string, p double")
    got = rows_of(W.ecdf(now, past, ["e"], "v", "p"), "e", "v", "ecdf", "ecdf_n")
    assert got == sorted([("a", 5.0, 2 / 3, 3)] * 3 + [("a", None, None, 3), ("b", 1.0, None, 0), (None, 2.0, None, 0), ("a", 0.0, 0.0, 3)], key=repr)
    assert M.typicality(now, past.withColumnRenamed("p", "v"), "e", "v", 1).count() == 7


def test_ranks_in_ranges_equal_ranks_in_one_task(spark):
    random_ = random.Random(2)
    rows = [(random_.choice(["x", "y"]), i, random_.choice([None, random_.randint(0, 30) / 2, random_.gauss(0, 5)])) for i in range(600)] + [("z", 1, None)]
    df = spark.createDataFrame(rows, "g string, e int, v double")
    assert rows_of(W.numbered(df, ["g"], "v", "e", "n", large=10), "g", "e", "n") == rows_of(W.numbered(df, ["g"], "v", "e", "n"), "g", "e", "n")


def test_nearest_stations_at_high_latitudes_and_the_date_line(spark):
    random_ = random.Random(3)
    spots = [(random_.uniform(60, 90), random_.uniform(-180, 180)) for _ in range(80)] + [(random_.uniform(-60, 60), random_.choice([-1, 1]) * random_.uniform(178, 180)) for _ in range(80)] + [(90.0, 0.0), (-89.9, 10.0)]
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "entity int, lat double, lon double")
    stations = spark.createDataFrame([(1000 + i, p[0], p[1]) for i, p in enumerate(random_.sample(spots, 120))], "station int, s_lat double, s_lon double")

    def miles(a, b):
        x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(min(1, x)))

    near = {r.station: (r.s_lat, r.s_lon) for r in stations.collect()}
    want = set()
    for i, p in enumerate(spots):
        found = sorted((round(miles(p, q), 6), s) for s, q in near.items() if miles(p, q) <= 150)
        want |= {(i, s, r + 1) for r, (_, s) in enumerate(found[:3])}
    got = J.nearest_k(places, stations, 3, 150)
    assert {(r.entity, r.station, r["rank"]) for r in got.collect()} == want and len(want) > 150
    nearest = {(i, s, r + 1) for i, p in enumerate(spots) for r, (_, s) in enumerate(sorted((round(miles(p, q), 6), s) for s, q in near.items())[:3])}
    assert {(r.entity, r.station, r["rank"]) for r in J.nearest_k(places, stations, 3, cell_rows=5).collect()} == nearest
    few = J.nearest_k(places, stations.limit(2), 3)
    assert few.count() == 2 * len(spots)


def test_pairs_of_a_hot_key_come_from_many_blocks(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(60)] + [(i, f"k{i % 7}") for i in range(60)], "e int, k string")
    one, many = J.self_pairs(df, "e", "k"), J.self_pairs(df, "e", "k", block=10)
    assert rows_of(one, "a", "b", "shared") == rows_of(many, "a", "b", "shared") and one.count() == 60 * 59 // 2


def test_checksums_see_repeats_and_not_order(spark):
    a = spark.createDataFrame([(1, "x")] * 2, "i int, s string")
    b = spark.createDataFrame([(2, "y")] * 2, "i int, s string")
    c = spark.createDataFrame([(1, None), (2, "")], "i int, s string")
    sums = [Q.rows_checksum(d).first().rows_sha256 for d in (a, b, c, c.orderBy(F.desc("i")), a.limit(0), a.limit(1))]
    assert sums[2] == sums[3] and len(set(sums)) == 5 and all(len(s) == 64 for s in sums)


def test_forests_keep_rows_with_nulls(spark):
    train = spark.createDataFrame([(float(i % 5), float(i) if i % 3 else None, 2.0 * (i % 5)) for i in range(60)], "x double, y double, t double")
    test = spark.createDataFrame([(1, 4.0, None), (2, None, 7.0), (3, float("nan"), float("nan"))], "k int, x double, y double")
    found = {r.k: r.predicted for r in M.forest_forecast(train, test, ["x", "y"], "t", trees=20).collect()}
    assert set(found) == {1, 2, 3} and abs(found[1] - 8) < 2 and all(0 <= p <= 8 for p in found.values())


def test_wide_gramians_equal_narrow_ones(spark, monkeypatch):
    random_ = random.Random(1)
    names = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(*[random_.choice([None, random_.random()]) for _ in names], random_.random()) for _ in range(50)], [*names, "t"]).repartition(3)
    narrow = M.gram(df, names, "t")
    monkeypatch.setattr(M, "SUMS_OF_PRODUCTS", 1)
    wide = M.gram(df, names, "t")
    assert abs(narrow[0] - wide[0]).max() < 1e-9 and abs(narrow[1] - wide[1]).max() < 1e-9 and narrow[0][0, 0] == 50


def test_membership_rollup_asserts_members_and_constants(spark):
    df = spark.createDataFrame([("a", 1, 2, 10.0, "r"), ("b", 1, 3, 0.0, "r"), ("c", 1, 1, 0.0, "s")], "e string, p int, cases int, d double, kind string")
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "e string, g int")
    got = {r.g: (r.kind, r.rate) for r in A.rollup_by_membership(df, members, "e", "p", "g", "cases", "d", ["kind"]).collect()}
    assert got == {1: ("r", 0.5), 2: ("s", None)}
    moved = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "e string, g int")
    with pytest.raises(Exception, match="kind differs"):
        A.rollup_by_membership(df, moved, "e", "p", "g", "cases", "d", ["kind"]).collect()
    with pytest.raises(J.KeyMismatch):
        A.rollup_by_membership(df, members.limit(2), "e", "p", "g", "cases", "d")


def small_panel(spark):
    rows = [(1 + (e > 3), e, y, 10.0 * (e > 2) + e + (y - 2000) % 3) for e in range(1, 7) for y in range(2000, 2007)]
    return spark.createDataFrame(rows, "grp int, entity int, period int, rate double")


def chain(spark, n=6):
    half = [(i, i + 1) for i in range(1, n)]
    return spark.createDataFrame(half + [(b, a) for a, b in half], "src int, dst int")


def test_regimes_come_from_prior_periods_alone(spark):
    panel, edges = small_panel(spark), chain(spark)
    build = lambda df: P.spatial_regimes(df, edges, "entity", "grp", "period", "rate", 3, 2, {"h_mean": 1.5, "h_prior": 1.5, "h_trend": 1}, 2003, 2007)
    found = {(r.period, r.node): (r.regime, r.members, r.degree) for r in build(panel).collect()}
    assert {k[0] for k in found} == set(range(2003, 2008))  # one more than any row has
    assert found[2005, 1] == (1, 2, 1) and found[2005, 4] == (2, 4, 2)
    changed = panel.withColumn("rate", F.when(F.col("period") == 2005, F.col("rate") * 9).otherwise(F.col("rate")))
    again = {(r.period, r.node): (r.regime, r.members, r.degree) for r in build(changed).collect()}
    assert {k: v for k, v in again.items() if k[0] <= 2005} == {k: v for k, v in found.items() if k[0] <= 2005}
    observed = panel.filter("NOT (entity = 1 AND period = 2004)").selectExpr("period", "entity AS node", "rate AS cases", "1 AS population")
    summary = {(r.period, r.regime): (r.nodes, r.actual_cases) for r in P.regime_summary(build(panel), observed, "cases", "population").collect()}
    assert summary[2004, 1] == ("1,2", None) and summary[2005, 1][1] is not None and summary[2007, 1][1] is None


def test_coming_period_has_one_horizon_and_six_models(spark):
    panel = small_panel(spark)
    people = spark.createDataFrame([(e, 1000.0) for e in range(1, 6)] + [(6, 0.0)], "entity int, population double")
    regimes = P.spatial_regimes(panel, chain(spark), "entity", "grp", "period", "rate", 3, 2, {"h_mean": 1.5}, 2007, 2007).withColumnRenamed("node", "entity")
    found = P.regional_forecast(panel, people, "entity", "grp", "period", "rate", 2008, 3, 2, 5.0, None, regimes).collect()
    assert {(r.origin, r.target) for r in found} == {(2006, 2008)} and {r.entity for r in found} == set(range(1, 6))
    assert {r.model for r in found} == set(P.RATE_MODELS[:6])
    of = {(r.entity, r.model): r.predicted for r in found}
    series = lambda e: {y: 10.0 * (e > 2) + e + (y - 2000) % 3 for y in range(2000, 2007)}
    for e in range(1, 6):
        s = series(e)
        mean = (s[2004] + s[2005] + s[2006]) / 3
        assert of[e, "latest"] == s[2006] and abs(of[e, "trailing_mean"] - mean) < 1e-9
        own = [x for x in range(1, 7) if (x > 3) == (e > 3)]
        group = sum(series(x)[y] for x in own for y in (2004, 2005, 2006)) / (3 * len(own))
        assert abs(of[e, "eb_group"] - (3 * mean + 5 * group) / 8) < 1e-9
        assert of[e, "analog"] == s[2005]  # the cycle has three years: 2003 is like 2006
    cases = {r.entity: r.predicted_cases for r in found if r.model == "latest"}
    assert abs(cases[1] - of[1, "latest"] * 1000 / 100_000) < 1e-12


def test_bad_panels_are_refused(spark):
    panel = small_panel(spark)
    people = spark.createDataFrame([(e, 1000.0) for e in range(1, 7)], "entity int, population double")
    ask = lambda p=panel, n=people, **k: P.regional_forecast(p, n, "entity", "grp", "period", "rate", k.pop("target", 2007), 3, 2, 5.0, **k)
    with pytest.raises(P.PanelError, match="finite"):
        ask(panel.withColumn("rate", F.when(F.col("entity") == 1, float("inf")).otherwise(F.col("rate"))))
    with pytest.raises(P.PanelError, match="missing"):
        ask(n=people.unionByName(spark.createDataFrame([(9, None)], people.schema)))
    with pytest.raises(P.PanelError, match="isn't after"):
        ask(target=2006)
    with pytest.raises(P.PanelError, match="after the origin"):
        ask(regimes=spark.createDataFrame([(1, 2009, 1.0)], "entity int, period int, regime_mean double"))
    with pytest.raises(P.PanelError, match="no period"):
        ask(panel.filter("(entity + period) % 2 = 0"))


def test_stress_tests_see_earlier_periods_alone(spark):
    panel, edges = small_panel(spark), chain(spark)
    regimes = P.spatial_regimes(panel, edges, "entity", "grp", "period", "rate", 3, 2, {"h_mean": 1.5}, 2003, 2006).withColumnRenamed("node", "entity")
    found = P.rate_stress(panel, "entity", "grp", "period", "rate", 2005, 2006, 3, 2, 5.0, regimes, edges, forest=True, trees=10)
    assert {r.model for r in found.select("model").distinct().collect()} == {*P.RATE_MODELS, "forest"}
    assert found.count() == 2 * 6 * 8
    cut = P.rate_stress(panel.withColumn("rate", F.when(F.col("period") > 2005, 99.0).otherwise(F.col("rate"))), "entity", "grp", "period", "rate", 2005, 2006, 3, 2, 5.0, regimes.filter("period <= 2005"), edges, forest=True, trees=10)
    same = lambda df: rows_of(df.filter("period = 2005"), "entity", "model", "predicted")
    assert same(found) == same(cut)
    counts = P.count_stress(panel, "entity", "grp", "period", "rate", 2005, 2005, 3, 2, 0.0)
    by = {(r.entity, r.model): r.predicted for r in counts.collect()}
    totals = {y: sum(10.0 * (e > 2) + e + (y - 2000) % 3 for e in range(1, 7)) for y in range(2000, 2007)}
    own = sum(10.0 * 1 + 4 + (y - 2000) % 3 for y in (2002, 2003, 2004))
    assert abs(by[4, "all_share"] - own / (totals[2002] + totals[2003] + totals[2004]) * totals[2004]) < 1e-9
    assert abs(by[4, "all_share"] - by[4, "eb_all_share"]) < 1e-9 and len({m for _, m in by}) == 6


def test_cluster_summary_and_ring_thinning(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 4, 10.0), (1, 0, 4.0, 6, 10.0), (1, 1, 9.0, 1, None)], "p int, c int, v double, n int, d double")
    got = {r.c: (r.members, r.least, r.mean, r.most, r.sd, r.cases, r.rate) for r in P.cluster_summary(df, ["p", "c"], "v", "n", "d").collect()}
    assert got == {0: (2, 2.0, 3.0, 4.0, 1.0, 10, 0.5), 1: (1, 9.0, 9.0, 9.0, 0.0, 1, None)}
    ring = [[0.0, 0.0], [0.1, 0.0], [1.0, 0.0], [1.0, 0.05], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    thin = G.thin_rings(spark.createDataFrame([(1, ring), (2, ring[:3])], "k int, ring array<array<double>>"), "ring", 0.5, 3)
    kept = {r.k: [tuple(p) for p in r.ring] for r in thin.collect()}
    assert kept[1] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)] and len(kept[2]) == 3


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_root(Session)
