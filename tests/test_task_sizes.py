"""Work that is bounded a task: what is shuffled, and into how many tasks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import aggregates as A
from panelwright.operators import forecast as M
from panelwright.operators import graph as G
from panelwright.operators import joins as J
from panelwright.operators import panel_models as P
from panelwright.operators.storage import spread
from panelwright.plans import forecast_queries as Q
from panelwright.plans.views import Tables


@pytest.fixture
def large(spark):
    """The plans that large tables get: none of them is broadcast for its size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_regimes_whose_means_round_alike_are_numbered_by_node(spark):
    nodes = spark.createDataFrame([(1, 5, 1.0000004999999999), (1, 2, 1.000001)], "t int, node int, v double")
    found = nodes.select("t", "node", F.col("node").alias("component"))
    assert {r.node: r.number for r in G.numbered_components(found, nodes, ["t"], "v").collect()} == {2: 1, 5: 2}


def test_pairs_are_counted_in_tasks_of_bounded_meetings(spark, monkeypatch):
    draw = random.Random(3)
    held = {e: {draw.randrange(60) for _ in range(12)} for e in range(80)}
    df = spark.createDataFrame([(e, k) for e, ks in held.items() for k in ks], "e int, k int")
    monkeypatch.setattr(J, "MEETINGS", 100)
    met = sum(len(a & b) for a, b in itertools.combinations(held.values(), 2))
    for block in (1000, 12):  # lists alone; lists and rows of crowded keys
        found = J.self_pairs(df, "e", "k", 1, block)
        assert {(r.a, r.b): r.shared for r in found.collect()} == {(a, b): len(held[a] & held[b]) for a, b in itertools.combinations(held, 2) if held[a] & held[b]}
        assert found.rdd.getNumPartitions() >= met / 100


def test_first_keys_are_looked_for_only_where_sizes_allow_it(spark, monkeypatch):
    draw = random.Random(11)
    held = {e: {draw.randrange(60) for _ in range(30)} for e in range(80)}
    df = spark.createDataFrame([(e, k) for e, ks in held.items() for k in ks], "e int, k int")
    want = {(a, b): len(held[a] & held[b]) for a, b in itertools.combinations(held, 2)}
    asked, whole = [], J.key_prefixes
    monkeypatch.setattr(J, "key_prefixes", lambda *args: (asked.append(args), whole(*args))[1])
    for least, looked in ((2, 0), (25, 1)):  # 80 entities leave out one key each, or 24
        assert {(r.a, r.b): r.shared for r in J.self_pairs(df, "e", "k", least).collect()} == {p: n for p, n in want.items() if n >= least}
        assert len(asked) == looked


def test_pairs_are_written_once_and_not_again_in_both_directions(spark, monkeypatch):
    written, whole = [], Q.settled
    monkeypatch.setattr(Q, "settled", lambda df: (written.append(df.columns), whole(df))[1])
    Q.q153_annual_forecast_models(Tables(spark, "/root/testdata/sf0.001"))
    assert written and not any("src" in columns for columns in written)


def test_edges_are_shuffled_by_their_ends_alone(spark):
    nodes = spark.createDataFrame([(t, n, float(n * t)) for t in (1, 2, 3) for n in range(6)], "t int, node int, v double")
    edges = spark.createDataFrame(list(itertools.permutations(range(6), 2)), "src int, dst int")
    near = G.similar_edges(edges, nodes, ["t"], {"v": 2})
    assert {tuple(r) for r in near.collect()} == {(t, a, b) for t in (1, 2, 3) for a, b in itertools.permutations(range(6), 2) if abs(a - b) * t <= 2}
    assert "hashpartitioning(t" not in plan(near)


def test_a_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(300)], "t int, src int, dst int")
    nodes = spark.createDataFrame([(1, i) for i in range(301)], "t int, node int")
    assert {r.component for r in G.components(nodes, edges, ["t"], most_rounds=10).collect()} == {0}
    shuffled = edges.withColumn("src", (F.col("src") * 97) % 301).withColumn("dst", (F.col("dst") * 97) % 301)
    assert {r.component for r in G.components(nodes, shuffled, ["t"]).collect()} == {0}


def test_spread_rows_are_rolled_up_without_another_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("u"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("d"), F.lit(1.0).alias("v"))
    dealt = spread(rows, ["u"], 50)
    assert dealt.rdd.getNumPartitions() >= 20
    assert plan(A.calendar_rollup(dealt, "u", "d", "v", "week", 1, 0.0)).count("Exchange") == 1


def test_a_query_meets_its_week_once(spark):
    days = spark.createDataFrame([(i, 1, "2020-03-04") for i in range(3)], "q int, e int, d string").withColumn("d", F.col("d").cast("date"))
    scores = spark.createDataFrame([(1, y, 10, float(y)) for y in (2018, 2019, 2021)], "e int, y int, w int, v double")
    found = J.asof_week(days, scores, "q", "e", "d", "y", "w", "v")
    assert {(r.q, r.used_year, r.flags) for r in found.collect()} == {(i, 2021, "latest_year_used") for i in range(3)}
    assert "SortAggregate" not in plan(found)


def test_rings_are_thinned_once_and_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "RINGS", 10)
    rows = spark.range(100).select("id", F.expr("transform(sequence(0, 20), i -> array(double(i % 20), double(i % 20 * (id % 3))))").alias("ring"))
    thin = G.thin_rings(rows, "ring", 1.5, 3)
    assert plan(thin).count("lambdafunction(CASE WHEN") == 1
    assert thin.rdd.getNumPartitions() >= 10


def test_nearest_rows_are_bounded_before_they_are_ranked(spark, monkeypatch):
    draw = random.Random(5)
    places = [(i, draw.uniform(30, 40), draw.uniform(-100, -90)) for i in range(400)]
    stations = [(i, draw.uniform(30, 40), draw.uniform(-100, -90)) for i in range(2000)]
    ranked, whole = [], J.settled

    def counted(df):
        out = whole(df)
        if "rank" in out.columns:
            ranked.append(out)
        return out

    pairs, met = [], J._kd_pairs
    monkeypatch.setattr(J, "_kd_pairs", lambda *args: (pairs.append(met(*args)), pairs[-1])[1])
    monkeypatch.setattr(J, "settled", counted)
    monkeypatch.setattr(J, "MEETINGS", 256 * 20)
    dealt = []
    monkeypatch.setattr(J, "spread", lambda *args: (dealt.append(spread(*args)), dealt[-1])[1])
    found = J.nearest_k(spark.createDataFrame(places, "entity int, lat double, lon double"), spark.createDataFrame(stations, "station int, s_lat double, s_lon double"), 3)
    assert found.count() == 1200
    assert ranked[0].count() == 1200
    assert [d.rdd.getNumPartitions() for d in dealt] == [20, 20]  # 400 rows, 20 a task
    near = pairs[1].filter("_bound IS NULL OR far <= _bound + 1e-6").count()
    assert 1200 <= near < 400 * 12 and pairs[1].count() > 400 * 100


def test_resamples_are_drawn_in_many_tasks_and_in_order(spark, monkeypatch):
    rows = [(1, i, r, float(v * i), 0.1 * r) for i in range(1, 41) for r, v in enumerate((10, 20, 30, 40, 55)[: 1 + i % 5], 1)]
    made = M.weighted_analogs(spark.createDataFrame(rows, "fold int, test_id int, rank int, outcome double, distance double"), "fold")
    monkeypatch.setattr(M, "DRAWN", 200 * 4)
    found = {r.test_id: r for r in M.bootstrap_intervals(made, ["fold", "test_id"]).collect()}
    monkeypatch.setattr(M, "FEW_ITEMS", 0)
    assert found == {r.test_id: r for r in M.bootstrap_intervals(made, ["fold", "test_id"]).collect()}
    draws = [(i, j) for i in range(1, 201) for j in range(1, 6)]
    drawn = spark.createDataFrame(draws, "i int, j int").withColumn("u", F.pmod(F.xxhash64(F.lit(7), F.lit(1), F.lit(9), "i", "j"), F.lit(1 << 30)) / float(1 << 30))
    uniform, items = {(r.i, r.j): r.u for r in drawn.collect()}, found[9].analogs
    total = sum(x.w for x in items)
    pick = lambda u: items[min(sum(sum(y.w for y in items[: q + 1]) / total <= u for q in range(5)), 4)].outcome
    means = sorted(sum(pick(uniform[i, j]) for j in range(1, 6)) / 5 for i in range(1, 201))
    assert abs(found[9].lower_95 - (means[4] + (means[5] - means[4]) * 0.975)) < 1e-9
    dealt = []
    monkeypatch.setattr(M, "spread", lambda *args: (dealt.append(spread(*args)), dealt[-1])[1])
    M.bootstrap_intervals(made, ["fold", "test_id"])
    assert dealt[0].rdd.getNumPartitions() == 10


def test_keys_are_counted_in_tasks_of_bounded_rows(spark, monkeypatch):
    draw = random.Random(4)
    held = {e: {0} | {draw.randrange(1, 60) for _ in range(12)} for e in range(80)}
    df = spark.createDataFrame([(e, k) for e, ks in held.items() for k in ks] * 2, "e int, k int")
    want = {(a, b): len(held[a] & held[b]) for a, b in itertools.combinations(held, 2)}
    rows, dealt = sum(map(len, held.values())), []
    monkeypatch.setattr(J, "HELD", 50)
    monkeypatch.setattr(J, "spread", lambda *args: (dealt.append((args[1], spread(*args))), dealt[-1][1])[1])
    for crowd, block in ((1000, 1000), (20, 1000), (20, 12)):
        monkeypatch.setattr(J, "CROWD", crowd)
        for least in (1, 4):
            dealt.clear()
            assert {(r.a, r.b): r.shared for r in J.self_pairs(df, "e", "k", least, block).collect()} == {p: n for p, n in want.items() if n >= least}
            sizes = {tuple(keys): out.rdd.getNumPartitions() for keys, out in reversed(dealt)}  # the first of each: prefixes are fewer rows
            assert sizes["_e", "_k"] >= 2 * rows / 50 and all(n >= rows / 50 for keys, n in sizes.items() if keys in (("_e",), ("_k",)))


def test_edges_are_not_sorted_with_what_their_ends_carry(large):
    nodes = large.createDataFrame([(t, n, float(n * t)) for t in (1, 2, 3) for n in range(6)], "t int, node int, v double")
    edges = large.createDataFrame(list(itertools.permutations(range(6), 2)), "src int, dst int")
    near = G.similar_edges(edges, nodes, ["t"], {"v": 2})
    assert plan(near).count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan(near)
    assert {tuple(r) for r in near.collect()} == {(t, a, b) for t in (1, 2, 3) for a, b in itertools.permutations(range(6), 2) if abs(a - b) * t <= 2}


def test_edges_are_not_sorted_for_values_of_neighbors(large):
    values = large.createDataFrame([(e, t, float(e * t)) for e in range(5) for t in (1, 2)], "e int, t int, v double")
    edges = large.createDataFrame([(a, b) for a, b in itertools.permutations(range(5), 2) if a + b != 4], "src int, dst int")
    found = J.neighbor_summary(values, edges, "e", "t", "v", 1)
    assert plan(found).count("ShuffledHashJoin") == 1
    near = {e: [float(b) for b in range(5) if b != e and e + b != 4] for e in range(5)}
    assert {(r.e, r.t): (r.neighbor_mean, r.neighbor_max, r.neighbor_n) for r in found.collect()} == {
        (e, t): (sum(v) / len(v), max(v), len(v)) if t == 2 else (None, None, 0) for e, v in near.items() for t in (1, 2)
    }


def test_edges_are_not_sorted_in_rounds_of_components(large, monkeypatch):
    edges = large.createDataFrame([(1, i, i + 1) for i in range(20) if i != 9], "t int, src int, dst int")
    nodes = large.createDataFrame([(1, i) for i in range(21)], "t int, node int")
    plans, whole = [], G.settled
    monkeypatch.setattr(G, "settled", lambda df: (plans.append((df.columns, plan(df))), whole(df))[1])
    for closed in (False, True):
        assert {(r.node, r.component) for r in G.components(nodes, edges, ["t"], closed=closed).collect()} == {(i, 0 if i < 10 else 10) for i in range(21)}
    rounds = [p for columns, p in plans if sorted(columns) == ["dst", "src", "t"]]
    assert len(rounds) >= 3 and all("SortMergeJoin" not in p and p.count("ShuffledHashJoin") == 2 for p in rounds)


def test_edges_are_not_sorted_for_the_neighbor_model(large):
    rows = large.createDataFrame([(e, e % 2, t, float(e + t)) for e in range(4) for t in range(1, 6)], "e int, g int, t int, v double")
    edges = large.createDataFrame(list(itertools.permutations(range(4), 2)), "src int, dst int")
    found = P.rate_models(rows, "e", "g", "t", "v", 3, 2, 5.0, edges=edges)
    assert plan(found).count("ShuffledHashJoin") == 1
    assert {(r.e, r.t): r.neighbor for r in found.collect()} == {(e, t): sum(b + t - 1 for b in range(4) if b != e) / 3 for e in range(4) for t in range(3, 6)}
