"""Rate and count models of multi-group panels: forecasts of a coming period and their rolling-origin comparison.

All closed-form models of a row at period t look at [t - back, t - 1] alone, by value frames over the whole panel at once.
A row needs `least` values in its window and one at t - 1. Rows that ask for a forecast have a null value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.expressions import shrunk_mean
from panelwright.operators import graph as G
from panelwright.operators import windows as W
from panelwright.operators.forecast import floor0, forest_backtest
from panelwright.operators.storage import settled

RATE_MODELS = ("latest", "trailing_mean", "eb_group", "eb_all", "analog", "eb_regime", "neighbor")
COUNT_MODELS = ("prior", "trailing_mean", "group_share", "eb_group_share", "all_share", "eb_all_share")
FOREST_FEATURES = ("h_prior", "h_mean", "h_min", "h_max", "h_trend", "h_n", "group_prior", "group_mean", "all_prior", "all_mean")


class PanelError(ValueError):
    """A panel that a model can't be asked about."""


def require_finite(df: DataFrame, columns: Sequence[str]) -> None:
    """Raises if a column holds NaN or an infinite value; nulls are allowed."""
    odd = {c: F.count_if(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns}
    found = {c: n for c, n in df.agg(*odd.values()).first().asDict().items() if n}
    if found:
        raise PanelError(f"values that aren't finite: {found}")


def asked(df: DataFrame, entity: str, group: str, period: str, value: str, first: int, last: int) -> DataFrame:
    """(entity, group, period, value): df's rows, and one with a null value for every entity and period of first to last without one."""
    rows = df.select(entity, group, period, F.col(value).cast("double").alias(value))
    members = rows.groupBy(entity).agg(F.max_by(group, period).alias(group))
    kind = df.schema[period].dataType
    grid = members.withColumn(period, F.explode(F.sequence(F.lit(first).cast(kind), F.lit(last).cast(kind))))
    return rows.unionByName(grid.join(rows.select(entity, period), [entity, period], "left_anti").withColumn(value, F.lit(None).cast("double")))


def analog_of_year(df: DataFrame, entity: str, period: str, value: str, horizon: int = 1, back: int = 3) -> DataFrame:
    """(entity, period, analog): the value `horizon` after the entity's own earlier year that is most like the year before period.

    Years are alike in their value and their mean over the back years up to them (sum of absolute differences); equal
    distances go to the latest year. Histories of one entity are short, entities many: pairs arise per entity.
    """
    w = W.by_value([entity], period, back - 1, 0)
    marks = df.select(entity, period, F.col(value).alias("v")).withColumn("m", F.avg("v").over(w)).filter("v IS NOT NULL")
    now = marks.select(entity, (F.col(period) + 1).alias(period), F.col("v").alias("v0"), F.col("m").alias("m0"))
    later = marks.select(entity, (F.col(period) - horizon).alias("_o"), F.col("v").alias("outcome"))
    past = marks.select(entity, F.col(period).alias("_o"), "v", "m").join(later, [entity, "_o"])
    both = now.join(past, entity).filter((F.col("_o") < F.col(period) - 1) & (F.col("_o") + horizon < F.col(period)))
    distance = F.round(F.abs(F.col("v0") - F.col("v")) + F.abs(F.col("m0") - F.col("m")), 9)
    return both.groupBy(entity, period).agg(F.min_by("outcome", F.struct(distance, -F.col("_o"))).alias("analog"))


def regime_graph(df: DataFrame, edges: DataFrame, entity: str, group: str, period: str, value: str, back: int, least: int, limits: Mapping[str, float], first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """(period, node, h_mean, h_prior, h_trend) of windows of prior periods, and the edges (period, src, dst) whose ends differ by at most limits."""
    history = W.history_summary(asked(df, entity, group, period, value, first, last), [entity], period, value, back, least)
    nodes = settled(history.filter(F.col(period).between(first, last)).select(F.col(period).alias("period"), F.col(entity).alias("node"), "h_mean", "h_prior", "h_trend"))
    half = settled(G.similar_edges(edges.filter("src < dst"), nodes, ["period"], limits))
    return nodes, half.unionByName(half.select("period", F.col("dst").alias("src"), F.col("src").alias("dst")))


def spatial_regimes(
    df: DataFrame, edges: DataFrame, entity: str, group: str, period: str, value: str, back: int, least: int, limits: Mapping[str, float], first: int, last: int, earlier: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(period, node, signature, regime, members, degree, regime_...): connected neighbours of like histories, from prior periods alone.

    A signature is the window's mean, last value and trend (h_mean, h_prior, h_trend); edges (src, dst, both ways) whose ends
    differ by at most limits in each are kept. Regimes are numbered from 1 within a period by (mean of h_mean, smallest node).
    earlier: components (period, node, component) and edges of an earlier version of these periods, such as that before
    revised rows, or of the periods before with period raised by one; they are repaired where edges changed.
    """
    nodes, near = regime_graph(df, edges, entity, group, period, value, back, least, limits, first, last)
    members = nodes.select("period", "node")
    half = near.filter("src < dst")
    components = G.components(members, half, ["period"], closed=True) if earlier is None else G.repaired_components(*earlier, members, half, ["period"])
    found = G.numbered_components(components, nodes, ["period"], "h_mean")
    degree = near.groupBy("period", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    rows = found.select("period", "node", F.col("number").alias("regime"), "members").join(nodes, ["period", "node"]).join(degree, ["period", "node"], "left")
    stats = rows.groupBy("period", "regime").agg(F.avg("h_mean").alias("regime_mean"), F.avg("h_prior").alias("regime_prior"), F.min("h_mean").alias("regime_min"), F.max("h_mean").alias("regime_max"), F.stddev_pop("h_mean").alias("regime_sd"))
    return rows.withColumn("degree", F.coalesce("degree", F.lit(0))).join(stats, ["period", "regime"])


def regime_summary(regimes: DataFrame, observed: DataFrame, cases: str, population: str) -> DataFrame:
    """A row per period and regime: members, features, and actual totals where every member is observed. observed: (period, node, cases, population)."""
    both = regimes.join(observed, ["period", "node"], "left")
    whole = F.count(cases) == F.count(F.lit(1))
    features = [F.first(c).alias(c) for c in ("members", "regime_mean", "regime_prior", "regime_min", "regime_max", "regime_sd")]
    return both.groupBy("period", "regime").agg(
        F.array_join(F.array_sort(F.collect_list("node")), ",").alias("nodes"), *features, F.when(whole, F.sum(cases)).alias("actual_cases"), F.when(whole, F.sum(population)).alias("actual_population")
    )


def cluster_summary(assigned: DataFrame, keys: Sequence[str], value: str, cases: str, population: str) -> DataFrame:
    """Per cluster: members, the spread of the prior value it was made from, and the actual rate where every population is known."""
    rate = F.when((F.count(population) == F.count(F.lit(1))) & (F.sum(population) > 0), F.sum(cases) / F.sum(population))
    return assigned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.stddev_pop(value).alias("sd"), F.sum(cases).alias("cases"), F.sum(population).alias("population"), rate.alias("rate")
    )


def rate_models(rows: DataFrame, entity: str, group: str, period: str, value: str, back: int, least: int, strength: float, horizon: int = 1, regimes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """rows that have enough history, with a column for each of RATE_MODELS; regimes: (entity, period, regime_mean)."""
    priors = W.pooled_prior_means(rows, group, period, value, back)
    found = W.history_summary(rows, [entity], period, value, back, least).join(priors, [group, period])
    found = found.join(analog_of_year(rows, entity, period, value, horizon), [entity, period], "left")
    shrunk = lambda prior: shrunk_mean(F.col("h_mean"), F.col("h_n"), F.col(prior), strength)
    found = found.withColumns({"latest": F.col("h_prior"), "trailing_mean": F.col("h_mean"), "eb_group": shrunk("group_mean"), "eb_all": shrunk("all_mean")})
    if regimes is not None:
        found = found.join(regimes.select(entity, period, "regime_mean"), [entity, period], "left").withColumn("eb_regime", F.when(F.col("regime_mean").isNotNull(), shrunk("regime_mean")))
    else:
        found = found.withColumn("eb_regime", F.lit(None).cast("double"))
    if edges is not None:
        seen = rows.filter(F.col(value).isNotNull()).select(F.col(entity).alias("dst"), (F.col(period) + 1).alias(period), F.col(value).alias("_v"))
        means = edges.join(seen.hint("shuffle_hash"), "dst").groupBy(F.col("src").alias(entity), period).agg(F.avg("_v").alias("neighbor"))
        return found.join(means, [entity, period], "left")
    return found.withColumn("neighbor", F.lit(None).cast("double"))


def long_predictions(found: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """(keys, model, predicted), predictions floored at 0; a model that has none for a row is left out."""
    long = found.select(*keys, *[F.col(m).cast("double").alias(m) for m in models]).unpivot(list(keys), list(models), "model", "raw")
    return long.filter("raw IS NOT NULL").withColumn("predicted", floor0(F.col("raw"))).drop("raw")


def latest_common_period(df: DataFrame, members: DataFrame, entity: str, period: str) -> int:
    """The latest period in which every member has a row."""
    wanted = members.select(entity).distinct()
    counts = df.join(wanted, entity, "left_semi").groupBy(period).agg(F.countDistinct(entity).alias("n"))
    found = counts.filter(F.col("n") == wanted.count()).agg(F.max(period)).first()[0]
    if found is None:
        raise PanelError("no period has a row of every member")
    return found


def regional_forecast(df: DataFrame, population: DataFrame, entity: str, group: str, period: str, value: str, target: int, back: int, least: int, strength: float, origin: int | None = None, regimes: DataFrame | None = None, per: float = 100_000) -> DataFrame:
    """(entity, group, origin, target, model, predicted, predicted_cases): six rate models of a coming period, one horizon for all.

    population: (entity, population) of the target period; entities without a positive one aren't forecast, a null one is refused.
    The origin is the latest period that every forecast entity has, if none is given; entities without a value there are left out.
    regimes: (entity, period, regime_mean) made from periods up to the origin, that is of period origin + 1; others are refused.
    """
    require_finite(df, [value])
    require_finite(population, ["population"])
    if not population.filter("population IS NULL").isEmpty():
        raise PanelError("a population of the target period is missing")
    wanted = population.filter("population > 0").select(entity, "population")
    rows = df.filter(F.col(value).isNotNull()) if origin is None else df
    origin = latest_common_period(rows, wanted, entity, period) if origin is None else origin
    if target <= origin:
        raise PanelError(f"target {target} isn't after the origin {origin}")
    if regimes is not None and not regimes.filter(F.col(period) > origin + 1).isEmpty():
        raise PanelError("regimes hold periods after the origin")
    known = asked(df.filter(F.col(period) <= origin), entity, group, period, value, origin + 1, origin + 1)
    found = rate_models(known, entity, group, period, value, back, least, strength, target - origin, regimes)
    found = found.filter(F.col(period) == origin + 1).join(wanted, entity)
    long = long_predictions(found, [entity, group, "population"], RATE_MODELS[:6])
    ends = {"origin": F.lit(origin), "target": F.lit(target), "predicted_cases": F.col("predicted") * F.col("population") / per}
    return long.withColumns(ends).select(entity, group, "origin", "target", "model", "predicted", "predicted_cases")


def rate_stress(df: DataFrame, entity: str, group: str, period: str, value: str, first: int, last: int, back: int, least: int, strength: float, regimes: DataFrame | None = None, edges: DataFrame | None = None, forest: bool = False, trees: int = 200) -> DataFrame:
    """(entity, group, period, actual, model, predicted, residual): rolling-origin predictions of observed rows of first to last.

    The closed-form models are windows; with `forest`, a forest of each test period learns from the window features of all rows
    of earlier periods, and all of them grow together.
    """
    require_finite(df, [value])
    rows = df.filter(F.col(value).isNotNull()).select(entity, group, period, F.col(value).cast("double").alias(value))
    found = rate_models(rows, entity, group, period, value, back, least, strength, 1, regimes, edges).withColumn("actual", F.col(value))
    tested = F.col(period).between(first, last)
    keys = [entity, group, period, "actual"]
    out = long_predictions(found.filter(tested), keys, RATE_MODELS)
    if forest:
        prior = W.pooled_prior_means(rows, group, period, value, 1).withColumnsRenamed({"group_mean": "group_prior", "all_mean": "all_prior"})
        features = settled(found.join(prior, [group, period]).withColumn("h_n", F.col("h_n").cast("double")).select(*keys, *FOREST_FEATURES))
        part = forest_backtest(features, FOREST_FEATURES, "actual", period, range(first, last + 1), [entity, period], trees)
        out = out.unionByName(part.select(*keys, F.lit("forest").alias("model"), floor0(F.col("predicted")).alias("predicted")))
    return out.withColumn("residual", F.col("actual") - F.col("predicted"))


def count_stress(df: DataFrame, entity: str, group: str, period: str, value: str, first: int, last: int, back: int, least: int, strength: float) -> DataFrame:
    """(entity, group, period, actual, model, predicted, residual): rolling-origin predictions of six count models.

    Shares are the entity's cases over its group's, or everyone's, in the entity's own earlier rows; shrunk ones are drawn to an
    equal share among the members; each is multiplied by the total of the period before.
    """
    rows = df.filter(F.col(value).isNotNull()).select(entity, group, period, F.col(value).cast("double").alias(value))
    groups = rows.groupBy(group, period).agg(F.sum(value).alias("group_total"))
    everyone = groups.groupBy(period).agg(F.sum("group_total").alias("all_total"))
    members = rows.groupBy(group).agg(F.countDistinct(entity).alias("group_members"))
    all_members = members.agg(F.sum("group_members").alias("all_members"))
    w, one = W.by_value([entity], period, back), W.by_value([entity], period, 1)
    met = rows.join(groups, [group, period]).join(everyone, period)
    sums = {"h_n": F.count(value).over(w), "h_sum": F.sum(value).over(w), "prior": F.max(value).over(one)}
    for side in ("group", "all"):
        sums |= {f"{side}_sum": F.sum(f"{side}_total").over(w)}
    met = met.withColumns(sums).filter((F.col("h_n") >= least) & F.col("prior").isNotNull() & F.col(period).between(first, last))
    lasts = [groups.select(group, (F.col(period) + 1).alias(period), F.col("group_total").alias("group_last")), everyone.select((F.col(period) + 1).alias(period), F.col("all_total").alias("all_last"))]
    met = met.join(lasts[0], [group, period]).join(lasts[1], period).join(members, group).crossJoin(F.broadcast(all_members))  # one row
    models: dict[str, Column] = {"trailing_mean": F.col("h_sum") / F.col("h_n")}
    for side in ("group", "all"):
        total, end, n = F.col(f"{side}_sum"), F.col(f"{side}_last"), F.col(f"{side}_members")
        models[f"{side}_share"] = F.when(total > 0, F.col("h_sum") / total).otherwise(0.0) * end
        models[f"eb_{side}_share"] = (F.col("h_sum") + strength / n) / (total + strength) * end
    found = met.withColumns(models).withColumn("actual", F.col(value))
    return long_predictions(found, [entity, group, period, "actual"], COUNT_MODELS).withColumn("residual", F.col("actual") - F.col("predicted"))
