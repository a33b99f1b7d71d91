"""Forecasts, rolling-origin backtests, intervals, updates and scores.

Closed-form models are windows over all periods at once: every row is its own fold, and only strictly earlier
periods reach it. Fitted models (ridge, forest) take the statistics of all folds from the same scans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.functions.expressions import first_match, half_even, shrunk_mean
from panelwright.operators import forest as X
from panelwright.operators import windows as W
from panelwright.operators.storage import settled, spread

PROBABILITIES = {"q025": 0.025, "q100": 0.1, "q500": 0.5, "q900": 0.9, "q975": 0.975}


def floor0(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def reading_summary(df: DataFrame, regime: str, period: str, error: str, reading: str, readings: Sequence[str], share_of: str) -> DataFrame:
    """Bias and counts of each reading per regime and period, and per regime over all periods (grouping sets)."""
    grouped = df.groupingSets([[F.col(regime), F.col(period)], [F.col(regime)]], F.col(regime), F.col(period))
    counts = [F.count_if(F.col(reading) == r).alias(f"n_{r}") for r in readings]
    share = F.avg((F.col(reading) == share_of).cast("double")).alias(f"share_{share_of}")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("bias"), *counts, share)


def baselines(df: DataFrame, entity: str, group: str, period: str, value: str, rows: int = 3) -> DataFrame:
    """df with prior_year, trailing_mean, trend_adjusted and linear_blend predictions from earlier rows alone, and the count of them."""
    w = W.by_row([entity], period, rows)
    history = Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    rates = df.groupBy(group, period).agg(F.avg(value).alias("_rate"))
    trend = W.trend_multiplier(rates, group, period, "_rate", rows).select(group, period, "multiplier")
    out = df.withColumns({"prior_year": F.max(value).over(W.by_value([entity], period, 1)), "trailing_mean": F.avg(value).over(w), "n_history": F.count(value).over(history)})
    out = out.join(trend, [group, period]).withColumn("trend_adjusted", F.col("trailing_mean") * F.col("multiplier")).drop("multiplier")
    return out.withColumn("linear_blend", (F.coalesce("prior_year", "trailing_mean") + F.col("trailing_mean")) / 2)


MODELS = ("prior_year", "trailing_mean", "trend_adjusted", "linear_blend")


def backtest(df: DataFrame, models: Sequence[str], keys: Sequence[str], value: str, test: Column, least: int) -> DataFrame:
    """(keys, actual, model, predicted, residual, absolute_error) of test rows with at least `least` earlier rows; predictions are floored at 0."""
    rows = df.filter(test & (F.col("n_history") >= least))
    long = rows.select(*keys, F.col(value).cast("double").alias("actual"), *[F.col(m).cast("double").alias(m) for m in models]).unpivot([*keys, "actual"], list(models), "model", "raw")
    long = long.filter("raw IS NOT NULL").withColumn("predicted", floor0(F.col("raw"))).drop("raw")
    return long.withColumns({"residual": F.col("predicted") - F.col("actual"), "absolute_error": F.abs(F.col("predicted") - F.col("actual"))})


def empirical_bayes(df: DataFrame, entity: str, group: str, period: str, value: str, back: int, strength: float) -> DataFrame:
    """df with the entity's earlier mean shrunk to its group's and to the overall mean of the same periods."""
    w = W.by_value([entity], period, back)
    priors = W.pooled_prior_means(df, group, period, value, back)
    out = df.withColumns({"own_mean": F.avg(value).over(w), "own_n": F.count(value).over(w)}).join(priors, [group, period])
    return out.withColumns({f"eb_{p}": shrunk_mean(F.col("own_mean"), F.col("own_n"), F.col(f"{p}_mean"), strength) for p in ("group", "all")})


def capacity_share(df: DataFrame, entity: str, group: str, period: str, value: str, back: int, strength: float) -> DataFrame:
    """df with the entity's share of its group's earlier cases, raw and shrunk to an equal share, times the group's last total."""
    totals = df.groupBy(group, period).agg(F.sum(value).alias("_t"), F.count(F.lit(1)).alias("_m"))
    w = W.by_value([group], period, back)
    past = totals.select(group, period, F.sum("_t").over(w).alias("_past"), F.max("_t").over(W.by_value([group], period, 1)).alias("_last"), F.col("_m"))
    own = F.coalesce(F.sum(value).over(W.by_value([entity], period, back)), F.lit(0))
    out = df.withColumn("_own", own).join(past, [group, period])
    share = F.when(F.col("_past") > 0, F.col("_own") / F.col("_past"))
    shrunk = (F.col("_own") + strength / F.col("_m")) / (F.coalesce("_past", F.lit(0)) + strength)
    return out.withColumns({"share_forecast": share * F.col("_last"), "shrunk_share_forecast": shrunk * F.col("_last")}).drop("_own", "_past", "_last", "_m")


#: Columns up to which Gramians are one aggregation of sums of products; more are summed as matrices, one a task and period.
SUMS_OF_PRODUCTS = 12


def grams(df: DataFrame, features: Sequence[str], target: str, period: str | None = None) -> dict:
    """{period: (matrix, vector)} of least-squares fits with intercept to each period's rows, from one scan; a null counts as 0.

    Without a period all rows are under None. The driver gets p^2 numbers a period.
    """
    named = {"_one": F.lit(1.0)} | {f"_{i}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate([*features, target])}
    at = F.col(period) if period else F.lit(None).cast("int")
    rows, n = df.select(at.alias("_period"), *[v.alias(k) for k, v in named.items()]), len(named)
    found, names = {}, list(named)
    if n <= SUMS_OF_PRODUCTS:
        sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]
        for row in rows.groupBy("_period").agg(*sums).collect():
            full = found.setdefault(row["_period"], np.zeros((n, n)))
            for i in range(n):
                for j in range(i, n):
                    full[i, j] = full[j, i] = row[f"s{i}_{j}"] or 0.0
    else:
        import pyarrow as pa

        kind = rows.schema["_period"].dataType

        def products(batches):
            totals: dict = {}
            for batch in batches:
                periods = batch.column("_period").to_pylist()
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                for p in set(periods):
                    part = x[[q == p for q in periods]]
                    totals[p] = totals.get(p, 0) + part.T @ part
            for p, total in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["_period", "i", "row"])

        parts = rows.withColumn("_period", F.col("_period").cast("bigint")).mapInArrow(products, "_period bigint, i int, row array<double>").select("_period", "i", F.posexplode("row").alias("j", "v"))
        for p, i, j, v in parts.groupBy(F.col("_period").cast(kind), "i", "j").agg(F.sum("v").alias("v")).collect():
            found.setdefault(p, np.zeros((n, n)))[i, j] = v
    return {p: (full[:-1, :-1], full[:-1, -1]) for p, full in found.items()}


def gram(df: DataFrame, features: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """The matrix and vector of a least-squares fit with intercept to all rows."""
    n = len(features) + 1
    return grams(df, features, target).get(None, (np.zeros((n, n)), np.zeros(n)))


def ridge_solution(matrix: np.ndarray, vector: np.ndarray, features: Sequence[str], alpha: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(columns, means, deviations, coefficients with the intercept first) of a standardised ridge fit; constant columns are left out."""
    n = matrix[0, 0]
    means = matrix[0, 1:] / n
    sds = np.sqrt(np.maximum(np.diag(matrix)[1:] / n - means**2, 0))
    keep = [i for i, sd in enumerate(sds) if sd > 1e-9]
    names, means, sds = [features[i] for i in keep], means[keep], sds[keep]
    at = [0, *[i + 1 for i in keep]]
    turn = np.eye(len(at))  # raw columns to standardised ones
    turn[1:, 1:] = np.diag(1 / sds) if len(sds) else np.zeros((0, 0))
    turn[0, 1:] = -means / sds
    z = turn.T @ matrix[np.ix_(at, at)] @ turn
    penalty = np.diag([0.0] + [alpha] * len(names))
    return names, means, sds, np.linalg.solve(z + penalty, turn.T @ vector[at])


def ridge_fit(df: DataFrame, features: Sequence[str], target: str, alpha: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The ridge solution of all rows."""
    return ridge_solution(*gram(df, features, target), features, alpha)


def ridge_predict(fit, floor: bool = True) -> Column:
    names, means, sds, beta = fit
    out = F.lit(float(beta[0]))
    for name, mean, sd, b in zip(names, means, sds, beta[1:]):
        out = out + (F.col(name).cast("double") - float(mean)) / float(sd) * float(b)
    return floor0(out) if floor else out


def ridge_backtest(df: DataFrame, features: Sequence[str], target: str, period: str, tests: Sequence[int], alpha: float, keys: Sequence[str]) -> DataFrame:
    """(keys, actual, predicted) of rows of each test period by a ridge fit to all rows of earlier periods.

    Gramians of all periods come from one scan; a fold's is their running sum. Coefficients are a row a fold, joined to its rows.
    A period without earlier rows is left out. A null feature of a test row gives a null prediction, as in ridge_predict, if the
    fold's fit uses it.
    """
    by_period = grams(df, features, target, period)
    folds = []
    for test in tests:
        past = [by_period[p] for p in sorted(p for p in by_period if p is not None and p < test)]
        if not past:
            continue
        names, means, sds, beta = ridge_solution(sum(m for m, _ in past), sum(v for _, v in past), features, alpha)
        of = {name: (float(m), float(s), float(b)) for name, m, s, b in zip(names, means, sds, beta[1:])}
        folds.append((test, float(beta[0]), [of.get(f) for f in features]))
    kind = df.schema[period].dataType.simpleString()
    fits = df.sparkSession.createDataFrame(folds, f"_fold {kind}, _first double, _terms array<struct<m:double,s:double,b:double>>")
    out = F.col("_first")
    for i, f in enumerate(features):
        term = F.get("_terms", i)
        out = out + F.when(term.isNull(), 0.0).otherwise((F.col(f).cast("double") - term.m) / term.s * term.b)
    rows = df.join(F.broadcast(fits), F.col(period) == F.col("_fold"))  # a row a fold
    return rows.select(*keys, F.col(target).cast("double").alias("actual"), floor0(out).alias("predicted"))


def forest_forecast(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, trees: int = 200, least: int = 3, seed: int = 1337, keys: Sequence[str] | None = None) -> DataFrame:
    """test, every row, with `predicted` of a random forest (square root of the features a split), null if there is nothing to learn from.

    A missing feature is its mean over the training rows, 0 if it has none there; training rows without a target are left out.
    keys tell training rows apart, all columns if none are given: the forest depends on the rows, not on their order or partitions.
    """
    rows = X.prepared(train.withColumn("_period", F.lit(0)), features, target, "_period", keys or train.columns)
    forest = X.grow(rows, [1], features, trees, least=least, seed=seed)
    return X.predict(test.withColumn("_test", F.lit(1)), forest, "_test").drop("_test")


def forest_backtest(df: DataFrame, features: Sequence[str], target: str, period: str, tests: Sequence[int], keys: Sequence[str], trees: int = 200, least: int = 3, seed: int = 1337) -> DataFrame:
    """Rows of the test periods with `predicted` of a forest of all rows of earlier periods; the forests of all periods grow together."""
    forest = X.grow(X.prepared(df, features, target, period, keys), tests, features, trees, least=least, seed=seed)
    return X.predict(df.filter(F.col(period).isin(*map(int, forest.folds))), forest, period)


def weighted_analogs(analogs: DataFrame, fold: str) -> DataFrame:
    """(fold, test_id, predicted, analogs): inverse-distance mean of the outcomes of nearest_analogs, and those outcomes with their weights."""
    both = analogs.withColumn("w", F.lit(1.0) / (F.col("distance") + 1e-9))
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("outcome").cast("double").alias("outcome"), "w")))
    return both.groupBy(fold, "test_id").agg((F.sum(F.col("outcome") * F.col("w")) / F.sum("w")).alias("predicted"), items.alias("analogs"))


#: Resampled means that one task makes, about; items up to which a draw is looked up without a function of arrays.
DRAWN = 1 << 21
FEW_ITEMS = 16


def bootstrap_intervals(analogs: DataFrame, keys: Sequence[str], seed: int = 7, draws: int = 200) -> DataFrame:
    """analogs (of weighted_analogs) with lower and upper 80 and 95 percent bounds of weighted resamples.

    Uniforms are hashes of seed, key, resample and draw, so bounds don't depend on partitioning. Rows are dealt to tasks by key, and
    each resample of a row is a row until they are sorted again, so that plain columns do the draws.
    """
    kept = settled(analogs.withColumn("_row", F.monotonically_increasing_id()))
    found = kept.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("analogs")).alias("most")).first()
    most = max(found.most or 0, 1)
    n = F.size("_outcomes")
    total = F.aggregate("analogs", F.lit(0.0), lambda a, x: a + x.w)
    edges = F.transform("analogs", lambda x, i: F.aggregate(F.slice(F.col("analogs"), F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y.w) / F.col("_total"))
    rows = spread(kept, keys, max(1, DRAWN // draws), found.rows).withColumn("_total", total)
    rows = rows.select(*keys, "_row", edges.alias("_edges"), F.transform("analogs", lambda x: x.outcome).alias("_outcomes"))
    drawn = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = drawn.withColumns({f"_u{j}": F.pmod(F.xxhash64(F.lit(seed), *keys, "_i", F.lit(j)), F.lit(1 << 30)) / float(1 << 30) for j in range(1, most + 1)})

    def pick(u: Column) -> Column:
        if most > FEW_ITEMS:
            passed = F.size(F.filter("_edges", lambda e: e <= u))
        else:
            passed = sum((F.coalesce((F.get("_edges", i) <= u).cast("int"), F.lit(0)) for i in range(most)), F.lit(0))
        return F.get("_outcomes", F.least(passed, n - 1))

    summed = sum((F.when(n >= j, pick(F.col(f"_u{j}"))).otherwise(0.0) for j in range(1, most + 1)), F.lit(0.0))
    means = drawn.select(*keys, "_row", (summed / n).alias("_mean")).groupBy(*keys, "_row").agg(F.array_sort(F.collect_list("_mean")).alias("_means"))

    def at(p: float) -> Column:
        place = p * (draws - 1)
        lo = int(place)
        a, b = F.get("_means", lo), F.get("_means", min(lo + 1, draws - 1))
        return a + (b - a) * (place - lo)

    bounds = means.select("_row", *[at(p).alias(name) for name, p in (("lower_95", 0.025), ("lower_80", 0.1), ("upper_80", 0.9), ("upper_95", 0.975))])
    return kept.join(bounds, "_row").drop("_row")


def own_history_analog(df: DataFrame, entity: str, period: str, value: str, rows: int, horizon: int = 1) -> DataFrame:
    """Per row the outcome `horizon` after the own past period whose (value, trailing mean) is nearest; ties go to the latest.

    The pairs of one entity's periods are joined by entity: histories are short, entities many.
    """
    traced = W.trailing_mean_rows(df.select(entity, period, value), [entity], period, value, rows).filter("trailing_mean IS NOT NULL")
    origin = traced.select(entity, F.col(period).alias("_o"), F.col(value).alias("_v"), F.col("trailing_mean").alias("_m"))
    later = df.select(entity, (F.col(period) - horizon).alias("_o"), F.col(value).alias("analog_forecast"))
    both = traced.join(origin.join(later, [entity, "_o"]), entity).filter(F.col("_o") + horizon <= F.col(period))
    distance = F.round(F.abs(F.col(value) - F.col("_v")) + F.abs(F.col("trailing_mean") - F.col("_m")), 9)
    best = both.withColumn("distance", distance).groupBy(entity, period).agg(F.min_by(F.struct("analog_forecast", F.col("_o").alias("analog_period"), "distance"), F.struct("distance", -F.col("_o"))).alias("b"))
    return best.select(entity, period, "b.*")


def ensemble(predictions: DataFrame, members: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """predictions with the mean of members as a further model, where all of them predicted."""
    mean = predictions.filter(F.col("model").isin(*members)).groupBy(*keys, "actual").agg(F.avg("predicted").alias("predicted"), F.countDistinct("model").alias("n")).filter(F.col("n") == len(members)).drop("n").withColumn("model", F.lit(name))
    mean = mean.withColumns({"residual": F.col("predicted") - F.col("actual"), "absolute_error": F.abs(F.col("predicted") - F.col("actual"))})
    return predictions.unionByName(mean.select(*predictions.columns))


def annual_forecast(df: DataFrame, entity: str, group: str, period: str, value: str, target: int, rows: int, least: int) -> DataFrame:
    """No-target forecasts of a future period by the closed-form models: a row is added for each entity and the windows reach it."""
    last = df.groupBy(entity).agg(F.max(period).alias("_l"), F.max_by(group, period).alias(group)).filter(F.col("_l") == target - 1)
    blank = last.select(entity, group, F.lit(target).cast(df.schema[period].dataType).alias(period), F.lit(None).cast(df.schema[value].dataType).alias(value))
    whole = df.select(entity, group, period, value).unionByName(blank)
    found = baselines(whole, entity, group, period, value, rows).filter(F.col(period) == target)
    long = found.filter(F.col("n_history") >= least).select(entity, group, period, *MODELS, "n_history").unpivot([entity, group, period, "n_history"], list(MODELS), "model", "predicted")
    return long.withColumns({"predicted": floor0(F.col("predicted")), "origin": F.lit(target - 1), "update_mode": F.lit("forecast")})


def annual_forecast_models(df: DataFrame, entity: str, group: str, period: str, value: str, cases: str, denom: str, target: int, rows: int = 3, least: int = 2, back: int = 4, strength: float = 5.0, alpha: float = 1.0, k: int = 5, edges: DataFrame | None = None) -> DataFrame:
    """(entity, group, model, predicted, origin, update_mode): all models side by side for a period that has no values yet.

    Forecast are entities with a row in the period before and at least `least` rows. Baselines, empirical Bayes, the mean of the
    nearest analogs among all earlier rows, and ridge fits to lagged columns alone, with edges (src, dst) also one that knows the
    neighbours' mean of the period before. `top4_ensemble` is the mean of prior year, linear blend and both fits, where all are there.
    """
    from panelwright.operators.features import design_matrix, moments
    from panelwright.operators.joins import nearest_analogs, neighbor_summary

    last = df.groupBy(entity).agg(F.max(period).alias("_l"), F.max_by(group, period).alias(group)).filter(F.col("_l") == target - 1)
    known = df.filter(F.col(period) < target).select(entity, group, period, value, cases, denom)
    blank = last.select(entity, group, *[F.lit(target if c == period else None).cast(df.schema[c].dataType).alias(c) for c in (period, value, cases, denom)])
    whole = settled(known.unionByName(blank))
    now = F.col(period) == target
    keys = [entity, group]
    base = baselines(whole, entity, group, period, value, rows).filter(now & (F.col("n_history") >= least))
    eb = empirical_bayes(whole, entity, group, period, value, back, strength).filter(now).select(entity, F.col("eb_group").alias("empirical_bayes"))
    neighbors = neighbor_summary(whole, edges, entity, period, value, 1) if edges is not None else None
    matrix, schema = design_matrix(whole, entity, group, period, value, cases, denom, [], [group], rows, neighbors)
    matrix = settled(matrix)
    spatial = [f for f in schema.features if "neighbor" in f]
    safe = [f for f in schema.features if f not in spatial]
    fit = lambda names, name: ridge_backtest(matrix, names, f"target_{value}", period, [target], alpha, [entity]).select(entity, F.col("predicted").alias(name))
    lags = [f for f in safe if not f.startswith(f"feature_{group}_")]
    past = matrix.filter(F.col(period) < target)
    stats = moments(past, lags)
    scaled = lambda part: part.select(F.lit(target).alias("fold"), F.col(entity).alias("id"), period, F.col(f"target_{value}").alias("outcome"), *[((F.col(c) - m) / sd).alias(c) for c, (m, sd) in stats.items()])
    near = weighted_analogs(nearest_analogs(scaled(matrix.filter(now)), scaled(past), lags, "fold", period, k), "fold").select(F.col("test_id").alias(entity), F.col("predicted").alias("analog"))
    found = base.join(eb, entity, "left").join(near, entity, "left").join(fit(safe, "ridge"), entity, "left")
    models = [*MODELS, "empirical_bayes", "analog", "ridge"]
    if spatial:
        found = found.join(fit(list(schema.features), "ridge_spatial"), entity, "left")
        found = found.withColumn("top4_ensemble", (floor0(F.col("prior_year")) + floor0(F.col("linear_blend")) + F.col("ridge") + F.col("ridge_spatial")) / 4)
        models += ["ridge_spatial", "top4_ensemble"]
    long = found.select(*keys, *[F.col(m).cast("double").alias(m) for m in models]).unpivot(keys, models, "model", "raw").filter("raw IS NOT NULL")
    return long.select(*keys, "model", floor0(F.col("raw")).alias("predicted"), F.lit(target - 1).alias("origin"), F.lit("forecast").alias("update_mode"))


class MixedResiduals(ValueError):
    """Residuals of one model that were made in more than one way, or too few of them."""


def residual_intervals(forecasts: DataFrame, residuals: DataFrame, period: str, origin: int, least: int, aliases: Mapping[str, str] | None = None, branch: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """forecasts (model, predicted) with bounds from quantiles of residuals (actual - predicted) up to the origin, of the same model
    or of the one that aliases names for it.

    branch names columns of residuals that say how they were made: a model whose residuals differ in one is refused. With strict a
    forecast model without `least` residuals is refused too; else its forecasts are left out.
    """
    past = residuals.filter(F.col(period) <= origin)
    if branch:
        mixed = past.select("model", *branch).distinct().groupBy("model").count().filter("count > 1").limit(5).collect()
        if mixed:
            raise MixedResiduals(f"residuals of {sorted(r.model for r in mixed)} differ in {list(branch)}")
    quantiles = W.quantile_linear(past.select("model", (F.col("actual") - F.col("predicted")).alias("_r")), ["model"], "_r", PROBABILITIES, "n_residuals").filter(F.col("n_residuals") >= least)
    source = F.coalesce(*[F.when(F.col("model") == a, F.lit(b)) for a, b in (aliases or {}).items()], F.col("model"))
    asked = forecasts.withColumn("_source", source)
    bounds_of = F.broadcast(quantiles.withColumnRenamed("model", "_source"))  # a row per model
    if strict:
        short = asked.join(bounds_of, "_source", "left_anti").select("model").distinct().limit(5).collect()
        if short:
            raise MixedResiduals(f"fewer than {least} residuals up to {origin} for {sorted(r.model for r in short)}")
    joined = asked.join(bounds_of, "_source").drop("_source")
    bounds = {"lower_95": "q025", "lower_80": "q100", "center": "q500", "upper_80": "q900", "upper_95": "q975"}
    return joined.withColumns({k: floor0(F.col("predicted") + F.col(q)) for k, q in bounds.items()}).drop(*PROBABILITIES)


def _histories(df: DataFrame, model: str, regime: str, period: str) -> DataFrame:
    own = W.expanding_sums(df, [model, regime], period, ["actual", "predicted"], "r_")
    return W.expanding_sums(own, [model], period, ["actual", "predicted"], "o_")


def ratio_calibration(df: DataFrame, model: str, regime: str, period: str, least: int, strength: float) -> DataFrame:
    """df with a shrunken observed-to-predicted multiplier from earlier periods: of the regime, else overall, else 1."""
    h = _histories(df, model, regime, period)
    use_regime = (F.col("r_n") >= least) & (F.col("r_predicted") > 0)
    use_all = (F.col("o_n") >= least) & (F.col("o_predicted") > 0)
    ratio = lambda p: (F.col(f"{p}_actual") + strength) / (F.col(f"{p}_predicted") + strength)
    out = h.withColumns({"scope": F.when(use_regime, "regime").when(use_all, "overall").otherwise("none"), "multiplier": F.when(use_regime, ratio("r")).when(use_all, ratio("o")).otherwise(F.lit(1.0))})
    out = out.withColumn("calibrated", F.col("predicted") * F.col("multiplier"))
    return out.drop(*[f"{a}_{b}" for a in "ro" for b in ("actual", "predicted", "n")])


def gamma_poisson(df: DataFrame, model: str, regime: str, period: str, least: int, strength: float) -> DataFrame:
    """df with the posterior case multiplier from earlier sums and a moment-based predictive interval."""
    h = _histories(df, model, regime, period)
    use_regime, use_all = F.col("r_n") >= least, F.col("o_n") >= least
    pick = lambda c: F.when(use_regime, F.col(f"r_{c}")).when(use_all, F.col(f"o_{c}")).otherwise(F.lit(0.0))
    shape, rate = F.lit(strength) + pick("actual"), F.lit(strength) + pick("predicted")
    out = h.withColumns({"scope": F.when(use_regime, "regime").when(use_all, "overall").otherwise("prior"), "shape": shape, "rate": rate})
    mean = F.col("predicted") * F.col("shape") / F.col("rate")
    out = out.withColumns({"posterior": mean, "variance": mean + F.col("predicted") ** 2 * F.col("shape") / F.col("rate") ** 2})
    out = out.withColumns({"lower_95": floor0(F.col("posterior") - 1.96 * F.sqrt("variance")), "upper_95": F.col("posterior") + 1.96 * F.sqrt("variance")})
    out = out.withColumn("covered_95", F.col("actual").between(F.col("lower_95"), F.col("upper_95")))
    return out.drop(*[f"{a}_{b}" for a in "ro" for b in ("actual", "predicted", "n")])


def promotion_gate(level: Column, rate_gain: Column, case_gain: Column) -> tuple[Column, Column]:
    """(decision, reason): only the overall row may pass, and only if both errors improve."""
    overall = level == "overall"
    decision = F.when(overall & (rate_gain > 0) & (case_gain > 0), "promote").otherwise("hold")
    reason = F.when(~overall, "subgroup rows never pass").when(rate_gain <= 0, "rate error doesn't improve").when(case_gain <= 0, "case error doesn't improve").otherwise("both errors improve")
    return decision, reason


def surveillance_regime(flags: Column, period: Column, change: int) -> Column:
    return first_match([(flags.contains("source_conflict"), "conflicting"), (period < change, "old_definition")], "current")


def classified(both: DataFrame, as_of: Column, cutoff: Column, near: float) -> DataFrame:
    """Rows with actual, predicted, lower_95 and upper_95: residual, direction, coverage and its reading (first match)."""
    out = both.withColumn("residual", F.col("actual") - F.col("predicted"))
    direction = F.when(F.col("residual") > near, "above").when(F.col("residual") < -near, "below").when(F.col("residual").isNotNull(), "near")
    out = out.withColumns({"covered_95": F.col("actual").between(F.col("lower_95"), F.col("upper_95")), "direction": direction})
    reading = first_match([(F.col("actual").isNull(), "pending"), (as_of > cutoff, "late_data"), (F.col("covered_95"), "expected"), (F.col("direction") == "above", "higher_than_expected")], "lower_than_expected")
    return out.withColumn("interpretation", reading)


def update_audit(forecasts: DataFrame, observed: DataFrame, keys: Sequence[str], as_of: Column, cutoff: Column, near: float) -> DataFrame:
    """Forecasts against the observations that have arrived."""
    return classified(forecasts.join(observed, list(keys), "left"), as_of, cutoff, near)


SEVERITY = [(10.0, "very low"), (25.0, "low"), (75.0, "typical"), (90.0, "high")]


def typicality(forecasts: DataFrame, history: DataFrame, entity: str, value: str, least: int) -> DataFrame:
    """forecasts, every row, as percentiles of the entity's own history, its quartiles, the distance to their band, and labels."""
    from panelwright.functions.expressions import bucketize

    quartiles = W.quantile_linear(history, [entity], value, {"p25": 0.25, "p75": 0.75})
    past = history.select(entity, F.col(value).alias("_h"))
    placed = W.ecdf(forecasts.select(entity, F.col(value).alias("_f")), past, [entity], "_f", "_h", "percentile").withColumnRenamed("percentile_n", "n_history")
    found = placed.join(quartiles, entity, "left").withColumn("percentile", F.col("percentile") * 100)
    outside = F.when(F.col("_f") > F.col("p75"), F.col("_f") - F.col("p75")).when(F.col("_f") < F.col("p25"), F.col("_f") - F.col("p25")).otherwise(F.lit(0.0))
    evidence = F.when(F.col("n_history") >= 2 * least, "strong").when(F.col("n_history") >= least, "moderate").otherwise("weak")
    return found.withColumns({"severity": bucketize(F.col("percentile"), SEVERITY, "very high"), "distance": outside, "evidence": evidence}).withColumnRenamed("_f", value)


def interval_typicality(forecasts: DataFrame, history: DataFrame, entity: str, value: str, lower: str, upper: str, least: int) -> DataFrame:
    """typicality of forecasts (entity, value, lower, upper) with the percentiles of both bounds and a label of the whole interval.

    Bounds are compared with the same history; the label is one severity, or `a to b` where the bounds' severities differ.
    """
    from panelwright.functions.expressions import bucketize

    past = history.select(entity, F.col(value).alias("_h"))
    found = forecasts.select(entity, value, lower, upper)
    for bound in (lower, upper):
        found = W.ecdf(found, past, [entity], bound, "_h", f"{bound}_percentile").drop(f"{bound}_percentile_n")
        found = found.withColumn(f"{bound}_percentile", F.col(f"{bound}_percentile") * 100)
    labels = [bucketize(F.col(f"{bound}_percentile"), SEVERITY, "very high") for bound in (lower, upper)]
    label = F.when(labels[0] == labels[1], labels[0]).when(labels[0].isNotNull() & labels[1].isNotNull(), F.concat(labels[0], F.lit(" to "), labels[1]))
    own = typicality(forecasts.select(entity, value).distinct(), history, entity, value, least)
    return found.withColumn("interval_severity", label).join(own, [entity, value], "left")


def capacity(forecasts: DataFrame, totals: DataFrame, group: str, value: str) -> DataFrame:
    """Forecast totals per group against totals of complete past periods: percentile, extremes and where the total lies."""
    now = forecasts.groupBy(group).agg(F.sum(value).alias("forecast"))
    both = now.join(totals.select(group, F.col("total").alias("_h")), group, "left")
    found = both.groupBy(group, "forecast").agg(F.count("_h").alias("n"), F.min("_h").alias("least"), F.percentile("_h", F.lit(0.5)).alias("median"), F.max("_h").alias("most"), F.avg((F.col("_h") <= F.col("forecast")).cast("double") * 100).alias("percentile"))
    return found.withColumn("place", F.when(F.col("n") == 0, "no history").when(F.col("forecast") > F.col("most"), "above maximum").when(F.col("forecast") < F.col("least"), "below minimum").otherwise("within range"))


def seasonal_baseline(df: DataFrame, year: str, period: str, value: str) -> DataFrame:
    """Per period: mean, median and extremes of its yearly shares, nearest-rank bands, peak rank and capped running sum."""
    shares = W.share_of_total(df, [year], value, empty=0.0)
    stats = shares.groupBy(period).agg(F.avg("share").alias("mean_share"), F.percentile("share", F.lit(0.5)).alias("median_share"), F.min("share").alias("min_share"), F.max("share").alias("max_share"))
    bands = W.quantile_nearest(shares, [period], "share", {"lower_80": 0.1, "upper_80": 0.9, "lower_95": 0.025, "upper_95": 0.975})
    joined = stats.join(bands, period).withColumn("_all", F.lit(0))
    return W.rank_and_cumulative(joined, ["_all"], period, "mean_share").drop("_all")


def seasonal_scores(rows: DataFrame, curve: DataFrame, value: str, share: str, quantile: float, headroom: float) -> DataFrame:
    """Annual rows spread over the curve and scored 1 to 10 against a nearest-rank benchmark of all spread values."""
    from panelwright.operators.joins import cross_allocate

    spread = cross_allocate(rows, curve, value, share, "allocated").withColumn("allocated", F.round("allocated", 6))
    benchmark = W.quantile_nearest(spread.filter("allocated > 0").withColumn("_all", F.lit(0)), ["_all"], "allocated", {"benchmark": quantile}).select("benchmark")
    both = spread.crossJoin(F.broadcast(benchmark))  # one row
    raw = F.col("allocated") / (F.col("benchmark") * headroom) * 10
    score = F.least(F.greatest(half_even(F.round(raw, 9)), F.lit(1)), F.lit(10))
    label = F.when(score <= 3, "low").when(score <= 6, "moderate").when(score <= 8, "high").otherwise("very high")
    return both.withColumns({"score": score, "category": label})


STAGE_FACTORS: Mapping[str, float] = {"a": 1.0, "b": 0.6}


def decision_scores(events: DataFrame, baseline: str, kind: str, hours: str, count: str, aliases: Mapping[str, str], factors: Mapping[str, float]) -> DataFrame:
    """A table of exposure events scored: alias, multiplied modifiers, chance of any of `count` exposures, criteria and a verdict of three states."""
    name = F.lower(F.trim(kind))
    for alias, target in aliases.items():
        name = F.when(name == alias, target).otherwise(name)
    rows = events.withColumn("kind_name", name)
    factor = F.coalesce(*[F.when(F.col("kind_name") == k, F.lit(v)) for k, v in factors.items()], F.lit(0.5))
    time = F.when(F.col(hours).isNull(), 0.8).when(F.col(hours) < 24, 0.25).when(F.col(hours) < 48, 0.6).otherwise(1.0)
    single = F.least(F.col(baseline) * factor * time, F.lit(1.0))
    rows = rows.withColumn("chance", 1 - F.pow(1 - single, F.col(count)))
    criteria = F.array(
        F.struct(F.lit("known_kind").alias("name"), F.col("kind_name").isin(*factors).alias("met")),
        F.struct(F.lit("long_exposure").alias("name"), (F.col(hours) >= 36).alias("met")),
        F.struct(F.lit("high_baseline").alias("name"), (F.col(baseline) >= 0.2).alias("met")),
    )
    rows = rows.withColumns({"criteria": criteria, "score": F.least(F.ceil(F.round(F.col("chance") * 10, 9)), F.lit(10))})
    verdict = F.when(F.exists("criteria", lambda x: ~F.coalesce(x.met, F.lit(True))), "not_met").when(F.forall("criteria", lambda x: F.coalesce(x.met, F.lit(False))), "met").otherwise("uncertain")
    return rows.withColumn("verdict", verdict)
