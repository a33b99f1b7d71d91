"""Ranks, lags, trailing statistics, shares and quantiles of panels.

Two meanings of "the periods before" are kept apart: frames by value (`years` calendar periods back, whatever
rows exist) and frames by row (the last `rows` rows that exist). Entity windows partition by entity, so that
several of them share one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from panelwright.operators.storage import settled

#: Rows of a group that one task may sort.
LARGE = 1_000_000
TIERS = ((0.1, "top_decile"), (0.2, "top_quintile"), (0.5, "top_half"))


def by_value(entity: Sequence[str], period: str, back: int | None, upto: int = -1) -> WindowSpec:
    """Rows whose period lies in [period - back, period + upto]; no lower bound if back is None."""
    start = Window.unboundedPreceding if back is None else -back
    return Window.partitionBy(*entity).orderBy(period).rangeBetween(start, upto)


def by_row(entity: Sequence[str], period: str, rows: int) -> WindowSpec:
    """The last rows rows before the current one."""
    return Window.partitionBy(*entity).orderBy(period).rowsBetween(-rows, -1)


def ceil_share(n: Column, q: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.round(n * q, 9)))


def rank_tier(df: DataFrame, groups: Sequence[str], value: str, entity: str, prefix: str = "", tiers=TIERS, rest: str = "lower_half", none_label: str | None = None, large: int = LARGE) -> DataFrame:
    """df with rank, n_ranked, percentile and tier of value within groups.

    Ranks run from the largest value, equal values by entity; null values have none. With none_label, values
    of 0 and less are labelled so. Large groups are ranked as in `numbered`.
    """
    known = F.col(value).isNotNull()
    order = [F.col(value).desc_nulls_last(), F.col(entity).asc()]
    out = running(df, groups, order, {f"{prefix}rank": F.lit(1)}, {f"{prefix}n_ranked": known.cast("bigint")}, large)
    out = out.withColumns({f"{prefix}rank": F.when(known, F.col(f"{prefix}rank").cast("int")), f"{prefix}n_ranked": F.when(known, F.col(f"{prefix}n_ranked"))})
    r, n = F.col(f"{prefix}rank"), F.col(f"{prefix}n_ranked")
    percentile = F.when(r.isNull(), None).when(n <= 1, F.lit(1.0)).otherwise((n - r) / (n - 1))
    tier = F.when(r.isNull(), None)
    if none_label:
        tier = tier.when(F.col(value) <= 0, none_label)
    for q, label in tiers:
        tier = tier.when(r <= ceil_share(n, q), label)
    return out.withColumns({f"{prefix}percentile": percentile, f"{prefix}tier": tier.otherwise(rest)})


def prior_period(df: DataFrame, entity: Sequence[str], period: str, columns: Sequence[str], prefix: str = "prior_") -> DataFrame:
    """df with the values of exactly the period before; null where that period has no row."""
    w = by_value(entity, period, 1)
    return df.withColumns({f"{prefix}{c}": F.max(c).over(w) for c in columns})


def trailing_stats(df: DataFrame, entity: Sequence[str], period: str, value: str, back: int, prefix: str = "trailing_") -> DataFrame:
    """Minimum, mean, maximum and count of value over the back periods before, and whether value lies in that band."""
    w = by_value(entity, period, back)
    out = df.withColumns({f"{prefix}min": F.min(value).over(w), f"{prefix}mean": F.avg(value).over(w), f"{prefix}max": F.max(value).over(w), f"{prefix}n": F.count(value).over(w)})
    inside = F.col(value).between(F.col(f"{prefix}min"), F.col(f"{prefix}max"))
    return out.withColumns({f"{prefix}in_band": inside, f"{prefix}partial": F.col(f"{prefix}n") < back})


def trailing_mean_rows(df: DataFrame, entity: Sequence[str], period: str, value: str, rows: int) -> DataFrame:
    w = by_row(entity, period, rows)
    return df.withColumns({"trailing_mean": F.avg(value).over(w), "trailing_rows": F.count(value).over(w)})


def season_anomaly(df: DataFrame, entity: Sequence[str], season: str, year: str, value: str, back: int = 10) -> DataFrame:
    """value less its mean in the same season of the years before."""
    w = by_value([*entity, season], year, back)
    return df.withColumns({"baseline": F.avg(value).over(w), "baseline_n": F.count(value).over(w), "anomaly": F.col(value) - F.avg(value).over(w)})


def share_of_total(df: DataFrame, groups: Sequence[str], value: str, name: str = "share", empty: float | None = None) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*groups))
    return df.withColumn(name, F.when(total != 0, F.col(value) / total).otherwise(F.lit(empty)))


def rank_and_cumulative(df: DataFrame, groups: Sequence[str], period: str, share: str) -> DataFrame:
    peak = Window.partitionBy(*groups).orderBy(F.col(share).desc(), period)
    running = Window.partitionBy(*groups).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"peak_rank": F.row_number().over(peak), "cumulative": F.least(F.sum(share).over(running), F.lit(1.0))})


def growth(df: DataFrame, entity: Sequence[str], period: str, value: str) -> DataFrame:
    """Change and percentage change since the period before; the mean of exactly three yearly changes."""
    prior = F.max(value).over(by_value(entity, period, 1))
    out = df.withColumn("prior_value", prior)
    out = out.withColumns({"change": F.col(value) - F.col("prior_value"), "pct": F.when(F.col("prior_value") != 0, (F.col(value) - F.col("prior_value")) / F.col("prior_value") * 100)})
    three = by_value(entity, period, 2, 0)
    return out.withColumn("mean_pct_3", F.when(F.count("pct").over(three) == 3, F.avg("pct").over(three)))


def history_summary(df: DataFrame, entity: Sequence[str], period: str, value: str, back: int, least: int) -> DataFrame:
    """Mean, extremes, population deviation, first, last and trend of the back periods before; rows with too few or without the last are dropped."""
    w = by_value(entity, period, back)
    known = F.when(F.col(value).isNotNull(), F.col(period))
    first, last = F.min_by(value, known).over(w), F.max_by(value, known).over(w)
    out = df.withColumns({"h_mean": F.avg(value).over(w), "h_min": F.min(value).over(w), "h_max": F.max(value).over(w), "h_sd": F.stddev_pop(value).over(w), "h_first": first, "h_last": last, "h_n": F.count(value).over(w), "h_prior": F.max(value).over(by_value(entity, period, 1))})
    return out.filter((F.col("h_n") >= least) & F.col("h_prior").isNotNull()).withColumn("h_trend", F.col("h_last") - F.col("h_first"))


def pooled_prior_means(df: DataFrame, group: str, period: str, value: str, back: int) -> DataFrame:
    """(group, period, group_mean, all_mean): means over rows of the back periods before, in the group and overall.

    Sums by group and period come first, so no row is read again for each window.
    """
    sums = df.groupBy(group, period).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    everywhere = sums.groupBy(period).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = by_value([group], period, back)
    all_ = Window.partitionBy(F.lit(0)).orderBy(period).rangeBetween(-back, -1)  # one row per period
    groups = sums.select(group, period, (F.sum("s").over(own) / F.sum("n").over(own)).alias("group_mean"))
    overall = everywhere.select(period, (F.sum("s").over(all_) / F.sum("n").over(all_)).alias("all_mean"))
    return groups.join(overall, period)


def group_rate(df: DataFrame, group: str, period: str, numerator: str, denominator: str) -> DataFrame:
    """(group, period, group_rate) and the rate of the period before, with a flag where it is missing."""
    sums = df.groupBy(group, period).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    rates = sums.select(group, period, F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("group_rate"))
    return prior_period(rates, [group], period, ["group_rate"]).withColumn("prior_missing", F.col("prior_group_rate").isNull().cast("int"))


def trend_multiplier(rates: DataFrame, group: str, period: str, rate: str, rows: int) -> DataFrame:
    """Last rate over the mean of the last rows rates; 1 where there is none or it is zero."""
    w = by_row([group], period, rows)
    mean, last = F.avg(rate).over(w), F.last(rate).over(w)
    return rates.withColumn("multiplier", F.when(mean > 0, last / mean).otherwise(F.lit(1.0)))


def expanding_sums(df: DataFrame, groups: Sequence[str], period: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """df with the sums of columns, and the count of rows, over all earlier periods of its groups.

    Groups are summed by period before the window, and whole periods are earlier: peers of a period aren't.
    """
    by_period = df.groupBy(*groups, period).agg(*[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))
    w = by_value(groups, period, None)
    sums = {f"{prefix}{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in [*columns, "n"]}
    return df.join(by_period.select(*groups, period, *[v.alias(k) for k, v in sums.items()]), [*groups, period])


def keep_latest(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), period).alias("_row"))
    return best.select(*keys, "_row.*")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that is least in order, a list of expressions."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def _order_statistics(df: DataFrame, groups: Sequence[str], value: str, places: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(groups, n, named values): of each group with known values their number and the values at places, from 1, as functions of it.

    Distinct values are counted first; running counts give a value's places, in ranges where a group has very many values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = running(counts, groups, [F.col(value).asc()], {"_upto": F.col("_c")}, {"_n": F.col("_c")})
    first = {name: F.min(F.when(F.col("_upto") >= place(F.col("_n")), F.col(value))).alias(name) for name, place in places.items()}
    return upto.groupBy(*groups).agg(F.max("_n").alias("n"), *first.values())


def quantile_nearest(df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles, the value at max(1, ceil(p n)), from counts of distinct values."""
    return _order_statistics(df, groups, value, {name: lambda n, p=p: ceil_share(n, p) for name, p in probabilities.items()}).drop("n")


def quantile_linear(df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float], count: str | None = None) -> DataFrame:
    """Quantiles interpolated at (n - 1) p between two order statistics, from counts of distinct values; groups without any have no row.

    With count, the number of values is kept under that name.
    """
    low = lambda p: lambda n: F.floor((n - 1) * p) + 1
    high = lambda p: lambda n: F.ceil((n - 1) * p) + 1
    found = _order_statistics(df, groups, value, {f"_{end}_{name}": place(p) for name, p in probabilities.items() for end, place in (("low", low), ("high", high))})
    between = lambda name, p: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p))
    return found.select(*groups, *[between(name, p).cast("double").alias(name) for name, p in probabilities.items()], *([F.col("n").alias(count)] if count else []))


def ecdf(df: DataFrame, history: DataFrame, keys: Sequence[str], value: str, past: str, name: str = "ecdf") -> DataFrame:
    """df, every row, with the share of its keys' history values that are at most value, and their number; history is (keys, past).

    Distinct values of both are counted before a window runs over them, so no row meets a history row: null keys have no
    history, a null value or no history gives a null share.
    """
    old = history.filter(F.col(past).isNotNull()).groupBy(*keys, F.col(past).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    now = df.select(*keys, F.col(value).alias("_v")).distinct().withColumn("_c", F.lit(None).cast("bigint"))
    whole = Window.partitionBy(*keys)
    upto = F.coalesce(F.sum("_c").over(whole.orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)), F.lit(0))
    placed = old.unionByName(now).withColumns({"_upto": upto, f"{name}_n": F.coalesce(F.sum("_c").over(whole), F.lit(0))}).filter("_c IS NULL").drop("_c")
    found = placed.withColumn(name, F.when(F.col("_v").isNotNull() & (F.col(f"{name}_n") > 0), F.col("_upto") / F.col(f"{name}_n"))).drop("_upto")
    a, b = df.alias("a"), found.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"a.{value}").eqNullSafe(F.col("b._v"))]
    known = [F.col(f"a.{k}").isNotNull() for k in keys]
    n = F.when(reduce(lambda x, y: x & y, known), F.col(f"b.{name}_n")).otherwise(F.lit(0))
    return a.join(b, reduce(lambda x, y: x & y, same)).select("a.*", F.when(n > 0, F.col(f"b.{name}")).alias(name), n.alias(f"{name}_n"))


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))


def in_ranges(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df, written once, with its range: rows of a smaller range come before those of a larger in the order of groups and then `order`.

    Ranges are cut by the whole order, so that a value which very many rows have is cut too if order goes on behind it.
    """
    return settled(df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_range", F.spark_partition_id()))


def running(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], totals: Mapping[str, Column] | None = None, large: int = LARGE) -> DataFrame:
    """df with the sum of each of sums over its group's rows up to this one in order, and of each of totals over the whole group.

    Groups of at most `large` rows are sorted by one task each. If any has more, all are cut into ranges of their order; a sum is
    that within the range and the sums of the ranges before it: as exact for whole numbers, with a task a range. order should
    tell rows of a group apart.
    """
    totals = totals or {}
    most = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    if most <= large:
        w, whole = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*groups)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.sum(c).over(whole) for n, c in totals.items()})
    dealt = in_ranges(df.withColumns({f"_of_{n}": c for n, c in {**sums, **totals}.items()}), groups, order)
    parts = dealt.groupBy(*groups, "_range").agg(*[F.sum(f"_of_{n}").alias(f"_of_{n}") for n in {**sums, **totals}])
    earlier, whole = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups)
    before = {f"_before_{n}": F.coalesce(F.sum(f"_of_{n}").over(earlier), F.lit(0)) for n in sums} | {n: F.sum(f"_of_{n}").over(whole) for n in totals}
    parts = settled(parts.select(*groups, "_range", *[c.alias(n) for n, c in before.items()]))
    w = Window.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumns({f"_within_{n}": F.sum(f"_of_{n}").over(w) for n in sums})
    both = within.alias("a").join(parts.alias("b"), _same([*groups, "_range"]))
    return both.select(*[F.col(f"a.{c}") for c in df.columns], *[(F.col(f"_within_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums], *[F.col(f"b.{n}").alias(n) for n in totals])


def numbered(df: DataFrame, groups: Sequence[str], value: str, entity: str, name: str, large: int = LARGE) -> DataFrame:
    """df with each row's place in its group from the largest value on, nulls last, equal values by entity; see `running`."""
    placed = running(df, groups, [F.col(value).desc_nulls_last(), F.col(entity).asc()], {name: F.lit(1)}, large=large)
    return placed.withColumn(name, F.col(name).cast("int"))
