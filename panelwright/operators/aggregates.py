"""Reconciliation, calendar roll-ups, runs, multi-level metrics and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.functions.expressions import days_in_month, flag_when, flags_text, iso_week, iso_year
from panelwright.operators.joins import attach_strict
from panelwright.operators.windows import numbered


def no_flags() -> Column:
    return F.array().cast("array<string>")


def sum_by_status(df: DataFrame, keys: Sequence[str], status: str, value: str, statuses: Sequence[str]) -> DataFrame:
    """One column per status and their total; statuses are given, so no pass looks for them."""
    sums = [F.sum(F.when(F.col(status) == s, F.col(value)).otherwise(0)).alias(s) for s in statuses]
    return df.groupBy(*keys).agg(*sums, F.sum(value).alias("total"))


def reconcile_sources(df: DataFrame, keys: Sequence[str], source: str, total: str, priority: Sequence[str]) -> DataFrame:
    """One row per key from the source of highest priority (others last, by name), whether sources agree, and all their values."""
    place = F.coalesce(*[F.when(F.col(source) == s, F.lit(i)) for i, s in enumerate(priority)], F.lit(len(priority)))
    item = F.struct(place.alias("place"), F.col(source).alias("source"), F.col(total).alias("total"))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"), F.countDistinct(total).alias("values"))
    summary = F.array_join(F.transform("items", lambda x: F.concat(x.source, F.lit("="), x.total.cast("string"))), ";")
    first = F.get("items", 0)
    status = F.when(F.size("items") == 1, "single").when(F.col("values") == 1, "matched").otherwise("conflict")
    flags = flag_when(flag_when(no_flags(), F.col("values") > 1, "source_conflict"), first.place > 0, "fallback_source")
    return grouped.select(*keys, first.total.alias("total"), first.source.alias("source"), status.alias("status"), summary.alias("summary"), flags_text(flags).alias("flags"))


def consistent(df: DataFrame, keys: Sequence[str], must_agree: str, may_differ: Sequence[str]) -> DataFrame:
    """One row per key: rows that disagree on must_agree are an error, on may_differ give null."""
    aggs = [F.min(must_agree).alias("_lo"), F.max(must_agree).alias("_hi")]
    aggs += [F.when(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c)).alias(c) for c in may_differ]
    found = df.groupBy(*keys).agg(*aggs)
    agreed = F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo")).otherwise(F.raise_error(F.concat(F.lit(f"rows disagree on {must_agree}: "), F.to_json(F.struct(*keys)))))
    return found.select(*keys, agreed.alias(must_agree), *may_differ)


def calendar_rollup(df: DataFrame, entity: str, day: str, value: str, grain: str, threshold: float, base: float) -> DataFrame:
    """Daily values by ISO week or month: days over a threshold, degree sums over a base, sums, means and completeness."""
    d = F.col(day)
    keys = [iso_year(d).alias("year"), iso_week(d).alias("period")] if grain == "week" else [F.year(d).alias("year"), F.month(d).alias("period")]
    expected = F.lit(7) if grain == "week" else F.max(days_in_month(d))
    v = F.col(value)
    found = df.groupBy(entity, *keys).agg(
        F.count_if(v >= threshold).alias("days_over"),
        F.sum(F.greatest(v - base, F.lit(0.0))).alias("degree_sum"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.countDistinct(d).alias("days"),
        expected.alias("expected"),
        F.count_if(v.isNull()).alias("n_missing"),
    )
    flags = flag_when(flag_when(no_flags(), F.col("days") < F.col("expected"), "partial_period"), F.col("n_missing") > 0, f"partial_{value}")
    return found.withColumns({"ratio": F.col("days") / F.col("expected"), "flags": flags_text(flags)})


def longest_run(df: DataFrame, keys: Sequence[str], order: str, holds: Column) -> DataFrame:
    """(keys, longest): the longest run of consecutive rows that hold; a missing day doesn't break a run, null rows are passed over."""
    rows = df.select(*keys, order, holds.alias("holds")).filter("holds IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "holds").orderBy(order))
    runs = rows.withColumn("island", island).groupBy(*keys, "holds", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.max(F.when(F.col("holds"), F.col("n")).otherwise(0)).alias("longest"))


def week_fragments(df: DataFrame, start: str, end: str) -> DataFrame:
    """Each interval cut at the years that it touches: (year, days, share) for every piece."""
    years = F.explode(F.sequence(F.year(start), F.year(end))).alias("year")
    pieces = df.select("*", years)
    first = F.greatest(F.col(start), F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    last = F.least(F.col(end), F.make_date(F.col("year"), F.lit(12), F.lit(31)))
    pieces = pieces.withColumn("days", F.datediff(last, first) + 1)
    return pieces.withColumn("share", F.col("days") / (F.datediff(end, start) + 1))


def weighted_period(df: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str], capped: Sequence[str], weight: str, days: str) -> DataFrame:
    """Weighted sums and means over fragments, and maxima capped by a fragment's days."""
    w = F.col(weight)
    aggs = [F.sum(F.col(c) * w).alias(f"{c}_sum") for c in sums]
    aggs += [(F.sum(F.col(c) * F.col(days)) / F.sum(F.when(F.col(c).isNotNull(), F.col(days)))).alias(f"{c}_mean") for c in means]
    aggs += [F.max(F.least(F.col(c), F.col(days))).alias(f"{c}_max") for c in capped]
    return df.groupBy(*keys).agg(*aggs)


def season_aggregate(df: DataFrame, entity: str, day: str, value: str, level: float, months: tuple[int, int]) -> DataFrame:
    d, v = F.col(day), F.col(value)
    season = F.month(d).between(*months)
    return df.groupBy(entity, F.year(d).alias("period")).agg(
        F.count_if(v >= level).alias("n_over"),
        F.count_if((v >= level) & season).alias("n_over_season"),
        F.avg(v).alias("mean"),
        F.max(v).alias("most"),
        F.avg(F.when(season, v)).alias("season_mean"),
        F.coalesce(F.sum(F.when(season, v)), F.lit(0.0)).alias("season_sum"),
    )


def complete_groups(df: DataFrame, keys: Sequence[str], member: str, value: str, expected: int, period: str) -> DataFrame:
    """Mean, minimum and maximum of groups that hold every member with a value, emitted one period later."""
    found = df.groupBy(*keys).agg(F.countDistinct(member).alias("members"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    kept = found.filter((F.col("members") == expected) & (F.col("n") == expected))
    return kept.select(*[(F.col(k) + 1).alias(k) if k == period else F.col(k) for k in keys], "mean", "least", "most")


def complete_periods(df: DataFrame, group: str, entity: str, period: str, value: str) -> DataFrame:
    """(group, period, total) of the periods in which every entity that the group ever has is present."""
    members = df.groupBy(group).agg(F.countDistinct(entity).alias("members"))
    sums = df.filter(F.col(value).isNotNull()).groupBy(group, period).agg(F.countDistinct(entity).alias("present"), F.sum(value).alias("total"))
    return sums.join(members, group).filter("present = members").select(group, period, "total")


def latest_complete_period(df: DataFrame, group: str, entity: str, period: str, value: str) -> DataFrame:
    return complete_periods(df, group, entity, period, value).groupBy(group).agg(F.max(period).alias("latest"))


def derive_missing_total(df: DataFrame, keys: Sequence[str], category: str, value: str, label: str = "all") -> DataFrame:
    """df and, for keys without a row of the category label, one with the sum of the others."""
    explicit = df.filter(F.col(category) == label).select(*keys)
    sums = df.filter(F.col(category) != label).groupBy(*keys).agg(F.sum(value).alias(value)).join(explicit, list(keys), "left_anti")
    own = df.select(*keys, category, value, F.lit(False).alias("is_derived"))
    return own.unionByName(sums.select(*keys, F.lit(label).alias(category), value, F.lit(True).alias("is_derived")))


def pearson(x: str, y: str) -> Column:
    """Correlation; null where either column is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def error_metrics(df: DataFrame, levels: Sequence[Sequence[str]], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, bias, Pearson r and n at several grains at once (grouping sets); columns of other grains are null."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    rows = df.withColumn("_e", F.col(predicted) - F.col(actual))
    grouped = rows.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in columns])
    return grouped.agg(
        F.grouping_id(*columns).alias("level"),
        F.avg(F.abs("_e")).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg("_e").alias("bias"),
        pearson(actual, predicted).alias("r"),
        F.count(F.lit(1)).alias("n"),
    )


def rank_models(metrics: DataFrame, model: str, within: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*within, F.lit(0)).orderBy("mae", "rmse", model)  # one row per model
    return metrics.withColumn("rank", F.row_number().over(w))


def top_k_overlap(df: DataFrame, groups: Sequence[str], a: str, b: str, entity: str, ks: Sequence[int]) -> DataFrame:
    ranked = numbered(numbered(df.select(*groups, entity, a, b), groups, a, entity, "_a"), groups, b, entity, "_b")
    return ranked.groupBy(*groups).agg(*[F.count_if((F.col("_a") <= k) & (F.col("_b") <= k)).alias(f"top{k}") for k in ks])


def rollup_by_membership(df: DataFrame, members: DataFrame, entity: str, period: str, group: str, cases: str, denom: str, constants: Sequence[str] = ()) -> DataFrame:
    """(period, group, constants, cases, denom, rate, n): rows summed by the group that each entity is a member of.

    members: (entity, group), each entity once; an entity without a group, or constants that differ within a group, are
    errors of the job. The rate is null where the denominators sum to nothing positive.
    """
    joined = attach_strict(df, members.select(entity, group), [entity])
    by_period = joined.groupBy(period, group)
    same = [(F.min(c).alias(c), (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) <= 1).alias(f"_one_{c}")) for c in constants]
    sums = by_period.agg(F.sum(cases).alias(cases), F.sum(denom).alias(denom), F.count(F.lit(1)).alias("n"), *[c for pair in same for c in pair])
    for c in constants:
        differ = F.raise_error(F.concat(F.lit(f"{c} differs within "), F.to_json(F.struct(period, group)))).cast("boolean")
        sums = sums.filter(F.when(F.col(f"_one_{c}"), F.lit(True)).otherwise(differ))
    rate = F.when(F.col(denom) > 0, F.col(cases) / F.col(denom))
    return sums.select(period, group, *constants, cases, denom, rate.alias("rate"), "n")


def rollup_levels(df: DataFrame, run: str, group: str, cases: str, denom: str, flags: str | None = None) -> DataFrame:
    """Sums by group and over all groups, the rate of the sums, and extremes of the cases."""
    grouped = df.groupingSets([[F.col(run)], [F.col(run), F.col(group)]], F.col(run), F.col(group))
    out = grouped.agg(F.grouping(group).alias("_all"), F.sum(cases).alias("cases"), F.sum(denom).alias("denom"), F.min(cases).alias("least"), F.max(cases).alias("most"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("_all") == 1, "all").otherwise("group")
    return out.withColumns({"level": level, "rate": F.when(F.col("denom") > 0, F.col("cases") / F.col("denom"))}).drop("_all")


def concentration(df: DataFrame, groups: Sequence[str], entity: str, actual: str, predicted: str) -> DataFrame:
    """Herfindahl indices of actual and predicted shares, mean absolute share error, Spearman correlation and top hits."""
    whole = Window.partitionBy(*groups)
    share = lambda c: F.when(F.sum(c).over(whole) > 0, F.col(c) / F.sum(c).over(whole)).otherwise(0.0)

    def average_rank(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, c))
        return F.rank().over(whole.orderBy(c)) + (ties - 1) / 2

    rows = df.withColumns({"_sa": share(actual), "_sp": share(predicted), "_ra": average_rank(actual), "_rp": average_rank(predicted)})
    found = rows.groupBy(*groups).agg(
        F.sum(F.col("_sa") ** 2).alias("hhi_actual"),
        F.sum(F.col("_sp") ** 2).alias("hhi_predicted"),
        F.avg(F.abs(F.col("_sa") - F.col("_sp"))).alias("share_error"),
        pearson("_ra", "_rp").alias("spearman"),
        F.count(F.lit(1)).alias("n"),
    )
    return found.join(top_k_overlap(df, groups, actual, predicted, entity, [3, 5]), list(groups))


def weighted_rate(df: DataFrame, keys: Sequence[str], cases: str, population: str, rate: str) -> DataFrame:
    """Cases over population where every population is known, else the mean of rates."""
    known = F.count(population) == F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.when(known & (F.sum(population) > 0), F.sum(cases) / F.sum(population)).otherwise(F.avg(rate)).alias("rate"), F.count(F.lit(1)).alias("n"))


def per_period_then_stats(df: DataFrame, group: str, period: str, cases: str, population: str) -> DataFrame:
    yearly = df.groupBy(group, period).agg((F.sum(cases) / F.sum(population)).alias("r"))
    return yearly.groupBy(group).agg(F.min("r").alias("least"), F.avg("r").alias("mean"), F.max("r").alias("most"), F.stddev_pop("r").alias("sd"), F.count("r").alias("periods"))


def distinct_coverage(df: DataFrame, entity: str, period: str, least: int) -> DataFrame:
    found = df.groupBy(period).agg(F.countDistinct(entity).alias("entities"))
    return found.withColumn("flags", F.when(F.col("entities") < least, "partial_coverage").otherwise(""))


def fit_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.agg(F.sum(actual).alias("actual"), F.sum(predicted).alias("predicted"), F.sum(e).alias("residual"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count_if(e < 0).alias("under"), F.count_if(e > 0).alias("over"), F.count_if(e == 0).alias("exact"))


def persistence(df: DataFrame, entity: str, period: str, in_set: Column) -> DataFrame:
    """Per period the size of a set, how many stayed from the period before, are new, or left; null where that period has no rows."""
    members = df.filter(in_set).select(entity, period).distinct()
    periods = df.select(period).distinct()
    had = periods.select((F.col(period) + 1).alias(period), F.lit(True).alias("had_prior"))
    before = members.select(entity, (F.col(period) + 1).alias(period), F.lit(1).alias("was"))
    both = members.withColumn("is", F.lit(1)).join(before, [entity, period], "full")
    counts = both.groupBy(period).agg(F.count("is").alias("size"), F.count(F.when(F.col("was") == 1, F.col("is"))).alias("stayed"), F.count_if(F.col("was").isNull()).alias("new"), F.count_if(F.col("is").isNull()).alias("left"))
    joined = periods.join(had, period, "left").join(counts, period, "left")
    keep = lambda c: F.when(F.col("had_prior"), F.coalesce(F.col(c), F.lit(0))).alias(c)
    return joined.select(period, F.coalesce("size", F.lit(0)).alias("size"), keep("stayed"), keep("new"), keep("left"))


def project_trend(df: DataFrame, entity: str, period: str, value: str, last: int, fit: int, through: int) -> DataFrame:
    """A least-squares line over each entity's last fit periods up to last, carried on to through; only entities observed in last."""
    recent = df.filter(F.col(period).between(last - fit + 1, last)).groupBy(entity)
    back = F.col(period) - last  # counted from the last period: no large intercept to cancel
    lines = recent.agg(F.regr_slope(F.col(value), back).alias("slope"), F.regr_intercept(F.col(value), back).alias("intercept"), F.max(period).alias("latest"), F.count(F.lit(1)).alias("n"))
    lines = lines.filter((F.col("latest") == last) & (F.col("n") >= 2))
    future = lines.select(entity, "slope", "intercept", F.explode(F.sequence(F.lit(last + 1), F.lit(through))).alias(period))
    return future.select(entity, period, F.greatest(F.lit(1), F.bround(F.round(F.col("intercept") + F.col("slope") * (F.col(period) - last), 6), 0).cast("bigint")).alias(value))


def interval_rollup(df: DataFrame, groups: Sequence[str], rate_bounds: Mapping[str, str], population: str, actual: str) -> DataFrame:
    """Bounds of rates turned to cases and summed, and whether the actual total lies between lower and upper."""
    sums = df.groupBy(*groups).agg(*[F.sum(F.col(c) * F.col(population)).alias(name) for name, c in rate_bounds.items()], F.sum(actual).alias("actual"))
    return sums.withColumn("covered", F.col("actual").between(F.col("lower"), F.col("upper")))
