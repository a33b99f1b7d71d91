"""Design matrices: lags, priors, imputation with indicators, one-hot and flag columns, standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.expressions import flags_split
from panelwright.operators import windows as W

MOST_CATEGORIES = 200


@dataclass(frozen=True)
class Schema:
    """What a design matrix's columns are for."""

    ids: tuple[str, ...]
    target: str
    features: tuple[str, ...]
    categories: dict


def categories(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list[str]:
    """Sorted distinct values, at most `most`: more are an error and need an indexer."""
    found = [r[0] for r in df.select(F.col(column).cast("string")).filter(f"{column} IS NOT NULL AND {column} <> ''").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return sorted(found)


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.withColumns({f"feature_{column}_{v}": (F.col(column).cast("string").eqNullSafe(F.lit(v))).cast("double") for v in values})


def observed_flags(df: DataFrame, flags: str, most: int = MOST_CATEGORIES) -> list[str]:
    return categories(df.select(F.explode(flags_split(F.col(flags))).alias("flag")), "flag", most)


def flag_indicators(df: DataFrame, flags: str, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"feature_flag_{n}": F.array_contains(flags_split(F.col(flags)), n).cast("double") for n in names})


def composite_index(components: Sequence[Column]) -> tuple[Column, Column]:
    """(mean of the known components times 100, how many are known)."""
    known = F.filter(F.array(*components), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known) * 100), F.size(known)


def imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature_<c>: the value or 0; feature_missing_<c>: whether it was missing."""
    return df.withColumns({f"feature_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns} | {f"feature_missing_{c}": F.col(c).isNull().cast("double") for c in columns})


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column in one pass; deviations too small to divide by, or of one row, are 1."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    sd = lambda c: row[f"s_{c}"] if row["n"] >= 2 and row[f"s_{c}"] is not None and row[f"s_{c}"] >= 1e-12 else 1.0
    return {c: (row[f"m_{c}"] or 0.0, sd(c)) for c in columns}


def standardized(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"z_{c}": (F.col(c) - m) / s for c, (m, s) in stats.items()})


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that aren't constant, by one aggregation."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def design_matrix(df: DataFrame, entity: str, group: str, period: str, value: str, cases: str, denom: str, numeric: Sequence[str], categorical: Sequence[str], rows: int = 3, neighbors: DataFrame | None = None) -> tuple[DataFrame, Schema]:
    """Rows with any history as model input, and what the columns are for.

    Lags, trailing mean and group prior see earlier periods only. neighbors: (entity, period, neighbor_mean) of the period before.
    """
    out = W.trailing_mean_rows(W.prior_period(df, [entity], period, [value]), [entity], period, value, rows).filter("trailing_rows > 0")
    priors = W.group_rate(df, group, period, cases, denom).select(group, period, "prior_group_rate")
    out = out.join(priors, [group, period], "left")
    extra = ["neighbor_mean"] if neighbors is not None else []
    if neighbors is not None:
        out = out.join(neighbors.select(entity, period, "neighbor_mean"), [entity, period], "left")
    out = imputed(out, [f"prior_{value}", "trailing_mean", "prior_group_rate", *extra, *numeric])
    maps = {c: categories(df, c) for c in categorical}
    for column, values in maps.items():
        out = one_hot(out, column, values)
    features = tuple(c for c in out.columns if c.startswith("feature_"))
    schema = Schema((entity, period), value, features, maps)
    return out.select(entity, period, F.col(value).alias(f"target_{value}"), *features), schema


def project_rows(df: DataFrame, entity: str, group: str, period: str, value: str, target: int, rows: int, denominators: DataFrame) -> DataFrame:
    """Feature rows of a future period: last value, recomputed trailing mean and the target period's denominator."""
    last = W.keep_latest(df.select(entity, group, period, value), [entity], period).filter(F.col(period) == target - 1)
    blank = last.select(entity, group, F.lit(target).cast(df.schema[period].dataType).alias(period), F.lit(None).cast(df.schema[value].dataType).alias(value))
    whole = df.select(entity, group, period, value).unionByName(blank)
    traced = W.trailing_mean_rows(W.prior_period(whole, [entity], period, [value]), [entity], period, value, rows).filter(F.col(period) == target)
    return traced.drop(value).join(denominators, entity, "left")
