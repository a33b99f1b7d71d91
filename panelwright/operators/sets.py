"""Unions, overrides and comparisons of row sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_sources(tables: Mapping[str, DataFrame], apart: Sequence[str] = (), name: str = "source") -> tuple[DataFrame, DataFrame | None]:
    """All tables under one schema with their name; tables in `apart` are returned on their own, for validation."""
    named = {k: v.withColumn(name, F.lit(k)) for k, v in tables.items()}
    join = lambda keys: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [named[k] for k in keys]) if keys else None
    return join([k for k in named if k not in apart]), join([k for k in named if k in apart])


def union_override(vintages: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tables laid over each other: of equal keys the row of the latest table stays, with its number as `vintage`."""
    rows = reduce(DataFrame.unionByName, [v.withColumn("vintage", F.lit(i)) for i, v in enumerate(vintages)])
    order = Window.partitionBy(*keys).orderBy(F.desc("vintage"))
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Existing and new rows; the last write wins for each key.

    With a column `order` that is the row where it is largest, wherever it stands (a late older row loses), of equal ones
    the new table's, then the one whose columns compare greatest. Without it a row of new wins, and rows of new that
    repeat a key must be equal: there is no last one among them.
    """
    if order is None:
        return union_override([existing, single(new, keys)], keys).drop("vintage")
    rows = existing.withColumn("vintage", F.lit(0)).unionByName(new.withColumn("vintage", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_order"), "vintage", *rest)).alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in existing.columns])


def single(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df without repeated rows; different rows of one key are an error of the job."""
    rows = df.distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    several = F.raise_error(F.concat(F.lit("different rows of key "), F.to_json(F.struct(*keys)))).cast("boolean")
    return rows.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(several)).drop("_n")


def replace_groups(existing: DataFrame, new: DataFrame, group: str, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """upsert after dropping the existing rows of every group that occurs in new."""
    return upsert(existing.join(new.select(group).distinct(), group, "left_anti").select(*existing.columns), new, keys, order)


def set_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sizes of both, only a and only b, by groups."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), list(keys), "full")
    return both.groupBy(*by).agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def expected_members(observed: DataFrame, expected: DataFrame, group: str, n: str) -> DataFrame:
    """(group, expected, observed, status): missing, unexpected, mismatched or ok groups."""
    have = observed.groupBy(group).agg(F.count(F.lit(1)).alias("observed"))
    both = expected.select(group, F.col(n).alias("expected")).join(have, group, "full")
    status: Column = F.when(F.col("observed").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") != F.col("observed"), "mismatched").otherwise("ok")
    return both.withColumn("status", status)
