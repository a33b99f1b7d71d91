"""Readers of delimited text, token text, JSON, GeoJSON and wide tables. All text is read as strings; nothing is inferred.

Rows that can't be parsed go to a rejects DataFrame instead of ending the job.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.expressions import flags_split, flags_union


class MissingColumns(ValueError):
    """A file lacks columns that its reader needs."""


def require_columns(df: DataFrame, required: Sequence[str], one_of: Sequence[Sequence[str]] = ()) -> DataFrame:
    missing = [c for c in required if c not in df.columns] + ["|".join(group) for group in one_of if not set(group) & set(df.columns)]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}; found {', '.join(df.columns)}")
    return df


def read_delimited(spark: SparkSession, path: str, required: Sequence[str] = (), sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Text with a header as strings; names are trimmed and a byte order mark is dropped, other columns are kept."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("inferSchema", False).option("quote", '"').option("escape", '"').csv(path)
    return require_columns(df.toDF(*[c.lstrip("﻿").strip() for c in df.columns]), required)


def read_headerless(spark: SparkSession, path: str, least_fields: int, positions: Mapping[str, int], sums: Mapping[str, Sequence[int]], sep: str = ",") -> DataFrame:
    """Positional text without a usable header: lines whose first field is all digits and that have enough fields."""
    fields = F.split(F.col("value"), re.escape(sep), -1)
    rows = spark.read.text(path).select(F.transform(fields, lambda x: F.trim(x)).alias("f")).filter((F.size("f") >= least_fields) & F.get("f", 0).rlike("^[0-9]+$"))
    number = lambda i: F.coalesce(F.get("f", i).try_cast("bigint"), F.lit(0))
    added = {name: sum((number(i) for i in places[1:]), number(places[0])) for name, places in sums.items()}
    return rows.select(*[F.get("f", i).alias(name) for name, i in positions.items()], *[c.alias(name) for name, c in added.items()])


def read_tokens(spark: SparkSession, path: str, names: Sequence[str], header: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of white-space separated text; lines that begin with header are skipped, others must have len(names) tokens."""
    lines = spark.read.text(path).filter(F.trim("value") != "").filter(~F.trim("value").startswith(header))
    cut = lines.withColumn("t", F.split(F.trim("value"), r"\s+"))
    good = F.size("t") == len(names)
    return cut.filter(good).select(*[F.get("t", i).alias(n) for i, n in enumerate(names)]), cut.filter(~good).select("value")


def read_sentinel_series(spark: SparkSession, path: str, missing_upto: float = -999.0) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of date,value text: values at or below the sentinel are null, dates must be the first of a month."""
    raw = read_delimited(spark, path, ["date", "value"])
    value = F.col("value").try_cast("double")
    rows = raw.select(F.try_to_date("date", "yyyy-MM-dd").alias("date"), F.when(value > missing_upto, value).alias("value"), F.col("date").alias("raw_date"))
    good = F.coalesce(F.dayofmonth("date") == 1, F.lit(False))
    return rows.filter(good).drop("raw_date"), rows.filter(~good).select("raw_date")


def unpivot_periods(df: DataFrame, ids: Sequence[str], pattern: str, value: str = "value") -> DataFrame:
    """Wide to long: columns that match pattern (its first group is the period) become (period, value) rows."""
    wide = {c: int(m[1]) for c in df.columns if (m := re.fullmatch(pattern, c, re.IGNORECASE))}
    if not wide:
        raise MissingColumns(f"no column matches {pattern}")
    long = df.unpivot(list(ids), list(wide), "_column", value)
    period = F.coalesce(*[F.when(F.col("_column") == c, F.lit(p)) for c, p in wide.items()])
    return long.select(*ids, period.alias("period"), value)


def flatten_records(df: DataFrame, json: str, schema: str, path: Column | None = None) -> DataFrame:
    """Rows of a JSON array of objects held in column json; other columns are kept. A document that isn't JSON gives no rows."""
    kept = [c for c in df.columns if c != json]
    parsed = F.from_json(F.col(json), schema)
    return df.select(*kept, F.inline(parsed if path is None else path))


def zip_parallel(df: DataFrame, arrays: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of parallel arrays: one row per index; rows whose arrays differ in length are rejected."""
    kept = [c for c in df.columns if c not in arrays]
    same = F.lit(True)
    for c in arrays[1:]:
        same = same & (F.size(arrays[0]) == F.size(c))
    good = F.coalesce(same, F.lit(False))
    return df.filter(good).select(*kept, F.inline(F.arrays_zip(*arrays))), df.filter(~good).select(*kept)


def pivot_observations(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str], order: str) -> DataFrame:
    """Entity-attribute-value rows to one row per key; of several values the last in order stays."""
    return df.groupBy(*keys).agg(*[F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order))).alias(n) for n in names])


def array_table(df: DataFrame, key: str, json: str, names: Sequence[str]) -> DataFrame:
    """JSON arrays of arrays whose first row is the header, as one row per record with the named fields."""
    table = df.select(key, F.from_json(json, "array<array<string>>").alias("t"))
    records = table.select(key, F.get("t", 0).alias("h"), F.posexplode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("record", "r"))
    return records.select(key, "record", *[F.try_element_at("r", F.nullif(F.array_position("h", n), F.lit(0)).cast("int")).alias(n) for n in names])


GEOMETRY = "struct<type:string,coordinates:string>"


def geojson_features(df: DataFrame, json: str, ids: Sequence[str], names: Sequence[str], groups: Sequence[str], allowed: Sequence[str], width: int) -> DataFrame:
    """(id, name, grp, geometry type, coordinates) of feature collections; the first known property alias is taken, other groups are left out."""
    schema = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    feature = df.select(F.explode(F.from_json(json, schema).features).alias("f"))
    first = lambda aliases: F.coalesce(*[F.try_element_at(F.col("f.properties"), F.lit(a)) for a in aliases])
    rows = feature.select(F.lpad(F.trim(first(ids)), width, "0").alias("id"), first(names).alias("name"), first(groups).alias("grp"), F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates"))
    return rows.filter(F.col("grp").isin(*allowed))


def text_table_lines(df: DataFrame, key: str, text: str, labels: Mapping[str, str], n_values: int, first_period: int) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): lines that begin with a label and then n_values numbers, one row per number and period.

    Lines with a label and another count of numbers are rejected.
    """
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "value"))
    label = F.coalesce(*[F.when(F.trim("value").startswith(k), F.lit(v)) for k, v in labels.items()])
    found = lines.withColumn("label", label).filter("label IS NOT NULL").withColumn("numbers", F.regexp_extract_all("value", F.lit(r"(\d[\d,]*)"), 1))
    good = F.size("numbers") == n_values
    rows = found.filter(good).select(key, "line", "label", F.posexplode("numbers").alias("i", "n"))
    rows = rows.select(key, "line", "label", (F.col("i") + first_period).alias("period"), F.replace("n", F.lit(","), F.lit("")).try_cast("bigint").alias("value"))
    return rows, found.filter(~good).select(key, "line", "value")


def labelled_blocks(df: DataFrame, key: str, text: str, marker: str, numbers: Sequence[str]) -> DataFrame:
    """Documents cut at `marker: value`, with the number that follows each of numbers in every block."""
    blocks = df.select(key, F.posexplode(F.split(F.col(text), rf"(?=\b{marker}: )")).alias("block", "body")).filter(F.col("body").startswith(f"{marker}: "))
    pick = lambda n: F.nullif(F.regexp_extract("body", rf"\b{n}: (-?\d+)", 1), F.lit("")).cast("bigint")
    return blocks.select(key, "block", F.regexp_extract("body", rf"^{marker}: ([^\n,]*)", 1).alias("label"), *[pick(n).alias(n) for n in numbers])


def manual_observations(df: DataFrame, flags: str, mandatory: Sequence[str]) -> DataFrame:
    """Human-entered rows, whose flags always hold the mandatory ones."""
    return df.withColumn(flags, F.concat_ws(",", flags_union(F.array(*map(F.lit, mandatory)), flags_split(F.col(flags)))))
