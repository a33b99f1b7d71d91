"""Writers: fixed column order, nested JSON. Versioned upserts are in `keyed`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, columns: Sequence[str], keys: Sequence[str], fmt: str = "parquet", in_order: bool = False) -> None:
    """Columns in a fixed order; rows sorted within files of a key range, or by key hash if no order over all is asked for."""
    out = df.select(*columns)
    out = out.repartitionByRange(*[F.col(k) for k in keys]) if in_order else out.repartition(*[F.col(k) for k in keys])
    writer = out.sortWithinPartitions(*keys).write
    (writer.option("header", True).option("nullValue", "").option("emptyValue", "") if fmt == "csv" else writer).format(fmt).save(path)


def attach_nested(df: DataFrame, records: DataFrame, key: str, fields: Sequence[str], name: str) -> DataFrame:
    """df with a sorted array of records' fields for each key; an empty array where there are none."""
    nested = records.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return df.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def export_records(df: DataFrame, entity: str, period: str, score: str, interval: tuple[str, str], flags: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, metadata, manifest): intervals as pairs, flags as arrays; per entity its periods and highest score; counts."""
    records = df.select(entity, period, score, F.array(*interval).alias("interval"), F.filter(F.split(F.col(flags), ","), lambda x: x != "").alias("flags"))
    metadata = df.groupBy(entity).agg(F.sort_array(F.collect_set(period)).alias("periods"), F.max(score).alias("max_score"))
    manifest = records.agg(F.count(F.lit(1)).alias("records"), F.countDistinct(entity).alias("entities"))
    return records, metadata, manifest


def write_export(df: DataFrame, root: str, entity: str, period: str, score: str, interval: tuple[str, str], flags: str) -> None:
    for name, part in zip(("records", "metadata", "manifest"), export_records(df, entity, period, score, interval, flags)):
        part.write.json(f"{root}/{name}")
