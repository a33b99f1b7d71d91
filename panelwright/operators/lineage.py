"""Versions of a table that can be compared without reading them: a tree of digests over bucketed rows.

Rows are dealt to buckets by a hash of their key. A bucket's digest is that of its rows in any order, a node's that of the nodes
below it, up to one root. Two versions with equal roots hold the same rows; where roots differ, a comparison descends into nodes
that differ and reads the rows of the differing buckets alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.quality import ContractError, row_digest

#: Children of a node.
FANOUT = 16


def tree_levels(buckets: int) -> int:
    """Levels above the buckets."""
    levels = 0
    while buckets > 1:
        buckets, levels = -(-buckets // FANOUT), levels + 1
    return levels


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def digest_tree(df: DataFrame, bucket: str, buckets: int) -> DataFrame:
    """(level, node, row_count, digest) of df's rows: buckets at level 0, the root at the last level.

    A bucket's digest is the SHA-256 of the sums of its rows' SHA-256, by 15 hexadecimal digits, so it depends neither on order nor on
    partitions, and repeated rows count. A bucket without rows has no node.
    """
    rows = df.drop(bucket)
    digest = row_digest(rows.columns)
    parts = [F.conv(F.substring("_digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.withColumn("_digest", digest).groupBy(F.col(bucket).alias("node")).agg(F.count(F.lit(1)).alias("row_count"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    level = sums.select(F.lit(0).alias("level"), "node", "row_count", F.sha2(F.concat_ws(",", "row_count", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))
    tree = [level]
    for height in range(1, tree_levels(buckets) + 1):
        below = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat_ws(":", x.node.cast("string"), x.digest)), ",")  # FANOUT at most
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(F.sum("row_count").alias("row_count"), F.sha2(below, 256).alias("digest"))
        level = level.select(F.lit(height).alias("level"), "node", "row_count", "digest")
        tree.append(level)
    return reduce(DataFrame.unionByName, tree)


def write_version(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 256) -> None:
    """df under path, a folder a bucket, and its tree beside it; the rows are read back for the tree, so it tells what was written."""
    spark = df.sparkSession
    df.withColumn("_bucket", bucket_of(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/rows")
    tree = digest_tree(kept.select(*sorted(kept.columns)), "_bucket", buckets)
    tree.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/tree")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("_bucket")


def root(spark: SparkSession, path: str) -> str | None:
    """The digest of all rows of a version; None if it has none."""
    top = spark.read.parquet(f"{path}/tree").orderBy(F.desc("level")).first()
    return top.digest if top else None


def differing_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """Buckets whose rows differ between two versions, found from the root down; nodes below equal ones aren't looked at."""
    one, two = (spark.read.parquet(f"{p}/tree") for p in (old, new))
    sizes = {r.buckets for p in (one, two) for r in p.select("buckets").distinct().collect()}
    if len(sizes) > 1:
        raise ContractError(f"versions of {sorted(sizes)} buckets can't be compared")
    if not sizes:
        return []
    nodes = [0]
    for level in range(tree_levels(sizes.pop()), -1, -1):
        at = lambda tree, name: tree.filter((F.col("level") == level) & F.col("node").isin(nodes)).select("node", F.col("digest").alias(name))  # noqa: B023, E731
        both = at(one, "was").join(at(two, "now"), "node", "full").filter(~F.col("was").eqNullSafe(F.col("now")))
        found = sorted(r.node for r in both.select("node").collect())  # the buckets' number at most
        if level == 0 or not found:
            return found
        nodes = [FANOUT * node + i for node in found for i in range(FANOUT)]
    return []


def changed_rows(spark: SparkSession, old: str, new: str, keys: Sequence[str]) -> DataFrame:
    """(keys, change): keys that were added, removed or changed from one version to another, by the differing buckets' files alone.

    Keys tell rows apart; rows that repeat one are compared as a whole.
    """
    at, sides = differing_buckets(spark, old, new), []
    for path in (old, new):
        kept = spark.read.parquet(f"{path}/tree").filter((F.col("level") == 0) & F.col("node").isin(at)) if at else None
        folders = [f"{path}/rows/_bucket={r.node}" for r in kept.select("node").collect()] if at else []
        sides.append(spark.read.option("basePath", f"{path}/rows").parquet(*folders).drop("_bucket") if folders else None)
    one, two = sides
    if one is None and two is None:
        return read_version(spark, new).select(*keys, F.lit("").alias("change")).limit(0)
    sides = [rows if rows is not None else other.limit(0) for rows, other in ((one, two), (two, one))]
    sides = [rows.groupBy(*keys).agg(F.array_sort(F.collect_list(row_digest(sorted(rows.columns)))).alias("_digests")) for rows in sides]
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = sides[0].alias("a").join(sides[1].alias("b"), same, "full")
    change = F.when(F.col("a._digests").isNull(), "added").when(F.col("b._digests").isNull(), "removed").when(F.col("a._digests") != F.col("b._digests"), "changed")
    return both.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], change.alias("change")).filter("change IS NOT NULL")
