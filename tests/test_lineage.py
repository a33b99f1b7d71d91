"""Trees of digests: equal versions, and changes found in the files of their buckets alone."""

import os

import pytest
from pyspark.sql import functions as F

from panelwright.operators import lineage as L
from panelwright.operators.quality import ContractError


def rows(spark, n=2000):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), (F.col("id") % 7).cast("string").alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") / 3).alias("v"))


def test_roots_depend_on_rows_alone(spark, tmp_path):
    df = rows(spark)
    at = lambda n: f"file://{tmp_path}/{n}"
    L.write_version(df.repartition(1), at(1), ["k"], 40)
    L.write_version(df.orderBy(F.desc("v")).repartition(7), at(2), ["k"], 40)
    L.write_version(df.select("v", "k", "g"), at(3), ["k"], 40)
    L.write_version(df.union(df.limit(1)), at(4), ["k"], 40)
    L.write_version(df.withColumn("v", F.when(F.col("k") == 5, None).otherwise(F.col("v"))), at(5), ["k"], 40)
    roots = [L.root(spark, at(i)) for i in range(1, 6)]
    assert roots[0] == roots[1] == roots[2] and len(set(roots)) == 3
    assert L.differing_buckets(spark, at(1), at(2)) == [] and L.changed_rows(spark, at(1), at(2), ["k"]).count() == 0
    assert [tuple(r) for r in L.changed_rows(spark, at(1), at(5), ["k"]).collect()] == [(5, "changed")]
    assert L.changed_rows(spark, at(1), at(4), ["k"]).count() == 1


def test_only_differing_buckets_are_read(spark, tmp_path):
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    df = rows(spark)
    L.write_version(df, old, ["k"], 300)
    other = df.filter("k <> 17").withColumn("v", F.when(F.col("k") == 400, -1.0).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(5000, "x", None)], df.schema))
    L.write_version(other, new, ["k"], 300)
    at = L.differing_buckets(spark, old, new)
    assert 1 <= len(at) <= 3
    # Files of all other buckets are spoilt: nothing may read them.
    for version in ("old", "new"):
        for folder, _, files in os.walk(tmp_path / version / "rows"):
            for name in files:
                if name.endswith(".parquet") and not any(f"_bucket={b}" == os.path.basename(folder) for b in at):
                    with open(os.path.join(folder, name), "wb") as f:
                        f.write(b"spoilt")
                    crc = os.path.join(folder, f".{name}.crc")
                    if os.path.exists(crc):
                        os.remove(crc)
    found = sorted(tuple(r) for r in L.changed_rows(spark, old, new, ["k"]).collect())
    assert found == [(17, "removed"), (400, "changed"), (5000, "added")]


def test_versions_of_other_buckets_and_none(spark, tmp_path):
    a, b, c = (f"file://{tmp_path}/{n}" for n in "abc")
    L.write_version(rows(spark, 10), a, ["k"], 4)
    L.write_version(rows(spark, 10), b, ["k"], 5)
    with pytest.raises(ContractError, match="buckets"):
        L.differing_buckets(spark, a, b)
    L.write_version(rows(spark, 10).limit(0).unionByName(rows(spark, 1)), c, ["k"], 4)
    assert {r.change for r in L.changed_rows(spark, a, c, ["k"]).collect()} == {"removed"} and L.changed_rows(spark, a, c, ["k"]).count() == 9
