"""Streaming audits: orders of arrival, revisions, expiry, restarts."""

import datetime

from pyspark.sql import functions as F

from panelwright.sources import keyed
from panelwright.streaming import streams

DAY = datetime.datetime(2024, 5, 1)
FORECASTS = "k int, predicted double, lower_95 double, upper_95 double, issued timestamp"
OBSERVED = "k int, actual double, seen timestamp"


def day(n):
    return DAY + datetime.timedelta(days=n)


class Audit:
    """One audit that is started again for every delivery, from its checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, f"file://{folder}"
        for name, schema in (("forecasts", FORECASTS), ("observed", OBSERVED)):
            spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}")

    def deliver(self, forecasts=(), observed=()):
        for name, schema, rows in (("forecasts", FORECASTS, forecasts), ("observed", OBSERVED, observed)):
            if rows:
                self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        f, o = (self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}") for name, schema in (("forecasts", FORECASTS), ("observed", OBSERVED)))
        audit = streams.stream_update_audit(o, f, ["k"], "issued", "seen", "10 days", F.col("seen"), F.lit(day(60)), 1.0, "1 day")
        kept = audit.select("k", "issued", "actual", "seen", "interpretation")
        kept.writeStream.outputMode("append").format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(((r.k, r.actual, r.interpretation) for r in self.spark.read.schema(kept.schema).parquet(f"{self.folder}/out").collect()), key=repr)


def forecast(k, n):
    return (k, 10.0, 8.0, 12.0, day(n))


def test_audit_takes_either_order_revisions_and_expiry(spark, tmp_path):
    audit = Audit(spark, tmp_path)
    assert audit.deliver(observed=[(1, 11.0, day(2)), (5, 1.0, day(2))]) == []  # before their forecasts
    first = [(1, 11.0, "expected")]
    assert audit.deliver(forecasts=[forecast(1, 0), forecast(2, 0), forecast(3, 1)]) == first
    more = sorted([*first, (1, 20.0, "higher_than_expected"), (3, 7.0, "lower_than_expected")], key=repr)
    assert audit.deliver(observed=[(1, 20.0, day(4)), (3, 7.0, day(5)), (3, 7.5, day(12))]) == more  # a revision; one out of time
    # Nothing is over while either stream stands still.
    assert audit.deliver(forecasts=[forecast(9, 40)]) == more
    over = sorted([*more, (2, None, "pending")], key=repr)
    assert audit.deliver(forecasts=[forecast(9, 41)], observed=[(8, 1.0, day(39))]) == over
    assert audit.deliver() == over


def test_last_readings_are_kept_in_a_keyed_table(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    rows = spark.createDataFrame([(1, day(0), 1.0, day(3), "expected"), (1, day(0), 2.0, day(2), "expected"), (2, day(0), None, None, "pending")], "k int, issued timestamp, actual double, seen timestamp, interpretation string")
    keyed.write_upsert(rows.limit(1), root, ["k", "issued"], order="seen")
    keyed.write_upsert(rows, root, ["k", "issued"], order="seen")
    assert sorted((r.k, r.actual) for r in keyed.read_upserts(spark, root).collect()) == [(1, 1.0), (2, None)]
