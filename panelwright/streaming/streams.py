"""Streaming forms: keyed upserts, calendar roll-ups and update audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelwright.operators.forecast import classified
from panelwright.sources.keyed import write_upsert


def stream_upsert(stream: DataFrame, root: str, keys: Sequence[str], order: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch laid over the table at root: of equal keys the row of the largest order, in whichever batch it came.

    A batch that runs again gives the same table. Each batch writes its own rows, and compacts levels of earlier ones that are full.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write_upsert(batch, root, keys, order=order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_calendar_rollup(stream: DataFrame, entity: str, ts: str, value: str, late: str = "2 days") -> DataFrame:
    """ISO-week counts, sums and days with rows of an event stream; rows later than `late` behind are dropped.

    Days are grouped first, so a week's distinct days are its number of day groups. Weeks come out once they are closed.
    """
    days = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day"), entity).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    week = F.window(F.window_time("day"), "7 days", startTime="4 days")
    weeks = days.groupBy(week.alias("week"), entity).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("days"))
    return weeks.select(entity, F.to_date("week.start").alias("week_start"), "n", "total", "days")


def batch_calendar_rollup(rows: DataFrame, entity: str, ts: str, value: str) -> DataFrame:
    """What stream_calendar_rollup gives once every week is closed."""
    start = F.to_date(F.date_trunc("week", ts))
    return rows.groupBy(entity, start.alias("week_start")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.countDistinct(F.to_date(ts)).alias("days"))


def stream_update_audit(observed: DataFrame, forecasts: DataFrame, keys: Sequence[str], issued: str, seen: str, wait: str, as_of: Column, cutoff: Column, near: float, late: str = "2 days") -> DataFrame:
    """A row for each forecast and observation of its keys from `issued` until `wait` later, classified, as both arrive.

    forecasts: (keys, predicted, lower_95, upper_95, issued); observed: (keys, actual, seen); both are streams. Either may come
    first: rows of both wait in the state until the watermark, `late` behind the slower stream, has passed all that they could
    meet. An observation that is revised gives a row each time. A forecast that had none is given out as pending once its time is
    over; after a restart both streams have to bring rows before Spark knows how far each is. To keep the last reading of each
    forecast, lay the rows over a keyed table in the order of `seen`.
    """
    f = forecasts.withWatermark(issued, late).alias("f")
    o = observed.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in observed.columns if c not in keys]).withWatermark(seen, late).alias("o")
    same = reduce(lambda a, b: a & b, [F.col(f"f.{k}") == F.col(f"o._{k}") for k in keys])
    in_time = (F.col(f"o.{seen}") >= F.col(f"f.{issued}")) & (F.col(f"o.{seen}") < F.col(f"f.{issued}") + F.expr(f"interval {wait}"))
    both = f.join(o, same & in_time, "left_outer").drop(*[f"_{k}" for k in keys])
    return classified(both, as_of, cutoff, near)
