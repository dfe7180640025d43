"""Event-time operators on streams: accumulators with eviction, merging of passes, pairs of days."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberframe.functions.scalars import priority_key


def daily_counts(events: DataFrame, time: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Counts per key and day of a stream, final when the watermark passes; later rows are dropped."""
    w = events.withWatermark(time, delay).groupBy(F.window(time, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.to_date("window.start").alias("day"), *keys, "n")


def merged_passes(passes: DataFrame, time: str, keys: list[str], value: str, delay: str = "1 day") -> DataFrame:
    """Observations of a day merged by priority, emitted when the day is complete. The merge is an algebraic maximum."""
    k = passes.withColumn("__k", priority_key(value)).withWatermark(time, delay)
    best = k.groupBy(F.window(time, "1 day"), *keys).agg(F.max("__k").alias("k"))
    return best.select(F.to_date("window.start").alias("day"), *keys, (F.col("k") % 256).cast("int").alias(value))


def next_day_pairs(a: DataFrame, b: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """Rows (key, day TIMESTAMP) of one stream with the row of the other on the next day; state is kept for a day and the delay."""
    x = a.withWatermark("day", delay).select(F.col(key).alias("__a"), F.col("day").alias("day_t"))
    y = b.withWatermark("day", delay).select(F.col(key).alias("__b"), F.col("day").alias("day_t1"))
    near = F.expr("__a = __b and day_t1 >= day_t + interval 1 day and day_t1 < day_t + interval 2 days")
    return x.join(y, near).select(F.col("__a").alias(key), "day_t", "day_t1")


def fire_histories(events: DataFrame, quiet_days: int = 7, delay: str = "1 day") -> DataFrame:
    """(fire_id, first_day, last_day, n): one row per burning period of a fire, emitted when it was quiet long enough.

    events has fire_id BIGINT and ts TIMESTAMP. State per fire is three numbers, whatever it saw; an event-time timer evicts
    it quiet_days after the last sighting. Rows behind the watermark are dropped, as a fire evicted is closed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({"fire_id": [key[0]], "first_day": [pd.Timestamp(first, unit="ms")], "last_day": [pd.Timestamp(last, unit="ms")], "n": [n]})
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        for pdf in batches:
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
            first = int(ms.min()) if first is None else min(first, int(ms.min()))
            last = int(ms.max()) if last is None else max(last, int(ms.max()))
            n += len(pdf)
        if first is not None:
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(last + quiet_days * 86_400_000, state.getCurrentWatermarkMs() + 1))

    return (
        events.filter("fire_id is not null and ts is not null").withWatermark("ts", delay).groupBy("fire_id")
        .applyInPandasWithState(step, "fire_id long, first_day timestamp, last_day timestamp, n long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    )
