"""What was seen when: accumulators over days, last days, first places, steps between days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accumulated(cells: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Per row of cells(keys, day): first and latest day seen so far, and how often, the row's own day included.

    One row per key and day, however many detections there were; the window's groups are single cells.
    """
    by = cells.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("seen"))
    w = Window.partitionBy(*keys).orderBy(day)
    return by.select(
        *keys, day, F.min(day).over(w).alias("first_day"), F.max(day).over(w).alias("last_day"), F.sum("seen").over(w).alias("times")
    )


def last_day_once(df: DataFrame, group: str, day: str, order: str) -> DataFrame:
    """df with is_last on one row per group: the latest day, on ties the row that comes last in `order`.

    The maximum is an algebraic aggregate per group; only it is joined back, so a group with a third of all rows
    is no single task. A null group is a group of its own.
    """
    top = df.groupBy(group).agg(F.max(F.struct(day, order)).alias("__top"))
    top = top.select(F.col(group).alias("__g"), F.col(f"__top.{day}").alias("__d"), F.col(f"__top.{order}").alias("__o"))
    hit = df[group].eqNullSafe(F.col("__g")) & df[day].eqNullSafe(F.col("__d")) & df[order].eqNullSafe(F.col("__o"))
    return df.join(top, hit, "left").select(*df.columns, F.col("__o").isNotNull().alias("is_last"))


def last_day_all(df: DataFrame, group: str, day: str) -> DataFrame:
    """df with is_last on every row of the group's latest day."""
    top = df.groupBy(F.col(group).alias("__g")).agg(F.max(day).alias("__d"))
    return df.join(top, df[group].eqNullSafe(F.col("__g")), "left").select(*df.columns, (F.col(day) == F.col("__d")).alias("is_last"))


def first_values(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Of each group the columns of the row that comes first in order."""
    return df.groupBy(group).agg(F.min_by(F.struct(*columns), order).alias("__x")).select(group, *[F.col(f"__x.{c}").alias(c) for c in columns])


def nearest_day(wanted: DataFrame, have: DataFrame, keys: list[str], day: str) -> DataFrame:
    """(keys, day, nearest): for every wanted day of a key the nearest day at hand, the earlier on ties; null if none.

    Both sides are merged in order of days and carry the day before and after along, so no pairs are formed.
    """
    w, h = wanted.select(*keys, day).distinct(), have.select(*keys, day).distinct()
    both = w.withColumns({"__w": F.lit(True), "__h": F.lit(None).cast("date")}).union(h.withColumns({"__w": F.lit(False), "__h": F.col(day)}))
    by = Window.partitionBy(*keys).orderBy(day)
    near = both.withColumns(
        {
            "__a": F.last("__h", True).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "__b": F.first("__h", True).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).filter("__w")
    before, after = F.datediff(day, "__a"), F.datediff("__b", day)
    pick = F.when(after.isNull() | (before <= after), F.col("__a")).otherwise(F.col("__b"))
    return near.select(*keys, day, pick.alias("nearest"))
