"""Per-key results although a few keys hold most rows (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Functions whose state per key is of fixed size and merges.
ALGEBRAIC = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "bool_or": F.bool_or, "bool_and": F.bool_and}


def combine_by_key(df: DataFrame, keys: list[str], states: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """One row per key with states name -> (function, column), the function one of ALGEBRAIC.

    Every map task folds its rows into a hash table of key states that is bounded by the task's memory (it
    spills, sorted, and merges), and only those states are shuffled: a key with a third of all rows sends
    one state per map task. Null keys form one group; an empty input gives an empty result. Functions
    without such a state, as distinct counts and lists, are refused: make their keys distinct before.
    """
    if bad := {f for f, _ in states.values()} - set(ALGEBRAIC):
        raise ValueError(f"no state of fixed size: {sorted(bad)}")
    return df.groupBy(*keys).agg(*[ALGEBRAIC[f](c).alias(name) for name, (f, c) in states.items()])


def fire_totals(counting_rows: DataFrame, fires: DataFrame) -> DataFrame:
    """(fire_id, n_samples, first_dt, last_dt, num_fire, samples_per_detection) per recorded fire_id.

    The rows of a null fire_id form one group. num_fire is the largest known in fires, null
    where the fire is unknown there or has none; the ratio is null where num_fire is null
    or 0. Both sides of the join have one row per key, so no key can be hot in it.
    """
    mine = combine_by_key(
        counting_rows, ["fire_id"], {"n_samples": ("count", F.lit(1)), "first_dt": ("min", "dt"), "last_dt": ("max", "dt")}
    )
    known = combine_by_key(fires.filter("fire_id is not null"), ["fire_id"], {"num_fire": ("max", "num_fire")})
    return mine.join(known, "fire_id", "left").select(
        "fire_id",
        "n_samples",
        "first_dt",
        "last_dt",
        "num_fire",
        F.expr("n_samples / nullif(num_fire, 0)").alias("samples_per_detection"),
    )


def heavy_keys(totals: DataFrame, least_share: float) -> DataFrame:
    """Keys of fire_totals that hold at least least_share of all samples, null not among them."""
    everything = totals.agg(F.sum("n_samples").alias("n"))
    return totals.filter(F.col("fire_id").isNotNull() & (F.col("n_samples") >= F.lit(least_share) * everything.scalar()))
