"""Running sums and ranks over all rows, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.session import materialize


def running_total(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """df with run_<column>: the sum over all rows up to and with this one in the given order.

    Rows are range-partitioned and summed within their range; the ranges' totals, one row each, give what to add.
    Rows that tie in order must have been merged before, or the result among them is arbitrary.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(*order)
    total = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = total.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    run = ranged.join(F.broadcast(ahead), "__part")
    return run.select(*df.columns, *[(F.sum(c).over(w) + F.col(f"__{c}")).alias(f"run_{c}") for c in columns])


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with its place in the order, from 0; order must tell all rows apart."""
    run = running_total(df.withColumn("__one", F.lit(1)), order, ["__one"])
    return run.withColumn(name, F.col("run___one") - 1).drop("__one", "run___one")


def group_positions(df: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """df with its place in its group's order, from 0, though one group may hold most rows.

    Rows are placed in the order of all groups; the first place of each group, an algebraic minimum, is taken off.
    """
    at = materialize(positions(df, [group, *order], "__at"))
    first = at.groupBy(F.col(group).alias("__g")).agg(F.min("__at").alias("__first"))
    hit = at[group].eqNullSafe(first["__g"])
    return at.join(first, hit).withColumn(name, F.col("__at") - F.col("__first")).drop("__at", "__g", "__first")


def ranked_values(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """df with the rank of its value, the largest first and equal values sharing a rank: one count per value is ordered, not the rows."""
    n = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__neg", -F.col("__v"))
    run = running_total(n, ["__neg"], ["__n"]).select("__v", (F.col("run___n") - F.col("__n") + 1).alias(name))
    return df.join(run, df[value].eqNullSafe(run["__v"])).drop("__v")


def even_positions(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows at evenly spaced places of the order, first and last included, places truncated; all rows if no more than k."""
    n = df.count()
    at = [i for i in range(n)] if n <= k else sorted({i * (n - 1) // (k - 1) for i in range(k)} if k > 1 else {0})
    return positions(df, order, "__at").filter(F.col("__at").isin(at)).drop("__at")


def strided(df: DataFrame, order: list[str], job: int, jobs: int) -> DataFrame:
    """Every jobs-th row of the order, from place `job`."""
    return positions(df, order, "__at").filter(F.pmod("__at", F.lit(jobs)) == job).drop("__at")


def sliced(df: DataFrame, order: list[str], job: int, jobs: int) -> DataFrame:
    """The job-th of `jobs` contiguous pieces, whose ends are n * job // jobs."""
    n = df.count()
    return positions(df, order, "__at").filter((F.col("__at") >= n * job // jobs) & (F.col("__at") < n * (job + 1) // jobs)).drop("__at")


def chunked(df: DataFrame, order: list[str], jobs: int) -> DataFrame:
    """df with `chunk`, one of `jobs` contiguous pieces; the first n % jobs of them have one row more."""
    n = df.count()
    size, more = divmod(n, jobs)
    at = F.col("__at")
    chunk = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(size, 1)))
    return positions(df, order, "__at").withColumn("chunk", chunk.cast("int")).drop("__at")
