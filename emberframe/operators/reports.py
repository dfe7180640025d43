"""Building blocks of report tables: counts by class, matrices, deltas against a base, best and running-best rows, histograms.

All of them are plain aggregates, so a hot group costs one state per task; where a row is picked from a group it is picked by a
minimum or maximum and not by ordering the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(condition: Column) -> Column:
    """Number of rows that meet a condition; null doesn't."""
    return F.count(F.when(condition, 1))


def class_counts(df: DataFrame, by: Sequence[str], classes: Mapping[str, Column], total: str = "n", level: str | None = None) -> DataFrame:
    """Rows of each class by group, and their total. With level, a last row over all groups has level = 1 and null keys."""
    grouped = df.rollup(*by) if level else df.groupBy(*by)
    aggs = [counted(c).alias(name) for name, c in classes.items()] + [F.count(F.lit(1)).alias(total)]
    if level:
        aggs.append(F.grouping(by[0]).cast("bigint").alias(level))
    return grouped.agg(*aggs)


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def matrix(df: DataFrame, row: Sequence[str], column: str, values: Mapping[str, object], value: Column) -> DataFrame:
    """A long table as a matrix: one row per key, one column per entry of values (name -> key); the largest where several stand."""
    return df.groupBy(*row).agg(*[F.max(F.when(F.col(column) == F.lit(key), value)).alias(name) for name, key in values.items()])


def with_group_best(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with name: whether the row's value is the best of its group."""
    best = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.max(value).alias("__best"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return df.join(best, on).select(*df.columns, (F.col(value) == F.col("__best")).alias(name))


def best_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The first row of each group in the order (ascending columns that tell its rows apart), as an algebraic minimum."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*keep), key).alias("__row"))
    return picked.select(*by, *[F.col(f"__row.{c}").alias(c) for c in keep])


def deltas(df: DataFrame, value: str, base: Column, digits: int = 6) -> DataFrame:
    """df with delta: value minus that of the one row that meets base; null where none does."""
    at = df.filter(base).agg(F.max(value).alias("b"))
    return df.withColumn("delta", F.round(F.col(value) - at.scalar(), digits))


def leave_one_out(scores: DataFrame, label: str, region: str, value: str, left_out: Column) -> DataFrame:
    """Per label the mean over regions of its score less the score of all labels there (delta), and both macro means.

    Rows that meet left_out are the ones the label was trained on; they take no part in its own mean.
    """
    full = scores.groupBy(F.col(region).alias("__r")).agg(F.avg(value).alias("full"))
    own = scores.filter(~F.coalesce(left_out, F.lit(False))).groupBy(label, region).agg(F.avg(value).alias("own"))
    j = own.join(full, F.col(region) == F.col("__r"), "left")
    return j.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_regions"), F.round(F.avg(F.col("own") - F.col("full")), 6).alias("delta"),
        F.round(F.avg(F.coalesce("full", F.lit(0.0))), 6).alias("full_macro"), F.round(F.avg("own"), 6).alias("loo_macro"),
    )


def running_best(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """df with best (the largest value so far in the order) and is_new_best. A group is one run's rows: few."""
    w = Window.partitionBy(*by).orderBy(order)
    seen = df.withColumn("best", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return seen.withColumn("is_new_best", F.coalesce(F.col(value) > before, F.lit(True)))


def edge_histogram(df: DataFrame, by: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """(by, bin, n): rows by bins [edge, next edge), the last one closed; bin counts from 0, -1 is below and len(edges) - 1 above all.

    Null and NaN values are in no bin.
    """
    v = F.col(value)
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= v)) - 1
    at = F.when(v == F.lit(float(edges[-1])), len(edges) - 2).otherwise(at)
    d = df.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    return d.groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): rows by bins of equal width between the least and the largest value, which falls into the last bin."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if span["lo"] is None:
        return df.groupBy(F.lit(0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = F.nullif(F.lit(span["hi"] - span["lo"]), F.lit(0.0))
    at = F.coalesce(F.floor((F.col(value) - F.lit(span["lo"])) / width * bins), F.lit(0))
    return df.groupBy(F.least(F.lit(bins - 1), at).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def contingency_scores(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: nmi, ari and purity of two labellings, from the table of their counts."""
    k = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sets = k.groupingSets([["a", "b"], ["a"], ["b"], []], "a", "b").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.grouping_id().alias("gid"))
    n, t = F.col("n").cast("double"), df.agg(F.count(F.lit(1)).cast("double")).scalar()
    of = lambda gid, v: F.sum(F.when(F.col("gid") == gid, v))
    plogp, two = n / t * F.log(n / t), n * (n - 1) / 2
    s = sets.agg(
        of(0, plogp).alias("hab"), of(1, plogp).alias("ha"), of(2, plogp).alias("hb"), of(0, two).alias("c"), of(1, two).alias("ca"),
        of(2, two).alias("cb"), of(3, two).alias("ct"), (of(1, F.col("top")) / of(3, n)).alias("purity"),
    )
    # I(a, b) = H(a) + H(b) - H(a, b); the sums of p ln p are minus the entropies.
    nmi = (F.col("hab") - F.col("ha") - F.col("hb")) / (-(F.col("ha") + F.col("hb")) / 2)
    chance = F.col("ca") * F.col("cb") / F.col("ct")
    ari = (F.col("c") - chance) / ((F.col("ca") + F.col("cb")) / 2 - chance)
    return s.select(F.round(nmi, 6).alias("nmi"), F.round(ari, 6).alias("ari"), F.round("purity", 6).alias("purity"))
