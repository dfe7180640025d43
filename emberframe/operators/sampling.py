"""Deterministic sampling: hashes take the place of a random generator, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_unit(key: Column, seed: int = 42) -> Column:
    """A number in (0, 1) from a whole number, by arithmetic that other engines can repeat: (key * 2654435761 + seed) mod 1000003.

    Key and factor are reduced before they are multiplied, so that no key overflows a BIGINT.
    """
    m = F.lit(1000003)
    return (F.pmod(F.pmod(key.cast("bigint"), m) * (2654435761 % 1000003) + seed % 1000003, m) + 0.5) / 1000003.0


def fire_day_key(fire: Column, day: Column) -> Column:
    return fire.cast("bigint") * 10007 + F.datediff(day, F.lit("2000-01-01"))


def size_weight(n: Column, exponent: float = 0.5) -> Column:
    return F.pow(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("double"), F.lit(exponent))


def weighted_key(u: Column, weight: Column, documented: bool = True) -> Column:
    """The smaller, the earlier picked: -ln(u) / weight (exponential clocks), or u / weight."""
    return (-F.log(u) if documented else u) / weight


def capped(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group; map tasks keep no more than that many per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= most).drop("__rank")


def cheapest(pool: DataFrame, per_region: int, per_fire: int, exponent: float = 0.5) -> DataFrame:
    """Up to per_fire days of a fire and per_region rows of a region by u / weight, downloaded pairs weighing more."""
    cost = F.when(F.col("t_full") & F.col("t1_full"), 1.0).when(F.col("t_full"), 0.7).otherwise(0.5)
    key = weighted_key(hash_unit(fire_day_key(F.col("fire_id"), F.col("day_t"))), size_weight(F.col("num_fire"), exponent) * cost, False)
    keyed = pool.withColumn("key", key)
    some = capped(keyed, ["fire_id"], [F.col("key"), F.col("day_t")], per_fire)
    return capped(some.filter("region_id > 0"), ["region_id"], [F.col("key"), F.col("fire_id"), F.col("day_t")], per_region)


def balanced(pool: DataFrame, per_region: int, per_fire: int, static_share: float = 0.2, exponent: float = 0.5) -> DataFrame:
    """per_region rows of each region, static fires up to static_share of them, weighted by fire size without replacement."""
    u = hash_unit(fire_day_key(F.col("fire_id"), F.col("day_t")))
    both = F.coalesce(F.col("t_full") & F.col("t1_full"), F.lit(False)).cast("int")
    some = capped(pool.withColumn("u", u), ["fire_id"], [both.desc(), F.col("u"), F.col("day_t")], per_fire).filter("region_id > 0")
    key = weighted_key(F.col("u"), size_weight(F.col("num_fire"), exponent))
    keyed = some.withColumns({"key": key, "is_static": F.col("fire_type") == 1})
    w = Window.partitionBy("region_id", "is_static").orderBy("key", "fire_id", "day_t")
    picks = keyed.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= per_region)
    most = int(per_region * static_share)
    # Only the other class needs to know how many static ones there are: at most `most` of each region.
    n = picks.filter(F.col("is_static") & (F.col("__rank") <= most)).groupBy("region_id").agg(F.count(F.lit(1)).alias("__n"))
    full = picks.join(n, "region_id", "left").fillna(0, ["__n"])
    keep = F.when(F.col("is_static"), F.col("__rank") <= most).otherwise(F.col("__rank") <= per_region - F.col("__n"))
    return full.filter(keep).drop("__rank", "__n", "key", "u", "is_static")


def whole_groups(df: DataFrame, group: str, most: int, seed: int = 42) -> DataFrame:
    """Rows of whole groups, taken in hash order until at least `most` rows are reached.

    The prefix is found on a histogram of hash buckets, so no task sorts all groups: buckets before the
    boundary are taken whole and only the boundary's groups are ordered.
    """
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col(group).isNotNull()).withColumn("u", hash_unit(F.col(group), seed))
    b = g.withColumn("b", F.floor(F.col("u") * 1024).cast("int"))
    hist = b.groupBy("b").agg(F.sum("n").alias("n"))
    run = hist.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"), F.col("n").alias("size"))
    edge = b.join(F.broadcast(run.filter(F.col("before") < most)), "b")
    w = Window.partitionBy("b").orderBy("u", group).rowsBetween(Window.unboundedPreceding, -1)
    ahead = edge.drop("size").withColumn("ahead", F.col("before") + F.coalesce(F.sum(b["n"]).over(w), F.lit(0)))
    return df.join(ahead.filter(F.col("ahead") < most).select(group), group, "left_semi")


def temporal_split(df: DataFrame, by: str, order: list[str], train: float = 0.60, val: float = 0.15) -> DataFrame:
    """df with `part`: by group, in the order of dates, the first share to train, the next to val, the rest to test.

    A group (a region) may hold a third of all rows: it is cut by day counts, which are few, and only
    the two days on which a boundary falls are numbered row by row.
    """
    day = order[0]
    n = df.groupBy(by, day).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(day)
    all_ = Window.partitionBy(by)
    days = n.select(by, day, (F.sum("n").over(w) - F.col("n")).alias("before"), F.col("n").alias("size"), F.sum("n").over(all_).alias("total"))
    cut = days.withColumns({"t1": F.floor(F.col("total") * train), "t2": F.floor(F.col("total") * (train + val))})

    def split(first, last):
        return F.when(last <= F.col("t1"), "train").when((first >= F.col("t1")) & (last <= F.col("t2")), "val").when(first >= F.col("t2"), "test")

    cut = cut.withColumn("whole", split(F.col("before"), F.col("before") + F.col("size")))
    cut = cut.withColumnsRenamed({by: "__by", day: "__day"})
    on = df[by].eqNullSafe(F.col("__by")) & df[day].eqNullSafe(F.col("__day"))
    j = df.join(cut, on)
    done = j.filter("whole is not null").withColumn("part", F.col("whole"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("__by", "__day").orderBy(*order[1:])) - 1
    edge = j.filter("whole is null").withColumn("__at", at).withColumn("part", split(F.col("__at"), F.col("__at") + 1)).drop("__at")
    return done.unionByName(edge).select(*df.columns, "part")
