"""Percentiles per group from mergeable states, by distributed multi-select (problem 4).

States come in two kinds: exact ones (`value_states`, a weight per distinct value) and compact ones of a fixed size with a
stated rank error (`compact_states`). Both are combined by UNION ALL and read by `multi_select`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.session import discard, materialize

#: Candidates that one range may keep for the last step, done in one sorted pass.
ENOUGH = 64
#: Pivots of a range in a round; about as many times fewer candidates are left by it.
PIVOTS = 15


def value_states(df: DataFrame, group: str, value: str, part: str) -> DataFrame:
    """The state of each part (a month, a day, a partition): (part, grp, value, n), n rows having that value.

    States of parts that hold different rows are combined by UNION ALL, at any time, in any order. They are exact,
    and no larger than the rows they came from. Null and NaN values are no numbers and are left out;
    a null group or part is a group or part of its own.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(part).alias("part"), F.col(group).alias("grp"), v.alias("value"))
    return rows.filter("value is not null and not isnan(value)").groupBy("part", "grp", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def _weighted(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """PIVOTS weighted quantiles at even steps, the middle one being the weighted median."""
    order = np.argsort(values, kind="stable")
    c = np.cumsum(weights[order])
    steps = np.arange(1, PIVOTS + 1) / (PIVOTS + 1)
    return values[order][np.minimum(np.searchsorted(c, c[-1] * steps), len(c) - 1)]


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Local medians, quartiles and so on of this partition for each range, from those of its batches, and the weight behind each."""
    held: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(key: tuple[str, str], values: np.ndarray, weights: np.ndarray) -> None:
        held.setdefault(key, []).append((_weighted(values, weights), np.full(PIVOTS, weights.sum() / PIVOTS)))

    for pdf in batches:
        for key, part in pdf.groupby(["g", "iv"], sort=False):
            add(key, part["value"].to_numpy(), part["n"].to_numpy(float))
            if len(held[key]) > 64:
                all_ = held.pop(key)
                add(key, np.concatenate([v for v, _ in all_]), np.concatenate([w for _, w in all_]))
    if held:
        out = [(*key, float(v), float(w)) for key, x in held.items() for values, weights in x for v, w in zip(values, weights)]
        yield pd.DataFrame(out, columns=["g", "iv", "value", "w"])


def _slot(value: Column, pivots: Column) -> Column:
    """0, 2, 4 .. for values before, between and behind the pivots (sorted, distinct), 1, 3, 5 .. for those equal to one."""
    below = F.size(F.filter(pivots, lambda p: p < value))
    return 2 * below + F.array_contains(pivots, value).cast("int")


def multi_select(states: DataFrame, fractions: list[float], enough: int = ENOUGH) -> DataFrame:
    """(grp, fraction, value, n_rows, rank_error): the smallest value with at least fraction * n_rows rows up to it.

    All fractions of a group are looked for together. They start in one range that holds all values of the group. In a round,
    each partition proposes the median (and further quantiles) of its rows in each range, the weighted medians of
    the proposals are the pivots, and rows before, at and after every pivot are counted. Each fraction goes on in
    the one range between pivots that holds its rank, or has its answer where the rank falls on a pivot. Ranges never
    overlap, so a value is looked at once however many fractions there are, and values outside of them are discarded: what
    is kept is written anew, so a round reads a fraction of what the last one read, and the files before it are removed.
    When no range has more than `enough` distinct values, running counts over these give the answers.

    The answers are exact for the states given: rank_error is 0 for exact states, and for compact ones what
    `compact_states` states. Ranges are kept in tables, not in the driver; it gets one row saying whether any is open.
    """
    if not fractions or any(not 0 < f <= 1 for f in fractions):
        raise ValueError("fractions lie in (0, 1]")
    g = F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit("null"))
    live = materialize(
        states.groupBy("grp", "value").agg(F.sum("n").alias("n")).select("grp", g.alias("g"), F.lit("").alias("iv"), "value", "n")
    )
    totals = live.groupBy("grp", "g").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("open"))
    ks = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(f)).alias("fraction")) for i, f in enumerate(fractions)]))
    targets = materialize(totals.select("grp", "g", "n_rows", "open", ks.alias("x")).select(
        "grp", "g", "n_rows", "x.k", "x.fraction",
        F.greatest(F.lit(1.0), F.ceil(F.col("x.fraction") * F.col("n_rows") - 1e-9)).alias("rank"),
        F.lit("").alias("iv"), F.lit(0.0).alias("below"), "open", F.lit(None).cast("double").alias("value"),
    ))
    is_wide = F.col("value").isNull() & (F.col("open") > enough)
    while not targets.filter(is_wide).isEmpty():
        wide = targets.filter(is_wide).select("g", "iv").distinct()
        proposals = live.join(wide, ["g", "iv"], "left_semi").select("g", "iv", "value", "n").mapInPandas(
            _propose, "g string, iv string, value double, w double"
        )
        by, all_ = Window.partitionBy("g", "iv").orderBy("value"), Window.partitionBy("g", "iv")
        step = F.ceil((F.col("c") - F.col("w") / 2) / F.col("t") * (PIVOTS + 1))
        pivots = materialize(
            proposals.groupBy("g", "iv", "value").agg(F.sum("w").alias("w"))
            .withColumn("c", F.sum("w").over(by)).withColumn("t", F.sum("w").over(all_))
            .groupBy("g", "iv", step.alias("step")).agg(F.max("value").alias("value"))
            .groupBy("g", "iv").agg(F.array_sort(F.collect_set("value")).alias("ps"))
        )
        slotted = live.select("g", "iv", "value", "n").join(pivots, ["g", "iv"], "left").withColumn("slot", _slot(F.col("value"), F.col("ps")))
        slotted = slotted.withColumn("next", F.when(F.col("ps").isNull(), F.col("iv")).otherwise(F.concat_ws(".", "iv", "slot")))
        # At most 2 * PIVOTS + 3 slots of each range are ordered in one task.
        upto = Window.partitionBy("g", "iv").orderBy("slot")
        counts = slotted.filter("ps is not null").groupBy("g", "iv", "slot", "next").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("here"), F.max("value").alias("at")
        ).withColumn("cum", F.sum("n").over(upto))
        # Slots meet without a gap and the outer ones are open, so that every rank lies in one, whatever sums of weights round to.
        ordered = Window.partitionBy("g", "iv").orderBy("slot")
        counts = counts.withColumn("before", F.lag("cum").over(ordered)).withColumn("to", F.when(F.lead("cum").over(ordered).isNotNull(), F.col("cum")))
        found = targets.filter("value is null").join(counts, ["g", "iv"]).filter(
            "(before is null or rank > below + before) and (to is null or rank <= below + to)"
        )
        moved = found.select(
            "g", "k", "next", (F.col("below") + F.coalesce("before", F.lit(0.0))).alias("below2"), "here",
            F.when(F.col("slot") % 2 == 1, F.col("at")).alias("at"),
        )
        after = materialize(
            targets.join(moved, ["g", "k"], "left").select(
                "grp", "g", "n_rows", "k", "fraction", "rank", F.coalesce("next", "iv").alias("iv"), F.coalesce("below2", "below").alias("below"),
                F.coalesce("here", "open").alias("open"), F.coalesce("value", "at").alias("value"),
            )
        )
        needed = after.filter("value is null").select("g", F.col("iv").alias("next")).distinct()
        kept = materialize(slotted.join(needed, ["g", "next"], "left_semi").select("g", F.col("next").alias("iv"), "value", "n"))
        for old in (live, targets, pivots):
            discard(old)
        live, targets = kept, after
    w = Window.partitionBy("g", "iv").orderBy("value")
    run = live.select("g", "iv", F.col("value").alias("at"), F.sum("n").over(w).alias("c"))
    last = (
        targets.filter("value is null").join(run, ["g", "iv"]).groupBy("g", "k")
        .agg(F.coalesce(F.min(F.when(F.expr("below + c >= rank"), F.col("at"))), F.max("at")).alias("at"))
    )
    error = "rank_error" if "rank_error" in states.columns else None
    out = targets.join(last, ["g", "k"], "left").select("grp", "fraction", F.coalesce("value", "at").alias("value"), F.col("n_rows").cast("long").alias("n_rows"))
    if error is None:
        return out.withColumn("rank_error", F.lit(0))
    return out.withColumn("rank_error", states.agg(F.max(error)).scalar())


def compact_states(states: DataFrame, points: int) -> DataFrame:
    """States of at most `points` values for each part and group: (part, grp, value, n, rank_error).

    The values are the quantiles at (j + 1/2) / points, found by multi_select, so no part or group is ordered in one task,
    and each stands for n_rows / points rows. The rank of any value in the state is off by at most n_rows / (2 * points) + 1
    rows; off parts and days combined the same holds of their sum, which is what rank_error says as a share:
    1 / (2 * points), besides one row a state. Exact states of fewer than `points` values are kept as they are.
    """
    sizes = states.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("values"))
    same = F.col("s.part").eqNullSafe(F.col("z.part")) & F.col("s.grp").eqNullSafe(F.col("z.grp"))
    few = states.alias("s").join(sizes.filter(F.col("values") <= points).alias("z"), same, "left_semi").select("part", "grp", "value", F.col("n").cast("double").alias("n"))
    many = states.alias("s").join(sizes.filter(F.col("values") > points).alias("z"), same, "left_semi")
    keyed = many.select(F.struct("part", "grp").alias("grp"), "value", "n")
    # A struct isn't a string: its JSON names the pair, nulls left out.
    keyed = keyed.withColumn("key", F.to_json("grp"))
    names = keyed.groupBy("key").agg(F.first("grp").alias("pair"))
    found = multi_select(keyed.select(F.col("key").alias("grp"), "value", "n"), [(j + 0.5) / points for j in range(points)])
    found = found.join(names, F.col("grp") == F.col("key")).select("pair.part", "pair.grp", "value", (F.col("n_rows") / F.lit(float(points))).alias("n"))
    both = found.groupBy("part", "grp", "value").agg(F.sum("n").alias("n")).unionByName(few)
    return both.withColumn("rank_error", F.lit(0.5 / points))
