"""Balanced samples that match target shares of categories: the cube method (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.session import materialize

EPS = 1e-9


def flight(pi: np.ndarray, balance: np.ndarray | None, rng: np.random.Generator) -> np.ndarray:
    """Flight phase for the units of one category: moves pi along the kernel of its constraints until it can't.

    The constraints are the category's indicator, scaled by pi so that the sum of pi is kept, and the columns of
    balance (values divided by pi). With q columns, any q + 2 units that are neither 0 nor 1 have a
    direction in which no constraint changes; the step ends with one of them at 0 or 1, the two ends drawn with
    the odds that keep every unit's expectation. At most q + 1 units stay open. Without columns the direction is
    (1, -1), with one column it is the cross product of the two rows of constraints, with more it comes from linear algebra.
    """
    pi = np.clip(pi.astype(float), 0.0, 1.0)
    if balance is None or balance.shape[1] == 0:
        u = rng.random(len(pi))
        open_, p = -1, 0.0
        for i in np.flatnonzero((pi > EPS) & (pi < 1 - EPS)):
            if open_ < 0:
                open_, p = i, pi[i]
                continue
            q = pi[i]
            up, down = min(1 - p, q), min(p, 1 - q)
            # The step is +up with the odds down / (up + down), and -down otherwise.
            step = up if u[i] * (up + down) < down else -down
            p, q = p + step, q - step
            pi[open_], pi[i] = p, q
            if EPS < p < 1 - EPS:
                continue
            pi[open_] = round(p)
            if EPS < q < 1 - EPS:
                open_, p = i, q
            else:
                pi[i], open_ = round(q), -1
        return pi
    if balance.shape[1] == 1:
        return _flight_of_three(pi, balance[:, 0], rng)
    a = np.column_stack([np.ones(len(pi)), balance]).T
    need = a.shape[0] + 1
    waiting = list(np.flatnonzero((pi > EPS) & (pi < 1 - EPS)))[::-1]
    active: list[int] = []
    while True:
        while len(active) < need and waiting:
            active.append(waiting.pop())
        if len(active) < need:
            return pi
        direction = np.linalg.svd(a[:, active])[2][-1]
        x = pi[active]
        with np.errstate(divide="ignore"):
            up = np.min(np.where(direction > EPS, (1 - x) / direction, np.where(direction < -EPS, -x / direction, np.inf)))
            down = np.min(np.where(direction > EPS, x / direction, np.where(direction < -EPS, (x - 1) / direction, np.inf)))
        x = x + (up if rng.random() * (up + down) < down else -down) * direction
        x = np.where(x < EPS, 0.0, np.where(x > 1 - EPS, 1.0, x))
        pi[active] = x
        active = [i for i, v in zip(active, x) if 0.0 < v < 1.0]


def _flight_of_three(pi: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight with one balance column: three open units at a time, along the kernel (b3 - b2, b1 - b3, b2 - b1)."""
    open_: list[tuple[int, float, float]] = []
    u = iter(rng.random(2 * len(pi) + 2).tolist())
    for i in np.flatnonzero((pi > EPS) & (pi < 1 - EPS)).tolist():
        open_.append((i, float(pi[i]), float(balance[i])))
        while len(open_) == 3:
            (i1, p1, b1), (i2, p2, b2), (i3, p3, b3) = open_
            way = (b3 - b2, b1 - b3, b2 - b1)
            scale = max(map(abs, way))
            # Three equal values leave a plane of directions; any that keeps the sum will do.
            way = tuple(d / scale for d in way) if scale > EPS else (1.0, -1.0, 0.0)
            up = min((1 - p) / d if d > 0 else -p / d for p, d in zip((p1, p2, p3), way) if abs(d) > EPS)
            down = min(p / d if d > 0 else (p - 1) / d for p, d in zip((p1, p2, p3), way) if abs(d) > EPS)
            step = up if next(u) * (up + down) < down else -down
            open_ = []
            for i, p, d, b in zip((i1, i2, i3), (p1, p2, p3), way, (b1, b2, b3)):
                p += step * d
                if EPS < p < 1 - EPS:
                    open_.append((i, p, b))
                else:
                    pi[i] = round(p)
    for i, p, _ in open_:
        pi[i] = p
    return pi


def _fly(seed: int, balance: list[str], last: bool = False):
    """The flight over all units of one group of partitions, and the landing in the last group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "unit"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(key[0]) & 0x7FFFFFFF])
        pi = pdf["pi"].to_numpy(float).copy()
        for _, at in pdf.groupby("category", sort=True).indices.items():
            b = pdf[balance].to_numpy(float)[at] if balance else None
            pi[at] = flight(pi[at], b, rng)
        flown = pdf.assign(pi=pi).drop(columns="part")
        return _land(flown) if last else flown

    return run


def _walk(seed: int):
    """The flight over a whole partition in one pass: of each category only the one open unit is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            pdf = pd.concat([*held.values(), pdf], ignore_index=True) if held else pdf.reset_index(drop=True)
            held = {}
            pi = pdf["pi"].to_numpy(float).copy()
            if len(pdf):
                rng = np.random.default_rng([seed, int(pdf["h"].iloc[-1]) & 0x7FFFFFFF])
                for c, at in sorted(pdf.groupby("category", sort=False).indices.items()):
                    pi[at] = flight(pi[at], None, rng)
            pdf["pi"] = pi
            still = (pi > EPS) & (pi < 1 - EPS)
            for c, part in pdf[still].groupby("category", sort=True):
                held[c] = part
            yield pdf[~still]
        yield from held.values()

    return run


def cube_sample(
    units: DataFrame, targets: DataFrame, size: float, balance: list[str] | None = None, seed: int = 7, per_task: int = 250_000, fan: int = 16,
    fill: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(sample, report): units drawn so that their categories match targets.

    units: unit (STRING, unique), category (STRING) and the numeric columns of balance; targets: category, share,
    min_rows. Units whose category isn't in targets can't be drawn. A category is to have
    wanted = max(min_rows, share * size) rows. With fewer units all are taken and the gap is reported. Without fill
    it isn't given to other categories, so each of them keeps its share of `size` and the sample is smaller by the
    gaps, and larger by what min_rows adds. With fill the sample has `size` rows, rounded: gaps go to the
    categories with units left, and the excess comes off those above min_rows, both in proportion to share (`_filled`).
    Numbers are rounded by largest remainder, so that their sum is kept.

    The inclusion probability of a unit is its category's number over its units. Flight phases run per partition,
    units being spread by a hash and not by category, so a hot category is no hot task; of each category
    they leave at most 1 + len(balance) units open in a partition. The open units of `fan` partitions are merged and
    fly again, and so on until one partition is left; landing rounds what is open there, keeping
    the category's sum as near as it goes. A null category counts as no category; no units or no targets
    give an empty sample.

    sample: the units drawn. report: category, share, min_rows, available, wanted, drawn, left (units looked at and not drawn),
    shortfall (wanted - available where units are missing, else 0), residual (drawn - wanted); wanted is the target before
    filling.
    """
    balance = balance or []
    u = units.filter("unit is not null and category is not null").select("unit", "category", *balance)
    have = u.groupBy("category").agg(F.count(F.lit(1)).alias("available"))
    t = targets.filter("category is not null").groupBy("category").agg(
        F.sum(F.coalesce("share", F.lit(0.0))).alias("share"), F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows")
    )
    plan = t.join(have, "category", "left").select(
        "category", "share", "min_rows", F.coalesce("available", F.lit(0)).alias("available"),
        F.greatest(F.col("min_rows").cast("double"), F.col("share") * F.lit(float(size))).alias("wanted"),
    )
    plan = materialize(_round_to_rows(_filled(materialize(plan), size) if fill else plan.withColumn("aim", F.col("wanted"))))
    h = F.xxhash64(F.lit(seed), "unit")
    counts = plan.select("category", "available", "rows")
    pi = F.when(F.col("rows") >= F.col("available"), 1.0).otherwise(F.col("rows") / F.col("available"))
    n = u.join(F.broadcast(counts) if _small(plan) else counts, "category").withColumn("pi", pi)
    n = n.select("unit", "category", *balance, "pi", h.alias("h"))
    total = plan.agg(F.sum("available").alias("n")).first()["n"] or 0
    parts = max(1, -(-int(total) // per_task), min(8, int(total) // 20_000))
    schema = n.schema
    if balance:
        # Values are divided by pi, as the cube method balances Horvitz-Thompson sums, and nulls count as 0.
        n = n.withColumns({b: F.coalesce(F.col(b).cast("double"), F.lit(0.0)) / F.greatest("pi", F.lit(1e-12)) for b in balance})
        schema = n.schema
        flown = n.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).groupBy("part").applyInPandas(
            _fly(seed, balance), schema
        )
    else:
        spread = n.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).repartition(parts, "part")
        flown = spread.drop("part").sortWithinPartitions("h", "unit").mapInPandas(_walk(seed), schema)
    flown = materialize(flown)
    is_open = (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)
    drawn = [flown.filter(F.col("pi") >= 1 - EPS).select("unit", "category")]
    passed = [flown.filter(F.col("pi") <= EPS).groupBy("category").agg(F.count(F.lit(1)).alias("left"))]
    rest, level = flown.filter(is_open), parts
    while level >= 1:
        level = 0 if level == 1 else -(-level // fan)
        groups = max(1, level)
        spread = rest.withColumn("part", F.pmod("h", F.lit(groups)).cast("int"))
        rest = spread.groupBy("part").applyInPandas(_fly(seed + 1 + groups, balance, groups == 1), schema)
        rest = materialize(rest)
        drawn.append(rest.filter(F.col("pi") >= 1 - EPS).select("unit", "category"))
        passed.append(rest.filter(F.col("pi") <= EPS).groupBy("category").agg(F.count(F.lit(1)).alias("left")))
        rest = rest.filter(is_open)
        if groups == 1:
            break
    sample, left = reduce(DataFrame.union, drawn), reduce(DataFrame.union, passed).groupBy("category").agg(F.sum("left").alias("left"))
    got = sample.groupBy("category").agg(F.count(F.lit(1)).alias("drawn"))
    report = plan.join(got, "category", "left").join(left, "category", "left").select(
        "category", "share", "min_rows", "available", "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn"),
        F.coalesce("left", F.lit(0)).alias("left"),
        F.when(F.col("available") < F.col("wanted"), F.col("wanted") - F.col("available")).otherwise(F.lit(0.0)).alias("shortfall"),
        (F.coalesce("drawn", F.lit(0)) - F.col("wanted")).alias("residual"),
    )
    return sample, report


def _small(plan: DataFrame, bound: int = 100_000) -> bool:
    """Whether the plan, one row per category, may be broadcast."""
    return plan.limit(bound + 1).count() <= bound


def _filled(plan: DataFrame, size: float) -> DataFrame:
    """Adds aim: min(available, max(min_rows, share * scale)), the scale being such that aims add up to size, rounded.

    As the scale grows, a category's aim stays at min_rows, rises with its share and ends at its units. The sum is
    piecewise linear, so the scale is found exactly between two of these turns. Where the units of all categories with
    a share don't suffice, the rest comes from those without a share, in proportion to their units left. Where the
    minima alone exceed size, they hold and the sample is larger.
    """
    from pyspark.sql import Window

    n = float(int(size + 0.5))
    low = F.least("min_rows", "available").cast("double")
    plan = plan.withColumn("low", low)
    least = plan.agg(F.sum("low").alias("n")).first()["n"] or 0.0
    live = plan.filter("share > 0 and available > low")
    turns = live.select(F.explode(F.array(
        F.struct((F.col("low") / F.col("share")).alias("at"), F.col("share").alias("slope")),
        F.struct((F.col("available") / F.col("share")).alias("at"), (-F.col("share")).alias("slope")),
    )).alias("t")).select("t.*").groupBy("at").agg(F.sum("slope").alias("slope"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.select("at", F.sum("slope").over(upto).alias("s"), F.sum(F.col("slope") * F.col("at")).over(upto).alias("c"))
    last = turns.filter(F.col("at") * F.col("s") - F.col("c") + F.lit(least) <= F.lit(n)).agg(F.max_by(F.struct("at", "s", "c"), "at").alias("t")).first()["t"]
    scale = 0.0
    if last is not None:
        scale = (n - least + last["c"]) / last["s"] if last["s"] > EPS else last["at"]
    aim = F.when(F.col("share") > 0, F.least(F.col("available").cast("double"), F.greatest("low", F.col("share") * F.lit(scale)))).otherwise(F.col("low"))
    plan = plan.withColumn("aim", aim).withColumn("spare", F.when(F.col("share") > 0, 0.0).otherwise(F.col("available") - F.col("low")))
    got = plan.agg(F.sum("aim").alias("n"), F.sum("spare").alias("spare")).first()
    short, spare = n - (got["n"] or 0.0), got["spare"] or 0.0
    if short > 1e-6 and spare > 0:
        plan = plan.withColumn("aim", F.col("aim") + F.col("spare") * F.lit(min(1.0, short / spare)))
    return plan.drop("low", "spare")


def _round_to_rows(plan: DataFrame) -> DataFrame:
    """Adds rows in place of aim: aims rounded so that the total is kept, the largest remainders going up; min_rows is kept."""
    from pyspark.sql import Window

    base = F.floor(F.col("aim") + EPS)
    rest = F.col("aim") - base
    by = Window.orderBy(rest.desc(), "category")
    extra = F.round(F.sum(rest).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return plan.withColumn("rows", (base + (F.row_number().over(by) <= extra).cast("int")).cast("long")).drop("aim")


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """Landing: in each category the open units with the largest pi are taken, as many as their sum rounds to."""
    pi = pdf["pi"].to_numpy(float).copy()
    for _, at in pdf.groupby("category", sort=True).indices.items():
        open_ = at[(pi[at] > EPS) & (pi[at] < 1 - EPS)]
        if len(open_):
            k = int(round(pi[open_].sum()))
            order = open_[np.argsort(-pi[open_], kind="stable")]
            pi[order[:k]], pi[order[k:]] = 1.0, 0.0
    return pdf.assign(pi=pi)
