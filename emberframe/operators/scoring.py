"""Scoring masked predictions: confusion counts, ratios, threshold sweeps, ranking and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.ordering import running_total

RATIOS = ["precision", "recall", "f1", "iou", "brier"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(pixels: DataFrame, keys: list[str], threshold: Column | float = 0.5) -> DataFrame:
    """tp, fp, fn, tn, brier_sum and n per key over pixels(pred, target, mask) whose mask is set; pred > threshold counts.

    Only algebraic sums: they are combined before the shuffle, and every coarser grouping can be had from them.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, y, m = F.col("pred") > t, F.col("target") == 1, F.coalesce(F.col("mask") == 1, F.lit(False))

    def count(c: Column) -> Column:
        return F.coalesce(F.sum((c & m).cast("bigint")), F.lit(0))

    return pixels.groupBy(*keys).agg(
        count(hit & y).alias("tp"), count(hit & ~y).alias("fp"), count(~hit & y).alias("fn"), count(~hit & ~y).alias("tn"),
        F.coalesce(F.sum(F.when(m, F.pow(F.col("pred") - F.col("target"), 2))), F.lit(0.0)).alias("brier_sum"),
        F.coalesce(F.sum(m.cast("bigint")), F.lit(0)).alias("n"),
    )


def ratios(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, IoU and Brier score from confusion counts, 0 on an empty denominator."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "iou": ratio(tp, tp + fp + fn), "brier": ratio(F.col("brier_sum"), F.col("n")),
        }
    )


def micro(per_sample: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios of summed counts per key; samples without any positive, predicted or real, are left out."""
    kept = per_sample.filter(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    sums = kept.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "brier_sum", "n")], F.count(F.lit(1)).alias("n_samples")
    )
    return ratios(sums)


def sweep(pixels: DataFrame, keys: list[str], steps: int = 100) -> DataFrame:
    """F1 of pred >= k / steps for k = 1 .. steps - 1, per key, from one histogram of steps bins.

    All valid pixels are pooled. The running sums run over at most `steps` rows per key.
    """
    valid = pixels.filter("mask = 1 and pred is not null")
    b = F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.floor(F.col("pred") * steps))).cast("int")
    hist = valid.groupBy(*keys, b.alias("bin")).agg(
        F.sum((F.col("target") == 1).cast("bigint")).alias("p"), F.sum((F.col("target") != 1).cast("bigint")).alias("q")
    )
    grid = hist.groupBy(*keys).agg(F.sum("p").alias("pos")).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    w = Window.partitionBy(*keys).orderBy(F.col("bin").desc())
    full = grid.join(hist.select(*keys, "bin", "p", "q"), [*keys, "bin"], "left").fillna(0, ["p", "q"])
    run = full.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("q").over(w)})
    return run.select(
        *keys, (F.col("bin") / float(steps)).alias("threshold"), "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"),
        ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")).alias("f1"),
    )


def best_threshold(swept: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest threshold with the best F1 per key."""
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))).alias("b")
    return swept.groupBy(*keys).agg(best).select(*keys, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def roc_auc(pixels: DataFrame) -> DataFrame:
    """(n_pos, n_neg, auc) over valid pixels by rank sums, ties counting half; 0 if a class is missing."""
    valid = pixels.filter("mask = 1 and pred is not null")
    by = valid.groupBy("pred").agg(
        F.sum((F.col("target") == 1).cast("bigint")).alias("p"), F.sum((F.col("target") != 1).cast("bigint")).alias("q")
    )
    won = running_total(by, ["pred"], ["q"]).agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_neg"),
        F.sum(F.col("p") * (F.col("run_q") - F.col("q") / 2.0)).alias("u"),
    )
    return won.select("n_pos", "n_neg", ratio(F.col("u"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def masked_losses(pixels: DataFrame, keys: list[str], logit: Column) -> DataFrame:
    """Masked means of cross entropy and focal loss, and the dice loss, per key."""
    from emberframe.functions.scalars import bce, focal, sigmoid

    y, m = F.col("target").cast("double"), F.coalesce(F.col("mask"), F.lit(0)).cast("double")
    n = F.greatest(F.sum(m), F.lit(1.0))
    p = sigmoid(logit) * m
    return pixels.groupBy(*keys).agg(
        (F.sum(bce(logit, y) * m) / n).alias("bce"), (F.sum(focal(logit, y) * m) / n).alias("focal"),
        (1.0 - (2.0 * F.sum(p * y * m) + 1.0) / (F.sum(p) + F.sum(y * m) + 1.0)).alias("dice"),
    ).withColumn("hybrid", 0.3 * F.col("focal") + 0.7 * F.col("dice"))


def dilate(cells: DataFrame, keys: list[str], radius: int, height: int, width: int) -> DataFrame:
    """Cells (keys, row, col) grown by a disk of the radius, inside height x width."""
    disk = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disk]))
    grown = cells.select(*keys, "row", "col", at.alias("d")).select(
        *keys, (F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col")
    )
    return grown.filter((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)).distinct()
