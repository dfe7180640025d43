"""Weighted cosine join between two sets of records (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.session import materialize


def unit_vectors(terms: DataFrame) -> DataFrame:
    """(id, term, weight) with repeated terms summed and every vector scaled to length 1; zero vectors vanish."""
    t = terms.filter("id is not null and term is not null and weight > 0").groupBy("id", "term").agg(
        F.sum("weight").alias("weight")
    )
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return t.withColumn("weight", F.col("weight") / norm)


def cosine_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, cosine) of all pairs with cosine >= threshold > 0; left and right are unit_vectors.

    right is indexed by inverted lists. Before, each right vector loses the terms that cannot matter: in the order
    of what a term can add to a dot product for each entry of its list in left (light terms with long lists first), the
    longest prefix stays out of the index whose dot product with any left vector is below the threshold, by the maximum left
    weight of its terms or by its norm, whichever bound is less. A pair at the threshold therefore shares an indexed term.
    Matches of one list are summed; a pair goes on only if that sum and the bound of the left-out prefix
    reach the threshold, and then the prefix is added exactly. Lists are joined term by term; a hot
    list is split by the skew join of adaptive execution. Empty sides give an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies in (0, 1]")
    eps = 1e-9
    left, right = materialize(left), right
    lists = left.groupBy("term").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("df"))
    # Terms that no left vector has add nothing to any dot product: they are the start of every prefix.
    held = right.join(lists, "term")
    order = Window.partitionBy("id").orderBy(F.col("weight") * F.col("top") / F.col("df"), "term")
    bounds = held.withColumns(
        {
            "__max": F.sum(F.col("weight") * F.col("top")).over(order),
            "__norm": F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(order)),
        }
    )
    bounds = bounds.withColumn("bound", F.least("__max", "__norm"))
    out = F.col("bound") < threshold - eps
    posted = materialize(
        bounds.select(
            F.col("id").alias("right_id"), "term", "weight", (~out).alias("indexed"),
            F.coalesce(F.max(F.when(out, F.col("bound"))).over(Window.partitionBy("id")), F.lit(0.0)).alias("rest"),
        )
    )
    lv = left.select(F.col("id").alias("left_id"), "term", F.col("weight").alias("lw"))
    cand = (
        posted.filter("indexed").join(lv, "term").groupBy("left_id", "right_id")
        .agg(F.sum(F.col("weight") * F.col("lw")).alias("dot"), F.first("rest").alias("rest"))
        .filter(F.col("dot") + F.col("rest") >= threshold - eps)
    )
    # Pairs whose prefix is empty are done; the others get its products.
    prefix = posted.filter("not indexed").select("right_id", "term", "weight")
    cand = materialize(cand)
    more = (
        cand.filter("rest > 0").select("left_id", "right_id").join(prefix, "right_id").join(lv, ["left_id", "term"])
        .groupBy("left_id", "right_id").agg(F.sum(F.col("weight") * F.col("lw")).alias("more"))
    )
    return (
        cand.join(more, ["left_id", "right_id"], "left")
        .select("left_id", "right_id", F.least(F.lit(1.0), F.col("dot") + F.coalesce("more", F.lit(0.0))).alias("cosine"))
        .filter(F.col("cosine") >= threshold - eps)
    )
