"""Splits that keep related records together (problem 1).

Records are linked by the values of any number of identifying columns. Hash-to-min finds the components of
the graph of those values; every component is then sent to one split by weighted rendezvous hashing.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import discard, materialize

#: Strata told apart when splits are balanced: the largest ones. All others are balanced together, as one.
MAX_STRATA = 2000
#: Components with at least this share of all records are placed one by one; there are at most 1 / HEAVY of them.
HEAVY = 0.001


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph edges(u, v) as (node, component), component being the least node.

    Each node v holds a cluster C(v), at first itself and its neighbours. In a round it sends C(v) to the
    least node of C(v) and that least node to every other member; the union of what arrives is the new C(v).
    It ends when the clusters stand still. Clusters are rows (v, u), never arrays: the cluster of the least
    node grows with its component, and as rows it is spread over all tasks. The least member is an algebraic
    aggregate (combined before the shuffle), and the join that sends it back is cut where a node is hot by the skew
    join of adaptive execution. A loop (u, u) makes a node of its own. Rows with a null end are ignored; no
    edges give an empty result. Each round is written to the shared folder, so lineage stays short, and the files of the round before are removed.
    """
    e = edges.filter("u is not null and v is not null").select("u", "v")
    clusters = materialize(
        e.union(e.select(F.col("v"), F.col("u"))).union(e.select("u", F.col("u"))).union(e.select("v", F.col("v"))).toDF(
            "v", "u"
        ).distinct()
    )
    size = _fingerprint(clusters)
    for _ in range(max_rounds):
        least = clusters.groupBy("v").agg(F.min("u").alias("m"))
        sent = clusters.join(least, "v").select(
            F.explode(
                F.array(
                    F.struct(F.col("m").alias("v"), F.col("u").alias("u")),
                    F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
                )
            ).alias("x")
        )
        after = materialize(sent.select("x.v", "x.u").distinct())
        discard(clusters)
        clusters = after
        now = _fingerprint(clusters)
        if now == size:
            return clusters.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
        size = now
    raise RuntimeError(f"hash-to-min did not settle in {max_rounds} rounds")


def _fingerprint(clusters: DataFrame) -> tuple:
    return tuple(clusters.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first())


def link_nodes(df: DataFrame, links: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Edges between the values that stand in one record. links: kind -> value; equal kinds share their values.

    A kind is the part of the name before a dot, so "fire.recorded" and "fire.tile" name the same nodes.
    Distinct edges are taken first: a value with a third of all records gives few of them.
    """
    nodes = {
        name: F.when(v.isNotNull(), F.concat(F.lit(name.split(".")[0] + ":"), v.cast("string")))
        for name, v in links.items()
    }
    first = F.coalesce(*nodes.values())
    pairs = df.select(F.explode(F.array(*[F.struct(first.alias("u"), n.alias("v")) for n in nodes.values()])).alias("x"))
    return pairs.select("x.u", "x.v").filter("u is not null and v is not null").distinct(), nodes


def with_component(df: DataFrame, links: dict[str, Column], alone: Column) -> DataFrame:
    """df with `component`, which takes the place of a column of that name; row count and other columns stay.

    A record without any link value is a component of its own, named by `alone`; repeated rows share theirs.
    """
    df = df.drop("component")
    edges, nodes = link_nodes(df, links)
    found = hash_to_min(edges)
    named = df.withColumn("__node", F.coalesce(*nodes.values()))
    joined = named.join(found.withColumnRenamed("node", "__node"), "__node", "left")
    return joined.withColumn("component", F.coalesce("component", F.concat(F.lit("alone:"), alone.cast("string")))).drop(
        "__node"
    )


def torn(df: DataFrame, links: dict[str, Column], mark: Column) -> DataFrame:
    """(component, node, mark): the marks of every node whose component holds more than one mark.

    Each value that stands in a record's links is a node, and so is (value, mark) of the record's first value that isn't
    null; records link them all. Components therefore gather the marks of all records that belong together, and a
    component with two different ones is torn. Records without a mark link their values only; those without any value
    take no part.
    """
    edges, nodes = link_nodes(df, links)
    first = F.coalesce(*nodes.values())
    marked = df.filter(first.isNotNull() & mark.isNotNull()).select(first.alias("value"), mark.cast("string").alias("mark")).distinct()
    marked = marked.withColumn("v", F.concat(F.lit("mark:"), F.to_json(F.struct("value", "mark"))))
    found = hash_to_min(edges.union(marked.select("value", "v")))
    marks = materialize(found.join(marked, F.col("node") == F.col("v")).select("component", F.col("value").alias("node"), "mark"))
    several = marks.groupBy("component").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).filter("a <> b")
    return marks.join(several.select("component"), "component", "left_semi")


def _unit(key: Column, split: str, seed: int) -> Column:
    """A number in (0, 1) from key, split and seed, the same on every machine."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(split), key), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def rendezvous(key: Column, weights: dict[str, Column], seed: int = 0) -> Column:
    """The split with the largest -weight / ln(u); a split is taken in proportion to its weight, none if all are 0."""
    scores = [
        F.struct(
            F.when(w > 0, -w / F.log(_unit(key, s, seed))).otherwise(F.lit(-1.0)).alias("score"), F.lit(s).alias("split")
        )
        for s, w in weights.items()
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["split"])


def _unit_py(spark, keys: list[str], splits: list[str], seed: int) -> dict[tuple[str, str], float]:
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = df.select("k", *[_unit(F.col("k"), s, seed).alias(s) for s in splits]).collect() if keys else []
    return {(r["k"], s): r[s] for r in rows for s in splits}


def assign_splits(components: DataFrame, shares: dict[str, float], seed: int = 0, periods: DataFrame | None = None) -> DataFrame:
    """components(component, stratum, n) with `split`, one per component.

    stratum is the component's main stratum and n its records. The few heavy components (at most 1 / HEAVY, so
    they may come to the driver) are placed largest first, each by rendezvous hashing weighted with what
    the splits still lack in total and in its stratum; a split that could not take it without passing its share
    has weight 0 unless none can. The rest is hashed in place, weighted by what remains to each split in
    the stratum, so shares hold overall and by stratum up to the spread of many small components.

    periods(component, period STRING, n) are the component's records by period, few in number: heavy components are then
    weighted also with what the splits lack in their periods, and the rest by stratum and main period.
    Sums by stratum and period come to the driver: MAX_STRATA strata at most, all smaller ones being balanced as one.
    """
    if not shares or min(shares.values()) < 0 or sum(shares.values()) <= 0:
        raise ValueError("shares must be positive")
    spark, total_share = components.sparkSession, sum(shares.values())
    shares = {s: w / total_share for s, w in shares.items()}
    if periods is not None:
        periods = materialize(periods)
        main = periods.groupBy("component").agg(F.max(F.struct("n", "period"))["period"].alias("period"))
        components = components.join(main, "component", "left")
    rows = materialize(components.withColumn("given", F.col("stratum")))
    largest = rows.groupBy("stratum").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), F.col("stratum").asc_nulls_first()).limit(MAX_STRATA + 1)
    if (most := largest.collect())[MAX_STRATA:]:
        # Every component keeps its records and its place in the result; only the balance of the smaller strata is one.
        apart = spark.createDataFrame([(r["stratum"],) for r in most[:MAX_STRATA]], "own string")
        both = rows.join(F.broadcast(apart), F.col("stratum").eqNullSafe(F.col("own")) & (F.col("stratum").isNotNull()), "left")
        rows = materialize(both.withColumn("stratum", F.coalesce("own", F.lit("all others"))).drop("own"))
    strata = rows.groupBy("stratum").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in strata)
    heavy = rows.filter(F.col("n") >= max(2.0, HEAVY * total)).collect() if total else []
    lack = {(r["stratum"], s): w * r["n"] for r in strata for s, w in shares.items()}
    whole = {s: w * total for s, w in shares.items()}
    spans: dict = {}
    lack_p: dict = {}
    if periods is not None:
        lack_p = {(r["period"], s): w * r["n"] for r in periods.groupBy("period").agg(F.sum("n").alias("n")).collect() for s, w in shares.items()}
        chosen = spark.createDataFrame([(r["component"],) for r in heavy], "component string")
        for r in periods.join(F.broadcast(chosen), "component", "left_semi").collect():
            spans.setdefault(r["component"], []).append((r["period"], r["n"]))
    u = _unit_py(spark, [r["component"] for r in heavy], list(shares), seed)
    placed = []
    for r in sorted(heavy, key=lambda r: (-r["n"], r["component"])):
        fits = [s for s in shares if whole[s] >= r["n"]]
        pool = fits or [max(shares, key=lambda s: whole[s])]
        near = [s for s in pool if lack[r["stratum"], s] >= r["n"]] or pool
        weight = {s: max(whole[s], 1e-9) * max(lack[r["stratum"], s], 1e-9) for s in near}
        if periods is not None:
            span = spans.get(r["component"], [])
            # The share of its records that their periods can take.
            takes = {s: sum(min(n, max(lack_p[p, s], 0.0)) for p, n in span) / r["n"] for s in near}
            weight = {s: weight[s] * max(takes[s], 1e-9) ** 2 for s in near}
        split = max(near, key=lambda s: (-weight[s] / math.log(u[r["component"], s]), s))
        whole[split] -= r["n"]
        lack[r["stratum"], split] -= r["n"]
        for p, n in spans.get(r["component"], []):
            lack_p[p, split] -= n
        placed.append((r["component"], split))
    left = {s: max(0.0, whole[s]) for s in shares}
    keys = ["stratum", "period"] if periods is not None else ["stratum"]
    cells = {tuple(r[k] for k in keys): float(r["n"]) for r in rows.groupBy(*keys).agg(F.sum("n").alias("n")).collect()}
    for r in heavy:
        cells[tuple(r[k] for k in keys)] -= r["n"]
    wanted = [lack, lack_p][: len(keys)]
    return _placed(rows, placed, keys, cells, _fit(cells, left, wanted), shares, seed)


def _placed(rows: DataFrame, placed: list, keys: list[str], cells: dict, weights: dict, shares: dict, seed: int) -> DataFrame:
    """rows with the splits of heavy components, and by rendezvous hashing with the weights of its cell for each of the rest."""
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(*k, *[float(weights[k, s]) for s in shares]) for k in cells],
        ", ".join([f"{k} string" for k in keys] + [f"`w_{s}` double" for s in shares]),
    )
    done = spark.createDataFrame(placed, "component string, placed string")
    split = rendezvous(F.col("component"), {s: F.col(f"w_{s}") for s in shares}, seed)
    least = F.lit(max(shares, key=shares.get))
    return (
        rows.join(F.broadcast(done), "component", "left")
        .join(table, reduce(and_, [rows[k].eqNullSafe(table[k]) for k in keys]), "left")
        .select(rows["component"], rows["given"].alias("stratum"), "n", F.coalesce("placed", split, least).alias("split"))
    )


def _fit(cells: dict[tuple, float], left: dict, lack: list[dict], rounds: int = 200) -> dict:
    """Weights by cell (stratum, or stratum and period) and split: raked in turn to what splits lack in each stratum, in each period and
    in all, and to the size of every cell."""
    if not cells:
        return {}
    splits = list(left)
    size = np.array(list(cells.values()))[:, None]
    whole = np.array([[left[s] for s in splits]])
    views = [(np.zeros(len(cells), dtype=int), whole)]
    for i, short in enumerate(lack):
        names = {c: j for j, c in enumerate(dict.fromkeys(c[i] for c in cells))}
        views.insert(i, (np.array([names[c[i]] for c in cells]), np.array([[max(0.0, short.get((name, s), 0.0)) for s in splits] for name in names])))
    w = np.tile(whole + 1e-6, (len(cells), 1))
    for _ in range(rounds):
        for at, wanted in views:
            have = np.zeros(wanted.shape)
            np.add.at(have, at, w)
            w = w * np.divide(wanted, have, out=np.zeros_like(have), where=have > 0)[at]
            got = w.sum(axis=1, keepdims=True)
            w = np.where(got > 0, w * np.divide(size, got, out=np.zeros_like(got), where=got > 0), whole)
    return {(c, s): float(w[i, j]) for i, c in enumerate(cells) for j, s in enumerate(splits)}
