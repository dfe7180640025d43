"""Rasters as rows (keys, row, col, value): projection, filling, resampling, morphology, hulls, tiling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import materialize, shuffled


def window(radius: int) -> Column:
    """Offsets (i, j, d2) of a square window, to be exploded."""
    r = range(-radius, radius + 1)
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * i + j * j).alias("d2")) for i in r for j in r]))


def project(points: DataFrame, keys: list[str], radius: int, how: str) -> DataFrame:
    """Points (keys, y, x, value, src), y and x in cells, onto the cells within `radius` of each.

    how: nearest (ties to the smaller src), inv_dist (weights 1 / distance, exact hits alone), max. Every contribution
    is an algebraic aggregate, so cells need no neighbours at hand and blocks have no borders.
    """
    p = points.select(*keys, "value", "src", "y", "x", window(radius).alias("o"))
    p = p.withColumns({"row": F.floor("y").cast("int") + F.col("o.i"), "col": F.floor("x").cast("int") + F.col("o.j")})
    d = F.sqrt(F.pow(F.col("row") + 0.5 - F.col("y"), 2) + F.pow(F.col("col") + 0.5 - F.col("x"), 2))
    g = p.withColumn("d", d).groupBy(*keys, "row", "col")
    if how == "max":
        return g.agg(F.max("value").alias("value"))
    if how == "nearest":
        return g.agg(F.min(F.struct("d", "src", "value")).alias("t")).select(*keys, "row", "col", F.col("t.value").alias("value"))
    w = 1.0 / F.greatest(F.col("d"), F.lit(1e-9))
    return g.agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))


#: Cells a side of the blocks in which cells meet those around them.
BLOCK = 64


def in_block(margin: int = 0) -> Column:
    """Whether (row, col) lies in the block (br, bc) or within margin of it."""
    side = lambda c, b: F.col(c).between(F.col(b) * BLOCK - margin, F.col(b) * BLOCK + (BLOCK - 1 + margin))
    return side("row", "br") & side("col", "bc")


def in_blocks(cells: DataFrame, keys: list[str], reach: int, row: Column, col: Column) -> DataFrame:
    """cells partitioned by keys and block (br, bc), in every block that is within reach of their place: to group by these and more takes no other shuffle."""
    blocks = lambda c: F.explode(F.sequence(F.floor((c - reach) / BLOCK), F.floor((c + reach) / BLOCK)))
    return cells.select("*", blocks(row).alias("br")).select("*", blocks(col).alias("bc")).repartition(*keys, "br", "bc")


def _around(cells: DataFrame, keys: list[str], radius: int, columns: list[str], margin: int = 0) -> DataFrame:
    """cells(keys, row, col) at every cell (row, col) within radius, with their own place (r, c), d2, `columns`, and the block (br, bc).

    Rows are partitioned by keys and block before they are multiplied, and no raster is a single task. (row, col) lies in
    the block or within margin of it.
    """
    b = cells.select(*keys, F.col("row").alias("r"), F.col("col").alias("c"), *columns)
    b = in_blocks(b, keys, radius + margin, F.col("r"), F.col("c"))
    at = b.select("*", window(radius).alias("o")).select(
        *keys, "br", "bc", "r", "c", (F.col("r") + F.col("o.i")).alias("row"), (F.col("c") + F.col("o.j")).alias("col"), F.col("o.d2").alias("d2"), *columns
    )
    return at.filter(in_block(margin))


def _nearness(radius: int) -> Column:
    """A number that orders what _around gives for one place by d2, r and c, as a struct of them would, but is summed up without sorting."""
    side = 2 * radius + 1
    return (F.col("d2") * side + F.col("r") - F.col("row") + radius) * side + F.col("c") - F.col("col") + radius


def fill_holes(cells: DataFrame, grid: DataFrame, keys: list[str], radius: int, how: str = "nearest") -> DataFrame:
    """Cells of grid(keys, row, col) that cells, each given once, lacks, from those within radius; what has none near stays out.

    Every cell is sent to the cells around it; one that is sent to itself is no hole. So the cost is that of the
    cells and not of the holes, of which a sparse grid has many times more.
    """
    g = _around(cells, keys, radius, ["value"]).groupBy(*keys, "br", "bc", "row", "col")
    if how == "nearest":
        v = g.agg(F.min_by("value", _nearness(radius)).alias("value"), F.min("d2").alias("d2"))
    else:
        w = F.when(F.col("d2") > 0, 1.0 / F.sqrt(F.col("d2").cast("double")))
        v = g.agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"), F.min("d2").alias("d2"))
    return v.filter("d2 > 0").select(*keys, "row", "col", "value").join(shuffled(grid), [*keys, "row", "col"], "left_semi")


def closing(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """3 x 3 closing of cells (keys, row, col, id), each given once, joined to the originals; new cells get the id of the nearest original.

    Outside the grid counts as empty, so cells on its border never survive the erosion. Both steps run in blocks with the margin that
    they need: cells are shuffled once, before they are multiplied.
    """
    near = _around(cells, keys, 1, ["id"], 1)
    inside = (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)
    grown = near.filter(inside).groupBy(*keys, "br", "bc", "row", "col").agg(F.min_by("id", _nearness(1)).alias("id"), F.min("d2").alias("d2"))
    own = F.col("o.d2") == 0
    at = grown.select("*", window(1).alias("o")).select(
        *keys, "br", "bc", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.when(own, F.col("id")).alias("id"), F.when(own, F.col("d2")).alias("d2"),
    ).filter(in_block())
    kept = at.groupBy(*keys, "br", "bc", "row", "col").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"), F.max("d2").alias("d2"))
    return cells.select(*keys, "row", "col", "id").union(kept.filter("n = 9 and d2 > 0").select(*keys, "row", "col", "id"))


def ring(cells: DataFrame, keys: list[str], radius: int, height: int, width: int) -> DataFrame:
    """What dilation by a disk adds to cells."""
    from emberframe.operators.scoring import dilate

    return dilate(cells, keys, radius, height, width).join(cells, [*keys, "row", "col"], "left_anti")


def upsample_bilinear(cells: DataFrame, keys: list[str], factor: int, height: int, width: int) -> DataFrame:
    """Every cell of a grid `factor` times as fine, by half-pixel centres with the source index clamped at the edges.

    A source cell is sent to the fine cells it weighs on; their weighted sum is algebraic.
    """
    fine = F.explode(F.sequence(F.lit(-factor), F.lit(2 * factor - 1)))
    p = cells.select(*keys, "row", "col", "value", fine.alias("i")).select("*", fine.alias("j"))

    def axis(base: str, off: str, n: int) -> tuple[Column, Column]:
        """The fine index, and the weight of source `base` on it."""
        at = F.col(base) * factor + F.col(off)
        s = F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (at + 0.5) / factor - 0.5))
        return at, F.greatest(F.lit(0.0), 1.0 - F.abs(s - F.col(base)))

    (r, wr), (c, wc) = axis("row", "i", height), axis("col", "j", width)
    p = p.select(*keys, r.alias("r"), c.alias("c"), (wr * wc).alias("w"), "value")
    ok = (F.col("w") > 0) & (F.col("r") >= 0) & (F.col("r") < height * factor) & (F.col("c") >= 0) & (F.col("c") < width * factor)
    return p.filter(ok).groupBy(*keys, F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def upsample_nearest(cells: DataFrame, keys: list[str], factor: int) -> DataFrame:
    fine = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    p = cells.select(*keys, "row", "col", "value", fine.alias("i")).select("*", fine.alias("j"))
    return p.select(*keys, (F.col("row") * factor + F.col("i")).alias("row"), (F.col("col") * factor + F.col("j")).alias("col"), "value")


def max_pool(cells: DataFrame, keys: list[str], radius: int = 1) -> DataFrame:
    """The largest value within a square window, for every cell that has one."""
    p = cells.select(*keys, "value", (F.col("row")).alias("r"), F.col("col").alias("c"), window(radius).alias("o"))
    p = p.select(*keys, (F.col("r") + F.col("o.i")).alias("row"), (F.col("c") + F.col("o.j")).alias("col"), "value")
    return p.groupBy(*keys, "row", "col").agg(F.max("value").alias("value"))


def block_mode(cells: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Most frequent value of blocks of size x size cells, the smallest on ties."""
    b = cells.filter("value is not null").groupBy(*keys, F.floor(F.col("row") / size).cast("int").alias("row"), F.floor(F.col("col") / size).cast("int").alias("col"), "value").count()
    return b.groupBy(*keys, "row", "col").agg(F.max(F.struct("count", (-F.col("value")).alias("v"))).alias("t")).select(*keys, "row", "col", (-F.col("t.v")).alias("value"))


def block_mean(cells: DataFrame, keys: list[str], size: int) -> DataFrame:
    return cells.groupBy(*keys, F.floor(F.col("row") / size).cast("int").alias("row"), F.floor(F.col("col") / size).cast("int").alias("col")).agg(F.avg("value").alias("value"))


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of (n, 2) points by a monotone chain; 0 for fewer than three or collinear ones."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return 0.0

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    h = np.array(chain(p) + chain(p[::-1]))
    x, y = h[:, 0], h[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def solidity(cells: DataFrame, key: str) -> DataFrame:
    """(key, num_pixels, hull_area, solidity): cells over the area of the hull of their centres; 1 where it has none.

    Only extreme cells can be corners of a hull, so per key each row sends its two outermost cells: the Python
    step sees at most twice the patch's height, whatever the number of its cells.
    """
    d = cells.select(key, "row", "col").distinct()
    rows = d.groupBy(key, "row").agg(F.min("col").alias("a"), F.max("col").alias("b"), F.count(F.lit(1)).alias("n"))

    def hull(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pts = np.vstack([pdf[["row", "a"]].to_numpy(float), pdf[["row", "b"]].to_numpy(float)])
        area, n = hull_area(pts), int(pdf["n"].sum())
        return pd.DataFrame({key: [k[0]], "num_pixels": [n], "hull_area": [area], "solidity": [n / area if area > 0 else 1.0]})

    kind = dict(cells.dtypes)[key]
    return rows.groupBy(key).applyInPandas(hull, f"{key} {kind}, num_pixels long, hull_area double, solidity double")


def tiles(boxes: DataFrame, keys: list[str], size: int = 256, stride: int = 224, padding: int = 16) -> DataFrame:
    """Tile origins over padded boxes (keys, x0, y0, x1, y1): windows of `size` every `stride`."""
    nx = F.greatest(F.lit(1), F.ceil((F.col("x1") - F.col("x0") + 1 + 2 * padding - (size - stride)) / stride)).cast("int")
    ny = F.greatest(F.lit(1), F.ceil((F.col("y1") - F.col("y0") + 1 + 2 * padding - (size - stride)) / stride)).cast("int")
    t = boxes.select("*", F.explode(F.sequence(F.lit(0), nx - 1)).alias("xi")).select("*", F.explode(F.sequence(F.lit(0), ny - 1)).alias("yi"))
    return t.select(*keys, "xi", "yi", (F.col("x0") - padding + F.col("xi") * stride).alias("tx"), (F.col("y0") - padding + F.col("yi") * stride).alias("ty"))


def _predecessors(asks: DataFrame, first: DataFrame, key: str, reach: int) -> DataFrame:
    """(key, x, y, t, d2) of asks that have an earlier cell of their key within reach, the nearest one's squared distance."""
    b = lambda c: F.floor(F.col(c) / reach).cast("int")
    hosts = first.select(key, b("x").alias("bx"), b("y").alias("by"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("t").alias("pt"))
    a = asks.withColumn("o", window(1)).select(key, "x", "y", "t", (b("x") + F.col("o.i")).alias("bx"), (b("y") + F.col("o.j")).alias("by"))
    d2 = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    hit = a.join(shuffled(hosts), [key, "bx", "by"]).filter("pt < t").withColumn("d2", d2).filter(F.col("d2") <= reach * reach)
    return hit.groupBy(key, "x", "y", "t").agg(F.min("d2").alias("d2"))


def nearest_predecessor(cells: DataFrame, key: str, reach: int = 8) -> DataFrame:
    """(key, x, y, t, d2): squared distance of each cell to the nearest cell of its key that was seen earlier.

    Cells on the first day of their key are left out. Cells meet in blocks of reach x reach; those that found nothing
    look again in blocks eight times as large, where by then few are left, until all have found one.
    """
    first = materialize(cells.filter(F.col(key).isNotNull()).groupBy(key, "x", "y").agg(F.min("t").alias("t")))
    start = first.groupBy(key).agg(F.min("t").alias("t0"))
    asks = materialize(first.join(shuffled(start), key).filter("t > t0").drop("t0"))
    out = None
    while not asks.isEmpty():
        got = materialize(_predecessors(asks, first, key, reach))
        out = got if out is None else out.union(got)
        asks = materialize(asks.join(shuffled(got), [key, "x", "y"], "left_anti"))
        reach *= 8
    return out if out is not None else asks.withColumn("d2", F.lit(0.0))


def spread(cells: DataFrame, key: str, reach: int = 3) -> DataFrame:
    """Coherence of spread per key: share of later cells with a predecessor within `reach`, days with a new ignition,
    mean and largest distance; a key with one day only is coherent."""
    close = F.col("d2") <= reach * reach
    s = nearest_predecessor(cells, key).groupBy(key).agg(
        F.avg(close.cast("double")).alias("spread_ratio"), F.countDistinct(F.when(~close, F.col("t"))).alias("n_new_ignitions"),
        F.avg(F.sqrt("d2")).alias("mean_spread_dist"), F.max(F.sqrt("d2")).alias("max_spread_dist"),
    )
    every = cells.filter(F.col(key).isNotNull()).select(key).distinct().join(shuffled(s), key, "left")
    return every.select(
        key, F.coalesce(F.round("spread_ratio", 4), F.lit(1.0)).alias("spread_ratio"), F.coalesce("n_new_ignitions", F.lit(0)).alias("n_new_ignitions"),
        F.coalesce(F.round("mean_spread_dist", 2), F.lit(0.0)).alias("mean_spread_dist"), F.coalesce(F.round("max_spread_dist", 2), F.lit(0.0)).alias("max_spread_dist"),
    )
