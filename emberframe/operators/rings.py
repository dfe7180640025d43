"""Boxes against ring polygons in longitude and latitude, around the globe."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions import scalars as S


def round_bins(a: Column, b: Column, size: float) -> Column:
    """Numbers of the bins of longitude between a and b, b unwrapped, each once; bins of `size` degrees are counted around the globe."""
    n = int(360 / size)
    first = F.floor(a / size).cast("int")
    every = F.sequence(first, F.least(F.floor(b / size).cast("int"), first + (n - 1)))
    return F.explode(F.transform(every, lambda i: F.pmod(i, F.lit(n))))


def unwrapped_ring(ring: Column) -> Column:
    """Vertices ARRAY<STRUCT<x, y>> with each longitude moved to within 180 degrees of the one before.

    A ring that goes around a pole doesn't close that way; it is closed along the pole on the side of its mean latitude.
    """

    def step(done: Column, v: Column) -> Column:
        before = F.element_at(done, -1)["x"]
        d = v["x"] - before
        return F.concat(done, F.array(F.struct((before + d - 360.0 * F.floor((d + 180.0) / 360.0)).alias("x"), v["y"].cast("double").alias("y"))))

    start = F.struct(F.get(ring, F.lit(0))["x"].cast("double").alias("x"), F.get(ring, F.lit(0))["y"].cast("double").alias("y"))
    # The first vertex is walked to once more at the end, which shows whether the ring closes.
    walked = F.aggregate(F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), F.array(start), step)
    last = F.element_at(walked, -1)
    mean = F.aggregate(ring, F.lit(0.0), lambda s, v: s + v["y"])
    pole = F.when(mean >= 0, 90.0).otherwise(-90.0)
    cap = F.concat(walked, F.array(F.struct(last["x"].alias("x"), pole.alias("y")), F.struct(start["x"].alias("x"), pole.alias("y"))))
    return F.when(F.abs(last["x"] - start["x"]) > 180, cap).otherwise(walked)


def box_meets_ring(x0: Column, y0: Column, x1: Column, y1: Column, ring: Column) -> Column:
    """Whether a closed box and a polygon of unwrapped vertices share a point: an edge meets the box, or the box lies inside."""
    n = F.size(ring)

    def edge_meets(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        side = [(b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) for x in (x0, x1) for y in (y0, y1)]
        near = (F.least(a["x"], b["x"]) <= x1) & (F.greatest(a["x"], b["x"]) >= x0) & (F.least(a["y"], b["y"]) <= y1) & (F.greatest(a["y"], b["y"]) >= y0)
        return near & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)

    return F.exists(F.sequence(F.lit(0), n - 1), edge_meets) | S.in_polygon(x0, y0, ring)


def boxes_in_rings(boxes: DataFrame, rings: DataFrame, bin_deg: float = 30.0) -> DataFrame:
    """Distinct (fire_id, ring_id, day): boxes(fire_id, x0, y0, x1, y1, day) and rings(ring_id, day, ring) that meet on a day.

    x1 < x0 marks a box across the date line; a ring's edges go the short way around. Both sides name their bins of
    longitude, counted around the globe, which with the day are the key; the test on the polygon is exact in the plane
    of longitude and latitude. Rings of fewer than three vertices or with nulls among them have no area and meet nothing.
    """
    whole = (F.size("ring") >= 3) & F.forall("ring", lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    r = rings.filter(whole).select("ring_id", "day", unwrapped_ring(F.col("ring")).alias("ring"))
    of = lambda c: F.transform("ring", lambda v: v[c])
    bounds = {f"r{c}{i}": f(of(c)) for c in "xy" for i, f in enumerate((F.array_min, F.array_max))}
    r = r.withColumns(bounds)
    r = r.withColumn("bin", round_bins(F.col("rx0"), F.col("rx1"), bin_deg))
    east = F.when(F.col("x1") < F.col("x0"), F.col("x1") + 360.0).otherwise(F.col("x1"))
    b = boxes.withColumn("x1", east)
    b = b.select("*", round_bins(F.col("x0"), F.col("x1"), bin_deg).alias("bin"))
    turns = [k * 360.0 for k in range(-3, 4)]
    # The box is brought to the turns of the globe that the ring's vertices lie on; bounds are compared first, being cheap.
    near = lambda k: (F.col("x0") + k <= F.col("rx1")) & (F.col("x1") + k >= F.col("rx0"))
    some = (F.col("y0") <= F.col("ry1")) & (F.col("y1") >= F.col("ry0")) & reduce(or_, [near(F.lit(k)) for k in turns])
    exact = lambda k: near(k) & box_meets_ring(F.col("x0") + k, F.col("y0"), F.col("x1") + k, F.col("y1"), F.col("ring"))
    meets = F.exists(F.array(*map(F.lit, turns)), exact)
    return b.join(r, ["day", "bin"]).filter(some).filter(meets).select("fire_id", "ring_id", "day").distinct()


def overlapping_boxes(a: DataFrame, b: DataFrame, on: list[str], pad: float, size: int = 2) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1; x1 unwrapped) with equal `on` that come within `pad` degrees: the columns of a with suffix _a, of b with _b.

    An equi-join on `on` and bins of `size` degrees, counted around the globe, then the exact test; each pair is given
    once, by the bin in which the overlap of their padded rows and columns begins, so nothing is made distinct afterwards. Nulls meet nothing.
    """
    rows = lambda p: F.explode(F.sequence(F.floor((F.col("y0") - p) / size).cast("int"), F.floor((F.col("y1") + p) / size).cast("int")))
    left = a.withColumn("__bx", round_bins(F.col("x0") - pad, F.col("x1") + pad, size)).withColumn("__by", rows(pad))
    right = b.withColumn("__bx", round_bins(F.col("x0"), F.col("x1"), size)).withColumn("__by", rows(0))
    left = left.select("__bx", "__by", *[F.col(c).alias(f"{c}_a") for c in a.columns], *[F.col(c).alias(f"__on_{c}") for c in on])
    right = right.select("__bx", "__by", *[F.col(c).alias(f"{c}_b") for c in b.columns], *[F.col(c).alias(f"__on_{c}") for c in on])
    meet = " or ".join(f"x0_a + {k} <= x1_b + {pad} and x0_b <= x1_a + {k} + {pad}" for k in (-360, 0, 360))
    near = left.join(right, ["__bx", "__by", *[f"__on_{c}" for c in on]]).filter(f"y0_a <= y1_b + {pad} and y0_b <= y1_a + {pad} and ({meet})")
    # The first common row, and the first column of b (counted from its west edge) that is a column of a.
    first_row = F.floor(F.greatest(F.col("y0_a") - pad, F.col("y0_b")) / size).cast("int")
    n = int(360 / size)
    first_a, last_a = F.floor((F.col("x0_a") - pad) / size).cast("int"), F.floor((F.col("x1_a") + pad) / size).cast("int")
    first_b = F.floor(F.col("x0_b") / size).cast("int")
    # b's own first bin if a covers it, else a's first bin.
    covers = F.pmod(first_b - first_a, F.lit(n)) <= F.least(last_a - first_a, F.lit(n - 1))
    first_col = F.when(covers, F.pmod(first_b, F.lit(n))).otherwise(F.pmod(first_a, F.lit(n)))
    once = near.filter((F.col("__by") == first_row) & (F.col("__bx") == first_col))
    return once.select(*[f"{c}_a" for c in a.columns], *[f"{c}_b" for c in b.columns])


def rasterized(polygons: DataFrame, size: float) -> DataFrame:
    """(grid_row, grid_col, id): cells of `size` degrees whose centre lies in a polygon; where several do, the largest id.

    polygons(id, rings ARRAY<ARRAY<STRUCT<x, y>>>): any number of rings each, holes and parts alike, filled by the even-odd rule; rings may be
    open or closed, longitudes run from -180 to 180. Cells are counted from the north-west corner. Each edge names the rows whose
    centre line it crosses, and the crossings of a line, as many as the polygon has edges there at most, are paired in order: the
    cost is that of the cells filled and not of the bounding box. Null rings and rings of fewer than three points fill nothing.
    """
    ring = polygons.select("id", F.explode("rings").alias("r")).filter(F.size("r") >= 3)
    n = F.size("r")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("r", i).alias("a"), F.get("r", F.pmod(i + 1, n)).alias("b")))
    e = ring.select("id", F.explode(edges).alias("e")).select(
        "id", F.col("e.a.x").cast("double").alias("ax"), F.col("e.a.y").cast("double").alias("ay"), F.col("e.b.x").cast("double").alias("bx"), F.col("e.b.y").cast("double").alias("by")
    )
    line = lambda y: F.floor((90.0 - y) / size - 0.5)
    first, last = line(F.greatest("ay", "by")) + 1, line(F.least("ay", "by"))
    e = e.filter(F.col("ay").isNotNull() & F.col("by").isNotNull() & (first <= last)).withColumn("row", F.explode(F.sequence(first, last)))
    y = 90.0 - (F.col("row") + 0.5) * size
    at = (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    crossings = e.groupBy("id", "row").agg(F.array_sort(F.collect_list(at)).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", (i * 2).cast("int")).alias("a"), F.get("xs", (i * 2 + 1).cast("int")).alias("b")))
    s = crossings.filter(F.size("xs") >= 2).select("id", "row", F.explode(spans).alias("s"))
    column = lambda x: F.ceil((x + 180.0) / size - 0.5)
    a, b = column(F.col("s.a")), column(F.col("s.b")) - 1
    cells = s.filter(a <= b).select("id", "row", F.explode(F.sequence(a, b)).alias("col"))
    return cells.groupBy(F.col("row").cast("int").alias("grid_row"), F.col("col").cast("int").alias("grid_col")).agg(F.max("id").alias("id"))
