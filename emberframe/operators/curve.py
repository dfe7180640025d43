"""Space-filling-curve cells over the globe, covers of discs and regions, range joins (problem 5).

The grid is cut into half-degree cells, rows from the north pole and columns from 180 W, each of them
2**FINE x 2**FINE times. A code interleaves the bits of row and column, so that a cell of any
coarser level is one range of codes, and of a rectangle the least and largest code stand at its
north-west and south-east corner.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
FINE = 16
ROWS, COLS = 360 << FINE, 720 << FINE


def _spread(x: Column) -> Column:
    """The bits of x (0 <= x < 2**32) with a gap behind each: its binary digits read in base 4.

    Two calls in place of a chain of shifts and masks, which would make methods too large for the JVM to compile.
    """
    return F.conv(F.bin(x), 4, 10).cast("bigint")


def morton(row: Column, col: Column) -> Column:
    """Row and column (below 2**32, BIGINT) as one code on the Z curve."""
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))


def grid_row(lat: Column, level: int = FINE) -> Column:
    """Row of a latitude when half a degree is cut 2**level times; the south pole lies in the last row."""
    n = 2.0 * (1 << level)
    return F.least(F.floor((90.0 - lat) * n), F.lit((360 << level) - 1)).cast("bigint")


def grid_col(lon: Column, level: int = FINE) -> Column:
    return F.floor((lon + 180.0) * (2.0 * (1 << level))).cast("bigint")


def point_code(lat: Column, lon: Column) -> Column:
    return morton(grid_row(lat), grid_col(lon))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a sphere of radius EARTH_KM (haversine)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def disc_level(radius_km: float) -> int:
    """The finest level whose cells are at least as high as the radius (0 if none is)."""
    deg = math.degrees(radius_km / EARTH_KM)
    return max(0, min(FINE, int(math.floor(math.log2(0.5 / deg))))) if deg > 0 else FINE


def disc_ranges(df: DataFrame, lat: str, lon: str, radius_km: float) -> DataFrame:
    """df once per bucket that the disc around (lat, lon) touches, with bucket, lo and hi.

    A bucket is a cell one level above disc_level; lo and hi are the least and largest code of
    the disc's bounding rectangle within it. The rectangle allows for the meridians' convergence,
    wraps at the date line and spans all columns where the disc holds a pole.
    """
    k = max(0, disc_level(radius_km) - 1)
    side, last = 1 << (FINE - k), COLS
    r = radius_km / EARTH_KM * (1 + 1e-9) + 1e-12
    deg = math.degrees(r)
    la, lo = F.col(lat), F.col(lon)
    polar = F.abs(la) + deg >= 90.0
    half = F.when(polar, 180.0).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(r)) / F.cos(F.radians(la))))) + 1e-9
    )
    n = 2.0 * (1 << FINE)
    box = df.withColumns(
        {
            "__r0": grid_row(F.least(F.lit(90.0), la + deg)),
            "__r1": grid_row(F.greatest(F.lit(-90.0), la - deg)),
            "__c0": F.when(polar, 0).otherwise(F.floor((lo - half + 180.0) * n)).cast("bigint"),
            "__c1": F.when(polar, last - 1).otherwise(F.floor((lo + half + 180.0) * n)).cast("bigint"),
        }
    )
    box = box.withColumn("__br", F.explode(F.sequence(F.expr(f"__r0 div {side}"), F.expr(f"__r1 div {side}"))))
    box = box.withColumn(
        "__bc",
        F.explode(
            F.sequence(F.floor(F.col("__c0") / side).cast("bigint"), F.floor(F.col("__c1") / side).cast("bigint"))
        ),
    )
    turn = (F.floor(F.col("__bc") * side / last) * last).cast("bigint")
    box = box.withColumns(
        {
            "__r0": F.greatest("__r0", F.col("__br") * side),
            "__r1": F.least("__r1", F.col("__br") * side + (side - 1)),
            "__c0": F.greatest("__c0", F.col("__bc") * side) - turn,
            "__c1": F.least("__c1", F.col("__bc") * side + (side - 1)) - turn,
        }
    )
    return box.withColumns(
        {"lo": morton(F.col("__r0"), F.col("__c0")), "hi": morton(F.col("__r1"), F.col("__c1"))}
    ).withColumn("bucket", F.shiftright("lo", 2 * (FINE - k))).drop("__r0", "__r1", "__c0", "__c1", "__br", "__bc")


def bucket_of(code: Column, radius_km: float) -> Column:
    return F.shiftright(code, 2 * (FINE - max(0, disc_level(radius_km) - 1)))


def near_pairs(places: DataFrame, radius_km: float, on: list[str], ident: str, differ: str) -> DataFrame:
    """Pairs of places with equal `on`, different `differ` and at most radius_km apart, a < b by ident.

    The result has on, a and b (ident), km and lat, lon and differ of both, with suffix _a and _b.

    places has ident (unique), lat, lon, differ and the columns of on. Each disc is covered by
    code ranges, ranges and codes meet in a sort-merge join on (on, bucket) whose residual
    condition is the range test, and the great-circle distance decides. Places without
    coordinates take no part. A hot bucket is cut by the skew join of adaptive execution.
    """
    located = places.filter("lat is not null and lon is not null")
    pts = located.withColumn("code", point_code(F.col("lat"), F.col("lon"))).select(
        *on,
        bucket_of(F.col("code"), radius_km).alias("bucket"),
        "code",
        F.col(ident).alias("b"),
        F.col("lat").alias("lat_b"),
        F.col("lon").alias("lon_b"),
        F.col(differ).alias("differ_b"),
    )
    discs = disc_ranges(located.select(*on, ident, "lat", "lon", differ), "lat", "lon", radius_km).select(
        *on, "bucket", "lo", "hi", F.col(ident).alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"),
        F.col(differ).alias("differ_a"),
    )
    km = great_circle_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return (
        discs.join(pts, [*on, "bucket"])
        .filter("code between lo and hi and a < b and differ_a <> differ_b")
        .withColumn("km", km)
        .filter(F.col("km") <= radius_km)
        .select(*on, "a", "b", "km", "lat_a", "lon_a", "differ_a", "lat_b", "lon_b", "differ_b")
    )


REGION_LEVEL = 3


def region_ranges(cells: DataFrame) -> DataFrame:
    """Cells (grid_row, grid_col, region) as (bucket, lo, hi, region): runs of neighbouring half-degree codes.

    Runs end where the code jumps, the region changes or a bucket of 2**REGION_LEVEL half-degree cells
    a side ends. Cells without a region are left out; of a repeated cell the smallest region counts.
    """
    one = (
        cells.filter("grid_row is not null and grid_col is not null and region is not null")
        .groupBy("grid_row", "grid_col")
        .agg(F.min("region").alias("region"))
        .withColumn("c", morton(F.col("grid_row").cast("bigint"), F.col("grid_col").cast("bigint")))
        .withColumn("bucket", F.shiftright("c", 2 * REGION_LEVEL))
    )
    w = Window.partitionBy("bucket").orderBy("c")
    new = F.coalesce((F.lag("c").over(w) + 1 != F.col("c")) | (F.lag("region").over(w) != F.col("region")), F.lit(True))
    runs = one.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("bucket", "run", "region").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).drop("run")


def containing_region(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (lat, lon) with `region`, in place of such a column: that of the half-degree cell that holds them, null if none does.

    Points without coordinates are kept with a null region.
    """
    points = points.drop("region")
    c = morton(grid_row(F.col("lat"), 0), grid_col(F.col("lon"), 0))
    coded = points.withColumn("__c", c).withColumn("__bucket", F.shiftright("__c", 2 * REGION_LEVEL))
    ranges = region_ranges(cells).withColumnRenamed("bucket", "__bucket")
    hit = (F.col("p.__bucket") == F.col("r.__bucket")) & F.col("p.__c").between(F.col("r.lo"), F.col("r.hi"))
    return coded.alias("p").join(ranges.alias("r"), hit, "left").select(*[f"p.{x}" for x in points.columns], "r.region")
