"""Queries of the general problems: a few keys with most rows, and points near points or regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators.curve import containing_region, near_pairs
from emberframe.operators.skew import fire_totals, heavy_keys
from emberframe.registry import CORE
from emberframe.session import materialize
from emberframe.tables import (
    COUNTING_SQL,
    FIRE_SQL,
    LON_SQL,
    counting,
    fire_by_right,
    latitude,
    longitude,
    table,
)

NEAR_KM = 2.0
HEAVY_SHARE = 0.01


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id", "dt"))
    return fire_totals(rows, table(spark, sf_dir, "fires").select("fire_id", "num_fire"))


_TOTALS_SQL = f"""
with s as (select fire_id, count(*) as n_samples, min(dt) as first_dt, max(dt) as last_dt from {COUNTING_SQL} group by 1),
f as (select fire_id, max(num_fire) as num_fire from fires where fire_id is not null group by 1)
select s.fire_id, n_samples, first_dt, last_dt, num_fire, n_samples / nullif(num_fire, 0) as samples_per_detection
from s left join f on s.fire_id = f.fire_id"""


@CORE.query("p2_fire_totals", _TOTALS_SQL)
def p2_fire_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


@CORE.query(
    "p2_found",
    f"""with s as (select fire_id, count(*) as n from {COUNTING_SQL} group by 1)
select fire_id from s where fire_id is not null and n >= 0.01 * (select count(distinct sample_id) from samples)""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(materialize(_totals(spark, sf_dir)), HEAVY_SHARE).select("fire_id")


def _located(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    rows = counting(
        table(spark, sf_dir, "samples").select(
            "sample_id", "load_order", "loaded_at", "fire_id", "tile_key", "lon", "lat", "dt", *more
        )
    )
    return rows.select("sample_id", fire_by_right().alias("fire"), "dt", latitude().alias("lat"), longitude().alias("lon"), *more)


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Located samples, and their places (dt, fire, lat, lon, place, n)."""
    rows = materialize(
        _located(spark, sf_dir).filter(
            "sample_id is not null and dt is not null and lat is not null and lon is not null and fire is not null"
        )
    )
    return rows, rows.groupBy("dt", "fire", "lat", "lon").agg(F.min("sample_id").alias("place"), F.count(F.lit(1)).alias("n"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id_a, sample_id_b, dt, km): nearby samples of different fires on one day, a < b.

    Samples with the same fire, day and coordinates are one place; places are joined, and only
    the places that have a partner are expanded to their samples. Rows without sample_id, dt,
    coordinates or fire take no part.
    """
    rows, places = _places(spark, sf_dir)
    pairs = near_pairs(places, NEAR_KM, ["dt"], "place", "fire")
    for side in "ab":
        mine = rows.select(
            "dt",
            F.col("fire").alias(f"differ_{side}"),
            F.col("lat").alias(f"lat_{side}"),
            F.col("lon").alias(f"lon_{side}"),
            F.col("sample_id").alias(f"id_{side}"),
        )
        pairs = pairs.join(mine, ["dt", f"differ_{side}", f"lat_{side}", f"lon_{side}"])
    return pairs.select(
        F.least("id_a", "id_b").alias("sample_id_a"), F.greatest("id_a", "id_b").alias("sample_id_b"), "dt", "km"
    )


_PLACED_SQL = f"""
select sample_id, {FIRE_SQL} as fire, {LON_SQL} as ln, lat, dt, xi, yi, split, source, region_id from {COUNTING_SQL}"""

_KM_SQL = (
    "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) "
    "* cos(radians(y.lat)) * pow(sin(radians(y.ln - x.ln) / 2), 2))))"
)


@CORE.query(
    "p5_found",
    f"""with p as ({_PLACED_SQL})
select x.sample_id as sample_id_a, y.sample_id as sample_id_b from p x join p y
on x.dt = y.dt and x.sample_id < y.sample_id and x.fire <> y.fire and abs(x.lat - y.lat) < 0.02
where {_KM_SQL} <= 2.0""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("sample_id_a", "sample_id_b")


@CORE.query(
    "p5_place_pairs",
    f"""with p as ({_PLACED_SQL}),
c as (select dt, fire, lat, ln, min(sample_id) as place, count(*) as n from p where sample_id is not null and fire is not null and lat is not null and ln is not null and dt is not null group by 1, 2, 3, 4)
select x.place as place_a, y.place as place_b, x.n as n_a, y.n as n_b, round({_KM_SQL}, 6) as km from c x join c y
on x.dt = y.dt and x.place < y.place and x.fire <> y.fire and abs(x.lat - y.lat) < 0.02 where {_KM_SQL} <= 2.0""",
)
def p5_place_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of places (samples of one fire, day and position, named by the least sample_id) with the number of samples of each; not expanded."""
    _, places = _places(spark, sf_dir)
    pairs = near_pairs(places, NEAR_KM, ["dt"], "place", "fire")
    n = lambda side: places.select(F.col("place").alias(f"place_{side}"), F.col("n").alias(f"n_{side}"))
    named = pairs.select(F.col("a").alias("place_a"), F.col("b").alias("place_b"), F.round("km", 6).alias("km"))
    return named.join(n("a"), "place_a").join(n("b"), "place_b").select("place_a", "place_b", "n_a", "n_b", "km")


@CORE.query(
    "p5_neighbours",
    f"""with p as ({_PLACED_SQL}),
q as (select x.sample_id as a, y.sample_id as b, {_KM_SQL} as km from p x join p y
on x.dt = y.dt and x.sample_id < y.sample_id and x.fire <> y.fire and abs(x.lat - y.lat) < 0.02)
select sample_id, count(*) as n_near, round(min(km), 6) as nearest_km from
(select a as sample_id, km from q where km <= 2.0 union all select b, km from q where km <= 2.0) group by 1""",
)
def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sample with neighbours of other fires, their number and the least distance."""
    near = _near(spark, sf_dir)
    ends = near.select(F.explode(F.array("sample_id_a", "sample_id_b")).alias("sample_id"), "km")
    return ends.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_near"), F.round(F.min("km"), 6).alias("nearest_km"))


@CORE.query(
    "p5_regions",
    f"""with p as ({_PLACED_SQL})
select sample_id, region_id, cast(cell_value as integer) as raster_region,
case when region_id is null or region_id <= 0 or cell_value is null then 'unknown'
when region_id = cell_value then 'agrees' else 'differs' end as verdict
from p left join (select * from raster where layer = 'region' and not isnan(cell_value)) r
on r.grid_row = floor((90 - lat) * 2) and r.grid_col = floor((ln + 180) * 2)
where lat is not null and ln is not null""",
)
def p5_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster region that holds each located sample beside the region it carries."""
    cells = table(spark, sf_dir, "raster").filter("layer = 'region' and not isnan(cell_value)")
    cells = cells.select("grid_row", "grid_col", F.col("cell_value").cast("int").alias("region"))
    points = _located(spark, sf_dir, "region_id").filter("lat is not null and lon is not null")
    verdict = (
        F.when(F.expr("region_id is null or region_id <= 0 or region is null"), "unknown")
        .when(F.expr("region_id = region"), "agrees")
        .otherwise("differs")
    )
    return containing_region(points, cells).select(
        "sample_id", "region_id", F.col("region").alias("raster_region"), verdict.alias("verdict")
    )
