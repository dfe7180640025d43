"""Scenes of samples as term-weight vectors, and the overlaps of their splits (problem 6)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.cosine import cosine_join
from emberframe.operators.curve import EARTH_KM, great_circle_km

#: Strong terms, most of a train vector (tile, place) and of an evaluation vector (3 days of the tile and of up to 4 cells).
TRAIN_TERMS, EVAL_TERMS = 2, 15
#: Weight of a weak term beside the strong one that implies it: the fire of a tile, the wider cell of a place.
WEAK = 0.3
#: Cells of a wider cell's side.
WIDE = 16
SCENE = ["fire", "xi", "yi", "lat", "lon", "dt"]


def scene_classes(rows: DataFrame) -> DataFrame:
    """rows (sample_id, side, fire, xi, yi, lat, lon, dt) -> one row per side and scene, named by its least sample_id."""
    return rows.groupBy("side", *SCENE).agg(F.min("sample_id").alias("scene"), F.count(F.lit(1)).alias("copies"))


def _cells(km: float) -> tuple[float, float]:
    """Cell height in degrees, four times the distance, and the distance in degrees."""
    deg = math.degrees(km / EARTH_KM)
    return 4 * deg, deg


def _cell(lat: Column, lon: Column, height: float) -> Column:
    """Row and column of the cell that holds a place.

    Rows are `height` high. All cells of a row are at least as wide, in degrees of its band of five degrees, as
    a disc of a quarter of that height needs to touch two of them at most; the last takes up what is left at the date
    line. Beyond 85 degrees a row is one cell.
    """
    row = F.floor(lat / height)
    band = F.floor(F.abs(row * height + height / 2) / 5.0)
    width = F.lit(height) / F.cos(F.radians(F.least(F.lit(85.0), (band + 1) * 5.0) + height))
    col = F.when(band >= 17, 0).otherwise(F.least(F.floor((lon + 180.0) / width), F.floor(360.0 / width) - 1))
    return F.struct(row.alias("row"), col.alias("col"))


def _term(kind: str, *c: Column) -> Column:
    return F.xxhash64(F.lit(kind), *c)


def _terms(scenes: DataFrame, cells: Column, days: int) -> DataFrame:
    """Vectors of scenes: on each day at most `days` away the tile and every cell, of weight 1, and their fire and wider cells, of weight WEAK.

    A strong term that two scenes share stands with its weak term in both. Terms repeated in a scene count once. The vectors have length 1, as of unit_vectors.
    """
    s = scenes.filter("dt is not null").select(F.col("scene").alias("id"), "fire", "xi", "yi", F.datediff("dt", F.lit("1970-01-01")).alias("day"), cells.alias("cells"))
    # Keys without the day first, so that places are encoded once however many days there are.
    has_tile = F.expr("fire is not null and xi is not null and yi is not null")
    tile = lambda k: F.when(has_tile, F.array(k)).otherwise(F.array().cast("array<bigint>"))
    strong = F.concat(tile(_term("t", F.col("fire"), F.col("xi"), F.col("yi"))), F.transform("cells", lambda c: _term("c", c["row"], c["col"])))
    weak = F.concat(tile(_term("f", F.col("fire"))), F.transform("cells", lambda c: _term("w", F.floor(c["row"] / WIDE), F.floor(c["col"] / WIDE))))
    k = s.select("id", "day", F.array_distinct(strong).alias("strong"), F.array_distinct(weak).alias("weak"))
    # The terms of a scene stand in one row and differ, so the vector's length is known before they are spread: no shuffle.
    norm = F.sqrt((2 * days + 1) * (F.size("strong") + F.lit(WEAK * WEAK) * F.size("weak")))
    keys = F.transform("strong", lambda x: F.struct(x.alias("key"), (1.0 / F.col("norm")).alias("weight")))
    light = F.transform("weak", lambda x: F.struct(x.alias("key"), (F.lit(WEAK) / F.col("norm")).alias("weight")))
    k = k.withColumn("norm", norm).select("id", "day", F.explode(F.concat(keys, light)).alias("k"))
    near = F.explode(F.sequence(F.col("day") - days, F.col("day") + days)) if days else F.col("day")
    return k.select("id", "k.*", near.alias("on")).select("id", _term("d", F.col("key"), F.col("on")).alias("term"), "weight")


def train_vectors(scenes: DataFrame, km: float) -> DataFrame:
    """A train scene's terms: its tile, the cell of its place, its fire and the wider cell, on its day."""
    height, _ = _cells(km)
    place = F.when(F.expr("lat is not null and lon is not null"), F.array(_cell(F.col("lat"), F.col("lon"), height)))
    return _terms(scenes, F.coalesce(place, F.array().cast("array<struct<row:bigint,col:bigint>>")), 0)


def eval_vectors(scenes: DataFrame, km: float, days: int) -> DataFrame:
    """An evaluation scene's terms: those of its tile and of every cell its disc touches, on each day at most `days` away."""
    height, deg = _cells(km)
    deg *= 1 + 1e-6
    half = F.lit(deg) / F.cos(F.radians(F.least(F.lit(89.9), F.abs("lat") + deg)))
    # The disc's box spans two rows and in each two columns at most, so its corners name all cells that it can touch.
    corners = []
    for a in (-1, 1):
        la = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat") + a * deg))
        for b in (-1, 0, 1):
            x = F.col("lon") + b * half
            x = F.when(x < -180, x + 360.0).when(x >= 180, x - 360.0).otherwise(x)
            corners.append(_cell(la, x, height))
    cells = F.when(F.expr("lat is not null and lon is not null"), F.array_distinct(F.array(*corners)))
    return _terms(scenes, F.coalesce(cells, F.array().cast("array<struct<row:bigint,col:bigint>>")), days)


def overlaps(classes: DataFrame, km: float, days: int) -> DataFrame:
    """(train_scene, eval_scene, cosine, km): scenes of train and of val or test that are the same or near.

    Scenes count as overlapping if their days are at most `days` apart and they show the same tile or lie at most
    km apart. Any such pair shares a strong term and the weak one that it implies. With s strong terms a vector has at most s weak
    ones, so that pair's cosine is at least (1 + WEAK**2) / sqrt(TRAIN_TERMS * (1 + WEAK**2) * EVAL_TERMS * (1 + WEAK**2)), which
    is 1 / sqrt(TRAIN_TERMS * EVAL_TERMS): the join at this threshold loses none. Weak terms alone
    stay below it, so the long lists of a fire and of a wider cell on a day are pruned and only add to
    the dot product of a candidate. An exact test follows. Parts that are null match nothing.
    """
    train = classes.filter("side = 'train'")
    others = classes.filter("side = 'eval'")
    threshold = 1.0 / math.sqrt(TRAIN_TERMS * EVAL_TERMS)
    found = cosine_join(eval_vectors(others, km, days), train_vectors(train, km), threshold)
    a = train.select(F.col("scene").alias("right_id"), *[F.col(c).alias(f"{c}_a") for c in SCENE])
    b = others.select(F.col("scene").alias("left_id"), *[F.col(c).alias(f"{c}_b") for c in SCENE])
    dist = great_circle_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    same = F.coalesce(F.expr("fire_a = fire_b and xi_a = xi_b and yi_a = yi_b"), F.lit(False))
    return (
        found.join(a, "right_id").join(b, "left_id").withColumn("km", dist)
        .filter(F.abs(F.datediff("dt_a", "dt_b")) <= days)
        .filter(same | F.coalesce(F.col("km") <= km, F.lit(False)))
        .select(F.col("right_id").alias("train_scene"), F.col("left_id").alias("eval_scene"), "cosine", "km")
    )


def members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with `scene`, the class that each belongs to, in place of a column of that name; nulls match nulls."""
    rows = rows.drop("scene")
    keys = ["side", *SCENE]
    c = classes.select(*[F.col(k).alias(f"__{k}") for k in keys], "scene")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(c, on).drop(*[f"__{k}" for k in keys])
