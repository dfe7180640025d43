"""Reading the input tables, and the cleaning rules that every query shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counting(samples: DataFrame) -> DataFrame:
    """The rows of samples that count: of one sample_id the one loaded last, once.

    Ties in loaded_at go to the larger load_order; a null loaded_at is older than any
    other. A row without sample_id cannot be told to be a resend and counts by itself.
    The limit of one row per key is applied before the shuffle as well, so a key that
    was resent very often costs one row per input split.
    """
    w = Window.partitionBy("sample_id", F.when(F.col("sample_id").isNull(), F.col("load_order"))).orderBy(
        F.col("loaded_at").desc_nulls_last(), F.col("load_order").desc_nulls_last()
    )
    return samples.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def fire_by_right() -> Column:
    """fire_id or, where it is null, the first number in tile_key; null where neither is there."""
    return F.expr("coalesce(fire_id, try_cast(nullif(regexp_extract(tile_key, '([0-9]+)', 1), '') as int))")


def split_meaning(name: str = "split") -> Column:
    """train, val or test, however the split is written; anything else is null."""
    s = F.lower(F.trim(F.col(name)))
    return (
        F.when(s.startswith("train"), "train").when(s.startswith("val"), "val").when(s.startswith("test"), "test")
    )


def longitude(name: str = "lon") -> Column:
    """Longitude brought into [-180, 180); NaN and infinities become null."""
    x = F.col(name)
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e6)
    folded = x - 360.0 * F.floor((x + 180.0) / 360.0)
    return F.when(ok, F.when((x >= -180) & (x < 180), x).otherwise(folded))


def latitude(name: str = "lat") -> Column:
    """Latitude, null where it isn't a number between -90 and 90."""
    x = F.col(name)
    return F.when(~F.isnan(x) & (F.abs(x) <= 90), x)


def unwrapped_east(west: str = "min_x", east: str = "max_x") -> Column:
    """The eastern edge of a box, beyond 180 where the box crosses the date line."""
    return F.when(F.col(east) < F.col(west), F.col(east) + 360).otherwise(F.col(east))


#: SQL of the same rules, for the checking engine.
COUNTING_SQL = (
    "(select * from (select *, row_number() over (partition by sample_id order by loaded_at desc nulls last, "
    "load_order desc) as rn from samples) where rn = 1)"
)
FIRE_SQL = "coalesce(fire_id, try_cast(nullif(regexp_extract(tile_key, '([0-9]+)', 1), '') as integer))"
SPLIT_SQL = (
    "case when lower(trim(split)) like 'train%' then 'train' when lower(trim(split)) like 'val%' then 'val' "
    "when lower(trim(split)) like 'test%' then 'test' end"
)
LON_SQL = "case when lon >= -180 and lon < 180 then lon else lon - 360.0 * floor((lon + 180.0) / 360.0) end"
EAST_SQL = "case when max_x < min_x then max_x + 360 else max_x end"
