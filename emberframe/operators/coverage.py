"""Which event-days are observed: links of events and images, coverage of days, pairs of days, missing images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def modal_group(links: DataFrame, key: str, group: str) -> DataFrame:
    """(key, group, n): the most frequent group of each key, the smallest on ties; null groups don't count."""
    n = links.filter(F.col(group).isNotNull()).groupBy(key, group).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(key).agg(F.max(F.struct("n", (-F.col(group)).alias("g"))).alias("t"))
    return top.select(key, (-F.col("t.g")).alias(group), F.col("t.n").alias("n"))


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_images(links: DataFrame, fires: DataFrame, images: DataFrame, n: int) -> DataFrame:
    """The n images with most detections of each region, an image's region being that of most of its fires.

    links(fire_id, image_id), fires(fire_id, region_id), images(image_id, num_fire_pixels). Region 0 is none. Ranking
    keeps n rows per region in each map task before it shuffles.
    """
    of = modal_group(links.distinct().join(fires, "fire_id"), "image_id", "region_id").drop("n")
    r = of.filter("region_id > 0").join(images, "image_id")
    return ranked(r, ["region_id"], [F.col("num_fire_pixels").desc(), F.col("image_id")]).filter(F.col("rank") <= n)


def day_coverage(fi: DataFrame) -> DataFrame:
    """Per fire and day of fi(fire_id, day, downloaded): images, those at hand, whether any and whether all are."""
    d = F.coalesce(F.col("downloaded"), F.lit(False)).cast("int")
    return fi.groupBy("fire_id", "day").agg(F.count(F.lit(1)).alias("n_total"), F.sum(d).alias("n_downloaded")).withColumns(
        {"has_any": F.col("n_downloaded") > 0, "fully_covered": F.col("n_downloaded") == F.col("n_total")}
    )


def day_pairs(coverage: DataFrame) -> DataFrame:
    """(fire_id, day_t, t_full, t1_full, has_t, has_t1): days of a fire whose next day has images too.

    Both sides are keyed by (fire, day), so the join moves one row per fire-day, whatever a fire's length.
    """
    a = coverage.select("fire_id", F.col("day").alias("day_t"), F.col("fully_covered").alias("t_full"), F.col("has_any").alias("has_t"))
    b = coverage.select("fire_id", F.date_sub("day", 1).alias("day_t"), F.col("fully_covered").alias("t1_full"), F.col("has_any").alias("has_t1"))
    return a.join(b, ["fire_id", "day_t"])


def refreshed(pairs: DataFrame, coverage: DataFrame) -> DataFrame:
    """pairs(fire_id, day_t, ...) with t_full and t1_full taken from coverage; a day without images isn't full."""
    c = coverage.select("fire_id", "day", "fully_covered")
    out = pairs.drop("t_full", "t1_full").withColumn("day_t1", F.date_add("day_t", 1))
    for d, flag in (("day_t", "t_full"), ("day_t1", "t1_full")):
        out = out.join(c.select("fire_id", F.col("day").alias(d), F.col("fully_covered").alias(flag)), ["fire_id", d], "left")
    return out.withColumns({f: F.coalesce(f, F.lit(False)) for f in ("t_full", "t1_full")}).drop("day_t1")


def missing_images(pairs: DataFrame, fi: DataFrame) -> DataFrame:
    """Images that pairs need on day_t or the next day and that aren't at hand, each once."""
    t = pairs.select("fire_id", F.col("day_t").alias("day"))
    need = t.union(t.select("fire_id", F.date_add("day", 1))).distinct()
    lacking = fi.filter(~F.coalesce(F.col("downloaded"), F.lit(False)))
    return lacking.join(need, ["fire_id", "day"], "left_semi").select("image_id", "day").distinct()


def gap_images(pairs: DataFrame, fi: DataFrame) -> DataFrame:
    """Images of the next day for pairs that are seen on day_t and not on the next."""
    gaps = pairs.filter("has_t and not has_t1").select("fire_id", F.date_add("day_t", 1).alias("day"))
    return fi.join(gaps, ["fire_id", "day"], "left_semi").select("image_id", "day").distinct()


def tile_estimate(width_deg, height_deg, cell: float, crop: int = 224):
    """Tiles that a box needs: whole strides in both directions, at least one."""
    n = [F.greatest(F.lit(1), (x / cell / crop).cast("int")) for x in (width_deg, height_deg)]
    return n[0] * n[1]
