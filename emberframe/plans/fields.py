"""Fields, lookups and filters that build the inputs of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import scalars as S
from emberframe.operators import raster as R
from emberframe.operators import scoring
from emberframe.plans.scalars import FIRE_TYPES_SQL, covered_fires
from emberframe.registry import CORE
from emberframe.tables import COUNTING_SQL, LON_SQL, counting, latitude, longitude, table


def field_pipeline(cells: DataFrame, stats: DataFrame, factor: int, height: int, width: int, missing: float = 0.0) -> DataFrame:
    """cells(sample_id, channel, row, col, value) normalised by stats(channel, mean, std) and set on a grid `factor` times as fine.

    Not-a-number values become `missing` first; a channel without statistics stays as it is.
    """
    clean = cells.withColumn("value", F.when(F.col("value").isNull() | F.isnan("value"), missing).otherwise(F.col("value")))
    z = clean.join(F.broadcast(stats), "channel", "left") if stats.limit(100_001).count() <= 100_000 else clean.join(stats, "channel", "left")
    z = z.withColumn("value", F.coalesce((F.col("value") - F.col("mean")) / F.greatest("std", F.lit(1e-6)), F.col("value")))
    return R.upsample_bilinear(z.drop("mean", "std"), ["sample_id", "channel"], factor, height, width)


@CORE.query(
    "r13_field_pipeline",
    """with s as (select user_id as p, event_type as ch, floor(value / 62)::integer as r, (event_id % 8)::integer as k, max(value) as v from events group by 1, 2, 3, 4),
st as (select ch, avg(v) as m, stddev_pop(v) as d from s where ch <> 'view' group by 1), z as (select p, ch, r, k, coalesce((v - m) / greatest(d, 1e-6), v) as v from s left join st using (ch)),
f as (select unnest(generate_series(0, 15))::integer as a), w as (select a, b, greatest(0, 1 - abs(greatest(0, least(7, (a + 0.5) / 2 - 0.5)) - b)) as w from f, (select unnest(generate_series(0, 7))::integer as b))
select z.p as sample_id, ch as channel, y.a as row, x.a as col, round(sum(y.w * x.w * v)::double, 7) + 0.0 as value from z join w y on y.b = z.r join w x on x.b = z.k where y.w > 0 and x.w > 0 group by 1, 2, 3, 4""",
)
def r13_field_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("sample_id"), F.col("event_type").alias("channel"), F.floor(F.col("value") / 62).cast("int").alias("row"), F.expr("event_id % 8").cast("int").alias("col")
    ).agg(F.max("value").alias("value"))
    stats = c.filter("channel <> 'view'").groupBy("channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return field_pipeline(c, stats, 2, 8, 8).withColumn("value", F.round("value", 7) + 0.0)


@CORE.query(
    "r14_cluster_lookup",
    """with s as (select country % 10 as cluster, avg(ignition_ratio) as a, avg(t_ratio) as b, count(*) as n from fires where country is not null group by 1),
c as (select user_id as p, event_id, (event_id % 12)::integer as cluster from events)
select event_id, round(coalesce(a, 0), 6) as ignition, round(coalesce(b, 0), 6) as persistence, coalesce(n, 0) as n from c left join s using (cluster)""",
)
def r14_cluster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels of statistics for the cluster of each pixel, zeros for unknown clusters."""
    s = table(spark, sf_dir, "fires").filter("country is not null").groupBy(F.expr("country % 10").alias("cluster")).agg(
        F.avg("ignition_ratio").alias("a"), F.avg("t_ratio").alias("b"), F.count(F.lit(1)).alias("n")
    )
    c = table(spark, sf_dir, "events").select("event_id", F.expr("cast(event_id % 12 as int)").alias("cluster"))
    return c.join(s, "cluster", "left").select(
        "event_id", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("ignition"), F.round(F.coalesce("b", F.lit(0.0)), 6).alias("persistence"), F.coalesce("n", F.lit(0)).alias("n")
    )


@CORE.query(
    "s18_canopy_dates",
    f"""with h as (select grid_row as r, grid_col as k, case when cell_value is null or isnan(cell_value) then null else cell_value * 3 end as height, 15 + (grid_row + grid_col) % 8 as years from raster),
s as (select sample_id, floor((90 - lat) * 2)::integer as r, floor((ln + 180) * 2)::integer as k, year(dt) - 2000 + (dayofyear(dt) - 1) / 365.25 as y from (select *, {LON_SQL} as ln from {COUNTING_SQL}) where ln is not null and abs(lat) <= 90)
select sample_id, height, coalesce(years < y, false) as predates from s left join h on h.r = s.r and h.k = s.k""",
)
def s18_canopy_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height under each located sample, null without data, and whether its image is older than the sample."""
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "lon", "lat", "dt"))
    s = s.select("sample_id", longitude().alias("lon"), latitude().alias("lat"), "dt").filter("lon is not null and lat is not null")
    return _canopy(spark, sf_dir, s)


def _canopy(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    v = F.col("cell_value")
    h = table(spark, sf_dir, "raster").select(
        F.col("grid_row").alias("r"), F.col("grid_col").alias("k"), F.when(v.isNotNull() & ~F.isnan(v), v * 3).alias("height"), (15 + (F.col("grid_row") + F.col("grid_col")) % 8).alias("years")
    )
    s = s.select("sample_id", F.floor((90 - F.col("lat")) * 2).cast("int").alias("r"), F.floor((F.col("lon") + 180) * 2).cast("int").alias("k"), S.years_since_2000("dt").alias("y"))
    return s.join(h, ["r", "k"], "left").select("sample_id", "height", F.coalesce(F.col("years") < F.col("y"), F.lit(False)).alias("predates"))


@CORE.query(
    "s19_day_cells",
    f"select fire_id, xi, yi, count(*) as n from {COUNTING_SQL} where dt = date '2021-08-15' + 1 and xi between 0 and 40 group by 1, 2, 3",
)
def s19_day_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the day after a given one within a window; rows of other days are dropped only after resends are settled."""
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id", "xi", "yi", "dt"))
    day = F.date_add(F.lit("2021-08-15").cast("date"), 1)
    return s.filter((F.col("dt") == day) & F.col("xi").between(0, 40)).groupBy("fire_id", "xi", "yi").agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "where31_burned_equivalent",
    """with a as (select event_id, user_id, event_type <> 'signup' as m, case when event_type = 'view' then -1.0 else value / 491 end as age, value / 491 as p, case when event_type in ('error', 'purchase') then 1 else 0 end as y from events)
select user_id as sample_id, count(*) filter (where m and age < -0.1) as n, count(*) filter (where m and age < -0.1 and p > 0.5 and y = 1) as tp, count(*) filter (where m and age < -0.1 and p > 0.5 and y = 0) as fp from a group by 1""",
)
def where31_burned_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over pixels that were not burned before."""
    e = table(spark, sf_dir, "events")
    age = F.when(F.col("event_type") == "view", -1.0).otherwise(F.col("value") / 491)
    px = e.select(
        F.col("user_id").alias("sample_id"), (F.col("value") / 491).alias("pred"), F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("target"),
        ((F.col("event_type") != "signup") & (age < -0.1)).cast("int").alias("mask"),
    )
    return scoring.confusion(px, ["sample_id"]).select("sample_id", "n", "tp", "fp")


@CORE.query(
    "where9_region_and_size",
    f"""with f as (select fire_id, max(num_fire) as n from fires group by 1) select sample_id from {COUNTING_SQL} s left join f using (fire_id)
where region_id in (1, 3, 5) and case when coalesce(n, 0) < 100 then '<100' when n < 1000 then '100-1000' when n < 10000 then '1000-10000' else '>10000' end <> '<100'""",
)
def where9_region_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of some regions whose fire isn't among the smallest."""
    f = table(spark, sf_dir, "fires").filter("fire_id is not null").groupBy("fire_id").agg(F.max("num_fire").alias("n"))
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id", "region_id")).filter("region_id in (1, 3, 5)")
    return s.join(f, "fire_id", "left").filter(S.size_range(F.coalesce("n", F.lit(0))) != "<100").select("sample_id")


@CORE.query(
    "a31_ensemble_daily",
    "select user_id % 10 as cell, cast(ts as date) as day, round(sum(value), 6) as precip, max(value) as speed, min(value) as pressure, count(distinct event_type) as members from events group by 1, 2",
)
def a31_ensemble_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.expr("user_id % 10").alias("cell"), F.to_date("ts").alias("day"))
    return e.agg(F.round(F.sum("value"), 6).alias("precip"), F.max("value").alias("speed"), F.min("value").alias("pressure"), F.countDistinct("event_type").alias("members"))


@CORE.query(
    "a37_dominant_class",
    """with n as (select user_id % 32 as cluster, event_type as lc, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by cluster order by n desc, lc) as rn, sum(n) over (partition by cluster) as t from n),
h as (select user_id % 32 as cluster, avg(case when value > 0 and value < 255 then value end) as h from events group by 1) select r.cluster, lc, round(n / t, 6) as purity, round(h, 6) as mean_height from r join h using (cluster) where rn = 1""",
)
def a37_dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent class of each cluster, its share, and the mean height of pixels that have one."""
    e = table(spark, sf_dir, "events").withColumn("cluster", F.expr("user_id % 32"))
    n = e.groupBy("cluster", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # The largest count first, then the first name: a minimum over (-n, name).
    top = n.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("t"), F.sum("n").alias("all"))
    h = e.groupBy("cluster").agg(F.round(F.avg(F.when((F.col("value") > 0) & (F.col("value") < 255), F.col("value"))), 6).alias("mean_height"))
    return top.join(h, "cluster").select("cluster", F.col("t.event_type").alias("lc"), F.round(-F.col("t.m") / F.col("all"), 6).alias("purity"), "mean_height")


@CORE.query(
    "a10_grouped_cells",
    f"""with c as (select fire_id, count(*) as n from {COUNTING_SQL} where fire_id is not null group by 1) select fire_id, n, (sum(n) over (order by fire_id) - n)::bigint as first from c""",
)
def a10_grouped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each fire's partition and the offset at which it starts in the order of fires."""
    from emberframe.operators.ordering import running_total

    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id")).filter("fire_id is not null")
    c = s.groupBy("fire_id").agg(F.count(F.lit(1)).alias("n"))
    return running_total(c, ["fire_id"], ["n"]).select("fire_id", "n", (F.col("run_n") - F.col("n")).alias("first"))


@CORE.query(
    "j5_pair_flags",
    """with c as (select fire_id, day_t as day, bool_or(coalesce(t_full, false)) as full from picked group by 1, 2), p as (select distinct fire_id, day_t from picked)
select p.fire_id, p.day_t, a.full as t_full, coalesce(b.full, false) as t1_full from p join c a on a.fire_id = p.fire_id and a.day = p.day_t left join c b on b.fire_id = p.fire_id and b.day = p.day_t + 1""",
)
def j5_pair_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberframe.operators.coverage import refreshed

    p = table(spark, sf_dir, "picked")
    c = p.groupBy("fire_id", F.col("day_t").alias("day")).agg(F.bool_or(F.coalesce("t_full", F.lit(False))).alias("fully_covered"))
    return refreshed(p.select("fire_id", "day_t").distinct(), c).select("fire_id", "day_t", "t_full", "t1_full")


def type_case(regions: DataFrame) -> str:
    """The fire-type rules of all regions as one CASE expression over region_id, lc and t_ratio, for any SQL engine.

    The rules are a dimension: its rows are read to the driver, and more than 10,000 of them are refused.
    """
    rows = regions.select("region_id", "exclude_lc", "crop_is_veg").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many rules for one expression")
    quoted = lambda names: ", ".join("'" + n.lower().replace("'", "''") + "'" for n in sorted(names))
    whens = [f"WHEN t_ratio > {S.STATIC_T_RATIO} AND NOT isnan(t_ratio) THEN 1", f"WHEN lower(lc) IN ({quoted(S.STATIC_LC)}) THEN 1"]
    whens += [f"WHEN region_id = {r['region_id']} AND lower(lc) IN ({quoted(r['exclude_lc'])}) THEN 1" for r in rows if r["exclude_lc"]]
    if crop := ", ".join(str(r["region_id"]) for r in rows if r["crop_is_veg"]):
        whens.append(f"WHEN lower(lc) = 'cropland' AND region_id IN ({crop}) THEN 0")
    return "CASE " + " ".join([*whens, "WHEN lower(lc) = 'cropland' THEN 2", "ELSE 0 END"])


@CORE.query("where21_type_case", FIRE_TYPES_SQL)
def where21_type_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire types by the generated expression; the same result as the joined rules of where20_fire_types."""
    return covered_fires(spark, sf_dir).select("fire_id", "lc", F.expr(type_case(table(spark, sf_dir, "regions"))).alias("fire_type"))
