"""Composite pipelines: tiered picking, loss masks, tile windows, footprints, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import scalars as S
from emberframe.operators import coverage as C
from emberframe.operators import sampling as P
from emberframe.operators.graph import label_cells
from emberframe.operators.rings import boxes_in_rings
from emberframe.plans.picking import PICKED_SQL, fire_images, picked
from emberframe.registry import CORE
from emberframe.session import materialize
from emberframe.tables import COUNTING_SQL, EAST_SQL, LON_SQL, counting, latitude, longitude, table

# ---- Q-C: vegetation first, then static, then crop; each tier sees the images that the ones before ask for


def tiered_pick(pool: DataFrame, fi: DataFrame, budgets: dict[int, int], per_fire: int) -> DataFrame:
    """(fire_id, day_t, fire_type): picks of each type in turn, coverage being refreshed with what was asked for so far.

    pool(fire_id, day_t, region_id, num_fire, fire_type); fi(fire_id, image_id, day, downloaded). The tiers depend on each
    other's result, so each is written to the shared folder before the next is planned.
    """
    out = None
    for kind, per_region in budgets.items():
        mine = C.refreshed(pool.filter(F.col("fire_type") == kind), C.day_coverage(fi))
        pick = materialize(P.cheapest(mine, per_region, per_fire).select("fire_id", "day_t", "fire_type"))
        out = pick if out is None else out.union(pick)
        asked = C.missing_images(pick, fi).select("image_id", F.lit(True).alias("got"))
        fi = materialize(fi.join(asked, "image_id", "left").withColumn("downloaded", F.col("downloaded") | F.coalesce("got", F.lit(False))).drop("got"))
    return out


_FI_SQL = """fi0 as (select distinct l_suppkey as fire_id, l_orderkey as image_id, cast(o_orderdate as date) as day, o_orderstatus = 'F' as downloaded from lineitem join orders on l_orderkey = o_orderkey),
pool as (select distinct fire_id, day as day_t, (fire_id % 5)::integer as region_id, (fire_id * 37 % 1000)::integer as num_fire, (date_diff('day', date '1995-01-01', day) % 3)::integer as fire_type from fi0)"""


def _tier_sql(k: int, per_region: int) -> str:
    return f"""c{k} as (select fire_id, day, bool_and(downloaded) as full from fi{k} group by 1, 2),
k{k} as (select p.*, coalesce(a.full, false) as tf, coalesce(b.full, false) as t1f,
(((p.fire_id::bigint * 10007 + date_diff('day', date '2000-01-01', day_t)) * 2654435761 + 42) % 1000003) as h from pool p
left join c{k} a on a.fire_id = p.fire_id and a.day = day_t left join c{k} b on b.fire_id = p.fire_id and b.day = day_t + 1 where fire_type = {k}),
u{k} as (select *, ((h + 1000003) % 1000003 + 0.5) / 1000003.0 / (pow(greatest(num_fire, 1)::double, 0.5) * case when tf and t1f then 1.0 when tf then 0.7 else 0.5 end) as key from k{k}),
f{k} as (select *, row_number() over (partition by fire_id order by key, day_t) as a from u{k}),
r{k} as (select *, row_number() over (partition by region_id order by key, fire_id, day_t) as b from f{k} where a <= 5 and region_id > 0),
t{k} as (select fire_id, day_t, fire_type from r{k} where b <= {per_region}),
n{k} as (select fire_id, day_t as day from t{k} union select fire_id, day_t + 1 from t{k}),
m{k} as (select distinct image_id from fi{k} join n{k} using (fire_id, day) where not downloaded),
fi{k + 1} as (select fire_id, image_id, day, downloaded or image_id in (select image_id from m{k}) as downloaded from fi{k})"""


@CORE.query("qc_tiered_pick", f"with {_FI_SQL}, {_tier_sql(0, 40)}, {_tier_sql(1, 10)}, {_tier_sql(2, 20)} select * from t0 union all select * from t1 union all select * from t2")
def qc_tiered_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    fi = materialize(fire_images(spark, sf_dir))
    pool = fi.select("fire_id", F.col("day").alias("day_t")).distinct().select(
        "fire_id", "day_t", F.expr("cast(fire_id % 5 as int)").alias("region_id"), F.expr("cast(fire_id * 37 % 1000 as int)").alias("num_fire"),
        (F.datediff("day_t", F.lit("1995-01-01")) % 3).alias("fire_type"),
    )
    return tiered_pick(materialize(pool), fi, {0: 40, 1: 10, 2: 20}, 5)


@CORE.query(
    "qe_survey_budgets",
    f"""with {PICKED_SQL}, b as (select region_id, case when region_id in (1, 5) then 60 else 20 end as budget from regions),
k as (select *, u / (pow(greatest(coalesce(num_fire, 1), 1)::double, 0.5) * case when t_full and t1_full then 1.0 when t_full then 0.7 else 0.5 end) as key from pk where fire_type = 0),
f as (select *, row_number() over (partition by fire_id order by key, day_t) as a from k), r as (select *, row_number() over (partition by region_id order by key, fire_id, day_t) as place from f where a <= 5 and region_id > 0)
select r.region_id, count(*) as n, count(distinct fire_id) as n_fires, sum(n_tiles_est)::bigint as tiles from r join b using (region_id) where place <= budget group by 1""",
)
def qe_survey_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What budgets per region would pick: ranks up to the largest budget are kept, then cut at each region's own."""
    budget = F.when(F.col("region_id").isin(1, 5), 60).otherwise(20)
    top = P.cheapest(picked(spark, sf_dir).filter("fire_type = 0"), 60, 5)
    from emberframe.operators.coverage import ranked

    r = ranked(top, ["region_id"], [F.col("key"), F.col("fire_id"), F.col("day_t")]).filter(F.col("rank") <= budget)
    return r.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fire_id").alias("n_fires"), F.sum("n_tiles_est").alias("tiles"))


# ---- Q-G: the loss mask of a pixel


def loss_mask(px: DataFrame, border: int, size: int) -> DataFrame:
    """px(…, obs_t, obs_t1, ignition, other_fire, is_last, row, col) with `mask`.

    A pixel counts if both days are clear, it is no ignition and of no other fire. On a fire's last day the
    target is known to be empty, which cancels all of that but clear sight of the day; the border never counts.
    """
    seen = S.is_clear("obs_t") & S.is_clear("obs_t1") & ~F.col("ignition") & ~F.col("other_fire")
    last = F.col("is_last") & S.is_clear("obs_t")
    inside = (F.col("row") >= border) & (F.col("row") < size - border) & (F.col("col") >= border) & (F.col("col") < size - border)
    return px.withColumn("mask", F.coalesce((last | seen) & inside, F.lit(False)))


@CORE.query(
    "qg_loss_mask",
    """with px as (select event_id, user_id, (event_id % 10)::integer as a, (event_id * 3 % 10)::integer as b, event_type = 'signup' as ign, event_type = 'view' as other, user_id % 9 = 0 as last,
floor(value / 16)::integer as r, (event_id * 7 % 32)::integer as k from events)
select event_id, (((last and a in (3, 5, 7, 8, 9)) or (a in (3, 5, 7, 8, 9) and b in (3, 5, 7, 8, 9) and not ign and not other)) and r between 2 and 29 and k between 2 and 29) as mask from px""",
)
def qg_loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    px = e.select(
        "event_id", F.expr("event_id % 10").alias("obs_t"), F.expr("event_id * 3 % 10").alias("obs_t1"), (F.col("event_type") == "signup").alias("ignition"),
        (F.col("event_type") == "view").alias("other_fire"), F.expr("user_id % 9 = 0").alias("is_last"), F.floor(F.col("value") / 16).cast("int").alias("row"),
        F.expr("cast(event_id * 7 % 32 as int)").alias("col"),
    )
    return loss_mask(px, 2, 32).select("event_id", "mask")


# ---- G10, J32: components that hold a target detection

@CORE.query(
    "g10_target_components",
    """with recursive c as (select distinct user_id as p, cast(floor(value) as bigint) % 40 as x, cast(floor(value / 40) as bigint) as y from events where event_type <> 'view'),
e as (select a.p, a.x as ux, a.y as uy, b.x as vx, b.y as vy from c a join c b on a.p = b.p and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
r as (select * from e union select r.p, r.ux, r.uy, e.vx, e.vy from r join e on r.p = e.p and r.vx = e.ux and r.vy = e.uy),
t as (select distinct user_id as p, cast(floor(value) as bigint) % 40 as x, cast(floor(value / 40) as bigint) as y from events where event_type = 'purchase')
select r.p as patch, r.ux::integer as x, r.uy::integer as y from r join t on r.p = t.p and r.vx = t.x and r.vy = t.y group by 1, 2, 3""",
)
def g10_target_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the components of a patch that hold a purchase."""
    e = table(spark, sf_dir, "events").select(
        F.expr("cast(floor(value) as bigint) % 40").cast("int").alias("x"), F.floor(F.col("value") / 40).cast("int").alias("y"), F.col("user_id").cast("int").alias("t"), "event_type"
    )
    cells = materialize(label_cells(e.filter("event_type <> 'view'"), 1, 1, 0))
    hit = cells.join(e.filter("event_type = 'purchase'").select("x", "y", "t").distinct(), ["x", "y", "t"], "left_semi").select("component").distinct()
    return cells.join(hit, "component", "left_semi").select(F.col("t").cast("bigint").alias("patch"), "x", "y")


# ---- J31: windows of tiles in a larger buffer

@CORE.query(
    "j31_tile_windows",
    """with b as (select user_id as p, floor(value)::integer as r, (event_id * 7 % 300)::integer as k, max(value) as v from events group by 1, 2, 3),
t as (select distinct p, (tr * 200)::integer as r0, (tk * 150)::integer as k0 from b, (select unnest([0, 1]) as tr), (select unnest([0, 1]) as tk))
select t.p, r0, k0, (r - r0)::integer as r, (k - k0)::integer as k, v from t join b on b.p = t.p and r >= r0 and r < r0 + 256 and k >= k0 and k < k0 + 200""",
)
def j31_tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a buffer in the local coordinates of every tile that holds them; each cell names its tiles, nothing is joined."""
    b = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("p"), F.floor("value").cast("int").alias("r"), F.expr("cast(event_id * 7 % 300 as int)").alias("k")).agg(F.max("value").alias("v"))
    r0 = F.filter(F.array(F.lit(0), F.lit(200)), lambda x: (F.col("r") >= x) & (F.col("r") < x + 256))
    k0 = F.filter(F.array(F.lit(0), F.lit(150)), lambda x: (F.col("k") >= x) & (F.col("k") < x + 200))
    t = b.withColumn("r0", F.explode(r0)).withColumn("k0", F.explode(k0))
    return t.select("p", "r0", "k0", (F.col("r") - F.col("r0")).alias("r"), (F.col("k") - F.col("k0")).alias("k"), "v")


# ---- J19: boxes against rings, day by day


@CORE.query(
    "j19_ring_overlaps",
    f"""with f as (select distinct fire_id, min_x as x0, min_y as y0, {EAST_SQL} as x1, max_y as y1, unnest(generate_series(start_date, end_date, interval 1 day))::date as day from fires),
g as (select day, w from (select distinct dt as day from {COUNTING_SQL} where dt is not null) d, (select unnest(generate_series(-180, 150, 30)) as w)),
h as (select distinct f.day, fire_id, w from f join g on f.day = g.day and y1 >= -60 and y0 <= 70 join (select unnest([-720, -360, 0, 360]) as k) on x1 + k >= w and x0 + k <= w + 35
and x1 + k - (y0 + 60) * 15 / 130 >= w and x0 + k - (y1 + 60) * 15 / 130 <= w + 20)
select day, count(*) as n_pairs, count(distinct fire_id) as n_fires from h group by 1""",
)
def j19_ring_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires and swaths of a day that meet: twelve slanted rings a day stand in for a table of swaths, two of them across the date line."""
    f = table(spark, sf_dir, "fires").select("fire_id", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), F.col("max_x").alias("x1"), F.col("max_y").alias("y1"), "start_date", "end_date").distinct()
    f = f.withColumn("day", F.explode(F.sequence("start_date", "end_date"))).drop("start_date", "end_date")
    days = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "dt")).filter("dt is not null").select(F.col("dt").alias("day")).distinct()
    fold = lambda x: x - 360.0 * F.floor((x + 180.0) / 360.0)
    w = F.col("ring_id")
    ring = F.array(*[F.struct(fold(w + dx).alias("x"), F.lit(y).alias("y")) for dx, y in ((0, -60.0), (20, -60.0), (35, 70.0), (15, 70.0))])
    rings = days.withColumn("ring_id", F.explode(F.sequence(F.lit(-180), F.lit(150), F.lit(30)))).withColumn("ring", ring)
    return boxes_in_rings(f, rings).groupBy("day").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("fire_id").alias("n_fires"))


# ---- W2, T6, T7: caps and subsets by hash

@CORE.query(
    "w2_capped_days",
    f"with {PICKED_SQL} select fire_id, day_t from (select *, row_number() over (partition by fire_id order by (t_full and t1_full)::int desc, u, day_t) as a from pk) q where a <= 3",
)
def w2_capped_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = picked(spark, sf_dir).withColumn("u", P.hash_unit(P.fire_day_key(F.col("fire_id"), F.col("day_t"))))
    both = (F.col("t_full") & F.col("t1_full")).cast("int")
    return P.capped(p, ["fire_id"], [both.desc(), F.col("u"), F.col("day_t")], 3).select("fire_id", "day_t")


@CORE.query(
    "t6_largest_of_pool",
    """with f as (select fire_id, max(num_fire) as n, ((fire_id::bigint * 2654435761 + 42) % 1000003 + 0.5) / 1000003.0 as u from fires where num_fire is not null group by 1),
p as (select * from f where u < 0.5) select fire_id, n from p order by n desc, fire_id limit 50""",
)
def t6_largest_of_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty largest fires of a random half."""
    f = table(spark, sf_dir, "fires").filter("num_fire is not null").groupBy("fire_id").agg(F.max("num_fire").alias("n"))
    return f.filter(P.hash_unit(F.col("fire_id")) < 0.5).orderBy(F.col("n").desc(), "fire_id").limit(50)


@CORE.query(
    "t7_statistics_sample",
    "select event_type, count(*) as n, round(avg(value), 6) as mean from events where ((event_id * 2654435761 + 42) % 1000003 + 0.5) / 1000003.0 < 0.1 group by 1",
)
def t7_statistics_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of channels over a tenth of the rows, the sampling operator itself."""
    e = table(spark, sf_dir, "events").filter(P.hash_unit(F.col("event_id")) < 0.1)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@CORE.query(
    "a11_unique_places",
    f"""with c as (select fire_id, count(*) as raw, count(distinct (xi, yi)) as places from {COUNTING_SQL} where fire_id is not null group by 1) select fire_id, places from c where raw >= 5 and places >= 5""",
)
def a11_unique_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places of fires with at least five rows and five places; distinct first, then counted, so no fire is one task."""
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id", "xi", "yi")).filter("fire_id is not null")
    by = s.groupBy("fire_id", "xi", "yi").agg(F.count(F.lit(1)).alias("k"))
    return by.groupBy("fire_id").agg(F.sum("k").alias("raw"), F.count(F.lit(1)).alias("places")).filter("raw >= 5 and places >= 5").select("fire_id", "places")


@CORE.query(
    "j8_land_cover",
    f"""with p as (select sample_id, floor((90 - lat) * 2)::integer as r, floor((ln + 180) * 2)::integer as k from (select sample_id, lat, {LON_SQL} as ln from {COUNTING_SQL}))
select sample_id, coalesce(['Forest', 'Grass', 'Shrub', 'Cropland', 'Wetland'][(cell_value::integer % 5) + 1], 'Unknown') as lc from p
left join (select * from raster where layer = 'region' and cell_value is not null and not isnan(cell_value)) q on q.grid_row = p.r and q.grid_col = p.k""",
)
def j8_land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class name of the cell under each sample; outside the raster and without coordinates it is Unknown."""
    names = F.array(*map(F.lit, ("Forest", "Grass", "Shrub", "Cropland", "Wetland")))
    r = table(spark, sf_dir, "raster").filter("layer = 'region' and cell_value is not null and not isnan(cell_value)")
    r = r.select(F.col("grid_row").alias("r"), F.col("grid_col").alias("k"), F.get(names, (F.col("cell_value").cast("int") % 5)).alias("lc"))
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "lon", "lat"))
    p = s.select("sample_id", F.floor((90 - latitude()) * 2).cast("int").alias("r"), F.floor((longitude() + 180) * 2).cast("int").alias("k"))
    return p.join(r, ["r", "k"], "left").select("sample_id", F.coalesce("lc", F.lit("Unknown")).alias("lc"))


@CORE.query(
    "qi_dataset",
    f"""with s as (select sample_id, fire_id, region_id, dt, load_order from {COUNTING_SQL} where fire_type = 0 and year(dt) >= 2019 and fire_id is not null and region_id > 0),
p as (select *, row_number() over (partition by region_id order by dt, load_order) - 1 as i, count(*) over (partition by region_id) as n from s)
select sample_id, case when i < floor(n * 0.6::double) then 'train' when i < floor(n * (0.6::double + 0.15::double)) then 'val' else 'test' end as part,
row_number() over (partition by fire_id order by dt desc, load_order desc) = 1 as is_last from p""",
)
def qi_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter by type and year, split by date within regions, mark the last sample of each fire."""
    from emberframe.operators.history import last_day_once

    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id", "fire_type", "region_id", "dt"))
    s = materialize(s.filter("fire_type = 0 and year(dt) >= 2019 and fire_id is not null and region_id > 0").select("sample_id", "fire_id", "region_id", "dt", "load_order"))
    split = P.temporal_split(s, "region_id", ["dt", "load_order"])
    return last_day_once(split, "fire_id", "dt", "load_order").select("sample_id", "part", "is_last")


@CORE.query(
    "a46_event_enrichment",
    """with s as (select user_id as event, event_id % 4 as model, avg(value / 491) as m, count(*) filter (where event_type = 'error') as gt from events group by 1, 2)
select event, sum(gt)::bigint as n_gt, round(max(case when model = 0 then m end), 6) as m0, round(max(case when model = 3 then m end), 6) as m3 from s group by 1""",
)
def a46_event_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("event"), F.expr("event_id % 4").alias("model")).agg(
        F.avg(F.col("value") / 491).alias("m"), F.count(F.when(F.col("event_type") == "error", 1)).alias("gt")
    )
    pick = lambda k: F.round(F.max(F.when(F.col("model") == k, F.col("m"))), 6).alias(f"m{k}")
    return s.groupBy("event").agg(F.sum("gt").alias("n_gt"), pick(0), pick(3))
