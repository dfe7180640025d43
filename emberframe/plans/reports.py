"""Report tables, each built from the operators of emberframe.operators.reports, and the SQL that checks it.

Runs of models are read from lineitem: return flag is the model, line status the target, order priority the
training region, supplier's region the region scored, and the discount the score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.operators import reports as R
from emberframe.operators.ordering import positions
from emberframe.registry import CORE
from emberframe.session import materialize
from emberframe.tables import COUNTING_SQL, EAST_SQL, LON_SQL, counting, latitude, longitude, split_meaning, table, unwrapped_east

_C = COUNTING_SQL

RUNS = """runs as (select l_returnflag as model, l_linestatus as target, o_orderpriority as train_label, n_regionkey as region_id,
round(avg(l_discount * 10), 6) as f1, round(avg(l_tax * 10), 6) as iou, count(*) as n
from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2, 3, 4)"""

_SPLIT = (
    "case when lower(trim(split)) like 'train%' then 'train' when lower(trim(split)) like 'val%' then 'val' "
    "when lower(trim(split)) like 'test%' then 'test' else 'none' end"
)

SQL = {
    # Splits and samples
    "a24_split_summary": f"""with s as (select {_SPLIT} as part, dt from {_C} s)
select coalesce(part, 'Total') as part, count(*) as n, round(1e2 * count(*) / (select count(*) from s), 6) as pct, min(dt) as first_day, max(dt) as last_day
from s group by rollup (part)""",
    "a25_region_split": f"""with s as (select {_SPLIT} as part, region_id from {_C} s)
select region_id, grouping(region_id) as total, count(*) filter (where part = 'train') as train, count(*) filter (where part = 'val') as val,
count(*) filter (where part = 'test') as test, count(*) as n from s group by rollup (region_id)""",
    "a25_region_year": f"""select region_id, year(dt) as y, count(*) as n, count(distinct fire_id) as n_fires from {_C} s group by cube (region_id, year(dt))""",
    "a25_type_region": f"""select region_id, count(*) filter (where fire_type = 0) as veg, count(*) filter (where fire_type = 1) as static, count(*) filter (where fire_type = 2) as crop,
count(*) as n, rank() over (order by count(*) desc) as place from {_C} s where region_id > 0 group by region_id""",
    "a51_region_counts": f"select region_id, count(*) filter (where {_SPLIT} = 'train') as n_train, count(*) filter (where {_SPLIT} = 'val') as n_val from {_C} s group by region_id",
    "a55_samples_by_fire": f"""select fire_id, count(*) as n, min(sample_id) as first_sample, max(sample_id) as last_sample, count(distinct dt) as n_days from {_C} s where fire_id is not null group by fire_id""",
    # Runs and grids
    "a19_runs_mean_std": f"""with {RUNS} select model, target, count(*) as n_runs, round(avg(f1), 6) as f1, round(stddev_pop(f1), 6) as f1_std,
round(avg(iou), 6) as iou, round(stddev_pop(iou), 6) as iou_std, round(avg(n), 6) as n from {{runs}} group by model, target""".replace("{runs}", "runs"),
    "a20_best_runs": f"""with {RUNS} select model, target, train_label, region_id, f1 from (select *, row_number() over (partition by model, target order by f1 desc, train_label, region_id) as rn from runs) r where rn = 1""",
    "a21_leave_one_out": f"""with {RUNS}, f as (select region_id, avg(f1) as f1 from runs group by region_id),
l as (select train_label, region_id, avg(f1) as f1 from runs where train_label <> '3-MEDIUM' or region_id <> 2 group by train_label, region_id)
select train_label, count(*) as n_regions, round(avg(l.f1 - f.f1), 6) as delta, round(avg(coalesce(f.f1, 0)), 6) as full_macro, round(avg(l.f1), 6) as loo_macro
from l left join f on l.region_id = f.region_id group by train_label""",
    "a22_transfer_matrix": f"""with {RUNS}, m as (select train_label, region_id, sum(f1 * n) / sum(n) as f1 from runs group by train_label, region_id)
select train_label, region_id, round(f1, 6) as f1, f1 = max(f1) over (partition by region_id) as column_best from m""",
    "a22_transfer_pivot": f"""with {RUNS}, m as (select train_label, region_id, sum(f1 * n) / sum(n) as f1 from runs group by train_label, region_id)
select train_label, {", ".join(f"round(max(case when region_id = {r} then f1 end), 6) as r{r}" for r in range(5))} from m group by train_label""",
    "a23_ablation_deltas": f"""with {RUNS}, m as (select train_label, sum(f1 * n) / sum(n) as f1 from runs group by train_label), b as (select f1 as base from m where train_label = '1-URGENT')
select train_label, round(f1, 6) as f1, round(f1 - base, 6) as delta from m cross join b""",
    "a28_baseline_summary": f"""with {RUNS} select model, target, round(sum(f1 * n) / sum(n), 6) as f1, round(sum(iou * n) / sum(n), 6) as iou, cast(sum(n) as bigint) as n from runs group by rollup (model, target)""",
    "a28_model_regions": f"""with {RUNS}, m as (select model, region_id, sum(f1 * n) / sum(n) as f1 from runs group by model, region_id)
select region_id, max(case when model = 'A' then round(f1, 6) end) as f1_a, max(case when model = 'N' then round(f1, 6) end) as f1_n, max(case when model = 'R' then round(f1, 6) end) as f1_r,
round(max(f1), 6) as best from m group by region_id""",
    "a29_type_performance": f"""with {RUNS} select target as fire_type, model, round(sum(f1 * n) / sum(n), 6) as f1,
rank() over (partition by target order by sum(f1 * n) / sum(n) desc, model) as place from runs group by target, model""",
    "t13_run_ranking": f"""with {RUNS} select model, target, train_label, region_id, f1, row_number() over (order by f1 desc, model, target, train_label, region_id) as place from runs""",
    "t14_ordered_baselines": f"""with {RUNS}, m as (select model, target, sum(f1 * n) / sum(n) as f1 from runs group by model, target)
select model, target, round(f1, 6) as f1, row_number() over (order by case target when 'O' then 0 else 1 end, model) as place from m""",
    "t16_region_order": f"""with {RUNS}, g as (select region_id, max(f1) as best, sum(n) as n from runs group by region_id),
k as (select * from g where n >= 1000) select region_id, best, row_number() over (order by best, region_id) as place from (select * from k union all select * from g where not exists (select 1 from k)) q""",
    "m4_best_checkpoint": f"""with {RUNS}, e as (select model, target, row_number() over (partition by model, target order by train_label, region_id) as epoch, f1 from runs),
b as (select *, max(f1) over (partition by model, target order by epoch) as best from e)
select model, target, epoch, f1, best, f1 = best and f1 > coalesce(lag(best) over (partition by model, target order by epoch), -1) as is_new_best from b""",
    "u7_config_grid": """with m as (select distinct l_returnflag as model from lineitem), l as (select distinct o_orderpriority as loss from orders), t as (select distinct l_linestatus as target from lineitem)
select concat('grid_', lower(model), '_', lower(replace(loss, '-', '')), '_', lower(target)) as tag from m cross join l cross join t""",
    # Fires
    "a26_solidity_table": """with f as (select distinct fire_id, country % 10 as region_id, avg_xy_neighbors as v, num_cells from fires where country is not null)
select region_id, count(*) as n, percentile_cont(0.5) within group (order by v) as median, percentile_cont(0.25) within group (order by v) as q1,
percentile_cont(0.75) within group (order by v) as q3, percentile_cont(0.5) within group (order by num_cells) as cells from f group by region_id""",
    "a27_cumulative_buckets": f"""with f as (select distinct fire_id, country % 10 as region_id, ignition_ratio as v from fires where country is not null)
select region_id, grouping(region_id) as total, {", ".join(f"count(*) filter (where v >= 0.{k}) as ge_{k}" for k in range(1, 10))}, count(*) as n from f group by rollup (region_id)""",
    "a43_size_histogram": """with f as (select distinct fire_id, country % 10 as region_id, num_fire from fires where num_fire is not null and country is not null),
e as (select generate_subscripts(l, 1) - 1 as i, unnest(l) as lo, unnest(l[2:] || [null]) as hi from (select [1, 3, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000] as l)),
b as (select region_id, case when num_fire = 50000 then 13 when num_fire < 1 then -1 else i end as bin from f left join e on num_fire >= lo and (hi is null or num_fire < hi))
select region_id, cast(bin as integer) as bin, count(*) as n from b group by 1, 2""",
    "t1_largest_fires": """select region_id, fire_id, num_fire, place from (select country % 10 as region_id, fire_id, num_fire, row_number() over (partition by country % 10 order by num_fire desc, fire_id) as place
from (select distinct fire_id, country, num_fire from fires where num_fire is not null and country is not null) f) q where place <= 5""",
    "where36_scenarios": """with f as (select distinct fire_id, num_fire, avg_xy_neighbors as xy, ignition_ratio as ign from fires where num_fire is not null)
select 'all' as scenario, count(*) as n, cast(sum(num_fire) as bigint) as detections from f union all select 'min100', count(*), cast(sum(num_fire) as bigint) from f where num_fire >= 100
union all select 'compact', count(*), cast(sum(num_fire) as bigint) from f where num_fire >= 100 and xy >= 2 union all select 'coherent', count(*), cast(sum(num_fire) as bigint) from f where num_fire >= 100 and xy >= 2 and ign < 0.3""",
    "a35_cluster_stats": """with f as (select distinct fire_id, num_fire, t_ratio, cast(floor(min_x / 30) as integer) as cluster from fires where num_fire is not null)
select cluster, count(*) as n, count(*) filter (where num_fire >= 100) as n100, count(*) filter (where num_fire >= 1000) as n1000,
round(sum(case when t_ratio > 1.5 then sqrt(num_fire) else 0 end) / nullif(sum(sqrt(num_fire)), 0), 6) as tame_share, round(count(*) / 9e-1, 6) as density from f group by cluster""",
    "a36_region_cluster": """with f as (select distinct fire_id, t_ratio, country % 10 as region_id, cast(floor(min_x / 30) as integer) as cluster from fires where country is not null)
select region_id, cluster, count(*) as n, case when count(*) >= 20 then round(avg(case when t_ratio > 1.5 then 1e0 else 0e0 end), 6) end as ratio from f group by region_id, cluster""",
    "a38_cluster_spread": """with f as (select distinct fire_id, num_fire, avg_xy_neighbors as v, cast(floor(min_x / 30) as integer) as cluster from fires where num_fire is not null)
select cluster, round(avg(case when num_fire >= 10 then v end), 9) as mean_10, round(avg(case when num_fire >= 1000 then v end), 9) as mean_1000, max(case when num_fire >= 10 then v end) as max_10 from f group by cluster""",
    "a39_tile_clusters": """select cast(floor(grid_row / 64) as integer) as tr, cast(floor(grid_col / 64) as integer) as tc, cast(cell_value as integer) as cluster, count(*) as n,
round(count(*) / 4096e0, 6) as fraction from raster where cell_value is not null and not isnan(cell_value) group by 1, 2, 3""",
    "where19_mostly_covered_tiles": """with t as (select cast(floor(grid_row / 64) as integer) as tr, cast(floor(grid_col / 64) as integer) as tc, count(*) as n from raster where cell_value is not null and not isnan(cell_value) group by 1, 2)
select tr, tc, tr * 64 + 32 as centre_row, tc * 64 + 32 as centre_col from t where n / 4096e0 > 0.15""",
    "where18_burnable": """with s as (select country % 10 as id, avg(case when t_ratio > 1.5 then 1e0 else 0e0 end) as ratio from fires where country is not null group by country % 10)
select id, round(ratio, 6) as ratio, ratio <= 0.3 as burnable from s""",
    "a40_cluster_quality": """with k as (select user_id % 7 as a, event_type as b, count(*) as n from events group by 1, 2), t as (select sum(n) as t from k),
ra as (select a, sum(n) as n from k group by a), rb as (select b, sum(n) as n from k group by b),
mi as (select sum(k.n / t * ln(k.n * t / (ra.n * rb.n))) as mi from k join ra on k.a = ra.a join rb on k.b = rb.b cross join t),
ha as (select -sum(n / t * ln(n / t)) as h from ra cross join t), hb as (select -sum(n / t * ln(n / t)) as h from rb cross join t),
pu as (select sum(m) / max(t) as purity from (select a, max(n) as m from k group by a) q cross join t),
c as (select sum(n * (n - 1) / 2e0) as s from k), ca as (select sum(n * (n - 1) / 2e0) as s from ra), cb as (select sum(n * (n - 1) / 2e0) as s from rb)
select round(mi / ((ha.h + hb.h) / 2), 6) as nmi, round((c.s - ca.s * cb.s / (t * (t - 1) / 2e0)) / ((ca.s + cb.s) / 2 - ca.s * cb.s / (t * (t - 1) / 2e0)), 6) as ari, round(purity, 6) as purity
from mi cross join ha cross join hb cross join pu cross join c cross join ca cross join cb cross join t""",
    "a42_sample_density": f"""with s as (select cast(floor(({LON_SQL}) / 3) as integer) as x, cast(floor(lat / 3) as integer) as y, year(dt) as yr from {_C} s where lon is not null and abs(lat) <= 90),
p as (select yr, cast(floor((dense_rank() over (order by yr) - 1) / 2) as integer) as pair from (select distinct yr from s) q) select pair, x, y, count(*) as n from s join p on s.yr = p.yr group by pair, x, y""",
    "a48_class_balance": """select user_id % 5 as region_id, round(avg(case when event_type in ('error', 'purchase') then 1e0 else 0e0 end), 6) as positive, round(avg(case when event_type = 'view' then 1e0 else 0e0 end), 6) as nodata from events group by 1""",
    "a49_display_range": """select event_type, percentile_cont(0.02) within group (order by value) as lo, percentile_cont(0.98) within group (order by value) as hi from events group by event_type""",
    "a53_patch_grid": f"""select percentile_cont(0.5) within group (order by m) as median, percentile_cont(0.25) within group (order by m) as q1 from
(select distinct fire_id, ({EAST_SQL} - min_x) * 111195e-3 * cos(radians(min_y)) / 256e-3 as m from fires) q""",
    "a54_histogram": """with l as (select min(value) as lo, max(value) as hi from events) select least(9, cast(floor((value - lo) / (hi - lo) * 10) as integer)) as bin, count(*) as n from events cross join l group by 1""",
    "a33_channel_stats": """select event_type as channel, round(avg(value), 6) as mean, round(greatest(stddev_pop(value), 1e-6), 6) as std, count(*) as n from events group by event_type""",
    # Rounded, since folding leaves a place on the edge of a cell just below it.
    "a44_detection_counts": f"""select cast(floor(round(({LON_SQL}) * 10, 6)) as integer) as x, cast(floor(round(lat * 10, 6)) as integer) as y, count(distinct dt) as n from {_C} s where lon is not null and abs(lat) <= 90 group by 1, 2""",
    "a47_export_rows": """select user_id as sample_id, count(*) filter (where event_type in ('error', 'purchase')) as n_gt, round(count(*) filter (where event_type in ('error', 'purchase')) * 140625e-6, 6) as area_km2,
round(avg(case when event_type <> 'signup' then value / 491 end), 6) as mean_prob from events group by user_id""",
    # Joins on keys
    "j1_link_regions": """select n_regionkey as region_id, count(distinct l_orderkey) as n_images, count(distinct l_suppkey) as n_fires from lineitem join supplier on l_suppkey = s_suppkey
join nation on s_nationkey = n_nationkey group by n_regionkey""",
    "j2_image_metadata": """with i as (select l_orderkey as image_id, count(distinct l_suppkey) as n_fires from lineitem group by l_orderkey) select image_id, n_fires, o_orderdate as start_time, cast(floor(o_totalprice) as integer) as num_fire_pixels
from i join orders on o_orderkey = image_id""",
    "j14_membership": """select o_orderkey as image_id, o_orderstatus = 'F' or exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as at_hand from orders""",
    "j15_semi_join": "select l_orderkey, l_linenumber from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'P')",
    "j25_default_lookup": f"select sample_id, coalesce(r.region_id, 0) as region from {_C} s left join regions r on s.region_id = r.region_id",
    "j30_density_lookup": f"""with f as (select fire_id, max((min_x + {EAST_SQL}) / 2) as cx from fires group by fire_id) select count(*) as n, count(cx) as found, count(*) - count(cx) as unknown from {_C} s left join f on s.fire_id = f.fire_id""",
    "j11_enriched_pairs": """with f as (select fire_id, max(num_fire) as detections, max(end_date) as ended from fires group by fire_id), p as (select distinct fire_id, day_t, region_id, fire_type from picked)
select p.fire_id, p.day_t, detections, ended, name from p join f on p.fire_id = f.fire_id left join regions r on r.region_id = p.region_id""",
    # Sets and texts of rows
    "u3_union_of_types": """select fire_id, day_t, 'veg' as pool from picked where fire_type = 0 union select fire_id, day_t, 'static' from picked where fire_type = 1 union select fire_id, day_t, 'crop' from picked where fire_type = 2""",
    "u4_needed_existing": """select o_orderkey as id, 'both' as kind from orders where o_orderstatus = 'F' intersect select l_orderkey, 'both' from lineitem where l_returnflag = 'R'
union all (select o_orderkey, 'missing' from orders where o_orderstatus = 'F' except select l_orderkey, 'missing' from lineitem where l_returnflag = 'R')""",
    "u6_event_tiles": f"select fire_id, count(*) as n_tiles from (select distinct fire_id, xi, yi from {_C} s where fire_id is not null) q group by fire_id",
    "where34_search": f"""select sample_id from {_C} s left join regions r on s.region_id = r.region_id where lower(coalesce(name, '')) like '%belt%' or lower(source) like '%field%' or lower(tile_key) like '%tile%'""",
    "where29_selected_fields": "select event_id, value from events",
    "where30_new_cells": """select event_id, event_type = 'click' and value < 100 as new_fire, event_type in ('click', 'error') as cur from events""",
    "where32_known_regions": """select case when n_regionkey = 0 then concat('unknown_', cast(n_regionkey as varchar(9))) else cast(n_regionkey as varchar(9)) end as region, count(*) as n from nation where n_regionkey <> 0 group by 1""",
    "t12_richest_sample": f"""select fire_id, sample_id, num_fire from (select *, row_number() over (partition by fire_id order by coalesce(num_fire, -1) desc, load_order) as place from {_C} s where fire_id is not null) q where place = 1""",
    "t9_best_patches": """with p as (select user_id as fire, event_id, value as footprint, event_id % 97 as active, max(value) over (partition by user_id) as top from events)
select fire, event_id from (select *, row_number() over (partition by fire order by active desc, event_id) as place from p where footprint >= 0.5 * top) q where place = 1""",
}


def report(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return CORE.query(f.__name__, SQL[f.__name__])(f)


N = lambda: F.count(F.lit(1))


def _samples(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", *columns)).drop("loaded_at")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, target, train_label, region_id, f1, iou, n): the results of one run each."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("target"), F.col("o_orderpriority").alias("train_label"), F.col("n_regionkey").alias("region_id")
    ).agg(F.round(F.avg(F.col("l_discount") * 10), 6).alias("f1"), F.round(F.avg(F.col("l_tax") * 10), 6).alias("iou"), N().alias("n"))


def _fires(spark: SparkSession, sf_dir: str, *columns: Column | str) -> DataFrame:
    return table(spark, sf_dir, "fires").select("fire_id", *columns).distinct()


def _region() -> Column:
    return F.expr("country % 10").alias("region_id")


# ---- splits and samples


def _parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _samples(spark, sf_dir, "split", *columns).withColumn("part", F.coalesce(split_meaning(), F.lit("none")))


def _part_classes(**names: str) -> dict[str, Column]:
    return {name: F.col("part") == part for name, part in names.items()}


@report
def a24_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, share and span of each split, and of all."""
    s = _parts(spark, sf_dir, "dt")
    sums = materialize(s.groupBy("part").agg(N().alias("n"), F.min("dt").alias("first_day"), F.max("dt").alias("last_day")))
    both = sums.rollup("part").agg(F.sum("n").alias("n"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    pct = F.round(100.0 * F.col("n") / sums.agg(F.sum("n")).scalar(), 6)
    return both.filter("n is not null").select(F.coalesce("part", F.lit("Total")).alias("part"), "n", pct.alias("pct"), "first_day", "last_day")


@report
def a25_region_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.class_counts(_parts(spark, sf_dir, "region_id"), ["region_id"], _part_classes(train="train", val="val", test="test"), level="total")


@report
def a25_region_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir, "region_id", "dt", "fire_id").withColumn("y", F.year("dt").cast("bigint"))
    return s.cube("region_id", "y").agg(N().alias("n"), F.countDistinct("fire_id").alias("n_fires"))


@report
def a25_type_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {name: F.col("fire_type") == k for k, name in enumerate(("veg", "static", "crop"))}
    c = R.class_counts(_samples(spark, sf_dir, "region_id", "fire_type").filter("region_id > 0"), ["region_id"], kinds)
    # One row per region is ordered here.
    return c.withColumn("place", F.rank().over(Window.orderBy(F.col("n").desc())).cast("bigint"))


@report
def a51_region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.class_counts(_parts(spark, sf_dir, "region_id"), ["region_id"], _part_classes(n_train="train", n_val="val")).drop("n")


@report
def a55_samples_by_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir, "fire_id", "dt").filter("fire_id is not null")
    return s.groupBy("fire_id").agg(N().alias("n"), F.min("sample_id").alias("first_sample"), F.max("sample_id").alias("last_sample"), F.countDistinct("dt").alias("n_days"))


# ---- runs and grids


@report
def a19_runs_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pair(c: str) -> list[Column]:
        return [F.round(F.avg(c), 6).alias(c), F.round(F.stddev_pop(c), 6).alias(f"{c}_std")]

    return _runs(spark, sf_dir).groupBy("model", "target").agg(N().alias("n_runs"), *pair("f1"), *pair("iou"), F.round(F.avg("n"), 6).alias("n"))


@report
def a20_best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_rows(_runs(spark, sf_dir), ["model", "target"], [-F.col("f1"), F.col("train_label"), F.col("region_id")], ["train_label", "region_id", "f1"])


@report
def a21_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = (F.col("train_label") == "3-MEDIUM") & (F.col("region_id") == 2)
    return R.leave_one_out(materialize(_runs(spark, sf_dir)), "train_label", "region_id", "f1", out)


def _transfer(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy(*by).agg(R.weighted_mean("f1", "n").alias("f1"))


@report
def a22_transfer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.with_group_best(materialize(_transfer(spark, sf_dir, "train_label", "region_id")), ["region_id"], "f1", "column_best")
    return m.withColumn("f1", F.round("f1", 6))


@report
def a22_transfer_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.matrix(_transfer(spark, sf_dir, "train_label", "region_id"), ["train_label"], "region_id", {f"r{r}": r for r in range(5)}, F.round("f1", 6))


@report
def a23_ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = materialize(_transfer(spark, sf_dir, "train_label"))
    return R.deltas(m, "f1", F.col("train_label") == "1-URGENT").withColumn("f1", F.round("f1", 6))


@report
def a28_baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [F.round(R.weighted_mean(c, "n"), 6).alias(c) for c in ("f1", "iou")]
    return _runs(spark, sf_dir).rollup("model", "target").agg(*means, F.sum("n").alias("n"))


@report
def a28_model_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = materialize(_transfer(spark, sf_dir, "model", "region_id").withColumn("f1", F.round("f1", 6)))
    wide = R.matrix(m, ["region_id"], "model", {f"f1_{k.lower()}": k for k in "ANR"}, F.col("f1"))
    return wide.join(m.groupBy("region_id").agg(F.max("f1").alias("best")), "region_id")


@report
def a29_type_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _transfer(spark, sf_dir, "target", "model").withColumn("place", F.rank().over(Window.partitionBy("target").orderBy(F.col("f1").desc(), "model")).cast("bigint"))
    return m.select(F.col("target").alias("fire_type"), "model", F.round("f1", 6).alias("f1"), "place")


@report
def t13_run_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs in the order of their score; places come from range partitions, so no task sees all runs."""
    r = _runs(spark, sf_dir).select("model", "target", "train_label", "region_id", "f1", (-F.col("f1")).alias("__o"))
    p = positions(r, ["__o", "model", "target", "train_label", "region_id"], "place")
    return p.select("model", "target", "train_label", "region_id", "f1", (F.col("place") + 1).cast("bigint").alias("place"))


@report
def t14_ordered_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _transfer(spark, sf_dir, "model", "target").withColumn("__o", F.when(F.col("target") == "O", 0).otherwise(1))
    return positions(m, ["__o", "model"], "at").select("model", "target", F.round("f1", 6).alias("f1"), (F.col("at") + 1).cast("bigint").alias("place"))


@report
def t16_region_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with enough rows by their best score; all of them if none has enough."""
    g = materialize(_runs(spark, sf_dir).groupBy("region_id").agg(F.max("f1").alias("best"), F.sum("n").alias("n")))
    enough = g.agg(F.max(F.col("n") >= 1000)).scalar()
    kept = g.filter((F.col("n") >= 1000) | ~F.coalesce(enough, F.lit(False)))
    return positions(kept, ["best", "region_id"], "at").select("region_id", "best", (F.col("at") + 1).cast("bigint").alias("place"))


@report
def m4_best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("model", "target").orderBy("train_label", "region_id")
    e = _runs(spark, sf_dir).select("model", "target", F.row_number().over(by).cast("bigint").alias("epoch"), "f1")
    return R.running_best(e, ["model", "target"], "epoch", "f1")


@report
def u7_config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all combinations of model, loss and target: three short lists, of a bounded size each."""
    values = lambda t, c, n: table(spark, sf_dir, t).select(c).distinct().orderBy(c).limit(n)
    lists = [("lineitem", "l_returnflag"), ("orders", "o_orderpriority"), ("lineitem", "l_linestatus")]
    model, loss, target = ([r[0] for r in values(t, c, 1001).collect()] for t, c in lists)
    if max(map(len, (model, loss, target))) > 1000:
        raise ValueError("more than 1000 values in one list of the grid")
    cells = spark.range(len(model)).select(F.element_at(F.array(*map(F.lit, model)), F.col("id").cast("int") + 1).alias("m"))
    cells = cells.withColumn("l", F.explode(F.array(*map(F.lit, loss)))).withColumn("t", F.explode(F.array(*map(F.lit, target))))
    return cells.select(F.concat_ws("_", F.lit("grid"), F.lower("m"), F.lower(F.replace(F.col("l"), F.lit("-"), F.lit(""))), F.lower("t")).alias("tag"))


# ---- fires


@report
def a26_solidity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fires(spark, sf_dir, _region(), F.col("avg_xy_neighbors").alias("v"), "num_cells").filter("region_id is not null")
    return f.groupBy("region_id").agg(
        N().alias("n"), *[F.percentile("v", q).alias(name) for name, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))], F.percentile("num_cells", 0.5).alias("cells")
    )


@report
def a27_cumulative_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fires(spark, sf_dir, _region(), F.col("ignition_ratio").alias("v")).filter("region_id is not null")
    return R.class_counts(f, ["region_id"], {f"ge_{k}": F.col("v") >= k / 10 for k in range(1, 10)}, level="total")


#: Edges of the size bins.
SIZE_EDGES = [1, 3, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000]


@report
def a43_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires by region and size bin. Larger ones than the last edge are counted in a bin of their own (14), none is left out."""
    f = _fires(spark, sf_dir, _region(), "num_fire").filter("region_id is not null")
    return R.edge_histogram(f, ["region_id"], "num_fire", SIZE_EDGES)


@report
def t1_largest_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fires(spark, sf_dir, _region(), "num_fire").filter("region_id is not null and num_fire is not null")
    place = F.row_number().over(Window.partitionBy("region_id").orderBy(F.col("num_fire").desc(), "fire_id"))
    return f.withColumn("place", place).filter("place <= 5").withColumn("place", F.col("place").cast("bigint"))


@report
def where36_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires that pass each of four filters, every one stricter than the one before."""
    f = _fires(spark, sf_dir, "num_fire", "avg_xy_neighbors", "ignition_ratio").filter("num_fire is not null")
    large, compact = F.col("num_fire") >= 100, F.col("avg_xy_neighbors") >= 2
    tests = {"all": F.lit(True), "min100": large, "compact": large & compact, "coherent": large & compact & (F.col("ignition_ratio") < 0.3)}
    names = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return f.withColumn("scenario", F.explode(names)).groupBy("scenario").agg(N().alias("n"), F.sum("num_fire").alias("detections"))


def _cluster() -> Column:
    return F.floor(F.col("min_x") / 30).cast("int").alias("cluster")


@report
def a35_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fires(spark, sf_dir, "num_fire", "t_ratio", _cluster()).filter("num_fire is not null")
    root = F.sqrt("num_fire")
    share = F.sum(F.when(F.col("t_ratio") > 1.5, root).otherwise(0.0)) / F.nullif(F.sum(root), F.lit(0.0))
    return f.groupBy("cluster").agg(
        N().alias("n"), R.counted(F.col("num_fire") >= 100).alias("n100"), R.counted(F.col("num_fire") >= 1000).alias("n1000"),
        F.round(share, 6).alias("tame_share"), F.round(N() / 0.9, 6).alias("density"),
    )


@report
def a36_region_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fires(spark, sf_dir, "t_ratio", _region(), _cluster()).filter("region_id is not null")
    tame = F.round(F.avg(F.when(F.col("t_ratio") > 1.5, 1.0).otherwise(0.0)), 6)
    return f.groupBy("region_id", "cluster").agg(N().alias("n"), F.when(N() >= 20, tame).alias("ratio"))


@report
def a38_cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fires(spark, sf_dir, "num_fire", F.col("avg_xy_neighbors").alias("v"), _cluster()).filter("num_fire is not null")
    at = lambda k: F.when(F.col("num_fire") >= k, F.col("v"))
    return f.groupBy("cluster").agg(F.round(F.avg(at(10)), 9).alias("mean_10"), F.round(F.avg(at(1000)), 9).alias("mean_1000"), F.max(at(10)).alias("max_10"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "raster").filter("cell_value is not null and not isnan(cell_value)")
    return r.select(F.floor(F.col("grid_row") / 64).cast("int").alias("tr"), F.floor(F.col("grid_col") / 64).cast("int").alias("tc"), F.col("cell_value").cast("int").alias("cluster"))


@report
def a39_tile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).groupBy("tr", "tc", "cluster").agg(N().alias("n"), F.round(N() / 4096, 6).alias("fraction"))


@report
def where19_mostly_covered_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tiles(spark, sf_dir).groupBy("tr", "tc").agg(N().alias("n")).filter(F.col("n") / 4096 > 0.15)
    return t.select("tr", "tc", (F.col("tr") * 64 + 32).alias("centre_row"), (F.col("tc") * 64 + 32).alias("centre_col"))


@report
def where18_burnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fires").filter("country is not null").select(_region(), F.when(F.col("t_ratio") > 1.5, 1.0).otherwise(0.0).alias("tame"))
    s = f.groupBy(F.col("region_id").alias("id")).agg(F.avg("tame").alias("ratio"))
    return s.select("id", F.round("ratio", 6).alias("ratio"), (F.col("ratio") <= 0.3).alias("burnable"))


@report
def a40_cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contingency_scores(table(spark, sf_dir, "events").select(F.expr("user_id % 7").alias("a"), "event_type"), "a", "event_type")


def _placed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    s = _samples(spark, sf_dir, "lon", "lat", *columns)
    return s.withColumn("lon", longitude()).withColumn("lat", latitude()).filter("lon is not null and lat is not null")


@report
def a42_sample_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by cells of three degrees and pairs of years that follow each other among those that occur."""
    s = materialize(_placed(spark, sf_dir, "dt").groupBy(
        F.floor(F.col("lon") / 3).cast("int").alias("x"), F.floor(F.col("lat") / 3).cast("int").alias("y"), F.year("dt").alias("yr")
    ).agg(N().alias("n")))
    # The years that occur, a handful, are numbered in one task.
    years = s.filter("yr is not null").select("yr").distinct().withColumn("pair", F.floor((F.row_number().over(Window.orderBy("yr")) - 1) / 2).cast("int"))
    return s.join(years, "yr").groupBy("pair", "x", "y").agg(F.sum("n").alias("n"))


@report
def a44_detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which each cell of a tenth of a degree burned."""
    at = lambda c: F.floor(F.round(F.col(c) * 10, 6)).cast("int")
    return _placed(spark, sf_dir, "dt").groupBy(at("lon").alias("x"), at("lat").alias("y")).agg(F.countDistinct("dt").alias("n"))


@report
def a53_patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and quartile of the metres that a pixel of a fire's patch covers, boxes across the date line unwrapped."""
    width = unwrapped_east() - F.col("min_x")
    m = _fires(spark, sf_dir, (width * 111.195 * F.cos(F.radians("min_y")) / 0.256).alias("m"))
    return m.agg(F.percentile("m", 0.5).alias("median"), F.percentile("m", 0.25).alias("q1"))


# ---- scores and exports of events


POSITIVE = ("error", "purchase")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _share(condition: Column) -> Column:
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 6)


@report
def a48_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, sf_dir).groupBy(F.expr("user_id % 5").alias("region_id")).agg(_share(kind.isin(*POSITIVE)).alias("positive"), _share(kind == "view").alias("nodata"))


@report
def a49_display_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.percentile("value", 0.02).alias("lo"), F.percentile("value", 0.98).alias("hi"))


@report
def a54_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.width_histogram(_events(spark, sf_dir).select("value"), "value", 10)


@report
def a33_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    std = F.round(F.greatest(F.stddev_pop("value"), F.lit(1e-6)), 6)
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("channel")).agg(F.round(F.avg("value"), 6).alias("mean"), std.alias("std"), N().alias("n"))


@report
def a47_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = R.counted(F.col("event_type").isin(*POSITIVE))
    mean = F.round(F.avg(F.when(F.col("event_type") != "signup", F.col("value") / 491)), 6)
    return _events(spark, sf_dir).groupBy(F.col("user_id").alias("sample_id")).agg(hit.alias("n_gt"), F.round(hit * 0.140625, 6).alias("area_km2"), mean.alias("mean_prob"))


# ---- joins on keys


@report
def j1_link_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("region_id"))
    links = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return links.groupBy("region_id").agg(F.countDistinct("l_orderkey").alias("n_images"), F.countDistinct("l_suppkey").alias("n_fires"))


@report
def j2_image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.countDistinct("l_suppkey").alias("n_fires"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderdate").alias("start_time"), F.floor("o_totalprice").cast("int").alias("num_fire_pixels"))
    return i.join(o, "image_id")


@report
def j14_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each image is at hand: it is marked so, or stands in the list of those fetched."""
    have = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id"), F.lit(True).alias("have")).distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderstatus") == "F").alias("marked"))
    return o.join(have, "image_id", "left").select("image_id", (F.col("marked") | F.coalesce("have", F.lit(False))).alias("at_hand"))


@report
def j15_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(open_, "l_orderkey", "left_semi")


@report
def j25_default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "regions").select("region_id", F.col("region_id").alias("region"))
    return _samples(spark, sf_dir, "region_id").join(known, "region_id", "left").select("sample_id", F.coalesce("region", F.lit(0)).alias("region"))


@report
def j30_density_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples find the centre of their fire's box."""
    f = table(spark, sf_dir, "fires").groupBy("fire_id").agg(F.max((F.col("min_x") + unwrapped_east()) / 2).alias("cx"))
    j = _samples(spark, sf_dir, "fire_id").join(f, "fire_id", "left")
    return j.agg(N().alias("n"), F.count("cx").alias("found"), (N() - F.count("cx")).alias("unknown"))


@report
def j11_enriched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fires").groupBy("fire_id").agg(F.max("num_fire").alias("detections"), F.max("end_date").alias("ended"))
    p = table(spark, sf_dir, "picked").select("fire_id", "day_t", "region_id", "fire_type").distinct()
    r = table(spark, sf_dir, "regions").select("region_id", "name")
    return p.join(f, "fire_id").join(r, "region_id", "left").select("fire_id", "day_t", "detections", "ended", "name")


# ---- sets and texts of rows


@report
def u3_union_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = F.element_at(F.array(*map(F.lit, ("veg", "static", "crop"))), F.col("fire_type") + 1)
    return table(spark, sf_dir, "picked").filter("fire_type between 0 and 2").select("fire_id", "day_t", pool.alias("pool")).distinct()


@report
def u4_needed_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that are needed and at hand, and those still missing."""
    need = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).distinct()
    have = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit(1).alias("have")).distinct()
    return need.join(have, "id", "left").select("id", F.when(F.col("have") == 1, "both").otherwise("missing").alias("kind"))


@report
def u6_event_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir, "fire_id", "xi", "yi").filter("fire_id is not null").select("fire_id", "xi", "yi").distinct()
    return s.groupBy("fire_id").agg(N().alias("n_tiles"))


@report
def where34_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "regions").select("region_id", "name")
    s = _samples(spark, sf_dir, "region_id", "source", "tile_key").join(names, "region_id", "left")
    hit = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(word) for c, word in (("name", "belt"), ("source", "field"), ("tile_key", "tile"))]
    return s.filter(hit[0] | hit[1] | hit[2]).select("sample_id")


@report
def where29_selected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "value")


@report
def where30_new_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, sf_dir).select("event_id", ((kind == "click") & (F.col("value") < 100)).alias("new_fire"), kind.isin("click", "error").alias("cur"))


@report
def where32_known_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_regionkey <> 0")
    return n.groupBy(F.col("n_regionkey").cast("string").alias("region")).agg(N().alias("n"))


@report
def t12_richest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir, "fire_id", "num_fire").filter("fire_id is not null")
    return R.best_rows(s, ["fire_id"], [-F.coalesce("num_fire", F.lit(-1)).cast("bigint"), F.col("load_order")], ["sample_id", "num_fire"])


@report
def t9_best_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the patches with at least half of their fire's largest footprint the one with the most active cells."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("fire"), "event_id", "value", F.expr("event_id % 97").alias("active"))
    top = e.groupBy("fire").agg(F.max("value").alias("top"))
    return R.best_rows(e.join(top, "fire").filter("value >= 0.5 * top"), ["fire"], [-F.col("active"), F.col("event_id")], ["event_id"])
