"""Scalar functions and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import scalars as S
from emberframe.registry import CORE
from emberframe.tables import COUNTING_SQL, EAST_SQL, LON_SQL, counting, latitude, longitude, table, unwrapped_east

CELL_SQL = "(375 / 111320::double)"

# ---- granule names: derived from orders, whose key stands for the image and whose date for its start

_NAME_SQL = """img as (select o_orderkey as image_id, case when o_orderkey % 10 = 9 then 'broken.' || o_orderkey else
'/data/VNP14IMG.A' || strftime(o_orderdate, '%Y%j') || '.' || lpad((o_orderkey % 24)::varchar, 2, '0') || '30.002.' || o_orderkey || '.nc' end as path from orders),
pre as (select image_id, path, case when len(string_split(regexp_extract(path, '[^/]*$'), '.')) >= 4 then
array_to_string(string_split(regexp_extract(path, '[^/]*$'), '.')[2:4], '.') end as prefix from img)"""


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(
        F.lit("/data/VNP14IMG.A"), F.date_format("o_orderdate", "yyyyDDD"), F.lit("."), F.lpad((k % 24).cast("string"), 2, "0"),
        F.lit("30.002."), k.cast("string"), F.lit(".nc"),
    )
    path = F.when(k % 10 == 9, F.concat(F.lit("broken."), k.cast("string"))).otherwise(name)
    return table(spark, sf_dir, "orders").select(k.alias("image_id"), path.alias("path")).withColumn("prefix", S.granule_prefix("path"))


@CORE.query("f1_granule_prefix", f"with {_NAME_SQL} select image_id, prefix from pre")
def f1_granule_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return granules(spark, sf_dir).select("image_id", "prefix")


@CORE.query("f2_prefix_date", f"with {_NAME_SQL} select image_id, make_date(substr(prefix, 2, 4)::integer, 1, 1) + substr(prefix, 6, 3)::integer - 1 as day from pre where prefix is not null")
def f2_prefix_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return granules(spark, sf_dir).filter("prefix is not null").select("image_id", S.prefix_date("prefix").alias("day"))


@CORE.query(
    "f3_prefixes_by_date",
    f"""with {_NAME_SQL}, d as (select distinct prefix, make_date(substr(prefix, 2, 4)::integer, 1, 1) + substr(prefix, 6, 3)::integer - 1 as day from pre where prefix is not null)
select day, count(*) as n, array_to_string(list_sort(list(prefix)), ' ') as prefixes from d group by 1""",
)
def f3_prefixes_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = granules(spark, sf_dir).filter("prefix is not null").select("prefix").distinct().withColumn("day", S.prefix_date("prefix"))
    return g.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(" ", F.array_sort(F.collect_list("prefix"))).alias("prefixes"))


@CORE.query(
    "j35_granule_pairs",
    f"""with {_NAME_SQL}, a as (select distinct prefix from pre where image_id % 2 = 0), b as (select distinct prefix from pre where image_id % 3 = 0)
select count(*) filter (where a.prefix is not null and b.prefix is not null) as paired, count(*) filter (where b.prefix is null and a.prefix is not null) as only_mask,
count(*) filter (where a.prefix is null and b.prefix is not null) as only_geo from a full join b on a.prefix = b.prefix""",
)
def j35_granule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire-mask and geolocation granules paired by prefix, the unmatched counted."""
    g = granules(spark, sf_dir).filter("prefix is not null")
    a = g.filter("image_id % 2 = 0").select("prefix").distinct().withColumn("a", F.lit(1))
    b = g.filter("image_id % 3 = 0").select("prefix").distinct().withColumn("b", F.lit(1))
    return a.join(b, "prefix", "full").agg(
        F.count(F.when(F.expr("a = 1 and b = 1"), 1)).alias("paired"), F.count(F.when(F.expr("a = 1 and b is null"), 1)).alias("only_mask"),
        F.count(F.when(F.expr("a is null and b = 1"), 1)).alias("only_geo"),
    )


# ---- places and light

_S_SQL = f"s as (select sample_id, ln, lat, dt, hour(loaded_at) + minute(loaded_at) / 60.0 as h, dayofyear(dt) as doy from (select *, {LON_SQL} as ln from {COUNTING_SQL}) where ln is not null and lat is not null)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "lon", "lat", "dt"))
    hour = F.hour("loaded_at") + F.minute("loaded_at") / 60.0
    out = s.select("sample_id", longitude().alias("ln"), latitude().alias("lat"), "dt", hour.alias("h"), F.dayofyear("dt").alias("doy"))
    return out.filter("ln is not null and lat is not null")


@CORE.query("f4_day_pass", f"with {_S_SQL}, l as (select *, h + ln / 15.0 as x from s) select sample_id, x - 24 * floor(x / 24) >= 6 and x - 24 * floor(x / 24) < 18 as is_day from l")
def f4_day_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("sample_id", S.is_day_pass(F.col("h"), "ln").alias("is_day"))


@CORE.query(
    "f5_well_lit",
    f"""with {_S_SQL}, d as (select *, h + ln / 15.0 as x, -tan(radians(lat)) * tan(radians(-23.45 * cos(radians(360.0 / 365.0 * (doy + 10))))) as c from s),
e as (select *, x - 24 * floor(x / 24) as l, case when c < -1 then 10.0 when c > 1 then null else degrees(acos(greatest(-1, least(1, c)))) / 15.0 end as half from d)
select sample_id, coalesce(l >= 12 - half + 1.5 and l <= 12 + half - 1.5, false) as well_lit from e""",
)
def f5_well_lit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("sample_id", S.is_well_lit(F.col("h"), F.col("doy"), "ln", "lat").alias("well_lit"))


@CORE.query("f6_grid_cells", f"with {_S_SQL} select sample_id, round_even((ln + 180) / {CELL_SQL}, 0)::integer as x, round_even((lat + 90) / {CELL_SQL}, 0)::integer as y from s")
def f6_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = S.to_cell("ln", "lat")
    return _placed(spark, sf_dir).select("sample_id", F.bround(x).cast("int").alias("x"), F.bround(y).cast("int").alias("y"))


@CORE.query(
    "f7_padded_boxes",
    f"""with b as (select distinct fire_id, round_even((min_x + 180) / {CELL_SQL}, 0)::integer as x0, round_even((min_y + 90) / {CELL_SQL}, 0)::integer as y0,
round_even(({EAST_SQL} + 180) / {CELL_SQL}, 0)::integer as x1, round_even((max_y + 90) / {CELL_SQL}, 0)::integer as y1 from fires), p as (select *, (256 - ((x1 + 1 - x0) % 256)) % 256 as px, (256 - ((y1 + 1 - y0) % 256)) % 256 as py from b)
select fire_id, (x0 - (px // 2 + 16))::bigint as x0, (y0 - (py // 2 + 16))::bigint as y0, (x1 + 1 + px - px // 2 + 16)::bigint as x1, (y1 + 1 + py - py // 2 + 16)::bigint as y1 from p""",
)
def f7_padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded boxes in cells, a multiple of 256 a side; the cells of a box across the date line are counted on beyond it."""
    return _padded(table(spark, sf_dir, "fires"), unwrapped_east())


def _padded(f: DataFrame, east: Column) -> DataFrame:
    box = S.bbox_cells(F.col("min_x"), F.col("min_y"), east, F.col("max_y"))
    f = f.select("fire_id", *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))]).distinct()
    out = S.padded_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return f.select("fire_id", *[c.cast("bigint").alias(n) for c, n in zip(out, ("x0", "y0", "x1", "y1"))])


@CORE.query(
    "f8_footprints",
    f"""with {_S_SQL}, z as (select sample_id, lat, (sample_id % 113) - 56.0 as v from s)
select sample_id, round(case when abs(v) <= 31.72 then 3 when abs(v) <= 44.86 then 2 else 1 end * 129.3 / pow(cos(radians(v)), 2) / (2 * pi() * 6371008.8 / 360 * cos(radians(lat))), 9) as dx,
round(371.0 / cos(radians(v)) / (2 * pi() * 6371008.8 / 360), 9) as dy from z""",
)
def f8_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _placed(spark, sf_dir).withColumn("v", (F.col("sample_id") % 113) - F.lit(56.0))
    dx, dy = S.footprint_degrees("lat", "v")
    return s.select("sample_id", F.round(dx, 9).alias("dx"), F.round(dy, 9).alias("dy"))


@CORE.query(
    "f9_areas",
    f"""select distinct fire_id, round(num_fire * (375 * 375 / 1e6::double), 6) as flat_km2,
round(num_cells * pow({CELL_SQL} * 111, 2) * cos(radians((min_y + max_y) / 2)), 6) as km2 from fires where num_fire is not null""",
)
def f9_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fires").filter("num_fire is not null")
    return f.select(
        "fire_id", F.round(S.flat_km2("num_fire"), 6).alias("flat_km2"),
        F.round(S.latitude_km2("num_cells", (F.col("min_y") + F.col("max_y")) / 2), 6).alias("km2"),
    ).distinct()


@CORE.query("f10_kernels", f"with {_S_SQL}, k as (select sample_id, ceil(3.0 / cos(radians(abs(lat))))::integer as k from s) select sample_id, greatest(3, case when k % 2 = 0 then k + 1 else k end)::integer as kernel from k")
def f10_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("sample_id", S.kernel_size("lat").alias("kernel"))


@CORE.query("f24_date_line", "select distinct fire_id, min_x > max_x as crosses, round(case when min_x > max_x then max_x - min_x + 360 else max_x - min_x end, 6) as width from fires")
def f24_date_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    crosses = S.crosses_date_line("min_x", "max_x")
    width = F.col("max_x") - F.col("min_x")
    f = table(spark, sf_dir, "fires")
    return f.select("fire_id", crosses.alias("crosses"), F.round(F.when(crosses, width + 360).otherwise(width), 6).alias("width")).distinct()


@CORE.query(
    "f27_coarse_cells",
    f"""with {_S_SQL} select trunc((ln + 180) / 45)::integer as xi, trunc((lat + 90) / 45)::integer as yi, count(*) as n,
greatest(-180, -180 + trunc((ln + 180) / 45)::integer * 45.0 - 1)::double as west from s group by 1, 2""",
)
def f27_coarse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    xi, yi = S.coarse_cell("ln", "lat")
    s = _placed(spark, sf_dir).groupBy(xi.alias("xi"), yi.alias("yi")).agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("west", S.coarse_extent(F.col("xi"), F.col("yi"))[0])


#: A fixed polygon for the point-in-polygon query.
RING = [(-125.0, 30.0), (-100.0, 45.0), (-60.0, -30.0), (-120.0, -5.0)]


@CORE.query(
    "f23_in_polygon",
    f"""with {_S_SQL}, e as (select * from (values (-125.0::double, 30.0::double, -100.0::double, 45.0::double), (-100, 45, -60, -30), (-60, -30, -120, -5), (-120, -5, -125, 30)) v(ax, ay, cx, cy))
select sample_id, count(*) filter (where (ay > lat) <> (cy > lat) and ln < (cx - ax) * (lat - ay) / nullif(cy - ay, 0) + ax) % 2 = 1 as inside from s, e group by 1""",
)
def f23_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    return _placed(spark, sf_dir).select("sample_id", S.in_polygon("ln", "lat", ring).alias("inside"))


@CORE.query(
    "f29_metres_per_pixel",
    f"select distinct fire_id, round(sqrt(pow(({EAST_SQL} - min_x) * 2 * pi() * 6371000 / 360 * cos(radians((min_y + max_y) / 2)), 2) + pow((max_y - min_y) * 2 * pi() * 6371000 / 360, 2)) / 256, 6) as mpp from fires",
)
def f29_metres_per_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres a pixel of each fire's patch covers, boxes across the date line being unwrapped."""
    return _metres(table(spark, sf_dir, "fires"), unwrapped_east())


def _metres(f: DataFrame, east: Column) -> DataFrame:
    mpp = S.metres_per_pixel(east - F.col("min_x"), F.col("max_y") - F.col("min_y"), (F.col("min_y") + F.col("max_y")) / 2, F.lit(256))
    return f.select("fire_id", F.round(mpp, 6).alias("mpp")).distinct()


@CORE.query("f28_sample_years", f"with {_S_SQL} select sample_id, round(year(dt) - 2000 + (doy - 1) / 365.25, 6)::double as years, 20.5 < year(dt) - 2000 + (doy - 1) / 365.25 as imagery_predates from s")
def f28_sample_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = S.years_since_2000("dt")
    return _placed(spark, sf_dir).select("sample_id", F.round(y, 6).alias("years"), (F.lit(20.5) < y).alias("imagery_predates"))


@CORE.query("f11_sample_ids", f"select sample_id, concat_ws('_', fire_id, xi, yi, dt::varchar) as key, round(lon - img_size * {CELL_SQL} / 2, 6) as west, round(lat + img_size * {CELL_SQL} / 2, 6) as north from {COUNTING_SQL}")
def f11_sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counting(table(spark, sf_dir, "samples"))
    half = F.col("img_size") * S.CELL_DEG / 2
    return s.select(
        "sample_id", F.concat_ws("_", "fire_id", "xi", "yi", F.col("dt").cast("string")).alias("key"),
        F.round(F.col("lon") - half, 6).alias("west"), F.round(F.col("lat") + half, 6).alias("north"),
    )


# ---- weather: events give a value per day and user

_W_SQL = "w as (select event_id, value / 8 - 10 as temp, value / 10 - 12 as dew, value / 500 as soil, (value - 245) / 10 as u, (event_id % 41 - 20) / 2.0 as v from events)"


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", (v / 8 - 10).alias("temp"), (v / 10 - 12).alias("dew"), (v / 500).alias("soil"), ((v - 245) / 10).alias("u"),
        ((F.col("event_id") % 41 - 20) / 2.0).alias("v"),
    )


@CORE.query(
    "f12_vapour_deficit",
    f"with {_W_SQL}, c as (select event_id, greatest(-90, least(60, temp)) as t, greatest(-90, least(60, dew)) as d from w) select event_id, round(greatest(0, 0.6108 * exp(17.27 * t / (t + 237.3)) - 0.6108 * exp(17.27 * d / (d + 237.3))), 6) as vpd from c",
)
def f12_vapour_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weather(spark, sf_dir).select("event_id", F.round(S.vapour_deficit("temp", "dew"), 6).alias("vpd"))


@CORE.query("f13_ratio_anomaly", f"with {_W_SQL} select event_id, round(greatest(0.2, least(3.0, soil / greatest(abs(soil - 0.4), 0.05))), 6)::double as anomaly from w")
def f13_ratio_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weather(spark, sf_dir).select("event_id", F.round(S.ratio_anomaly("soil", F.col("soil") - 0.4), 6).alias("anomaly"))


@CORE.query("f14_wind", f"with {_W_SQL} select event_id, round(sqrt(u * u + v * v), 6) as speed, round(sin(atan2(v, u)), 6) + 0.0 as wind_sin, round(cos(atan2(v, u)), 6) + 0.0 as wind_cos from w")
def f14_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed, s, c = S.wind("u", "v")
    return _weather(spark, sf_dir).select("event_id", F.round(speed, 6).alias("speed"), (F.round(s, 6) + 0.0).alias("wind_sin"), (F.round(c, 6) + 0.0).alias("wind_cos"))


@CORE.query(
    "f15_percentile_rank",
    """with h as (select user_id, value, event_id from events) select a.event_id, round(100.0 * count(*) filter (where b.value <= a.value) / count(*), 6)::double as pct
from h a join h b on a.user_id = b.user_id group by 1, a.value""",
)
def f15_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a user's values up to each value: one sort per user, no pairs."""
    from pyspark.sql import Window

    # cume_dist over the user's values is the share of values up to and with this one.
    share = F.cume_dist().over(Window.partitionBy("user_id").orderBy("value"))
    return table(spark, sf_dir, "events").select("event_id", F.round(100.0 * share, 6).alias("pct"))


@CORE.query(
    "f16_piecewise_percentile",
    f"""with {_W_SQL}, p as (select event_id, soil as x, 0.1 as a, 0.25 as b, 0.5 as c, 0.7 as d, 0.9 as e from w)
select event_id, round(greatest(0, least(100, case when x <= a then 10 * x / a when x <= b then 10 + (x - a) / (b - a) * 15 when x <= c then 25 + (x - b) / (c - b) * 25
when x <= d then 50 + (x - c) / (d - c) * 25 when x <= e then 75 + (x - d) / (e - d) * 15 else 90 + 10 * least(1, (x - e) / e) end)), 6)::double as pct from p""",
)
def f16_piecewise_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = [F.lit(x) for x in (0.1, 0.25, 0.5, 0.7, 0.9)]
    return _weather(spark, sf_dir).select("event_id", F.round(S.piecewise_percentile("soil", t), 6).alias("pct"))


@CORE.query("f17_int16", f"with {_W_SQL}, q as (select event_id, round((temp + 60) / 120 * 32767)::integer as q from w) select event_id, q, round(q / 32767::double * 120 - 60, 6) as back from q")
def f17_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _weather(spark, sf_dir).select("event_id", S.quantize("temp", -60.0, 60.0, 32767).alias("q"))
    return w.withColumn("back", F.round(S.dequantize("q", -60.0, 60.0, 32767), 6))


@CORE.query(
    "f17_embedding_bytes",
    """with e as (select vec_id, unnest(embedding)::double as x from embeddings), q as (select vec_id, round_even((greatest(-0.6, least(0.6, x)) + 0.6) / (0.6 - -0.6) * 254, 0)::integer as q from e)
select vec_id, sum(q)::bigint as total, min(q) as least, max(q) as most from q group by 1""",
)
def f17_embedding_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").select("vec_id", S.quantize_array("embedding", -0.6, 0.6).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return q.select("vec_id", total.alias("total"), F.array_min("q").alias("least"), F.array_max("q").alias("most"))


# ---- labels of fires

_F_SQL = "f as (select distinct * from fires where num_fire is not null)"


def _fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fires").filter("num_fire is not null").distinct()


@CORE.query(
    "where26_size_buckets",
    f"""with {_F_SQL} select fire_id, case when num_fire < 100 then 'tiny' when num_fire < 1000 then 'small' when num_fire < 10000 then 'medium' else 'large' end as a,
case when num_fire < 100 then '<100' when num_fire < 1000 then '100-1000' when num_fire < 10000 then '1000-10000' else '>10000' end as b,
case when num_fire < 500 then '< 500' when num_fire < 5000 then '500–5k' else '5k+' end as c from f""",
)
def where26_size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fires(spark, sf_dir).select("fire_id", S.size_class("num_fire").alias("a"), S.size_range("num_fire").alias("b"), S.size_panel("num_fire").alias("c"))


_TAME_SQL = f"""{_F_SQL}, t as (select *, num_fire >= 100 and (t_ratio > 1.5 or (avg_xy_neighbors <= 12 and ignition_ratio * 100 >= 2)) as tame,
num_cells * pow({CELL_SQL} * 111, 2) * cos(radians((min_y + max_y) / 2)) as km2 from f)"""


@CORE.query("where24_tame_wild", f"with {_TAME_SQL} select fire_id, tame, num_fire >= 100 and not tame and avg_xy_neighbors >= 17 and t_ratio < 0.75 and km2 >= 1 as wild from t")
def where24_tame_wild(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, xy, ign, t = (F.col(c) for c in ("num_fire", "avg_xy_neighbors", "ignition_ratio", "t_ratio"))
    km2 = S.latitude_km2("num_cells", (F.col("min_y") + F.col("max_y")) / 2)
    return _fires(spark, sf_dir).select("fire_id", S.is_tame(n, xy, ign, t).alias("tame"), S.is_wild(n, xy, ign, t, km2).alias("wild"))


@CORE.query("where4_filtered_fires", f"with {_F_SQL} select fire_id from f where not (t_ratio > 0.7 or (ignition_ratio * 100 > 1 and avg_xy_neighbors < 17))")
def where4_filtered_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fires(spark, sf_dir).filter("not (t_ratio > 0.7 or (ignition_ratio * 100 > 1 and avg_xy_neighbors < 17))").select("fire_id")


@CORE.query("where3_size_tiers", f"with {_F_SQL}, k as (select unnest([10, 100, 1000, 10000]) as least) select least, count(*) as n, sum(num_fire)::bigint as detections from f, k where num_fire >= least group by 1")
def where3_size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of fires with at least 10, 100, 1000 and 10000 detections; a fire is in every tier it reaches."""
    tiers = F.array(*[F.lit(k) for k in (10, 100, 1000, 10000)])
    t = _fires(spark, sf_dir).withColumn("least", F.explode(F.filter(tiers, lambda k: F.col("num_fire") >= k)))
    return t.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.sum("num_fire").alias("detections"))


#: Stand-in land cover, by fire.
CLASSES = ("Cropland", "Grass", "Shrub", "Forest", "Urban", "water", "Bare", "Ocean")


FIRE_TYPES_SQL = """with f as (select distinct fire_id, num_fire, t_ratio from fires where fire_id is not null), g as (select fire_id, max(region_id) as region_id from samples where fire_id is not null group by 1),
c as (select f.fire_id, t_ratio, g.region_id, ['Cropland', 'Grass', 'Shrub', 'Forest', 'Urban', 'water', 'Bare', 'Ocean'][f.fire_id % 8 + 1] as lc from f left join g using (fire_id))
select c.fire_id, lc, case when t_ratio > 10 and not isnan(t_ratio) then 1 when lower(lc) in ('urban', 'ocean', 'bare', 'water') then 1
when list_contains(str_split(lower(array_to_string(exclude_lc, '|')), '|'), lower(lc)) then 1
when lc = 'Cropland' and coalesce(crop_is_veg, false) then 0 when lc = 'Cropland' then 2 else 0 end as fire_type from c left join regions r on r.region_id = c.region_id"""


def covered_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fire_id, t_ratio, region_id, lc) of every fire."""
    f = table(spark, sf_dir, "fires").filter("fire_id is not null").select("fire_id", "num_fire", "t_ratio").distinct()
    g = table(spark, sf_dir, "samples").filter("fire_id is not null").groupBy("fire_id").agg(F.max("region_id").alias("region_id"))
    lc = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("fire_id") % len(CLASSES) + 1).cast("int"))
    return f.join(g, "fire_id", "left").withColumn("lc", lc)


@CORE.query("where20_fire_types", FIRE_TYPES_SQL)
def where20_fire_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire type by land cover, the rules of its region, and persistence; unknown regions get the common rules."""
    c = covered_fires(spark, sf_dir).join(table(spark, sf_dir, "regions"), "region_id", "left")
    kind = S.fire_type(F.col("lc"), F.col("t_ratio"), F.col("exclude_lc"), F.col("crop_is_veg"))
    return c.select("fire_id", "lc", kind.alias("fire_type"))


@CORE.query(
    "where8_region_filter",
    f"select sample_id, region_id from {COUNTING_SQL} where region_id in (select region_id from regions where name in ('Cinder Coast', 'Miombo Belt'))",
)
def where8_region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of named regions; a name that the dimension doesn't have raises."""
    return filter_regions(
        counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "region_id")), table(spark, sf_dir, "regions"),
        include=["Cinder Coast", "Miombo Belt"],
    ).select("sample_id", "region_id")


def filter_regions(df: DataFrame, regions: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows of the included regions or, where none are named, of all but the excluded; neither gives df as it is."""
    names = include or exclude
    if not names:
        return df
    ids = {r["name"]: r["region_id"] for r in regions.filter(F.col("name").isin(names)).select("name", "region_id").collect()}
    if lost := [n for n in names if n not in ids]:
        raise ValueError(f"unknown regions: {lost}")
    hit = F.col("region_id").isin(list(ids.values()))
    return df.filter(hit if include else F.coalesce(~hit, F.lit(True)))


@CORE.query("where11_days_per_fire", f"with s as (select fire_id, dt, sample_id from {COUNTING_SQL}), k as (select fire_id from s where fire_id is not null group by 1 having count(distinct dt) >= 3) select sample_id from s where fire_id in (select fire_id from k)")
def where11_days_per_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id", "dt"))
    k = s.groupBy("fire_id", "dt").count().groupBy("fire_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return s.join(k, "fire_id", "left_semi").select("sample_id")


@CORE.query("where12_since_year", f"select sample_id, dt from {COUNTING_SQL} where year(dt) >= 2021")
def where12_since_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "dt")).filter(F.year("dt") >= 2021).select("sample_id", "dt")


@CORE.query("where10_without_bad_fires", f"select sample_id, fire_id from {COUNTING_SQL} where fire_id is null or fire_id not in (select fire_id from fires where ignition_ratio > 0.6)")
def where10_without_bad_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id"))
    return s.join(table(spark, sf_dir, "fires").filter("ignition_ratio > 0.6"), "fire_id", "left_anti").select("sample_id", "fire_id")


@CORE.query(
    "where14_modal_shape",
    """with s as (select o_orderpriority as field, o_orderkey as id, count(*) as shape from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
m as (select field, shape, row_number() over (partition by field order by count(*) desc, shape) as rn from s group by 1, 2)
select s.field, s.id, s.shape from s join m on s.field = m.field and s.shape = m.shape and rn = 1""",
)
def where14_modal_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field, the records that have its most frequent shape."""
    from emberframe.operators.coverage import modal_group

    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("shape"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field"), F.col("o_orderkey").alias("id"))
    s = o.join(n, "id")
    return s.join(modal_group(s, "field", "shape").drop("n"), ["field", "shape"], "left_semi").select("field", "id", "shape")


@CORE.query(
    "where16_valid_fraction",
    """with o as (select l_suppkey as sample_id, l_linenumber + 2 as obs, l_quantity as q from lineitem),
f as (select sample_id, avg(case when obs in (3, 5, 7, 8, 9) and q > 10 then 1.0 else 0.0 end) as valid from o group by 1) select sample_id, round(valid, 6)::double as valid from f where valid >= 0.10""",
)
def where16_valid_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample_id"), (F.col("l_linenumber") + 2).alias("obs"), F.col("l_quantity").alias("q"))
    ok = S.is_clear("obs") & (F.col("q") > 10)
    return o.groupBy("sample_id").agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("valid")).filter("valid >= 0.10")


@CORE.query(
    "r4_priority_merge",
    """with o as (select l_orderkey as cell, l_linenumber + 2 as obs from lineitem),
k as (select cell, max(case when obs in (4, 6) then 1 when obs in (3, 5) then 2 when obs in (7, 8, 9) then 3 else 0 end * 256 + obs) as k from o group by 1) select cell, (k % 256)::integer as obs from k""",
)
def r4_priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of several passes merged by tier, then value: an algebraic maximum."""
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_linenumber") + 2).alias("obs"))
    return o.groupBy("cell").agg(F.max(S.priority_key("obs")).alias("k")).select("cell", (F.col("k") % 256).cast("int").alias("obs"))


# ---- texts of reports

@CORE.query(
    "f18_training_scale",
    """with n as (select distinct l_suppkey as id, count(*) over (partition by l_suppkey) as n from lineitem)
select id, n, case when n >= 20000 or n = 0 then 15 else greatest(15, least(100, round_even(15 * pow(20000.0 / n, 0.25), 0)))::integer end as epochs,
case when n >= 20000 or n = 0 then 5 else greatest(5, least(30, round_even(5 * pow(20000.0 / n, 0.25), 0)))::integer end as patience from n""",
)
def f18_training_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    e, p = S.scaled_training("n")
    return n.select("id", "n", e.alias("epochs"), p.alias("patience"))


@CORE.query(
    "f22_number_texts",
    """select event_id, case when substr(printf('%.3f', value / 491), 1, 2) = '0.' then substr(printf('%.3f', value / 491), 2) else printf('%.3f', value / 491) end as score,
format('{:,}', round_even(value * 1000, 0)::bigint) as n, case when value >= 200 then '+' else '$-$' end ||
case when substr(printf('%.3f', abs(value - 200) / 491), 1, 2) = '0.' then substr(printf('%.3f', abs(value - 200) / 491), 2) else printf('%.3f', abs(value - 200) / 491) end as delta from events""",
)
def f22_number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", S.score_text(F.col("value") / 491).alias("score"), S.count_text(F.col("value") * 1000).alias("n"),
        S.delta_text((F.col("value") - 200) / 491).alias("delta"),
    )


@CORE.query("f21_slugs", "select region_id, replace(replace(lower(name), ' ', '_'), '/', '_') as slug, case when region_id % 2 = 0 then 'nf' else 'nm' end as target from regions")
def f21_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("region_id") % 2 == 0, "new_fires").otherwise("next_mask")
    return table(spark, sf_dir, "regions").select("region_id", S.slug("name").alias("slug"), S.short_target(t).alias("target"))


def _escape_sql(x: str) -> str:
    for a, b in S.ESCAPES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@CORE.query("f30_escaped_texts", f"select doc_id, md5({_escape_sql('text')}) as escaped from documents")
def f30_escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.escaped("text").cast("binary")).alias("escaped"))


@CORE.query("f31_file_status", "select o_orderkey as id, case when o_orderstatus = 'P' then 'pending' when o_orderpriority = '5-LOW' then 'missing' when o_totalprice > 100000 then 'valid' else 'invalid' end as status from orders")
def f31_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_totalprice") > 100000)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.file_status(F.col("o_orderstatus") == "P", size, F.lit(True)).alias("status"))


@CORE.query("f32_region_names", f"select sample_id, coalesce(short_name, 'unknown_' || coalesce(s.region_id, 0)) as region from {COUNTING_SQL} s left join regions r on s.region_id = r.region_id")
def f32_region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "region_id"))
    return s.join(table(spark, sf_dir, "regions"), "region_id", "left").select("sample_id", S.region_label(F.col("short_name"), F.col("region_id")).alias("region"))


@CORE.query("f25_channel_ranges", "select region_id, len(exclude_lc) as channels, (sum(len(exclude_lc)) over (order by region_id) - len(exclude_lc))::bigint as first, sum(len(exclude_lc)) over (order by region_id)::bigint as last from regions")
def f25_channel_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of channels by field: running sums over one row per field."""
    from pyspark.sql import Window

    n = F.size("exclude_lc")
    total = F.sum(n).over(Window.orderBy("region_id"))
    return table(spark, sf_dir, "regions").select("region_id", n.cast("bigint").alias("channels"), (total - n).alias("first"), total.alias("last"))


@CORE.query("f26_normalized", "with s as (select event_type, avg(value) as m, stddev_pop(value) as d from events where event_type <> 'view' group by 1) select event_id, round(coalesce((value - m) / greatest(d, 1e-6), value), 6) as z from events left join s using (event_type)")
def f26_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by the mean and deviation of their channel; a channel without statistics stays as it is."""
    e = table(spark, sf_dir, "events")
    s = e.filter("event_type <> 'view'").groupBy("event_type").agg(F.avg("value").alias("m"), F.greatest(F.stddev_pop("value"), F.lit(1e-6)).alias("d"))
    return e.join(s, "event_type", "left").select("event_id", F.round(F.coalesce((F.col("value") - F.col("m")) / F.col("d"), F.col("value")), 6).alias("z"))


@CORE.query("f34_colour_parameter", "select event_id, round(least(1, greatest(0, value / 491 / 0.4)), 6) as colour from events")
def f34_colour_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(S.clip(F.col("value") / 491 / 0.4, 0.0, 1.0), 6).alias("colour"))
