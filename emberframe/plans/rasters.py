"""Raster operators over patches; the events table stands in: user is the patch, value and number give the cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators import raster as R
from emberframe.operators.rings import overlapping_boxes, round_bins
from emberframe.registry import CORE
from emberframe.session import materialize
from emberframe.tables import COUNTING_SQL, EAST_SQL, LON_SQL, counting, latitude, longitude, table, unwrapped_east

_CELLS_SQL = """c as (select user_id as p, floor(value / 16)::integer as r, (event_id * 7 % 32)::integer as k, min(event_id) as id, max(value) as v from events group by 1, 2, 3)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("p"), F.floor(F.col("value") / 16).cast("int").alias("row"), F.expr("event_id * 7 % 32").cast("int").alias("col")
    ).agg(F.min("event_id").alias("id"), F.max("value").alias("value"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("p"), (F.col("value") / 16).alias("y"), (F.col("event_id") * 7 % 321 / 10.0).alias("x"), F.col("value"), F.col("event_id").alias("src")
    )


_PROJECT_SQL = """e as (select user_id as p, value / 16 as y, event_id * 7 % 321 / 10.0::double as x, value, event_id as src from events),
q as (select p, floor(y)::integer + i as r, floor(x)::integer + j as k, value, src, sqrt(pow(floor(y) + i + 0.5 - y, 2) + pow(floor(x) + j + 0.5 - x, 2)) as d
from e, (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j))"""


@CORE.query("r1_project_nearest", f"with {_PROJECT_SQL} select p, r as row, k as col, value from (select *, row_number() over (partition by p, r, k order by d, src) as rn from q) where rn = 1")
def r1_project_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(_points(spark, sf_dir), ["p"], 1, "nearest")


@CORE.query("r1_project_inverse", f"with {_PROJECT_SQL} select p, r as row, k as col, round(sum(value / greatest(d, 1e-9)) / sum(1 / greatest(d, 1e-9)), 5) as value from q group by 1, 2, 3")
def r1_project_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(_points(spark, sf_dir), ["p"], 1, "inv_dist").withColumn("value", F.round("value", 5))


@CORE.query("r1_project_max", f"with {_PROJECT_SQL} select p, r as row, k as col, max(value) as value from q group by 1, 2, 3")
def r1_project_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(_points(spark, sf_dir), ["p"], 1, "max")


@CORE.query(
    "r3_fill_holes",
    f"""with {_CELLS_SQL}, g as (select distinct c.p, a.r, b.k from c, (select unnest(generate_series(0, 31))::integer as r) a, (select unnest(generate_series(0, 31))::integer as k) b),
h as (select g.* from g left join c using (p, r, k) where c.id is null), n as (select h.p, h.r, h.k, c.v, row_number() over (partition by h.p, h.r, h.k order by pow(c.r - h.r, 2) + pow(c.k - h.k, 2), c.r, c.k) as rn
from h join c on c.p = h.p and abs(c.r - h.r) <= 2 and abs(c.k - h.k) <= 2) select p, r as row, k as col, v as value from n where rn = 1""",
)
def r3_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = materialize(patches(spark, sf_dir))
    side = F.explode(F.sequence(F.lit(0), F.lit(31)))
    grid = c.select("p").distinct().select("p", side.alias("row")).select("p", "row", side.alias("col"))
    return R.fill_holes(c, grid, ["p"], 2)


@CORE.query(
    "r5_ring",
    f"""with {_CELLS_SQL}, d as (select distinct p, r + i as r, k + j as k from c, (select unnest([-2, -1, 0, 1, 2]) as i), (select unnest([-2, -1, 0, 1, 2]) as j) where i * i + j * j <= 4 and r + i between 0 and 31 and k + j between 0 and 31)
select d.p, d.r as row, d.k as col from d left join c using (p, r, k) where c.id is null""",
)
def r5_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that dilation by a disk of radius 2 adds."""
    return R.ring(materialize(patches(spark, sf_dir).select("p", "row", "col")), ["p"], 2, 32, 32)


@CORE.query(
    "r6_closing",
    f"""with {_CELLS_SQL}, d as (select p, r + i as r, k + j as k, id, row_number() over (partition by p, r + i, k + j order by i * i + j * j, r, k) as rn from c, (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j)
where r + i between 0 and 31 and k + j between 0 and 31), u as (select p, r, k, id from d where rn = 1),
e as (select p, r + i as r, k + j as k from u, (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j) group by 1, 2, 3 having count(*) = 9)
select p, r as row, k as col, id from c union all select u.p, u.r, u.k, u.id from u join e using (p, r, k) left join c using (p, r, k) where c.id is null""",
)
def r6_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.closing(materialize(patches(spark, sf_dir)), ["p"], 32, 32)


_SMALL_SQL = "s as (select user_id as p, floor(value / 62)::integer as r, (event_id % 8)::integer as k, max(value) as v from events group by 1, 2, 3)"


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("p"), F.floor(F.col("value") / 62).cast("int").alias("row"), F.expr("event_id % 8").cast("int").alias("col")).agg(F.max("value").alias("value"))


@CORE.query(
    "r7_bilinear",
    f"""with {_SMALL_SQL}, f as (select unnest(generate_series(0, 31))::integer as a), w as (select a, b, greatest(0, 1 - abs(greatest(0, least(7, (a + 0.5) / 4 - 0.5)) - b)) as w from f, (select unnest(generate_series(0, 7))::integer as b))
select s.p, y.a as row, x.a as col, round(sum(y.w * x.w * v)::double, 9) as value from s join w y on y.b = s.r join w x on x.b = s.k where y.w > 0 and x.w > 0 group by 1, 2, 3""",
)
def r7_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 patches on a grid four times as fine; cells without a value weigh as zeros."""
    return R.upsample_bilinear(_small(spark, sf_dir), ["p"], 4, 8, 8).withColumn("value", F.round("value", 9))


@CORE.query("r8_nearest_upsample", f"with {_SMALL_SQL} select p, (r * 3 + i)::integer as row, (k * 3 + j)::integer as col, v as value from s, (select unnest([0, 1, 2]) as i), (select unnest([0, 1, 2]) as j)")
def r8_nearest_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.upsample_nearest(_small(spark, sf_dir), ["p"], 3)


@CORE.query("r15_max_pool", f"with {_SMALL_SQL} select p, (r + i)::integer as row, (k + j)::integer as col, max(v) as value from s, (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j) group by 1, 2, 3")
def r15_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.max_pool(_small(spark, sf_dir), ["p"])


@CORE.query("r19_block_mean", f"with {_CELLS_SQL} select p, floor(r / 4)::integer as row, floor(k / 4)::integer as col, round(avg(v), 6) as value from c group by 1, 2, 3")
def r19_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.block_mean(patches(spark, sf_dir), ["p"], 4).withColumn("value", F.round("value", 6))


@CORE.query(
    "a41_region_blocks",
    """with n as (select layer, floor(grid_row / 4)::integer as r, floor(grid_col / 4)::integer as k, cell_value as v, count(*) as n from raster where cell_value is not null group by 1, 2, 3, 4)
select layer, r as row, k as col, v as value from (select *, row_number() over (partition by layer, r, k order by n desc, v) as rn from n) where rn = 1""",
)
def a41_region_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region raster at two degrees: the most frequent region of each block."""
    c = table(spark, sf_dir, "raster").select("layer", F.col("grid_row").alias("row"), F.col("grid_col").alias("col"), F.col("cell_value").alias("value"))
    return R.block_mode(c, ["layer"], 4)


@CORE.query("r9_solidity")
def r9_solidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a patch over the area of their convex hull."""
    return R.solidity(patches(spark, sf_dir), "p")


@CORE.query(
    "r10_spread",
    """with f as (select user_id as p, floor(value)::integer as x, (event_id * 7 % 97)::integer as y, min(date_diff('day', timestamp '2024-01-01', ts)) as t from events group by 1, 2, 3),
d as (select a.p, a.x, a.y, a.t, min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d2 from f a join f b on a.p = b.p and b.t < a.t group by 1, 2, 3, 4)
select f.p, coalesce(round(avg((d2 <= 9)::integer), 4), 1) as spread_ratio, count(distinct case when d2 > 9 then d.t end) as n_new_ignitions,
coalesce(round(avg(sqrt(d2)), 2), 0) as mean_spread_dist, coalesce(round(max(sqrt(d2)), 2), 0) as max_spread_dist from (select distinct p from f) f left join d on f.p = d.p group by 1""",
)
def r10_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("p"), F.floor("value").cast("int").alias("x"), F.expr("event_id * 7 % 97").cast("int").alias("y"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("t")
    )
    return R.spread(c, "p")


@CORE.query(
    "r11_tiles",
    f"""with b as (select fire_id, min(xi) * 100 as x0, min(yi) * 100 as y0, max(xi) * 100 as x1, max(yi) * 100 as y1 from {COUNTING_SQL} where fire_id is not null group by 1),
n as (select *, greatest(1, ceil((x1 - x0 + 1) / 224.0))::integer as nx, greatest(1, ceil((y1 - y0 + 1) / 224.0))::integer as ny from b)
select fire_id, xi, yi, (x0 - 16 + xi * 224)::integer as tx, (y0 - 16 + yi * 224)::integer as ty from (select *, unnest(generate_series(0, nx - 1))::integer as xi from n) x, lateral (select unnest(generate_series(0, x.ny - 1))::integer as yi)""",
)
def r11_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles over the padded box of each fire."""
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id", "xi", "yi")).filter("fire_id is not null")
    b = s.groupBy("fire_id").agg(*[(f(c) * 100).alias(n) for n, f, c in (("x0", F.min, "xi"), ("y0", F.min, "yi"), ("x1", F.max, "xi"), ("y1", F.max, "yi"))])
    return R.tiles(b, ["fire_id"])


@CORE.query(
    "j9_rounded_lookup",
    f"""with r as (select grid_row, grid_col, cell_value from raster where layer = 'region' and cell_value is not null and not isnan(cell_value)),
p as (select sample_id, floor((90 - lat) * 2)::integer as r, floor((ln + 180) * 2)::integer as k from (select sample_id, lat, {LON_SQL} as ln from {COUNTING_SQL}) where lat is not null and ln is not null),
m as (select grid_row + i as r, grid_col + j as k, max(cell_value) as v from r, (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j) group by 1, 2)
select sample_id, coalesce(r.cell_value, m.v)::integer as region from p left join r on r.grid_row = p.r and r.grid_col = p.k left join m on m.r = p.r and m.k = p.k""",
)
def j9_rounded_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region of the cell or, where it has none, the largest of the cells around it."""
    r = table(spark, sf_dir, "raster").filter("layer = 'region' and cell_value is not null and not isnan(cell_value)")
    r = r.select(F.col("grid_row").alias("row"), F.col("grid_col").alias("col"), F.col("cell_value").alias("value"))
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "lon", "lat"))
    p = s.select("sample_id", longitude().alias("ln"), latitude().alias("lat")).filter("lat is not null and ln is not null").select(
        "sample_id", F.floor((90 - F.col("lat")) * 2).cast("int").alias("row"), F.floor((F.col("ln") + 180) * 2).cast("int").alias("col")
    )
    pooled = R.max_pool(r.withColumn("k", F.lit(1)), ["k"]).select("row", "col", F.col("value").alias("around"))
    return p.join(r, ["row", "col"], "left").join(pooled, ["row", "col"], "left").select("sample_id", F.coalesce("value", "around").cast("int").alias("region"))


@CORE.query(
    "j16_points_in_boxes",
    f"""with b as (select distinct fire_id, min_x - 0.5 as x0, min_y - 0.5 as y0, {EAST_SQL} + 0.5 as x1, max_y + 0.5 as y1, start_date, end_date from fires),
p as (select sample_id, ln, lat, dt from (select sample_id, lat, {LON_SQL} as ln, dt from {COUNTING_SQL}) where lat is not null and ln is not null)
select b.fire_id, count(*) as n from b join p on (ln between x0 and x1 or ln + 360 between x0 and x1 or ln - 360 between x0 and x1) and lat between y0 and y1 and dt between start_date and end_date group by 1""",
)
def j16_points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in the padded box of every fire while it burned, by bins of one degree; boxes and padding run on across the date line."""
    b = padded_fires(table(spark, sf_dir, "fires"), unwrapped_east())
    return points_in_boxes(_dated_points(spark, sf_dir), b, wrap=True).groupBy("fire_id").agg(F.count(F.lit(1)).alias("n"))


def padded_fires(fires: DataFrame, east: Column) -> DataFrame:
    """(fire_id, x0, y0, x1, y1, start_date, end_date): boxes grown by half a degree."""
    return fires.select(
        "fire_id", (F.col("min_x") - 0.5).alias("x0"), (F.col("min_y") - 0.5).alias("y0"), (east + 0.5).alias("x1"), (F.col("max_y") + 0.5).alias("y1"), "start_date", "end_date"
    ).distinct()


def _dated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "lon", "lat", "dt"))
    return s.select(longitude().alias("x"), latitude().alias("y"), "dt").filter("x is not null and y is not null")


def points_in_boxes(points: DataFrame, boxes: DataFrame, bin_deg: float = 1.0, wrap: bool = False) -> DataFrame:
    """points(x, y, dt) in boxes(x0, y0, x1, y1, start_date, end_date): an equi-join on bins and months, then the exact test.

    The month keeps a place that burns again and again from becoming one hot bin. With wrap, x0 <= x1 may lie beyond
    the date line on either side, and bins and test go around the globe (bin_deg must divide 360).
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_deg).cast("int"), F.floor(F.col(b) / bin_deg).cast("int")))
    month = lambda d: F.year(d) * 12 + F.month(d)
    if wrap:
        q = boxes.withColumn("bx", round_bins(F.col("x0"), F.col("x1"), bin_deg)).withColumn("by", bins("y0", "y1")).withColumn("bm", F.explode(F.sequence(month("start_date"), month("end_date"))))
        bx = F.pmod(F.floor(F.col("x") / bin_deg).cast("int"), F.lit(int(360 / bin_deg)))
        p = points.withColumns({"bx": bx, "by": F.floor(F.col("y") / bin_deg).cast("int"), "bm": month("dt")})
        inside = "(x between x0 and x1 or x + 360 between x0 and x1 or x - 360 between x0 and x1) and y between y0 and y1 and dt between start_date and end_date"
        return p.join(q, ["bx", "by", "bm"]).filter(inside).drop("bx", "by", "bm")
    q = boxes.withColumn("bx", bins("x0", "x1")).withColumn("by", bins("y0", "y1")).withColumn("bm", F.explode(F.sequence(month("start_date"), month("end_date"))))
    p = points.withColumns({"bx": F.floor(F.col("x") / bin_deg).cast("int"), "by": F.floor(F.col("y") / bin_deg).cast("int"), "bm": month("dt")})
    return p.join(q, ["bx", "by", "bm"]).filter("x between x0 and x1 and y between y0 and y1 and dt between start_date and end_date").drop("bx", "by", "bm")


@CORE.query(
    "j18_box_overlaps",
    f"""with b as (select distinct fire_id, min_x as x0, min_y as y0, {EAST_SQL} as x1, max_y as y1, start_date as d from fires)
select distinct a.fire_id as a, b.fire_id as b from b a join b b on a.d = b.d and a.fire_id < b.fire_id and a.y0 <= b.y1 + 1 and b.y0 <= a.y1 + 1
join (select unnest([-360, 0, 360]) as k) on a.x0 + k <= b.x1 + 1 and b.x0 <= a.x1 + k + 1""",
)
def j18_box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires that start on one day and whose boxes come within a degree; boxes and the degree between them run on across the date line."""
    f = table(spark, sf_dir, "fires").select("fire_id", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), unwrapped_east().alias("x1"), F.col("max_y").alias("y1"), F.col("start_date").alias("d")).distinct()
    j = overlapping_boxes(f, f, ["d"], 1).filter("fire_id_a < fire_id_b")
    return j.select(F.col("fire_id_a").alias("a"), F.col("fire_id_b").alias("b"))


@CORE.query(
    "s10_raster_window",
    "select grid_row, grid_col, cell_value from raster where layer = 'region' and grid_row between floor((90 - 60) * 2) and ceil((90 - 20) * 2) and grid_col between floor((-130 + 180) * 2) and ceil((-60 + 180) * 2)",
)
def s10_raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a window 130 W to 60 W, 20 N to 60 N, filtered in the scan."""
    r = table(spark, sf_dir, "raster").filter("layer = 'region' and grid_row between 60 and 140 and grid_col between 100 and 240")
    return r.select("grid_row", "grid_col", "cell_value")


@CORE.query(
    "s41_longitude_groups",
    """with g as (select distinct fire_id, floor(min_x / 30)::integer as a, floor(case when max_x < min_x then max_x + 360 else max_x end / 30)::integer as b from fires)
select fire_id, (((unnest(generate_series(a, b)) % 12) + 12) % 12)::integer as strip from g""",
)
def s41_longitude_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strips of thirty degrees that a box touches, wrapping at the date line."""
    east = F.when(F.col("max_x") < F.col("min_x"), F.col("max_x") + 360).otherwise(F.col("max_x"))
    g = table(spark, sf_dir, "fires").select("fire_id", F.floor(F.col("min_x") / 30).cast("int").alias("a"), F.floor(east / 30).cast("int").alias("b")).distinct()
    return g.select("fire_id", F.explode(F.sequence("a", "b")).alias("s")).select("fire_id", F.pmod("s", F.lit(12)).alias("strip"))


@CORE.query(
    "r18_overlay",
    """with e as (select event_id, user_id, value, case when event_type in ('error', 'purchase') then 1 else 0 end as y, value / 491 > 0.5 as p, event_id % 32 = 0 as border from events)
select event_id, case when border then 'excluded' when p and y = 1 then 'tp' when p then 'fp' when y = 1 then 'fn' else 'none' end as label,
round((value - min(value) over (partition by user_id)) / nullif(max(value) over (partition by user_id) - min(value) over (partition by user_id), 0), 6) as scaled from e""",
)
def r18_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion label of each pixel without the border, and its value scaled to the patch's range."""
    e = table(spark, sf_dir, "events")
    lim = e.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    y, p = F.col("event_type").isin("error", "purchase"), F.col("value") / 491 > 0.5
    label = F.when(F.col("event_id") % 32 == 0, "excluded").when(p & y, "tp").when(p, "fp").when(y, "fn").otherwise("none")
    return e.join(lim, "user_id").select("event_id", label.alias("label"), F.round((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), 6).alias("scaled"))
