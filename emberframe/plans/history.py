"""Ordered operators over days and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.functions import scalars as S
from emberframe.operators import history as H
from emberframe.registry import CORE
from emberframe.session import materialize
from emberframe.tables import COUNTING_SQL, LON_SQL, counting, latitude, longitude, table, unwrapped_east

_SAMPLE = ("sample_id", "load_order", "loaded_at")


def samples(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return counting(table(spark, sf_dir, "samples").select(*_SAMPLE, *more))


@CORE.query(
    "w5_last_sample",
    f"select sample_id, row_number() over (partition by fire_id order by dt desc, load_order desc) = 1 as is_last from {COUNTING_SQL}",
)
def w5_last_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.last_day_once(samples(spark, sf_dir, "fire_id", "dt"), "fire_id", "dt", "load_order").select("sample_id", "is_last")


@CORE.query("w6_last_day", f"select sample_id, dt = max(dt) over (partition by fire_id) as is_last from {COUNTING_SQL}")
def w6_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.last_day_all(samples(spark, sf_dir, "fire_id", "dt"), "fire_id", "dt").select("sample_id", "is_last")


@CORE.query(
    "w7_accumulators",
    f"""with c as (select fire_id, xi, yi, dt, count(*) as seen from {COUNTING_SQL} where fire_id is not null group by 1, 2, 3, 4)
select fire_id, xi, yi, dt, min(dt) over w as first_day, max(dt) over w as last_day, sum(seen) over w::bigint as times from c window w as (partition by fire_id, xi, yi order by dt)""",
)
def w7_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and latest day and number of sightings of every tile, as of each day it was seen."""
    s = samples(spark, sf_dir, "fire_id", "xi", "yi", "dt").filter("fire_id is not null")
    return H.accumulated(s, ["fire_id", "xi", "yi"], "dt")


@CORE.query(
    "w8_latest_fire",
    f"""with c as (select cast(floor({LON_SQL}) as integer) as x, cast(floor(lat) as integer) as y, fire_id, dt, load_order from {COUNTING_SQL} where fire_id is not null and lon is not null and abs(lat) <= 90)
select x, y, fire_id from (select *, row_number() over (partition by x, y order by dt desc, load_order desc) as rn from c) where rn = 1""",
)
def w8_latest_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fire that burned last in each cell of a degree, both conventions of longitude being brought to one cell."""
    return _latest_fire(samples(spark, sf_dir, "fire_id", "lon", "lat", "dt").withColumns({"lon": longitude(), "lat": latitude()}))


def _latest_fire(s: DataFrame) -> DataFrame:
    s = s.filter("fire_id is not null and lon is not null and lat is not null")
    c = s.groupBy(F.floor("lon").cast("int").alias("x"), F.floor("lat").cast("int").alias("y"))
    return c.agg(F.max(F.struct("dt", "load_order", "fire_id")).alias("t")).select("x", "y", F.col("t.fire_id").alias("fire_id"))


_ACCUM_SQL = "a as (select user_id as sample_id, event_id, case when event_type = 'view' then -1 else floor(value / 4)::integer end as t, event_type = 'click' as cur from events)"


def _accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"), "event_id", F.when(F.col("event_type") == "view", -1).otherwise(F.floor(F.col("value") / 4).cast("int")).alias("t"),
        (F.col("event_type") == "click").alias("cur"),
    )


@CORE.query(
    "w9_relative_age",
    f"with {_ACCUM_SQL} select event_id, case when t < 0 then -1 else round(least(1, greatest(0, (max(t) over (partition by sample_id) - t) / 30.0)), 6) end::double as age from a",
)
def w9_relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max("t").over(Window.partitionBy("sample_id"))
    return _accum(spark, sf_dir).select("event_id", F.round(S.relative_age(F.col("t"), newest), 6).alias("age"))


@CORE.query(
    "w10_union_current",
    f"""with {_ACCUM_SQL}, m as (select *, greatest(0, max(t) over (partition by sample_id)) as newest, case when t < 0 then 0 else 2 end as n from a)
select event_id, case when cur and t < 0 then newest else t end as t_min, case when cur then newest else t end as t_max, case when cur and n = 0 then 1 else n end as n from m""",
)
def w10_union_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's mask merged into the accumulators of first day, latest day and count."""
    m = _accum(spark, sf_dir).withColumns({"newest": F.greatest(F.lit(0), F.max("t").over(Window.partitionBy("sample_id"))), "n": F.when(F.col("t") < 0, 0).otherwise(2)})
    cur = F.col("cur")
    return m.select(
        "event_id", F.when(cur & (F.col("t") < 0), F.col("newest")).otherwise(F.col("t")).alias("t_min"),
        F.when(cur, F.col("newest")).otherwise(F.col("t")).alias("t_max"), F.when(cur & (F.col("n") == 0), 1).otherwise(F.col("n")).alias("n"),
    )


@CORE.query("w11_day_of_fire", f"with f as (select fire_id, min(start_date) as d from fires group by 1) select sample_id, date_diff('day', d, dt)::integer as day from {COUNTING_SQL} s join f using (fire_id)")
def w11_day_of_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fires").groupBy("fire_id").agg(F.min("start_date").alias("d"))
    return samples(spark, sf_dir, "fire_id", "dt").join(f, "fire_id").select("sample_id", F.datediff("dt", "d").alias("day"))


@CORE.query(
    "w17_steps",
    f"""with d as (select distinct fire_id, xi, yi, dt from {COUNTING_SQL} where fire_id is not null) select *, lag(dt) over w as previous, lead(dt) over w as next from d window w as (partition by fire_id, xi, yi order by dt)""",
)
def w17_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days before and after each day on which a tile was seen."""
    w = Window.partitionBy("fire_id", "xi", "yi").orderBy("dt")
    d = samples(spark, sf_dir, "fire_id", "xi", "yi", "dt").filter("fire_id is not null").select("fire_id", "xi", "yi", "dt").distinct()
    return d.withColumns({"previous": F.lag("dt").over(w), "next": F.lead("dt").over(w)})


@CORE.query(
    "w18_detection_days",
    f"""with c as (select fire_id, xi, yi, min(dt) as a, max(dt) as b from {COUNTING_SQL} where fire_id is not null group by 1, 2, 3)
select fire_id, xi, yi, date_diff('day', min(a) over (partition by fire_id), a)::integer as earliest, date_diff('day', min(a) over (partition by fire_id), b)::integer as latest from c""",
)
def w18_detection_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = samples(spark, sf_dir, "fire_id", "xi", "yi", "dt").filter("fire_id is not null").groupBy("fire_id", "xi", "yi").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    start = c.groupBy("fire_id").agg(F.min("a").alias("s"))
    return c.join(start, "fire_id").select("fire_id", "xi", "yi", F.datediff("a", "s").alias("earliest"), F.datediff("b", "s").alias("latest"))


@CORE.query(
    "w19_first_place",
    f"select fire_id, xi, yi from (select fire_id, xi, yi, row_number() over (partition by fire_id order by load_order) as rn from {COUNTING_SQL} where fire_id is not null) where rn = 1",
)
def w19_first_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir, "fire_id", "xi", "yi").filter("fire_id is not null")
    return H.first_values(s, "fire_id", "load_order", ["xi", "yi"])


@CORE.query(
    "j24_nearest_day",
    f"""with s as (select distinct fire_id, dt from {COUNTING_SQL} where fire_id is not null), p as (select distinct fire_id, day_t as dt from picked),
j as (select p.fire_id, p.dt, s.dt as d, row_number() over (partition by p.fire_id, p.dt order by abs(date_diff('day', p.dt, s.dt)), s.dt) as rn from p left join s on s.fire_id = p.fire_id)
select fire_id, dt, d as nearest from j where rn = 1""",
)
def j24_nearest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of a sample nearest to each picked day of its fire."""
    have = samples(spark, sf_dir, "fire_id", "dt").filter("fire_id is not null").select("fire_id", "dt")
    wanted = table(spark, sf_dir, "picked").select("fire_id", F.col("day_t").alias("dt"))
    return H.nearest_day(wanted, have, ["fire_id"], "dt")


# ---- lagged joins on days; lineitem gives a value per day

_DAILY_SQL = "d as (select cast(l_shipdate as date) as day, l_linenumber as cell, avg(l_quantity) as v from lineitem group by 1, 2)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("cell")).agg(F.avg("l_quantity").alias("v"))


@CORE.query(
    "j20_year_lag",
    f"with {_DAILY_SQL} select a.day, a.cell, round(coalesce(b.v, a.v), 6) as past, round(greatest(0.2, least(3.0, a.v / greatest(abs(coalesce(b.v, a.v)), 0.05))), 6)::double as anomaly from d a left join d b on b.day = a.day - 365 and b.cell = a.cell",
)
def j20_year_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values beside those of 365 days before, the current ones where there is none."""
    d = _daily(spark, sf_dir)
    past = d.select(F.date_add("day", 365).alias("day"), "cell", F.col("v").alias("p"))
    j = d.join(past, ["day", "cell"], "left").withColumn("p", F.coalesce("p", "v"))
    return j.select("day", "cell", F.round("p", 6).alias("past"), F.round(S.ratio_anomaly("v", "p"), 6).alias("anomaly"))


@CORE.query("j21_clamped_year", f"select sample_id, greatest(2017, least(2024, year(dt) - 1))::integer as year from {COUNTING_SQL}")
def j21_clamped_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir, "dt").select("sample_id", F.greatest(F.lit(2017), F.least(F.lit(2024), F.year("dt") - 1)).alias("year"))


@CORE.query(
    "s14_point_series",
    f"with {_DAILY_SQL} select cell, count(*) as days, round(sum(v), 6) as total, min(day) as first_day, max(day) as last_day from d where day between date '1996-01-01' and date '1996-12-31' group by 1",
)
def s14_point_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of one year per cell."""
    d = _daily(spark, sf_dir).filter("day between date '1996-01-01' and date '1996-12-31'")
    s = d.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("series"))
    total = F.aggregate("series", F.lit(0.0), lambda a, x: a + x["v"])
    return s.select(
        "cell", F.size("series").cast("bigint").alias("days"), F.round(total, 6).alias("total"), F.col("series")[0]["day"].alias("first_day"),
        F.element_at("series", -1)["day"].alias("last_day"),
    )


@CORE.query(
    "a32_climatology",
    """with y as (select l_linenumber as cell, dayofyear(l_shipdate) as doy, l_quantity as v from lineitem),
x as (select cell, ((doy - 1 + o + 366) % 366 + 1)::integer as doy, v from y, (select unnest(generate_series(-15, 15)) as o))
select cell, doy, count(*) as n, quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.9) as p90
from x group by 1, 2 having count(*) >= 5""",
)
def a32_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per cell and day of the year over a window of 15 days on both sides, from 5 values on.

    Equal values of a day are counted before they are copied into the 31 days that see them.
    """
    y = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("cell"), F.dayofyear("l_shipdate").alias("d"), F.col("l_quantity").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    x = y.withColumn("o", F.explode(F.sequence(F.lit(-15), F.lit(15)))).withColumn("doy", (F.pmod(F.col("d") - 1 + F.col("o"), F.lit(366)) + 1).cast("int"))
    marks = [0.1, 0.25, 0.5, 0.75, 0.9]
    g = x.groupBy("cell", "doy").agg(F.sum("k").alias("n"), F.percentile("v", marks, F.col("k")).alias("p")).filter("n >= 5")
    return g.select("cell", "doy", "n", *[F.col("p")[i].alias(f"p{int(m * 100)}") for i, m in enumerate(marks)])


_HOURS_SQL = """h as (select cast(ts as date) as init_date, user_id % 10 as cell, hour(ts) as hr, value as temp, (value - 245) / 10 as u from events)"""


@CORE.query(
    "a30_daily_forecast",
    f"""with {_HOURS_SQL} select init_date, cell, max(temp) as temp_max, min(temp) as temp_min, case when abs(min(u)) > abs(max(u)) then min(u) else max(u) end as u_max,
round(coalesce(sum(temp) filter (where hr in (5, 11, 17, 23)), 0), 6) as precip, count(*) as n from h group by 1, 2""",
)
def a30_daily_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily extremes, the wind of largest magnitude with its sign, and sums at the ends of six-hour buckets."""
    h = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("init_date"), F.expr("user_id % 10").alias("cell"), F.hour("ts").alias("hr"), F.col("value").alias("temp"), ((F.col("value") - 245) / 10).alias("u"),
    )
    return h.groupBy("init_date", "cell").agg(
        F.max("temp").alias("temp_max"), F.min("temp").alias("temp_min"), S.largest_magnitude(F.min("u"), F.max("u")).alias("u_max"),
        F.round(F.coalesce(F.sum(F.when(F.col("hr").isin(5, 11, 17, 23), F.col("temp"))), F.lit(0.0)), 6).alias("precip"), F.count(F.lit(1)).alias("n"),
    )


@CORE.query(
    "s15_complete_forecasts",
    """with f as (select user_id as init, cast(ts as date) as day, count(*) as n from events group by 1, 2), c as (select init, count(*) as days from f group by 1)
select f.init, count(*) as days, sum(n)::bigint as n from f join c using (init) where c.days >= 25 group by 1""",
)
def s15_complete_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of which enough days are there; of the others nothing is returned."""
    f = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("init"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return f.groupBy("init").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n")).filter("days >= 25")


@CORE.query(
    "u5_missing_days",
    """with c as (select u, d::date as day from (select distinct user_id as u from events), (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as d))
select u as user_id, day from c where not exists (select 1 from events e where e.user_id = c.u and cast(e.ts as date) = c.day)""",
)
def u5_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a dense calendar that a user has no value on."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    return e.select("user_id").distinct().withColumn("day", F.explode(days)).join(e, ["user_id", "day"], "left_anti")


@CORE.query(
    "s13_tile_merge",
    """with t as (select cast(ts as date) as day, user_id % 20 as cell, event_id, value from events) select day, cell, value from (select *, row_number() over (partition by day, cell order by event_id desc) as rn from t) where rn = 1""",
)
def s13_tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of one day merged, a later one written over an earlier."""
    t = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.expr("user_id % 20").alias("cell"))
    return t.agg(F.max_by("value", "event_id").alias("value"))


@CORE.query(
    "w16_spread_picks",
)
def w16_spread_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of the largest fires at least 30 degrees apart, filled up by size; boxes across the date line are unwrapped."""
    f = table(spark, sf_dir, "fires").withColumn("east", unwrapped_east()).filter("fire_id is not null and num_fire is not null and min_x is not null and max_x is not null")
    x = F.avg((F.col("min_x") + F.col("east")) / 2)
    f = f.groupBy("fire_id").agg(
        F.max("num_fire").alias("num_fire"), F.when(x >= 180, x - 360).otherwise(x).alias("x"), F.avg((F.col("min_y") + F.col("max_y")) / 2).alias("y")
    )
    return spark.createDataFrame(spread_largest(f, 6, 30.0), "fire_id int, x double, y double, num_fire int")


def spread_largest(fires: DataFrame, n: int, apart: float) -> list[tuple]:
    """Greedy choice of n rows of fires(fire_id, num_fire, x, y) over the whole table, as spread_pick makes it of a ranked list.

    Each round takes the largest fire, ties to the smaller fire_id, that lies at least `apart` degrees from all chosen, as one
    small aggregate; longitudes are compared the short way around. Where none is left, the largest of the rest fill up.
    """
    f = materialize(fires.select("fire_id", "num_fire", "x", "y"))
    best = F.max(F.struct("num_fire", (-F.col("fire_id").cast("long")).alias("id"), "x", "y")).alias("t")
    chosen: list[tuple] = []
    far = F.lit(True)
    while len(chosen) < n:
        t = f.filter(far).agg(best).first()["t"]
        if t is None:
            break
        chosen.append((-t["id"], t["x"], t["y"], t["num_fire"]))
        dx = F.abs(F.col("x") - t["x"])
        d2 = F.pow(F.least(dx, 360 - dx), 2) + F.pow(F.col("y") - t["y"], 2)
        far = far & (d2 >= apart**2) & (F.col("fire_id") != -t["id"])
    rest = f.filter(~F.col("fire_id").isin([c[0] for c in chosen])).orderBy(F.col("num_fire").desc(), "fire_id").limit(n - len(chosen))
    return chosen + [(r["fire_id"], r["x"], r["y"], r["num_fire"]) for r in rest.collect()] if len(chosen) < n else chosen


def spread_pick(ranked: list[tuple], n: int, apart: float) -> list[tuple]:
    """Greedy choice in the given order of rows (id, x, y, ...) whose distance to all chosen is at least `apart`; then the rest in order."""
    chosen: list[tuple] = []
    for r in ranked:
        if len(chosen) < n and all((r[1] - c[1]) ** 2 + (r[2] - c[2]) ** 2 >= apart**2 for c in chosen):
            chosen.append(r)
    rest = [r for r in ranked if r not in chosen]
    return chosen + rest[: max(0, n - len(chosen))]


@CORE.query(
    "j27_metadata",
    f"""with m as (select {'coalesce(fire_id, -1)'} as fire, xi, yi, dt, num_fire, load_order from samples),
l as (select *, row_number() over (partition by fire, xi, yi, dt order by load_order desc) as rn from m)
select s.sample_id, l.num_fire as last_num_fire from {COUNTING_SQL} s left join l on coalesce(s.fire_id, -1) = l.fire and s.xi = l.xi and s.yi = l.yi and s.dt = l.dt and l.rn = 1""",
)
def j27_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by fire, tile and day, the row loaded last winning."""
    k = ["fire", "xi", "yi", "dt"]
    fire = F.coalesce("fire_id", F.lit(-1)).alias("fire")
    m = table(spark, sf_dir, "samples").select(fire, "xi", "yi", "dt", "num_fire", "load_order").groupBy(*k).agg(F.max_by("num_fire", "load_order").alias("last_num_fire"))
    return samples(spark, sf_dir, "fire_id", "xi", "yi", "dt").select("sample_id", fire, "xi", "yi", "dt").join(m, k, "left").select("sample_id", "last_num_fire")


@CORE.query(
    "j34_lookup",
    f"with s as (select {'fire_id'}, count(*) as n from {COUNTING_SQL} where fire_id is not null group by 1) select s.fire_id, n, f.fire_id is null as missing from s left join (select distinct fire_id from fires) f on s.fire_id = f.fire_id",
)
def j34_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires of samples, marked where the fires table doesn't know them."""
    s = samples(spark, sf_dir, "fire_id").filter("fire_id is not null").groupBy("fire_id").agg(F.count(F.lit(1)).alias("n"))
    f = table(spark, sf_dir, "fires").select("fire_id").distinct().withColumn("known", F.lit(True))
    return s.join(f, "fire_id", "left").select("fire_id", "n", F.col("known").isNull().alias("missing"))


@CORE.query(
    "j29_size_fallback",
    f"with f as (select fire_id, max(num_fire) as n from fires group by 1) select sample_id, coalesce(f.n, s.num_fire, 0) as num_fire from {COUNTING_SQL} s left join f on s.fire_id = f.fire_id",
)
def j29_size_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fires").filter("fire_id is not null").groupBy("fire_id").agg(F.max("num_fire").alias("n"))
    s = samples(spark, sf_dir, "fire_id", "num_fire").join(f, "fire_id", "left")
    return s.select("sample_id", F.coalesce("n", "num_fire", F.lit(0)).alias("num_fire"))
