"""Detections, cells and events: components in space and time and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators.graph import connected_components, event_cells, event_stats, label_cells
from emberframe.registry import CORE
from emberframe.session import materialize, shuffled
from emberframe.tables import COUNTING_SQL, LON_SQL, counting, latitude, longitude, table

#: Tenth-degree cells of located samples and the day since 2018-01-01.
CELLS_SQL = f"""cells as (select distinct cast(floor((ln + 180) * 10) as integer) as x, cast(floor((lat + 90) * 10) as integer) as y,
cast(date_diff('day', date '2018-01-01', dt) as integer) as t
from (select {LON_SQL} as ln, lat, dt from {COUNTING_SQL}) where ln is not null and lat is not null)"""
KEY_SQL = "((cast(t + 524288 as bigint) << 42) + (cast(y + 524288 as bigint) << 21) + cast(x + 524288 as bigint))"


def sample_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "lon", "lat", "dt"))
    s = s.select(latitude().alias("lat"), longitude().alias("lon"), "dt").filter("lat is not null and lon is not null and dt is not null")
    return s.select(
        F.floor((F.col("lon") + 180) * 10).cast("int").alias("x"),
        F.floor((F.col("lat") + 90) * 10).cast("int").alias("y"),
        F.datediff("dt", F.lit("2018-01-01")).alias("t"),
    ).distinct()


def _components_sql(dt: int, name: str) -> str:
    return f"""{name}_e as (select a.k as u, b.k as v from k a join k b on abs(a.x - b.x) <= 2 and abs(a.y - b.y) <= 2 and abs(a.t - b.t) <= {dt}),
{name}_r as (select u, v from {name}_e union select r.u, e.v from {name}_r r join {name}_e e on r.v = e.u),
{name} as (select u as k, min(v) as c from {name}_r group by 1)"""


_EVENT_SQL = f"""with recursive {CELLS_SQL}, k as (select x, y, t, {KEY_SQL} as k from cells),
{_components_sql(7, "comp")}, {_components_sql(0, "dayc")},
n as (select a.k, count(*) filter (where b.t < a.t) as predecessors, count(*) filter (where b.t = a.t) as neighbours
from k a join k b on abs(a.x - b.x) <= 2 and abs(a.y - b.y) <= 2 and a.t - b.t between 0 and 7 and a.k <> b.k group by 1),
f as (select x, y, t, comp.c as component, dayc.c as same_day, coalesce(predecessors, 0) as predecessors, coalesce(neighbours, 0) as neighbours
from k join comp using (k) join dayc using (k) left join n using (k)),
g as (select *, max(predecessors) over (partition by same_day) = 0 as ignition from f)"""


@CORE.query("g2_components", f"with recursive {CELLS_SQL}, k as (select x, y, t, {KEY_SQL} as k from cells), {_components_sql(7, 'comp')} "
            "select x, y, t, c as component from k join comp using (k)")  # fmt: skip
def g2_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells linked within 7 days and 2 cells a side, labelled by the least cell of their component."""
    return label_cells(sample_cells(spark, sf_dir))


@CORE.query("g3_ignition", _EVENT_SQL + " select * from g")
def g3_ignition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(sample_cells(spark, sf_dir))


@CORE.query(
    "g4_event_stats",
    _EVENT_SQL + """ select component, count(*) as num_cells, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y,
min(t) as min_t, max(t) as max_t, round(avg(neighbours), 6) as avg_xy_neighbors, count(distinct case when ignition then same_day end) as ignitions,
round(count(distinct case when ignition then same_day end) / count(*), 6) as ignition_ratio,
round((max(t) - min(t) + 1) / sqrt((max(x) - min(x) + 1) * (max(y) - min(y) + 1)), 6) as t_ratio from g group by 1""",
)
def g4_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stats(event_cells(sample_cells(spark, sf_dir)))
    return s.withColumns({c: F.round(c, 6) for c in ("avg_xy_neighbors", "ignition_ratio", "t_ratio")})


@CORE.query(
    "g9_patch_labels",
    """with recursive c as (select distinct user_id as p, cast(floor(value) as bigint) % 40 as x, cast(floor(value / 40) as bigint) as y from events where event_type = 'error'),
e as (select a.p, a.x as ux, a.y as uy, b.x as vx, b.y as vy from c a join c b on a.p = b.p and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
r as (select * from e union select r.p, r.ux, r.uy, e.vx, e.vy from r join e on r.p = e.p and r.vx = e.ux and r.vy = e.uy),
m as (select p, ux, uy, min(vy * 1000 + vx) as c from r group by 1, 2, 3)
select p as patch, count(distinct c) as n_components, count(*) as n_cells from m group by 1""",
)
def g9_patch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-connected components of each patch: the patch number takes the place of the day, with no reach across it."""
    cells = (
        table(spark, sf_dir, "events").filter("event_type = 'error'")
        .select(F.expr("cast(floor(value) as bigint) % 40").cast("int").alias("x"), F.floor(F.col("value") / 40).cast("int").alias("y"), F.col("user_id").cast("int").alias("t"))
    )
    return label_cells(cells, 1, 1, 0).groupBy(F.col("t").cast("bigint").alias("patch")).agg(
        F.countDistinct("component").alias("n_components"), F.count(F.lit(1)).alias("n_cells")
    )


@CORE.query(
    "g7_detections",
    f"""with recursive {CELLS_SQL}, k as (select x, y, t, {KEY_SQL} as k from cells), {_components_sql(7, 'comp')},
d as (select sample_id, cast(floor((ln + 180) * 10) as integer) as x, cast(floor((lat + 90) * 10) as integer) as y,
cast(date_diff('day', date '2018-01-01', dt) as integer) as t from (select sample_id, {LON_SQL} as ln, lat, dt from {COUNTING_SQL}) where ln is not null and lat is not null)
select sample_id, c as component from d join k on d.x = k.x and d.y = k.y and d.t = k.t join comp on comp.k = k.k""",
)
def g7_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every located sample with the component of its cell."""
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "lon", "lat", "dt"))
    s = s.select("sample_id", latitude().alias("lat"), longitude().alias("lon"), "dt").filter("lat is not null and lon is not null and dt is not null")
    d = s.select(
        "sample_id",
        F.floor((F.col("lon") + 180) * 10).cast("int").alias("x"),
        F.floor((F.col("lat") + 90) * 10).cast("int").alias("y"),
        F.datediff("dt", F.lit("2018-01-01")).alias("t"),
    )
    return d.join(shuffled(label_cells(d)), ["x", "y", "t"]).select("sample_id", "component")


@CORE.query(
    "g1_covered_cells",
    """with d as (select event_id, cast(floor(value) as bigint) as cx, user_id as cy, cast(date_diff('day', date '2024-01-01', ts::date) as bigint) as t, event_id % 3 as w from events),
x as (select event_id, t, unnest(generate_series(cx - w, cx + w)) as x, cy, w from d),
y as (select event_id, t, x, unnest(generate_series(cy - w, cy + w)) as y from x)
select x, y, t, max(event_id) as event_id, count(*) as n from y group by 1, 2, 3""",
)
def g1_covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the rectangle of each detection covers; the last detection written holds the cell."""
    d = table(spark, sf_dir, "events").select(
        "event_id", F.floor("value").cast("bigint").alias("cx"), F.col("user_id").alias("cy"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint").alias("t"), F.expr("event_id % 3").alias("w"),
    )
    x = d.withColumn("x", F.explode(F.sequence(F.col("cx") - F.col("w"), F.col("cx") + F.col("w"))))
    y = x.withColumn("y", F.explode(F.sequence(F.col("cy") - F.col("w"), F.col("cy") + F.col("w"))))
    return y.groupBy("x", "y", "t").agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))


@CORE.query(
    "g0_graph_components",
    """with recursive e as (select fire_id as u, xi * 1000 + yi + 1000000 as v from samples where fire_id is not null),
b as (select u, v from e union select v, u from e union select u, u from e union select v, v from e),
l as (select u, min(v) as m, 0 as i from b group by 1 union all
select b.u, min(l.m), max(l.i) + 1 from b join l on l.u = b.v where l.i < 12 group by b.u)
select cast(u as bigint) as node, cast(min(m) as bigint) as component from l group by 1""",
)
def g0_graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires and tile positions linked by samples, as a plain graph."""
    e = table(spark, sf_dir, "samples").filter("fire_id is not null").select(
        F.col("fire_id").cast("bigint").alias("u"), F.expr("cast(xi * 1000 + yi + 1000000 as bigint)").alias("v")
    )
    return connected_components(materialize(e.distinct()))
