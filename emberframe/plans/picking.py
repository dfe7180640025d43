"""Coverage of event-days and the picking of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.scalars import CELL_DEG
from emberframe.operators import coverage as C
from emberframe.operators import sampling as P
from emberframe.operators.ordering import chunked, even_positions, group_positions, positions, ranked_values, sliced, strided
from emberframe.registry import CORE
from emberframe.session import materialize
from emberframe.tables import COUNTING_SQL, counting, table

_LINKS_SQL = """links as (select distinct l_suppkey as fire_id, l_orderkey as image_id from lineitem),
fr as (select s_suppkey as fire_id, n_regionkey as region_id from supplier join nation on s_nationkey = n_nationkey),
img as (select o_orderkey as image_id, cast(floor(o_totalprice) as integer) as num_fire_pixels, cast(o_orderdate as date) as day, o_orderstatus = 'F' as downloaded from orders),
fi as (select fire_id, image_id, day, downloaded from links join img using (image_id)),
cov as (select fire_id, day, count(*) as n_total, count(*) filter (where downloaded) as n_downloaded from fi group by 1, 2)"""
_PAIRS_SQL = """prs as (select a.fire_id, a.day as day_t, a.n_total = a.n_downloaded as t_full, b.n_total = b.n_downloaded as t1_full,
a.n_downloaded > 0 as has_t, b.n_downloaded > 0 as has_t1 from cov a join cov b on a.fire_id = b.fire_id and b.day = a.day + 1)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("fire_id"), F.col("l_orderkey").alias("image_id")).distinct()


def fire_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("fire_id"), F.col("n_regionkey").alias("region_id"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.floor("o_totalprice").cast("int").alias("num_fire_pixels"),
        F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("downloaded"),
    )


def fire_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).join(images(spark, sf_dir).drop("num_fire_pixels"), "image_id")


@CORE.query("a1_fire_image_links", "with " + _LINKS_SQL + " select fire_id, image_id from links")
def a1_fire_image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir)


_MODAL_SQL = """m as (select image_id, region_id, count(*) as n, row_number() over (partition by image_id order by count(*) desc, region_id) as rn
from links join fr using (fire_id) group by 1, 2)"""


@CORE.query("a2_image_region", f"with {_LINKS_SQL}, {_MODAL_SQL} select image_id, region_id, n from m where rn = 1")
def a2_image_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.modal_group(links(spark, sf_dir).join(fire_regions(spark, sf_dir), "fire_id"), "image_id", "region_id")


@CORE.query(
    "qa_top_images",
    f"""with {_LINKS_SQL}, {_MODAL_SQL}, r as (select region_id, image_id, num_fire_pixels, day, row_number() over (partition by region_id order by num_fire_pixels desc, image_id) as rank
from m join img using (image_id) where rn = 1 and region_id > 0) select region_id, image_id, num_fire_pixels, day, rank from r where rank <= 100""",
)
def qa_top_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = C.top_images(links(spark, sf_dir), fire_regions(spark, sf_dir), images(spark, sf_dir), 100)
    return top.select("region_id", "image_id", "num_fire_pixels", "day", F.col("rank").cast("bigint").alias("rank"))


@CORE.query(
    "a5_region_summary",
    f"""with {_LINKS_SQL}, {_MODAL_SQL} select region_id, count(*) as n_images, sum(num_fire_pixels)::bigint as total_pixels, max(num_fire_pixels) as max_pixels
from m join img using (image_id) where rn = 1 and region_id > 0 group by 1""",
)
def a5_region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = C.modal_group(links(spark, sf_dir).join(fire_regions(spark, sf_dir), "fire_id"), "image_id", "region_id")
    return of.filter("region_id > 0").join(images(spark, sf_dir), "image_id").groupBy("region_id").agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("num_fire_pixels").alias("total_pixels"), F.max("num_fire_pixels").alias("max_pixels")
    )


@CORE.query("a3_day_coverage", f"with {_LINKS_SQL} select fire_id, day, n_total, n_downloaded, n_downloaded > 0 as has_any, n_downloaded = n_total as fully_covered from cov")
def a3_day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.day_coverage(fire_images(spark, sf_dir))


@CORE.query("j3_day_pairs", f"with {_LINKS_SQL}, {_PAIRS_SQL} select * from prs")
def j3_day_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.day_pairs(C.day_coverage(fire_images(spark, sf_dir)))


@CORE.query(
    "a8_coverage_report",
    f"""with {_LINKS_SQL}, {_PAIRS_SQL} select region_id, count(*) as n_pairs, count(*) filter (where has_t and has_t1) as covered,
count(*) filter (where has_t and not has_t1) as t_only, count(*) filter (where not has_t and has_t1) as t1_only, count(*) filter (where not has_t and not has_t1) as neither
from prs join fr using (fire_id) group by rollup (region_id)""",
)
def a8_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.day_pairs(C.day_coverage(fire_images(spark, sf_dir))).join(F.broadcast(fire_regions(spark, sf_dir)), "fire_id")
    a, b = F.col("has_t"), F.col("has_t1")
    return p.rollup("region_id").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count(F.when(a & b, 1)).alias("covered"), F.count(F.when(a & ~b, 1)).alias("t_only"),
        F.count(F.when(~a & b, 1)).alias("t1_only"), F.count(F.when(~a & ~b, 1)).alias("neither"),
    )


@CORE.query(
    "j12_missing_images",
    f"""with {_LINKS_SQL}, {_PAIRS_SQL}, need as (select fire_id, day_t as day from prs where has_t union select fire_id, day_t + 1 from prs where has_t)
select distinct image_id, day from fi join need using (fire_id, day) where not downloaded""",
)
def j12_missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    fi = materialize(fire_images(spark, sf_dir))
    return C.missing_images(C.day_pairs(C.day_coverage(fi)).filter("has_t"), fi)


@CORE.query(
    "j13_gap_images",
    f"""with {_LINKS_SQL}, {_PAIRS_SQL}, gaps as (select fire_id, day_t + 1 as day from prs where has_t and not has_t1) select distinct image_id, day from fi join gaps using (fire_id, day)""",
)
def j13_gap_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    fi = materialize(fire_images(spark, sf_dir))
    return C.gap_images(C.day_pairs(C.day_coverage(fi)), fi)


@CORE.query(
    "j6_refreshed_coverage",
    f"""with {_LINKS_SQL}, {_PAIRS_SQL}, c2 as (select fire_id, day, bool_and(downloaded or o_orderpriority = '1-URGENT') as full from fi join orders on o_orderkey = image_id group by 1, 2)
select p.fire_id, p.day_t, coalesce(a.full, false) as t_full, coalesce(b.full, false) as t1_full from prs p
left join c2 a on a.fire_id = p.fire_id and a.day = p.day_t left join c2 b on b.fire_id = p.fire_id and b.day = p.day_t + 1""",
)
def j6_refreshed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage flags after urgent images were fetched as well."""
    fi = fire_images(spark, sf_dir)
    pairs = C.day_pairs(C.day_coverage(fi))
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("image_id"), F.lit(True).alias("got"))
    more = fi.join(urgent, "image_id", "left").withColumn("downloaded", F.col("downloaded") | F.coalesce("got", F.lit(False)))
    return C.refreshed(pairs, C.day_coverage(more)).select("fire_id", "day_t", "t_full", "t1_full")


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """picked with one row per key: a flag is set if any copy sets it, null counts as not."""
    return table(spark, sf_dir, "picked").groupBy("fire_id", "day_t").agg(
        *[F.max(c).alias(c) for c in ("region_id", "num_fire", "n_tiles_est", "fire_type")],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("t_full", "t1_full")],
    )


PICKED_SQL = """pk as (select fire_id, day_t, max(region_id) as region_id, max(num_fire) as num_fire, max(n_tiles_est) as n_tiles_est, max(fire_type) as fire_type,
coalesce(bool_or(t_full), false) as t_full, coalesce(bool_or(t1_full), false) as t1_full,
(((fire_id::bigint * 10007 + date_diff('day', date '2000-01-01', day_t)) * 2654435761 + 42) % 1000003 + 0.5) / 1000003.0 as u from picked group by 1, 2)"""


@CORE.query(
    "t4_cheapest_pairs",
    f"""with {PICKED_SQL}, k as (select *, u / (pow(greatest(coalesce(num_fire, 1), 1)::double, 0.5) * case when t_full and t1_full then 1.0 when t_full then 0.7 else 0.5 end) as key from pk),
f as (select *, row_number() over (partition by fire_id order by key, day_t) as a from k),
r as (select *, row_number() over (partition by region_id order by key, fire_id, day_t) as b from f where a <= 5 and region_id > 0)
select fire_id, day_t, region_id from r where b <= 200""",
)
def t4_cheapest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cheapest(picked(spark, sf_dir), 200, 5).select("fire_id", "day_t", "region_id")


@CORE.query(
    "t3_balanced_pairs",
    f"""with {PICKED_SQL}, f as (select *, row_number() over (partition by fire_id order by (t_full and t1_full)::int desc, u, day_t) as a from pk),
k as (select *, fire_type = 1 as s, row_number() over (partition by region_id, fire_type = 1 order by -ln(u) / pow(greatest(coalesce(num_fire, 1), 1)::double, 0.5), fire_id, day_t) as rn
from f where a <= 5 and region_id > 0), n as (select region_id, least(30, count(*) filter (where s)) as ns from k group by 1)
select fire_id, day_t, region_id, fire_type from k join n using (region_id) where (s and rn <= 30) or (not s and rn <= 150 - ns)""",
)
def t3_balanced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.balanced(picked(spark, sf_dir), 150, 5).select("fire_id", "day_t", "region_id", "fire_type")


@CORE.query(
    "t5_whole_fires",
    f"""with s as (select sample_id, fire_id from {COUNTING_SQL} where fire_id is not null),
g as (select fire_id, count(*) as n, ((fire_id::bigint * 2654435761 + 42) % 1000003 + 0.5) / 1000003.0 as u from s group by 1),
c as (select fire_id, sum(n) over (order by u, fire_id) - n as ahead from g) select sample_id, fire_id from s join c using (fire_id) where ahead < 3000""",
)
def t5_whole_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole fires in hash order until 3000 samples are reached."""
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id")).filter("fire_id is not null")
    return P.whole_groups(s.select("sample_id", "fire_id"), "fire_id", 3000)


@CORE.query(
    "w4_temporal_split",
    f"""with s as (select sample_id, region_id, dt, row_number() over (partition by region_id order by dt, load_order) - 1 as i, count(*) over (partition by region_id) as n from {COUNTING_SQL})
select sample_id, region_id, dt, case when i < floor(n * 0.6::double) then 'train' when i < floor(n * (0.6::double + 0.15::double)) then 'val' else 'test' end as part from s""",
)
def w4_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "region_id", "dt"))
    return P.temporal_split(s.drop("loaded_at"), "region_id", ["dt", "load_order"]).drop("load_order")


@CORE.query(
    "a6_selection_summary",
    f"""with {PICKED_SQL} select region_id, count(*) as n, count(distinct fire_id) as n_fires, sum(n_tiles_est)::bigint as tiles, count(*) filter (where t_full and t1_full) as both_full,
quantile_cont(num_fire, 0.25) as p25, quantile_cont(num_fire, 0.5) as p50, quantile_cont(num_fire, 0.75) as p75,
round(100.0 * count(*) filter (where fire_type = 0) / count(*), 6)::double as veg_pct from pk where region_id > 0 group by rollup (region_id)""",
)
def a6_selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = picked(spark, sf_dir).filter("region_id > 0")
    return p.rollup("region_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("fire_id").alias("n_fires"), F.sum("n_tiles_est").alias("tiles"),
        F.count(F.when(F.col("t_full") & F.col("t1_full"), 1)).alias("both_full"),
        *[F.percentile("num_fire", q).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)],
        F.round(100.0 * F.count(F.when(F.col("fire_type") == 0, 1)) / F.count(F.lit(1)), 6).alias("veg_pct"),
    )


@CORE.query(
    "a7_weight_sweep",
    f"""with {PICKED_SQL}, x as (select unnest([0.0, 0.5, 1.0])::double as exponent), k as (select exponent, fire_id, day_t, region_id, num_fire,
row_number() over (partition by exponent, region_id order by -ln(u) / pow(greatest(coalesce(num_fire, 1), 1)::double, exponent), fire_id, day_t) as rn from pk, x where region_id > 0)
select exponent, region_id, count(*) as n, count(distinct fire_id) as n_fires, quantile_cont(num_fire, 0.5) as p50 from k where rn <= 100 group by 1, 2""",
)
def a7_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several weight exponents would pick."""
    x = picked(spark, sf_dir).filter("region_id > 0").withColumn("exponent", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    w = F.pow(F.greatest(F.coalesce("num_fire", F.lit(1)), F.lit(1)).cast("double"), F.col("exponent"))
    k = x.withColumn("key", P.weighted_key(P.hash_unit(P.fire_day_key(F.col("fire_id"), F.col("day_t"))), w))
    top = P.capped(k, ["exponent", "region_id"], [F.col("key"), F.col("fire_id"), F.col("day_t")], 100)
    return top.groupBy("exponent", "region_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fire_id").alias("n_fires"), F.percentile("num_fire", 0.5).alias("p50"))


@CORE.query(
    "qb_sample_pool",
    f"""with f as (select fire_id, max(num_fire) as num_fire, max(min_x) as x0, max(max_x) as x1, max(min_y) as y0, max(max_y) as y1 from fires group by 1), {PICKED_SQL}
select p.fire_id, p.day_t, f.num_fire, (greatest(1, trunc((case when x1 < x0 then x1 - x0 + 360 else x1 - x0 end) / (375 / 111320::double) / 224)) * greatest(1, trunc((y1 - y0) / (375 / 111320::double) / 224)))::integer as n_tiles
from pk p join f on p.fire_id = f.fire_id where f.num_fire >= 10""",
)
def qb_sample_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the size and tile estimate of their fire; a box across the date line is unwrapped."""
    f = table(spark, sf_dir, "fires").groupBy("fire_id").agg(*[F.max(c).alias(c) for c in ("num_fire", "min_x", "max_x", "min_y", "max_y")])
    width = F.when(F.col("max_x") < F.col("min_x"), F.col("max_x") - F.col("min_x") + 360).otherwise(F.col("max_x") - F.col("min_x"))
    f = f.filter("num_fire >= 10").select("fire_id", "num_fire", C.tile_estimate(width, F.col("max_y") - F.col("min_y"), CELL_DEG).alias("n_tiles"))
    return picked(spark, sf_dir).select("fire_id", "day_t").join(f, "fire_id")


@CORE.query(
    "w15_even_positions",
    """with f as (select fire_id, max(t_ratio) as t_ratio from fires group by 1), r as (select *, row_number() over (order by t_ratio, fire_id) - 1 as i, count(*) over () as n from f)
select fire_id, t_ratio from r where i in (select floor(k * (select count(*) - 1 from f) / 19) from generate_series(0, 19) g(k))""",
)
def w15_even_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fires").groupBy("fire_id").agg(F.max("t_ratio").alias("t_ratio"))
    return even_positions(f, ["t_ratio", "fire_id"], 20)


_FIRES_SQL = "f as (select fire_id, start_date, row_number() over (order by start_date, fire_id) - 1 as i, count(*) over () as n from (select fire_id, min(start_date) as start_date from fires group by 1))"


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fires").groupBy("fire_id").agg(F.min("start_date").alias("start_date"))


@CORE.query("w12_strided_job", f"with {_FIRES_SQL} select fire_id, start_date from f where i % 7 = 3")
def w12_strided_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strided(_starts(spark, sf_dir), ["start_date", "fire_id"], 3, 7)


@CORE.query("w13_chunks", f"with {_FIRES_SQL} select fire_id, start_date, ntile(7) over (order by start_date, fire_id)::integer - 1 as chunk from f")
def w13_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(_starts(spark, sf_dir), ["start_date", "fire_id"], 7)


@CORE.query("w14_date_slice", f"with {_FIRES_SQL} select fire_id, start_date from f where i >= n * 2 // 7 and i < n * 3 // 7")
def w14_date_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced(_starts(spark, sf_dir), ["start_date", "fire_id"], 2, 7)


# ---- orders over all rows, or over groups of which one may hold most rows

@CORE.query("t2_ordered_picks", "select fire_id, day_t, region_id, row_number() over (order by region_id, day_t, fire_id) as place from (select distinct fire_id, day_t, region_id from picked where region_id > 0) q")
def t2_ordered_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "picked").filter("region_id > 0").select("fire_id", "day_t", "region_id").distinct()
    return positions(p, ["region_id", "day_t", "fire_id"], "place").withColumn("place", F.col("place") + 1)


@CORE.query("t11_sorted_table", f"select sample_id, coalesce(num_fire, -1) as v, rank() over (order by coalesce(num_fire, -1) desc) as place from {COUNTING_SQL} s")
def t11_sorted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples ranked by a column, missing values last as -1."""
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "num_fire"))
    return ranked_values(s.select("sample_id", F.coalesce("num_fire", F.lit(-1)).alias("v")), "v", "place")


@CORE.query("t15_ratio_order", """with f as (select distinct fire_id, t_ratio from fires where t_ratio > 0) select fire_id, round(greatest(-2e0, least(2e0, log10(t_ratio))), 6) as log_ratio,
row_number() over (order by t_ratio, fire_id) as place from f""")
def t15_ratio_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive ratios in ascending order, on a log scale clipped to [0.01, 100]."""
    f = table(spark, sf_dir, "fires").filter("t_ratio > 0").select("fire_id", "t_ratio").distinct()
    log = F.round(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.log10("t_ratio"))), 6)
    return positions(f, ["t_ratio", "fire_id"], "place").select("fire_id", log.alias("log_ratio"), (F.col("place") + 1).alias("place"))


@CORE.query("t8_allocation", """with c as (select region_id, count(*) as n from picked where region_id > 0 group by region_id), k as (select distinct fire_id, day_t, region_id from picked where region_id > 0),
r as (select k.*, row_number() over (partition by k.region_id order by fire_id, day_t) as place from k)
select r.fire_id, r.day_t, r.region_id from r join c on r.region_id = c.region_id cross join (select sum(n) as total from c) t where place <= floor(1e3 * n / total)""")
def t8_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rows given to regions in proportion to their size."""
    p = table(spark, sf_dir, "picked").filter("region_id > 0")
    c = p.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    share = c.select("region_id", F.floor(1000.0 * F.col("n") / c.agg(F.sum("n")).scalar()).alias("most"))
    k = group_positions(p.select("fire_id", "day_t", "region_id").distinct(), "region_id", ["fire_id", "day_t"], "place")
    return k.join(share, "region_id").filter(F.col("place") < F.col("most")).select("fire_id", "day_t", "region_id")


@CORE.query("j33_event_samples", f"""select fire_id, sample_id, row_number() over (partition by fire_id order by dt, load_order) as place from {COUNTING_SQL} s where fire_id is not null""")
def j33_event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered samples of each event, as rows: an event may have too many for one list."""
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id", "dt")).filter("fire_id is not null")
    g = group_positions(s.drop("loaded_at"), "fire_id", ["dt", "load_order"], "place")
    return g.select("fire_id", "sample_id", (F.col("place") + 1).alias("place"))
