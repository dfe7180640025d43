"""Sources and sinks, streams and models, each run over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators import coverage as C
from emberframe.operators import models as M
from emberframe.plans.picking import _LINKS_SQL, _MODAL_SQL, fire_regions, images, links
from emberframe.registry import CORE
from emberframe.session import materialize, shared_dir
from emberframe.sources import store as S
from emberframe.streaming import windows as W
from emberframe.tables import COUNTING_SQL, LON_SQL, counting, latitude, longitude, table


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/emberframe-{uuid.uuid4().hex}"


@CORE.query("s1_store_round_trip", "select fire_id, num_fire, min_x, max_x, 0 as t_full, start_date from fires where country = 30")
def s1_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved by country and read back for one of them, with a declared column that the file lacks."""
    st = S.Store(spark, _folder(spark))
    st.save("fires", table(spark, sf_dir, "fires"), by=["country"])
    return st.load("fires", "fire_id int, num_fire int, min_x double, max_x double, t_full int, start_date date", country=30)


@CORE.query("s3_json_round_trip", "select fire_id, start_date, t_ratio, num_fire from fires")
def s3_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.to_json_rows(table(spark, sf_dir, "fires"))
    back = F.from_json("json", "fire_id int, start_date date, t_ratio double, num_fire int", {"dateFormat": "yyyy-MM-dd"})
    return rows.select(back.alias("r")).select("r.*")


@CORE.query("s22_json_file", "select region_id, short_name, crop_is_veg from regions")
def s22_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a JSON document and read under a schema that drops the other keys."""
    path = _folder(spark)
    S.write_json_document(table(spark, sf_dir, "regions"), path)
    return spark.read.schema("region_id int, short_name string, crop_is_veg boolean").json(path)


@CORE.query("s23_iso_dates", "select sample_id, date_diff('day', date '2018-01-01', dt)::integer as day, tile_key from samples")
def s23_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are ISO dates throughout become dates."""
    s = table(spark, sf_dir, "samples").select("sample_id", F.col("dt").cast("string").alias("dt"), "tile_key")
    return S.iso_dates(s).select("sample_id", F.datediff("dt", F.lit("2018-01-01")).alias("day"), "tile_key")


@CORE.query("s24_resumed_write", "select fire_id, day_t, count(*) as n from (select distinct fire_id, day_t from picked) p group by 1, 2")
def s24_resumed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer that is run twice, the first time with part of the rows, stores each key once."""
    st, p = S.Store(spark, _folder(spark)), table(spark, sf_dir, "picked").select("fire_id", "day_t", "num_fire")
    st.write_missing("picked", p.filter("fire_id < 1000"), ["fire_id", "day_t"])
    st.write_missing("picked", p, ["fire_id", "day_t"])
    st.write_missing("picked", p, ["fire_id", "day_t"])
    return st.load("picked").groupBy("fire_id", "day_t").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("s24_replaced_shards", "select region_id, case when region_id = 3 then n * 2 else n end as n from (select region_id, count(*) as n from picked where region_id > 0 group by 1)")
def s24_replaced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition overwritten, the others left alone."""
    st = S.Store(spark, _folder(spark))
    p = table(spark, sf_dir, "picked").filter("region_id > 0").select("fire_id", "day_t", "region_id")
    st.save("shards", p, by=["region_id"])
    st.replace_keys("shards", p.filter("region_id = 3").union(p.filter("region_id = 3")), ["region_id"])
    return st.load("shards").groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))


@CORE.query(
    "s27_distilled",
    f"""with s as (select sample_id, ntile(5) over (order by dt, load_order)::integer - 1 as file, dt, load_order from {COUNTING_SQL})
select sample_id, file, (row_number() over (partition by file order by dt, load_order) - 1)::integer as index from s""",
)
def s27_distilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "dt")).drop("loaded_at")
    return S.distilled(s, 5, ["dt", "load_order"]).select("sample_id", "file", "index")


@CORE.query(
    "s28_manifest",
    f"""with {_LINKS_SQL}, {_MODAL_SQL}, r as (select region_id, image_id, row_number() over (partition by region_id order by num_fire_pixels desc, image_id) as rank from m join img using (image_id) where rn = 1 and region_id > 0)
select region_id, count(*) as n_images, md5(to_json(list_sort(list('f' || image_id)))) as files from r where rank <= 100 group by 1""",
)
def s28_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the hundred images that each region keeps."""
    top = C.top_images(links(spark, sf_dir), fire_regions(spark, sf_dir), images(spark, sf_dir), 100)
    m = S.manifest(top.select("region_id", F.concat(F.lit("f"), F.col("image_id").cast("string")).alias("file_name")), "region_id")
    return m.withColumn("files", F.md5(F.col("files").cast("binary")))


@CORE.query(
    "s30_matrix_sink",
    "select l_returnflag as model, round(avg(case when l_linestatus = 'F' then l_discount end), 6) as \"F\", round(avg(case when l_linestatus = 'O' then l_discount end), 6) as \"O\" from lineitem group by 1",
)
def s30_matrix_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix written as CSV and read back."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), "l_linestatus").agg(F.round(F.avg("l_discount"), 6).alias("v"))
    path = _folder(spark)
    S.write_matrix(m, "model", "l_linestatus", "v", path, ["F", "O"])
    return spark.read.option("header", "true").schema("model string, F double, O double").csv(path)


@CORE.query(
    "s31_run_documents",
    """select 'transfer_' || lower(l_returnflag) || case when l_linestatus = 'F' then '_nf' else '_nm' end as tag, case when l_linestatus = 'F' then 'nf' else 'nm' end as target,
lower(l_returnflag) as region, round(avg(l_discount), 6) as f1 from lineitem group by l_returnflag, l_linestatus""",
)
def s31_run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as one folder a run, and collected again by pattern."""
    end = F.when(F.col("l_linestatus") == "F", "_nf").otherwise("_nm")
    r = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("transfer_"), F.lower("l_returnflag"), end).alias("tag")).agg(F.round(F.avg("l_discount"), 6).alias("f1"))
    path = _folder(spark)
    r.write.mode("overwrite").partitionBy("tag").json(path)
    return S.collect_runs(spark, f"{path}/*/*.json", "f1 double").select("tag", "target", "region", "f1")


@CORE.query("s7_granules")
def s7_granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table files themselves as granules: read as bytes on the executors, parsed to name and footer."""

    def parse(path: str, content: bytes):
        if content[-4:] != b"PAR1":
            raise ValueError("no table")
        yield path.rsplit("/", 1)[1], len(content), int.from_bytes(content[-8:-4], "little")

    return S.granule_rows(spark, f"{sf_dir}/region*.parquet", parse, "name string, n_bytes long, footer long")[0]


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detection granules, one a batch of rows; of every eighth the last byte is missing."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for k, part in pdf.groupby(pdf["event_id"] % 40):
                raw = (part["value"] * 100).round().clip(0, 65535)
                content = S.pack_granule(part["event_id"], part["user_id"] - 75.0, part["value"] / 10, raw, 50.0, 1000.0, 40000)
                yield pd.DataFrame({"path": [f"g{k}"], "content": [content[:-1] if k % 8 == 7 else content]})

    return e.mapInPandas(run, "path string, content binary")


_GRANULE_SQL = "event_id % 40 % 8 <> 7"


@CORE.query(
    "s8_detections",
    f"""select event_id as det_id, user_id - 75.0 as lon, round(value / 10, 6) as lat,
case when round_even(value * 100, 0) <= 40000 then round((round_even(value * 100, 0) - 1000) / 50, 6) end as intensity from events where {_GRANULE_SQL}""",
)
def s8_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections read from granules, with calibrated intensity."""
    rows, _ = S.parsed_granules(_packed(spark, sf_dir), S.read_granule, S.GRANULE_SCHEMA)
    return rows.select("det_id", "lon", F.round("lat", 6).alias("lat"), F.round("intensity", 6).alias("intensity"))


@CORE.query("s8_rejects", f"select distinct 'g' || (event_id % 40) as path, 'ValueError' as kind from events where not ({_GRANULE_SQL})")
def s8_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granules that could not be read, and why."""
    _, rejects = S.parsed_granules(_packed(spark, sf_dir), S.read_granule, S.GRANULE_SCHEMA)
    return rejects.select("path", F.regexp_extract("reason", "^[^:]+", 0).alias("kind")).distinct()


# ---- streams


def run_stream(stream: DataFrame) -> DataFrame:
    """Runs an append stream over all that is there, into the shared folder, and reads the result."""
    spark = stream.sparkSession
    at = _folder(spark)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


_MARK_SQL = "m as (select max(ts) - interval 1 day as mark from events)"


@CORE.query(
    "st0_daily_counts",
    f"with {_MARK_SQL} select cast(ts as date) as day, event_type, count(*) as n from events, m where cast(ts as date) + interval 1 day <= mark group by 1, 2",
)
def st0_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the days that the watermark has passed."""
    return run_stream(W.daily_counts(event_stream(spark, sf_dir), "ts", ["event_type"]))


@CORE.query(
    "st1_fire_histories",
    f"""with {_MARK_SQL}, h as (select user_id as fire_id, min(ts) as first_day, max(ts) as last_day, count(*) as n from events group by 1)
select fire_id, date_trunc('millisecond', first_day)::timestamp as first_day, date_trunc('millisecond', last_day)::timestamp as last_day, n from h, m where last_day + interval 1 day < mark""",
)
def st1_fire_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burning periods of fires that have been quiet for a day; the whole table arrives in one batch."""
    e = event_stream(spark, sf_dir).select(F.col("user_id").alias("fire_id"), "ts")
    return run_stream(W.fire_histories(e, quiet_days=1))


@CORE.query(
    "st2_merged_passes",
    f"""with {_MARK_SQL}, o as (select cast(ts as date) as day, user_id, (event_id % 10)::integer as obs from events),
k as (select day, user_id, max(case when obs in (4, 6) then 1 when obs in (3, 5) then 2 when obs in (7, 8, 9) then 3 else 0 end * 256 + obs) as k from o group by 1, 2)
select day, user_id, (k % 256)::integer as obs from k, m where day + interval 1 day <= mark""",
)
def st2_merged_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).withColumn("obs", F.expr("cast(event_id % 10 as int)"))
    return run_stream(W.merged_passes(e, "ts", ["user_id"], "obs"))


# ---- models


@CORE.query(
    "a34_covariance",
    """with v as (select vec_id, unnest(generate_series(1, len(embedding))) as i, unnest(embedding)::double as x from embeddings)
select (a.i - 1)::integer as i, (b.i - 1)::integer as j, round(covar_pop(a.x, b.x), 7) + 0.0 as cov from v a join v b on a.vec_id = b.vec_id group by 1, 2""",
)
def a34_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.covariance(table(spark, sf_dir, "embeddings"), "embedding")
    return c.withColumn("cov", F.round("cov", 7) + 0.0)


@CORE.query("a34_components")
def a34_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors on their first five principal components."""
    e = table(spark, sf_dir, "embeddings")
    _, directions = M.principal_components(e, "embedding", 5)
    return M.project_components(e, "embedding", directions).select("vec_id", *[F.round(F.col("components")[i], 6).alias(f"c{i}") for i in range(5)])


def _projected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, M.CalibratedProjection]:
    e = table(spark, sf_dir, "embeddings").withColumns({"height": F.col("embedding")[0].cast("double") + F.col("embedding")[1].cast("double"), "odd": F.expr("cast(label % 2 = 1 as int)")})
    p = M.calibrated_projection(e, "embedding", ["height"], "odd", 4)
    return p.project(e, "embedding"), p


@CORE.query("m6_projection")
def m6_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors on the directions of a number and of a class, and on the components of the rest."""
    e, p = _projected(spark, sf_dir)
    return e.select("vec_id", *[F.round(F.col("coords")[i], 6).alias(n) for i, n in enumerate(p.names)])


@CORE.query("m7_region_clusters")
def m7_region_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters fitted on a bounded sample of each region (label) and given to every vector."""
    e, _ = _projected(spark, sf_dir)
    return M.region_clusters(e, "coords", "label", "vec_id", 8).select("vec_id", "label", "cluster")


@CORE.query("m7_clusters")
def m7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.clusters(table(spark, sf_dir, "embeddings"), "embedding", 10).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


@CORE.query("m6_probes")
def m6_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well embeddings tell their first coordinate's square and their label."""
    e = table(spark, sf_dir, "embeddings").withColumns({"y": F.pow(F.col("embedding")[0].cast("double"), 2), "label": F.col("label").cast("double")})
    p = M.probes(materialize(e), "embedding", "y", "label")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(p.items())], "probe string, score double")


@CORE.query("s17_embedding_bands", "select vec_id, round(embedding[1]::double, 6) as b0, round(embedding[64]::double, 6) as b63, len(embedding)::integer as n from embeddings")
def s17_embedding_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("b0"), F.round(F.col("embedding")[63].cast("double"), 6).alias("b63"), F.size("embedding").alias("n"))


@CORE.query("s20_source_registry", "select 'fires' as source, count(*) as n from fires union all select 'picked', count(*) from picked union all select 'samples', count(*) from samples")
def s20_source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of lazily opened sources."""
    r = S.Sources()
    for name in ("fires", "picked", "samples"):
        r.register(name, lambda name=name: table(spark, sf_dir, name))
    one = lambda name: r.get(name).agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"))
    return one("fires").union(one("picked")).union(one("samples"))


@CORE.query(
    "j26_merged_metrics",
    """with m as (select user_id as id, event_type as model, avg(value / 491) as iou from events where event_type <> 'view' group by 1, 2)
select id, count(*) as n_models, round(max(case when model = 'click' then iou end), 6) as click, round(max(case when model = 'error' then iou end), 6) as error from m group by 1""",
)
def j26_merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of several models gathered into a map per sample and read back from it."""
    m = table(spark, sf_dir, "events").filter("event_type <> 'view'").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("model")).agg(F.avg(F.col("value") / 491).alias("iou"))
    g = m.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("model", "iou"))).alias("metrics"))
    get = lambda k: F.round(F.try_element_at("metrics", F.lit(k)), 6).alias(k)
    return g.select("id", F.size("metrics").cast("bigint").alias("n_models"), get("click"), get("error"))


@CORE.query(
    "a45_event_rollup",
    f"""with s as (select *, {LON_SQL} as ln, case when abs(lat) <= 90 then lat end as la, row_number() over (partition by fire_id order by dt, load_order) as a from {COUNTING_SQL} q where fire_id is not null),
c as (select *, case when max(ln) over (partition by fire_id) - min(ln) over (partition by fire_id) > 180 and ln < 0 then ln + 360 else ln end as lu from s),
m as (select fire_id as id, min(dt) as start, max(dt) as "end", (date_diff('day', min(dt), max(dt)) + 1)::integer as duration_days, avg(lu) as lon, round(avg(la), 6) as lat,
count(*) as n_samples, max(case when a = 1 then sample_id end) as first_sample from c group by 1)
select id, start, "end", duration_days, round(case when lon >= 180 then lon - 360 else lon end, 6) as lon, lat, n_samples, first_sample from m""",
)
def a45_event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their span, centre and first sample, both conventions of longitude being brought to one; an event that spans more than 180 degrees lies across the
    date line, and its western longitudes are averaged beyond 180."""
    s = counting(table(spark, sf_dir, "samples").select("sample_id", "load_order", "loaded_at", "fire_id", "dt", "lon", "lat")).filter("fire_id is not null")
    s = s.withColumns({"lon": longitude(), "lat": latitude()})
    east = F.avg(F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon")))
    lon = F.when(F.max("lon") - F.min("lon") > 180, east).otherwise(F.avg("lon"))
    return _rollup(s, F.when(lon >= 180, lon - 360).otherwise(lon))


def _rollup(s: DataFrame, lon: Column) -> DataFrame:
    return s.groupBy(F.col("fire_id").alias("id")).agg(
        F.min("dt").alias("start"), F.max("dt").alias("end"), (F.datediff(F.max("dt"), F.min("dt")) + 1).alias("duration_days"),
        F.round(lon, 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count(F.lit(1)).alias("n_samples"),
        F.min(F.struct("dt", "load_order", "sample_id"))["sample_id"].alias("first_sample"),
    )
