"""Named queries of the operators on training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm.automaton import find_passages, remove_passages
from emberframe.llm.components import assign_splits, torn, with_component
from emberframe.llm.cube import cube_sample
from emberframe.llm.mixing import mix_sources, proper_source, token_counts
from emberframe.llm.quantiles import compact_states, multi_select, value_states
from emberframe.llm.scenes import members, overlaps, scene_classes
from emberframe.llm.sentences import sentences
from emberframe.registry import Registry
from emberframe.session import materialize
from emberframe.tables import (
    COUNTING_SQL,
    FIRE_SQL,
    LON_SQL,
    SPLIT_SQL,
    counting,
    fire_by_right,
    latitude,
    longitude,
    split_meaning,
    table,
)

LLM = Registry()
SHARES = {"train": 0.60, "val": 0.15, "test": 0.25}
FRACTIONS = [0.25, 0.5, 0.9, 0.99, 0.999]
SCENE_KM, SCENE_DAYS = 0.2, 1

# ---- 1: splits that keep related records together


def _links() -> dict[str, Column]:
    return {"fire.recorded": F.col("fire_id"), "fire.tile": F.col("tile_fire")}


def _linkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting samples with both names of their fire: fire_id and the number in tile_key name one and the same."""
    s = counting(
        table(spark, sf_dir, "samples").select(
            "sample_id", "load_order", "loaded_at", "fire_id", "tile_key", "region_id", "dt", "split"
        )
    )
    return materialize(
        s.select("sample_id", "load_order", "fire_id", "tile_key", "region_id", "dt", split_meaning().alias("split"))
        .withColumn("fire", fire_by_right())
        .withColumn("tile_fire", F.expr("try_cast(nullif(regexp_extract(tile_key, '([0-9]+)', 1), '') as int)"))
        .drop("tile_key")
    )


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_component(_linkable(spark, sf_dir), _links(), F.coalesce("sample_id", "load_order"))


@LLM.query(
    "p1_found",
    f"""select fire as fire_id from (select {FIRE_SQL} as fire, {SPLIT_SQL} as s from {COUNTING_SQL})
where fire is not null group by 1 having count(distinct s) > 1""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires by right in more than one split: components that hold marks of several, then their fires one by one.

    A component may join two fires by a record that names both; the exact step keeps those that carry several splits themselves.
    """
    marks = torn(_linkable(spark, sf_dir), _links(), F.col("split"))
    exact = marks.groupBy("node").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).filter("a <> b")
    return exact.select(F.regexp_extract("node", "^fire:(.*)$", 1).cast("int").alias("fire_id"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_linked(spark, sf_dir))
    # A component's stratum is the region that most of its samples carry, ties to the smaller one.
    by = rows.groupBy("component", F.when(F.col("region_id") > 0, F.col("region_id")).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    comps = by.groupBy("component").agg(
        F.sum("n").alias("n"),
        F.max(F.when(F.col("r").isNotNull(), F.struct("n", (-F.col("r")).alias("r")))).alias("top"),
    )
    comps = comps.select("component", "n", (-F.col("top.r")).cast("string").alias("stratum"))
    years = rows.groupBy("component", F.coalesce(F.year("dt").cast("string"), F.lit("none")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(assign_splits(comps, SHARES, periods=years).select("component", F.col("split").alias("new_split")), "component")


@LLM.query("p1_splits")
def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counting sample with its fire's split."""
    return _assigned(spark, sf_dir).select("sample_id", "fire", "component", F.col("new_split").alias("split"))


@LLM.query("p1_balance")
def p1_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the new splits overall, by region_id and by year of dt, beside their targets."""
    a = _assigned(spark, sf_dir).select(F.col("new_split").alias("split"), F.col("region_id").cast("string").alias("region"), F.year("dt").cast("string").alias("year"))
    sets = a.groupingSets([["split"], ["split", "region"], ["split", "year"]], "split", "region", "year").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("region").alias("gr"), F.grouping("year").alias("gy")
    )
    of = F.when(F.col("gr") == 0, "region").when(F.col("gy") == 0, "year").otherwise("all")
    out = sets.select(of.alias("level"), F.coalesce("region", "year").alias("value"), "split", "n")
    whole = out.groupBy("level", "value").agg(F.sum("n").alias("all_n"))
    target = F.create_map(*[x for s, w in SHARES.items() for x in (F.lit(s), F.lit(w))])
    same = (F.col("o.level") == F.col("w.level")) & F.col("o.value").eqNullSafe(F.col("w.value"))
    return out.alias("o").join(whole.alias("w"), same).select(
        "o.level", "o.value", "split", "n", (F.col("n") / F.col("all_n")).alias("share"), target[F.col("split")].alias("target")
    )


# ---- 3: sample matching target category proportions


def _cube(spark: SparkSession, sf_dir: str, fill: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, sf_dir, "picked").select("fire_id", "day_t", "region_id", "fire_type", "num_fire")
    keys = p.filter("fire_id is not null and day_t is not null and region_id > 0 and fire_type >= 0").groupBy("fire_id", "day_t").agg(
        F.min(F.struct("region_id", "fire_type")).alias("c"), F.max("num_fire").alias("num_fire")
    )
    name = lambda a, b: F.concat_ws(":", a, b)
    units = materialize(
        keys.select(
            "fire_id", "day_t", F.col("c.region_id").alias("region_id"), F.col("c.fire_type").alias("fire_type"),
            F.concat_ws("@", "fire_id", "day_t").alias("unit"), name("c.region_id", "c.fire_type").alias("category"),
            F.log1p("num_fire").alias("log_size"),
        )
    )
    mix = table(spark, sf_dir, "target_mix")
    targets = mix.select(name("region_id", "fire_type").alias("category"), F.col("target_share").alias("share"), "min_rows")
    size = units.count() / 10.0
    sample, report = cube_sample(units, targets, size, balance=["log_size"], fill=fill)
    return units, sample, report


def _categories(df: DataFrame) -> DataFrame:
    part = F.split("category", ":")
    return df.withColumn("region_id", part[0].cast("int")).withColumn("fire_type", part[1].cast("int")).drop("category")


_MIX_SQL = """
with k as (select fire_id, day_t, min(region_id) as region_id, min(fire_type) as fire_type from picked
where fire_id is not null and day_t is not null and region_id > 0 and fire_type >= 0 group by 1, 2),
n as (select count(*) / 10.0 as n from k),
h as (select region_id, fire_type, count(*) as available from k group by 1, 2),
m as (select t.region_id, t.fire_type, target_share, min_rows, coalesce(available, 0) as available,
greatest(min_rows, target_share * n) as wanted from target_mix t cross join n
left join h on h.region_id = t.region_id and h.fire_type = t.fire_type)"""


@LLM.query("p3_found", _MIX_SQL + " select region_id, fire_type from m where available < wanted")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target categories of which the sample took every unit and that are still short of their target.

    It is the sample in which every category strives for its own target, whatever the others lack.
    """
    _, _, report = _cube(spark, sf_dir, fill=False)
    return _categories(report.filter("left = 0 and drawn < wanted").select("category"))


@LLM.query("p3_sample")
def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as a tenth of the valid keys; what some categories lack comes from the others."""
    units, sample, _ = _cube(spark, sf_dir)
    return units.join(sample.select("unit"), "unit", "left_semi").select("fire_id", "day_t", "region_id", "fire_type")


@LLM.query(
    "p3_report",
    _MIX_SQL + """ select region_id, fire_type, min_rows, available, round(wanted, 6) as wanted,
round(case when available < wanted then wanted - available else 0 end, 6) as shortfall from m""",
)
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, report = _cube(spark, sf_dir)
    return _categories(report).select(
        "region_id", "fire_type", "min_rows", "available", F.round("wanted", 6).alias("wanted"), F.round("shortfall", 6).alias("shortfall")
    )


@LLM.query("p3_balance")
def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was drawn of each category, the residual imbalance, and the mean size (log of num_fire) in sample and pool."""
    units, sample, report = _cube(spark, sf_dir)
    pool = units.groupBy("category").agg(F.avg(F.coalesce("log_size", F.lit(0.0))).alias("pool_mean"))
    mine = units.join(sample.select("unit"), "unit", "left_semi").groupBy("category").agg(F.avg(F.coalesce("log_size", F.lit(0.0))).alias("sample_mean"))
    out = report.join(pool, "category", "left").join(mine, "category", "left")
    return _categories(out).select("region_id", "fire_type", "wanted", "drawn", "residual", "pool_mean", "sample_mean")


# ---- 4: percentiles of very large numeric columns


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of picked.num_fire by month of day_t; a repeated key counts once, region 0 is no region."""
    p = table(spark, sf_dir, "picked").groupBy("fire_id", "day_t").agg(
        F.max(F.when(F.col("region_id") > 0, F.col("region_id"))).alias("region_id"), F.max("num_fire").alias("num_fire")
    )
    return value_states(p.withColumn("month", F.date_format("day_t", "yyyy-MM")), "region_id", "num_fire", "month")


_PICKED_SQL = """(select fire_id, day_t, max(case when region_id > 0 then region_id end) as region_id,
max(num_fire) as num_fire from picked group by 1, 2)"""


@LLM.query(
    "p4_percentiles",
    f"""select region_id, cast(f as double) as fraction, cast(v as double) as value, n_rows, 0 as rank_error from (
select region_id, count(num_fire) as n_rows, unnest({FRACTIONS}) as f,
unnest(quantile_disc(num_fire, {FRACTIONS})) as v from {_PICKED_SQL} where num_fire is not null group by 1)""",
)
def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = materialize(_monthly(spark, sf_dir))
    found = multi_select(states, FRACTIONS)
    return found.withColumnRenamed("grp", "region_id")


@LLM.query(
    "p4_months",
    f"""select strftime(day_t, '%Y-%m') as month, region_id, count(num_fire) as n_rows, count(distinct num_fire) as n_values
from {_PICKED_SQL} where num_fire is not null group by 1, 2""",
)
def p4_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the monthly states that are combined."""
    return _monthly(spark, sf_dir).groupBy(F.col("part").alias("month"), F.col("grp").alias("region_id")).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values")
    )


POINTS = 32


@LLM.query(
    "p4_compact",
    f"""with p as (select strftime(day_t, '%Y-%m') as m, region_id, num_fire from {_PICKED_SQL} where num_fire is not null),
s as (select m, region_id, num_fire, count(*) as n, count(*) over (partition by m, region_id) as values_ from p group by 1, 2, 3),
c as (select region_id, num_fire as v, cast(n as double) as n from s where values_ <= {POINTS} union all
select region_id, unnest(quantile_disc(num_fire, {[(j + 0.5) / POINTS for j in range(POINTS)]})) as v, count(*) / {POINTS}.0 as n
from p group by m, region_id having count(distinct num_fire) > {POINTS}),
w as (select region_id, v, sum(n) as n from c group by 1, 2),
r as (select region_id, v, sum(n) over (partition by region_id order by v) as c, sum(n) over (partition by region_id) as t from w)
select region_id, cast(f as double) as fraction, cast(min(v) as double) as value, cast(max(t) as bigint) as n_rows, cast({0.5 / POINTS} as double) as rank_error
from r cross join (select unnest({FRACTIONS}) as f) where c >= greatest(1, ceil(f * t - 1e-9)) group by 1, 2""",
)
def p4_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles from monthly states of at most POINTS values, with the rank error that this costs at most."""
    small = compact_states(materialize(_monthly(spark, sf_dir)), POINTS)
    return multi_select(materialize(small), FRACTIONS).withColumnRenamed("grp", "region_id")


# ---- 6: same or near-same records across splits


def _scenes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = counting(
        table(spark, sf_dir, "samples").select(
            "sample_id", "load_order", "loaded_at", "fire_id", "tile_key", "xi", "yi", "lon", "lat", "dt", "split", "source"
        )
    )
    split = split_meaning()
    side = F.when(split == "train", "train").when(split.isNotNull(), "eval")
    rows = s.select(
        "sample_id", split.alias("split"), side.alias("side"), fire_by_right().alias("fire"), "xi", "yi",
        latitude().alias("lat"), longitude().alias("lon"), "dt", "source",
    ).filter("side is not null and sample_id is not null")
    rows = materialize(rows)
    classes = materialize(scene_classes(rows))
    found = materialize(overlaps(classes, SCENE_KM, SCENE_DAYS))
    return rows, classes, found


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene pairs expanded to samples: train and eval sample, split and source of the latter."""
    rows, classes, found = _scenes(spark, sf_dir)
    hit = classes.join(found.select(F.explode(F.array("train_scene", "eval_scene")).alias("scene")).distinct(), "scene", "left_semi")
    m = members(rows, hit).select("scene", "side", "sample_id", "split", "source")
    a = m.filter("side = 'train'").select(F.col("scene").alias("train_scene"), F.col("sample_id").alias("train_id"))
    b = m.filter("side = 'eval'").select(F.col("scene").alias("eval_scene"), F.col("sample_id").alias("eval_id"), "split", "source")
    return found.join(a, "train_scene").join(b, "eval_scene")


_PLACED_SQL = f"""
p as (select sample_id, {FIRE_SQL} as fire, {LON_SQL} as ln, lat, dt, xi, yi, {SPLIT_SQL} as s, source from {COUNTING_SQL}),
t as (select * from p where s = 'train'), e as (select * from p where s in ('val', 'test')),
q as (select t.sample_id as train_id, e.sample_id as eval_id from t join e
on t.fire = e.fire and t.xi = e.xi and t.yi = e.yi and abs(date_diff('day', t.dt, e.dt)) <= 1
union select x.sample_id, y.sample_id from t x join e y
on abs(x.lat - y.lat) < 0.002 and abs(date_diff('day', x.dt, y.dt)) <= 1 where 2 * 6371.0088 * asin(least(1.0, sqrt(
pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.ln - x.ln) / 2), 2)))) <= 0.2)"""


@LLM.query(
    "p6_found",
    f"with {_PLACED_SQL} select least(train_id, eval_id) as sample_id_a, greatest(train_id, eval_id) as sample_id_b from q",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(
        F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b")
    )


@LLM.query(
    "p6_overlaps",
    f"with {_PLACED_SQL} select s as split, source, count(*) as n_eval, count(distinct e.sample_id) filter (where q.eval_id is not null) as n_leaked "
    "from (select sample_id, s, source from e) e left join (select distinct eval_id from q) q on q.eval_id = e.sample_id group by 1, 2",
)
def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the val and test samples of each source, how many show a scene that stands in train."""
    rows, classes, found = _scenes(spark, sf_dir)
    leaked = found.select(F.col("eval_scene").alias("scene")).distinct().withColumn("leaked", F.lit(1))
    marked = classes.filter("side = 'eval'").join(leaked, "scene", "left")
    return members(rows.filter("side = 'eval'"), marked.drop("leaked")).join(leaked, "scene", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_eval"), F.count("leaked").alias("n_leaked")
    )


# ---- 7: evaluation texts leaking into training text


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_passages"))


@LLM.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


@LLM.query("p7_leaks")
def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with its longest run and the share of the item that it makes."""
    return _leaks(spark, sf_dir).withColumn("share", F.col("longest") / F.col("item_size"))


@LLM.query("p7_items")
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the documents it leaked to, by source, and the longest run."""
    leaks = _leaks(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", proper_source().alias("source"))
    return leaks.join(docs, "doc_id").groupBy("item_id", "source").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.max("longest").alias("longest")
    )


@LLM.query("p7_cleaned")
def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the leaked spans."""
    return remove_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


# ---- 8: mixing sources to target weights


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), proper_source().alias("source"), "text")
    return mix_sources(materialize(token_counts(d)), table(spark, sf_dir, "source_weights"))


@LLM.query(
    "p8_found",
    # The ways to count agree on the sources that fall short; bytes stand for tokens here.
    r"""with d as (select regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') as source, sum(strlen(text)) as t from documents group by 1)
select w.source from source_weights w left join d on d.source = w.source
where coalesce(t, 0) * max_repeats < target_share * (select sum(t) from d)""",
)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which the mix takes every record as often as it may, its threshold at the end, and that still fall short."""
    return _mixed(spark, sf_dir)[1].filter("mixed = available * max_repeats and mixed < wanted").select("source")


@LLM.query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


@LLM.query("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is taken."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


# ---- 9: sentence boundaries


@LLM.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents")).select("doc_id", "end_char")


@LLM.query("p9_sentences")
def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its place."""
    return sentences(table(spark, sf_dir, "documents"))
