"""Scores of predictions. The events table stands in for pixels: user is the sample, value the probability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import scalars as S
from emberframe.operators import scoring
from emberframe.registry import CORE
from emberframe.session import materialize
from emberframe.tables import table

PIXELS_SQL = """px as (select user_id as sample_id, user_id % 5 as region_id, value / 491 as pred,
case when event_type in ('error', 'purchase') then 1 else 0 end as target, case when event_type = 'signup' then 0 else 1 end as mask from events)"""
COUNTS_SQL = """cs as (select sample_id, region_id, count(*) filter (where mask = 1 and pred > 0.5 and target = 1) as tp,
count(*) filter (where mask = 1 and pred > 0.5 and target = 0) as fp, count(*) filter (where mask = 1 and not pred > 0.5 and target = 1) as fn,
count(*) filter (where mask = 1 and not pred > 0.5 and target = 0) as tn,
coalesce(sum(pow(pred - target, 2)) filter (where mask = 1), 0) as brier_sum, count(*) filter (where mask = 1) as n from px group by 1, 2)"""


def _ratios_sql(pre: str = "") -> str:
    d = {
        "precision": "tp / nullif(tp + fp, 0)", "recall": "tp / nullif(tp + fn, 0)", "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)",
        "iou": "tp / nullif(tp + fp + fn, 0)", "brier": "brier_sum / nullif(n, 0)",
    }
    return ", ".join(f"round(coalesce({x}, 0), 6) as {k}" for k, x in d.items())


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"), F.expr("user_id % 5").alias("region_id"), (F.col("value") / 491).alias("pred"),
        F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("target"),
        F.when(F.col("event_type") == "signup", 0).otherwise(1).alias("mask"),
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@CORE.query("a12_confusion", f"with {PIXELS_SQL}, {COUNTS_SQL} select sample_id, tp, fp, fn, tn, round(brier_sum, 6) as brier_sum, n from cs")
def a12_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.confusion(pixels(spark, sf_dir), ["sample_id"]), "brier_sum")


@CORE.query("a14_sample_scores", f"with {PIXELS_SQL}, {COUNTS_SQL} select sample_id, {_ratios_sql()} from cs")
def a14_sample_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.ratios(scoring.confusion(pixels(spark, sf_dir), ["sample_id"]))
    return _rounded(s, *scoring.RATIOS).select("sample_id", *scoring.RATIOS)


_SUM_SQL = "sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn, sum(brier_sum) as brier_sum, sum(n) as n, count(*) as n_samples"


@CORE.query(
    "a13_micro_scores",
    f"with {PIXELS_SQL}, {COUNTS_SQL}, m as (select {_SUM_SQL} from cs where tp + fp + fn > 0) select n_samples, {_ratios_sql()} from m",
)
def a13_micro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.micro(scoring.confusion(pixels(spark, sf_dir), ["sample_id"]), [])
    return _rounded(s, *scoring.RATIOS).select("n_samples", *scoring.RATIOS)


@CORE.query(
    "a15_roc_auc",
    f"""with {PIXELS_SQL}, v as (select pred, target, rank() over (order by pred) + (count(*) over (partition by pred) - 1) / 2.0 as r from px where mask = 1)
select sum(target)::bigint as n_pos, (count(*) - sum(target))::bigint as n_neg,
round((sum(case when target = 1 then r end) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * (count(*) - sum(target))), 6) as auc from v""",
)
def a15_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.roc_auc(pixels(spark, sf_dir)), "auc")


_SWEEP_SQL = f"""with {PIXELS_SQL}, h as (select least(99, greatest(0, floor(pred * 100)))::integer as b, target from px where mask = 1),
g as (select unnest(generate_series(1, 99)) as b), c as (select g.b, count(*) filter (where target = 1) as tp, count(*) filter (where target = 0) as fp
from g left join h on h.b >= g.b group by 1), p as (select count(*) filter (where target = 1) as pos from h),
s as (select b / 100.0 as threshold, tp, fp, pos - tp as fn, coalesce(2 * tp / nullif(tp + fp + pos, 0), 0) as f1 from c, p)"""


@CORE.query("a16_threshold_sweep", _SWEEP_SQL + " select round(threshold, 6)::double as threshold, tp, fp, fn, round(f1, 6) as f1 from s")
def a16_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).withColumn("one", F.lit(1))
    return _rounded(scoring.sweep(p, ["one"]).drop("one"), "f1", "threshold")


@CORE.query("a16_best_threshold", _SWEEP_SQL + " select threshold::double as threshold, round(f1, 6) as f1 from s order by s.f1 desc, s.threshold limit 1")
def a16_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).withColumn("one", F.lit(1))
    return _rounded(scoring.best_threshold(scoring.sweep(p, ["one"]), ["one"]).drop("one"), "f1", "threshold")


@CORE.query(
    "a17_group_scores",
    f"""with {PIXELS_SQL}, {COUNTS_SQL}, b as (select *, case when tp + fn < 10 then 'few' else 'many' end as size from cs where tp + fp + fn > 0),
m as (select region_id, size, {_SUM_SQL} from b group by cube (region_id, size)) select region_id, size, n_samples, {_ratios_sql()} from m""",
)
def a17_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by region, size, both and overall, from one pass over the pixels."""
    s = materialize(scoring.confusion(pixels(spark, sf_dir), ["sample_id", "region_id"]))
    s = s.filter("tp + fp + fn > 0").withColumn("size", F.when(F.col("tp") + F.col("fn") < 10, "few").otherwise("many"))
    sums = s.cube("region_id", "size").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "brier_sum", "n")], F.count(F.lit(1)).alias("n_samples"))
    return _rounded(scoring.ratios(sums), *scoring.RATIOS).select("region_id", "size", "n_samples", *scoring.RATIOS)


@CORE.query(
    "a50_losses",
    f"""with {PIXELS_SQL}, l as (select sample_id, target::double as y, mask::double as m, ln(pred / (1 - pred)) as x from px),
q as (select sample_id, y, m, 1 / (1 + exp(-x)) as p, ln(1 + exp(-abs(x))) + greatest(-x, 0) as lp, ln(1 + exp(-abs(x))) + greatest(x, 0) as lq from l),
r as (select sample_id, sum((y * lp + (1 - y) * lq) * m) / greatest(sum(m), 1) as bce,
sum((0.25 * y + 0.75 * (1 - y)) * pow(1 - (p * y + (1 - p) * (1 - y)), 2) * (y * lp + (1 - y) * lq) * m) / greatest(sum(m), 1) as focal,
1 - (2 * sum(p * y * m) + 1) / (sum(p * m) + sum(y * m) + 1) as dice from q group by 1)
select sample_id, round(bce, 6) as bce, round(focal, 6) as focal, round(dice, 6) as dice, round(0.3 * focal + 0.7 * dice, 6) as hybrid from r""",
)
def a50_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.log(F.col("pred") / (1 - F.col("pred")))
    return _rounded(scoring.masked_losses(pixels(spark, sf_dir), ["sample_id"], x), "bce", "focal", "dice", "hybrid")


@CORE.query(
    "m1_persistence",
    f"""with {PIXELS_SQL}, q as (select sample_id, region_id, case when pred > 0.25 then 1.0 else 0.0 end as pred, target, mask from px),
{COUNTS_SQL.replace('from px', 'from q')}, m as (select region_id, {_SUM_SQL} from cs where tp + fp + fn > 0 group by 1) select region_id, n_samples, {_ratios_sql()} from m""",
)
def m1_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's mask as tomorrow's prediction, scored by region."""
    p = pixels(spark, sf_dir).withColumn("pred", F.when(F.col("pred") > 0.25, 1.0).otherwise(0.0))
    s = scoring.micro(scoring.confusion(p, ["sample_id", "region_id"]), ["region_id"])
    return _rounded(s, *scoring.RATIOS).select("region_id", "n_samples", *scoring.RATIOS)


GRID_SQL = """c as (select distinct user_id as p, cast(floor(value / 16) as integer) as r, (event_id * 7 % 32)::integer as k, event_type from events)"""


def _patches(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
        .select(F.col("user_id").alias("p"), F.floor(F.col("value") / 16).cast("int").alias("row"), F.expr("event_id * 7 % 32").cast("int").alias("col")).distinct()
    )


@CORE.query(
    "m2_morphological",
    f"""with {GRID_SQL}, a as (select p, r, k from c where event_type = 'view'), t as (select p, r, k from c where event_type = 'click'),
d as (select distinct q.rad, p, r + i as r, k + j as k from a, (select unnest([1, 2, 3]) as rad) q, (select unnest(generate_series(-3, 3)) as i) x, (select unnest(generate_series(-3, 3)) as j) y
where i * i + j * j <= rad * rad and r + i between 0 and 31 and k + j between 0 and 31),
s as (select rad, count(t.p) as tp, count(*) - count(t.p) as fp, (select count(*) from t) - count(t.p) as fn from d left join t on t.p = d.p and t.r = d.r and t.k = d.k group by 1)
select rad::integer as radius, tp, fp, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from s""",
)
def m2_morphological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dilation of today's mask by disks of several radii, scored against tomorrow's mask."""
    a, t = materialize(_patches(spark, sf_dir, "view")), materialize(_patches(spark, sf_dir, "click"))
    total = t.agg(F.count(F.lit(1)).alias("n"))
    out = None
    for radius in (1, 2, 3):
        d = scoring.dilate(a, ["p"], radius, 32, 32).join(t.withColumn("y", F.lit(1)), ["p", "row", "col"], "left")
        one = d.agg(F.count("y").alias("tp"), F.count(F.when(F.col("y").isNull(), 1)).alias("fp")).select(F.lit(radius).alias("radius"), "tp", "fp")
        out = one if out is None else out.union(one)
    out = out.withColumn("fn", total.scalar() - F.col("tp"))
    return out.withColumn("f1", F.round(scoring.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


@CORE.query(
    "m5_ablation",
    f"""with {PIXELS_SQL}, v as (select 'full' as variant, * from px union all select 'half', sample_id, region_id, pred / 2, target, mask from px
union all select 'zero', sample_id, region_id, 0.0, target, mask from px),
f as (select variant, 2 * count(*) filter (where pred > 0.5 and target = 1) / nullif(2 * count(*) filter (where pred > 0.5 and target = 1)
+ count(*) filter (where pred > 0.5 and target = 0) + count(*) filter (where pred <= 0.5 and target = 1), 0) as f1 from v where mask = 1 group by 1)
select variant, round(coalesce(f1, 0), 6) as f1, round((select f1 from f where variant = 'full') - coalesce(f1, 0), 6) as f1_drop from f""",
)
def m5_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of F1 of each prediction set against the first."""
    p = pixels(spark, sf_dir)
    x = p.withColumn("variant", F.explode(F.array(*map(F.lit, ("full", "half", "zero")))))
    x = x.withColumn("pred", F.when(F.col("variant") == "half", F.col("pred") / 2).when(F.col("variant") == "zero", 0.0).otherwise(F.col("pred")))
    f = scoring.ratios(scoring.confusion(x, ["variant"])).select("variant", "f1")
    base = f.filter("variant = 'full'").select("f1").scalar()
    return f.select("variant", F.round("f1", 6).alias("f1"), F.round(base - F.col("f1"), 6).alias("f1_drop"))


@CORE.query(
    "f20_centred_scores",
    f"""with {PIXELS_SQL} select sample_id, round(avg(least(1, greatest(0, case when pred < 0.38 then 0.5 * pred / 0.38 else 0.5 + 0.5 * (pred - 0.38) / 0.62 end))), 6) as centred from px group by 1""",
)
def f20_centred_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("sample_id").agg(F.round(F.avg(S.centred_at("pred", 0.38)), 6).alias("centred"))
