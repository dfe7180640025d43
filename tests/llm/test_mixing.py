import random

from emberframe.llm.mixing import mix_sources, proper_source, token_counts


def records(spark, sizes, seed=1):
    r = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, r.randrange(1, 80)))
            i += 1
    return spark.createDataFrame(rows, "id long, source string, tokens long")


def weights(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_repeats_and_shortfalls(spark):
    d = records(spark, {"a": 4000, "b": 400, "c": 20, None: 30, "other": 50})
    mix, report = mix_sources(d, weights(spark, [("a", 0.5, 1), ("b", 0.25, 4), ("c", 0.2, 3), ("gone", 0.05, 2)]))
    r = {x["source"]: x for x in report.collect()}
    for s in ("a", "b"):
        assert abs(r[s]["mixed"] - r[s]["wanted"]) <= 80 and r[s]["shortfall"] == 0
    assert r["c"]["mixed"] == 3 * r["c"]["available"] and r["c"]["shortfall"] > 0 and r["gone"]["shortfall"] > 0
    assert r["other"]["mixed"] == 0 and r[None]["mixed"] == 0 and abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    copies = {x["source"]: x["m"] for x in mix.groupBy("source").agg({"copies": "max"}).withColumnRenamed("max(copies)", "m").collect()}
    assert copies["a"] == 1 and copies["b"] <= 4 and copies["c"] == 3


def test_budgets_are_nested(spark):
    d = records(spark, {"a": 1500})
    w = weights(spark, [("a", 1.0, 1)])
    small, large = ({x["id"] for x in mix_sources(d, w, size=n)[0].collect()} for n in (8000, 20000))
    assert small < large


def test_empty_and_zero_tokens(spark):
    d = spark.createDataFrame([(1, "a", 0), (2, "a", 0)], "id long, source string, tokens long")
    w = weights(spark, [("a", 1.0, None)])
    mix, report = mix_sources(d, w)
    assert mix.count() in (0, 2) and report.first()["mixed"] == 0
    assert mix_sources(d.limit(0), w)[0].count() == 0 and mix_sources(d, w.limit(0))[0].count() == 0


def test_tokens_and_spellings(spark):
    d = spark.createDataFrame([(1, "Fire at dawn."), (2, ""), (3, None), (4, "烟雾"), (5, "a " * 50000)], "id long, text string")
    n = {x["id"]: x["tokens"] for x in token_counts(d.selectExpr("*", "'clash' as tokens", "1 as h")).collect()}
    assert n[1] == 4 and n[2] == n[3] == 0 and n[4] >= 2 and n[5] >= 50000
    s = spark.createDataFrame([(" Dispatch-Log ",), ("DISPATCH_LOG",), ("dispatch log",)], "source string")
    assert {x[0] for x in s.select(proper_source()).collect()} == {"dispatch_log"}
