import numpy as np

from emberframe.llm.cube import cube_sample, flight


def units(spark, sizes):
    rows = [(f"{c}-{i}", c, float(i)) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "unit string, category string, size double")


def test_flight_keeps_sums_and_expectations():
    pi = np.full(101, 10 / 101)
    hits = np.zeros(101)
    for seed in range(400):
        out = flight(pi, None, np.random.default_rng(seed))
        assert abs(out.sum() - 10) < 1e-6 and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        hits += out
    assert abs(hits / 400 - 10 / 101).max() < 0.08


def test_flight_with_balance_keeps_totals():
    rng = np.random.default_rng(1)
    x, pi = rng.random((200, 1)), np.full(200, 0.2)
    out = flight(pi, x / pi[:, None], rng)
    assert abs(out.sum() - 40) < 1e-6 and abs((out * x[:, 0] / 0.2).sum() - x.sum()) < 1e-6
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2


def test_flight_of_three_equals_the_kernel(monkeypatch):
    rng = np.random.default_rng(2)
    pi, x = np.full(90, 0.3), rng.integers(0, 4, 90).astype(float)
    hits = np.zeros(90)
    for seed in range(400):
        out = flight(pi, x[:, None] / 0.3, np.random.default_rng(seed))
        assert abs(out.sum() - 27) < 1e-6 and abs((out * x).sum() - (pi * x).sum()) < 1e-6
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
        hits += out
    assert abs(hits / 400 - 0.3).max() < 0.1


def test_targets_are_met_and_gaps_reported(spark):
    u = units(spark, {"a": 500, "b": 300, "c": 4, "d": 50})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1), ("e", 0.0, 3)], "category string, share double, min_rows int")
    for per_task in (50, 10_000):
        sample, report = cube_sample(u, t, 100, per_task=per_task)
        r = {x["category"]: x for x in report.collect()}
        assert {k: x["drawn"] for k, x in r.items()} == {"a": 50, "b": 30, "c": 4, "e": 0}
        assert r["c"]["left"] == 0 and r["a"]["left"] == 450 and r["e"]["left"] == 0
        assert r["c"]["shortfall"] == 16 and r["e"]["shortfall"] == 3 and r["a"]["shortfall"] == 0
        assert sample.count() == sample.select("unit").distinct().count() == 84


def test_minimum_of_small_categories_and_balance(spark):
    u = units(spark, {"a": 400, "b": 40})
    t = spark.createDataFrame([("a", 1.0, 1), ("b", 0.0, 5)], "category string, share double, min_rows int")
    sample, _ = cube_sample(u, t, 40, balance=["size"], per_task=100)
    got = sample.groupBy("category").count().collect()
    assert {x["category"]: x["count"] for x in got} == {"a": 40, "b": 5}
    mean = sample.filter("category = 'a'").join(u.select("unit", "size"), "unit").agg({"size": "avg"}).first()[0]
    assert abs(mean - 199.5) < 12


def test_empty_and_null(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], "category string, share double, min_rows int")
    sample, report = cube_sample(units(spark, {"a": 0}), t, 10)
    assert sample.count() == 0 and report.first()["shortfall"] == 10
    u = spark.createDataFrame([(None, "a", 1.0), ("x", None, 1.0), ("y", "a", None)], "unit string, category string, size double")
    sample, _ = cube_sample(u, t, 1)
    assert [x["unit"] for x in sample.collect()] == ["y"]
    sample, _ = cube_sample(u, t.limit(0), 1)
    assert sample.count() == 0


def test_fill_reaches_the_size(spark):
    u = units(spark, {"a": 500, "b": 40, "c": 4, "d": 50, "z": 30})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1), ("e", 0.0, 3), ("z", 0.0, 5)], "category string, share double, min_rows int")

    def drawn(size):
        sample, report = cube_sample(u, t, size, per_task=50, fill=True)
        r = {x["category"]: x for x in report.collect()}
        assert sample.count() == sample.select("unit").distinct().count() == sum(x["drawn"] for x in r.values())
        return {k: x["drawn"] for k, x in r.items()}, r

    got, r = drawn(100)
    # c and e leave 19 rows after the minimum of z; a and b share them 5 : 3 until b is exhausted.
    assert got == {"a": 100 - 5 - 4 - 34, "b": 34, "c": 4, "e": 0, "z": 5}
    assert r["c"]["wanted"] == 20 and r["c"]["shortfall"] == 16 and r["e"]["shortfall"] == 3 and r["b"]["shortfall"] == 0
    assert drawn(560)[0] == {"a": 500, "b": 40, "c": 4, "e": 0, "z": 16}
    assert sum(drawn(9_000)[0].values()) == 574


def test_fill_takes_the_excess_of_minima_off(spark):
    u = units(spark, {"a": 400, "b": 40, "c": 100})
    t = spark.createDataFrame([("a", 0.75, 1), ("b", 0.0, 5), ("c", 0.25, 1)], "category string, share double, min_rows int")
    sample, report = cube_sample(u, t, 45, fill=True)
    assert {x["category"]: x["drawn"] for x in report.collect()} == {"a": 30, "b": 5, "c": 10}
    assert cube_sample(u, t, 2, fill=True)[0].count() == 7
