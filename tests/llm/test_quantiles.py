import math
import random

import pytest

from emberframe.llm import quantiles
from emberframe.llm.quantiles import compact_states, multi_select, value_states


def expected(values, f):
    v = sorted(values)
    return v[max(1, math.ceil(f * len(v) - 1e-9)) - 1]


@pytest.mark.parametrize("enough", [1, 8, 4096])
def test_exact_from_parts(spark, enough):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", "b", None]), float(int(r.paretovariate(0.6))), r.randrange(6)) for _ in range(3000)] + [("one", 7.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, m int")
    states = value_states(df.filter("m < 3"), "g", "v", "m").union(value_states(df.filter("m >= 3"), "g", "v", "m"))
    fractions = [0.25, 0.5, 0.99, 0.999, 1.0]
    got = {(x["grp"], x["fraction"]): x["value"] for x in multi_select(states, fractions, enough).collect()}
    groups = {g: [v for h, v, _ in rows if h == g] for g in {g for g, _, _ in rows}}
    assert got == {(g, f): expected(v, f) for g, v in groups.items() for f in fractions}


def test_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 3.0, 1)] * 50 + [("a", None, 1), ("a", float("nan"), 2), ("c", None, 1)], "g string, v double, m int")
    got = multi_select(value_states(df, "g", "v", "m"), [0.5], 1).collect()
    assert [(x["grp"], x["value"], x["n_rows"]) for x in got] == [("a", 3.0, 50)]
    assert multi_select(value_states(df.limit(0), "g", "v", "m"), [0.5]).count() == 0
    with pytest.raises(ValueError):
        multi_select(value_states(df, "g", "v", "m"), [0.0])


def test_rounds_read_less_and_less(spark, monkeypatch):
    sizes = []

    def watched(df, *a):
        out = kept(df, *a)
        if {"g", "iv", "value", "n"} <= set(out.columns) and "k" not in out.columns:
            sizes.append(out.count())
        return out

    kept = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", watched)
    df = spark.range(40_000).selectExpr("id % 3 as g", "cast(hash(id) as double) as v", "id % 4 as m")
    got = multi_select(value_states(df, "g", "v", "m"), [0.25, 0.5, 0.999], 8).collect()
    assert len(got) == 9 and len(sizes) <= 6
    assert all(b <= a / 2.5 for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("points", [10, 50])
def test_compact_states_keep_their_rank_error(spark, points):
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), r.lognormvariate(0, 3), r.choice([1, 1, 1, 2, 3, None])) for _ in range(6000)] + [("b", 1.0, 7)] * 3
    df = spark.createDataFrame(rows, "g string, v double, m int")
    small = compact_states(value_states(df, "g", "v", "m"), points)
    per = small.groupBy("part", "grp").count().collect()
    assert max(x["count"] for x in per) <= points and abs(small.agg({"n": "sum"}).first()[0] - len(rows)) < 1e-6
    for x in multi_select(small, [0.1, 0.5, 0.9, 0.99]).collect():
        values = sorted(v for h, v, _ in rows if h == x["grp"])
        low, high = (sum(f(v, x["value"]) for v in values) / len(values) for f in (float.__lt__, float.__le__))
        assert x["rank_error"] == 0.5 / points
        slack = x["rank_error"] + 6 / len(values)
        assert low - slack <= x["fraction"] <= high + slack
    assert compact_states(value_states(df.limit(0), "g", "v", "m"), points).count() == 0
