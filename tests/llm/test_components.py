import random

import pytest
from pyspark.sql import functions as F

from emberframe.llm.components import assign_splits, hash_to_min, torn, with_component


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_hash_to_min_equals_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(12)]
    got = {x["node"]: x["component"] for x in hash_to_min(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == brute(edges)


def test_hash_to_min_hub_nulls_and_empty(spark):
    hub = [("a", f"z{i}") for i in range(500)] + [(None, "a"), ("q", None), ("a", "z1")]
    got = hash_to_min(spark.createDataFrame(hub, "u string, v string"))
    assert got.count() == 501 and {x["component"] for x in got.collect()} == {"a"}
    assert hash_to_min(spark.createDataFrame([], "u string, v string")).count() == 0


def test_linked_records_share_a_component(spark):
    rows = [(1, 5, 5), (2, None, 5), (3, 5, None), (4, 6, 7), (5, 7, None), (6, None, None), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, a int, b int").withColumns({"component": F.lit("clash"), "node": F.lit(1), "u": F.lit("clash")})
    got = with_component(df, {"fire.a": F.col("a"), "fire.b": F.col("b")}, F.col("id"))
    by = {}
    for x in got.collect():
        by.setdefault(x["id"], set()).add(x["component"])
    assert got.count() == 7 and by[1] == by[2] == by[3] and by[4] == by[5] != by[1] and by[6] == {"alone:6"}


def test_splits_keep_shares_and_components(spark):
    r = random.Random(3)
    sizes = [4000, 2500, 1500] + [r.randrange(1, 12) for _ in range(2500)]
    comps = spark.createDataFrame([(f"c{i}", str(i % 3) if i % 7 else None, n) for i, n in enumerate(sizes)], "component string, stratum string, n long")
    shares = {"train": 0.6, "val": 0.15, "test": 0.25}
    got = assign_splits(comps, shares)
    rows = got.collect()
    assert len(rows) == len(sizes) == len({x["component"] for x in rows})
    total = sum(sizes)
    for s, w in shares.items():
        assert abs(sum(x["n"] for x in rows if x["split"] == s) / total - w) < 0.03
    assert {x["component"]: x["split"] for x in assign_splits(comps.repartition(7), shares).collect()} == {x["component"]: x["split"] for x in rows}


def test_splits_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "component string, stratum string, n long")
    assert assign_splits(empty, {"train": 1.0}).count() == 0
    one = spark.createDataFrame([("c", None, 10)], "component string, stratum string, n long")
    assert assign_splits(one, {"train": 0.6, "test": 0.4}).first()["split"] in ("train", "test")
    with pytest.raises(ValueError):
        assign_splits(one, {})


def test_splits_follow_periods(spark):
    """A heavy component of one year is made up for by the others of that year."""
    rows = [("big", "1", 200, "2020")] + [(f"c{y}-{i}", "1", 1, str(y)) for y in range(2018, 2026) for i in range(300 if y == 2020 else 500)]
    d = spark.createDataFrame(rows, "component string, stratum string, n long, period string")
    got = assign_splits(d.drop("period"), {"train": 0.6, "val": 0.15, "test": 0.25}, periods=d.select("component", "period", "n"))
    by = got.join(d.select("component", "period"), "component").groupBy("period", "split").agg({"n": "sum"}).collect()
    share = {(r["period"], r["split"]): r[2] / 500 for r in by}
    assert got.count() == len(rows) and got.filter("split is null").count() == 0
    assert all(abs(share.get((str(y), s), 0) - w) < 0.06 for y in range(2018, 2026) for s, w in (("train", 0.6), ("val", 0.15), ("test", 0.25)))


def links():
    return {"fire.recorded": F.col("a"), "fire.tile": F.col("b")}


def test_torn_components_join_what_records_link(spark, monkeypatch):
    rows = [
        (1, 1, "train"), (1, None, "train"), (2, 2, "train"), (None, 2, "val"),
        # 3 and 4 are joined by a record without a split, 5 to 7 by a chain.
        (3, 4, None), (3, 3, "train"), (4, 4, "test"), (5, 6, "val"), (6, 7, "val"), (7, 7, "train"), (None, None, "val"), (8, None, None),
    ]
    df = spark.createDataFrame(rows, "a int, b int, s string").withColumn("node", F.lit("clash"))
    got = {(x["node"], x["mark"]) for x in torn(df, links(), F.col("s")).collect()}
    assert got == {
        ("fire:2", "train"), ("fire:2", "val"), ("fire:3", "train"), ("fire:4", "test"), ("fire:5", "val"), ("fire:6", "val"), ("fire:7", "train"),
    }
    assert torn(df.limit(0), links(), F.col("s")).count() == 0
    # The rows come from the components: without them nothing is torn.
    from emberframe.llm import components

    monkeypatch.setattr(components, "hash_to_min", lambda e: e.selectExpr("v as node", "v as component").union(e.selectExpr("u", "u")).distinct())
    assert torn(df, links(), F.col("s")).count() == 0


def test_found_and_splits_on_bridged_fires(spark, tmp_path):
    from emberframe.llm.queries import LLM

    schema = "load_order long, sample_id long, fire_id int, tile_key string, region_id int, dt date, split string, loaded_at timestamp"
    rows = [
        (1, 1, 5, "5_0_0", 1, "train"), (2, 2, 5, "6_0_0", 1, "train"), (3, 3, 6, "6_1_0", 2, "val"), (4, 4, None, "6_1_0", 2, "val"),
        (5, 5, 9, "9_0_0", 1, "TEST"), (6, 6, None, "9/1/0", 1, "Train"), (7, 7, None, None, None, "val"), (8, 8, 10, None, 3, None),
    ]
    df = spark.createDataFrame([(*r[:5], None, r[5], None) for r in rows], schema)
    df.write.parquet(f"{tmp_path}/samples.parquet")
    assert [tuple(x) for x in LLM.queries["p1_found"](spark, str(tmp_path)).collect()] == [(9,)]
    got = {x["sample_id"]: x for x in LLM.queries["p1_splits"](spark, str(tmp_path)).collect()}
    assert len(got) == 8 and got[1]["component"] == got[2]["component"] == got[3]["component"] == got[4]["component"]
    assert len({got[i]["split"] for i in (1, 2, 3, 4)}) == 1 and got[5]["split"] == got[6]["split"]


def test_many_strata_are_balanced_together(spark, monkeypatch):
    from emberframe.llm import components

    monkeypatch.setattr(components, "MAX_STRATA", 3)
    comps = spark.createDataFrame([(f"c{i}", str(i % 40) if i % 41 else None, 1 + i % 5) for i in range(4000)], "component string, stratum string, n long")
    shares = {"train": 0.6, "val": 0.15, "test": 0.25}
    rows = assign_splits(comps, shares).collect()
    assert {(x["component"], x["stratum"]) for x in rows} == {(x["component"], x["stratum"]) for x in comps.collect()} and len(rows) == 4000
    total = sum(x["n"] for x in rows)
    for s, w in shares.items():
        assert abs(sum(x["n"] for x in rows if x["split"] == s) / total - w) < 0.03
