"""Properties of the core queries that SQL cannot state, against brute force; and of the report operators and granules."""

import math
import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberframe.operators import models as M
from emberframe.operators import reports as R
from emberframe.plans import registry
from emberframe.sources import store

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = registry()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def run(spark, name):
    return CORE.queries[name](spark, DATA).toPandas()


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pandas()


def hull(points):
    """Area of the convex hull by gift wrapping."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return 0.0
    at, out = pts[0], []
    while True:
        out.append(at)
        nxt = pts[0] if pts[0] != at else pts[1]
        for q in pts:
            cross = (nxt[0] - at[0]) * (q[1] - at[1]) - (nxt[1] - at[1]) * (q[0] - at[0])
            if cross < 0 or (cross == 0 and math.dist(at, q) > math.dist(at, nxt)):
                nxt = q
        at = nxt
        if at == out[0]:
            break
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1]))) / 2


@needs_data
def test_r9_solidity(spark):
    e = read("events")
    cells = {}
    for p, v, i in zip(e["user_id"], e["value"], e["event_id"]):
        cells.setdefault(p, set()).add((int(v // 16), int(i * 7 % 32)))
    got = run(spark, "r9_solidity").set_index("p")
    assert set(got.index) == set(cells)
    for p, c in cells.items():
        area = hull(list(c))
        assert got.loc[p, "num_pixels"] == len(c) and abs(got.loc[p, "hull_area"] - area) < 1e-9
        assert abs(got.loc[p, "solidity"] - (len(c) / area if area else 1.0)) < 1e-9


@needs_data
def test_s7_granules(spark):
    got = run(spark, "s7_granules").set_index("name")
    want = [f for f in os.listdir(DATA) if f.startswith("region") and f.endswith(".parquet")]
    assert sorted(got.index) == sorted(want)
    for f in want:
        content = open(f"{DATA}/{f}", "rb").read()
        assert got.loc[f, "n_bytes"] == len(content) and got.loc[f, "footer"] == int.from_bytes(content[-8:-4], "little")


@needs_data
def test_a34_components(spark):
    x = np.array(read("embeddings").sort_values("vec_id")["embedding"].tolist(), dtype=float)
    got = run(spark, "a34_components").sort_values("vec_id")[[f"c{i}" for i in range(5)]].to_numpy()
    w, v = np.linalg.eigh(np.cov(x.T, bias=True))
    cov = np.cov(got.T, bias=True)
    assert np.allclose(np.diag(cov), w[::-1][:5], atol=1e-5) and np.allclose(cov, np.diag(np.diag(cov)), atol=1e-5)
    assert np.allclose(np.abs(got), np.abs(x @ v[:, ::-1][:, :5]), atol=1e-4)


@needs_data
def test_m7_clusters(spark):
    e = read("embeddings")
    got = run(spark, "m7_clusters")
    assert got["n"].sum() == len(e) and got["cluster"].between(0, 9).all()
    assert got.groupby("label")["n"].sum().to_dict() == e["label"].value_counts().to_dict()
    labelled = M.clusters(spark.read.parquet(f"{DATA}/embeddings.parquet"), "embedding", 10).toPandas()
    x = np.array(labelled["embedding"].tolist(), dtype=float)
    centres = np.array([x[labelled["cluster"] == k].mean(axis=0) for k in sorted(labelled["cluster"].unique())])
    nearest = np.argmin(((x[:, None] - centres) ** 2).sum(axis=2), axis=1)
    assert (nearest == labelled["cluster"].to_numpy()).mean() > 0.97


@needs_data
def test_m6_probes(spark):
    got = run(spark, "m6_probes").set_index("probe")["score"]
    e = read("embeddings")
    assert e["label"].value_counts(normalize=True).max() <= got["accuracy"] <= 1 and 0 < got["r2"] <= 1
    # A number that is a coordinate is told by a linear probe, noise isn't.
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").select("embedding", F.col("embedding")[3].cast("double").alias("y"), F.lit(1.0).alias("one"))
    exact = M.probes(df.withColumn("label", (F.col("y") > 0).cast("double")), "embedding", "y", "label")
    assert exact["r2"] > 0.8 and exact["accuracy"] > 0.9


@needs_data
def test_m6_projection(spark):
    e = read("embeddings").sort_values("vec_id")
    got = run(spark, "m6_projection").sort_values("vec_id")
    x = np.array(e["embedding"].tolist(), dtype=float)
    names = [c for c in got.columns if c != "vec_id"]
    assert names == ["height", "odd", "rest0", "rest1", "rest2", "rest3"] and len(got) == len(e)
    assert np.corrcoef(got["height"], x[:, 0] + x[:, 1])[0, 1] > 0.95
    assert abs(np.corrcoef(got["odd"], e["label"] % 2)[0, 1]) > 0.1
    # The rest holds no more of the number, and its components are uncorrelated and fall in variance.
    rest = np.cov(got[names[2:]].to_numpy().T)
    assert np.allclose(rest, np.diag(np.diag(rest)), atol=1e-4) and (np.diff(np.diag(rest)) <= 1e-6).all()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert abs(got[names].to_numpy()).max() <= np.linalg.norm(z, axis=1).max() + 1e-6


@needs_data
def test_m7_region_clusters(spark):
    got = run(spark, "m7_region_clusters")
    e = read("embeddings")
    assert got["vec_id"].is_unique and len(got) == len(e) and got["cluster"].between(0, 7).all() and got["cluster"].nunique() > 3
    rows = [(i, [float(i % 2) * 10 + i / 1000, 0.0], i % 3) for i in range(60)] + [(99, None, 1)]
    df = spark.createDataFrame(rows, "id int, coords array<double>, region int").withColumn("cluster", F.lit("clash"))
    by = {r["id"]: r["cluster"] for r in M.region_clusters(df, "coords", "region", "id", 2, per_region=5).collect()}
    assert by[99] is None and len({by[i] for i in range(0, 60, 2)}) == len({by[i] for i in range(1, 60, 2)}) == 1 and by[0] != by[1]


def test_rasterized_polygons(spark):
    from emberframe.operators.rings import rasterized

    square = [[{"x": 10.0, "y": 10.0}, {"x": 12.0, "y": 10.0}, {"x": 12.0, "y": 12.0}, {"x": 10.0, "y": 12.0}, {"x": 10.0, "y": 10.0}]]
    rows = [(1, square), (2, [square[0], [{"x": 11.0, "y": 11.0}, {"x": 12.0, "y": 11.0}, {"x": 12.0, "y": 12.0}, {"x": 11.0, "y": 12.0}]]), (3, None), (4, [[]])]
    df = spark.createDataFrame(rows, "id int, rings array<array<struct<x: double, y: double>>>")
    got = {(r["grid_row"], r["grid_col"]): r["id"] for r in rasterized(df, 1.0).collect()}
    # The hole of 2 is the north-east quarter, where 1 shows through.
    assert got == {(78, 190): 2, (78, 191): 1, (79, 190): 2, (79, 191): 2}
    assert rasterized(df.limit(0), 1.0).count() == 0


@needs_data
def test_w16_spread_picks(spark):
    f = read("fires").dropna(subset=["fire_id", "num_fire"])
    east = np.where(f["max_x"] < f["min_x"], f["max_x"] + 360, f["max_x"])
    f = f.assign(x=(f["min_x"] + east) / 2, y=(f["min_y"] + f["max_y"]) / 2)
    f = f.groupby("fire_id").agg(num_fire=("num_fire", "max"), x=("x", "mean"), y=("y", "mean")).reset_index()
    f["x"] = np.where(f["x"] >= 180, f["x"] - 360, f["x"])
    ranked = f.sort_values(["num_fire", "fire_id"], ascending=[False, True]).itertuples(index=False)
    ranked, chosen = list(ranked), []
    for r in ranked:
        gap = lambda c: math.hypot(min(abs(c.x - r.x), 360 - abs(c.x - r.x)), c.y - r.y)  # noqa: B023, E731
        if len(chosen) < 6 and all(gap(c) >= 30 for c in chosen):
            chosen.append(r)
    chosen += [r for r in ranked if r not in chosen][: 6 - len(chosen)]
    assert run(spark, "w16_spread_picks")["fire_id"].tolist() == [c.fire_id for c in chosen]


def test_report_operators(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("b", 1, 0.6), ("b", 2, 0.6), (None, 1, None)], "label string, region int, f1 double")
    best = {(r["label"], r["region"]): r["best"] for r in R.with_group_best(df, ["region"], "f1", "best").collect()}
    assert best == {("a", 1): False, ("a", 2): True, ("b", 1): True, ("b", 2): False, (None, 1): None}
    m = {r["label"]: (r["r1"], r["r2"]) for r in R.matrix(df, ["label"], "region", {"r1": 1, "r2": 2}, F.col("f1")).collect()}
    assert m == {"a": (0.5, 0.7), "b": (0.6, 0.6), None: (None, None)}
    d = {(r["label"], r["region"]): r["delta"] for r in R.deltas(df, "f1", F.expr("label = 'a' and region = 1")).collect()}
    assert d[("a", 2)] == 0.2 and d[("b", 1)] == 0.1 and d[(None, 1)] is None
    assert all(r["delta"] is None for r in R.deltas(df, "f1", F.lit(False)).collect())
    first = {r["label"]: r["region"] for r in R.best_rows(df, ["label"], [-F.col("f1"), F.col("region")], ["region", "f1"]).collect()}
    assert first == {"a": 2, "b": 1, None: 1}
    loo = {r["label"]: r for r in R.leave_one_out(df, "label", "region", "f1", F.expr("label = 'a' and region = 1")).collect()}
    assert loo["a"]["n_regions"] == 1 and abs(loo["a"]["delta"] - 0.05) < 1e-9 and loo["b"]["n_regions"] == 2
    run_ = [(r["best"], r["is_new_best"]) for r in R.running_best(df.filter("label = 'b'"), ["label"], "region", "f1").orderBy("region").collect()]
    assert run_ == [(0.6, True), (0.6, False)]
    for f in (lambda x: R.class_counts(x, ["label"], {"hi": F.col("f1") > 0.55}), lambda x: R.edge_histogram(x, ["label"], "f1", [0, 1]), lambda x: R.width_histogram(x, "f1", 4)):
        assert f(df.limit(0)).count() == 0


def test_histograms(spark):
    v = [-1.0, 0.0, 1.0, 2.9, 3.0, 9.9, 10.0, 11.0, None, float("nan")]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = {r["bin"]: r["n"] for r in R.edge_histogram(df, [], "v", [1, 3, 10]).collect()}
    assert got == {-1: 2, 0: 2, 1: 3, 2: 1}
    same = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert [tuple(r) for r in R.width_histogram(same, "v", 5).collect()] == [(0, 3)]


def test_contingency_scores(spark):
    perfect = spark.createDataFrame([(i % 3, f"c{i % 3}") for i in range(30)], "a int, b string")
    r = R.contingency_scores(perfect, "a", "b").first()
    assert (r["nmi"], r["ari"], r["purity"]) == (1.0, 1.0, 1.0)
    free = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(40)], "a int, b int")
    r = R.contingency_scores(free, "a", "b").first()
    assert abs(r["nmi"]) < 1e-6 and r["ari"] < 0.01 and r["purity"] == 0.5


def test_granules_and_rejects(spark):
    good = store.pack_granule([1, 2], [10.0, -179.5], [1.0, 2.0], [1100, 65535], 50.0, 1000.0, 40000)
    bad = [("short", good[:9]), ("cut", good[:-1]), ("magic", b"XXXX" + good[4:]), ("none", None), ("flat", store.pack_granule([1], [0], [0], [0], 0.0, 0.0, 9))]
    empty = store.pack_granule([], [], [], [], 1.0, 0.0, 9)
    df = spark.createDataFrame([("good", good), ("empty", empty), *bad], "path string, content binary").withColumn("reason", F.lit("clash"))
    rows, rejects = store.parsed_granules(df, store.read_granule, store.GRANULE_SCHEMA)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 10.0, 1.0, 2.0), (2, -179.5, 2.0, None)]
    got = {r["path"]: r["reason"] for r in rejects.collect()}
    assert set(got) == {p for p, _ in bad} and all(x.startswith("ValueError") for x in got.values())
    rows, rejects = store.parsed_granules(df.limit(0), store.read_granule, store.GRANULE_SCHEMA)
    assert rows.count() == rejects.count() == 0


def test_fire_types(spark):
    from emberframe.functions.scalars import fire_type

    cases = [
        ("Urban", 0.0, [], False, 1), ("OCEAN", 0.0, None, None, 1), ("bare", 0.0, ["x"], True, 1), ("Shrub", 0.0, ["SHRUB"], True, 1), ("Shrub", 0.0, [], True, 0),
        ("Cropland", 0.0, [], True, 0), ("cropland", 0.0, [], None, 2), ("Grass", 10.5, [], False, 1), ("Grass", float("nan"), [], False, 0), (None, None, None, None, 0),
    ]
    df = spark.createDataFrame(cases, "lc string, t double, ex array<string>, crop boolean, want int")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", fire_type(F.col("lc"), F.col("t"), F.col("ex"), F.col("crop"))).collect())


def test_every_query_without_sql_has_a_property():
    tested = {k.removeprefix("test_") for k in globals() if k.startswith("test_")}
    assert set(CORE.queries) - set(CORE.sql) <= tested
    assert isinstance(read("region") if os.path.isdir(DATA) else pd.DataFrame(), pd.DataFrame)
