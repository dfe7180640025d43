"""Operators of the core on small fixtures, against brute force."""

import datetime as d
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import coverage, history, ordering, raster, sampling, scoring
from emberframe.operators.curve import containing_region, near_pairs
from emberframe.operators.graph import connected_components, event_cells, label_cells
from emberframe.operators.skew import combine_by_key, fire_totals, heavy_keys
from emberframe.plans.history import spread_pick
from emberframe.plans.scalars import filter_regions
from emberframe.sources import store
from emberframe.tables import counting, fire_by_right, latitude, longitude, split_meaning

ROW = "sample_id long, load_order long, loaded_at timestamp, fire_id int, tile_key string, split string, lon double, lat double, extra string"


def ts(day, hour=0):
    return d.datetime(2020, 1, day, hour)


def test_counting_keeps_the_latest_row_once(spark):
    rows = [(1, 1, ts(1), 1, "a", None, 0.0, 0.0, "x"), (1, 2, ts(3), 2, "a", None, 0.0, 0.0, "x"), (1, 3, ts(2), 3, "a", None, 0.0, 0.0, "x"),
            (2, 4, ts(1), 4, "a", None, 0.0, 0.0, "x"), (2, 5, ts(1), 5, "a", None, 0.0, 0.0, "x"), (3, 6, None, 6, "a", None, 0.0, 0.0, "x"),
            (None, 7, ts(1), 7, "a", None, 0.0, 0.0, "x"), (None, 8, ts(1), 8, "a", None, 0.0, 0.0, "x")]
    df = spark.createDataFrame(rows, ROW)
    assert sorted(r["fire_id"] for r in counting(df).collect()) == [2, 5, 6, 7, 8]
    assert counting(df.limit(0)).count() == 0


def test_cleaning_rules(spark):
    rows = [(1, 1, None, None, "fire007_x1_y2", " Training", 359.5, 91.0, ""), (2, 2, None, 9, "1_2_3", "VALID", -180.0, 45.0, ""),
            (3, 3, None, None, None, None, None, None, ""), (4, 4, None, None, "99999999999_1", "other", float("nan"), float("nan"), ""), (5, 5, None, 3, "x", "test", 180.0, -90.0, "")]
    got = spark.createDataFrame(rows, ROW).select("sample_id", fire_by_right().alias("f"), split_meaning().alias("s"), longitude().alias("x"), latitude().alias("y"))
    r = {x["sample_id"]: tuple(x)[1:] for x in got.collect()}
    assert r == {1: (7, "train", -0.5, None), 2: (9, "val", -180.0, 45.0), 3: (None,) * 4, 4: (None,) * 4, 5: (3, "test", -180.0, -90.0)}


def test_totals_of_hot_and_null_keys(spark):
    s = spark.createDataFrame([(1, d.date(2020, 1, 1))] * 500 + [(2, d.date(2020, 1, 2)), (None, None), (3, None)], "fire_id int, dt date").withColumn("num_fire", F.lit("clash"))
    f = spark.createDataFrame([(1, 250), (1, 250), (2, 0), (None, 5), (4, 1)], "fire_id int, num_fire int")
    got = {r["fire_id"]: r for r in fire_totals(s, f).collect()}
    assert set(got) == {1, 2, 3, None} and got[1]["samples_per_detection"] == 2.0 and got[2]["samples_per_detection"] is None and got[3]["first_dt"] is None
    assert [r["fire_id"] for r in heavy_keys(fire_totals(s, f), 0.5).collect()] == [1]
    assert fire_totals(s.limit(0), f).count() == 0 and heavy_keys(fire_totals(s.limit(0), f), 0.01).count() == 0
    with pytest.raises(ValueError):
        combine_by_key(s, ["fire_id"], {"n": ("count_distinct", "dt")})


def km(a, b):
    la, lo, lb, l2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((l2 - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("radius", [0.05, 2.0, 80.0])
def test_near_pairs_equal_brute_force(spark, radius):
    r = random.Random(int(radius * 10))
    size = radius / 111.0
    centres = [(0.0, 0.0), (51.0, 179.99999), (-51.0, -180.0), (89.999, 30.0), (-90.0, 0.0), (69.0, 13.3)]
    rows = []
    for i in range(360):
        la, lo = r.choice(centres)
        la = max(-90.0, min(90.0, la + r.uniform(-2, 2) * size))
        lo = (lo + r.uniform(-2, 2) * size / max(0.02, math.cos(math.radians(la))) + 180) % 360 - 180
        rows.append((i, r.randrange(3), r.randrange(5), la if i % 40 else None, lo))
    df = spark.createDataFrame(rows, "id int, day int, fire int, lat double, lon double")
    got = {(x["a"], x["b"]) for x in near_pairs(df, radius, ["day"], "id", "fire").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and a[3] is not None and b[3] is not None and km(a[3:], b[3:]) <= radius}
    assert got == want and len(want) > 30
    assert near_pairs(df.limit(0), radius, ["day"], "id", "fire").count() == 0


def test_containing_region(spark):
    cells = [(r, c, 1 + (r // 5 + c // 7) % 3) for r in range(0, 60) for c in range(700, 720)] + [(10, 3, 9), (10, 3, 8), (11, 4, None), (359, 0, 5)]
    look = {(r, c): v for r, c, v in cells if v is not None}
    look[(10, 3)] = 8
    rnd = random.Random(2)
    pts = [(rnd.uniform(55, 90), rnd.uniform(165, 180)) for _ in range(200)] + [(84.9, -178.3), (84.4, -177.9), (-90.0, -180.0), (None, 1.0), (90.0, 179.9)]
    df = spark.createDataFrame(pts, "lat double, lon double").withColumns({"region_id": F.lit(1), "region": F.lit("clash"), "lo": F.lit(0)})
    got = containing_region(df, spark.createDataFrame(cells, "grid_row int, grid_col int, region int"))
    rows = got.collect()
    assert len(rows) == len(pts)
    for x in rows:
        want = None if x["lat"] is None else look.get((min(359, math.floor((90 - x["lat"]) * 2)), math.floor((x["lon"] + 180) * 2)))
        assert x["region"] == want


def test_components_equal_union_find(spark):
    r = random.Random(9)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300), (None, 4)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cells_and_ignitions(spark):
    r = random.Random(4)
    cells = [(r.randrange(30) - 10, r.randrange(30), r.randrange(40)) for _ in range(250)]
    df = spark.createDataFrame([*cells, cells[0], (None, 1, 1)], "x int, y int, t int")
    near = lambda a, b, dt: abs(a[0] - b[0]) <= 2 and abs(a[1] - b[1]) <= 2 and abs(a[2] - b[2]) <= dt

    def parts(dt):
        left, out = set(cells), []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                a = todo.pop()
                part.add(a)
                more = {b for b in left if near(a, b, dt)}
                left -= more
                todo += more
            out.append(frozenset(part))
        return out

    got = {}
    for x in label_cells(df).collect():
        got.setdefault(x["component"], set()).add((x["x"], x["y"], x["t"]))
    assert {frozenset(v) for v in got.values()} == set(parts(7))
    fresh = {p: not any(near(a, b, 7) and b[2] < a[2] for a in p for b in cells) for p in parts(0)}
    of = {a: v for p, v in fresh.items() for a in p}
    assert all(x["ignition"] == of[(x["x"], x["y"], x["t"])] for x in event_cells(df).collect())


def test_orders(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "k int, g int").repartition(5)
    assert [x["position"] for x in ordering.positions(df, ["k"]).orderBy("k").collect()] == list(range(101))
    g = ordering.group_positions(df, "g", ["k"]).collect()
    assert all(sorted(x["position"] for x in g if x["g"] == v) == list(range(sum(y["g"] == v for y in g))) for v in range(3))
    assert ordering.even_positions(df, ["k"], 5).count() == 5 and ordering.even_positions(df, ["k"], 500).count() == 101
    assert [x["count"] for x in ordering.chunked(df, ["k"], 4).groupBy("chunk").count().orderBy("chunk").collect()] == [26, 25, 25, 25]
    assert sum(ordering.strided(df, ["k"], j, 4).count() for j in range(4)) == sum(ordering.sliced(df, ["k"], j, 4).count() for j in range(4)) == 101
    assert ordering.positions(df.limit(0), ["k"]).count() == 0
    t = ordering.ranked_values(spark.createDataFrame([(5,), (5,), (9,), (1,)], "v int"), "v").collect()
    assert sorted((x["v"], x["rank"]) for x in t) == [(1, 4), (5, 2), (5, 2), (9, 1)]


def test_temporal_split_equals_sorted_cut(spark):
    r = random.Random(1)
    rows = [(i, r.choice([1, 1, 1, 2, None]), d.date(2020, 1, 1 + r.randrange(6))) for i in range(400)]
    got = {x["o"]: x["part"] for x in sampling.temporal_split(spark.createDataFrame(rows, "o int, g int, day date"), "g", ["day", "o"]).collect()}
    want = {}
    for g in (1, 2, None):
        own = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0]))
        a, b = int(len(own) * 0.6), int(len(own) * (0.6 + 0.15))
        want |= {x[0]: "train" if i < a else "val" if i < b else "test" for i, x in enumerate(own)}
    assert got == want


def test_scores(spark):
    r = random.Random(2)
    px = [(i % 7, round(r.random(), 2), int(r.random() < 0.3), int(r.random() < 0.8)) for i in range(900)] + [(9, 0.1, 0, 1), (8, 0.9, 1, None)]
    df = spark.createDataFrame(px, "s int, pred double, target int, mask int")
    v = [(p, t) for _, p, t, m in px if m == 1]
    wins = sum((a > b) + 0.5 * (a == b) for a, y in v if y for b, z in v if not z)
    pos = sum(y for _, y in v)
    assert abs(scoring.roc_auc(df).first()["auc"] - wins / (pos * (len(v) - pos))) < 1e-9
    micro = scoring.micro(scoring.confusion(df, ["s"]), []).first()
    with_content = {s for s, p, t, m in px if m == 1 and (p > 0.5 or t)}
    tp = sum(p > 0.5 and t for s, p, t, m in px if m == 1)
    assert micro["tp"] == tp and micro["n_samples"] == len(with_content) < 9
    best = scoring.best_threshold(scoring.sweep(df.withColumn("one", F.lit(1)), ["one"]), ["one"]).first()
    f1 = {k / 100: 2 * sum(y for p, y in v if math.floor(p * 100) >= k) / (sum(math.floor(p * 100) >= k for p, _ in v) + pos) for k in range(1, 100)}
    assert abs(best["f1"] - max(f1.values())) < 1e-9 and best["threshold"] == min(k for k, x in f1.items() if abs(x - max(f1.values())) < 1e-12)
    assert scoring.roc_auc(df.filter("target = 0")).first()["auc"] == 0.0 and scoring.roc_auc(df.limit(0)).first()["n_pos"] == 0


def test_coverage_and_history(spark):
    fi = spark.createDataFrame([(1, 10, d.date(2020, 1, 1), True), (1, 11, d.date(2020, 1, 2), False), (1, 12, d.date(2020, 1, 2), None), (2, 13, d.date(2020, 1, 5), True)], "fire_id int, image_id int, day date, downloaded boolean")
    pairs = coverage.day_pairs(coverage.day_coverage(fi))
    assert [tuple(x) for x in pairs.collect()] == [(1, d.date(2020, 1, 1), True, True, False, False)]
    assert sorted(x["image_id"] for x in coverage.missing_images(pairs, fi).collect()) == sorted(x["image_id"] for x in coverage.gap_images(pairs, fi).collect()) == [11, 12]
    assert tuple(coverage.refreshed(pairs, coverage.day_coverage(fi.limit(0))).first())[-2:] == (False, False)
    want = spark.createDataFrame([(1, d.date(2020, 1, 4)), (1, d.date(2019, 1, 1)), (7, d.date(2020, 1, 1))], "k int, day date")
    have = spark.createDataFrame([(1, d.date(2020, 1, 2)), (1, d.date(2020, 1, 6))], "k int, day date")
    assert {(x["k"], x["nearest"]) for x in history.nearest_day(want, have, ["k"], "day").collect()} == {(1, d.date(2020, 1, 2)), (7, None)}
    assert [r[0] for r in spread_pick([(1, 0, 0), (2, 1, 1), (3, 50, 0), (4, 2, 2)], 3, 30.0)] == [1, 3, 2]


def test_rasters(spark):
    full = [("a", i, j, 1.0) for i in range(4) for j in range(5)] + [("b", 0, i, 1.0) for i in range(3)] + [("c", 2, 2, 1.0)]
    s = {x["k"]: x["solidity"] for x in raster.solidity(spark.createDataFrame(full, "k string, row int, col int, value double"), "k").collect()}
    assert s == {"a": 20 / 12, "b": 1.0, "c": 1.0}
    r = random.Random(3)
    cells = [("k", r.randrange(300), r.randrange(300), r.randrange(9)) for _ in range(120)] + [("k", 9000, 9000, 8)]
    got = {(x["x"], x["y"]): x["d2"] for x in raster.nearest_predecessor(spark.createDataFrame(cells, "k string, x int, y int, t int"), "k", 3).collect()}
    first = {}
    for _, x, y, t in cells:
        first[(x, y)] = min(t, first.get((x, y), 99))
    t0 = min(first.values())
    want = {a: min((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 for b, u in first.items() if u < t) for a, t in first.items() if t > t0}
    assert got == want
    assert raster.hull_area(np.array([[0, 0], [0, 2], [2, 0], [2, 2], [1, 1]])) == 4.0


def test_store(spark, tmp_path):
    st = store.Store(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "2020-01-01", "x"), (2, "2020-02-03", None)], "id int, day string, note string")
    assert st.load("t") is None
    st.save("t", df, by=["id"])
    assert [tuple(x) for x in st.load("t", "id long, day date, size double, flag boolean", id=2).collect()] == [(2, d.date(2020, 2, 3), 0.0, False)]
    assert dict(store.iso_dates(df).dtypes) == {"id": "int", "day": "date", "note": "string"}
    assert st.write_missing("m", df, ["id"]).count() == 2 and st.write_missing("m", df, ["id"]).count() == 0 and st.load("m").count() == 2
    (tmp_path / "runs" / "transfer_europe_nf").mkdir(parents=True)
    (tmp_path / "runs" / "transfer_europe_nf" / "result.json").write_text('{"f1": 0.5, "other": 1}')
    got = store.collect_runs(spark, f"{tmp_path}/runs/*/result.json", "f1 double").first()
    assert (got["f1"], got["tag"], got["target"], got["region"]) == (0.5, "transfer_europe_nf", "nf", "europe")
    assert store.config_from({"a": 1, "b": 2}, '{"a": 3}', {"b": 4}) == {"a": 3, "b": 4}
    with pytest.raises(ValueError):
        store.config_from({"a": 1}, None, {"c": 1})


def test_region_filter(spark):
    df = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, region_id int")
    regions = spark.createDataFrame([(7, "r7"), (8, "r8")], "region_id int, name string")
    assert [x["id"] for x in filter_regions(df, regions, include=["r7"]).collect()] == [1]
    assert sorted(x["id"] for x in filter_regions(df, regions, exclude=["r7"]).collect()) == [2, 3]
    assert filter_regions(df, regions).count() == 3
    with pytest.raises(ValueError):
        filter_regions(df, regions, include=["nowhere"])
