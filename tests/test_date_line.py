"""Boxes across the date line, against brute force."""

import datetime as d
import random

import pytest

from emberframe.plans import registry
from emberframe.plans.history import spread_largest, spread_pick

CORE = registry()
DAY = d.date(2020, 1, 1)
#: fire_id, min_x, min_y, max_x, max_y: across the line, just west of it, just east of it, far away, and around the globe.
BOXES = [(1, 178.0, 10.0, -178.0, 11.0), (2, 179.0, 11.5, 179.8, 12.0), (3, -179.9, 10.0, -179.5, 11.0), (4, 0.0, 10.0, 1.0, 11.0), (5, -179.9, 40.0, 179.9, 41.0)]
POINTS = [(179.0, 10.5), (-179.0, 10.5), (-177.8, 10.5), (0.5, 10.5), (179.9, 10.5), (-179.95, 40.5), (539.0, 10.5), (181.0, 10.5)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("line"))
    fires = [(i, DAY, DAY, 10 * i, *b) for i, *b in BOXES]
    spark.createDataFrame(fires, "fire_id int, start_date date, end_date date, num_fire int, min_x double, min_y double, max_x double, max_y double").write.parquet(f"{at}/fires.parquet")
    samples = [(i, i, d.datetime(2020, 1, 2), 1, x, y, DAY) for i, (x, y) in enumerate(POINTS)]
    spark.createDataFrame(samples, "sample_id long, load_order long, loaded_at timestamp, fire_id int, lon double, lat double, dt date").write.parquet(f"{at}/samples.parquet")
    return at


def meets(a, b, pad):
    e = lambda x: x[3] + 360 * (x[3] < x[1])
    return any(a[1] + k <= e(b) + pad and b[1] <= e(a) + k + pad for k in (-720, -360, 0, 360, 720)) and a[2] <= b[4] + pad and b[2] <= a[4] + pad


def test_points_in_boxes(spark, sf_dir):
    want = {b[0]: sum(meets(b, (0, x, y, x, y), 0.5) for x, y in POINTS) for b in BOXES}
    got = {r["fire_id"]: r["n"] for r in CORE.queries["j16_points_in_boxes"](spark, sf_dir).collect()}
    assert got == {k: n for k, n in want.items() if n} and want[1] == 6 and want[3] == 3


def test_box_overlaps(spark, sf_dir):
    want = {(a[0], b[0]) for a in BOXES for b in BOXES if a[0] < b[0] and meets(a, b, 1)}
    got = {tuple(r) for r in CORE.queries["j18_box_overlaps"](spark, sf_dir).select("a", "b").collect()}
    assert got == want and {(1, 2), (1, 3), (2, 3)} <= want


def test_every_fire_has_a_box(spark, sf_dir):
    boxes = {r["fire_id"]: r for r in CORE.queries["f7_padded_boxes"](spark, sf_dir).collect()}
    assert len(boxes) == len(BOXES) and all((r["x1"] - r["x0"] - 32) % 256 == 0 and r["x1"] > r["x0"] for r in boxes.values())
    mpp = {r["fire_id"]: r["mpp"] for r in CORE.queries["f29_metres_per_pixel"](spark, sf_dir).collect()}
    assert len(mpp) == len(BOXES) and 1_700 < mpp[1] < 1_800
    assert CORE.queries["j30_density_lookup"](spark, sf_dir).first()["found"] == len(POINTS)


def test_spread_picks_walk_the_whole_table(spark, tmp_path):
    """600 large fires on one spot, smaller ones elsewhere, one of them across the line and one just beside it."""
    near = [(i, 10_000 - i, 10.0, 10.0, 10.2, 10.2) for i in range(1, 601)]
    rest = [(701, 90, 179.0, 0.0, -177.0, 1.0), (702, 80, -179.0, 0.0, -178.0, 1.0), (703, 70, 100.0, 0.0, 101.0, 1.0)]
    schema = "fire_id int, num_fire int, min_x double, min_y double, max_x double, max_y double"
    spark.createDataFrame(near + rest + rest[:1], schema).write.parquet(f"{tmp_path}/fires.parquet")
    got = [tuple(r) for r in CORE.queries["w16_spread_picks"](spark, str(tmp_path)).collect()]
    assert [r[0] for r in got] == [1, 701, 703, 2, 3, 4] and got[1][1] == -179.0


def test_spread_largest_as_spread_pick(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(50), r.uniform(-80, 80), r.uniform(-60, 60)) for i in range(300)]
    ranked = [(i, x, y, n) for i, n, x, y in sorted(rows, key=lambda v: (-v[1], v[0]))]
    f = spark.createDataFrame(rows, "fire_id int, num_fire int, x double, y double")
    for n, apart in ((6, 30.0), (12, 70.0), (0, 30.0)):
        assert spread_largest(f, n, apart) == spread_pick(ranked, n, apart)
