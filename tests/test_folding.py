"""One place in both conventions of longitude is one place."""

import datetime as d

import pytest

from emberframe.plans import registry

CORE = registry()
DAY = d.date(2020, 1, 1)
#: fire_id, lon, lat; every place twice, and fire 3 on both sides of the date line.
ROWS = [(1, -100.25, 40.2), (1, 259.75, 40.2), (2, 10.2, -5.2), (2, 370.2, -5.2), (3, 179.5, 1.2), (3, 180.5, 1.2), (4, None, 1.2)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("fold"))
    rows = [(i, i, d.datetime(2020, 1, 2), f, x, y, DAY) for i, (f, x, y) in enumerate(ROWS)]
    spark.createDataFrame(rows, "sample_id long, load_order long, loaded_at timestamp, fire_id int, lon double, lat double, dt date").write.parquet(f"{at}/samples.parquet")
    cells = [("region", int((90 - y) * 2), int(((x + 180) % 360) * 2), 7.0) for _, x, y in ROWS if x is not None]
    spark.createDataFrame(sorted(set(cells)), "layer string, grid_row int, grid_col int, cell_value double").write.parquet(f"{at}/raster.parquet")
    return at


def test_canopy_under_every_located_sample(spark, sf_dir):
    got = {r["sample_id"]: r["height"] for r in CORE.queries["s18_canopy_dates"](spark, sf_dir).collect()}
    assert got == dict.fromkeys(range(6), 21.0)


def test_cells_are_counted_once(spark, sf_dir):
    got = {(r["x"], r["y"]): r["fire_id"] for r in CORE.queries["w8_latest_fire"](spark, sf_dir).collect()}
    assert got == {(-101, 40): 1, (10, -6): 2, (179, 1): 3, (-180, 1): 3}
    assert {(r["x"], r["y"], r["n"]) for r in CORE.queries["a42_sample_density"](spark, sf_dir).collect()} == {(-34, 13, 2), (3, -2, 2), (59, 0, 1), (-60, 0, 1)}
    assert {(r["x"], r["n"]) for r in CORE.queries["a44_detection_counts"](spark, sf_dir).collect()} == {(-1003, 1), (102, 1), (1795, 1), (-1795, 1)}


def test_centres(spark, sf_dir):
    got = {r["id"]: r["lon"] for r in CORE.queries["a45_event_rollup"](spark, sf_dir).collect()}
    assert got == {1: -100.25, 2: 10.2, 3: -180.0, 4: None}
