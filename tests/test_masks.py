"""Masks of fires: dense places, odd boxes, and kernels that don't depend on how their rows are cut."""

import datetime as dt
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from emberframe.operators import masks
from emberframe.plans import composites
from tests.test_queries import CORE, canon

DAY = dt.date(2020, 3, 1)
#: West, south, east and north of boxes: at one place, across the date line, by its edge in both conventions, with two boxes for fire 3, around the globe, at the pole, turned over.
BOXES = [(1, 10.02, 20.03, 10.07, 20.08), (2, 179.9, -5.0, -179.9, -4.9), (3, 9.98, 19.95, 10.1, 20.1), (3, 10.01, 20.0, 10.05, 20.1), (4, -179.5, 19.0, 179.5, 21.0)]
BOXES += [(5, 30.0, 89.9, 30.1, 90.0), (6, 10.0, 20.5, 10.1, 20.4), (7, -181.0, -5.0, -180.9, -4.9), (8, 179.0, -5.0, 179.1, -4.9), (None, 10.0, 20.0, 10.1, 20.1)]


@pytest.fixture
def tables(tmp_path):
    """50 fires and 400 points of two days near 10 E, 20 N, with the boxes above and points near them."""
    rng = random.Random(3)
    boxes = BOXES + [(100 + i, 10 + rng.randrange(200) / 1000, 20 + rng.randrange(200) / 1000, 10.3, 20.3) for i in range(50)]
    fires = pd.DataFrame(boxes * 2, columns=["fire_id", "min_x", "min_y", "max_x", "max_y"]).assign(start_date=DAY)
    at = [(10 + rng.randrange(-60, 160) / 100, 20 + rng.randrange(-90, 130) / 100) for _ in range(300)] + [(10.05, 20.05)] * 100
    at += [(180 + rng.randrange(-200, 200) / 100, -5 + rng.randrange(-110, 110) / 100) for _ in range(150)] + [(rng.randrange(-180, 180), 89.5) for _ in range(40)]
    at += [(rng.randrange(-1800, 1800) / 10, 20.5) for _ in range(100)] + [(30.0, 90.0), (None, 20.0), (10.0, 91.0)]
    samples = pd.DataFrame(at, columns=["lon", "lat"])
    samples["sample_id"] = [3 * i - 400 for i in range(len(at))]
    samples["load_order"] = range(len(at))
    samples["loaded_at"] = pd.Timestamp("2020-04-01")
    samples["dt"] = [DAY + dt.timedelta(rng.randrange(2)) for _ in at]
    samples["fire_id"] = pd.array([rng.choice([None, 1, 2, 3, 4, 100, 101, 102]) for _ in at], "Int64")
    con = duckdb.connect()
    con.execute("create table samples as select * replace (dt::date as dt, fire_id::integer as fire_id) from samples")
    con.execute("create table fires as select * replace (fire_id::integer as fire_id, start_date::date as start_date) from fires")
    for t in ("samples", "fires"):
        con.execute(f"copy {t} to '{tmp_path / t}.parquet'")
    return con, str(tmp_path)


def test_fire_masks_of_odd_boxes(spark, tables, monkeypatch):
    """Against the SQL, with fires of any share."""
    con, at = tables
    real = composites.fire_masks
    monkeypatch.setattr(composites, "fire_masks", lambda points, fires, _: real(points, fires, 0.0))
    want = con.sql(CORE.sql["qg_fire_masks"].replace("share >= 0.1", "share >= 0")).df()
    assert canon(CORE.queries["qg_fire_masks"](spark, at).toPandas()) == canon(want)
    ids = set(want["fire_id"].dropna())
    assert {1, 2, 3, 4, 5, 6, 7, 8, 100} < ids and want["fire_id"].isna().sum() == 1
    assert (want["n_target"] > 0).sum() > 3 and (want["n_new"] > want["n_target"]).any() and want["share"].max() > 0


def test_fire_masks_write_no_pairs(spark, tables, monkeypatch):
    """What is written on the way has a row for each point, and for each fire, day and granule, however many of them meet."""
    real, rows = composites.materialize, []

    def counted(df, *args):
        out = real(df, *args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(composites, "materialize", counted)
    CORE.queries["qg_fire_masks"](spark, tables[1]).collect()
    con = tables[0]
    points, fires = (con.sql(f"select count(*) from {t}").fetchall()[0][0] for t in ("samples", "fires"))
    assert rows and max(rows) <= max(points, 4 * fires)


def test_kernels_dont_depend_on_cuts(monkeypatch):
    rng = np.random.default_rng(4)
    n = 400
    d = pd.DataFrame({"granule": np.sort(rng.integers(0, 12, n)), "fire": rng.integers(0, 5, n), "later": rng.integers(-1, 2, n).astype(np.int8), "id": np.arange(n), "state": rng.integers(1, 4, n)})
    d["x0"], d["y0"] = rng.integers(0, 300, n) / 100, rng.integers(0, 300, n) / 100
    d["x1"], d["y1"] = d["x0"] + 0.3, d["y0"] + 0.3

    def run(size):
        cut = lambda df: (df.iloc[i : i + size] for i in range(0, len(df), size))
        seen = pd.concat(masks.placed(cut(d))).sort_values("fire", kind="stable")
        return pd.concat(masks.masked(cut(seen))).to_dict("list")

    want = run(n)
    assert len(want["fire"]) == 5 and sum(want["n_new"]) > 0
    monkeypatch.setattr(masks, "MOST", 60)
    assert run(7) == want
