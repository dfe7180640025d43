"""Joins whose sides Spark takes for smaller than they are never broadcast them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from emberframe.operators import graph, raster
from emberframe.plans import composites
from tests.test_queries import CORE, DATA


@pytest.fixture
def plans(monkeypatch):
    """Physical plans of all that an operator materializes, to which a test adds those of its results."""
    seen = []

    def watch(module):
        real = module.materialize

        def kept(df, *args):
            seen.append(plan(df))
            return real(df, *args)

        monkeypatch.setattr(module, "materialize", kept)
        return seen

    return watch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins_without_broadcast(seen):
    return any("SortMergeJoin" in p for p in seen) and not any("Broadcast" in p for p in seen)


CELLS = [(x, y, t) for x in range(0, 12, 3) for y in range(0, 8, 2) for t in range(0, 30, 9)]


def test_components_broadcast_nothing(spark, plans):
    seen = plans(graph)
    seen.append(plan(graph.label_cells(spark.createDataFrame(CELLS, "x int, y int, t int"))))
    assert joins_without_broadcast(seen)


def test_patch_labels_broadcast_nothing(spark, plans):
    """One day a patch, nothing in reach across it."""
    seen = plans(graph)
    seen.append(plan(graph.label_cells(spark.createDataFrame(CELLS, "x int, y int, t int"), 1, 1, 0)))
    assert joins_without_broadcast(seen)


def test_holes_are_filled_without_naming_them(spark, plans):
    """Two cells in a large grid: rows are made for the cells around them, and the grid is only looked up."""
    side = F.explode(F.sequence(F.lit(0), F.lit(99)))
    cells = spark.createDataFrame([(1, 5, 5, 1.0), (1, 5, 7, 2.0)], "p int, row int, col int, value double")
    grid = cells.select("p").distinct().select("p", side.alias("row")).select("p", "row", side.alias("col"))
    out = raster.fill_holes(cells, grid, ["p"], 1)
    rows = out.collect()
    assert joins_without_broadcast([plan(out)])
    want = {(r, c): 1.0 if c < 7 else 2.0 for r in (4, 5, 6) for c in (4, 5, 6, 7, 8)}
    assert {(r.row, r.col): r.value for r in rows} == {k: v for k, v in want.items() if k not in ((5, 5), (5, 7))}


def test_spread_broadcasts_nothing(spark, plans):
    seen = plans(raster)
    seen.append(plan(raster.spread(spark.createDataFrame([(1, *c) for c in CELLS], "p int, x int, y int, t int"), "p")))
    assert joins_without_broadcast(seen)


def test_events_broadcast_nothing(spark, plans):
    seen = plans(graph)
    seen.append(plan(graph.event_stats(graph.event_cells(spark.createDataFrame(CELLS, "x int, y int, t int")))))
    assert joins_without_broadcast(seen)


def test_ignitions_broadcast_nothing(spark, plans):
    seen = plans(graph)
    seen.append(plan(graph.event_cells(spark.createDataFrame(CELLS, "x int, y int, t int"), 1, 1, 3)))
    assert joins_without_broadcast(seen)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_detections_are_joined_without_broadcast(spark):
    assert joins_without_broadcast([plan(CORE.queries["g7_detections"](spark, DATA))])


def test_closing_shuffles_cells_once(spark):
    """Cells on both sides of a block's edge and at the grid's border, against the definition."""
    rng = random.Random(5)
    cells = {(1, r, c): 1000 * r + c for r in range(56, 72) for c in range(58, 70) if rng.random() < 0.5}
    cells |= {(2, r, c): 1000 * r + c for r in range(0, 6) for c in range(0, 6) if rng.random() < 0.7}
    out = raster.closing(spark.createDataFrame([(*k, v) for k, v in cells.items()], "p int, row int, col int, id int"), ["p"], 80, 80)
    got = {(r.p, r.row, r.col): r.id for r in out.collect()}
    off = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    grown = {}
    for (p, r, c), v in cells.items():
        for i, j in off:
            if 0 <= r + i < 80 and 0 <= c + j < 80:
                k = (p, r + i, c + j)
                grown[k] = min(grown.get(k, (9,)), (i * i + j * j, r, c, v))
    want = {k: t[3] for k, t in grown.items() if all((k[0], k[1] + i, k[2] + j) in grown for i, j in off)} | cells
    assert got == want and len(got) > len(cells)
    assert plan(out).split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_fire_masks_shuffle_points_once(spark, plans):
    """Points are projected and merged by cell in the partitions of their block."""
    seen = plans(composites)
    CORE.queries["qg_fire_masks"](spark, DATA)
    merged = [p for p in seen if "obs0" in p]
    assert len(merged) == 1 and merged[0].split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
