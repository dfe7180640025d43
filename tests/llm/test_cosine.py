import math
import random

import pytest

from emberframe.llm import cosine
from emberframe.llm.cosine import cosine_join, unit_vectors
from emberframe.llm.scenes import members, overlaps, scene_classes


def vectors(r, n):
    return [(i, f"t{min(r.randrange(40), r.randrange(40))}", r.random() + 0.01) for i in range(n) for _ in range(r.randrange(1, 9))]


def unit(rows):
    v = {}
    for i, t, w in rows:
        v.setdefault(i, {}).setdefault(t, 0.0)
        v[i][t] += w
    return {i: {t: w / math.sqrt(sum(x * x for x in d.values())) for t, w in d.items()} for i, d in v.items()}


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.8, 0.97])
def test_equals_brute_force(spark, threshold):
    r = random.Random(11)
    a, b = vectors(r, 60), vectors(r, 80)
    b += [(200, t, w) for i, t, w in a if i == 3]
    schema = "id int, term string, weight double"
    got = cosine_join(unit_vectors(spark.createDataFrame(a, schema)), unit_vectors(spark.createDataFrame(b, schema)), threshold)
    ua, ub = unit(a), unit(b)
    want = {(i, j): sum(w * y.get(t, 0.0) for t, w in x.items()) for i, x in ua.items() for j, y in ub.items()}
    want = {k: v for k, v in want.items() if v >= threshold - 1e-9}
    rows = {(x["left_id"], x["right_id"]): x["cosine"] for x in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-9 for k in want)
    if threshold > 0.9:
        assert (3, 200) in rows


def test_empty_sides_and_null_terms(spark):
    schema = "id int, term string, weight double"
    a = unit_vectors(spark.createDataFrame([(1, "x", 1.0), (1, None, 1.0), (None, "x", 1.0), (2, "y", 0.0)], schema))
    assert a.count() == 1
    e = unit_vectors(spark.createDataFrame([], schema))
    assert cosine_join(a, e, 0.5).count() == cosine_join(e, a, 0.5).count() == 0
    with pytest.raises(ValueError):
        cosine_join(a, a, 0.0)


def km(a, b):
    la, lo, lb, l2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((l2 - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_scene_overlaps_lose_no_pair(spark):
    import datetime as d

    r = random.Random(4)
    centres = [(0.0, 0.0), (4.9999, 10.0), (60.0, 179.9995), (-60.0, -180.0), (84.9999, 20.0), (85.001, 20.0), (89.95, 0.0), (-33.0, 151.2)]
    rows = []
    for i in range(700):
        la, lo = r.choice(centres)
        la += r.uniform(-1, 1) * 0.004
        lo = lo + r.uniform(-1, 1) * 0.004 / max(0.01, math.cos(math.radians(la)))
        lo = (lo + 180) % 360 - 180
        place = (min(90.0, la), lo) if r.random() > 0.1 else (None, None)
        fire = r.randrange(40) if r.random() > 0.1 else None
        rows.append((i, r.choice(["train", "train", "eval"]), fire, r.randrange(2), 0, *place, d.date(2020, 1, 1 + r.randrange(4)) if i % 50 else None))
    df = spark.createDataFrame(rows, "sample_id long, side string, fire int, xi int, yi int, lat double, lon double, dt date")
    classes = scene_classes(df)
    of = {}
    for x in members(df, classes).collect():
        of.setdefault(x["scene"], []).append(x["sample_id"])
    assert sum(map(len, of.values())) == len(rows)
    found = overlaps(classes, 0.2, 1).collect()
    got = {(a, b) for x in found for a in of[x["train_scene"]] for b in of[x["eval_scene"]]}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] == "eval" and a[7] and b[7] and abs((a[7] - b[7]).days) <= 1:
                tile = a[2] is not None and a[2:5] == b[2:5]
                near = a[5] is not None and b[5] is not None and km(a[5:7], b[5:7]) <= 0.2
                if tile or near:
                    want.add((a[0], b[0]))
    assert got == want and len(want) > 50


def test_scenes_are_pruned_by_weight(spark, monkeypatch):
    seen = []

    def watched(df, *a):
        seen.append(kept(df, *a))
        return seen[-1]

    kept = cosine.materialize
    monkeypatch.setattr(cosine, "materialize", watched)
    # One fire on one day, tiles far apart: its list is long, and says nothing.
    rows = [(i, "train" if i % 2 else "eval", 7, i // 2, 0, 10.0 + (i // 2) * 0.1, 20.0) for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id long, side string, fire int, xi int, yi int, lat double, lon double").selectExpr("*", "date'2020-01-01' as dt")
    found = {(x["train_scene"], x["eval_scene"]) for x in overlaps(scene_classes(df), 0.2, 1).collect()}
    assert found == {(i + 1, i) for i in range(0, 400, 2)}
    posted = next(d for d in seen if "indexed" in d.columns)
    cand = next(d for d in seen if "dot" in d.columns)
    assert posted.filter("not indexed").count() >= 200 and posted.filter("indexed").count() <= 3 * 200
    assert cand.count() == cand.filter("rest > 0").count() == 200
