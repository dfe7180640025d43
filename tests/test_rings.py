import datetime as d

from emberframe.operators.rings import boxes_in_rings

DAY, NEXT = d.date(2020, 1, 1), d.date(2020, 1, 2)
RINGS = {
    "slanted": [(0, 0), (10, 0), (30, 40), (20, 40)],
    "line": [(170, -10), (-170, -10), (-160, 10), (-180, 10)],
    "hook": [(60, 0), (90, 0), (90, 30), (80, 30), (80, 10), (60, 10)],
    "pole": [(0, 70), (120, 70), (-120, 70)],
    "thin": [(0, 0), (5, 5)],
}
#: name of the case: box, rings that it meets
BOXES = {
    "beside the slant, inside its bounds": ((1, 30, 5, 35), set()),
    "inside the slant": ((14, 18, 15, 19), {"slanted"}),
    "holds the slant": ((-5, -5, 35, 45), {"slanted"}),
    "crosses two edges, holds no corner": ((5, 20, 29, 21), {"slanted"}),
    "touches a corner": ((-5, -5, 0, 0), {"slanted"}),
    "across the line, both": ((179, 0, -179, 1), {"line"}),
    "east of the line": ((-175, 0, -174, 1), {"line"}),
    "west of the line": ((176, -5, 178, -4), {"line"}),
    "across the line, too far north": ((179, 20, -179, 21), set()),
    "in the notch of the hook": ((65, 15, 75, 25), set()),
    "near the pole": ((-60, 85, -59, 86), {"pole"}),
    "at the pole across the line": ((170, 80, -170, 81), {"pole"}),
    "around the globe": ((-180, 0, 179.9, 1), {"slanted", "line", "hook"}),
}


def test_boxes_in_rings(spark):
    rings = spark.createDataFrame([(k, day, [(float(x), float(y)) for x, y in v]) for k, v in RINGS.items() for day in (DAY,)], "ring_id string, day date, ring array<struct<x double, y double>>")
    boxes = [(i, *map(float, b), day) for i, (b, _) in enumerate(BOXES.values()) for day in (DAY, NEXT)]
    boxes = spark.createDataFrame(boxes, "fire_id int, x0 double, y0 double, x1 double, y1 double, day date")
    for bin_deg in (5.0, 30.0):
        got = {k: set() for k in BOXES}
        for r in boxes_in_rings(boxes, rings, bin_deg).collect():
            assert r["day"] == DAY
            got[list(BOXES)[r["fire_id"]]].add(r["ring_id"])
        assert got == {k: want for k, (_, want) in BOXES.items()}
