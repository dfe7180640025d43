"""Column functions of the domain; all are built-in expressions and stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of a grid cell in degrees: 375 m at 111.32 km per degree (fixed value).
CELL_DEG = 375 / 111_320
TWO_PI_R = 2 * math.pi * 6_371_000.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- file names and dates of granules


def granule_prefix(path: Column | str) -> Column:
    """Second to fourth dot-separated part of the base name, null with fewer than four parts."""
    parts = F.split(F.element_at(F.split(col(path), "/"), -1), "[.]")
    return F.when(F.size(parts) >= 4, F.concat_ws(".", parts[1], parts[2], parts[3]))


def prefix_date(prefix: Column | str) -> Column:
    """Date of a prefix A<year><day of year>.<hhmm>.<version>; day 366 of a common year is 1 January of the next."""
    p = col(prefix)
    ok = p.rlike(r"^A\d{7}")
    day = F.substring(p, 6, 3).try_cast("int")
    return F.when(ok, F.date_add(F.make_date(F.substring(p, 2, 4).try_cast("int"), F.lit(1), F.lit(1)), day - 1))


def utc_hour(prefix: Column | str) -> Column:
    """Hour with its fraction, from the hhmm part of a prefix; null where there is none."""
    hhmm = F.regexp_extract(col(prefix), r"^A\d{7}\.(\d{4})", 1)
    return F.when(hhmm != "", F.substring(hhmm, 1, 2).try_cast("int") + F.substring(hhmm, 3, 2).try_cast("int") / 60.0)


def local_solar_hour(hour: Column, lon: Column | str) -> Column:
    x = hour + col(lon) / 15.0
    return x - 24.0 * F.floor(x / 24.0)


def is_day_pass(hour: Column, lon: Column | str) -> Column:
    """Local solar time from 6 (included) to 18."""
    h = local_solar_hour(hour, lon)
    return (h >= 6.0) & (h < 18.0)


def is_well_lit(hour: Column, day_of_year: Column, lon: Column | str, lat: Column | str, margin: float = 1.5) -> Column:
    """Whether the sun is up for at least `margin` hours before and after; never in polar night, 2 to 22 h in polar day."""
    declination = F.radians(-23.45 * F.cos(F.radians(360.0 / 365.0 * (day_of_year + 10))))
    c = -F.tan(F.radians(col(lat))) * F.tan(declination)
    half = F.when(c < -1, 10.0).when(c > 1, None).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))) / 15.0)
    h = local_solar_hour(hour, lon)
    return F.coalesce((h >= 12.0 - half + margin) & (h <= 12.0 + half - margin), F.lit(False))


# ---- grid


def to_cell(lon: Column | str, lat: Column | str, cell: float = CELL_DEG) -> tuple[Column, Column]:
    """Grid coordinates (x, y) of a place as reals; y grows northward."""
    return (col(lon) + 180.0) / cell, (col(lat) + 90.0) / cell


def bbox_cells(min_x: Column, min_y: Column, max_x: Column, max_y: Column, cell: float = CELL_DEG) -> list[Column]:
    """Corner cells of a box, rounded half to even."""
    a, b = to_cell(min_x, min_y, cell)
    c, d = to_cell(max_x, max_y, cell)
    return [F.bround(v).cast("int") for v in (a, b, c, d)]


def padded_box(x0: Column, y0: Column, x1: Column, y1: Column, crop: int = 256, padding: int = 16) -> list[Column]:
    """The box grown to a multiple of crop in both directions, and by padding on each side; x1 and y1 are inclusive."""
    w, h = x1 + 1 - x0, y1 + 1 - y0
    px, py = F.pmod(crop - F.pmod(w, F.lit(crop)), F.lit(crop)), F.pmod(crop - F.pmod(h, F.lit(crop)), F.lit(crop))
    lx, ly = F.floor(px / 2), F.floor(py / 2)
    return [x0 - (lx + padding), y0 - (ly + padding), x1 + 1 + (px - lx + padding), y1 + 1 + (py - ly + padding)]


def footprint_degrees(lat: Column | str, zenith: Column | str) -> tuple[Column, Column]:
    """Width and height in degrees of an imaging pixel by latitude and view zenith (fixed values of the sensor)."""
    z, t = F.abs(col(zenith)), F.radians(col(zenith))
    joined = F.when(z <= 31.72, 3.0).when(z <= 44.86, 2.0).otherwise(1.0)
    per_deg = 2 * math.pi * 6_371_008.8 / 360.0
    dx = joined * 129.3 / F.pow(F.cos(t), 2) / (per_deg * F.cos(F.radians(col(lat))))
    return dx, 371.0 / F.cos(t) / per_deg


def flat_km2(pixels: Column | str, side_m: float = 375.0) -> Column:
    return col(pixels) * (side_m**2 / 1e6)


def latitude_km2(pixels: Column | str, lat: Column | str, cell: float = CELL_DEG) -> Column:
    """Area of grid cells with the meridians' convergence, 111 km to a degree."""
    return col(pixels) * ((cell * 111.0) ** 2) * F.cos(F.radians(col(lat)))


def kernel_size(lat: Column | str, base: int = 3) -> Column:
    """The odd kernel that covers at a latitude what base covers at the equator."""
    k = F.ceil(F.lit(float(base)) / F.cos(F.radians(F.abs(col(lat)))))
    return F.greatest(F.lit(base), k + F.pmod(k + 1, F.lit(2))).cast("int")


def coarse_cell(lon: Column | str, lat: Column | str, nx: int = 8) -> tuple[Column, Column]:
    step = 360.0 / nx
    return ((col(lon) + 180.0) / step).cast("int"), ((col(lat) + 90.0) / step).cast("int")


def coarse_extent(xi: Column, yi: Column, nx: int = 8, padding: float = 1.0) -> Column:
    step = 360.0 / nx
    return F.array(
        F.greatest(F.lit(-180.0), -180.0 + xi * step - padding),
        F.greatest(F.lit(-90.0), -90.0 + yi * step - padding),
        F.least(F.lit(180.0), -180.0 + (xi + 1) * step + padding),
        F.least(F.lit(90.0), -90.0 + (yi + 1) * step + padding),
    )


def crosses_date_line(west: Column | str, east: Column | str) -> Column:
    return col(west) > col(east)


def in_polygon(x: Column | str, y: Column | str, ring: Column | str) -> Column:
    """Ray casting against a ring, ARRAY<STRUCT<x, y>>, closed or open; points on an edge may go either way."""
    px, py, r = col(x), col(y), col(ring)
    n = F.size(r)

    def crosses(i: Column) -> Column:
        a, b = F.get(r, i), F.get(r, F.pmod(i + 1, n))
        over = (a["y"] > py) != (b["y"] > py)
        at = (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(over & (px < at), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i))
    return F.when(n >= 3, F.pmod(hits, F.lit(2)) == 1).otherwise(F.lit(False))


def metres_per_pixel(dlon: Column, dlat: Column, mean_lat: Column, pixels: Column) -> Column:
    """Length of a side given in degrees over its number of pixels."""
    per = TWO_PI_R / 360.0
    return F.hypot(dlon * per * F.cos(F.radians(mean_lat)), dlat * per) / pixels


# ---- weather


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def vapour_deficit(temp_c: Column | str, dew_c: Column | str) -> Column:
    """Vapour pressure deficit in kPa (Tetens), temperatures clipped to -90 .. 60, at least 0."""

    def es(t: Column) -> Column:
        t = clip(t, -90.0, 60.0)
        return 0.6108 * F.exp(17.27 * t / (t + 237.3))

    return F.greatest(F.lit(0.0), es(col(temp_c)) - es(col(dew_c)))


def ratio_anomaly(now: Column | str, past: Column | str, least: float = 0.05, lo: float = 0.2, hi: float = 3.0) -> Column:
    return clip(col(now) / F.greatest(F.abs(col(past)), F.lit(least)), lo, hi)


def wind(u: Column | str, v: Column | str) -> tuple[Column, Column, Column]:
    """Magnitude, and sine and cosine of the direction."""
    a = F.atan2(col(v), col(u))
    return F.sqrt(col(u) * col(u) + col(v) * col(v)), F.sin(a), F.cos(a)


def largest_magnitude(lowest: Column, highest: Column) -> Column:
    """Of two extremes the one farther from 0, with its sign; the higher on ties."""
    return F.when(F.abs(lowest) > F.abs(highest), lowest).otherwise(highest)


def piecewise_percentile(v: Column | str, thresholds: list[Column], marks: tuple[int, ...] = (10, 25, 50, 75, 90)) -> Column:
    """Percentile of v between the thresholds of the given marks, extended to 0 and 100 at the ends."""
    x = col(v)
    out = F.when(x <= thresholds[0], marks[0] * x / F.greatest(thresholds[0], F.lit(0.01)))
    for i in range(1, len(marks)):
        a, b = thresholds[i - 1], thresholds[i]
        out = out.when(x <= b, marks[i - 1] + (x - a) / F.greatest(b - a, F.lit(0.001)) * (marks[i] - marks[i - 1]))
    top = thresholds[-1]
    last = marks[-1] + (100 - marks[-1]) * F.least(F.lit(1.0), (x - top) / F.greatest(top, F.lit(0.01)))
    return clip(out.otherwise(last), 0.0, 100.0)


# ---- encodings


def quantize(v: Column | str, lo: float, hi: float, top: int) -> Column:
    return F.round((col(v) - lo) / (hi - lo) * top).cast("int")


def dequantize(q: Column | str, lo: float, hi: float, top: int) -> Column:
    return col(q) / float(top) * (hi - lo) + lo


def quantize_array(v: Column | str, lo: float, hi: float, top: int = 254, missing: int = 255) -> Column:
    """Elements as whole numbers 0 .. top, clipped; null and NaN elements as `missing`."""
    return F.transform(
        col(v),
        lambda x: F.when(x.isNull() | F.isnan(x), missing).otherwise(
            F.bround((F.greatest(F.lit(lo), F.least(F.lit(hi), x.cast("double"))) - lo) / (hi - lo) * top).cast("int")
        ),
    )


def dequantize_array(q: Column | str, lo: float, hi: float, top: int = 254, missing: int = 255) -> Column:
    return F.transform(col(q), lambda x: F.when(x == missing, None).otherwise(x / float(top) * (hi - lo) + lo))


# ---- observations and labels


def is_clear(v: Column | str) -> Column:
    """Land, water or fire seen without cloud (fixed values)."""
    return col(v).isin(3, 5, 7, 8, 9)


def priority_tier(v: Column | str) -> Column:
    """0 no data, 1 cloud or unclassified, 2 clear, 3 fire (fixed values)."""
    return F.when(col(v).isin(4, 6), 1).when(col(v).isin(3, 5), 2).when(col(v).isin(7, 8, 9), 3).otherwise(0)


def priority_key(v: Column | str) -> Column:
    """Order of observations when passes are merged: the tier, then the value; max_by of it is associative."""
    return priority_tier(v) * 256 + col(v)


def size_class(n: Column | str) -> Column:
    return F.when(col(n) < 100, "tiny").when(col(n) < 1000, "small").when(col(n) < 10000, "medium").otherwise("large")


def size_range(n: Column | str) -> Column:
    return F.when(col(n) < 100, "<100").when(col(n) < 1000, "100-1000").when(col(n) < 10000, "1000-10000").otherwise(">10000")


def size_panel(n: Column | str) -> Column:
    """Three ranges of figures; null below 0."""
    return F.when(col(n) < 0, None).when(col(n) < 500, "< 500").when(col(n) < 5000, "500–5k").when(col(n) >= 5000, "5k+")


def is_tame(n: Column, xy: Column, ign: Column, t_ratio: Column) -> Column:
    """Crop burns and flares: at least 100 detections and long-lived, or compact with many ignitions."""
    return F.coalesce((n >= 100) & ((t_ratio > 1.5) | ((xy <= 12) & (ign * 100 >= 2))), F.lit(False))


def is_wild(n: Column, xy: Column, ign: Column, t_ratio: Column, km2: Column, least_km2: float = 1.0) -> Column:
    return F.coalesce((n >= 100) & ~is_tame(n, xy, ign, t_ratio) & (xy >= 17) & (t_ratio < 0.75) & (km2 >= least_km2), F.lit(False))


def type_label(t: Column | str) -> Column:
    return F.when(col(t) == 0, "vegetation").when(col(t) == 1, "static").when(col(t) == 2, "crop").otherwise("unknown")


def region_label(name: Column, region_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("unknown_"), F.coalesce(region_id, F.lit(0)).cast("string")))


def relative_age(t: Column, newest: Column, scale: float = 30.0) -> Column:
    """Days since first seen over scale, at most 1; -1 where never seen (t < 0 or null)."""
    return F.when(t.isNull() | (t < 0), -1.0).otherwise(clip((newest - t) / scale, 0.0, 1.0))


def years_since_2000(d: Column | str) -> Column:
    return F.year(col(d)) - 2000 + (F.dayofyear(col(d)) - 1) / 365.25


def file_status(pending: Column, size: Column, expected: Column) -> Column:
    return F.when(pending, "pending").when(size.isNull(), "missing").when(size == expected, "valid").otherwise("invalid")


def centred_at(p: Column | str, t: float) -> Column:
    """A probability moved so that the threshold t stands at 0.5."""
    x = col(p)
    if t <= 0:
        return clip(x, 0.0, 1.0)
    high = F.lit(0.5) if t >= 1 else 0.5 + 0.5 * (x - t) / (1.0 - t)
    return clip(F.when(x < t, 0.5 * x / t).otherwise(high), 0.0, 1.0)


def scaled_training(n: Column | str, reference: int = 20_000, epochs: int = 15, patience: int = 5) -> tuple[Column, Column]:
    """Epochs and patience, growing with the fourth root of reference / n, capped at 100 and 30."""
    k = F.pow(F.lit(float(reference)) / F.nullif(col(n), F.lit(0)), F.lit(0.25))
    keep = (col(n) >= reference) | (col(n) == 0)

    def grown(base: int, most: int) -> Column:
        return F.when(keep, base).otherwise(F.greatest(F.lit(base), F.least(F.lit(most), F.bround(base * k).cast("int"))))

    return grown(epochs, 100), grown(patience, 30)


# ---- texts of reports


def slug(name: Column | str) -> Column:
    return F.translate(F.lower(col(name)), " /", "__")


def short_target(name: Column | str) -> Column:
    return F.when(col(name) == "new_fires", "nf").when(col(name) == "next_mask", "nm").otherwise(col(name))


def run_label(tag: Column | str, loss: Column | str) -> Column:
    """Label of a grid run from the weight in its tag, ? where the tag has none."""
    t = F.concat(F.lit("_"), col(tag))
    pw, a = F.regexp_extract(t, "_pw([^_]*)", 1), F.regexp_extract(t, r"_a(\d+)(?:_|$)", 1)
    return (
        F.when(col(loss) == "bce", F.concat(F.lit("BCE pw"), F.when(t.contains("_pw"), pw).otherwise("?")))
        .when(col(loss) == "focal", F.concat(F.lit("Focal $\\alpha$"), F.when(a != "", F.concat(F.lit("."), a)).otherwise("?")))
        .otherwise(col(tag))
    )


def score_text(v: Column | str) -> Column:
    """Three decimals without the leading zero; -- for null."""
    s = F.format_string("%.3f", col(v).cast("double"))
    return F.when(col(v).isNull(), "--").when(s.startswith("0."), F.substring(s, 2, 9)).otherwise(s)


def count_text(v: Column | str) -> Column:
    return F.when(col(v).isNull(), "--").otherwise(F.format_number(F.bround(col(v).cast("double")), 0))


def delta_text(v: Column | str) -> Column:
    return F.when(col(v) >= 0, F.concat(F.lit("+"), score_text(v))).otherwise(F.concat(F.lit("$-$"), score_text(F.abs(col(v)))))


#: Replacements of a text for typesetting, in this order (fixed values); later ones also act on earlier ones' output.
ESCAPES = [
    ("\\", "\\textbackslash{}"),
    ("&", "\\&"),
    ("%", "\\%"),
    ("$", "\\$"),
    ("#", "\\#"),
    ("_", "\\_"),
    ("{", "\\{"),
    ("}", "\\}"),
    ("~", "\\textasciitilde{}"),
    ("^", "\\textasciicircum{}"),
]


def escaped(text: Column | str) -> Column:
    out = col(text)
    for a, b in ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# ---- losses


def bce(logit: Column, y: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross entropy of a logit, in the form that neither overflows nor loses digits."""
    soft = F.log1p(F.exp(-F.abs(logit)))
    return pos_weight * y * (soft + F.greatest(-logit, F.lit(0.0))) + (1 - y) * (soft + F.greatest(logit, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def focal(logit: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(logit)
    pt = p * y + (1 - p) * (1 - y)
    return (alpha * y + (1 - alpha) * (1 - y)) * F.pow(1 - pt, F.lit(gamma)) * bce(logit, y)


#: Land cover that is static in every region, and how long lasting a fire is static whatever its land cover.
STATIC_LC = ("urban", "ocean", "bare", "water")
STATIC_T_RATIO = 10.0


def fire_type(lc: Column, t_ratio: Column, exclude_lc: Column, crop_is_veg: Column) -> Column:
    """0 vegetation, 1 static, 2 crop; names of land cover are compared without case.

    Static are fires that last far longer than they spread, those on land cover that is static everywhere, and those on
    what their region excludes besides. Cropland is vegetation where the region says so. A null list excludes
    nothing besides, a null flag is false, a null or NaN ratio is no reason.
    """
    name = F.lower(lc)
    listed = F.coalesce(F.exists(exclude_lc, lambda x: F.lower(x) == name), F.lit(False))
    lasting = F.coalesce((t_ratio > STATIC_T_RATIO) & ~F.isnan(t_ratio), F.lit(False))
    static = lasting | F.coalesce(name.isin(*STATIC_LC), F.lit(False)) | listed
    crop = F.coalesce(name == "cropland", F.lit(False))
    return F.when(static, 1).when(crop & ~F.coalesce(crop_is_veg, F.lit(False)), 2).otherwise(0)
