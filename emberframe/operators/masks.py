"""Kernels of fire masks: points of a granule on the grids of the fires near them, and a fire's granules as one mask.

Both run over partitions sorted by a key. A pair of a fire and a point, or a cell, is never a row, so what is written and shuffled grows
with points and fires and not with the pairs of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Pairs and cells that are held at once, unless a single fire has more.
MOST = 1 << 20
#: What is said of a cell, in the order in which it counts: nothing, no clear view, clear, fire. Half a byte has two bits of it, and whether the fire itself was detected.
CLEAR, FIRE, OWN = 2, 3, 4
_PLACED = ["fire", "row", "col", "width", "obs0", "obs1"]


def whole_keys(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of batches, sorted by key, cut where the key changes."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        if held and held[-1][key].iat[-1] != k[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _parts(weights: np.ndarray) -> Iterator[slice]:
    """Slices of about MOST in weight."""
    at = _starts(np.cumsum(weights) // MOST)
    yield from (slice(a, b) for a, b in zip(at, [*at[1:], len(weights)]))


def _within(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (granule, fire, later, id, state, x0, y0, x1, y1), sorted by granule, as rasters (fire, row, col, width, obs0 or obs1).

    Rows with later -1 are points (x0, y0) with their own fire, the others fires' boxes, of which a fire may have several. A granule is projected if its box comes within a
    degree of the fire's, and then its points within a degree, onto the nine cells of a tenth of a degree around each. A cell keeps
    the state of the nearest point, of equally near ones that with the smallest id. Points lie in [-180, 180), x1 beyond x0.
    """
    for pdf in whole_keys(batches, "granule"):
        points = pdf[pdf["later"] < 0].sort_values(["granule", "id"])
        fires = pdf[pdf["later"] >= 0].sort_values(["granule", "fire", "later"])
        p, f = ({c: d[c].to_numpy() for c in d.columns} for d in (points, fires))
        if not (len(points) and len(fires)):
            continue
        at = _starts(p["granule"])
        names, counts = p["granule"][at], np.diff([*at, len(points)])
        west, south = (np.minimum.reduceat(p[c], at) for c in ("x0", "y0"))
        east, north = (np.maximum.reduceat(p[c], at) for c in ("x0", "y0"))
        g = np.minimum(np.searchsorted(names, f["granule"]), len(names) - 1)
        near = (names[g] == f["granule"]) & (f["y0"] <= north[g] + 1) & (south[g] <= f["y1"] + 1)
        near &= np.any([(f["x0"] + k <= east[g] + 1) & (west[g] <= f["x1"] + k + 1) for k in (-360, 0, 360)], axis=0)
        f = {c: v[near] for c, v in f.items()} | {"first": at[g][near], "n": counts[g][near]}
        if not near.any():
            continue
        # One raster for each granule, fire and day; a granule is ten degrees a side unless it is seen from both sides of the globe.
        wide = (f["x1"] - f["x0"] + 2) * 10 + 4
        area = np.where(wide > 3400, np.minimum(wide, 10900), np.minimum(wide, 104)) * np.clip((f["y1"] - f["y0"] + 2) * 10 + 4, 3, 104)
        raster = _starts(f["granule"], f["fire"], f["later"])
        ends = np.append(raster[1:], len(area))
        for part in _parts(np.add.reduceat(f["n"] + np.maximum(area, 9), raster)):
            rows = slice(raster[part][0], ends[part][-1])
            of = np.repeat(np.arange(part.stop - part.start), (ends - raster)[part])
            yield from _rasters({c: v[rows] for c, v in f.items()}, p, of)


def _rasters(f: dict[str, np.ndarray], p: dict[str, np.ndarray], of: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rasters of boxes f, numbered by `of`; points p[first : first + n] are those of a box's granule, ordered by id."""
    low_x, high_x, low_y, high_y = f["x0"] - 1, f["x1"] + 1, f["y0"] - 1, f["y1"] + 1
    found = []
    for k in (-360.0, 0.0, 360.0):
        box = np.flatnonzero((high_x >= k - 180) & (low_x <= k + 180))
        fi = np.repeat(box, f["n"][box])
        pi = f["first"][fi] + _within(f["n"][box])
        y = p["y0"][pi]
        ok = (y >= low_y[fi]) & (y <= high_y[fi])
        fi, pi, y = fi[ok], pi[ok], y[ok]
        x = p["x0"][pi] + k
        ok = (x >= low_x[fi]) & (x <= high_x[fi])
        fi, pi = fi[ok], pi[ok]
        found.append((fi, pi, (y[ok] - f["y0"][fi]) * 10, (x[ok] - f["x0"][fi]) * 10))
    fi, pi, y, x = (np.concatenate(a) for a in zip(*found))
    if not len(fi):
        return
    used, ci = np.unique(of[fi], return_inverse=True)
    row, col = np.floor(y), np.floor(x)

    def span(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(len(used), np.inf), np.full(len(used), -np.inf)
        np.minimum.at(low, ci, v)
        np.maximum.at(high, ci, v)
        return low - 1, (high - low + 3).astype(np.int64)

    (top, height), (left, width) = span(row), span(col)
    size = height * width + (height * width & 1)
    base = np.cumsum(size) - size
    centre = base[ci] + (row - top[ci]).astype(np.int64) * width[ci] + (col - left[ci]).astype(np.int64)
    around = [(centre + i * width[ci] + j, np.sqrt(np.square(row + i + 0.5 - y) + np.square(col + j + 0.5 - x))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    least, who = np.full(size.sum(), np.inf), np.full(size.sum(), len(p["id"]))
    for cell, d in around:
        np.minimum.at(least, cell, d)
    for cell, d in around:
        hit = d == least[cell]
        np.minimum.at(who, cell[hit], pi[hit])
    cells = np.append(p["state"], 0).astype(np.uint8)[who]
    cells[centre[p["fire"][pi] == f["fire"][fi]]] |= OWN
    packed = cells[0::2] | cells[1::2] << 4
    one = np.searchsorted(of, used)
    said = [packed[a:b].tobytes() for a, b in zip(base // 2, (base + size) // 2)]
    days = [[s if day == k else None for s, day in zip(said, f["later"][one])] for k in (0, 1)]
    yield pd.DataFrame(dict(zip(_PLACED, (f["fire"][one], top.astype(np.int32), left.astype(np.int32), width.astype(np.int32), *days))))


def masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rasters of `placed`, sorted by fire, as (fire, n_cells, n_new, n_target, n_counted): of a cell counts the highest state that is said of it on a day."""
    for pdf in whole_keys(batches, "fire"):
        day = pdf["obs1"].notna().to_numpy().astype(int)
        said = pdf["obs0"].where(day == 0, pdf["obs1"]).to_numpy()
        fire, row, col, width = (pdf[c].to_numpy().astype(np.int64) for c in _PLACED[:4])
        length = 2 * np.array([len(s) for s in said])
        at = _starts(fire)
        ends = np.append(at[1:], len(fire))
        # A border of one cell, so that all cells have neighbours.
        top, left = np.minimum.reduceat(row, at) - 1, np.minimum.reduceat(col, at) - 1
        height, across = np.maximum.reduceat(row + length // width, at) - top + 1, np.maximum.reduceat(col + width, at) - left + 1
        for part in _parts(height * across + np.add.reduceat(length, at)):
            rows = slice(at[part][0], ends[part][-1])
            of = np.repeat(np.arange(part.stop - part.start), (ends - at)[part])
            stride, area = across[part], (height * across)[part]
            base = np.cumsum(area) - area
            raw = np.frombuffer(b"".join(said[rows]), np.uint8)
            cells = np.stack([raw & 15, raw >> 4], 1).ravel()
            ri, off = np.repeat(np.arange(len(of)), length[rows]), _within(length[rows])
            some = cells > 0
            cells, ri, off = cells[some], ri[some], off[some]
            r, c = np.divmod(off, width[rows][ri])
            fi = of[ri]
            pos = base[fi] + (r + row[rows][ri] - top[part][fi]) * stride[fi] + c + col[rows][ri] - left[part][fi]
            obs = np.zeros((2, area.sum()), np.uint8)
            for k in (0, 1):
                on = day[rows][ri] == k
                np.maximum.at(obs[k], pos[on], cells[on] & 3)
            own = np.zeros(area.sum(), bool)
            own[pos[cells >= OWN]] = True
            before, after = obs == FIRE
            new = after & ~before
            target = _reached(own, before | after, np.repeat(stride, area))
            counted = (obs >= CLEAR).all(0) & ~(new & ~target)
            sums = [np.add.reduceat(v, base, dtype=np.int64) for v in (obs.any(0), new, target, counted)]
            yield pd.DataFrame(dict(zip(("fire", "n_cells", "n_new", "n_target", "n_counted"), (fire[at[part]], *sums))))


def _reached(seeds: np.ndarray, open_: np.ndarray, stride: np.ndarray) -> np.ndarray:
    """Open cells that are linked to open seeds, rows being `stride` apart: each cell is walked to once."""
    front = np.flatnonzero(seeds & open_)
    done = np.zeros(len(seeds), bool)
    done[front] = True
    i, j = np.repeat([-1, 0, 1], 3), np.tile([-1, 0, 1], 3)
    while len(front):
        near = (front[:, None] + stride[front][:, None] * i + j).ravel()
        front = np.unique(near[open_[near] & ~done[near]])
        done[front] = True
    return done
