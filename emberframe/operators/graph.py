"""Connected components, of graphs and of cells in space and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import discard, materialize, shuffled


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of the undirected graph edges(u BIGINT, v BIGINT), component being the least node.

    Large-star and small-star steps alternate: in the first each node links its larger neighbours to the least node
    it sees, in the second its smaller ones, until every node hangs on its component's least. Each step is an
    algebraic minimum and one join, and the number of edges never grows. Rows with a null end are passed over;
    a loop (u, u) keeps a node that has no other edge.
    """
    e = edges.filter("u is not null and v is not null").select("u", "v")
    loops = e.filter("u = v").select(F.col("u").alias("node"))
    links = materialize(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(links)
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(low), "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.filter("u <> v").distinct())
        discard(links)
        links = after
        now = _mark(links)
        if now == before:
            roots = links.select(F.col("v").alias("node")).union(loops).distinct()
            hung = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return hung.union(roots.join(shuffled(hung), "node", "left_anti").select("node", F.col("node").alias("component")))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def cell_key(x: Column, y: Column, t: Column) -> Column:
    """A cell as one number that sorts by t, then y, then x (each at least -2**19 and below 2**20)."""
    off = 1 << 19
    return F.shiftleft((t + off).cast("bigint"), 42) + F.shiftleft((y + off).cast("bigint"), 21) + (x + off).cast("bigint")


def _blocks(cells: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    return cells.withColumns({f"b{c}": F.floor(F.col(c) / n).cast("int") for c, n in zip("xyt", size)})


def cell_links(cells: DataFrame, dx: int, dy: int, dt: int) -> DataFrame:
    """Edges (u, v) of block keys whose graph has the components of cells linked by |dx|, |dy|, |dt|.

    Cells of one block of (dx + 1) x (dy + 1) x (dt + 1) are all in reach of each other, so blocks are the
    nodes, and two neighbouring blocks are linked if any two of their cells are in reach: a dense cluster
    costs an edge or thirteen per block and not one per pair of cells. Every block also gets a loop.
    """
    b = materialize(_blocks(cells.select("x", "y", "t"), (dx + 1, dy + 1, dt + 1)))
    key = cell_key(F.col("bx"), F.col("by"), F.col("bt"))
    half = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (k, j, i) > (0, 0, 0)]
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in half]))
    a = b.withColumn("n", near).select(
        (F.col("bx") + F.col("n.i")).alias("bx"), (F.col("by") + F.col("n.j")).alias("by"), (F.col("bt") + F.col("n.k")).alias("bt"),
        F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("t").alias("t1"), key.alias("u"),
    )
    reach = (F.abs(F.col("x") - F.col("x1")) <= dx) & (F.abs(F.col("y") - F.col("y1")) <= dy) & (F.abs(F.col("t") - F.col("t1")) <= dt)
    pairs = a.join(shuffled(b), ["bx", "by", "bt"]).filter(reach).select("u", key.alias("v")).distinct()
    return pairs.union(b.select(key.alias("u"), key.alias("v")).distinct())


def label_cells(cells: DataFrame, dx: int = 2, dy: int = 2, dt: int = 7, name: str = "component") -> DataFrame:
    """Distinct cells(x, y, t) with the key of the least cell of their component; null coordinates are passed over."""
    return label_cells_by(cells, dx, dy, {name: dt})


def label_cells_by(cells: DataFrame, dx: int, dy: int, windows: dict[str, int]) -> DataFrame:
    """label_cells for up to two windows of time at once, name -> dt: one search for components over both graphs.

    The nodes of the second graph are negative, so the graphs share no node and their rounds are the same jobs.
    """
    if len(windows) > 2:
        raise ValueError("at most two windows")
    c = materialize(cells.select("x", "y", "t").filter("x is not null and y is not null and t is not null").distinct())
    node = lambda i, k: -1 - k if i else k
    sides = [cell_links(c, dx, dy, dt).select(node(i, F.col("u")).alias("u"), node(i, F.col("v")).alias("v")) for i, dt in enumerate(windows.values())]
    found = materialize(connected_components(sides[0] if len(sides) == 1 else sides[0].union(sides[1])))
    out = c
    for i, (name, dt) in enumerate(windows.items()):
        own = _blocks(c, (dx + 1, dy + 1, dt + 1)).withColumn("node", node(i, cell_key(F.col("bx"), F.col("by"), F.col("bt"))))
        by = materialize(own.join(shuffled(found), "node").select("x", "y", "t", "component"))
        least = by.groupBy(F.col("component").alias("root")).agg(F.min(cell_key(F.col("x"), F.col("y"), F.col("t"))).alias("least"))
        named = by.join(shuffled(least), by["component"] == least["root"]).select("x", "y", "t", F.col("least").alias(name))
        out = named if i == 0 else out.join(shuffled(named), ["x", "y", "t"])
    return out


def event_cells(cells: DataFrame, dx: int = 2, dy: int = 2, dt: int = 7) -> DataFrame:
    """cells with component, same_day (component within a day), predecessors, neighbours and ignition.

    predecessors counts earlier cells of the window, neighbours those of the same day. A same-day group
    is an ignition if none of its cells has a predecessor.
    """
    c = materialize(label_cells_by(cells, dx, dy, {"event": dt, "same_day": 0}))
    b = _blocks(c, (dx + 1, dy + 1, dt + 1))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0)]))
    a = b.withColumn("n", near).select(
        (F.col("bx") + F.col("n.i")).alias("bx"), (F.col("by") + F.col("n.j")).alias("by"), (F.col("bt") + F.col("n.k")).alias("bt"),
        F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("t").alias("t1"),
    )
    gap = F.col("t1") - F.col("t")
    seen = a.join(shuffled(b.select("bx", "by", "bt", "x", "y", "t")), ["bx", "by", "bt"]).filter(
        (F.abs(F.col("x") - F.col("x1")) <= dx) & (F.abs(F.col("y") - F.col("y1")) <= dy) & gap.between(0, dt)
        & ~((gap == 0) & (F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1")))
    )
    counts = seen.groupBy(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("t1").alias("t")).agg(
        F.count(F.when(gap > 0, 1)).alias("predecessors"), F.count(F.when(gap == 0, 1)).alias("neighbours")
    )
    full = c.join(shuffled(counts), ["x", "y", "t"], "left").fillna(0, ["predecessors", "neighbours"])
    full = materialize(full)
    fresh = full.groupBy("same_day").agg((F.max("predecessors") == 0).alias("ignition"))
    return full.join(shuffled(fresh), "same_day").select(
        "x", "y", "t", F.col("event").alias("component"), "same_day", "predecessors", "neighbours", "ignition"
    )


def event_stats(labelled: DataFrame) -> DataFrame:
    """One row per component of event_cells: size, box, days, mean neighbours, ignitions and the ratio of its sides."""
    s = labelled.groupBy("component").agg(
        F.count(F.lit(1)).alias("num_cells"),
        *[f(c).alias(f"{n}_{c}") for c in "xyt" for n, f in (("min", F.min), ("max", F.max))],
        F.avg("neighbours").alias("avg_xy_neighbors"),
        F.countDistinct(F.when(F.col("ignition"), F.col("same_day"))).alias("ignitions"),
    )
    area = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    return s.withColumns(
        {
            "ignition_ratio": F.col("ignitions") / F.col("num_cells"),
            "t_ratio": (F.col("max_t") - F.col("min_t") + 1) / F.sqrt(area),
        }
    )
