"""Range and nearest-neighbour joins in the plane.

Points and places are bucketed into square cells of side ``r``; each place is
copied to its 3 x 3 neighbourhood, so the join is an equi-join on the cell with
an exact residual. A dense cell is a skewed key, which AQE splits.

The copies are a cross join with a few numbers: Spark takes the size of a join for the product of its sides, but
that of an explode for its input's, and would send nine copies of a growing table through the driver as a broadcast.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.sources.shared import cut, merged


#: Cells of a level of the tree that are broadcast, of at most 16 smaller ones each; the lowest level, of stops, is not.
TOP_CELLS = 1 << 12


def dist2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared planar distance."""
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def _cell(v: Column, r: float) -> Column:
    return F.floor(v / F.lit(r))


def copies(df: DataFrame, n: int, number: str) -> DataFrame:
    """Each row ``n`` times, with its ``number`` from 0; the planner knows how many rows these are."""
    return df.crossJoin(F.broadcast(df.sparkSession.range(0, n, 1, 1).withColumnRenamed("id", number)))


def range_pairs(points: DataFrame, places: DataFrame, r: float, at: tuple[str, str] = ("px", "py"), to: tuple[str, str] = ("x", "y"), inclusive: bool = True) -> DataFrame:
    """All (point, place) with distance <= r (< r unless ``inclusive``), with ``d2``."""
    wide = copies(places, 9, "_k").withColumn("_cx", _cell(F.col(to[0]), r) + F.col("_k") % 3 - 1).withColumn("_cy", _cell(F.col(to[1]), r) + F.floor(F.col("_k") / 3) - 1).drop("_k")
    cells = points.withColumn("_cx", _cell(F.col(at[0]), r)).withColumn("_cy", _cell(F.col(at[1]), r))
    pairs = cells.join(merged(wide), ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("d2", dist2(F.col(at[0]), F.col(at[1]), F.col(to[0]), F.col(to[1])))
    return pairs.filter(F.col("d2") <= r * r if inclusive else F.col("d2") < r * r)


def nearby_stops(points: DataFrame, stops: DataFrame, r: float, key: str = "id", at: tuple[str, str] = ("px", "py")) -> DataFrame:
    """Stops within r of each point, in order of coordinates (x, then y) as ``ord``."""
    pairs = range_pairs(points, stops.select("idx", "x", "y"), r, at)
    return pairs.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("x", "y", "idx")))


def nearest(points: DataFrame, stops: DataFrame, key: str = "id", at: tuple[str, str] = ("px", "py"), first: float = 500.0) -> DataFrame:
    """(key, idx, d2) of each point's nearest stop, the least idx on ties.

    What is within ``first`` is nearest for sure; points that have no stop so near go down a tree of cells.
    Points and stops without finite coordinates are left out.
    """
    finite = lambda *names: [F.abs(F.col(c).cast("double")) < float("inf") for c in names]
    ok, placed = finite("x", "y"), finite(*at)
    places = stops.select("idx", "x", "y").filter(ok[0] & ok[1])
    extent = places.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).cast("double")).first()[0]
    if extent is None:
        return points.select(key).limit(0).withColumns({"idx": F.lit(None).cast("long"), "d2": F.lit(None).cast("double")})
    todo = cut(points.select(key, *at).filter(placed[0] & placed[1]))
    ring = range_pairs(todo, places, first, at).groupBy(key).agg(F.min_by("idx", F.struct("d2", "idx")).alias("idx"), F.min("d2").alias("d2"))
    todo = cut(todo.join(merged(ring.select(key)), key, "left_anti"))
    if todo.isEmpty():
        return ring
    return ring.unionByName(nearest_by_tree(todo, places, max(extent, first), key, at, first / 16))


def nearest_by_tree(points: DataFrame, places: DataFrame, extent: float, key: str, at: tuple[str, str], side: float) -> DataFrame:
    """``nearest`` through a tree of cells, each of four by four smaller ones, down to ``side``.

    A point first goes down to one stop, always into the cell whose occupied box is nearest; then into every cell whose
    box isn't farther than that stop. So it meets a few cells a level, however many stops are equally far.
    """
    px, py = F.col(at[0]), F.col(at[1])
    spots = places.groupBy("x", "y").agg(F.min("idx").alias("idx")).withColumns({"_cx": _cell(F.col("x"), side), "_cy": _cell(F.col("y"), side)})
    box = [f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in ((0, F.min), (1, F.max))]
    level = cut(spots.groupBy("_cx", "_cy").agg(*box, F.collect_list(F.struct("x", "y", "idx")).alias("inside")))
    levels = [level]
    node = F.collect_list(F.struct("_cx", "_cy", "x0", "x1", "y0", "y1")).alias("inside")
    around = [f(f"{c}{n}").alias(f"{c}{n}") for c in ("x", "y") for n, f in ((0, F.min), (1, F.max))]
    for _ in range(ceil(log(max(extent / side, 1), 4))):
        level = cut(level.groupBy(F.floor(F.col("_cx") / 4).alias("_cx"), F.floor(F.col("_cy") / 4).alias("_cy")).agg(*around, node))
        levels.append(level)
    root = cut(level.agg(node))
    off = lambda low, high, v: F.greatest(low - v, v - high, F.lit(0))
    gap = lambda c: off(c["x0"], c["x1"], px) * off(c["x0"], c["x1"], px) + off(c["y0"], c["y1"], py) * off(c["y0"], c["y1"], py)
    far = lambda s: dist2(px, py, s["x"], s["y"])
    # The top levels are few cells, which each have many points; the others join by merge.
    few = [k > 0 and level.count() <= TOP_CELLS for k, level in enumerate(levels)]
    inside = [(F.broadcast if top else merged)(level.select("_cx", "_cy", "inside")) for top, level in zip(reversed(few), reversed(levels), strict=True)]
    down = points.crossJoin(F.broadcast(root))
    for level in inside:
        best = F.array_min(F.transform("inside", lambda c: F.struct(gap(c).alias("gap"), c["_cx"].alias("_cx"), c["_cy"].alias("_cy"))))
        down = down.withColumn("_to", best).select(key, *at, F.col("_to._cx").alias("_cx"), F.col("_to._cy").alias("_cy")).join(level, ["_cx", "_cy"])
    bound = cut(down.select(key, *at, F.array_min(F.transform("inside", far)).alias("_most")))
    rows = bound.crossJoin(F.broadcast(root))
    for level in inside:
        rows = rows.select(key, *at, "_most", F.explode(F.filter("inside", lambda c: gap(c) <= F.col("_most"))).alias("_to"))
        rows = rows.select(key, *at, "_most", "_to._cx", "_to._cy").join(level, ["_cx", "_cy"])
    rows = rows.select(key, *at, F.explode(F.filter("inside", lambda s: far(s) <= F.col("_most"))).alias("_s")).select(key, F.col("_s.idx").alias("idx"), far(F.col("_s")).alias("d2"))
    return rows.groupBy(key).agg(F.min_by("idx", F.struct("d2", "idx")).alias("idx"), F.min("d2").alias("d2"))


def stops_or_nearest(points: DataFrame, stops: DataFrame, r: float, key: str = "id", at: tuple[str, str] = ("px", "py")) -> DataFrame:
    """(key, idx, ord): stops within r, or else the nearest one."""
    near = nearby_stops(points, stops, r, key, at).select(key, "idx", "ord")
    lone = cut(points.select(key, *at).join(merged(near.select(key)), key, "left_anti"))
    if lone.isEmpty():
        return near
    far = nearest(lone, stops, key, at, first=4 * r).select(key, "idx").withColumn("ord", F.lit(1))
    return near.unionByName(far)
