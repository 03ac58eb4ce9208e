"""Grid cells and distance clusters of points."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.sources.shared import cut


def key(v: Column, g: float) -> Column:
    """Nearest grid line; halves round up (not away from zero)."""
    return F.floor(v / F.lit(g) + 0.5)


def centre(k: Column, g: float) -> Column:
    return k * F.lit(g)


def cells(points: DataFrame, g: float) -> DataFrame:
    """(u, v, n): distinct points of each cell. ``points``: (x, y, payload)."""
    return points.withColumns({"u": key(F.col("x"), g), "v": key(F.col("y"), g)}).groupBy("u", "v").agg(F.count_distinct("x", "y", "payload").alias("n"))


def neighbours(c: DataFrame, r: float, g: float) -> DataFrame:
    """(u, v, n, nu, nv, nn): pairs of cells whose centres lie within r, found through coarse cells."""
    reach = max(1, floor(r / g))
    coarse = lambda k: F.floor(F.col(k) / reach)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    wide = c.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("n").alias("nn")).withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near))
    wide = wide.withColumns({"_a": coarse("nu") + F.col("_i"), "_b": coarse("nv") + F.col("_j")}).drop("_i", "_j")
    pairs = c.withColumns({"_a": coarse("u"), "_b": coarse("v")}).join(wide, ["_a", "_b"]).drop("_a", "_b")
    du, dv = F.col("u") - F.col("nu"), F.col("v") - F.col("nv")
    return pairs.filter((du * du + dv * dv) * (g * g) <= r * r)


def scores(c: DataFrame, r: float, g: float) -> DataFrame:
    """(u, v, score): points in the cells within reach of each cell."""
    return neighbours(c, r, g).groupBy("u", "v").agg(F.sum("nn").alias("score"))


def cluster(points: DataFrame, r: float, g: float) -> DataFrame:
    """Points with the centre (cx, cy) of their cluster.

    The greedy rule takes the open cell of the greatest (score, u, v) with all open cells in
    reach. Rounds of local dominance give the same: a cell that is the greatest within twice the
    reach is taken in this round whatever happens elsewhere, for counts only fall.
    """
    rows = points.dropDuplicates(["x", "y", "payload"]).withColumns({"u": key(F.col("x"), g), "v": key(F.col("y"), g)})
    open_ = cut(rows.groupBy("u", "v").agg(F.count("*").alias("n")))
    taken = None
    while not open_.isEmpty():
        ranked = cut(scores(open_, r, g).join(open_, ["u", "v"]))
        rival = F.struct("score", "u", "v")
        far = neighbours(ranked.select("u", "v", "n"), 2 * r, g).join(ranked.select(F.col("u").alias("nu"), F.col("v").alias("nv"), rival.alias("rival")), ["nu", "nv"])
        best = far.groupBy("u", "v").agg(F.max("rival").alias("top")).filter((F.col("top.u") == F.col("u")) & (F.col("top.v") == F.col("v")))
        got = neighbours(open_, r, g).join(best.select("u", "v"), ["u", "v"]).select(F.col("nu").alias("u"), F.col("nv").alias("v"), centre(F.col("u"), g).alias("cx"), centre(F.col("v"), g).alias("cy"))
        got = cut(got)
        taken = got if taken is None else taken.union(got)
        open_ = cut(open_.join(got, ["u", "v"], "left_anti"))
    if taken is None:
        return rows.withColumns({"cx": F.lit(None).cast("double"), "cy": F.lit(None).cast("double")}).drop("u", "v")
    return rows.join(taken, ["u", "v"]).drop("u", "v")
