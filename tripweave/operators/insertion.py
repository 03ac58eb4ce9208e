"""One insertion step of a request into a ride, as joins: all four cases.

A ride is rows (ride, side, pos, stop) with side U (pickups) then D (dropoffs).
A request has candidate stops (ride, req, role, idx, ord). Costs are leg costs
with dwell, where staying at one stop counts as forbidden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.operators.routes import leg_cost
from tripweave.operators.sequences import by, with_travel, with_travels


def _leg(df: DataFrame, travel, a: str, b: str, out: str, dwell: int) -> DataFrame:
    return with_travel(df, travel, a, b, "_ms").withColumn(out, leg_cost(F.col(a), F.col(b), F.col("_ms"), dwell)).drop("_ms")


def _legs(df: DataFrame, travel, dwell: int, *pairs: tuple[str, str, str]) -> DataFrame:
    df = with_travels(df, travel, list(pairs))
    return df.withColumns({out: leg_cost(F.col(a), F.col(b), F.col(out), dwell) for a, b, out in pairs})


def ride_ends(rides: DataFrame, travel, dwell: int) -> DataFrame:
    """Per ride: first and last stops p1, pm, d1, dn, the whole cost ``now``, the extra over direct ``det`` and the middle leg ``gap``."""
    order = ["side_no", "pos"]
    rows = rides.withColumn("side_no", F.when(F.col("side") == "U", 0).otherwise(1))
    nxt = rows.withColumn("nxt", F.lead("stop").over(by("ride", order))).filter("nxt IS NOT NULL")
    now = _leg(nxt, travel, "stop", "nxt", "c", dwell).groupBy("ride").agg(F.sum("c").alias("now"))
    up, down = F.col("side") == "U", F.col("side") == "D"
    ends = rows.groupBy("ride").agg(
        F.min_by("stop", F.when(up, F.col("pos"))).alias("p1"), F.max_by("stop", F.when(up, F.col("pos"))).alias("pm"),
        F.min_by("stop", F.when(down, F.col("pos"))).alias("d1"), F.max_by("stop", F.when(down, F.col("pos"))).alias("dn"),
    )
    out = _leg(_leg(ends.join(now, "ride"), travel, "p1", "dn", "base", dwell), travel, "pm", "d1", "gap", dwell)
    return out.withColumn("det", F.col("now") - F.col("base"))


def matched(rides: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ride, req, up, down): the first stop of each side that is among the request's candidates, else null."""
    hits = rides.join(wanted.select("ride", "req", "role", F.col("idx").alias("stop")), ["ride", "stop"])
    side = lambda s, r: F.min_by("stop", F.when((F.col("side") == s) & (F.col("role") == r), F.col("pos")))
    return hits.groupBy("ride", "req").agg(side("U", "S").alias("up"), side("D", "E").alias("down"))


def interior(rides: DataFrame, wanted: DataFrame, travel, side: str, role: str, dwell: int) -> DataFrame:
    """(ride, req, idx, ord, pos, change): a stop between two of one side."""
    rows = rides.filter(F.col("side") == side).withColumn("b", F.lead("stop").over(by("ride", "pos"))).filter("b IS NOT NULL").withColumnRenamed("stop", "a")
    rows = rows.join(wanted.filter(F.col("role") == role).select("ride", "req", "idx", "ord"), "ride")
    rows = _legs(rows, travel, dwell, ("a", "idx", "ac"), ("idx", "b", "cb"), ("a", "b", "ab"))
    return rows.select("ride", "req", "idx", "ord", "pos", (F.col("ac") + F.col("cb") - F.col("ab")).alias("change"))


def insertion_step(rides: DataFrame, wanted: DataFrame, travel, budget: float, dwell: int) -> DataFrame:
    """(ride, req, case, detour, way, up, down): the best way to take each request, null detour in case match; none if over budget.

    Ways tie in the order front, back, interior for one new stop, and interior before corners for two.
    """
    ends = ride_ends(rides, travel, dwell)
    asked = wanted.select("ride", "req").distinct().join(matched(rides, wanted), ["ride", "req"], "left").join(ends, "ride")
    case = F.when(F.col("up").isNotNull() & F.col("down").isNotNull(), "match").when(F.col("down").isNotNull(), "pickup").when(F.col("up").isNotNull(), "dropoff").otherwise("both")
    asked = asked.withColumn("case", case)
    both_sides = rides.groupBy("ride", "side").agg(F.collect_set("stop").alias("s"))
    ups = both_sides.filter("side = 'U'").select("ride", F.col("s").alias("in_up"))
    downs = both_sides.filter("side = 'D'").select("ride", F.col("s").alias("in_down"))
    stops = wanted.select("ride", "req", "role", "idx", "ord")

    def legs(df: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
        return _legs(df, travel, dwell, *pairs)

    def way(df: DataFrame, no: int, cost: Column, up: Column, down: Column, pos: Column | int = 0) -> DataFrame:
        rank = F.struct(cost.alias("cost"), F.lit(no).alias("no"), F.col("ord").alias("ord"), (F.lit(pos) if isinstance(pos, int) else pos).alias("pos"))
        return df.select("ride", "req", "case", rank.alias("rank"), up.cast("long").alias("up"), down.cast("long").alias("down"))

    # One new pickup: in front, behind the last pickup, or between two.
    s = asked.filter("case = 'pickup'").join(stops.filter("role = 'S'"), ["ride", "req"]).join(downs, "ride").filter("NOT array_contains(in_down, idx)")
    s = legs(s, ("idx", "p1", "s_p1"), ("idx", "dn", "s_dn"), ("pm", "idx", "pm_s"), ("idx", "d1", "s_d1"))
    ways = way(s, 0, F.col("now") + F.col("s_p1") - F.col("s_dn"), F.col("idx"), F.col("down"))
    ways = ways.union(way(s, 1, F.col("det") + F.col("pm_s") + F.col("s_d1") - F.col("gap"), F.col("idx"), F.col("down")))
    inner_up = interior(rides, wanted, travel, "U", "S", dwell)
    free = asked.filter("case = 'pickup'").join(inner_up, ["ride", "req"]).join(downs, "ride").filter("NOT array_contains(in_down, idx)")
    ways = ways.union(way(free, 2, F.col("det") + F.col("change"), F.col("idx"), F.col("down"), F.col("pos")))
    # One new dropoff: in front of the first dropoff, at the end, or between two.
    e = asked.filter("case = 'dropoff'").join(stops.filter("role = 'E'"), ["ride", "req"]).join(ups, "ride").filter("NOT array_contains(in_up, idx)")
    e = legs(e, ("pm", "idx", "pm_e"), ("idx", "d1", "e_d1"), ("dn", "idx", "dn_e"), ("p1", "idx", "p1_e"))
    ways = ways.union(way(e, 0, F.col("det") + F.col("pm_e") + F.col("e_d1") - F.col("gap"), F.col("up"), F.col("idx")))
    ways = ways.union(way(e, 1, F.col("now") + F.col("dn_e") - F.col("p1_e"), F.col("up"), F.col("idx")))
    inner_down = interior(rides, wanted, travel, "D", "E", dwell)
    free = asked.filter("case = 'dropoff'").join(inner_down, ["ride", "req"]).join(ups, "ride").filter("NOT array_contains(in_up, idx)")
    ways = ways.union(way(free, 2, F.col("det") + F.col("change"), F.col("up"), F.col("idx"), F.col("pos")))
    # Two new stops: the best of each side between two, or one of four corners.
    best = lambda df, n: df.groupBy("ride", "req").agg(F.min(F.struct("change", "ord", "pos", "idx")).alias(n))
    pair = asked.filter("case = 'both'").join(best(inner_up, "u"), ["ride", "req"]).join(best(inner_down, "d"), ["ride", "req"]).withColumn("ord", F.lit(0))
    ways = ways.union(way(pair, 0, F.col("det") + F.col("u.change") + F.col("d.change"), F.col("u.idx"), F.col("d.idx")))
    c = asked.filter("case = 'both'").drop("up", "down").join(stops.filter("role = 'S'").select("ride", "req", F.col("idx").alias("s"), F.col("ord").alias("s_ord")), ["ride", "req"])
    c = c.join(stops.filter("role = 'E'").select("ride", "req", F.col("idx").alias("e"), F.col("ord").alias("e_ord")), ["ride", "req"]).join(ups, "ride").join(downs, "ride")
    c = c.filter("s <> e AND NOT array_contains(in_up, e) AND NOT array_contains(in_down, s)").withColumn("ord", F.col("s_ord") * 10_000 + F.col("e_ord"))
    c = legs(c, ("s", "p1", "s_p1"), ("pm", "e", "pm_e"), ("e", "d1", "e_d1"), ("s", "dn", "s_dn"), ("dn", "e", "dn_e"), ("s", "e", "s_e"), ("pm", "s", "pm_s"), ("s", "d1", "s_d1"), ("p1", "e", "p1_e"))
    v = {n: F.col(n) for n in ("now", "det", "gap", "s_p1", "pm_e", "e_d1", "s_dn", "dn_e", "s_e", "pm_s", "s_d1", "p1_e")}
    corners = (
        v["now"] + v["s_p1"] + v["pm_e"] + v["e_d1"] - v["gap"] - v["s_dn"],
        v["now"] + v["s_p1"] + v["dn_e"] - v["s_e"],
        v["det"] + v["pm_s"] + v["s_e"] + v["e_d1"] - v["gap"],
        v["now"] + v["pm_s"] + v["s_d1"] - v["gap"] + v["dn_e"] - v["p1_e"],
    )
    for n, cost in enumerate(corners, 1):
        ways = ways.union(way(c, n, cost, F.col("s"), F.col("e")))
    first = Window.partitionBy("ride", "req").orderBy("rank")
    chosen = ways.filter(F.col("rank.cost") <= budget).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    chosen = chosen.select("ride", "req", "case", F.col("rank.cost").alias("detour"), F.col("rank.no").alias("way"), "up", "down")
    same = asked.filter("case = 'match'").select("ride", "req", "case", F.lit(None).cast("double").alias("detour"), F.lit(0).alias("way"), F.col("up").cast("long").alias("up"), F.col("down").cast("long").alias("down"))
    return chosen.unionByName(same)
