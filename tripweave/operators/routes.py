"""Operators on routes as rows: costs, insertion, fulfilment, scores, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.operators.sequences import by, neighbours, with_travel, with_travels

SAME_STOP_COST = 1e9


def leg_cost(a: Column, b: Column, ms: Column, dwell: int) -> Column:
    """Cost of a leg in an insertion search: staying at one stop is as good as forbidden."""
    return F.when(a == b, F.lit(SAME_STOP_COST)).otherwise(ms + dwell)


def leg_time(a: Column, b: Column, ms: Column, dwell: int) -> Column:
    """Travel time of a leg: staying costs nothing."""
    return F.when(a == b, F.lit(0)).otherwise(ms + dwell)


def path_legs(path: DataFrame, travel, part: str = "service", order: str = "pos", stop: str = "stop") -> DataFrame:
    """Each row with ``next_`` stop and ``leg`` time to it (null at the end)."""
    nxt = path.withColumn(f"next_{stop}", F.lead(stop).over(by(part, order)))
    legs = with_travel(nxt, travel, stop, f"next_{stop}", "leg")
    return legs.withColumn("leg", F.when(F.col(f"next_{stop}").isNotNull(), F.col("leg")))


def removal_saving(path: DataFrame, travel, part: str = "service", order: str = "pos", reversed_next: bool = True) -> DataFrame:
    """Inner stops with ``saving``: d(p, c) + d(n, c) - d(p, n), the second leg in reverse direction by default."""
    rows = neighbours(path, part, order, "stop").filter("prev_stop IS NOT NULL AND next_stop IS NOT NULL")
    rows = with_travels(rows, travel, [("prev_stop", "stop", "pc"), (*(("next_stop", "stop") if reversed_next else ("stop", "next_stop")), "nc"), ("prev_stop", "next_stop", "pn")])
    return rows.withColumn("saving", F.col("pc") + F.col("nc") - F.col("pn"))


def insertion_detours(path: DataFrame, requests: DataFrame, travel, dwell: int, part: str = "service") -> DataFrame:
    """Every gap of a path with every wanted stop: ``detour`` = cost(a, c) + cost(c, b) - cost(a, b).

    ``path``: (part, pos, stop); ``requests``: (part, req, idx).
    """
    gaps = path.withColumn("b", F.lead("stop").over(by(part, "pos"))).withColumnRenamed("stop", "a").filter("b IS NOT NULL")
    rows = gaps.join(requests, part)
    rows = with_travels(rows, travel, [("a", "idx", "ac"), ("idx", "b", "cb"), ("a", "b", "ab")])
    cost = lambda a, b, ms: leg_cost(F.col(a), F.col(b), F.col(ms), dwell)
    return rows.withColumn("detour", cost("a", "idx", "ac") + cost("idx", "b", "cb") - cost("a", "b", "ab"))


def best_insertion(detours: DataFrame, keys: list[str]) -> DataFrame:
    """The cheapest gap and stop of each key; ties to the first gap, then the least stop."""
    order = F.struct("detour", "pos", "idx")
    best = detours.groupBy(*keys).agg(F.min(order).alias("best"))
    return best.select(*keys, F.col("best.detour").alias("detour"), F.col("best.pos").alias("pos"), F.col("best.idx").alias("idx"))


def with_costs(rows: DataFrame, travel, dwell: int, *pairs: str) -> DataFrame:
    """Adds for each pair "ab" of column names the column ``ab``: the leg time with dwell, nothing for staying."""
    rows = with_travels(rows, travel, [(a, b, f"{a}{b}") for a, b in pairs])
    return rows.withColumns({f"{a}{b}": leg_time(F.col(a), F.col(b), F.col(f"{a}{b}"), dwell) for a, b in pairs})


def stop_detour(a: str, c: str, b: str) -> Column:
    """Extra time of passing c on the way from a to b, from the columns of ``with_costs``."""
    return F.col(f"{a}{c}") + F.col(f"{c}{b}") - F.col(f"{a}{b}")


def od_detour(a: str, b: str, c: str, d: str) -> Column:
    """Least extra time of two trips (a, b) and (c, d) sharing a ride, from the columns of ``with_costs``.

    One trip lies within the other, or they overlap; then the longer of the two detours counts.
    """
    leg = lambda x, y: F.col(f"{x}{y}")
    within = leg(a, c) + leg(c, d) + leg(d, b) - leg(a, b)
    around = leg(c, a) + leg(a, b) + leg(b, d) - leg(c, d)
    first = F.greatest(stop_detour(a, c, b), stop_detour(c, b, d))
    second = F.greatest(stop_detour(c, a, d), stop_detour(a, d, b))
    return F.least(within, around, first, second)


def fulfilment(acts: DataFrame, part: str = "service") -> DataFrame:
    """Per request: pickup and dropoff place on the route and the time between their latest times."""
    pick, drop = F.col("kind") == "pickup", F.col("kind") == "dropoff"
    g = acts.groupBy(part, "req").agg(
        F.max(F.when(pick, F.col("pos"))).alias("pickup_pos"), F.max(F.when(drop, F.col("pos"))).alias("dropoff_pos"),
        F.max(F.when(pick, F.col("latest"))).alias("_p"), F.max(F.when(drop, F.col("latest"))).alias("_d"),
    )
    return g.withColumn("ride_ms", F.col("_d") - F.col("_p")).drop("_p", "_d")


def route_score(counts: DataFrame) -> DataFrame:
    """Sum of (activities / 2 - 1) over the half of the routes with most activities. ``counts``: (route, n).

    The rank is over all routes; it is taken from a histogram of n, which has few rows.
    """
    histogram = counts.groupBy("n").agg(F.count("*").alias("k"))
    above = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("k").over(Window.partitionBy())
    take = F.greatest(F.lit(0), F.least(F.col("k"), F.floor(total / 2) - above))
    return histogram.select(F.col("n"), take.alias("take")).agg(F.coalesce(F.sum(F.col("take") * (F.col("n") / 2 - 1)), F.lit(0.0)).alias("score"))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets; null if one is empty (never similar)."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def alternative_stops(acts: DataFrame, wanted: DataFrame, part: str = "service") -> DataFrame:
    """(part, req, kind, alternative): other stops of the route at which a request could be served.

    A pickup may move to a start stop of its request before the dropoff, a dropoff to an end stop
    after the pickup. ``wanted``: (part, req, role, idx).
    """
    side = lambda kind: acts.filter(F.col("kind") == kind)
    stops = acts.select(part, F.col("pos").alias("at"), F.col("stop").alias("alternative"))
    out = None
    for kind, other, role, fits in (("pickup", "dropoff", "S", "at < until"), ("dropoff", "pickup", "E", "at > until")):
        own = side(kind).select(part, "req", F.col("stop").alias("own"))
        rows = own.join(side(other).select(part, "req", F.col("pos").alias("until")), [part, "req"]).join(stops, part).filter(fits).filter("alternative <> own")
        rows = rows.join(wanted.filter(F.col("role") == role).select(part, "req", F.col("idx").alias("alternative")), [part, "req", "alternative"], "left_semi")
        rows = rows.select(part, "req", F.lit(kind).alias("kind"), "alternative").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def similar_routes(sets: DataFrame, limit: float, key: str = "service", item: str = "stop") -> DataFrame:
    """(a, b, share): pairs a < b whose overlap coefficient exceeds ``limit``. ``sets``: distinct (key, item).

    Prefix filter: items are ordered by how rare they are; if two sets share more than ``limit`` of the
    smaller, which has n items, they share one of the smaller set's first n - floor(limit * n) items. Only
    those meet the other sets, so frequent items rarely do.
    """
    often = sets.groupBy(item).agg(F.count("*").alias("_often"))
    rows = sets.join(often, item)
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_often", F.col(item).alias("i")))), lambda s: s["i"]).alias("items"))
    lists = lists.withColumn("n", F.size("items"))
    small = lists.select(F.col(key).alias("s"), F.col("n").alias("sn"), F.col("items").alias("sl"), F.explode(F.slice("items", F.lit(1), (F.col("n") - F.floor(F.col("n") * limit)).cast("int"))).alias("i"))
    large = lists.select(F.col(key).alias("l"), F.col("n").alias("ln"), F.col("items").alias("ll"), F.explode("items").alias("i"))
    met = small.join(large, "i").filter("s <> l AND (sn < ln OR sn = ln AND s < l)")
    # Of the items that both share in the prefix only the first one reports the pair.
    first = F.array_intersect("sl", "ll")
    met = met.withColumn("both", first).filter(F.col("i") == F.col("both")[0])
    share = F.size("both") / F.col("sn")
    return met.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), share.alias("share")).filter(F.col("share") > limit)


def first_of_equal(routes: DataFrame, stops: str = "stops", key: str = "service") -> DataFrame:
    """Of routes with one list of stops the least key stays."""
    return routes.groupBy(stops).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def replacement_delta(rows: DataFrame, travel, new: str) -> DataFrame:
    """Adds ``delta``: the change of length when ``new`` takes the place of ``stop`` between ``prev_stop`` and ``next_stop``."""
    rows = with_travels(rows, travel, [("prev_stop", new, "_pc"), (new, "next_stop", "_cn"), ("prev_stop", "stop", "_po"), ("stop", "next_stop", "_on")])
    return rows.withColumn("delta", F.col("_pc") + F.col("_cn") - F.col("_po") - F.col("_on")).drop("_pc", "_cn", "_po", "_on")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Uniform random order by a seeded hash of the rows, repeatable."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns)
