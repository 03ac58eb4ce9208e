"""Suggestions: scans, similarity, candidate stops, compatibility, service by a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.operators.routes import stop_detour, with_costs
from tripweave.operators.sequences import uniq_by, with_travel
from tripweave.operators.spatial import copies, dist2, range_pairs, stops_or_nearest
from tripweave.settings import RETRIGGER_MS, Settings
from tripweave.sources.shared import cut, merged


def distinct_trips(df: DataFrame) -> DataFrame:
    """One suggestion for each trip and rider; the least id stays."""
    return uniq_by(df, ["sx", "sy", "ex", "ey", "time_ms", "email"], ["id"])


def similar_to(df: DataFrame, seed: dict, s: Settings) -> DataFrame:
    """Suggestions near a seed trip in start, end, time and days; all predicates reach the scan's filter."""
    known = F.lit(s.include_anonymous) | F.col("user_id").isNotNull() | F.col("email").isNotNull()
    days = F.lit(not s.match_days) | (F.col("days_mask").bitwiseAND(F.lit(seed["days_mask"])) > 0)
    start = dist2(F.col("sx"), F.col("sy"), F.lit(seed["sx"]), F.lit(seed["sy"])) < s.start_cluster_radius**2
    end = dist2(F.col("ex"), F.col("ey"), F.lit(seed["ex"]), F.lit(seed["ey"])) < s.end_cluster_radius**2
    hits = df.filter(known & (F.col("created_ms") > s.created_since) & (F.abs(F.col("time_ms") - seed["time_ms"]) <= s.time_allowance) & days & start & end)
    return distinct_trips(hits)


def near_places(seeds: DataFrame, df: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, rows, near): seeds and rows with their places, and the pairs of places that are near in ends and time.

    An equi-join on the cell of the start, the cell of the end and the time slot. Cells are twice as wide as
    the radius, so a seed reaches into two of each kind; the exact predicates follow. Seeds and rows of the same
    ends and time meet once, as places, named by their least id. ``points``: (id, ends and time, days_mask, _seed_place);
    ``rows``: (id, ends and time, days_mask, _trip, _place), where a trip is one of a rider; ``near``: (_seed_place, _place).
    """
    known = F.lit(s.include_anonymous) | F.col("user_id").isNotNull() | F.col("email").isNotNull()
    reach = reaches(s)
    place = lambda df, name: df.withColumn(name, F.min("id").over(Window.partitionBy(*reach)))
    rows = df.filter(known & (F.col("created_ms") > s.created_since)).withColumn("_trip", F.min("id").over(Window.partitionBy(*reach, "email")))
    rows = cut(place(rows.select("id", *reach, "days_mask", "_trip"), "_place"))
    points = cut(place(seeds.select("id", *reach, "days_mask"), "_seed_place"))
    return points, rows, place_pairs(points.filter("id = _seed_place"), rows.filter("id = _place"), s)


def reaches(s: Settings) -> dict[str, int]:
    return {"sx": s.start_cluster_radius, "sy": s.start_cluster_radius, "ex": s.end_cluster_radius, "ey": s.end_cluster_radius, "time_ms": max(s.time_allowance, 1)}


def place_pairs(seeds: DataFrame, places: DataFrame, s: Settings) -> DataFrame:
    """(_seed_place, _place) near in ends and time, of tables of places."""
    reach = reaches(s)
    keys = [f"_{c}" for c in reach]
    cell = lambda c, shift: F.floor((F.col(c) + shift) / (2 * reach[c]))
    two = copies(seeds.select("_seed_place", *[F.col(c).alias(f"seed_{c}") for c in reach]), 2 ** len(reach), "_k")
    for k, (c, r) in enumerate(reach.items()):
        two = two.withColumn(f"_{c}", F.floor((F.col(f"seed_{c}") - r) / (2 * r)) + F.shiftright("_k", k) % 2)
    places = places.select("_place", *reach, *[cell(c, 0).alias(f"_{c}") for c in reach])
    start = dist2(F.col("sx"), F.col("sy"), F.col("seed_sx"), F.col("seed_sy")) < s.start_cluster_radius**2
    end = dist2(F.col("ex"), F.col("ey"), F.col("seed_ex"), F.col("seed_ey")) < s.end_cluster_radius**2
    near = two.join(merged(places), keys).filter((F.abs(F.col("time_ms") - F.col("seed_time_ms")) <= s.time_allowance) & start & end)
    return near.select("_seed_place", "_place")


def riders_of_places(df: DataFrame, s: Settings) -> DataFrame:
    """(_place, ends and time, ids, days, trips, weights): the riders of each place, whose name is the least id. A trip is one of a rider; one shuffle."""
    reach = reaches(s)
    known = F.lit(s.include_anonymous) | F.col("user_id").isNotNull() | F.col("email").isNotNull()
    rows = df.filter(known & (F.col("created_ms") > s.created_since)).select("id", *reach, "days_mask", "email", "weight").repartition(*reach)
    rows = rows.withColumn("_trip", F.min("id").over(Window.partitionBy(*reach, "email")))
    rider = F.struct("id", F.col("days_mask").alias("days"), F.col("_trip").alias("trip"), F.col("weight").cast("double").alias("weight"))
    lists = rows.groupBy(*reach).agg(F.min("id").alias("_place"), F.collect_list(rider).alias("r"))  # of one place
    return lists.select("_place", *reach, F.col("r.id").alias("ids"), F.col("r.days").alias("days"), F.col("r.trip").alias("trips"), F.col("r.weight").alias("weights"))


def similar_pairs(seeds: DataFrame, df: DataFrame, s: Settings) -> DataFrame:
    """(seed_id, id): as ``similar_to`` for a table of seeds. Riders join their places; of equal trips the least id stays."""
    points, rows, near = near_places(seeds, df, s)
    hits = near.join(merged(points.select("_seed_place", F.col("id").alias("seed_id"), F.col("days_mask").alias("seed_days_mask"))), "_seed_place")
    hits = hits.join(merged(rows.select("_place", "id", "days_mask", "_trip")), "_place")
    days = F.lit(not s.match_days) | (F.col("days_mask").bitwiseAND(F.col("seed_days_mask")) > 0)
    return hits.filter(days).groupBy("seed_id", "_trip").agg(F.min("id").alias("id")).select("seed_id", "id")


def mark_triggered(df: DataFrame, ids: DataFrame, now_ms: int, column: str = "last_trigger_ms") -> DataFrame:
    """The table with ``column`` set to now for the given ids."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, "id", "left").withColumn(column, F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col(column))).drop("_hit")


def trigger_verdict(found: Column, owner: Column, caller: Column, last_ms: Column, now_ms: Column) -> Column:
    """Errors as values: not_found, user_not_authorized, too_many_requests or ok."""
    return (
        F.when(~found, "not_found").when(~owner.eqNullSafe(caller), "user_not_authorized").when(last_ms.isNotNull() & (now_ms - last_ms < RETRIGGER_MS), "too_many_requests").otherwise("ok")
    )


def candidate_stops(df: DataFrame, stops: DataFrame, s: Settings) -> DataFrame:
    """(id, role, idx, ord): stops a rider can walk to at start (S) and end (E), else the nearest."""
    start = stops_or_nearest(df.select("id", F.col("sx").alias("px"), F.col("sy").alias("py")), stops, s.start_walking_distance)
    end = stops_or_nearest(df.select("id", F.col("ex").alias("px"), F.col("ey").alias("py")), stops, s.end_walking_distance)
    return start.withColumn("role", F.lit("S")).unionByName(end.withColumn("role", F.lit("E")))


def od_pairs(candidates: DataFrame, distinct_ends: bool = True) -> DataFrame:
    """(id, o, d, o_ord, d_ord): origin and destination stops of each rider, distinct ends unless told otherwise."""
    o = candidates.filter("role = 'S'").select("id", F.col("idx").alias("o"), F.col("ord").alias("o_ord"))
    d = candidates.filter("role = 'E'").select("id", F.col("idx").alias("d"), F.col("ord").alias("d_ord"))
    pairs = o.join(merged(d), "id")
    return pairs.filter("o <> d") if distinct_ends else pairs


def compatible(travel, candidates: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """The ``pairs`` (id, other) for which one origin and destination of ``id`` takes a start and an end stop of ``other`` within the detour budget.

    A stop c fits (o, d) if c on the way from o to d, or d on the way from o to c, or d on the way from c
    to o costs less than the budget. Each (id, o, d, c) is tested once, however many others stop at c, and
    all that follows the join by id stays in its partition.
    """
    ids = pairs.select("id").distinct()
    ods = od_pairs(candidates.join(merged(ids), "id", "left_semi"), distinct_ends=False).select("id", "o", "d")
    ods = with_costs(ods, travel, s.dwell, "od", "do")
    who = F.collect_list(F.struct("other", "role")).alias("who")  # of one rider's neighbourhood
    pool = pairs.join(merged(candidates.select(F.col("id").alias("other"), "role", F.col("idx").alias("c"))), "other").groupBy("id", "c").agg(who)
    tests = with_costs(ods.join(merged(pool), "id"), travel, s.dwell, "oc", "cd", "dc", "co")
    fits = F.least(stop_detour("o", "c", "d"), stop_detour("o", "d", "c"), stop_detour("c", "d", "o")) < s.budget
    near = tests.filter(fits).select("id", "o", "d", F.inline("who"))
    both = near.groupBy("id", "o", "d", "other").agg(F.max(F.col("role") == "S").alias("s"), F.max(F.col("role") == "E").alias("e")).filter("s AND e")
    return both.select("id", "other").distinct()


def top_ods(travel, ods: DataFrame, s: Settings) -> DataFrame:
    """(id, o, d, ms, rank): the fastest pairs of each rider, those close to the best only."""
    w = Window.partitionBy("id").orderBy("ms", "o_ord", "d_ord")
    ranked = with_travel(ods, travel, "o", "d", "ms").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= s.top_ods)
    best = F.min("ms").over(Window.partitionBy("id"))
    return ranked.withColumn("best", best).filter(F.col("ms") - F.col("best") < s.suboptimal_allowance).select("id", "o", "d", "ms", "rank")


def served_by(path: DataFrame, riders: DataFrame, r: float) -> DataFrame:
    """(path_id, id, board, alight): riders whose first reachable stop comes before their last.

    ``path``: (path_id, seq, x, y).
    """
    places = path.select("path_id", "seq", "x", "y")
    at = lambda c: riders.select("id", F.col(f"{c}x").alias("px"), F.col(f"{c}y").alias("py"))
    board = range_pairs(at("s"), places, r).groupBy("path_id", "id").agg(F.min("seq").alias("board"))
    alight = range_pairs(at("e"), places, r).groupBy("path_id", "id").agg(F.max("seq").alias("alight"))
    return board.join(merged(alight), ["path_id", "id"]).filter("board < alight")


ENDS = ["sx", "sy", "ex", "ey"]


def trips_of(riders: DataFrame) -> DataFrame:
    """(id, trip): the least id among the riders with the same ends."""
    return riders.join(merged(riders.groupBy(*ENDS).agg(F.min("id").alias("trip"))), ENDS).select("id", "trip")


def close_trips(trips: DataFrame, start_r: float, end_r: float) -> DataFrame:
    """(id, other): pairs of trips close at both ends, each with itself too. ``trips``: (id, sx, sy, ex, ey)."""
    a = trips.select("id", F.col("sx").alias("px"), F.col("sy").alias("py"), "ex", "ey")
    b = trips.select(F.col("id").alias("other"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("ex").alias("bx"), F.col("ey").alias("by"))
    return range_pairs(a, b, start_r).filter(dist2(F.col("ex"), F.col("ey"), F.col("bx"), F.col("by")) <= end_r * end_r).select("id", "other")


def of_riders(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (id, other) of riders from pairs of their trips; ``members``: (id, trip)."""
    left = pairs.withColumnsRenamed({"id": "trip", "other": "other_trip"}).join(merged(members), "trip")
    return left.join(merged(members.select(F.col("id").alias("other"), F.col("trip").alias("other_trip"))), "other_trip").filter("id <> other").select("id", "other")


def related(riders: DataFrame, start_r: float, end_r: float) -> DataFrame:
    """(id, other): pairs close at both ends, before the detour test of ``compatible``.

    Trips with the same ends are compared once: the range join runs over distinct trips, and riders join theirs.
    """
    trips = riders.groupBy(*ENDS).agg(F.min("id").alias("id"))
    return of_riders(close_trips(trips, start_r, end_r), trips_of(riders))


def related_compatible(travel, riders: DataFrame, stops: DataFrame, start_r: float, end_r: float, s: Settings) -> DataFrame:
    """(id, other): pairs close at both ends that are also compatible. Trips with the same ends have the same stops and are tested once."""
    trips = cut(riders.groupBy(*ENDS).agg(F.min("id").alias("id")))
    fits = compatible(travel, cut(candidate_stops(trips, stops, s)), close_trips(trips, start_r, end_r), s)
    return of_riders(fits, trips_of(riders))


def on_every(route_requests: DataFrame, related_pairs: DataFrame) -> DataFrame:
    """Relational division: (route, other) related to every request of the route."""
    n = route_requests.groupBy("route").agg(F.count_distinct("id").alias("n"))
    hits = route_requests.join(merged(related_pairs), "id").groupBy("route", "other").agg(F.count_distinct("id").alias("k"))
    return hits.join(merged(n), "route").filter("k = n").select("route", "other")
