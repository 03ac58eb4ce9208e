"""Stop headings, stop lists of several sources, and small formats."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.operators.sequences import by, with_travel
from tripweave.operators.spatial import range_pairs
from tripweave.sources.shared import cut, merged


def parse_hhmm(s: Column) -> Column:
    """'HHmm' as milliseconds since midnight."""
    return (F.substring(s, 1, 2).cast("long") * 60 + F.substring(s, 3, 2).cast("long")) * 60_000


def stop_code(description: Column) -> Column:
    code = F.regexp_extract(description, r"^([0-9]{5}) \(BUS STOP\)", 1)
    return F.when(code != "", code)


def iso_of(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_of(text: Column) -> Column:
    """Epoch milliseconds of either a number or an ISO timestamp; null if neither."""
    return F.coalesce(text.try_cast("long"), F.unix_millis(F.try_to_timestamp(text)))


def next_working_day(days: DataFrame, holidays: DataFrame, window: int = 30) -> DataFrame:
    """(today, next_day): the first later day that is neither weekend nor holiday. ``holidays``: (day).

    Looks ``window`` days ahead, and twice as many further for those that find none there, and so on until all have one.
    """
    todo, holidays, found, at = cut(days.filter("today IS NOT NULL")), cut(holidays), None, 0
    while True:
        later = todo.withColumn("day", F.explode(F.sequence(F.date_add("today", at + 1), F.date_add("today", at + window))))
        open_ = later.filter(F.weekday("day") < 5).join(holidays, "day", "left_anti")
        got = open_.groupBy("today").agg(F.min("day").alias("next_day"))
        found, at, window = got if found is None else found.unionByName(got), at + window, 2 * window
        todo = cut(todo.join(got.select("today"), "today", "left_anti"))
        if todo.isEmpty():
            return found


def penalised_times(legs: DataFrame, points: DataFrame, steps: DataFrame, costs: dict[str, int], penalty: int) -> DataFrame:
    """(leg, ms): instruction times and turn costs, plus a penalty for leaving or arriving against the heading.

    ``legs``: (leg, start_heading, end_heading); ``points``: (leg, k, lng, lat) and ``steps``: (leg, k, ms, turn)
    of the route found. A leg without points has no route: its time is infinite. A route of one point, an
    unknown heading and two equal points cost no penalty.
    """
    from tripweave.functions.geo import bearing_vector, cosine, heading_vector, turn_cost

    sums = steps.groupBy("leg").agg(F.sum(F.col("ms") + turn_cost(F.col("turn"), costs)).alias("ms"))
    place = F.struct(*[x for c in ("k", "lng", "lat") for x in (F.isnull(c).alias(f"no_{c}"), F.col(c))])  # unknown ones last
    line = points.groupBy("leg").agg(F.array_sort(F.collect_list(place)).alias("p"))  # the points of one leg
    rows = legs.join(line, "leg", "left").join(sums, "leg", "left")

    def against(a: int, b: int, heading: str) -> Column:
        at = lambda i: F.try_element_at("p", F.lit(i))
        way = heading_vector(at(a)["lng"], at(a)["lat"], at(b)["lng"], at(b)["lat"])
        return F.coalesce(cosine(*way, *bearing_vector(F.col(heading))) < 0.5, F.lit(False))

    wrong = (F.size("p") >= 2) & (against(1, 2, "start_heading") | against(-2, -1, "end_heading"))
    ms = F.coalesce("ms", F.lit(0)) + F.when(wrong, penalty).otherwise(0)
    return rows.select("leg", F.when(F.col("p").isNull(), F.lit(float("inf"))).otherwise(ms.cast("double")).alias("ms"))


def penalised_matrix(pairs: DataFrame, stops: DataFrame, travel, costs: dict[str, int], penalty: int) -> DataFrame:
    """(src, dst, ms): the matrix over ``pairs`` (a, b, turn) of stops (idx, lng, lat, heading), each a leg straight from one to the other with one instruction."""
    at = lambda n: stops.select(F.col("idx").alias(n), F.struct("lng", "lat").alias(f"p{n}"), F.col("heading").alias(f"h{n}"))
    legs = with_travel(pairs, travel, "a", "b", "ms").join(at("a"), "a").join(at("b"), "b").withColumn("leg", F.struct("a", "b"))
    points = legs.select("leg", F.posexplode(F.array("pa", "pb")).alias("k", "p")).select("leg", "k", "p.lng", "p.lat")
    ends = legs.select("leg", F.col("ha").alias("start_heading"), F.col("hb").alias("end_heading"))
    times = penalised_times(ends, points, legs.select("leg", F.lit(0).alias("k"), "ms", "turn"), costs, penalty)
    return times.select(F.col("leg.a").alias("src"), F.col("leg.b").alias("dst"), "ms")


def stop_pairs(path: DataFrame, part: str, order: str) -> DataFrame:
    """Distinct successive pairs (a, b)."""
    nxt = path.select(F.col("stop").alias("a"), F.lead("stop").over(by(part, order)).alias("b"))
    return nxt.filter("b IS NOT NULL").distinct()


def unit_vectors(v: DataFrame) -> DataFrame:
    """Adds (ux, uy) of (dx, dy); zero vectors are left out."""
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return v.withColumns({"ux": F.try_divide("dx", size), "uy": F.try_divide("dy", size)}).filter("ux IS NOT NULL")


def mean_heading(units: DataFrame) -> DataFrame:
    """Per stop: number, vector sum and mean bearing from north in degrees."""
    m = units.groupBy("stop").agg(F.count("*").alias("n"), F.sum("ux").alias("sx"), F.sum("uy").alias("sy"))
    return m.withColumn("heading", F.pmod(F.degrees(F.atan2("sx", "sy")), F.lit(360.0)))


def discrepancy(units: DataFrame, order: str, least: float = 0.9) -> DataFrame:
    """Per stop the least cosine to its first heading; stops below ``least`` are to be dropped."""
    first = units.groupBy("stop").agg(F.min_by(F.struct("ux", "uy"), order).alias("f"))
    cosine = F.col("ux") * F.col("f.ux") + F.col("uy") * F.col("f.uy")
    out = units.join(first, "stop").groupBy("stop").agg(F.min(cosine).alias("least_cosine"))
    return out.withColumn("dropped", F.col("least_cosine") < least)


def combine_sources(a: DataFrame, b: DataFrame, code: str, prefer_a: list[str]) -> DataFrame:
    """Full outer join by code: the columns ``prefer_a`` from a first, all others from b first."""
    left = a.withColumnsRenamed({c: f"_a_{c}" for c in a.columns if c != code})
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in b.columns if c != code})
    both = left.join(right, code, "full_outer")
    out = []
    for c in dict.fromkeys([*a.columns, *b.columns]):
        if c != code:
            sides = [f"_a_{c}"] * (c in a.columns) + [f"_b_{c}"] * (c in b.columns)
            out.append(F.coalesce(*map(F.col, sides if c in prefer_a else sides[::-1])).alias(c))
    return both.select(code, *out)


def later_wins(a: DataFrame, b: DataFrame, code: str) -> DataFrame:
    """Whole rows of b, and those of a whose code b lacks."""
    return b.unionByName(a.join(b, code, "left_anti"), allowMissingColumns=True)


def match_candidates(old: DataFrame, new: DataFrame, r: float) -> DataFrame:
    """(old, new, d): stops within r metres, by the equirectangular distance; a stop's own code comes before all others.

    ``old``: (old, lng, lat), ``new``: (new, lng, lat). Cells are metres along the equator and the meridian,
    widened by the greatest latitude, so that none within reach is missed.
    """
    from tripweave.functions.geo import EQUIRECTANGULAR_RADIUS, equirectangular

    metres = lambda c: F.radians(c) * EQUIRECTANGULAR_RADIUS
    steepest = old.select("lat").union(new.select("lat")).agg(F.max(F.abs("lat"))).first()[0] or 0.0
    wide = r / max(cos(radians(steepest)), 1e-6)
    points = old.select("old", F.col("lng").alias("olng"), F.col("lat").alias("olat"), metres(F.col("lng")).alias("px"), metres(F.col("lat")).alias("py"))
    places = new.select("new", "lng", "lat", metres(F.col("lng")).alias("x"), metres(F.col("lat")).alias("y"))
    pairs = range_pairs(points, places, 1.5 * wide).withColumn("d", equirectangular(F.col("olng"), F.col("olat"), F.col("lng"), F.col("lat"))).filter(F.col("d") <= r)
    return pairs.select("old", "new", F.when(F.col("old") == F.col("new"), -0.01).otherwise(F.col("d")).alias("d"))


def match_one_to_one(pairs: DataFrame) -> DataFrame:
    """Greedy matching by (d, old, new), as rounds of mutually best pairs."""
    open_, found = cut(pairs), None
    while not open_.isEmpty():
        order = F.struct("d", "old", "new")
        a = open_.groupBy("old").agg(F.min(order).alias("a"))
        b = open_.groupBy("new").agg(F.min(order).alias("b"))
        got = cut(open_.join(merged(a), "old").join(merged(b), "new").filter("a = b AND a.new = new AND b.old = old").select("old", "new"))
        found = got if found is None else found.union(got)
        open_ = cut(open_.join(merged(got.select("old")), "old", "left_anti").join(merged(got.select("new")), "new", "left_anti"))
    return found if found is not None else pairs.select("old", "new")


def migrate(old: DataFrame, new: DataFrame, r: float) -> DataFrame:
    """(old, new, defunct): the old list with matches; new stops without an old one are appended with a null ``old``."""
    matched = match_one_to_one(match_candidates(old, new, r))
    kept = old.select("old").join(merged(matched), "old", "left").withColumn("defunct", F.col("new").isNull())
    added = new.select("new").join(merged(matched.select("new")), "new", "left_anti")
    return kept.unionByName(added.select(F.lit(None).cast("long").alias("old"), "new", F.lit(False).alias("defunct")))
