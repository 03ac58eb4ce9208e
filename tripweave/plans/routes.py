"""Queries about paths, feasible times, insertion and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripweave.operators import demand, routes, sequences
from tripweave.operators.sequences import by
from tripweave.plans import demand as demand_plans
from tripweave.plans.catalog import query
from tripweave.settings import Settings
from tripweave.sources.driver_tables import Tables, cost_sql, leg_sql

S = Settings()
W = "PARTITION BY service ORDER BY pos"
LEGS = f"legs AS (SELECT *, CASE WHEN next_stop IS NOT NULL THEN {leg_sql('stop', 'next_stop')} END AS leg FROM (SELECT *, lead(stop) OVER ({W}) AS next_stop FROM paths) p)"
STEPS = f"""steps AS (SELECT a.*, CASE WHEN prev IS NULL THEN NULL ELSE {cost_sql('prev', 'stop')} END AS step FROM (SELECT *, lag(stop) OVER ({W}) AS prev FROM acts) a),
 c AS (SELECT *, sum(coalesce(step, 0)) OVER ({W}) AS c FROM steps),
 times AS (SELECT *, c + max(min_t - c) OVER ({W}) AS earliest, c + min(max_t - c) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS latest FROM c)"""


@query("unique_stop_sequence", "SELECT service, pos, stop, n FROM paths")
def unique_stop_sequence(t: Tables):
    return t.paths.select("service", "pos", "stop", "n")


@query("travel_times_path", f"WITH {LEGS} SELECT service, pos, stop, next_stop, leg FROM legs WHERE next_stop IS NOT NULL")
def travel_times_path(t: Tables):
    return routes.path_legs(t.paths, t.legs).filter("next_stop IS NOT NULL").select("service", "pos", "stop", "next_stop", "leg")


@query("path_cost", f"WITH {LEGS} SELECT service, sum(CASE WHEN stop = next_stop THEN 1e9 ELSE leg + 60000 END) AS search_cost, sum(CASE WHEN stop = next_stop THEN 0 ELSE leg + 60000 END) AS travel_ms FROM legs WHERE next_stop IS NOT NULL GROUP BY service")
def path_cost(t: Tables):
    legs = routes.path_legs(t.paths, t.legs).filter("next_stop IS NOT NULL")
    a, b, ms = F.col("stop"), F.col("next_stop"), F.col("leg")
    return legs.groupBy("service").agg(F.sum(routes.leg_cost(a, b, ms, S.dwell)).alias("search_cost"), F.sum(routes.leg_time(a, b, ms, S.dwell)).alias("travel_ms"))


@query("stop_surroundings", f"SELECT service, pos, stop, lag(stop) OVER ({W}) AS prev_stop, lead(stop) OVER ({W}) AS next_stop FROM paths")
def stop_surroundings(t: Tables):
    return sequences.neighbours(t.paths, "service", "pos", "stop").select("service", "pos", "stop", "prev_stop", "next_stop")


AROUND = f"(SELECT *, lag(stop) OVER ({W}) AS p, lead(stop) OVER ({W}) AS nx FROM paths) q"


@query("removal_saving", f"SELECT service, pos, stop, {leg_sql('p', 'stop')} + {leg_sql('nx', 'stop')} - {leg_sql('p', 'nx')} AS saving FROM {AROUND} WHERE p IS NOT NULL AND nx IS NOT NULL")
def removal_saving(t: Tables):
    return routes.removal_saving(t.paths, t.legs).select("service", "pos", "stop", "saving")


@query(
    "ruin_worst_step",
    f"""WITH s AS (SELECT service, pos, stop, {leg_sql('p', 'stop')} + {leg_sql('stop', 'nx')} - {leg_sql('p', 'nx')} AS saving FROM {AROUND} WHERE p IS NOT NULL AND nx IS NOT NULL)
    SELECT service, pos, stop, saving FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY saving DESC, pos) AS rn FROM s) q WHERE rn = 1""",
)
def ruin_worst_step(t: Tables):
    rows = routes.removal_saving(t.paths, t.legs, reversed_next=False)
    return sequences.uniq_by(rows.withColumn("_o", -F.col("saving")), ["service"], ["_o", "pos"]).select("service", "pos", "stop", "saving")


@query(
    "group_successive",
    f"""WITH r AS (SELECT *, sum(ch) OVER ({W}) AS run FROM (SELECT *, CASE WHEN lag(stop % 3) OVER ({W}) IS DISTINCT FROM stop % 3 AND pos > 1 THEN 1 ELSE 0 END AS ch FROM paths) q)
    SELECT service, run, stop % 3 AS k, count(*) AS n, min(pos) AS first_pos FROM r GROUP BY 1, 2, 3""",
)
def group_successive(t: Tables):
    rows = sequences.runs(t.paths.withColumn("k", F.col("stop") % 3), "service", "pos", "k")
    return rows.groupBy("service", "run", "k").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query("dedup_successive", f"SELECT service, pos, stop FROM (SELECT *, lag(stop % 3) OVER ({W}) AS before FROM paths) q WHERE pos = 1 OR before IS DISTINCT FROM stop % 3")
def dedup_successive(t: Tables):
    return sequences.dedup_successive(t.paths.withColumn("k", F.col("stop") % 3), "service", "pos", "k").select("service", "pos", "stop")


def timed(t: Tables):
    acts = t.activities.withColumn("prev", F.lag("stop").over(by("service", "pos")))
    acts = sequences.with_travel(acts, t.legs, "prev", "stop", "ms")
    step = F.when(F.col("prev").isNotNull(), sequences.step_time(F.col("prev"), F.col("stop"), F.col("ms"), S.dwell))
    return sequences.feasible_times(acts.withColumn("step", step), "service", "pos", "step")


@query("earliest_times", f"WITH {STEPS} SELECT service, pos, earliest FROM times")
def earliest_times(t: Tables):
    return timed(t).select("service", "pos", "earliest")


@query("latest_times", f"WITH {STEPS} SELECT service, pos, latest FROM times")
def latest_times(t: Tables):
    return timed(t).select("service", "pos", "latest")


@query("feasibility", f"WITH {STEPS} SELECT service, CASE WHEN bool_and(earliest <= latest) THEN 'ok' ELSE 'infeasible' END AS status FROM times GROUP BY service")
def feasibility(t: Tables):
    return sequences.feasible(timed(t), "service")


@query("time_to_end", f"WITH {LEGS} SELECT service, pos, coalesce(sum(leg) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS to_end FROM legs")
def time_to_end(t: Tables):
    return sequences.time_to_end(routes.path_legs(t.paths, t.legs), "service", "pos", "leg").select("service", "pos", "to_end")


@query("backward_times", f"WITH {LEGS} SELECT service, pos, 30600000 - sum(CASE WHEN next_stop IS NULL THEN 0 ELSE leg + 60000 END) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS arrive FROM legs")
def backward_times(t: Tables):
    legs = routes.path_legs(t.paths, t.legs).withColumn("end", F.lit(30_600_000))
    return sequences.backward_times(legs, "service", "pos", "leg", "end", S.dwell).select("service", "pos", "arrive")


@query(
    "optimistic_schedule",
    f"""WITH RECURSIVE p AS (SELECT service, pos, max_t AS t, kind FROM acts),
    r AS (SELECT service, pos, t AS s FROM p WHERE pos = 1 UNION ALL
      SELECT p.service, p.pos, CASE WHEN kind = 'pickup' THEN greatest(r.s + 60000, p.t - 180000) ELSE p.t END FROM r JOIN p ON p.service = r.service AND p.pos = r.pos + 1)
    SELECT service, pos, s AS scheduled FROM r""".replace("WITH RECURSIVE ", "WITH "),
    recursive=True,
)
def optimistic_schedule(t: Tables):
    acts = t.activities.withColumn("up", F.col("kind") == "pickup")
    return sequences.optimistic_schedule(acts, "service", "pos", "max_t", "up").select("service", "pos", "scheduled")


@query(
    "suffix_min_dropoff",
    f"""SELECT service, pos, best.c AS best_cost, -best.b AS best_at FROM (SELECT service, pos, min(struct_pack(c := (stop * 7919) % 13, b := -pos)) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM paths) q""",
)
def suffix_min_dropoff(t: Tables):
    return sequences.suffix_best(t.paths.withColumn("c", F.col("stop") * 7919 % 13), "service", "pos", "c").select("service", "pos", "best_cost", "best_at")


LIST = "l AS (SELECT service, list(stop ORDER BY pos) AS stops FROM paths GROUP BY service HAVING count(*) >= 4 AND count(DISTINCT stop) = count(*))"


def stop_lists(t: Tables):
    return t.paths.groupBy("service").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop"))), lambda s: s["stop"]).alias("stops"))


@query("list_insert", f"WITH {LIST} SELECT service, array_to_string(stops[1:2] || [-6] || stops[3:3] || [-7] || stops[4:], ',') AS edited, array_to_string(stops[2:2] || [-6] || stops[3:3] || [-7] || stops[4:4], ',') AS piece FROM l")
def list_insert(t: Tables):
    rows = stop_lists(t).filter("size(stops) >= 4 AND size(array_distinct(stops)) = size(stops)")
    x = F.col("stops")
    gap1, gap2 = F.slice(x, 2, 2), F.slice(x, 3, 2)
    args = (x, F.lit(-6).cast("long"), F.lit(-7).cast("long"), gap1, gap2)
    return rows.select("service", F.array_join(sequences.insert_two(*args).cast("array<string>"), ",").alias("edited"), F.array_join(sequences.inserted_window(*args).cast("array<string>"), ",").alias("piece"))


def search_sql(a: str, b: str) -> str:
    """A leg in an insertion search: staying is as good as forbidden."""
    return f"CASE WHEN {a} = {b} THEN 1e9 ELSE {leg_sql(a, b)} + 60000 END"


WANTED = "wanted AS (SELECT service, req, (stop * 31 + req) % 1000 + 1 AS idx FROM acts WHERE kind = 'pickup' AND (stop * 31 + req) % 1000 + 1 IN (SELECT idx FROM stops))"
DETOURS = f"""gaps AS (SELECT service, pos, stop AS a, lead(stop) OVER ({W}) AS b FROM paths),
 d AS (SELECT g.service, g.pos, req, w.idx, {search_sql('a', 'idx')} + {search_sql('idx', 'b')} - {search_sql('a', 'b')} AS detour FROM gaps g JOIN wanted w USING (service) WHERE b IS NOT NULL)"""


def wanted(t: Tables):
    rows = t.activities.filter("kind = 'pickup'").select("service", "req", ((F.col("stop") * 31 + F.col("req")) % 1000 + 1).alias("idx"))
    return rows.join(t.stops.select("idx"), "idx", "left_semi")


def detours(t: Tables):
    return routes.insertion_detours(t.paths.select("service", "pos", "stop"), wanted(t), t.legs, S.dwell)


@query("activity_insertion_cost", f"WITH {WANTED}, {DETOURS} SELECT service, pos, req, idx, detour FROM d")
def activity_insertion_cost(t: Tables):
    return detours(t).select("service", "pos", "req", "idx", "detour")


@query(
    "best_insertion",
    f"WITH {WANTED}, {DETOURS} SELECT service, req, detour, pos, idx, CASE WHEN detour > 120000 THEN 'rejected' ELSE 'ok' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY service, req ORDER BY detour, pos, idx) AS rn FROM d) q WHERE rn = 1",
)
def best_insertion(t: Tables):
    best = routes.best_insertion(detours(t), ["service", "req"])
    return best.withColumn("status", F.when(F.col("detour") > 120_000, "rejected").otherwise("ok"))


def _od_sql() -> str:
    c = lambda *stops: " + ".join(cost_sql(x, y) for x, y in zip(stops[:-1], stops[1:], strict=True))
    d = lambda a, via, b: f"{c(a, via, b)} - {c(a, b)}"
    return f"least({c('a', 'c', 'd', 'b')} - {c('a', 'b')}, {c('c', 'a', 'b', 'd')} - {c('c', 'd')}, greatest({d('a', 'c', 'b')}, {d('c', 'b', 'd')}), greatest({d('c', 'a', 'd')}, {d('a', 'd', 'b')}))"


@query(
    "detour_matrix",
    f"""SELECT service, pos, {cost_sql('a', 'c')} + {cost_sql('c', 'b')} - {cost_sql('a', 'b')} AS stop_detour, {_od_sql()} AS od_detour
    FROM (SELECT service, pos, stop AS a, lead(stop, 1) OVER ({W}) AS c, lead(stop, 2) OVER ({W}) AS b, lead(stop, 3) OVER ({W}) AS d FROM paths) q WHERE d IS NOT NULL""",
)
def detour_matrix(t: Tables):
    """Every four stops in a row: the detour of the trip a to b through c, and that of sharing with the trip c to d."""
    ahead = {n: F.lead("stop", k).over(by("service", "pos")) for k, n in enumerate("acbd")}
    rows = t.paths.withColumns(ahead).filter("d IS NOT NULL").select("service", "pos", *"abcd")
    rows = routes.with_costs(rows, t.legs, S.dwell, "ab", "ac", "cb", "ca", "ad", "db", "bd", "cd")
    return rows.select("service", "pos", routes.stop_detour("a", "c", "b").alias("stop_detour"), routes.od_detour("a", "b", "c", "d").alias("od_detour"))


@query(
    "fulfilment",
    f"""WITH {STEPS} SELECT service, req, max(CASE WHEN kind = 'pickup' THEN pos END) AS pickup_pos, max(CASE WHEN kind = 'dropoff' THEN pos END) AS dropoff_pos,
    max(CASE WHEN kind = 'dropoff' THEN latest END) - max(CASE WHEN kind = 'pickup' THEN latest END) AS ride_ms FROM times GROUP BY 1, 2""",
)
def fulfilment(t: Tables):
    return routes.fulfilment(timed(t))


@query(
    "mean_travel_time",
    f"WITH {STEPS}, f AS (SELECT service, req, max(latest) - min(latest) AS ms FROM times GROUP BY 1, 2) SELECT service, round(avg(ms) / 60000.0, 6) AS minutes FROM f GROUP BY 1",
)
def mean_travel_time(t: Tables):
    each = timed(t).groupBy("service", "req").agg((F.max("latest") - F.min("latest")).alias("ms"))
    return each.groupBy("service").agg(F.round(F.avg("ms") / 60_000.0, 6).alias("minutes"))


@query(
    "max_detour",
    f"""WITH {STEPS}, f AS (SELECT service, req, max(CASE WHEN kind = 'pickup' THEN stop END) AS o, max(CASE WHEN kind = 'dropoff' THEN stop END) AS d,
    max(CASE WHEN kind = 'dropoff' THEN latest END) - max(CASE WHEN kind = 'pickup' THEN latest END) AS ride FROM times GROUP BY 1, 2)
    SELECT service, max(ride - {leg_sql('o', 'd')}) AS max_detour FROM f GROUP BY service""",
)
def max_detour(t: Tables):
    rows = timed(t)
    ends = rows.groupBy("service", "req").agg(F.max(F.when(F.col("kind") == "pickup", F.col("stop"))).alias("o"), F.max(F.when(F.col("kind") == "dropoff", F.col("stop"))).alias("d"))
    rides = routes.fulfilment(rows).join(ends, ["service", "req"])
    return sequences.with_travel(rides, t.legs, "o", "d", "ms").groupBy("service").agg(F.max(F.col("ride_ms") - F.col("ms")).alias("max_detour"))


@query(
    "route_score",
    """WITH k AS (SELECT service, count(*) + 2 AS n FROM acts GROUP BY 1) SELECT coalesce(sum(n / 2.0 - 1), 0.0) AS score
    FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn, count(*) OVER () AS c FROM k) q WHERE rn <= floor(c / 2)""",
)
def route_score(t: Tables):
    return routes.route_score(t.activities.groupBy(F.col("service").alias("route")).agg((F.count("*") + 2).alias("n")))


@query("vehicles", "SELECT count(DISTINCT service) AS vehicles, count(*) AS stops FROM acts")
def vehicles(t: Tables):
    return t.activities.agg(F.count_distinct("service").alias("vehicles"), F.count("*").alias("stops"))


@query("surviving_routes", "SELECT service, count(*) AS n FROM acts GROUP BY service HAVING count(*) > 2")
def surviving_routes(t: Tables):
    return t.activities.groupBy("service").agg(F.count("*").alias("n")).filter("n > 2")


@query("stop_loads", "SELECT stop, sum(CASE WHEN kind = 'pickup' THEN 1 ELSE 0 END) AS board, sum(CASE WHEN kind = 'dropoff' THEN 1 ELSE 0 END) AS alight FROM acts GROUP BY stop")
def stop_loads(t: Tables):
    return t.activities.groupBy("stop").agg(F.sum(F.when(F.col("kind") == "pickup", 1).otherwise(0)).alias("board"), F.sum(F.when(F.col("kind") == "dropoff", 1).otherwise(0)).alias("alight"))


@query(
    "route_overlap",
    """WITH s AS (SELECT DISTINCT service, stop FROM paths), k AS (SELECT service, count(*) AS n FROM s GROUP BY 1)
    SELECT a.service AS a, b.service AS b, count(*) / CAST(least(max(ka.n), max(kb.n)) AS DOUBLE) AS share FROM s a JOIN s b ON a.stop = b.stop AND a.service < b.service
    JOIN k ka ON ka.service = a.service JOIN k kb ON kb.service = b.service GROUP BY 1, 2 HAVING count(*) / CAST(least(max(ka.n), max(kb.n)) AS DOUBLE) > 0.3""",
)
def route_overlap(t: Tables):
    return routes.similar_routes(t.paths.select("service", "stop").distinct(), S.similarity_limit)


@query("dedupe_stop_lists", "WITH l AS (SELECT service, list(stop ORDER BY pos) AS stops FROM paths GROUP BY service) SELECT min(service) AS service, count(*) AS copies FROM l GROUP BY stops")
def dedupe_stop_lists(t: Tables):
    return routes.first_of_equal(stop_lists(t)).select("service", "copies")


@query("best_route", "SELECT service % 50 AS seed, max(n) AS requests, min(service) FILTER (WHERE n = m) AS service FROM (SELECT *, max(n) OVER (PARTITION BY service % 50) AS m FROM (SELECT service, count(DISTINCT req) AS n FROM acts GROUP BY 1) q) r GROUP BY 1")
def best_route(t: Tables):
    n = t.activities.groupBy("service").agg(F.count_distinct("req").alias("n"))
    return n.groupBy((F.col("service") % 50).alias("seed")).agg(F.max("n").alias("requests"), F.min_by("service", F.struct(-F.col("n"), F.col("service"))).alias("service"))


@query("request_set_ops", "SELECT a.service, len(list_intersect(a.l, b.l)) AS shared, len(a.l) AS size FROM (SELECT service, list(DISTINCT stop) AS l FROM paths GROUP BY 1) a JOIN (SELECT service - 1 AS service, list(DISTINCT stop) AS l FROM paths GROUP BY 1) b USING (service)")
def request_set_ops(t: Tables):
    sets = t.paths.groupBy("service").agg(F.collect_set("stop").alias("l"))
    nxt = sets.select((F.col("service") - 1).alias("service"), F.col("l").alias("m"))
    return sets.join(nxt, "service").select("service", F.size(F.array_intersect("l", "m")).cast("long").alias("shared"), F.size("l").cast("long").alias("size"))


@query("unserved_union", "SELECT DISTINCT service, req FROM acts WHERE service % 3 = 0 UNION SELECT DISTINCT service, req FROM acts WHERE service % 5 = 0 EXCEPT SELECT service, req FROM acts WHERE service % 15 = 0")
def unserved_union(t: Tables):
    a = t.activities.select("service", "req")
    both = a.filter("service % 3 = 0").union(a.filter("service % 5 = 0")).distinct()
    return both.join(a.filter("service % 15 = 0"), ["service", "req"], "left_anti")


#: Requests of the routes as riders who start and end at their stops, willing to walk 750 m.
REQUESTS = """SELECT service * 100 + req AS id, service, req, sx, sy, ex, ey FROM (SELECT a.service, a.req, min(s.x) FILTER (kind = 'pickup') AS sx, min(s.y) FILTER (kind = 'pickup') AS sy,
 min(s.x) FILTER (kind = 'dropoff') AS ex, min(s.y) FILTER (kind = 'dropoff') AS ey FROM acts a JOIN stops s ON s.idx = a.stop GROUP BY 1, 2) AS z"""
WALK = 750


@query(
    "alternative_stops",
    f"""WITH riders AS ({REQUESTS}), {demand_plans.candidates_sql(WALK)}, w AS (SELECT service, req, role, idx FROM cand JOIN riders USING (id))
    SELECT DISTINCT p.service, p.req, p.kind, q.stop AS alternative FROM acts p JOIN acts o ON o.service = p.service AND o.req = p.req AND o.kind <> p.kind
    JOIN acts q ON q.service = p.service AND q.stop <> p.stop AND CASE p.kind WHEN 'pickup' THEN q.pos < o.pos ELSE q.pos > o.pos END
    JOIN w ON w.service = p.service AND w.req = p.req AND w.idx = q.stop AND w.role = CASE p.kind WHEN 'pickup' THEN 'S' ELSE 'E' END""",
)
def alternative_stops(t: Tables):
    side = lambda kind, c: F.min(F.when(F.col("kind") == kind, F.col(c)))
    ends = [side(kind, c).alias(f"{n}{c}") for n, kind in (("s", "pickup"), ("e", "dropoff")) for c in ("x", "y")]
    acts = t.activities
    riders = acts.join(t.stops.select(F.col("idx").alias("stop"), "x", "y"), "stop").groupBy("service", "req").agg(*ends)
    riders = riders.withColumn("id", F.col("service") * 100 + F.col("req"))
    cand = demand.candidate_stops(riders, t.stops, Settings(start_walking_distance=WALK, end_walking_distance=WALK))
    wanted = cand.join(riders.select("id", "service", "req"), "id").select("service", "req", "role", "idx")
    return routes.alternative_stops(acts, wanted)


@query("top_half_routes", "SELECT service, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, service) AS rn, count(*) OVER (PARTITION BY g) AS c FROM (SELECT service, service % 20 AS g, count(*) AS n FROM acts GROUP BY 1, 2) q) r WHERE rn <= floor(c / 2)")
def top_half_routes(t: Tables):
    n = t.activities.groupBy("service").agg(F.count("*").alias("n")).withColumn("g", F.col("service") % 20)
    ranked = n.withColumns({"rn": F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "service")), "c": F.count("*").over(Window.partitionBy("g"))})
    return ranked.filter(F.col("rn") <= F.floor(F.col("c") / 2)).select("service", "n")
