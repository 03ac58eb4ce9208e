"""Queries for one insertion step, stop replacement, and the composed pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.functions import formats
from tripweave.operators import headings, insertion, routes, sequences
from tripweave.plans.catalog import query
from tripweave.plans.demand import server_stop_sync
from tripweave.plans.functions import HEAD, head_vectors
from tripweave.plans.routes import AROUND, STEPS, search_sql, timed
from tripweave.plans.solver import best_routes
from tripweave.settings import Settings
from tripweave.sources.driver_tables import Tables, leg_sql
from tripweave.sources.shared import cut, merged

S = Settings()
RIDES = "SELECT service AS ride, CASE kind WHEN 'pickup' THEN 'U' ELSE 'D' END AS side, pos, stop FROM {acts} AS acts"
WANTED = """SELECT ride, req, role, idx, ord FROM (SELECT ride, CAST(req AS INT) AS req, role, CAST(k AS INT) AS ord,
 CASE WHEN (ride + req + k) % 3 = 0 THEN CASE role WHEN 'S' THEN s ELSE e END ELSE (ride * 17 + req * 31 + k * 7 + CASE role WHEN 'S' THEN 0 ELSE 90 END) % 190 + 1 + 190 * (ride % 10) END AS idx
 FROM (SELECT ride, min(stop) AS s, max(stop) AS e FROM {rides} AS r GROUP BY ride) AS q CROSS JOIN (VALUES (1), (2), (3)) AS a(req) CROSS JOIN (VALUES (0), (1)) AS b(k) CROSS JOIN (VALUES ('S'), ('E')) AS c(role)) AS z"""

STEP = f"""WITH r AS ({RIDES.format(acts='acts')}), w0 AS ({WANTED.format(rides='r')}), w AS (SELECT w0.* FROM w0 WHERE idx IN (SELECT idx FROM stops)),
 nowc AS (SELECT ride, sum({search_sql('a', 'b')}) AS now FROM (SELECT ride, stop AS a, lead(stop) OVER (PARTITION BY ride ORDER BY side DESC, pos) AS b FROM r) z WHERE b IS NOT NULL GROUP BY 1),
 en AS (SELECT ride, arg_min(stop, pos) FILTER (side = 'U') AS p1, arg_max(stop, pos) FILTER (side = 'U') AS pm, arg_min(stop, pos) FILTER (side = 'D') AS d1, arg_max(stop, pos) FILTER (side = 'D') AS dn,
   list(stop) FILTER (side = 'U') AS ups, list(stop) FILTER (side = 'D') AS downs FROM r GROUP BY 1),
 e AS (SELECT en.*, now, now - {search_sql('p1', 'dn')} AS det, {search_sql('pm', 'd1')} AS gap FROM en JOIN nowc USING (ride)),
 m AS (SELECT ride, req, arg_min(stop, pos) FILTER (side = 'U' AND role = 'S') AS up, arg_min(stop, pos) FILTER (side = 'D' AND role = 'E') AS down FROM r JOIN w USING (ride) WHERE stop = idx GROUP BY 1, 2),
 q AS (SELECT k.ride, k.req, up, down, e.* EXCLUDE (ride), CASE WHEN up IS NOT NULL AND down IS NOT NULL THEN 'match' WHEN down IS NOT NULL THEN 'pickup' WHEN up IS NOT NULL THEN 'dropoff' ELSE 'both' END AS kind
   FROM (SELECT DISTINCT ride, req FROM w) k JOIN e USING (ride) LEFT JOIN m ON m.ride = k.ride AND m.req = k.req),
 it AS (SELECT g.ride, side, req, idx, ord, pos, {search_sql('g.a', 'idx')} + {search_sql('idx', 'g.b')} - {search_sql('g.a', 'g.b')} AS change FROM (SELECT ride, side, pos, stop AS a, lead(stop) OVER (PARTITION BY ride, side ORDER BY pos) AS b FROM r) g
   JOIN w ON w.ride = g.ride AND ((side = 'U' AND role = 'S') OR (side = 'D' AND role = 'E')) WHERE g.b IS NOT NULL),
 bu AS (SELECT ride, req, side, change, idx FROM (SELECT *, row_number() OVER (PARTITION BY ride, req, side ORDER BY change, ord, pos, idx) AS rn FROM it) z WHERE rn = 1),
 s AS (SELECT q.*, w.idx, w.ord FROM q JOIN w ON w.ride = q.ride AND w.req = q.req AND role = 'S' WHERE NOT list_contains(downs, idx)),
 t AS (SELECT q.*, w.idx, w.ord FROM q JOIN w ON w.ride = q.ride AND w.req = q.req AND role = 'E' WHERE NOT list_contains(ups, idx)),
 cn AS (SELECT s.*, t.idx AS ei, s.ord * 10000 + t.ord AS o FROM s JOIN t USING (ride, req) WHERE s.kind = 'both' AND s.idx <> t.idx),
 ways AS (
  SELECT ride, req, kind, now + {search_sql('idx', 'p1')} - {search_sql('idx', 'dn')} AS detour, 0 AS way, ord, 0 AS pos, idx AS up, down FROM s WHERE kind = 'pickup'
  UNION ALL SELECT ride, req, kind, det + {search_sql('pm', 'idx')} + {search_sql('idx', 'd1')} - gap, 1, ord, 0, idx, down FROM s WHERE kind = 'pickup'
  UNION ALL SELECT s.ride, s.req, kind, det + change, 2, s.ord, pos, s.idx, down FROM s JOIN it ON it.ride = s.ride AND it.req = s.req AND it.idx = s.idx AND it.ord = s.ord AND side = 'U' WHERE kind = 'pickup'
  UNION ALL SELECT ride, req, kind, det + {search_sql('pm', 'idx')} + {search_sql('idx', 'd1')} - gap, 0, ord, 0, up, idx FROM t WHERE kind = 'dropoff'
  UNION ALL SELECT ride, req, kind, now + {search_sql('dn', 'idx')} - {search_sql('p1', 'idx')}, 1, ord, 0, up, idx FROM t WHERE kind = 'dropoff'
  UNION ALL SELECT t.ride, t.req, kind, det + change, 2, t.ord, pos, up, t.idx FROM t JOIN it ON it.ride = t.ride AND it.req = t.req AND it.idx = t.idx AND it.ord = t.ord AND side = 'D' WHERE kind = 'dropoff'
  UNION ALL SELECT q.ride, q.req, kind, det + u.change + d.change, 0, 0, 0, u.idx, d.idx FROM q JOIN bu u ON u.ride = q.ride AND u.req = q.req AND u.side = 'U' JOIN bu d ON d.ride = q.ride AND d.req = q.req AND d.side = 'D' WHERE kind = 'both'
  UNION ALL SELECT ride, req, kind, now + {search_sql('idx', 'p1')} + {search_sql('pm', 'ei')} + {search_sql('ei', 'd1')} - gap - {search_sql('idx', 'dn')}, 1, o, 0, idx, ei FROM cn
  UNION ALL SELECT ride, req, kind, now + {search_sql('idx', 'p1')} + {search_sql('dn', 'ei')} - {search_sql('idx', 'ei')}, 2, o, 0, idx, ei FROM cn
  UNION ALL SELECT ride, req, kind, det + {search_sql('pm', 'idx')} + {search_sql('idx', 'ei')} + {search_sql('ei', 'd1')} - gap, 3, o, 0, idx, ei FROM cn
  UNION ALL SELECT ride, req, kind, now + {search_sql('pm', 'idx')} + {search_sql('idx', 'd1')} - gap + {search_sql('dn', 'ei')} - {search_sql('p1', 'ei')}, 4, o, 0, idx, ei FROM cn),
 best AS (SELECT *, row_number() OVER (PARTITION BY ride, req ORDER BY detour, way, ord, pos) AS rn FROM ways WHERE detour <= {S.budget:.0f})
 SELECT ride, req, kind AS "case", CAST(detour AS DOUBLE) AS detour, way, up, down FROM best WHERE rn = 1
 UNION ALL SELECT ride, req, kind, NULL, 0, up, down FROM q WHERE kind = 'match'"""


@query("insert_step", STEP)
def insert_step(t: Tables):
    rides = t.spark.sql(RIDES, acts=t.activities)
    wanted = t.spark.sql(WANTED, rides=rides).join(t.stops.select("idx"), "idx", "left_semi")
    return insertion.insertion_step(cut(rides), cut(wanted), t.legs, S.budget, S.dwell)


@query(
    "stop_replacement",
    f"""SELECT service, pos, stop, idx, {leg_sql('p', 'idx')} + {leg_sql('idx', 'nx')} - {leg_sql('p', 'stop')} - {leg_sql('stop', 'nx')} AS delta
    FROM {AROUND} JOIN stops ON idx = (stop * 13 + service) % 190 + 1 + 190 * (service % 10) WHERE p IS NOT NULL AND nx IS NOT NULL""",
)
def stop_replacement(t: Tables):
    rows = sequences.neighbours(t.paths, "service", "pos", "stop").filter("prev_stop IS NOT NULL AND next_stop IS NOT NULL")
    rows = rows.withColumn("idx", (F.col("stop") * 13 + F.col("service")) % 190 + 1 + 190 * (F.col("service") % 10)).join(t.stops.select("idx"), "idx", "left_semi")
    return routes.replacement_delta(rows, t.legs, "idx").select("service", "pos", "stop", "idx", "delta")


@query("departure_time", "SELECT id, epoch_ms(make_timestamp((created_ms + time_ms - 28800000) * 1000)) // 1000 AS departs FROM suggestions")
def departure_time(t: Tables):
    return t.suggestions.select("id", formats.departure_seconds(F.col("created_ms"), F.col("time_ms")).alias("departs"))


@query("request_balance", "SELECT service, coalesce(list_sort(list(req) FILTER (kind = 'pickup')) = list_sort(list(req) FILTER (kind = 'dropoff')), FALSE) AS balanced FROM acts GROUP BY service")
def request_balance(t: Tables):
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("req"))))
    return t.activities.groupBy("service").agg((side("pickup") == side("dropoff")).alias("balanced"))


@query("route_json", f"""SELECT service, concat('{{"route":', service, ',"stops":[', string_agg(concat('{{"stop":', stop, ',"kind":"', kind, '","req":', req, '}}'), ',' ORDER BY pos), ']}}') AS body FROM acts GROUP BY service""")
def route_json(t: Tables):
    stop = F.struct("pos", F.struct("stop", "kind", "req").alias("s"))
    rows = t.activities.groupBy("service").agg(F.array_sort(F.collect_list(stop)).alias("l"))
    return rows.select("service", F.to_json(F.struct(F.col("service").alias("route"), F.transform("l", lambda x: x["s"]).alias("stops"))).alias("body"))


@query("stop_json", """SELECT idx, concat('{"coordinates":[', x, ',', y, '],"heading":', CASE WHEN idx % 3 = 0 THEN 'null' ELSE CAST(CAST((idx * 37) % 360 AS DOUBLE) AS VARCHAR) END, ',"description":"', p_name, '","index":', idx, ',"busStopCode":"', lpad(CAST(idx AS VARCHAR), 5, '0'), '"}') AS body
 FROM stops JOIN part ON p_partkey = idx""")
def stop_json(t: Tables):
    heading = F.when(F.col("idx") % 3 != 0, ((F.col("idx") * 37) % 360).cast("double"))
    rows = t.stops.join(t.read("part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("description")), "idx")
    shape = F.struct(F.array("x", "y").alias("coordinates"), heading.alias("heading"), "description", F.col("idx").alias("index"), F.lpad(F.col("idx").cast("string"), 5, "0").alias("busStopCode"))
    return rows.select("idx", F.to_json(shape, {"ignoreNullFields": "false"}).alias("body"))


@query("request_json", """SELECT id, concat('{"start":{"lat":', sy, ',"lng":', sx, '},"end":{"lat":', ey, ',"lng":', ex, '},"time":', time_ms, '}') AS body FROM suggestions""")
def request_json(t: Tables):
    at = lambda c: F.struct(F.col(f"{c}y").alias("lat"), F.col(f"{c}x").alias("lng"))
    return t.suggestions.select("id", F.to_json(F.struct(at("s").alias("start"), at("e").alias("end"), F.col("time_ms").alias("time"))).alias("body"))


@query(
    "suggested_route_json",
    f"""WITH {STEPS}, h AS (SELECT service, pos, concat('{{"lat":', y, ',"lng":', x, ',"numBoard":', CASE WHEN kind = 'pickup' THEN 1 ELSE 0 END, ',"numAlight":', CASE WHEN kind = 'pickup' THEN 0 ELSE 1 END,
      ',"index":', stop, ',"maxTime":', latest, ',"minTime":', latest, '}}') AS halt, req, kind FROM times JOIN stops ON idx = stop)
    SELECT service, concat('{{"stops":[', string_agg(halt, ',' ORDER BY pos), '],"requests":[', string_agg(CAST(req AS VARCHAR), ',' ORDER BY pos) FILTER (kind = 'pickup'), ']}}') AS body FROM h GROUP BY service""",
)
def suggested_route_json(t: Tables):
    """Routes as they are shown: halts with riders on and off and their times, and the requests served."""
    up = F.col("kind") == "pickup"
    rows = timed(t).join(t.stops.select(F.col("idx").alias("stop"), "x", "y"), "stop")
    halt = F.struct(F.col("y").alias("lat"), F.col("x").alias("lng"), F.when(up, 1).otherwise(0).alias("numBoard"), F.when(up, 0).otherwise(1).alias("numAlight"), F.col("stop").alias("index"), F.col("latest").alias("maxTime"), F.col("latest").alias("minTime"))
    rows = rows.groupBy("service").agg(F.array_sort(F.collect_list(F.struct("pos", halt.alias("h"), F.when(up, F.col("req")).alias("req")))).alias("l"))
    shape = F.struct(F.transform("l", lambda x: x["h"]).alias("stops"), F.transform(F.filter("l", lambda x: x["req"].isNotNull()), lambda x: x["req"]).alias("requests"))
    return rows.select("service", F.to_json(shape).alias("body"))


@query("stop_heading_pipeline", f"WITH {HEAD}, f AS (SELECT stop, arg_min(ux, b) AS fx, arg_min(uy, b) AS fy FROM u GROUP BY 1), d AS (SELECT u.stop, min(ux*fx + uy*fy) AS c, sum(ux) AS sx, sum(uy) AS sy FROM u JOIN f ON f.stop = u.stop GROUP BY 1) SELECT idx, CASE WHEN c IS NULL THEN 'missing' WHEN round(c, 9) < 0.9 THEN 'dropped' ELSE 'found' END AS status, CASE WHEN round(c, 9) >= 0.9 THEN round((degrees(atan2(sx, sy)) + 360.0) % 360.0, 4) % 360.0 END AS heading FROM stops LEFT JOIN d ON stop = idx")
def stop_heading_pipeline(t: Tables):
    units = head_vectors(t)
    found = headings.discrepancy(units, "b").join(headings.mean_heading(units), "stop").withColumnRenamed("stop", "idx")
    c = F.round("least_cosine", 9)
    rows = t.stops.select("idx").join(found, "idx", "left")
    status = F.when(c.isNull(), "missing").when(c < 0.9, "dropped").otherwise("found")
    return rows.select("idx", status.alias("status"), F.when(c >= 0.9, F.pmod(F.round("heading", 4), F.lit(360.0))).alias("heading"))


@query("published_schedule")
def published_schedule(t: Tables):
    """From every suggestion to the schedule that is published for it, as JSON for the sink.

    The route of most riders, the next working day after the suggestion was made, arrivals counted back from
    the wanted time, optimistic pickup times, and the server's stop for each halt (an id to reuse, or null
    where one is to be created). Suggestions with too few companions, or no route, get a failure.
    """
    seeds = t.suggestions.select(F.col("id").alias("seed"), "time_ms", F.to_date(F.timestamp_millis("created_ms")).alias("today"))
    best = cut(best_routes(t))
    halts = best.select("seed", "n_up", F.posexplode("stops").alias("pos", "stop")).join(merged(seeds), "seed")
    legs = sequences.backward_times(routes.path_legs(halts, t.legs, part="seed"), "seed", "pos", "leg", "time_ms", S.dwell)
    timed_halts = sequences.optimistic_schedule(legs.withColumn("up", F.col("pos") < F.col("n_up")), "seed", "pos", "arrive", "up")
    server = server_stop_sync(t).select(F.col("idx").alias("stop"), "server_id")
    halt = F.struct("pos", F.struct("stop", "server_id", F.when(F.col("up"), "pickup").otherwise("dropoff").alias("kind"), F.col("scheduled").alias("time")).alias("h"))
    bodies = timed_halts.join(merged(server), "stop", "left").groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(halt)), lambda x: x["h"]).alias("stops"))
    holidays = t.read("orders").filter("o_orderkey % 97 = 0").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    day = headings.next_working_day(seeds.select("today").distinct(), holidays)
    rows = seeds.join(day, "today").join(merged(bodies), "seed", "left").join(merged(best.select("seed", "requests")), "seed", "left")
    good = F.to_json(F.struct(F.lit("Success").alias("status"), F.col("next_day").cast("string").alias("date"), "stops", "requests"), {"ignoreNullFields": "false"})
    bad = F.to_json(F.struct(F.lit("Failure").alias("status"), F.lit("too_few_suggestions").alias("reason")))
    return rows.select("seed", F.when(F.col("stops").isNotNull(), good).otherwise(bad).alias("route"))
