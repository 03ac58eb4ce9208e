"""Queries for sources, sinks and result shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.operators import headings
from tripweave.plans.catalog import query
from tripweave.sources import files
from tripweave.sources.driver_tables import Tables
from tripweave.streaming import triggers

RAW = "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE 1.25e0 + p_size / 1000e0 END AS Latitude, CASE WHEN p_partkey % 13 = 0 THEN 0.0 ELSE 103.7e0 + p_size / 1000e0 END AS Longitude, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS Heading, p_name AS Description FROM {part} AS part"


@query("stops_scan", f"WITH raw AS ({RAW.format(part='part')}) SELECT idx, lng, lat, heading, description FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, Longitude AS lng, Latitude AS lat, coalesce(Heading, -1.0) AS heading, Description AS description FROM raw) q WHERE lng <> 0 AND lat <> 0")
def stops_scan(t: Tables):
    raw = t.spark.sql(RAW, part=t.read("part")).withColumns({"RoadName": F.lit(None).cast("string"), "BusStopCode": F.lit(None).cast("string")})
    rows = files.index_stops(raw, "p_partkey")
    return rows.select("idx", "lng", "lat", F.when(F.isnan("heading"), -1.0).otherwise(F.col("heading")).alias("heading"), "description")


@query("travel_time_peak", "SELECT src, sum(ms * 1.5) AS total, max(ms * 1.5) AS most FROM travel GROUP BY src")
def travel_time_peak(t: Tables):
    return files.peak(t.travel).groupBy("src").agg(F.sum("ms").alias("total"), F.max("ms").alias("most"))


@query("distance_matrix", "SELECT src, count(*) AS n, sum(ms) AS total, max(ms) AS most FROM travel GROUP BY src")
def distance_matrix(t: Tables):
    return t.travel.groupBy("src").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.max("ms").alias("most"))


@query("bus_stops_by_index", "SELECT k, idx, x, y FROM (SELECT CAST(k AS BIGINT) AS k, (k * 37) % 150 + 1 AS want FROM range(0, 40) AS g(k)) q JOIN stops ON idx = want")
def bus_stops_by_index(t: Tables):
    wanted = t.spark.range(40).select(F.col("id").alias("k"), ((F.col("id") * 37) % 150 + 1).alias("idx"))
    return wanted.join(t.stops.select("idx", "x", "y"), "idx").select("k", "idx", "x", "y")


ROUTES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 100 AS seed_id, concat('{{\"status\":\"', CASE WHEN l_suppkey % 4 = 0 THEN 'Failure' ELSE 'Success' END, '\",\"n\":', CAST(l_suppkey AS VARCHAR(20)), '}}') AS route FROM {l} AS lineitem"


@query("suggested_routes_latest", "SELECT id, status FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 100 AS seed_id, CASE WHEN l_suppkey % 4 = 0 THEN 'Failure' ELSE 'Success' END AS status FROM lineitem) q WHERE seed_id = 8 ORDER BY id DESC")
def suggested_routes_latest(t: Tables):
    routes = t.spark.sql(ROUTES, l=t.read("lineitem"))
    return files.latest_routes(routes, 8).select("id", "status")


@query("publish_json", "SELECT id, concat('{\"id\":', id, ',\"start\":{\"x\":', sx, ',\"y\":', sy, '},\"time\":', time_ms, ',\"weight\":', weight, '}') AS body FROM suggestions")
def publish_json(t: Tables):
    body = F.to_json(F.struct("id", F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")).alias("start"), F.col("time_ms").alias("time"), "weight"))
    return t.suggestions.select("id", body.alias("body"))


@query("read_points", "SELECT l AS line, CAST(1000 + l AS DOUBLE) AS distance, CAST(n AS INT) AS n, CAST(l * 3 AS DOUBLE) AS first_x FROM (SELECT l, l % 4 + 1 AS n FROM range(1, 200) AS g(l)) q")
def read_points(t: Tables):
    lines = t.spark.range(1, 200).select(F.col("id").alias("line"), F.concat_ws(" ", F.col("id") + 1000, F.lit(9), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("id") % 4 + 1), lambda i: F.concat_ws(" ", F.col("id") * 3, i, F.lit(1))), " ")).alias("text"))
    p = files.parse_points(F.col("text"))
    return lines.withColumn("p", p).select("line", "p.distance", F.size("p.points").alias("n"), F.col("p.points")[0]["x"].alias("first_x"))


@query("next_unmarked", "SELECT idx, lpad(CAST(idx AS VARCHAR), 5, '0') AS code FROM stops WHERE idx % 7 = 0 AND x <> 0 ORDER BY 2 LIMIT 1")
def next_unmarked(t: Tables):
    rows = t.stops.select("idx", F.lpad(F.col("idx").cast("string"), 5, "0").alias("code"), F.col("x").alias("lng"), F.when(F.col("idx") % 7 != 0, 90.0).alias("heading"))
    return files.next_unmarked(rows).select("idx", "code")


@query("set_heading", "SELECT idx, CASE WHEN idx % 5 = 0 THEN CAST((idx % 500 - 100 + 360) % 360 AS DOUBLE) ELSE 45.0 END AS heading FROM stops")
def set_heading(t: Tables):
    rows = t.stops.select("idx", F.col("idx").alias("code"), F.lit(45.0).alias("heading"))
    marks = t.stops.filter("idx % 5 = 0").select(F.col("idx").alias("code"), (F.col("idx") % 500 - 100).cast("double").alias("heading"))
    return files.set_heading(rows, marks).select("idx", "heading")


@query("known_pairs", "SELECT DISTINCT a, b FROM (SELECT stop AS a, lead(stop) OVER (PARTITION BY service ORDER BY seq, tie, stop) AS b FROM bus_routes) q WHERE b IS NOT NULL AND a IN (SELECT idx FROM stops WHERE idx % 2 = 0) AND b IN (SELECT idx FROM stops WHERE idx % 2 = 0)")
def known_pairs(t: Tables):
    from tripweave.operators.sequences import numbered

    rows = t.bus_routes.withColumn("k", F.struct("seq", "tie", "stop"))
    known = t.stops.filter("idx % 2 = 0").select("idx")
    pairs = headings.stop_pairs(numbered(rows, "service", "k"), "service", "pos")
    return pairs.join(known.withColumnRenamed("idx", "a"), "a", "left_semi").join(known.withColumnRenamed("idx", "b"), "b", "left_semi").select("a", "b")


@query("real_paths", "SELECT service, count(*) AS n FROM (SELECT service, stop, lag(stop) OVER (PARTITION BY service ORDER BY pos) AS p FROM paths) q WHERE p IS DISTINCT FROM stop GROUP BY service HAVING count(*) >= 2")
def real_paths(t: Tables):
    from tripweave.operators.sequences import dedup_successive

    return dedup_successive(t.paths, "service", "pos", "stop").groupBy("service").agg(F.count("*").alias("n")).filter("n >= 2")


@query(
    "throttled_triggers",
    """WITH e AS (SELECT user_id AS id, epoch_ms(ts) AS ms FROM events),
    acc AS (SELECT id, min(ms) AS ms FROM e GROUP BY id UNION ALL
      SELECT id, ms FROM (SELECT acc.id, min(e.ms) AS ms FROM acc JOIN e ON e.id = acc.id AND e.ms >= acc.ms + 3600000 GROUP BY acc.id, acc.ms) AS q)
    SELECT n.id, n, accepted FROM (SELECT id, count(*) AS n FROM e GROUP BY id) AS n JOIN (SELECT id, count(*) AS accepted FROM acc GROUP BY id) AS a ON a.id = n.id""",
    recursive=True,
)
def throttled_triggers(t: Tables):
    log = t.read("events").select(F.col("user_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return triggers.throttle_batch(log, window=3_600_000).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("long")).alias("accepted"))


@query("job_registry", "SELECT job, CASE WHEN s <> 'queued' AND 4000000 - t > 600000 THEN 'not_found' ELSE s END AS status FROM (SELECT l_orderkey AS job, max_by(CASE l_suppkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' ELSE 'succeeded' END, l_linenumber * 1000000 + l_suppkey) AS s, max(CAST(l_linenumber AS BIGINT) * 1000000 + l_suppkey) AS t FROM lineitem GROUP BY 1) q")
def job_registry(t: Tables):
    status = F.element_at(F.array(F.lit("queued"), F.lit("failed"), F.lit("succeeded")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    events = t.read("lineitem").select(F.col("l_orderkey").alias("job"), status.alias("status"), (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_suppkey")).alias("at_ms"))
    return triggers.job_status(events, 4_000_000)


@query("windowed_demand", "SELECT time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_demand(t: Tables):
    events = t.read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return triggers.windowed_demand(events).select(F.col("window.start").alias("start"), "event_type", "n")
