"""Queries about suggestions, stops and who can ride together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.operators import demand, spatial
from tripweave.plans.catalog import query
from tripweave.settings import Settings
from tripweave.sources.driver_tables import Tables, cost_sql, leg_sql
from tripweave.sources.shared import cut

S = Settings(start_cluster_radius=1500, end_cluster_radius=1500)
SEED = 8


def similar_sql(s: Settings) -> str:
    """Predicates of ``similar_to`` against the seed row z."""
    return f"""(user_id IS NOT NULL OR email IS NOT NULL OR TRUE) AND created_ms > 0 AND abs(time_ms - z_time) <= {s.time_allowance}
 AND (days_mask & z_days) > 0 AND (sx-z_sx)*(sx-z_sx) + (sy-z_sy)*(sy-z_sy) < {s.start_cluster_radius**2}
 AND (ex-z_ex)*(ex-z_ex) + (ey-z_ey)*(ey-z_ey) < {s.end_cluster_radius**2}"""


SIMILAR = similar_sql(S)
SEEDS = "SELECT id AS seed_id, sx AS z_sx, sy AS z_sy, ex AS z_ex, ey AS z_ey, time_ms AS z_time, days_mask AS z_days FROM suggestions"
SIMILAR_ROWS = f"""alike AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sx, sy, ex, ey, time_ms, email ORDER BY id) AS rn
 FROM suggestions, ({SEEDS} WHERE id = {SEED}) AS z WHERE {SIMILAR}) AS q WHERE rn = 1)"""
def candidates_sql(r: int) -> str:
    """Candidate stops ``cand`` (id, role, idx, ord) of ``riders``: those within r metres of an end, else the nearest."""
    d2 = "(px-x)*(px-x)+(py-y)*(py-y)"
    return f"""ends AS (SELECT id, 'S' AS role, sx AS px, sy AS py FROM riders UNION ALL SELECT id, 'E', ex, ey FROM riders),
 ball AS (SELECT id, role, idx, x, y FROM ends JOIN stops ON x BETWEEN px - {r} AND px + {r} AND y BETWEEN py - {r} AND py + {r} WHERE {d2} <= {r * r}),
 lone AS (SELECT ends.* FROM ends ANTI JOIN ball USING (id, role)),
 cand AS (SELECT id, role, idx, row_number() OVER (PARTITION BY id, role ORDER BY x, y, idx) AS ord FROM ball
   UNION ALL SELECT id, role, idx, 1 FROM (SELECT id, role, idx, row_number() OVER (PARTITION BY id, role ORDER BY {d2}, idx) AS rn FROM lone, stops) AS q WHERE rn = 1)"""


#: Candidate stops of the similar riders and of the seed.
CANDIDATES = candidates_sql(S.start_walking_distance)
ALL_ODS = "SELECT o.id, o.idx AS o, d.idx AS d, o.ord AS o_ord, d.ord AS d_ord FROM cand o JOIN cand d ON o.id = d.id WHERE o.role = 'S' AND d.role = 'E'"
OD = f"ods AS ({ALL_ODS} AND o.idx <> d.idx)"


def compatible_sql(pairs: str) -> str:
    """``compat`` (id, other): of the ``pairs`` those who can share a ride."""
    c = lambda a, b: cost_sql(a, b, S.dwell)
    arms = [f"{c('o', 'c')} + {c('c', 'd')} - {c('o', 'd')}", f"{c('o', 'd')} + {c('d', 'c')} - {c('o', 'c')}", f"{c('c', 'd')} + {c('d', 'o')} - {c('c', 'o')}"]
    return f"""pr AS ({pairs}), po AS ({ALL_ODS} AND o.id IN (SELECT id FROM pr)),
 via AS (SELECT DISTINCT pr.id, cand.idx AS c FROM pr JOIN cand ON cand.id = pr.other),
 fit AS (SELECT id, o, d, c FROM (SELECT DISTINCT id, o, d FROM po) AS po JOIN via USING (id) WHERE least({", ".join(arms)}) < {S.budget:.0f}),
 who AS MATERIALIZED (SELECT pr.id, pr.other, cand.role, cand.idx AS c FROM pr JOIN cand ON cand.id = pr.other),
 compat AS (SELECT DISTINCT id, other FROM (SELECT id, other, o, d FROM fit JOIN who USING (id, c) GROUP BY 1, 2, 3, 4 HAVING bool_or(role = 'S') AND bool_or(role = 'E')) AS q)"""


def seed_row(t: Tables) -> dict:
    row = t.suggestions.filter(F.col("id") == SEED).limit(1).collect()
    return row[0].asDict()


def similar(t: Tables):
    return demand.similar_to(t.suggestions, seed_row(t), S)


@query("live_suggestions", "SELECT id, sx, sy, ex, ey, time_ms, email FROM (SELECT *, row_number() OVER (PARTITION BY sx, sy, ex, ey, time_ms, email ORDER BY id) AS rn FROM suggestions) AS q WHERE rn = 1")
def live_suggestions(t: Tables):
    return demand.distinct_trips(t.suggestions).select("id", "sx", "sy", "ex", "ey", "time_ms", "email")


@query("similar_suggestions", f"WITH {SIMILAR_ROWS} SELECT id, sx, sy, ex, ey, time_ms, days_mask, user_id, email FROM alike")
def similar_suggestions(t: Tables):
    return similar(t).select("id", "sx", "sy", "ex", "ey", "time_ms", "days_mask", "user_id", "email")


BATCH = Settings(start_cluster_radius=400, end_cluster_radius=400)
ALIKE_PAIRS = f"""SELECT seed_id, min(id) AS id FROM suggestions JOIN ({SEEDS}) AS z
    ON sx > z_sx - {BATCH.start_cluster_radius} AND sx < z_sx + {BATCH.start_cluster_radius} WHERE {similar_sql(BATCH)} GROUP BY seed_id, sx, sy, ex, ey, time_ms, email"""


@query("similar_suggestions_batch", f"SELECT seed_id, count(*) AS n, min(id) AS least, max(id) AS most FROM ({ALIKE_PAIRS}) AS q GROUP BY seed_id")
def similar_suggestions_batch(t: Tables):
    """Every suggestion as a seed against all."""
    return demand.similar_pairs(t.suggestions, t.suggestions, BATCH).groupBy("seed_id").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


@query("suggestion_by_id", f"SELECT id, sx, sy, ex, ey, time_ms, user_id, email FROM suggestions WHERE id = {SEED} LIMIT 1")
def suggestion_by_id(t: Tables):
    return t.suggestions.filter(F.col("id") == SEED).limit(1).select("id", "sx", "sy", "ex", "ey", "time_ms", "user_id", "email")


@query("anonymous_gate", "SELECT id FROM suggestions WHERE user_id IS NOT NULL OR email IS NOT NULL")
def anonymous_gate(t: Tables):
    return t.suggestions.filter(F.col("user_id").isNotNull() | F.col("email").isNotNull()).select("id")


@query("mark_trigger", "SELECT id, CASE WHEN id % 7 = 0 THEN 1700000000000 ELSE created_ms END AS last_trigger_ms FROM suggestions")
def mark_trigger(t: Tables):
    rows = t.suggestions.withColumn("last_trigger_ms", F.col("created_ms"))
    return demand.mark_triggered(rows, rows.filter("id % 7 = 0"), 1_700_000_000_000).select("id", "last_trigger_ms")


@query(
    "trigger_verdict",
    """SELECT q.id, CASE WHEN s.id IS NULL THEN 'not_found' WHEN s.user_id IS DISTINCT FROM q.caller THEN 'user_not_authorized'
    WHEN 1000000 - s.time_ms % 1000000 < 20000 THEN 'too_many_requests' ELSE 'ok' END AS verdict
    FROM (SELECT l_orderkey * 2 AS id, max(l_suppkey) AS caller FROM lineitem GROUP BY 1) AS q LEFT JOIN suggestions s ON s.id = q.id""",
)
def trigger_verdict(t: Tables):
    asked = t.read("lineitem").groupBy((F.col("l_orderkey") * 2).alias("id")).agg(F.max("l_suppkey").alias("caller"))
    rows = asked.join(t.suggestions.select("id", "user_id", "time_ms").withColumn("found", F.lit(True)), "id", "left")
    verdict = demand.trigger_verdict(F.coalesce("found", F.lit(False)), F.col("user_id"), F.col("caller"), F.col("time_ms") % 1_000_000, F.lit(1_000_000))
    return rows.select("id", verdict.alias("verdict"))


@query(
    "trigger_throttle",
    """SELECT user_id, count(*) AS triggers, sum(CASE WHEN gap < 20000 THEN 1 ELSE 0 END) AS throttled FROM
    (SELECT user_id, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts)) AS gap FROM events) AS q GROUP BY user_id""",
)
def trigger_throttle(t: Tables):
    from tripweave.operators.sequences import gap_to_previous

    log = t.read("events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    gaps = gap_to_previous(log, "user_id", "at")
    return gaps.groupBy("user_id").agg(F.count("*").alias("triggers"), F.sum(F.when(F.col("gap") < 20_000, 1).otherwise(0)).alias("throttled"))


@query(
    "walk_ball",
    f"""SELECT id, idx, row_number() OVER (PARTITION BY id ORDER BY x, y, idx) AS ord FROM suggestions, stops
    WHERE (sx-x)*(sx-x)+(sy-y)*(sy-y) <= {S.start_walking_distance**2}""",
)
def walk_ball(t: Tables):
    points = t.suggestions.select("id", F.col("sx").alias("px"), F.col("sy").alias("py"))
    return spatial.nearby_stops(points, t.stops, S.start_walking_distance).select("id", "idx", "ord")


@query(
    "nearest_stop",
    """SELECT id, best % 10000000 AS idx, best // 10000000 AS d2 FROM (SELECT id, min(((sx-x)*(sx-x)+(sy-y)*(sy-y)) * 10000000 + idx) AS best FROM suggestions, stops GROUP BY id) AS q""",
)
def nearest_stop(t: Tables):
    points = t.suggestions.select("id", F.col("sx").alias("px"), F.col("sy").alias("py"))
    return spatial.nearest(points, t.stops).select("id", "idx", "d2")


@query("candidate_stops", f"WITH {SIMILAR_ROWS}, riders AS (SELECT * FROM alike), {CANDIDATES} SELECT id, role, idx, ord FROM cand")
def candidate_stops(t: Tables):
    return demand.candidate_stops(similar(t), t.stops, S).select("id", "role", "idx", "ord")


@query("candidate_counts", f"WITH {SIMILAR_ROWS}, riders AS (SELECT * FROM alike), {CANDIDATES} SELECT role, round(avg(n), 6) AS mean_stops FROM (SELECT id, role, count(*) AS n FROM cand GROUP BY 1, 2) AS q GROUP BY role")
def candidate_counts(t: Tables):
    n = demand.candidate_stops(similar(t), t.stops, S).groupBy("id", "role").agg(F.count("*").alias("n"))
    return n.groupBy("role").agg(F.round(F.avg("n"), 6).alias("mean_stops"))


@query("od_combinations", f"WITH {SIMILAR_ROWS}, riders AS (SELECT * FROM alike), {CANDIDATES}, {OD} SELECT id, o, d, o_ord, d_ord FROM ods")
def od_combinations(t: Tables):
    return demand.od_pairs(demand.candidate_stops(similar(t), t.stops, S))


@query("top5_ods", f"WITH {SIMILAR_ROWS}, riders AS (SELECT * FROM alike), {CANDIDATES}, {OD}, r AS (SELECT id, o, d, {leg_sql('o', 'd')} AS ms, row_number() OVER (PARTITION BY id ORDER BY {leg_sql('o', 'd')}, o_ord, d_ord) AS rank FROM ods) SELECT id, o, d, ms, rank FROM (SELECT *, min(ms) OVER (PARTITION BY id) AS best FROM r WHERE rank <= {S.top_ods}) AS q WHERE ms - best < {S.suboptimal_allowance}")
def top5_ods(t: Tables):
    return demand.top_ods(t.legs, demand.od_pairs(demand.candidate_stops(similar(t), t.stops, S)), S)


@query("od_replicas", f"WITH {SIMILAR_ROWS}, riders AS (SELECT * FROM alike), {CANDIDATES}, {OD}, r AS (SELECT id, o, d, row_number() OVER (PARTITION BY id ORDER BY {leg_sql('o', 'd')}, o_ord, d_ord) AS rank FROM ods WHERE id = {SEED}) SELECT id, o, d, rank, replica FROM r, range(1, {S.replicas + 1}) AS g(replica) WHERE rank <= {S.top_ods}")
def od_replicas(t: Tables):
    loose = Settings(suboptimal_allowance=1 << 60)
    cand = demand.candidate_stops(similar(t).filter(F.col("id") == SEED), t.stops, S)
    best = demand.top_ods(t.legs, demand.od_pairs(cand), loose)
    return best.withColumn("replica", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(S.replicas).cast("long")))).select("id", "o", "d", "rank", "replica")


COMPATIBLE = f"WITH {SIMILAR_ROWS}, riders AS (SELECT * FROM alike), {CANDIDATES}, {compatible_sql(f'SELECT CAST({SEED} AS BIGINT) AS id, id AS other FROM riders WHERE id <> {SEED}')}"


def compatible(t: Tables):
    riders = cut(similar(t).select("id", "sx", "sy", "ex", "ey"))
    cand = cut(demand.candidate_stops(riders, t.stops, S))
    return demand.compatible(t.legs, cand, riders.filter(F.col("id") != SEED).select(F.lit(SEED).cast("long").alias("id"), F.col("id").alias("other")), S)


@query("compatible_requests", f"{COMPATIBLE} SELECT id, other FROM compat")
def compatible_requests(t: Tables):
    return compatible(t)


@query("pool_guard", f"{COMPATIBLE} SELECT count(*) AS n, CASE WHEN count(*) < {S.min_requests} THEN 'too_few_suggestions' ELSE 'ok' END AS status FROM compat")
def pool_guard(t: Tables):
    n = compatible(t).agg(F.count("*").alias("n"))
    return n.withColumn("status", F.when(F.col("n") < S.min_requests, "too_few_suggestions").otherwise("ok"))


NEAR = Settings(start_walking_distance=250, end_walking_distance=250)
START_R, END_R = 300, 600
NEAR_PAIRS = f"""SELECT a.id, b.id AS other FROM suggestions a JOIN suggestions b ON b.sx BETWEEN a.sx - {START_R} AND a.sx + {START_R} AND a.id <> b.id
    AND (a.sx-b.sx)*(a.sx-b.sx)+(a.sy-b.sy)*(a.sy-b.sy) <= {START_R**2} AND (a.ex-b.ex)*(a.ex-b.ex)+(a.ey-b.ey)*(a.ey-b.ey) <= {END_R**2}"""
RELATED = f"WITH riders AS (SELECT * FROM suggestions), {candidates_sql(NEAR.start_walking_distance)}, {compatible_sql(NEAR_PAIRS)}"


def related_riders(t: Tables):
    riders = t.suggestions.select("id", "sx", "sy", "ex", "ey")
    return demand.related_compatible(t.legs, riders, t.stops, START_R, END_R, NEAR)


@query("related_requests", f"{RELATED} SELECT id, count(*) AS n, min(other) AS least, max(other) AS most FROM compat GROUP BY id")
def related_requests(t: Tables):
    return related_riders(t).groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("least"), F.max("other").alias("most"))


@query("related_mean", f"{RELATED} SELECT (SELECT count(*) FROM riders) AS riders, count(*) AS pairs, round(count(*) / CAST((SELECT count(*) FROM riders) AS DOUBLE), 6) AS mean_related FROM compat")
def related_mean(t: Tables):
    n = t.suggestions.count()
    return related_riders(t).agg(F.lit(n).cast("long").alias("riders"), F.count("*").alias("pairs")).withColumn("mean_related", F.round(F.try_divide("pairs", F.lit(float(n))), 6))


PATH = "SELECT CAST(floor(idx / 40.0) AS INT) AS path_id, CAST(row_number() OVER (PARTITION BY floor(idx / 40.0) ORDER BY x + y, idx) AS INT) AS seq, x, y FROM stops"


def stop_paths(t: Tables):
    return t.spark.sql(PATH.replace("FROM stops", "FROM {stops}"), stops=t.stops)


@query(
    "path_requests",
    f"""WITH path AS ({PATH}), b AS (SELECT path_id, id, min(seq) AS board FROM suggestions, path WHERE (sx-x)*(sx-x)+(sy-y)*(sy-y) <= {1000**2} GROUP BY 1, 2),
    a AS (SELECT path_id, id, max(seq) AS alight FROM suggestions, path WHERE (ex-x)*(ex-x)+(ey-y)*(ey-y) <= {1000**2} GROUP BY 1, 2)
    SELECT path_id, id, board, alight FROM b JOIN a USING (path_id, id) WHERE board < alight""",
)
def path_requests(t: Tables):
    return demand.served_by(stop_paths(t), t.suggestions, 1000)


#: Riders of one square of 400 m at each end share a route.
SHARED = "concat(" + ", '/', ".join(f"CAST(CAST(floor({c} / 400.0) AS BIGINT) AS VARCHAR(20))" for c in ("sx", "sy", "ex", "ey")) + ")"


@query(
    "route_feasible_set",
    f"""{RELATED}, rr AS (SELECT id, {SHARED} AS route FROM suggestions), n AS (SELECT route, count(*) AS n FROM rr GROUP BY 1)
    SELECT route, other FROM (SELECT route, other, count(*) AS k FROM rr JOIN compat USING (id) GROUP BY 1, 2) AS q JOIN n USING (route) WHERE k = n""",
)
def route_feasible_set(t: Tables):
    return demand.on_every(t.suggestions.select("id", F.expr(SHARED).alias("route")), related_riders(t))


@query(
    "server_stop_sync",
    """WITH server AS (SELECT s_suppkey AS sid, 250*((s_suppkey*1237)%50) + s_suppkey%7 AS x, 250*(CAST(floor(((s_suppkey*1237)%2500)/50.0) AS BIGINT)) AS y FROM supplier),
    r AS (SELECT idx, sid, (stops.x-server.x)*(stops.x-server.x)+(stops.y-server.y)*(stops.y-server.y) AS d2 FROM stops, server),
    b AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d2, sid) AS rn FROM r)
    SELECT idx, CASE WHEN d2 < 20 THEN sid END AS server_id, CASE WHEN d2 < 20 THEN 'reuse' ELSE 'create' END AS action FROM b WHERE rn = 1""",
)
def server_stop_sync(t: Tables):
    server = t.spark.sql("SELECT s_suppkey AS idx, 250*((s_suppkey*1237)%50) + s_suppkey%7 AS x, 250*(CAST(floor(((s_suppkey*1237)%2500)/50.0) AS BIGINT)) AS y FROM {s}", s=t.read("supplier"))
    points = t.stops.select(F.col("idx").alias("id"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = spatial.nearest(points, server)
    reuse = F.col("d2") < 20
    return near.select(F.col("id").alias("idx"), F.when(reuse, F.col("idx")).alias("server_id"), F.when(reuse, "reuse").otherwise("create").alias("action"))


@query("user_role_counts", "SELECT time_ms, count(*) AS n, count(DISTINCT user_id) AS users, sum(weight) AS weight FROM suggestions GROUP BY time_ms")
def user_role_counts(t: Tables):
    return t.suggestions.groupBy("time_ms").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("weight").alias("weight"))
