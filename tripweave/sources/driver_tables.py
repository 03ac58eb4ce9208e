"""Stops, travel times, suggestions and paths derived from the star-schema tables.

The same SQL text serves Spark and DuckDB; only the epoch expression differs.
All values are integers, so both engines agree exactly. Every 2,500 parts are the
stops of one more town east of the last, and every 60,000 order keys its riders,
so tables grow in area and not in density.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.sources.shared import merged

STOPS = """SELECT p_partkey AS idx, gj, gi, 250*gi AS x, 250*gj AS y
FROM (SELECT p_partkey, (p_partkey*1237) % 2500 % 50 AS gj, CAST(floor((p_partkey*1237) % 2500 / 50.0) AS BIGINT) + 50*CAST(floor(p_partkey / 2500.0) AS BIGINT) AS gi FROM {part} AS part) AS t"""

#: All pairs of stops of a town.
TRAVEL = """SELECT a.idx AS src, b.idx AS dst, 120000*(abs(a.gi-b.gi)+abs(a.gj-b.gj)) + CASE WHEN b.gj<a.gj THEN 30000 ELSE 0 END AS ms
FROM {stops} AS a JOIN {others} AS b ON floor(a.idx / 2500.0) = floor(b.idx / 2500.0)"""

SUGGESTIONS = """SELECT o_orderkey AS id, (o_orderkey*7919)%5000 + town AS sx, (o_orderkey*104729)%5000 AS sy, 7500+(o_orderkey*1299709)%5000 + town AS ex,
7500+(o_orderkey*15485863)%5000 AS ey, 28800000+(o_orderkey%4)*1800000 AS time_ms, CAST(o_orderkey%128 AS INT) AS days_mask,
CASE WHEN o_custkey%3=0 THEN NULL ELSE o_custkey END AS user_id,
CASE WHEN o_custkey%5=0 THEN NULL ELSE concat('c',CAST(o_custkey AS VARCHAR(20)),'@x') END AS email,
{epoch} AS created_ms, 1+o_orderkey%5 AS weight FROM (SELECT *, 12500*CAST(floor(o_orderkey / 60000.0) AS BIGINT) AS town FROM {orders} AS o) AS orders"""

BUS_ROUTES = "SELECT l_orderkey AS service, l_linenumber AS seq, l_partkey AS stop, l_suppkey AS tie FROM {lineitem} AS lineitem"

#: Legs a router was asked for, with the stops' headings, and what it found: points and instructions. Some legs have no route.
ROUTER_LEGS = "SELECT o_orderkey AS leg, CAST((o_orderkey * 37) % 360 AS DOUBLE) AS start_heading, CAST((o_custkey * 53) % 360 AS DOUBLE) AS end_heading FROM {orders} AS orders"
ROUTER_POINTS = """SELECT l_orderkey AS leg, l_linenumber AS k, 103.7 + ((l_partkey*1237) % 2500 % 50) / 400.0 AS lng, 1.25 + floor((l_partkey*1237) % 2500 / 50.0) / 400.0 AS lat
FROM {lineitem} AS lineitem WHERE l_discount >= 0.02"""
ROUTER_STEPS = """SELECT l_orderkey AS leg, l_linenumber AS k, CAST(l_quantity * 1000 AS BIGINT) AS ms,
CASE l_partkey % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'sharp_right' WHEN 3 THEN 'sharp_left' ELSE 'straight' END AS turn
FROM {lineitem} AS lineitem WHERE l_discount >= 0.02"""

SPARK_EPOCH = "unix_millis(CAST(o_orderdate AS TIMESTAMP))"
DUCK_EPOCH = "epoch_ms(o_orderdate)"
#: DuckDB rounds a fraction that is cast to an integer, Spark cuts it off.
STEP_MS = "l_quantity * 1000"

#: First row of each (service, seq), known stops only, with its place on the path.
PATHS = """SELECT service, stop, CAST(row_number() OVER (PARTITION BY service ORDER BY seq) AS INT) AS pos,
CAST(count(*) OVER (PARTITION BY service) AS INT) AS n FROM (SELECT service, seq, stop, row_number() OVER (PARTITION BY service, seq ORDER BY tie, stop) AS rn
FROM bus_routes) AS r WHERE rn = 1 AND EXISTS (SELECT 1 FROM stops WHERE stops.idx = r.stop)"""

#: Half of each path picks up request 1, 2, .., the other half drops it off.
ACTIVITIES = """SELECT service, pos, stop, CASE WHEN pos <= floor(n/2) THEN 'pickup' ELSE 'dropoff' END AS kind,
CASE WHEN pos <= floor(n/2) THEN pos ELSE pos - CAST(floor(n/2) AS INT) END AS req,
t - CASE WHEN pos <= floor(n/2) THEN 7200000 ELSE 900000 END AS min_t, t AS max_t
FROM (SELECT *, 28800000 + (service % 4)*1800000 + CASE WHEN pos <= floor(n/2) THEN 0 ELSE 3600000 END AS t FROM paths) AS p
WHERE pos <= 2*floor(n/2)"""


def leg_sql(a: str, b: str) -> str:
    """The travel time between two stops as an expression of their numbers, for oracles without a matrix."""
    gi = lambda n: f"(({n} * 1237) % 2500 // 50 + 50 * ({n} // 2500))"
    gj = lambda n: f"(({n} * 1237) % 2500 % 50)"
    return f"(120000 * (abs({gi(a)} - {gi(b)}) + abs({gj(a)} - {gj(b)})) + CASE WHEN {gj(b)} < {gj(a)} THEN 30000 ELSE 0 END)"


def cost_sql(a: str, b: str, dwell: int = 60_000) -> str:
    """A leg with dwell; staying costs nothing."""
    return f"(CASE WHEN {a} = {b} THEN 0 ELSE {leg_sql(a, b)} + {dwell} END)"


def oracle(body: str, recursive: bool = False) -> str:
    """A DuckDB query over the views."""
    views = {
        "stops": STOPS.format(part="part"),
        "travel": TRAVEL.format(stops="stops", others="stops"),
        "suggestions": SUGGESTIONS.format(orders="orders", epoch=DUCK_EPOCH),
        "bus_routes": BUS_ROUTES.format(lineitem="lineitem"),
        "paths": PATHS,
        "acts": ACTIVITIES,
        "router_legs": ROUTER_LEGS.format(orders="orders"),
        "router_points": ROUTER_POINTS.format(lineitem="lineitem"),
        "router_steps": ROUTER_STEPS.format(lineitem="lineitem"),
    }
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in views.items())
    body = body.strip()
    more = body.upper().startswith("WITH ")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{', ' + body[5:].lstrip() if more else ' ' + body}"


def leg_ms(a: tuple[int, int], b: tuple[int, int]) -> int:
    """The travel time between two stops from their places (gi, gj)."""
    return 120_000 * (abs(a[0] - b[0]) + abs(a[1] - b[1])) + (30_000 if b[1] < a[1] else 0)


#: Files larger than this, in bytes, hold more rows than a broadcast should.
BROADCAST_FILE = 1 << 20


class Legs:
    """Travel times worked out from the places of the two stops; serves wherever a matrix (src, dst, ms) does, and makes no pair that the rows don't hold."""

    def __init__(self, stops: DataFrame):
        self.stops = stops

    def __call__(self, rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
        """``rows`` with the time from stop ``a`` to stop ``b`` as ``out``; 0 if either is null, null if one is unknown."""
        return self.many(rows, [(a, b, out)])

    def many(self, rows: DataFrame, legs: list[tuple[str, str, str]]) -> DataFrame:
        """All ``legs`` (a, b, out) at once: each column of stops is looked up once."""
        names = list(dict.fromkeys(n for a, b, _ in legs for n in (a, b)))
        for n in names:
            rows = rows.join(self.stops.select(F.col("idx").alias(n), F.col("gi").alias(f"_i_{n}"), F.col("gj").alias(f"_j_{n}")), n, "left")
        i, j = (lambda n: F.col(f"_i_{n}")), (lambda n: F.col(f"_j_{n}"))
        for a, b, out in legs:
            ms = 120_000 * (F.abs(i(a) - i(b)) + F.abs(j(a) - j(b))) + F.when(j(b) < j(a), 30_000).otherwise(0)
            rows = rows.withColumn(out, F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0).cast("long")).otherwise(ms))
        return rows.drop(*[f"_{k}_{n}" for n in names for k in "ij"])


class Tables:
    """DataFrames of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        """A table; a large one joins by merge, since the size of its file says little about that of its rows."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return merged(df) if int(str(size)) > BROADCAST_FILE else df

    @property
    def stops(self) -> DataFrame:
        return self.spark.sql(STOPS, part=self.read("part"))

    @property
    def travel(self) -> DataFrame:
        """The matrix: as many tasks as cores, each with some of the sources."""
        sources = self.stops.repartition(self.spark.sparkContext.defaultParallelism, "idx")
        return self.spark.sql(TRAVEL, stops=sources, others=self.stops)

    @property
    def legs(self) -> Legs:
        return Legs(self.stops)

    @property
    def suggestions(self) -> DataFrame:
        return self.spark.sql(SUGGESTIONS.replace("{epoch}", SPARK_EPOCH), orders=self.read("orders"))

    @property
    def bus_routes(self) -> DataFrame:
        return self.spark.sql(BUS_ROUTES, lineitem=self.read("lineitem"))

    @property
    def paths(self) -> DataFrame:
        from tripweave.operators.sequences import numbered, uniq_by

        rows = uniq_by(self.bus_routes, ["service", "seq"], ["tie", "stop"])
        known = rows.join(self.stops.withColumnRenamed("idx", "stop").select("stop"), "stop", "left_semi")
        return numbered(known.select("service", "seq", "stop"), "service", "seq").drop("seq")

    def router(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(legs, points, steps) of the router."""
        orders, lineitem = self.read("orders"), self.read("lineitem")
        return self.spark.sql(ROUTER_LEGS, orders=orders), self.spark.sql(ROUTER_POINTS, lineitem=lineitem), self.spark.sql(ROUTER_STEPS.replace(STEP_MS, f"rint({STEP_MS})"), lineitem=lineitem)

    @property
    def activities(self) -> DataFrame:
        return self.spark.sql(ACTIVITIES.replace("FROM paths)", "FROM {paths})"), paths=self.paths)
