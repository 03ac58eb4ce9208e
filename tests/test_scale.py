"""Queries on tables that grew: against their SQL, and what their plans broadcast."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from tests.conftest import DATA, rows_of
from tripweave.operators import solver, spatial
from tripweave.plans.registry import ORACLES, QUERIES
from tripweave.settings import Settings
from tripweave.sources.driver_tables import leg_ms


def differing(spark, folder, name, **tables):
    """Rows of the query and of its SQL where the ``tables`` (SQL over the smallest ones) stand for their like."""
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS {tables[p.stem].format(t=f"'{p}'") if p.stem in tables else f"SELECT * FROM '{p}'"}")
        con.execute(f"COPY {p.stem} TO '{folder}/{p.name}' (FORMAT parquet)")
    return rows_of(QUERIES[name](spark, str(folder)).toPandas()), rows_of(con.execute(ORACLES[name]).df())


def test_days_without_an_open_day_in_reach_have_no_next_one(spark, tmp_path):
    """Sixty holidays in a row."""
    orders = "SELECT * REPLACE (o_orderkey * 97 AS o_orderkey, TIMESTAMP '1995-01-01' + to_days(CAST(o_orderkey % 60 AS INT)) AS o_orderdate) FROM {t}"
    got, want = differing(spark, tmp_path, "next_working_day", orders=orders)
    assert got == want and 0 < len(got) < 60


def test_every_day_has_a_next_working_day(spark, tmp_path):
    """A hundred and fifty holidays in a row, and orders without a date."""
    day = "CASE WHEN o_orderkey % 150 < 149 THEN TIMESTAMP '1995-01-01' + to_days(CAST(o_orderkey % 150 AS INT)) END"
    got, want = differing(spark, tmp_path, "next_working_day", orders=f"SELECT * REPLACE (o_orderkey * 97 AS o_orderkey, {day} AS o_orderdate) FROM {{t}}")
    assert got == want and len(got) == 149 and {r[0] for r in got} == {"1995-05-30"}


def test_turn_penalty_of_fractions_and_unknown_places(spark, tmp_path):
    """Instructions that take fractions of a millisecond, points without a number or a place."""
    number, part = "CASE WHEN l_orderkey % 5 > 0 OR l_linenumber <> 2 THEN l_linenumber END", "CASE WHEN l_orderkey % 7 > 0 OR l_suppkey % 3 > 0 THEN l_partkey END"
    lineitem = f"SELECT * REPLACE (l_quantity + 0.0005 + l_suppkey % 7 / 10000.0 AS l_quantity, {number} AS l_linenumber, {part} AS l_partkey) FROM {{t}}"
    got, want = differing(spark, tmp_path, "turn_penalty", lineitem=lineitem)
    assert got == want and got


def test_projection_far_from_its_meridian(spark, tmp_path):
    """The last of 480 towns is 60 degrees east of the first."""
    got, want = differing(spark, tmp_path, "svy21_roundtrip", part="SELECT * REPLACE (p_partkey * 5999 AS p_partkey) FROM {t}")
    assert got == want


def test_stops_far_from_all_servers(spark, tmp_path):
    """Towns up to 480 of their widths away from the only one with servers, which stand close together."""
    got, want = differing(spark, tmp_path, "server_stop_sync", part="SELECT * REPLACE (p_partkey * 5999 AS p_partkey) FROM {t}", supplier="SELECT t.* REPLACE (s_suppkey + 10 * i AS s_suppkey) FROM {t} AS t, range(300) AS g(i)")
    assert got == want


def test_nearest_equals_all_pairs(spark):
    """Clusters and single stops over many scales, copies, negative coordinates."""
    rng = random.Random(4)
    spot = lambda: [rng.choice((-1, 1)) * rng.randint(0, 10 ** rng.randint(1, 7)) for _ in range(2)]
    stops = [(i, *(spot() if i % 3 else (1000 + i % 7, -2000))) for i in range(200)]
    points = [(i, *spot()) for i in range(300)]
    got = spatial.nearest(spark.createDataFrame(points, "id long, px long, py long"), spark.createDataFrame(stops, "idx long, x long, y long"))
    d2 = lambda p, s: (p[1] - s[1]) ** 2 + (p[2] - s[2]) ** 2
    want = {p[0]: min((d2(p, s), s[0]) for s in stops) for p in points}
    assert {r["id"]: (r["d2"], r["idx"]) for r in got.collect()} == want


def test_copies_are_as_large_as_they_are(spark):
    """The planner's size of the copies; an explode has that of its input and is broadcast."""
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    df = spark.range(1000)
    assert size(spatial.copies(df, 9, "k")) >= 9 * size(df)
    assert sorted(r["k"] for r in spatial.copies(df.limit(1), 9, "k").collect()) == list(range(9))


def broadcast_joins(spark, monkeypatch, name):
    """Joins of the query that go through the driver, as it ran, where every file counts as large and Spark takes all tables for small; but for calendar days."""
    monkeypatch.setattr("tripweave.sources.driver_tables.BROADCAST_FILE", 0, raising=False)
    monkeypatch.setattr("tripweave.operators.spatial.TOP_CELLS", 0, raising=False)
    df = QUERIES[name](spark, str(DATA))
    df.collect()
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if re.search(r"BroadcastHashJoin \[(?!day|today)", x)]


@pytest.mark.parametrize("name", ["potential_routes", "published_schedule", "suggested_route_best", "solver", "recreate", "candidate_stops", "compatible_requests", "direct_ferry", "migrate_stops", "nearest_stop", "od_combinations", "od_replicas", "top5_ods", "pool_guard"])
def test_growing_tables_are_not_broadcast(spark, monkeypatch, name):
    assert broadcast_joins(spark, monkeypatch, name) == []


@pytest.mark.parametrize("name", ["path_requests", "related_mean", "related_requests", "route_feasible_set"])
def test_all_riders_against_stops_are_not_broadcast(spark, monkeypatch, name):
    """Queries that take every rider, not those near one seed."""
    assert broadcast_joins(spark, monkeypatch, name) == []


def test_a_place_is_tried_once_for_all_its_riders(monkeypatch):
    """Two hundred riders of four places, those of one of them seeds: as many insertions as lists of stops meet places, and the routes of the plain fold."""
    tried = []
    plain = solver.try_insert
    monkeypatch.setattr(solver, "try_insert", lambda ride, *a: (tried.append((ride.stops(), *map(tuple, a[1:3]))), plain(ride, *a))[1])
    s = Settings(top_ods=1, replicas=2, min_requests=1)
    stop = lambda i: {"idx": i, "gi": i, "gj": i % 3}
    ends = [([0, 1], [8, 9]), ([2], [7]), ([30], [60]), ([4], [11])]
    riders = [{"id": i, "days": 1 + i // 4 % 3, "trip": i - i % 2 * (i % 5 == 0), "weight": float(i % 5)} for i in range(200)]
    near = [{"starts": [*map(stop, a)], "ends": [*map(stop, b)], "riders": riders[k::4]} for k, (a, b) in enumerate(ends)]
    row = {"seeds": riders[::4], "jobs": [{"rank": 1, "o": 0, "d": 9}], "ends": [stop(0), stop(9)], "near": near}
    got = [r for rides in solver._grown(row, leg_ms, s) for r in rides]
    assert len(tried) == len(set(tried)) < 40
    at = {x: (x, x % 3) for a, b in ends for x in (*a, *b)}
    costs = solver.Costs({(a, b): float(leg_ms(at[a], at[b])) for a in at for b in at}, s.dwell)
    assert len(got) == 2 * len(riders[::4]) and len({tuple(r[3]) for r in got}) > 1
    for seed, rank, replica, stops, n_up, requests in got:
        firsts = {}
        for r in riders:
            if r["days"] & riders[seed]["days"]:
                firsts.setdefault(r["trip"], r)
        pool = sorted((r for r in firsts.values() if r["id"] != seed), key=lambda r: (r["weight"] <= 0, solver._draw(r["id"] * 1009 + rank * 31 + replica, r["weight"]), r["id"]))
        want = solver.grow(seed, 0, 9, [(r["id"], *ends[r["id"] % 4]) for r in pool], costs, s.budget)
        assert (stops, n_up, requests) == (list(want.stops()), len(want.up), sorted(want.requests()))


def test_an_insertion_walks_the_route_twice_at_most(monkeypatch):
    """Once for all ways into one gap, once for the cheapest into two; what it finds is the best that plain trial finds."""
    rng, walks = random.Random(3), []
    plain = solver.times
    at = {i: (rng.randrange(12), rng.randrange(12)) for i in range(30)}
    requests = {i: (rng.sample(range(30), 3), rng.sample(range(30), 3), 28_800_000.0 + rng.randrange(3) * 900_000) for i in range(40)}
    p = solver.Problem(requests, {(a, b): float(leg_ms(at[a], at[b])) for a in at for b in at})
    routes = solver.recreate(p, [], list(range(20)), 1, "regret")[0]
    found = 0
    for route in routes:
        for req in range(20, 40):
            ups, downs = [p.pickup(req, x) for x in requests[req][0]], [p.dropoff(req, x) for x in requests[req][1]]
            ways = []
            for i in (i for i in range(len(route) - 1) if route[i].stop != route[i + 1].stop):
                for u in ups:
                    for d in downs:
                        cost = p.step(route[i], u) + p.step(u, d) + p.step(d, route[i + 1]) - p.step(route[i], route[i + 1])
                        if cost <= 900_000 and solver.feasible(p, [*route[: i + 1], u, d, *route[i + 1 :]]):
                            ways.append(cost)
            with monkeypatch.context() as m:
                m.setattr(solver, "times", lambda *a: (walks.append(1), plain(*a))[1])
                walks.clear()
                got = solver.cheapest_insertion(p, route, req, 900_000)
            assert len(walks) <= 2 and (got is None or solver.feasible(p, got[1])) and (not ways or got[0] <= min(ways))
            if got is not None and [a.kind for a, b in zip(got[1], got[1][1:]) if a.req == b.req == req]:
                assert ways and got[0] == min(ways)
                found += 1
    assert found > 20


def test_the_worst_ruin_takes_first_and_last_stops():
    """Routes of two stops, where the whole way goes if one of them does."""
    p = solver.Problem({i: ([i], [i + 10], 28_800_000.0) for i in range(4)}, {(i, i + 10): 60_000.0 * (i + 1) for i in range(4)})
    routes = [solver.direct_ferry(p, i, 0) for i in range(4)]
    kept, gone = solver.worst_ruin(p, routes, 2)
    assert gone == {2, 3} and kept == routes[:2]


def test_recreate_puts_all_riders_of_a_group_in(spark, tmp_path):
    """Three riders of one place, against one pass over all of them."""
    from tripweave.plans import solver as plans
    from tripweave.sources.driver_tables import Tables

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (o_orderkey * 20000 + 8 AS o_orderkey) FROM '{DATA}/orders.parquet' WHERE o_orderkey < 3) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{DATA}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    t = Tables(spark, str(tmp_path))
    groups = plans.problem_groups(t).collect()
    want = set()
    for g in groups:
        at = {x["idx"]: (x["gi"], x["gj"]) for r in g["requests"] for x in (*r["starts"], *r["ends"])}
        requests = {r["req"]: ([x["idx"] for x in r["starts"]], [x["idx"] for x in r["ends"]], float(r["time"])) for r in g["requests"]}
        p = solver.Problem(requests, {(a, b): float(leg_ms(at[a], at[b])) for a in at for b in at})
        routes, _ = solver.recreate(p, [], sorted(requests), 1, "regret")
        want |= {(g["grp"], k, i, a.kind, a.req, a.stop) for k, r in enumerate(routes) for i, a in enumerate(r[1:-1])}
    assert {tuple(r) for r in plans.recreate(t).collect()} == want and len({w[:2] for w in want}) < 3


def test_the_solver_runs_a_hundred_rounds(spark, tmp_path):
    """Riders of one time all over a town, against the plain rounds of each group."""
    from tripweave.plans import solver as plans
    from tripweave.sources.driver_tables import Tables

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (o_orderkey * 40 AS o_orderkey) FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{DATA}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    t = Tables(spark, str(tmp_path))
    want = set()
    for g in plans.problem_groups(t).collect():
        at = {x["idx"]: (x["gi"], x["gj"]) for r in g["requests"] for x in (*r["starts"], *r["ends"])}
        requests = {r["req"]: ([x["idx"] for x in r["starts"]], [x["idx"] for x in r["ends"]], float(r["time"])) for r in g["requests"]}
        legs = solver.Placed(at, leg_ms)
        for replica in (1, 2):
            p = solver.Problem(requests, legs, solver.related_by_detour(requests, at, legs, plans.PART))
            routes, bad, value = solver.solve(p, replica, 100)
            want.add((g["grp"], replica, value, len(requests), len(routes)))
    assert {tuple(r) for r in plans.global_solver(t).collect()} == want


@pytest.mark.parametrize("name", ["potential_routes", "suggested_route_best"])
def test_routes_are_grown_and_picked_after_one_shuffle_of_neighbourhoods(spark, name):
    """What a place's routes need comes together once, and nothing is moved after them."""
    df = QUERIES[name](spark, str(DATA))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan.split("MapInArrow")[0]
    assert "REPARTITION_BY_NUM" in plan and "ROUND" not in plan.upper()


def test_routes_are_grown_from_all_pairs_of_ends_and_replicas(spark):
    """As many as the settings say by default."""
    from tripweave.plans import solver as plans
    from tripweave.sources.driver_tables import Tables

    seen = {}
    for r in plans.grown(Tables(spark, str(DATA))).select("seed", "rank", "replica").collect():
        seen.setdefault((r["seed"], r["rank"]), set()).add(r["replica"])
    assert seen and all(v == set(range(1, Settings().replicas + 1)) for v in seen.values()) and plans.GROW.top_ods == Settings().top_ods
