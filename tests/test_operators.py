"""Literal vectors and invariants of the transit operators."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.functions import geo
from tripweave.operators import demand, grid, headings, routes, sequences, solver, spatial
from tripweave.settings import HEADING_PENALTY, TURN_COSTS, Settings
from tripweave.sources import files
from tripweave.streaming import triggers


def test_optimistic_schedule(spark):
    planned = [100000, 150000, 300000, 500000, 480000]
    df = spark.createDataFrame([(1, i, t, i < 4) for i, t in enumerate(planned)], "r int, i int, t long, up boolean")
    got = sequences.optimistic_schedule(df, "r", "i", "t", "up").orderBy("i").collect()
    assert [x["scheduled"] for x in got] == [100000, 160000, 220000, 320000, 480000]


@pytest.mark.parametrize(
    "windows,step,low,high",
    [
        ([(1000, 10000), (2000, 9000), (3000, 8000), (4000, 7000)], 0, [1000, 2000, 3000, 4000], [7000] * 4),
        ([(1000, 15000), (2000, 14000), (3000, 13000), (4000, 12000)], 1500, [1000, 2500, 4000, 5500], [7500, 9000, 10500, 12000]),
    ],
)
def test_feasible_times(spark, windows, step, low, high):
    df = spark.createDataFrame([(1, i, a, b, None if i == 0 else step) for i, (a, b) in enumerate(windows)], "r int, i int, min_t long, max_t long, step long")
    got = sequences.feasible_times(df, "r", "i", "step").orderBy("i").collect()
    assert [x["earliest"] for x in got] == low and [x["latest"] for x in got] == high
    assert sequences.feasible(sequences.feasible_times(df, "r", "i", "step"), "r").first()["status"] == "ok"


@pytest.mark.parametrize(
    "gap1,gap2,edited,piece",
    [
        ((2, 3), (2, 3), [1, 2, 6, 7, 3, 4, 5, 6], [2, 6, 7, 3]),
        ((2, 3), (3, 4), [1, 2, 6, 3, 7, 4, 5, 6], [2, 6, 3, 7, 4]),
        ((2, 3), (5, 6), [1, 2, 6, 3, 4, 5, 7, 6], [2, 6, 3, 4, 5, 7, 6]),
        ((2, 3), (4, 5), [1, 2, 6, 3, 4, 7, 5, 6], [2, 6, 3, 4, 7, 5]),
        ((2, 4), (4, 5), None, None),
    ],
)
def test_list_edits(spark, gap1, gap2, edited, piece):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], list(gap1), list(gap2))], "l array<int>, g1 array<int>, g2 array<int>")
    args = (F.col("l"), F.lit(6), F.lit(7), F.col("g1"), F.col("g2"))
    row = df.select(sequences.insert_two(*args).alias("e"), sequences.inserted_window(*args).alias("p")).first()
    assert row["e"] == edited and row["p"] == piece


def test_grid_keys(spark):
    row = spark.range(1).select(*[grid.key(F.lit(v), 0.2) for v in (0.11, 0.29, 0.31, -0.5)], grid.centre(F.lit(5), 0.2)).first()
    assert list(row)[:3] == [1, 1, 2] and abs(row[4] - 1.0) < 1e-12


def test_cluster_of_four(spark):
    df = spark.createDataFrame([(10.1, 9.9, "Alvin"), (17.8, 10.0, "Benny"), (10.2, 17.8, "Carlos"), (32.1, 13.2, "Dick")], "x double, y double, payload string")
    got = {}
    for r in grid.cluster(df, 10.0, 1.0).collect():
        got.setdefault((r["cx"], r["cy"]), set()).add(r["payload"])
    assert got == {(32.0, 13.0): {"Dick"}, (10.0, 10.0): {"Alvin", "Benny", "Carlos"}}


def greedy_clusters(points, r, g):
    cells = {}
    for p in set(points):
        cells.setdefault((math.floor(p[0] / g + 0.5), math.floor(p[1] / g + 0.5)), []).append(p)
    near = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) * g * g <= r * r
    out, left = {}, set(cells)
    while left:
        score = {c: sum(len(cells[o]) for o in left if near(c, o)) for c in left}
        top = max(left, key=lambda c: (score[c], c))
        took = {o for o in left if near(top, o)}
        out[top] = sorted(p for o in took for p in cells[o])
        left -= took
    return out


def test_clusters_equal_greedy(spark):
    rng = random.Random(3)
    points = [(round(rng.random() * 60, 2), round(rng.random() * 60, 2), i) for i in range(120)]
    df = spark.createDataFrame(points, "x double, y double, payload int")
    got = {}
    for r in grid.cluster(df, 8.0, 1.0).collect():
        got.setdefault((round(r["cx"]), round(r["cy"])), []).append((r["x"], r["y"], r["payload"]))
    assert {k: sorted(v) for k, v in got.items()} == greedy_clusters(points, 8.0, 1.0)


def test_clusters_query_equals_greedy(spark):
    """All clusters of the query over every suggestion."""
    from tests.conftest import DATA
    from tripweave.plans import functions as plans
    from tripweave.sources.driver_tables import Tables

    t = Tables(spark, str(DATA))
    points = [(r["sx"], r["sy"], r["id"]) for r in t.suggestions.collect()]
    want = {k: len(v) for k, v in greedy_clusters(points, 1000.0, 90.0).items()}
    assert {(round(r["cx"] / 90), round(r["cy"] / 90)): r["n"] for r in plans.clusters(t).collect()} == want


def test_projection(spark):
    x, y = geo.to_svy21(F.lit(103 + 50 / 60), F.lit(1 + 22 / 60))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(row["x"] - 28001.642) < 1e-6 and abs(row["y"] - 38744.572) < 1e-6


def test_nearest_fallback_and_empty(spark):
    stops = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0)], "idx long, x double, y double")
    points = spark.createDataFrame([(7, 100000.0, 0.0), (8, 1.0, 0.0), (9, None, 0.0), (10, float("nan"), 0.0)], "id long, px double, py double")
    got = {(r["id"], r["idx"]) for r in spatial.stops_or_nearest(points, stops, 5.0).collect()}
    assert got == {(7, 2), (8, 1)}
    assert spatial.stops_or_nearest(points, stops.limit(0), 5.0).count() == 0


def test_path_direction(spark):
    riders = spark.createDataFrame([(1, 0, 0, 30, 0), (2, 10, 0, 20, 0)], "id long, sx long, sy long, ex long, ey long")
    stops = [(0, 0), (10, 0), (20, 0), (30, 0)]
    path = lambda order: spark.createDataFrame([(1, k, *stops[i]) for k, i in enumerate(order)], "path_id int, seq int, x long, y long")
    assert {r["id"] for r in demand.served_by(path([0, 1, 2, 3]), riders, 1).collect()} == {1, 2}
    assert demand.served_by(path([2, 3, 0, 1]), riders, 1).filter("id = 1").count() == 0


def test_runs_of_five(spark):
    df = spark.createDataFrame([(1, i, i // 5) for i in range(50)], "p int, i int, k int")
    got = sequences.runs(df, "p", "i", "k").groupBy("run").count().collect()
    assert sorted(r["count"] for r in got) == [5] * 10


def test_overlap_of_empty_is_null(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(routes.overlap(F.col("a"), F.col("b"))).collect()] == [0.5, None]


def test_weighted_order_distribution(spark):
    n = 200
    rows = [(part, i + part * 1000, float(n - 1) if i == 0 else 1.0) for part in range(400) for i in range(n)]
    got = solver.weighted_order(spark.createDataFrame(rows, "p int, id long, w double"), "p", "id", "w").filter("place = 1 AND w > 1").count()
    assert 150 <= got <= 250


def line_costs(n=40):
    return solver.Costs({(a, b): abs(a - b) * 10_000.0 for a in range(n) for b in range(n)}, 60_000)


def test_insertions_keep_the_budget():
    c, budget = line_costs(), 900_000
    ride = solver.Ride([[0, [1]]], [[30, [1]]])
    assert solver.try_insert(ride, 2, [0, 5], [30], c, budget).requests() == {1, 2}
    got = solver.try_insert(ride, 3, [10], [20], c, budget)
    assert got.stops() == (0, 10, 20, 30) and got.requests() == {1, 3}
    assert solver.try_insert(ride, 4, [10], [20], c, 10.0) is None
    assert solver.grow(1, 0, 30, [(4, [10], [20])], c, 10.0).stops() == (0, 30)


def small_problem(n=14, seed=1):
    rng = random.Random(seed)
    edges = {(a, b): abs(a - b) * 30_000.0 for a in range(30) for b in range(30)}
    reqs = {i: (sorted({rng.randrange(12), rng.randrange(12)}), sorted({rng.randrange(18, 30), rng.randrange(18, 30)}), 28_800_000.0) for i in range(n)}
    return solver.Problem(reqs, edges, {i: set(range(n)) - {i} for i in range(n)})


@pytest.mark.parametrize("policy", ["random", "regret", "related"])
def test_nobody_is_lost(policy):
    p = small_problem()
    routes_, bad = solver.recreate(p, [], sorted(p.requests), 5, policy)
    for k in range(3):
        served = set().union(*map(solver._requests, routes_), set(bad))
        assert served == set(p.requests)
        assert all(solver.feasible(p, r) for r in routes_)
        kept, gone = solver.ruin(p, routes_, k)
        alive = set().union(set(), *map(solver._requests, kept))
        assert not alive & gone and alive | gone | set(bad) == set(p.requests)
        routes_, bad = solver.recreate(p, kept, sorted(gone | set(bad)), k, policy)


def test_tweak_keeps_riders_and_stays_feasible():
    p = small_problem()
    for r in solver.recreate(p, [], sorted(p.requests), 5)[0]:
        better = solver.tweak(p, r)
        assert solver.feasible(p, better) and solver._requests(better) == solver._requests(r) and len(better) == len(r)
        assert len(solver.grouped(better)) <= len(solver.grouped(r))


def test_solver_is_repeatable():
    p = small_problem()
    assert solver.solve(p, 3, 5)[2] == solver.solve(p, 3, 5)[2]


def test_unique_rides():
    rides = [((1,), frozenset({1, 2})), ((2,), frozenset({1, 2, 3})), ((3,), frozenset({9})), ((4,), frozenset({9}))]
    assert set(solver.unique_rides(rides, 0.3)) == {1, 3}


def test_matching_equals_greedy(spark):
    rng = random.Random(9)
    pairs = [(a, b, float(rng.randrange(5))) for a in range(15) for b in range(15) if rng.random() < 0.4]
    want, used_a, used_b = set(), set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if a not in used_a and b not in used_b:
            want.add((a, b)), used_a.add(a), used_b.add(b)
    got = headings.match_one_to_one(spark.createDataFrame(pairs, "old long, new long, d double"))
    assert {(r["old"], r["new"]) for r in got.collect()} == want


def test_similar_flags(spark):
    df = spark.createDataFrame([(1, 0, 0, 9, 9, 1000, 1, None, None, 5), (2, 0, 0, 9, 9, 1000, 2, 3, None, 5)], "id long, sx long, sy long, ex long, ey long, time_ms long, days_mask int, user_id long, email string, created_ms long")
    seed = dict(sx=0, sy=0, ex=9, ey=9, time_ms=1000, days_mask=3)
    assert demand.similar_to(df, seed, Settings()).count() == 1  # same trip and rider key
    assert {r["id"] for r in demand.similar_to(df, seed, Settings(include_anonymous=False)).collect()} == {2}
    assert demand.similar_to(df, seed | {"days_mask": 4}, Settings()).count() == 0


def test_stop_file(spark, tmp_path):
    rows = [{"Latitude": 1.3, "Longitude": 103.8, "Heading": 90.0, "Description": "a", "RoadName": "r", "BusStopCode": "1"}, {"Latitude": 0.0, "Longitude": 103.8, "Description": "b", "RoadName": "r"}, {"Latitude": 1.4, "Longitude": 103.9, "Description": "c", "RoadName": "s"}]
    (tmp_path / "stops.json").write_text(json.dumps(rows))
    got = files.read_stops(spark, str(tmp_path / "stops.json")).orderBy("idx").collect()
    assert [(r["idx"], r["description"]) for r in got] == [(0, "a"), (2, "c")] and math.isnan(got[1]["heading"])


def test_paged_export(spark, tmp_path):
    for n, page in enumerate([[{"a": 1}, {"a": 2}], [{"a": 3}], [], [{"a": 9}]]):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"value": page}))
    assert sorted(r["a"] for r in files.read_paged(spark, str(tmp_path), "a int").collect()) == [1, 2, 3]


def test_pages_of_prefixes(spark, tmp_path):
    for prefix, pages in {"00": [[{"a": 1}], [{"a": 2}], []], "01": [[]], "02": [[{"a": 3}]]}.items():
        for n, page in enumerate(pages):
            (tmp_path / f"{prefix}-{n}.json").write_text(json.dumps({"results": page}))
    got = files.read_paged(spark, str(tmp_path), "a int", field="results", prefixes=[f"{k:02d}" for k in range(4)])
    assert sorted(r["a"] for r in got.collect()) == [1, 2, 3]


def test_jdbc(spark, tmp_path):
    url, table = f"jdbc:derby:{tmp_path}/db;create=true", "suggestions"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("CAST(id AS INT) AS id", "CAST(id % 7 AS INT) AS k").write.jdbc(url, table, properties={"driver": driver})
    got = files.read_jdbc(spark, url, table, "id", (0, 100), 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.filter("k = 3").count() == 14


def test_router_answers(spark, tmp_path):
    rows = [
        {"src": 1, "dst": 2, "time": 9000, "points": [[1.30, 103.80], [1.31, 103.80], [1.31, 103.81]], "instructions": [{"sign": "left", "time": 4000}, {"sign": "straight", "time": 5000}]},
        {"src": 2, "dst": 1, "points": None, "instructions": None},
        {"src": 1, "dst": 3, "time": 10, "points": [[1.3, 103.8]], "instructions": [{"sign": "right", "time": 10}]},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    legs, points, steps = files.read_router(spark, str(tmp_path / "r.json"))
    key = F.concat_ws("-", "src", "dst")
    named = legs.select(key.alias("leg"), F.lit(0.0).alias("start_heading"), F.lit(0.0).alias("end_heading"))
    penalised = lambda n: {r["leg"]: r["ms"] for r in headings.penalised_times(n, points.withColumn("leg", key), steps.withColumn("leg", key), TURN_COSTS, HEADING_PENALTY).collect()}
    # Leaves to the north as it should, arrives to the east instead of the north.
    assert penalised(named) == {"1-2": 9000 + 5000 + 600_000, "2-1": math.inf, "1-3": 10 + 30_000}
    assert penalised(named.withColumn("end_heading", F.lit(90.0)))["1-2"] == 14_000


def test_directions(spark, tmp_path):
    legs = [{"duration_in_traffic": {"value": 60}}, {"duration_in_traffic": {"value": 30}}]
    rows = [{"src": 1, "dst": 2, "routes": [{"legs": legs, "overview_polyline": {"points": "_p~iF~ps|U"}}, {"legs": []}]}, {"src": 2, "dst": 1, "routes": []}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    got = {r["src"]: (r["ms"], r["polyline"]) for r in files.read_directions(spark, str(tmp_path / "d.json")).collect()}
    assert got == {1: (90_000, "_p~iF~ps|U"), 2: (None, None)}


def test_annotation_copy(tmp_path):
    (tmp_path / "stops.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    copy = files.annotation_file(str(tmp_path / "stops.json"))
    assert files.annotate(copy, 1, 90) == {"a": 2, "Heading": 90} and files.annotation_file(str(tmp_path / "stops.json")) == copy
    assert json.loads(open(copy).read()) == [{"a": 1}, {"a": 2, "Heading": 90}]
    with pytest.raises(TypeError):
        files.annotate(copy, 0, "north")
    open(copy, "w").write("[]")
    with pytest.raises(ValueError):
        files.annotation_file(str(tmp_path / "stops.json"))


PLACE = {10: (0, 0), 20: (10, 0), 12: (2, 0), 18: (8, 0), 8: (-2, 0), 22: (12, 0), 90: (-50, 40)}


def place_leg(a, b):
    """10 s a place along the streets, 3 s more toward lower numbers."""
    (x, y), (u, v) = PLACE.get(a, (a, 0)), PLACE.get(b, (b, 0))
    return (abs(x - u) + abs(y - v)) * 10_000 + (3_000 if b < a else 0)


def travel_of(spark, stops):
    return spark.createDataFrame([(a, b, place_leg(a, b)) for a in stops for b in stops if a != b], "src long, dst long, ms long")


def test_compatible_takes_three_ways(spark):
    """Riders within the trip, around it and with the same ends fit; one whose end is far off doesn't; the budget is exclusive."""
    s = Settings(max_detour_minutes=2.0, dwell=1_000)
    rows = [(1, "S", 10), (1, "E", 20), (2, "S", 12), (2, "E", 18), (3, "S", 8), (3, "E", 22), (4, "S", 12), (4, "E", 90), (5, "S", 10), (5, "E", 20)]
    cand = spark.createDataFrame([(i, r, x, 1) for i, r, x in rows], "id long, role string, idx long, ord int")
    pairs = spark.createDataFrame([(1, k) for k in (2, 3, 4, 5)], "id long, other long")
    stops = {x for _, _, x in rows}
    c = lambda a, b: 0 if a == b else place_leg(a, b) + s.dwell
    d = lambda a, via, b: c(a, via) + c(via, b) - c(a, b)
    ways = lambda x: (d(10, x, 20), d(10, 20, x), d(x, 20, 10))
    want = {i for i in (2, 3, 4, 5) if all(min(ways(x)) < s.budget for k, _, x in rows if k == i)}
    assert want == {2, 3, 5}
    got = {r["other"] for r in demand.compatible(travel_of(spark, stops), cand, pairs, s).collect()}
    assert got == want
    # Beyond the destination only the second way is short, before the origin the first or the third.
    assert ways(22)[1] == min(ways(22)) < ways(22)[0]
    tight = Settings(max_detour_minutes=max(min(ways(8)), min(ways(22))) / 60_000, dwell=1_000)
    assert demand.compatible(travel_of(spark, stops), cand, pairs.filter("other = 3"), tight).count() == 0


def test_od_detour(spark):
    """All four ways of sharing, against sums over lists of stops."""
    rng = random.Random(4)
    rows = [(i, *[rng.randrange(12) for _ in "abcd"]) for i in range(200)]
    c = lambda *s: sum(0 if a == b else place_leg(a, b) + 60_000 for a, b in zip(s[:-1], s[1:], strict=True))
    df = spark.createDataFrame(rows, "i long, a long, b long, c long, d long")
    got = routes.with_costs(df, travel_of(spark, range(12)), 60_000, "ab", "ac", "cb", "ca", "ad", "db", "bd", "cd").select("i", routes.od_detour("a", "b", "c", "d").alias("x")).collect()
    for r in got:
        _, a, b, x, d = rows[r["i"]]
        ways = (c(a, x, d, b) - c(a, b), c(x, a, b, d) - c(x, d), max(c(a, x, b) - c(a, b), c(x, b, d) - c(x, d)), max(c(x, a, d) - c(x, d), c(a, d, b) - c(a, b)))
        assert r["x"] == min(ways)


def test_heading_vector_uses_the_mean_latitude(spark):
    x, y = spark.range(1).select(*geo.heading_vector(F.lit(10.0), F.lit(0.0), F.lit(11.0), F.lit(60.0))).first()
    assert x == pytest.approx(math.radians(1) * math.cos(math.radians(30))) and y == pytest.approx(math.radians(60))


def test_projected_heading(spark):
    """Within the projection's town the projected vector has the length on the sphere and the bearing of the plane."""
    a, b = (F.lit(103.80), F.lit(1.30)), (F.lit(103.81), F.lit(1.305))
    x, y, u, v, d = spark.range(1).select(*geo.svy21_vector(*a, *b), *geo.heading_vector(*a, *b), geo.haversine(*a, *b)).first()
    assert math.hypot(x, y) == pytest.approx(d, rel=5e-3) and math.atan2(x, y) == pytest.approx(math.atan2(u, v), abs=5e-3)


def test_migration_is_measured_on_the_sphere(spark):
    """At 60 degrees north a degree of longitude is half as long; a stop's own code is at -0.01."""
    metre = 1 / 111_194.9
    old = spark.createDataFrame([(1, 10.0, 60.0), (2, 10.1, 60.0), (3, 10.2, 60.0)], "old long, lng double, lat double")
    new = spark.createDataFrame([(1, 10.0 + 30 * metre, 60.0), (7, 10.1 + 50 * metre, 60.0), (8, 10.2, 60.0 + 19 * metre)], "new long, lng double, lat double")
    got = {(r["old"], r["new"]): r["d"] for r in headings.match_candidates(old, new, 20.0).collect()}
    assert set(got) == {(1, 1), (3, 8)} and got[1, 1] == -0.01 and got[3, 8] == pytest.approx(19, abs=0.01)


def test_next_working_day_after_long_holidays(spark):
    import datetime as dt

    start = dt.date(2024, 1, 1)
    closed = spark.createDataFrame([(start + dt.timedelta(days=k),) for k in range(1, 100)], "day date")
    days = spark.createDataFrame([(start,), (dt.date(2024, 6, 7),)], "today date")
    got = {r["today"]: r["next_day"] for r in headings.next_working_day(days, closed).collect()}
    assert got == {start: dt.date(2024, 4, 10), dt.date(2024, 6, 7): dt.date(2024, 6, 10)}


def test_overlap_by_prefix_equals_all_pairs(spark):
    rng = random.Random(6)
    sets = {i: {rng.choice([0, 1, 2, *range(40)]) for _ in range(rng.randint(1, 9))} for i in range(80)}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "service long, stop long")
    for limit in (0.0, 0.3, 0.5, 0.99):
        got = {(r["a"], r["b"]): r["share"] for r in routes.similar_routes(df, limit).collect()}
        share = {(a, b): len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b}
        assert got == {k: v for k, v in share.items() if v > limit}


def test_alternative_stops_of_both_ends(spark):
    acts = spark.createDataFrame([(1, 0, 10, "pickup", 1), (1, 1, 11, "pickup", 2), (1, 2, 12, "dropoff", 1), (1, 3, 13, "dropoff", 2)], "service long, pos int, stop long, kind string, req int")
    wanted = spark.createDataFrame([(1, 1, "S", 11), (1, 1, "S", 12), (1, 1, "S", 10), (1, 1, "E", 13), (1, 2, "E", 12), (1, 2, "S", 13)], "service long, req int, role string, idx long")
    got = {(r["req"], r["kind"], r["alternative"]) for r in routes.alternative_stops(acts, wanted).collect()}
    assert got == {(1, "pickup", 11), (1, "dropoff", 13), (2, "dropoff", 12)}


def drive(p, *halts):
    """A route of halts (stop, ["u1" picks rider 1 up, "d1" sets them down])."""
    return solver._driven([[(p.pickup if x[0] == "u" else p.dropoff)(int(x[1:]), s) for x in rows] for s, rows in halts])


def test_improvement_deletes_then_replaces():
    """Five halts on a line, 10 s a place. The stop that saves most goes if all its riders can use others; else the best swap; four halts stay."""
    edges = {(a, b): abs(a - b) * 10_000.0 for a in range(60) for b in range(60)}
    t = 28_800_000.0
    reqs = {1: ([0, 20], [40], t), 2: ([20], [40, 50], t), 3: ([5, 30, 7], [50], t)}
    p = solver.Problem(reqs, edges)
    route = drive(p, (0, ["u1"]), (20, ["u2"]), (5, ["u3"]), (40, ["d1", "d2"]), (50, ["d3"]))
    # Halt 0 can move its rider to 20. Halt 40 can't go, because rider 1 has no other end.
    assert [s for s, _ in solver.grouped(solver.improved(p, route))] == [20, 5, 40, 50]
    moved = solver.grouped(solver.improved(p, route))
    assert [(a.kind, a.req) for a in moved[0][1]] == [("pickup", 1), ("pickup", 2)]  # in front of those already there
    reqs[1] = ([0], [40], t)
    # Nothing can go; of the swaps 5 to 30 shortens 20-5-40 most.
    assert [s for s, _ in solver.grouped(solver.improved(p, route))] == [0, 20, 30, 40, 50]
    assert solver.improved(p, drive(p, (0, ["u1"]), (20, ["u2"]), (40, ["d1", "d2"]))) is None
    # A stop that is on the route twice takes the activity at its last halt.
    reqs[1], reqs[4] = ([0, 20], [40], t), ([20], [40], t)
    twice = drive(p, (0, ["u1"]), (20, ["u2"]), (5, ["u3"]), (20, ["u4"]), (40, ["d1", "d2", "d4"]), (50, ["d3"]))
    assert [(s, [a.req for a in rows]) for s, rows in solver.grouped(solver.improved(p, twice))][:3] == [(20, [2]), (5, [3]), (20, [1, 4])]


def test_published_schedules(spark):
    """What is published for each suggestion follows from its route, counted by hand."""
    from tests.conftest import DATA
    from tripweave.plans import insertion
    from tripweave.plans import solver as solver_plans
    from tripweave.sources.driver_tables import Tables

    t = Tables(spark, str(DATA))
    best = {r["seed"]: r for r in solver_plans.best_routes(t).collect()}
    trips = {r["id"]: r for r in t.suggestions.select("id", "time_ms").collect()}
    at = {r["idx"]: (r["gi"], r["gj"]) for r in t.stops.collect()}
    leg = lambda a, b: 120_000 * (abs(at[a][0] - at[b][0]) + abs(at[a][1] - at[b][1])) + (30_000 if at[b][1] < at[a][1] else 0)
    rows = insertion.published_schedule(t).collect()
    assert {r["seed"] for r in rows} == set(trips) and best
    for r in rows:
        got, route = json.loads(r["route"]), best.get(r["seed"])
        if route is None:
            assert got == {"status": "Failure", "reason": "too_few_suggestions"}
            continue
        stops = route["stops"]
        arrive = [trips[r["seed"]]["time_ms"]]
        for a, b in zip(stops[-2::-1], stops[:0:-1], strict=True):
            arrive.insert(0, arrive[0] - leg(a, b) - 60_000)
        want = [arrive[0]]
        for k in range(1, len(stops)):
            want.append(max(want[-1] + 60_000, arrive[k] - 180_000) if k < route["n_up"] else arrive[k])
        assert [h["stop"] for h in got["stops"]] == stops and [h["time"] for h in got["stops"]] == want
        assert [h["kind"] for h in got["stops"]] == ["pickup"] * route["n_up"] + ["dropoff"] * (len(stops) - route["n_up"])
        assert got["requests"] == route["requests"] and r["seed"] in got["requests"]


def test_grown_routes_equal_the_fold(spark):
    """Routes of the query against plain folds over pools found by exhaustive search."""
    from tests.conftest import DATA
    from tripweave.plans import solver as plans
    from tripweave.sources.driver_tables import Tables

    t, s = Tables(spark, str(DATA)), plans.GROW
    trips = t.suggestions.collect()
    stops = [(r["idx"], r["x"], r["y"], r["gi"], r["gj"]) for r in t.stops.collect()]
    at = {r[0]: r[3:] for r in stops}
    leg = lambda a, b: 120_000.0 * (abs(at[a][0] - at[b][0]) + abs(at[a][1] - at[b][1])) + (30_000 if at[b][1] < at[a][1] else 0)
    c = lambda a, b: 0 if a == b else leg(a, b) + s.dwell

    def near(x, y):
        ball = [r[0] for r in sorted(stops, key=lambda r: (r[1], r[2], r[0])) if (r[1] - x) ** 2 + (r[2] - y) ** 2 <= 300**2]
        return ball or [min(stops, key=lambda r: ((r[1] - x) ** 2 + (r[2] - y) ** 2, r[0]))[0]]

    ends = {r["id"]: (near(r["sx"], r["sy"]), near(r["ex"], r["ey"])) for r in trips}
    fits = lambda o, d, x: min(c(o, x) + c(x, d) - c(o, d), c(o, d) + c(d, x) - c(o, x), c(x, d) + c(d, o) - c(x, o)) < s.budget

    def compatible(a, b):
        return any(any(fits(o, d, x) for x in ends[b][0]) and any(fits(o, d, x) for x in ends[b][1]) for o in ends[a][0] for d in ends[a][1])

    def alike(z, r):
        start = (r["sx"] - z["sx"]) ** 2 + (r["sy"] - z["sy"]) ** 2 < s.start_cluster_radius**2
        end = (r["ex"] - z["ex"]) ** 2 + (r["ey"] - z["ey"]) ** 2 < s.end_cluster_radius**2
        return start and end and abs(r["time_ms"] - z["time_ms"]) <= s.time_allowance and r["days_mask"] & z["days_mask"]

    weights = {r["id"]: float(r["weight"]) for r in trips}
    costs = solver.Costs({(a, b): leg(a, b) for a in at for b in at if a != b}, s.dwell)
    want = {}
    for z in trips:
        firsts = {}
        for r in sorted((r for r in trips if alike(z, r)), key=lambda r: r["id"]):
            firsts.setdefault((r["sx"], r["sy"], r["ex"], r["ey"], r["time_ms"], r["email"]), r["id"])
        pool = [i for i in firsts.values() if i != z["id"] and compatible(z["id"], i)]
        pairs = sorted((leg(o, d), j, k, o, d) for j, o in enumerate(ends[z["id"]][0]) for k, d in enumerate(ends[z["id"]][1]) if o != d)
        for rank, (ms, _, _, o, d) in enumerate(pairs[: s.top_ods] if len(pool) >= s.min_requests else [], 1):
            if ms - pairs[0][0] < s.suboptimal_allowance:
                for replica in range(1, s.replicas + 1):
                    order = sorted(pool, key=lambda i: (weights[i] <= 0, solver._draw(i * 1009 + rank * 31 + replica, weights[i]), i))
                    want[z["id"], rank, replica] = list(solver.grow(z["id"], o, d, [(i, *ends[i]) for i in order], costs, s.budget).stops())
    got = {(r["seed"], r["rank"], r["replica"]): r["stops"] for r in plans.grown(t).collect()}
    assert got == want and len(got) > 100


def test_potential_routes_equal_the_fold(spark):
    """Of similar routes the one of most riders stays, the newest on ties; then one of equal stop lists. For every seed."""
    from tests.conftest import DATA
    from tripweave.plans import solver as plans
    from tripweave.sources.driver_tables import Tables

    t = Tables(spark, str(DATA))
    want = {}
    by_seed = {}
    for r in sorted(plans.grown(t).collect(), key=lambda r: (r["seed"], r["rank"], r["replica"])):
        by_seed.setdefault(r["seed"], []).append(r)
    for seed, rows in by_seed.items():
        kept = []
        for new in rows:
            similar, other = [], []
            for old in kept:
                a, b = set(new["requests"]), set(old["requests"])
                (similar if len(a & b) / min(len(a), len(b)) > plans.GROW.similarity_limit else other).append(old)
            best = new
            for old in similar:
                best = old if len(old["requests"]) > len(best["requests"]) else best
            kept = [best, *other]
        firsts = {}
        for r in kept:
            firsts.setdefault(tuple(r["stops"]), r)
        want[seed] = sorted(",".join(map(str, s)) for s in firsts)
    got = {}
    for r in plans.potential_routes(t).collect():
        got.setdefault(r["seed"], []).append(r["stops"])
    assert {k: sorted(v) for k, v in got.items()} == want and any(len(v) > 1 for v in by_seed.values())


def test_nobody_is_lost_over_all_riders(spark):
    """The solver queries keep every suggestion, once, on a route or rejected; shared routes can be driven in time."""
    from tests.conftest import DATA
    from tripweave.plans import solver as plans
    from tripweave.sources.driver_tables import Tables

    t = Tables(spark, str(DATA))
    requests, edges, _ = plans.grouped_problem(t)
    asked = {r["req"]: r for r in requests.collect()}
    legs = {(r["grp"], r["src"], r["dst"]): float(r["ms"]) for r in edges.collect()}
    assert set(asked) == {r["id"] for r in t.suggestions.select("id").collect()}
    rides, seen = {}, {}
    for r in plans.recreate(t).collect():
        seen.setdefault(r["req"], []).append(r["kind"])
        if r["kind"] != "rejected":
            rides.setdefault((r["grp"], r["route"]), []).append((r["pos"], r["kind"], r["req"], r["stop"]))
    assert set(seen) == set(asked) and all(sorted(k) in (["dropoff", "pickup"], ["rejected"]) for k in seen.values())
    for (grp, _), acts in rides.items():
        members = {a[2] for a in acts}
        p = solver.Problem({i: (asked[i]["starts"], asked[i]["ends"], float(asked[i]["time"])) for i in members}, {(a, b): ms for (g, a, b), ms in legs.items() if g == grp})
        route = [solver.START, *((p.pickup if k == "pickup" else p.dropoff)(i, x) for _, k, i, x in sorted(acts)), solver.END]
        assert (len(members) == 1 or solver.feasible(p, route)) and all(x in asked[i]["starts" if k == "pickup" else "ends"] for _, k, i, x in acts)


def test_sinks(spark, tmp_path):
    routes_ = spark.createDataFrame([(1, 8, '{"status":"Success"}'), (2, 8, '{"status":"Failure"}'), (3, 9, "{}")], "id long, seed_id long, route string")
    files.append_routes(routes_, str(tmp_path / "r"))
    got = files.latest_routes(spark.read.parquet(str(tmp_path / "r")), 8).collect()
    assert [(r["id"], r["status"]) for r in got] == [(2, "Failure"), (1, "Success")]
    travel = spark.createDataFrame([(1, 2, 10.0)], "src int, dst int, ms double")
    files.write_travel(travel, str(tmp_path / "t"), 2)
    assert files.read_travel(spark, str(tmp_path / "t")).first()["ms"] == 15.0
    files.write_json(travel, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_throttle_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(1, 0), (1, 10_000), (1, 25_000), (1, 44_999), (1, 45_000), (2, 5)], "id long, at_ms long")
    want = sorted((r["id"], r["at_ms"], r["accepted"]) for r in triggers.throttle_batch(log).collect())
    assert [x[2] for x in want] == [True, False, True, False, True, True]
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = triggers.throttle_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r["id"], r["at_ms"], r["accepted"]) for r in spark.table("throttled").collect()) == want


def test_job_expiry_and_cache(spark):
    events = spark.createDataFrame([("a", "queued", 0), ("a", "succeeded", 10), ("b", "queued", 0)], "job string, status string, at_ms long")
    late = {r["job"]: r["status"] for r in triggers.job_status(events, 700_000).collect()}
    assert late == {"a": "not_found", "b": "queued"}
    now = [0.0]
    loads = []
    cache = triggers.Cached(lambda: loads.append(1) or spark.range(1), 10, lambda: now[0])
    cache.get(), cache.get()
    now[0] = 11
    cache.get()
    assert len(loads) == 2


def test_insertion_step_equals_model(spark):
    from tripweave.operators import insertion

    rng = random.Random(5)
    n = 25
    edges = {(a, b): float(abs(a - b) * 40_000 + (7_000 if b < a else 0) + ((a * 7 + b * 13) % 11) * 1_000) for a in range(n) for b in range(n)}
    rides, wanted, model, asked = [], [], {}, {}
    for r in range(60):
        stops = rng.sample(range(n), rng.randint(2, 7))
        k = rng.randint(1, len(stops) - 1)
        model[r] = solver.Ride([[s, [0]] for s in stops[:k]], [[s, [0]] for s in stops[k:]])
        rides += [(r, "U", i, s) for i, s in enumerate(stops[:k])] + [(r, "D", i, s) for i, s in enumerate(stops[k:])]
        for q in range(4):
            asked[r, q] = rng.sample(range(n), rng.randint(1, 3)), rng.sample(range(n), rng.randint(1, 3))
            wanted += [(r, q, role, s, i) for role, side in zip("SE", asked[r, q], strict=True) for i, s in enumerate(side)]
    travel = spark.createDataFrame([(a, b, ms) for (a, b), ms in edges.items()], "src long, dst long, ms double")
    got = insertion.insertion_step(
        spark.createDataFrame(rides, "ride int, side string, pos int, stop long"), spark.createDataFrame(wanted, "ride int, req int, role string, idx long, ord int"), travel, 900_000, 60_000
    ).collect()
    by = {(x["ride"], x["req"]): x for x in got}
    c = solver.Costs(edges, 60_000)
    for (r, q), (starts, ends) in asked.items():
        new = solver.try_insert(model[r], 9, starts, ends, c, 900_000)
        assert (new is None) == ((r, q) not in by)
        if new is not None:
            assert (next(s for s, rs in new.up if 9 in rs), next(s for s, rs in new.down if 9 in rs)) == (by[r, q]["up"], by[r, q]["down"])


def test_polyline(spark):
    from tripweave.functions import formats

    df = spark.createDataFrame([("_p~iF~ps|U_ulLnnqC_mqNvxq`@",), ("",), (None,)], "t string")
    got = [[(p["lat"], p["lng"]) for p in r[0]] for r in df.select(formats.polyline_points(F.col("t"))).collect()]
    assert got == [[(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)], [], []]


def test_shuffle_is_repeatable(spark):
    df = spark.range(50)
    one, again, other = ([r["id"] for r in routes.shuffled(df, s).collect()] for s in (1, 1, 2))
    assert one == again != other and sorted(one) == list(range(50))
