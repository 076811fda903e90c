"""Sequential kernels and column functions against hand-made cases and brute force."""

import itertools
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fairway.config import SHIP_TEMPLATES, Settings
from fairway.functions import geo
from fairway.operators import clean, cluster, graph, grid, kernels, motion, nodes, routing, ships, topology, weights
from fairway.operators.router import Network, diverse, dominates
from fairway.session import written

POINTS = "ship_name string, us long, row_idx long, lat double, lon double, speed double, course double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_geometry(spark):
    assert one(spark, geo.haversine(*lit(0, 0, 0, 1))) == pytest.approx(111194.9266, abs=1e-3)
    assert [one(spark, geo.bearing(*lit(0, 0, *p))) for p in ((1, 0), (0, 1), (-1, 0), (0, -1))] == pytest.approx([0, 90, 180, 270])
    assert one(spark, geo.angle_difference(*lit(350, 10))) == 20
    assert [one(spark, geo.octant(F.lit(float(x)))) for x in (0, 44.9, 45, 359.9)] == [0, 0, 1, 7]
    assert [one(spark, geo.time_period(F.lit(h))) for h in (5, 6, 10, 14, 18, 22)] == ["night", "morning", "midday", "afternoon", "evening", "late_night"]
    assert one(spark, geo.cell(F.lit(-0.0007), 0.0005)) == -1
    assert one(spark, geo.point_line_distance(*lit(0.001, 0.5, 0, 0, 0, 1))) == pytest.approx(111, rel=1e-6)
    assert one(spark, geo.point_segment_distance(*lit(0, 2, 0, 0, 0, 1))) == pytest.approx(111194.93, abs=0.1)
    s, c = (math.sin(math.radians(350)) + math.sin(math.radians(10))) / 2, math.cos(math.radians(10))
    assert one(spark, geo.concentration(*lit(s, c))) == pytest.approx(0.984808, abs=1e-6)


def track(speeds, seconds, ship="A"):
    return [(ship, int(t * 1e6), i, 22.0 + i * 1e-3, 113.0, float(v), 0.0) for i, (v, t) in enumerate(zip(speeds, seconds, strict=True))]


def test_cleaning_rules(spark):
    rows = track([5] * 12, range(0, 1200, 100)) + [("A", 0, 99, 22.0, 113.0, 5.0, 0.0), (None, 1, 1, 22.0, 113.0, 5.0, 0.0), ("A", 5000, 98, 22.0, 113.0, 31.0, 0.0)]
    df = spark.createDataFrame(rows, POINTS)
    assert clean.speed_filter(clean.dedup(df)).count() == 12
    fence = spark.createDataFrame([("A", i, i, x, 110.0, 1.0, 0.0) for i, x in enumerate((17.9, 18.0, 42.0, 42.1))], POINTS)
    assert sorted(r["lat"] for r in clean.integrity_filter(fence).collect()) == [18.0, 42.0]
    gaps = clean.gap_segments(spark.createDataFrame(track([5] * 5, (0, 1800, 5400, 9001, 9002)), POINTS), Settings(min_segment_points=1)).orderBy("us")
    assert [r["trajectory_segment"] for r in gaps.collect()] == [0, 0, 0, 1, 1]
    jump = spark.createDataFrame([("A", 0, 0, 22.0, 113.0, 5.0, 0.0), ("A", 10_000_000, 1, 22.1, 113.0, 5.0, 0.0)], POINTS)
    assert clean.drift_filter(jump).count() == 1


def test_kalman(spark):
    f = clean.Kalman(0.01, 0.1, 1)
    assert [f.step((z,))[0] for z in (1.0, 2.0, 3.0)] == pytest.approx([1.0, 1.90990990990991, 2.457642312864187])
    df = spark.createDataFrame([(s, i, i, float(i + 1), 1.0, 1.0, 0.0) for s in "AB" for i in range(3)], POINTS)
    got = clean.kalman_smooth(df).orderBy("ship_name", "us").collect()
    assert [r["lat"] for r in got] == pytest.approx([1.0, 1.90990990990991, 2.457642312864187] * 2)


def test_stops(spark):
    stops = nodes.stop_islands(spark.createDataFrame(track([1, 1, 1, 5], [0, 200, 301, 400]), POINTS)).collect()
    assert [r["duration"] for r in stops] == [301.0]
    assert nodes.stop_islands(spark.createDataFrame(track([1, 1, 1, 5], [0, 200, 300, 400]), POINTS)).count() == 0


def test_line_simplification(spark):
    r = random.Random(1)
    lat = 22 + np.cumsum([r.uniform(-1e-3, 1e-3) for _ in range(430)])
    lon = 113 + np.cumsum([r.uniform(0, 1e-3) for _ in range(430)])
    kept = kernels.simplified(lat, lon, 50.0)
    assert kept[0] == 0 and kept[-1] == 429
    x, y = lon * 111000 * np.cos(np.radians(lat)), lat * 111000
    for a, b in itertools.pairwise(kept):
        for i in range(a + 1, b):
            d = np.array([x[b] - x[a], y[b] - y[a]])
            t = np.clip(((x[i] - x[a]) * d[0] + (y[i] - y[a]) * d[1]) / (d @ d), 0, 1)
            assert math.hypot(x[i] - x[a] - t * d[0], y[i] - y[a] - t * d[1]) <= 50.0
    want = set()
    for start in range(0, 430, 100):
        end = min(start + 200, 430)
        want |= {start + i for i in kernels.simplified(lat[start:end], lon[start:end], 50.0)}
        if end == 430:
            break
    df = spark.createDataFrame([("A", i, i, float(a), float(o), 1.0, 0.0) for i, (a, o) in enumerate(zip(lat, lon, strict=True))], POINTS)
    assert {r["us"] for r in kernels.simplify(df, 50.0, 200).collect()} == want


def test_viterbi_against_all_paths():
    r = random.Random(2)
    for _ in range(20):
        n = 5
        lat, lon = np.array([22 + r.random() / 100 for _ in range(n)]), np.array([113 + r.random() / 100 for _ in range(n)])
        cand = [[(k, 22 + r.random() / 100, 113 + r.random() / 100, r.uniform(0.1, 1)) for k in r.sample(range(9), 3)] for _ in range(n)]

        def score(path, lat=lat, lon=lon, cand=cand):
            s = math.log(path[0][3])
            for i in range(1, n):
                a, b = path[i - 1], path[i]
                moved = float(kernels.haversine(lat[i - 1], lon[i - 1], lat[i], lon[i]))
                d = float(kernels.haversine(a[1], a[2], b[1], b[2]))
                s += (math.log(0.9) if a[0] == b[0] else -abs(d - moved) / max(moved, 100)) + math.log(b[3])
            return s

        best = max(itertools.product(*cand), key=score)
        want = [c[0] for i, c in enumerate(best) if i == 0 or best[i - 1][0] != c[0]]
        got = [k for _, k in kernels.viterbi(lat, lon, cand)]
        assert got == want and all(a != b for a, b in itertools.pairwise(got))


def test_greedy_and_dbscan():
    assert kernels.greedy([1, 2, 3, 4], {1: [2], 2: [1, 3], 3: [2, 4], 4: [3]}) == {1: 1, 2: 1, 3: 3, 4: 3}
    label = kernels.dbscan(np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [9.0]]), 0.15, 2)
    assert label.tolist() == [0, 0, 0, 1, 1, -1]


def turns(values):
    """Sorted distinct bearings with counts, summed cosines and sines."""
    b, n = np.unique(np.array(values, dtype=float), return_counts=True)
    return b, n, n * np.cos(np.radians(b)), n * np.sin(np.radians(b))


def plain_direction(values):
    """The rule over every single bearing, with clusters from all pairs."""
    v = np.sort(np.array(values, dtype=float))
    if len(v) < 3:
        return "waypoint"
    xy = np.column_stack([np.cos(np.radians(v)), np.sin(np.radians(v))])
    label = kernels.dbscan(xy, 0.5, 3)
    kinds = sorted(set(label[label >= 0].tolist()))
    if len(kinds) >= 3:
        mean = [xy[label == k].mean(axis=0) for k in kinds]
        angle = [math.degrees(math.atan2(m[1], m[0])) % 360 for m in mean]
        return "merge_point" if any(min(abs(a - b), 360 - abs(a - b)) > 150 for a in angle for b in angle) else "bifurcation_point"
    r = math.hypot(*xy.mean(axis=0))
    return "turn_point" if math.degrees(math.sqrt(-2 * math.log(min(1, max(r, 1e-10))))) > 45 else "waypoint"


def test_directions():
    assert kernels.direction_of(*turns([0, 1, 2, 180, 181, 182, 90, 91, 92])) == "merge_point"
    assert kernels.direction_of(*turns([0, 1, 2])) == "waypoint" and kernels.direction_of(*turns([0])) == "waypoint"
    assert kernels.direction_of(*turns([0, 1, 2, 60, 61, 62, 120, 121, 122])) == "bifurcation_point"
    assert kernels.direction_of(*turns([0.0] * 100 + [90.0] * 3)) == "waypoint" and kernels.direction_of(*turns([0.0] * 3 + [90.0] * 3 + [200.0] * 3)) == "merge_point"
    r = random.Random(8)
    seen = set()
    for _ in range(400):
        centres = [r.uniform(0, 360) for _ in range(r.randint(1, 5))]
        values = [round((r.choice(centres) + r.gauss(0, r.choice([2, 15]))) % 360, 3) % 360 for _ in range(r.randint(1, 40))]
        values += [values[0]] * r.choice([0, 0, 30])
        seen.add(plain_direction(values))
        assert kernels.direction_of(*turns(values)) == plain_direction(values), values
        b, n, *_ = turns(values)
        every = kernels.dbscan(np.column_stack([np.cos(np.radians(np.sort(values))), np.sin(np.radians(np.sort(values)))]), 0.5, 3)
        assert np.repeat(kernels.circular_clusters(b, n), n).tolist() == every.tolist()
    assert len(seen) == 4


def test_isolation_and_kde():
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, (500, 2)), [[12.0, 12.0]]])
    assert kernels.IsolationForest().fit(x).score(x).argmax() == 500
    same = np.array([1.0] * 6)
    assert kernels.kde_centre(same, same, same) == pytest.approx((1.0, 1.0))
    lat = np.array([0, 0.1, 0.2, 0.1, 3, 0.12])
    assert kernels.kde_centre(lat, lat * 0.5 + np.array([0, 0.01, 0, 0.02, 0, 0.01]), np.ones(6))[0] < 1


def network():
    e = {(1, 2): 1, (2, 3): 1, (1, 3): 5, (3, 4): 1}
    return Network({k: {"distance": float(v), "time": float(v), "risk": 1.0, "count": 1} for k, v in e.items()})


def test_router():
    n = network()
    c = n.cost("shortest")
    assert n.best(1, 4, c) == (3.0, [1, 2, 3, 4]) and n.best(4, 1, c) is None
    assert [(x, p) for x, p in n.ranked(1, 4, 5, c)] == [(3.0, [1, 2, 3, 4]), (6.0, [1, 3, 4])]
    assert sorted(n.simple(1, 4, 12)) == [[1, 2, 3, 4], [1, 3, 4]] and n.simple(1, 4, 2) == [[1, 3, 4]]
    assert n.without_each(1, 4, c, [1, 2, 3, 4]) == [[1, 3, 4]]
    assert n.relaxed(1, 4, c, frozenset({(3, 4)}), {}) == (3.0, [1, 2, 3, 4])
    assert n.evolved(1, 4, c)[0] >= 3.0 and n.evolved(1, 4, c) == n.evolved(1, 4, c)
    assert dominates((1, 1), (1, 2)) and not dominates((1, 2), (1, 2))
    assert diverse([[1, 2, 3], [1, 2, 4], [7, 8]], 2) == [[1, 2, 3], [7, 8]]
    r = random.Random(4)
    for _ in range(30):
        big = Network({(a, b): {"distance": r.randint(1, 9)} for a in range(7) for b in range(7) if a != b and r.random() < 0.4})
        k = big.cost("shortest")
        every = sorted((big.total(p, k), p) for p in big.simple(0, 6, 7))
        got = big.ranked(0, 6, 4, k)
        assert [x for x, _ in got] == [x for x, _ in every[:4]]


def test_simple_paths_are_all_or_an_error(spark):
    r = random.Random(4)
    for _ in range(30):
        e = {(a, b) for a in range(8) for b in range(8) if a != b and r.random() < 0.35}
        net = Network({k: {"distance": 1.0} for k in e})
        for cutoff in (1, 3, 7):
            want = [list(p) for n in range(1, cutoff + 1) for p in itertools.permutations(range(8), n + 1) if p[0] == 0 and p[-1] == 7 and all(x in e for x in itertools.pairwise(p))] if cutoff < 7 else None
            got = net.simple(0, 7, cutoff)
            assert len({tuple(p) for p in got}) == len(got) and all(len(p) <= cutoff + 1 for p in got)
            assert want is None or sorted(got) == sorted(want)
            if got:
                with pytest.raises(ValueError, match="more than"):
                    net.simple(0, 7, cutoff, len(got) - 1)
    edges = spark.createDataFrame(sorted(e), "u long, v long")
    asked = spark.createDataFrame([(1, 0, 7), (2, 7, 0), (3, 2, 2)], "request_id long, start long, goal long")
    got = sorted((x["request_id"], x["path"]) for x in routing.request_paths(edges, asked, 4).collect())
    assert got == sorted([(1, p) for p in net.simple(0, 7, 4)] + [(2, p) for p in net.simple(7, 0, 4)])


def test_hours_change_the_plan(spark):
    w = spark.createDataFrame([(1, 2, 100.0, 50.0), (2, 3, 100.0, 50.0), (1, 3, 100.0, 120.0), (3, 1, 100.0, 120.0)], "u long, v long, distance double, time double")
    hourly = spark.createDataFrame([(1, 2, 8, 300.0), (1, 2, 9, 40.0), (1, 3, 8, 90.0)], "u long, v long, hour int, predicted_time double")
    net = routing.network(w, hourly=hourly)
    assert net.best(1, 3, net.cost("fastest", 8))[1] == [1, 3] and net.best(1, 3, net.cost("fastest", 9))[1] == [1, 2, 3]
    assert net.time((3, 1), 8) == 90.0  # the other way's hours
    asked = spark.createDataFrame([(1, 1, 3, 8, "x"), (2, 1, 3, 9, "x")], "request_id long, start long, goal long, hour int, ship_type string")
    got = {(r["request_id"], r["path_type"]): r["path"] for r in routing.plan(asked, net, ("fastest",)).collect()}
    assert got[1, "FASTEST"] == [1, 3] and got[2, "FASTEST"] == [1, 2, 3]


def test_graph_tables_in_rounds_and_in_one_task(spark):
    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(45)})
    e = spark.createDataFrame(pairs, "u long, v long")
    both, costs = [], {}
    kept = graph.IN_TASK, routing.IN_TASK
    for limit in (0, 10**6):
        graph.IN_TASK = routing.IN_TASK = limit
        try:
            both.append(sorted(map(tuple, graph.components(e.toDF("a", "b")).collect())))
            both.append(sorted(map(tuple, graph.reachable(e, pairs[0][0]).collect())))
            got = routing.least_costs(e.withColumn("w", F.col("u") + 1.0), pairs[0][0], "w").collect()
            costs[limit] = sorted((x["node"], x["cost"]) for x in got)
        finally:
            graph.IN_TASK, routing.IN_TASK = kept
    assert both[0] == both[2] and both[1] == both[3] and costs[0] == costs[10**6]
    assert graph.components(e.toDF("a", "b").limit(0)).count() == 0


def test_betweenness_and_clustering(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "u long, v long")
    assert {(r["u"], r["v"]): round(r["betweenness"], 6) for r in graph.edge_betweenness(e).collect()} == {(1, 2): round(1 / 6, 6), (2, 3): round(2 / 6, 6), (1, 3): round(2 / 6, 6), (3, 4): 0.5}
    got = {r["node"]: (r["degree"], r["triangles"], round(r["coefficient"], 4)) for r in graph.clustering(e).collect()}
    assert got == {1: (2, 1, 1.0), 2: (2, 1, 1.0), 3: (3, 1, 0.3333), 4: (1, 0, 0.0)}


def test_hours_and_octants(spark):
    steps = spark.createDataFrame([("A", 1, 2, 10.0, 100.0, 5.0, 0.0, 7)] * 24, "ship_name string, from_node long, to_node long, distance double, seconds double, speed double, course double, hour int")
    t = {r["hour"]: r["predicted_time"] for r in topology.hourly_times(steps, topology.edges(steps)).collect()}
    assert t[7] == pytest.approx(80.0) and t[8] == pytest.approx(100.0)
    o = weights.octants(spark.createDataFrame([(1, 2, 0.0), (1, 2, 0.0), (1, 2, 180.0)], "u long, v long, bearing double"))
    assert {r["octant"]: r["n"] for r in o.collect()} == {0: 2, 4: 1} and weights.bidirectional(o).first()["is_bidirectional"]


def test_ships(spark):
    t = ships.templates(spark)
    assert {r["ship_type"] for r in t.collect()} == set(SHIP_TEMPLATES)
    f = spark.createDataFrame([(1, 2, "narrow", 150.0), (3, 4, "narrow", 300.0), (5, 6, "open", 9.0)], "u long, v long, waterway_type string, avg_distance double")
    got = {(r["u"], r["v"]): (r["depth"], r["channel_width"], r["clearance"]) for r in ships.constraints(f).collect()}
    assert got == {(1, 2): (6, 40, 20), (3, 4): (8, 60, 30), (5, 6): (15, 120, 60)}
    limit = spark.createDataFrame([(1, 2, 6.0, 120.0, 60.0)], "u long, v long, depth double, channel_width double, clearance double")
    ship = spark.createDataFrame([(str(d), d, 15.0, 20.0) for d in (7.1, 7.2, 7.3)], "ship_type string, draft double, width double, height double")
    assert {r["ship_type"]: r["passable"] for r in ships.passability(limit, ship).collect()} == {"7.1": True, "7.2": False, "7.3": False}
    risk = ships.rule_risk(
        limit.withColumn("depth", F.lit(15.0)), spark.createDataFrame([(1, 2, "open", 60, 6.0)], "u long, v long, waterway_type string, segment_count long, avg_actual_speed double"),
        spark.createDataFrame([("x", 5.0, 15.0, 20.0, "low")], "ship_type string, draft double, width double, height double, risk_level string"),
    )
    assert risk.first()["risk"] == 10.0


def test_pareto_and_numbering(spark):
    p = spark.createDataFrame([(1, 1, 5, 5), (2, 2, 2, 2), (3, 3, 3, 3), (4, 2, 2, 2)], "id int, a int, b int, c int")
    assert sorted(r["id"] for r in routing.pareto(p, "id", ["a", "b", "c"]).collect()) == [1, 2, 4]
    t = spark.createDataFrame([(f, g, n) for f in (3, 1, 2) for g in (2, 1) for n in (5, 4)], "frequency int, gl int, gn int")
    got = [(r["frequency"], r["gl"], r["gn"]) for r in grid.numbered(t, ["frequency", "gl"], ("frequency",), ["gn"]).orderBy("node_id").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1], x[2]))


def test_grid_joins_against_all_pairs(spark):
    r = random.Random(7)
    n = spark.createDataFrame([(i, 22 + r.random() / 200, 113 + r.random() / 200) for i in range(60)], "node_id long, lat double, lon double")
    q = spark.createDataFrame([(i, 22 + r.random() / 200, 113 + r.random() / 200) for i in range(80)], "id long, lat double, lon double")
    places = [tuple(x) for x in n.collect()]
    near = {x["id"]: x["node_id"] for x in grid.nearest(q, n, 0.001, 100.0).collect()}
    for i, a, o in map(tuple, q.collect()):
        d, k = min((float(kernels.haversine(a, o, b, p)), k) for k, b, p in places)
        if d < 100:
            assert near[i] == k
    pairs = {(x["id"], x["r_node_id"]) for x in grid.within(q, n, 0.002, 150.0).collect()}
    assert pairs == {(i, k) for i, a, o in map(tuple, q.collect()) for k, b, p in places if float(kernels.haversine(a, o, b, p)) < 150.0}


def dense_graph():
    r = random.Random(8)
    return {(a, b): (float(r.randrange(1, 99)), r.randrange(9)) for a in range(9) for b in range(9) if a != b and r.random() < 0.5}


def test_request_paths_carry_sums_and_store_only_beginnings(spark, monkeypatch):
    e = dense_graph()
    edges = spark.createDataFrame([(*k, *x) for k, x in e.items()], "u long, v long, d double, n long")
    asked = spark.createDataFrame([(1, 0, 8), (2, 5, 1), (3, 4, 8), (4, 3, 3)], "request_id long, start long, goal long")
    net = Network({k: {} for k in e})
    for cutoff in (1, 2, 6):
        stored = []
        monkeypatch.setattr(routing, "written", lambda df, name: stored.append(name) or written(df, name))
        got = routing.request_paths(edges, asked, cutoff, ("d", "n"))
        assert stored.count("paths") == max(1, cutoff - routing.TAIL)
        rows = sorted((r["request_id"], r["path"], r["path_id"], r["hops"], r["d"], r["n"]) for r in got.collect())
        want = [(i, p) for i, a, b in ((1, 0, 8), (2, 5, 1), (3, 4, 8)) for p in net.simple(a, b, cutoff)]
        assert rows == sorted((i, p, "-".join(map(str, p)), len(p) - 1, sum(e[x][0] for x in itertools.pairwise(p)), sum(e[x][1] for x in itertools.pairwise(p))) for i, p in want)


def test_totals_of_paths_need_no_rows_for_edges(spark):
    e = dense_graph()
    edges = spark.createDataFrame([(*k, x[0], x[0] / 7, 30.0 + x[1], x[1]) for k, x in e.items()], "u long, v long, distance double, time double, risk double, frequency long")
    asked = spark.createDataFrame([(1, 0, 8)], "request_id long, start long, goal long")
    paths = routing.request_paths(edges, asked, 6, ("distance", "time", "risk", "frequency"))
    got = routing.totals(paths.withColumnRenamed("hops", "n_edges"))
    names = ["path_id", "n_edges", "distance", "time", "risk", "frequency", "avg_speed", "safety"]
    plain = lambda t: {r[0]: pytest.approx(tuple(r[1:])) for r in t.select(*names).collect()}
    assert plain(got) == {k: v.expected for k, v in plain(routing.path_totals(paths.select("path_id", "path"), edges)).items()}
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_pareto_of_many_rows(spark):
    rows = spark.range(150_000).selectExpr("id", "id % 2 as g", "cast(floor(1000 * rand(3)) as double) as a", "cast(floor(1000 * rand(4)) as double) as b").unionByName(spark.sql("select 150000L as id, 0L as g, cast(null as double) as a, 0e0 as b"))
    rows = spark.createDataFrame(rows.toPandas().astype(object).where(lambda x: x.notna(), None), rows.schema)
    got = {r["id"] for r in routing.pareto(rows, "id", ["a", "b"], "g").collect()}
    want = set()
    for g in (0, 1):
        least = {}
        for r in rows.where(f"g = {g} and a is not null").groupBy("a").agg(F.min("b").alias("b")).orderBy("a").collect():
            if r["b"] < min(least.values(), default=math.inf):
                least[r["a"]] = r["b"]
        want |= {r["id"] for r in rows.where(f"g = {g}").collect() if r["a"] is None or least.get(r["a"]) == r["b"]}
    assert got == want and len(want) > 2


def test_recommend_puts_no_request_in_order(spark):
    options = spark.range(1000).selectExpr("id % 3 as request_id", "concat('p', id) as option", "if(id % 5 = 0, 'FREQUENT', 'FASTEST') as path_type", "cast(id % 17 + 1 as double) as distance", "cast(id % 13 + 1 as double) as time", "60e0 as safety")
    got = routing.recommend(options)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in got.collect():
        found.setdefault(r["request_id"], []).append((-round(r["score"], 9), r["option"], r["is_recommended"]))
    assert all([x[2] for x in sorted(v)] == [True] + [False] * (len(v) - 1) for v in found.values())
    chosen = {r["request_id"]: (r["recommended"]["option"], r["comparison_summary"]["n_options"]) for r in routing.decided(options).collect()}
    assert chosen == {k: (min(v)[1], len(v)) for k, v in found.items()}
    whole = {r["request_id"]: json.loads(r["document"]) for r in routing.decisions(options).collect()}
    assert {k: (d["recommended"]["option"], len(d["alternatives"]) + 1) for k, d in whole.items()} == chosen


def test_points_of_paths_in_rows_and_in_lines(spark):
    places = spark.createDataFrame([(i, 20.0 + i, 110.0 - i) for i in range(4)], "node_id long, lat double, lon double")
    paths = spark.createDataFrame([("a", [2, 0, 3]), ("b", [1, 2])], "path_id string, path array<long>")
    points = routing.route_points(paths, places)
    assert sorted(map(tuple, points.collect())) == [("a", 0, 108.0, 22.0), ("a", 1, 110.0, 20.0), ("a", 2, 107.0, 23.0), ("b", 0, 109.0, 21.0), ("b", 1, 108.0, 22.0)]
    assert "Aggregate" not in points._jdf.queryExecution().executedPlan().toString()
    assert {r[0]: r[1] for r in routing.route_lines(paths, places).collect()} == {"a": [[108.0, 22.0], [110.0, 20.0], [107.0, 23.0]], "b": [[109.0, 21.0], [108.0, 22.0]]}


def test_page_figures_from_sums(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")
    features = spark.createDataFrame([(0, 1, 2000.0, 600.0, 2, "narrow")], "u long, v long, avg_distance double, avg_travel_time double, segment_count long, waterway_type string")
    w = routing.web_edges(edges, features)
    assert sorted(map(tuple, w.collect())) == [(0, 1, 2.0, 10.0, 55), (1, 2, 0.5, 0.5, 40)]
    asked = spark.createDataFrame([(1, 0, 2)], "request_id long, start long, goal long")
    assert [tuple(r) for r in routing.web_stats(routing.request_paths(w, asked, 6, ("km", "minutes", "risk"))).collect()] == [("0-1-2", 2.5, 10.5, 7.71, 47.5, 52.5, 2)]


def test_headings_on_the_edge_of_an_octant(spark):
    points = spark.range(0, 360, 5).selectExpr("'A' as ship_name", "cast(22 + id * 0.01 as double) as lat", "113e0 as lon", "cast(id as double) as course", "'waypoint' as type")
    found = cluster.grid_clusters(nodes.grid_nodes(points)).select("lat", "heading", "co").collect()
    s, c = "sin(radians(k::double))", "cos(radians(k::double))"
    want = dict(duckdb.sql(f"select k, (degrees(atan2({s}, {c})) + 360e0) % 360e0 from range(0, 360, 5) t(k)").fetchall())
    got = {round((r["lat"] - 22) * 100): (r["heading"], r["co"]) for r in found}
    assert got == {k: (h, int(h // 45) % 8) for k, h in want.items()}


def test_refine_without_large_clusters(spark):
    c = spark.createDataFrame([(1, 22.0, 113.0, "waypoint", 3, 1, 1)], "node_id long, lat double, lon double, type string, frequency long, ship_count long, node_count long")
    assert cluster.refine(c).count() == 1


def test_movement_leaves_out_slow_and_long_steps(spark):
    rows = [("A", 0, 0, 22.0, 113.0, 5.0, 10.0), ("A", 60_000_000, 1, 22.001, 113.0, 7.0, 350.0), ("A", 90_000_000, 2, 22.001, 113.0, 7.0, 350.0), ("A", 90_000_000 + 90_000_000_000, 3, 23.0, 113.0, 7.0, 350.0)]
    got = motion.movement_segments(spark.createDataFrame(rows, POINTS)).collect()
    assert len(got) == 1 and got[0]["reported_speed"] == 6.0 and got[0]["course_change"] == 20.0


def test_dynamic_weight_falls_back_from_hour_to_period_to_mean(spark):
    filled = spark.createDataFrame([(1, 2, 7, 70.0), (1, 2, 9, 90.0)], "u long, v long, hour int, predicted_time double")
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    named = {r[0]: r[1] for r in hours.select("hour", geo.time_period(F.col("hour"))).collect()}
    periods = spark.createDataFrame([(1, 2, named[8], 5.0)], "u long, v long, time_period string, avg_time double")
    stats = spark.createDataFrame([(1, 2, 3.0), (2, 1, 4.0)], "u long, v long, avg_travel_time double")
    got = {tuple(r)[:3]: r["weight"] for r in weights.dynamic_weight(filled, periods, stats, stats.select("u", "v").crossJoin(hours)).collect()}
    assert got == {(1, 2, h): {7: 70.0, 9: 90.0}.get(h, 5.0 if named[h] == named[8] else 3.0) for h in range(24)} | {(2, 1, h): 4.0 for h in range(24)}
