"""Figures over all paths that are not listed, against listings of small graphs and sums over sets of dense ones."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairway.operators import halves, routing
from fairway.plans import catalogue
from fairway.plans.base import Base

DATA = "/root/testdata/sf0.001"
SUMS = ("distance", "time", "risk", "frequency")


def weighted(r, n, share):
    """Edges with values, some of them zero and many equal."""
    return {(a, b): (float(r.randrange(6)), float(r.randrange(6)), 30.0 + r.randrange(7), r.randrange(3, 9)) for a in range(n) for b in range(n) if a != b and r.random() < share}


def table(spark, edges):
    return spark.createDataFrame([(*k, *x) for k, x in edges.items()], "u long, v long, distance double, time double, risk double, frequency long")


def simple(edges, start, goal, cutoff):
    out, todo = [], [[start]]
    while todo:
        p = todo.pop()
        for a, b in edges:
            if a == p[-1] and b not in p and len(p) <= cutoff:
                if b == goal:
                    out.append([*p, b])
                else:
                    todo.append([*p, b])
    return out


def graph_of(edges):
    k = list(edges)
    return halves.Graph(np.array([a for a, _ in k]), np.array([b for _, b in k]), np.array([edges[x] for x in k], float))


def without_paths(monkeypatch, spark, query):
    """The query's rows, if it does without the table of all paths."""
    with monkeypatch.context() as m:
        m.setattr(Base, "paths", property(lambda self: pytest.fail("lists all paths")))
        return catalogue.CATALOGUE[query].run(spark, DATA).count()


def test_skyline_of_paths_without_listing_them(spark, monkeypatch):
    r = random.Random(5)
    for n, share, cutoff in ((8, 0.5, 7), (8, 0.5, 4), (9, 0.3, 12)):
        e = weighted(r, n, share)
        asked = spark.createDataFrame([(1, 0, n - 1), (2, 3, 1), (3, 2, 2), (4, 0, 99)], "request_id long, start long, goal long")
        got = routing.pareto(routing.skyline_paths(table(spark, e), asked, cutoff, SUMS, ("distance", "time"), 1e-5), "path_id", ["distance", "time"], "request_id")
        want = []
        for i, a, b in ((1, 0, n - 1), (2, 3, 1)):
            cost = {tuple(p): tuple(sum(e[x][j] for x in itertools.pairwise(p)) for j in (0, 1)) for p in simple(e, a, b, cutoff)}
            want += [(i, "-".join(map(str, p)), c) for p, c in cost.items() if not any(o != c and o[0] <= c[0] and o[1] <= c[1] for o in cost.values())]
        assert sorted((x["request_id"], x["path_id"], (x["distance"], x["time"])) for x in got.collect()) == sorted(want)
    assert without_paths(monkeypatch, spark, "pareto_paths") > 0


def test_skyline_of_a_graph_with_too_many_paths():
    r = random.Random(6)
    e = {(a, b): (r.randrange(1, 999), r.randrange(1, 999)) for a in range(150) for b in range(150) if a != b}  # some 10^23 paths of 12 edges
    front = {0: {(0, 0)}}
    for _ in range(12):
        offers = {}
        for a, costs in front.items():
            for b in range(150):
                if b != a:
                    offers.setdefault(b, set()).update((d + e[a, b][0], t + e[a, b][1]) for d, t in costs)
        for b, costs in offers.items():
            kept, least = set(), math.inf
            for d, t in sorted(costs | front.get(b, set())):
                if t < least:
                    kept.add((d, t))
                    least = t
            front[b] = kept
    g = graph_of(e)
    found = {tuple(g.sums(p).tolist()) for p in halves.skyline(g, 0, 149, 12, [0, 1], 1e-5)}
    assert {c for c in found if not any(o != c and o[0] <= c[0] and o[1] <= c[1] for o in found)} == front[149]


def test_number_of_paths_of_a_full_graph():
    g = graph_of({(a, b): (1.0,) for a in range(14) for b in range(14) if a != b})
    h = halves.Halves(g, 0, 13, 12)
    found = sum(halves.count(p, g.n) for m in h.middles() if (p := h.parts(m)) is not None)
    assert found == sum(math.perm(12, k) for k in range(12)) > 8 * 10**8


@pytest.mark.parametrize("pairs", [1, 40, 1 << 18])
def test_number_and_extremes_are_those_of_all_paths(monkeypatch, pairs):
    monkeypatch.setattr(halves, "PAIRS", pairs)
    monkeypatch.setattr(halves, "BLOCK", 50)
    r = random.Random(pairs)
    for n, share, cutoff in ((8, 0.6, 1), (8, 0.6, 2), (8, 0.6, 5), (9, 0.5, 8), (10, 0.3, 12)):
        e = weighted(r, n, share)
        g = graph_of(e)
        if g.at(0) is None or g.at(n - 1) is None:
            continue
        paths = [tuple(p) for p in simple(e, 0, n - 1, cutoff)]
        sums = {p: np.sum([e[x] for x in itertools.pairwise(p)], axis=0) for p in paths}
        h = halves.Halves(g, 0, g.at(n - 1), cutoff)
        time, risk, near = halves.Most(), halves.Most(), halves.Most(1.5)
        bonus = lambda s, edges, kinds: s[:, 0] + 2 * s[:, 1] / edges + (3 if sum(kinds) % 2 == 0 else 0)
        total = 0
        for m in h.middles():
            if (parts := h.parts(m)) is not None:
                total += halves.count(parts, g.n)
                halves.look(parts, time, lambda s, edges, kinds: s[:, 1])
                halves.look(parts, risk, lambda s, edges, kinds: -s[:, 2] / edges)
                halves.look(parts, near, bonus, lambda s: s[:, 3].astype(int) % 2)
        assert total == len(paths)
        if paths:
            assert time.value == max(x[1] for x in sums.values()) == sums[tuple(g.ids[time.found[0][1]].tolist())][1]
            assert -risk.value == pytest.approx(min(x[2] / (len(p) - 1) for p, x in sums.items()))
            score = {p: x[0] + 2 * x[1] / (len(p) - 1) + (3 if x[3] % 2 == 0 else 0) for p, x in sums.items()}
            assert sorted(tuple(g.ids[p].tolist()) for _, p in near.found) == sorted(p for p, x in score.items() if x >= max(score.values()) - 1.5)


def test_summary_lists_no_paths(spark, monkeypatch):
    e = weighted(random.Random(7), 9, 0.5)
    asked = spark.createDataFrame([(1, 0, 8), (2, 5, 1), (3, 4, 4), (4, 0, 99)], "request_id long, start long, goal long")
    edges = table(spark, e)
    every = catalogue._options(routing.request_paths(edges, asked, 6, SUMS))
    aims = [routing.Aim(lambda s, n, k, j=j, sign=sign: sign * s[:, j] / (n if j == 2 else 1)) for j in (0, 1, 2) for sign in (1, -1)]
    for limit in (1, 200_000):
        monkeypatch.setattr(routing, "IN_TASK", limit)
        few = catalogue._options(routing.searched_paths(edges, asked, 6, SUMS, lambda r: aims, counted=True))
        assert sorted(map(tuple, routing.comparison(few, "n").collect())) == sorted(map(tuple, routing.comparison(every).collect()))
    assert without_paths(monkeypatch, spark, "comparison_summary") > 0


def test_decision_lists_no_paths(spark, monkeypatch):
    e = weighted(random.Random(9), 9, 0.5)
    asked = spark.createDataFrame([(1, 0, 8), (2, 5, 1)], "request_id long, start long, goal long")
    edges = table(spark, e)
    every = catalogue._options(routing.request_paths(edges, asked, 6, SUMS))
    worst = {r[0]: (r[1], r[2]) for r in every.groupBy("request_id").agg(F.max("time"), F.max("distance")).collect()}
    near = catalogue._options(routing.searched_paths(edges, asked, 6, SUMS, lambda r: [routing.score_aim(SUMS, *worst[r])])).drop("n")
    ends = every.join(every.groupBy("request_id").agg(F.max("time").alias("t"), F.max("distance").alias("d")), "request_id").where("time = t or distance = d").drop("t", "d")
    assert near.count() < every.count() / 4
    want = sorted((r["request_id"], r["recommended"]) for r in routing.decided(every).collect())
    assert sorted((r["request_id"], r["recommended"]) for r in routing.decided(every, near.unionByName(ends)).collect()) == want
    assert sorted(map(tuple, routing.recommend(every, near.unionByName(ends)).collect())) == sorted(map(tuple, routing.recommend(every).collect()))
    assert without_paths(monkeypatch, spark, "decision_documents") > 0


def test_reading_paths_brings_no_rows_together(spark):
    e = weighted(random.Random(11), 10, 0.3)
    asked = spark.createDataFrame([(1, 0, 9), (2, 3, 1)], "request_id long, start long, goal long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where ends are too many to be broadcast unasked
    try:
        got = routing.request_paths(table(spark, e), asked, 12, SUMS)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        rows = sorted((r["request_id"], r["path"], r["hops"], r["distance"], r["frequency"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(i, p) for i, a, b in ((1, 0, 9), (2, 3, 1)) for p in simple(e, a, b, 12)]
    assert rows == sorted((i, p, len(p) - 1, sum(e[x][0] for x in itertools.pairwise(p)), sum(e[x][3] for x in itertools.pairwise(p))) for i, p in want)
