"""Routing as tables: costs, nearest nodes, path enumeration, totals, skyline, decisions; batch planning."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.functions import geo
from fairway.operators import halves
from fairway.operators.router import Network, diverse
from fairway.session import new_table, write, written

GRAPH_LIMIT = 2_000_000
IN_TASK = 200_000  # edges up to which a search runs in one task instead of in rounds
TAIL, END, PAIRS_A_TASK, MOST_TASKS = 7, 3, 4_000_000, 20_000  # last edges of request paths that are not stored, and that are joined at once; paths to try in a task


def weight_maps(edges: DataFrame, features: DataFrame, nodes: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """(u, v, distance, time, risk, frequency) of every edge; without features the great circle and 8 knots."""
    place = nodes.select("node_id", "lat", "lon")
    t = edges.select("u", "v").join(features.select("u", "v", "avg_distance", "avg_travel_time", "segment_count"), ["u", "v"], "left")
    t = t.join(place.toDF("u", "lat_u", "lon_u"), "u", "left").join(place.toDF("v", "lat_v", "lon_v"), "v", "left")
    t = t.join(risk.select("u", "v", "risk"), ["u", "v"], "left") if risk is not None else t.withColumn("risk", F.lit(None).cast("double"))
    d = F.coalesce("avg_distance", geo.haversine(F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v")))
    return t.select("u", "v", d.alias("distance"), F.coalesce("avg_travel_time", d / (8 * 0.5144)).alias("time"), F.coalesce("risk", F.lit(30.0)).alias("risk"), F.coalesce("segment_count", F.lit(0)).alias("frequency"))


def turn_angles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, c, angle): course change between the edges a-b and b-c."""
    place = nodes.select("node_id", "lat", "lon")
    e = edges.select("u", "v").join(place.toDF("u", "lat_u", "lon_u"), "u").join(place.toDF("v", "lat_v", "lon_v"), "v")
    e = e.select("u", "v", geo.bearing(F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v")).alias("bearing"))
    x, y = e.toDF("a", "b", "b1"), e.toDF("b", "c", "b2")
    return x.join(y, "b").where("a <> c").select("a", "b", "c", geo.angle_difference(F.col("b1"), F.col("b2")).alias("angle"))


def turn_penalty(angle: Column, length: Column, width: Column) -> Column:
    """Factor from 1 to 5 by how far a turn exceeds what the ship can make."""
    most = F.least(90.0 / ((length * 1.5 + width * 0.5) / 100.0), F.lit(120.0))
    return F.when(angle < 10, 1.0).when(angle > most, F.least(2.0 + (angle - most) / 30.0, F.lit(5.0))).otherwise(1.0 + angle / most * 0.5)


def nearest_nodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, node_id, dist): the nearest node to each place, whatever the distance. Requests are a small table."""
    t = nodes.select("node_id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon")).crossJoin(F.broadcast(requests.select("request_id", "lat", "lon")))
    d = F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon")), 6)
    best = t.groupBy("request_id").agg(F.min(F.struct(d.alias("d"), F.col("node_id"))).alias("b"))
    return best.select("request_id", F.col("b.node_id").alias("node_id"), F.col("b.d").alias("dist"))


def simple_paths(edges: DataFrame, starts: DataFrame, cutoff: int) -> DataFrame:
    """(start, node, path, hops): every path without repeats of 1 to ``cutoff`` edges from the start nodes."""
    e = edges.select(F.col("u").alias("node"), F.col("v").alias("next")).distinct()
    level = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path"), F.lit(0).alias("hops"))
    found = None
    for _ in range(cutoff):
        level = level.join(e, "node").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"), (F.col("hops") + 1).alias("hops"))
        found = level if found is None else found.unionByName(level)
    return found


def hops_to(edges: DataFrame, goals: DataFrame, cutoff: int) -> DataFrame:
    """(goal, node, left): fewest edges from each node to the goals, up to ``cutoff``."""
    e = edges.select("u", "v").distinct()
    found = goals.select("goal").distinct().select("goal", F.col("goal").alias("node"), F.lit(0).alias("left"))
    front = found
    for step in range(1, cutoff + 1):
        new = front.join(e, front["node"] == e["v"]).select("goal", F.col("u").alias("node")).distinct().join(found, ["goal", "node"], "left_anti")
        front = written(new.withColumn("left", F.lit(step)), "hops")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def request_paths(edges: DataFrame, requests: DataFrame, cutoff: int, sums: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, start, goal, path, path_id, hops, sums): every path without repeats of up to ``cutoff`` edges from start to goal.

    ``sums`` are columns of the edges, never null, that are added up along each path; an edge is listed once.
    A path is only carried on while the goal is within the edges it has left. Only beginnings are stored: the last
    ``TAIL`` edges are joined whenever the result is read, as whole paths are far more: two edges at a time, the last ``END`` as ready
    ends to the goal. Edges and ends are broadcast where they are few, so that reading writes nothing.
    """
    e = edges.select(F.col("u").alias("node"), F.col("v").alias("next"), *sums).distinct()
    left = written(hops_to(edges, requests, cutoff).select("goal", F.col("node").alias("next"), "left"), "left")
    names = ["request_id", "start", "goal", "path", "path_id"]
    kinds = dict(edges.dtypes)
    level = requests.where("start <> goal").select("request_id", "start", "goal", F.col("start").alias("node"), F.array("start").alias("path"), F.col("start").cast("string").alias("path_id"), *(F.lit(0).cast(kinds[c]).alias(c) for c in sums))
    step, near = _few(e.withColumnsRenamed({"next": "__at", **{c: f"__{c}" for c in sums}}).withColumns({"__path": F.array("__at"), "__path_id": F.col("__at").cast("string")})), _few(left)

    def longer(level: DataFrame, steps: DataFrame, edges: int, most: int | None, through: bool = True) -> DataFrame:
        """Paths carried on by steps of a number of edges; ``most`` edges may then be left to the goal, which is not passed and only met if not ``through``."""
        apart = F.lit(True)
        for i in range(edges):
            apart &= ~F.array_contains("path", F.get("__path", F.lit(i)))
            if through or i < edges - 1:
                apart &= F.get("__path", F.lit(i)) != F.col("goal")
        on = level.join(steps, "node").where(apart)
        if most is not None:
            on = on.join(near.withColumnRenamed("next", "__at"), ["goal", "__at"]).where(F.col("left") <= most)
        return on.select("request_id", "start", "goal", F.col("__at").alias("node"), F.concat("path", "__path").alias("path"), F.concat_ws("-", "path_id", "__path_id").alias("path_id"), *((F.col(c) + F.col(f"__{c}")).alias(c) for c in sums))

    tail = min(TAIL, cutoff - 1)
    found = None
    for hops in range(1, cutoff - tail + 1):
        level = written(longer(level, step, 1, cutoff - hops, False), "paths")
        done = level.where("node = goal").select(*names, F.lit(hops).alias("hops"), *sums)
        found = done if found is None else found.unionByName(done)
        level = level.where("node <> goal")
    if not tail:
        return found
    level = level.select(*names, "node", *sums).repartition(_tasks(level, e, tail))
    ends = request_ends(e, requests, min(tail, END), sums).withColumnsRenamed({c: f"__{c}" for c in ["path", "path_id", "hops", *sums]})
    back = _few(e.withColumnsRenamed({"node": "__mid", "next": "__at", **{c: f"__to_{c}" for c in sums}}))
    twice = _few(e.withColumnRenamed("next", "__mid").join(back, "__mid").where("node <> __at").select("node", "__at", F.array("__mid", "__at").alias("__path"), F.concat_ws("-", F.col("__mid").cast("string"), F.col("__at").cast("string")).alias("__path_id"), *((F.col(c) + F.col(f"__to_{c}")).alias(f"__{c}") for c in sums)))
    last, at = _few(ends), cutoff - tail
    while at < cutoff:
        more, carried = (cutoff - at) % END or END, level  # edges of the ends to join here
        for done in range(cutoff - tail, at, 2):
            two = done + 2 <= at
            carried = longer(carried, twice if two else step, 2 if two else 1, cutoff - done - 2 if done + 2 < at else None)
        apart = F.col("__hops") <= more
        for i in range(more - 1):  # the goal, the last of each end, is in no beginning
            apart &= ~F.coalesce(F.array_contains("path", F.get("__path", F.lit(i))), F.lit(False))
        whole = carried.join(last, ["goal", "node"]).where(apart).select(
            "request_id", "start", "goal", F.concat("path", "__path").alias("path"), F.concat_ws("-", "path_id", "__path_id").alias("path_id"), (F.lit(at) + F.col("__hops")).alias("hops"),
            *((F.col(c) + F.col(f"__{c}")).alias(c) for c in sums),
        )
        found = found.unionByName(whole)
        at += more
    return found


def _few(t: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has no more rows than a task may hold."""
    return F.broadcast(t) if t.count() <= IN_TASK else t


def _tasks(beginnings: DataFrame, steps: DataFrame, most: int) -> int:
    """Tasks to carry on beginnings in, by the number of walks of up to ``most`` edges from their ends to the goals."""
    workers = steps.sparkSession.sparkContext.defaultParallelism
    if steps.count() > IN_TASK:
        return 16 * workers
    t = steps.select("node", "next").distinct().toArrow()
    ids, at = np.unique(np.concatenate([t.column("node").to_numpy(), t.column("next").to_numpy()]), return_inverse=True)
    u, v = at[: t.num_rows], at[t.num_rows :]
    total, ways = 0.0, {}
    for goal, node, n in beginnings.groupBy("goal", "node").count().collect():  # at most a row for each node and goal
        if goal not in ways:
            now, ways[goal] = (ids == goal).astype(float), np.zeros(len(ids))
            for _ in range(most):
                now = np.bincount(u, now[v] * (ids[u] != goal), len(ids))
                ways[goal] += now
        total += n * ways[goal][np.searchsorted(ids, node)]
    return int(min(max(workers, total // PAIRS_A_TASK), MOST_TASKS))


def request_ends(steps: DataFrame, requests: DataFrame, most: int, sums: tuple[str, ...]) -> DataFrame:
    """(goal, node, path, path_id, hops, sums): every path without repeats of 1 to ``most`` edges from a node to a goal; path leaves out the node."""
    goals = requests.select(F.col("goal").alias("next"), "goal").distinct()
    level = written(steps.join(goals, "next").where("node <> goal").select("goal", "node", F.array("next").alias("path"), F.col("next").cast("string").alias("path_id"), F.lit(1).alias("hops"), *sums), "ends")
    found = level
    for hops in range(2, most + 1):
        back = steps.select(F.col("node").alias("from"), F.col("next").alias("node"), *(F.col(c).alias(f"__{c}") for c in sums))
        on = level.join(back, "node").where((F.col("from") != F.col("node")) & ~F.array_contains("path", F.col("from")))
        level = written(on.select("goal", F.col("from").alias("node"), F.concat(F.array("node"), "path").alias("path"), F.concat_ws("-", F.col("node").cast("string"), "path_id").alias("path_id"), F.lit(hops).alias("hops"), *((F.col(f"__{c}") + F.col(c)).alias(c) for c in sums)), "ends")
        found = found.unionByName(level)
    return found


class Aim(NamedTuple):
    """What to look for among paths: the greatest value of (sums, edges, kinds), linear in the sums for each number of edges and pair of kinds, and all within ``slack`` of it (0: one path)."""

    value: Callable[[np.ndarray, int, tuple[int, int]], np.ndarray]
    slack: float = 0.0
    kinds: Callable[[np.ndarray], np.ndarray] = lambda sums: np.zeros(len(sums), int)


def path_graph(edges: DataFrame, cutoff: int, sums: tuple[str, ...]) -> halves.Graph | None:
    """The edges in memory, or None where they are too many for a task or sets of nodes would not fit a number."""
    e = edges.select("u", "v", *sums).distinct()
    if e.count() > IN_TASK:
        return None
    t = e.toArrow()
    graph = halves.Graph(t.column("u").to_numpy(), t.column("v").to_numpy(), np.column_stack([t.column(c).cast(pa.float64()).to_numpy() for c in sums]))
    return graph if graph.n ** max(1, cutoff - cutoff // 2 - 1) < 1 << 62 else None


def searched_paths(edges: DataFrame, requests: DataFrame, cutoff: int, sums: tuple[str, ...], aims: Callable[[int], list[Aim]], counted: bool = False) -> DataFrame:
    """Columns of ``request_paths`` and n, for those of its paths that the aims of their request look for; each task gives its own best.

    If ``counted``, rows without a path have in n how many paths there are; n adds up to their number. The paths are not listed,
    see ``halves``; only where the graph is too large for that, every path is, with 1 in n.
    """
    graph = path_graph(edges, cutoff, sums)
    if graph is None:
        return request_paths(edges, requests, cutoff, sums).withColumn("n", F.lit(1).cast("long"))

    def run(graph: halves.Graph, asked: dict, items: list) -> Iterator[tuple]:
        best = {r: [(a, halves.Most(a.slack)) for a in aims(r)] for r in {r for r, _ in items}}
        for r, middle in items:
            parts = asked[r].parts(middle)
            if parts is None:
                continue
            if counted and (n := halves.count(parts, graph.n)):
                yield r, None, n
            for a, most in best[r]:
                halves.look(parts, most, a.value, a.kinds)
        for r, found in best.items():
            for path in {tuple(p.tolist()) for _, most in found for _, p in most.found}:
                yield r, path, 0

    return _graph_rows(edges, graph, requests, cutoff, sums, lambda h: h.middles(), run)


def skyline_paths(edges: DataFrame, requests: DataFrame, cutoff: int, sums: tuple[str, ...], costs: tuple[str, str], margin: float) -> DataFrame:
    """Columns of ``request_paths`` and n, for its paths whose costs (sums that are never negative) no other path of the request reaches with one of
    them less by more than the margin; a few beaten ones may be among them. Where the graph is too large for a task, all paths."""
    graph = path_graph(edges, cutoff, sums)
    if graph is None:
        return request_paths(edges, requests, cutoff, sums).withColumn("n", F.lit(1).cast("long"))

    def run(graph: halves.Graph, asked: dict, items: list) -> Iterator[tuple]:
        for r, _ in items:
            for path in halves.skyline(graph, asked[r].start, asked[r].goal, cutoff, [sums.index(c) for c in costs], margin):
                yield r, tuple(path.tolist()), 0

    return _graph_rows(edges, graph, requests, cutoff, sums, lambda h: [halves.NONE], run)


def _graph_rows(edges: DataFrame, graph: halves.Graph, requests: DataFrame, cutoff: int, sums: tuple[str, ...], shares: Callable, run: Callable) -> DataFrame:
    """Rows of the paths (request_id, path or None, n) that ``run`` gives for its items (request_id, share), which are dealt over tasks."""
    spark, kinds = edges.sparkSession, dict(edges.dtypes)
    asked = {}
    for r in requests.where("start <> goal").collect():  # a small table
        a, b = graph.at(r["start"]), graph.at(r["goal"])
        if a is not None and b is not None:
            asked[r["request_id"]] = halves.Halves(graph, a, b, cutoff)
    items = [(r, x) for r, h in asked.items() for x in shares(h)]
    items = [items[i] for i in np.random.default_rng(0).permutation(len(items))]
    schema = "request_id long, start long, goal long, path array<long>, path_id string, hops int, " + "".join(f"{c} {kinds[c]}, " for c in sums) + "n long"
    if not items:
        return spark.createDataFrame([], schema)
    workers = spark.sparkContext.defaultParallelism
    tasks = min(-(-len(items) // 4), max(4 * workers, len(items) // 64))
    shared = spark.sparkContext.broadcast((graph, asked, items))
    whole = [kinds[c] in ("bigint", "int") for c in sums]

    def row(r: int, path: tuple | None, n: int) -> tuple:
        if path is None:
            return (r, None, None, None, None, None, *[None] * len(sums), n)
        graph = shared.value[0]
        ids = graph.ids[list(path)].tolist()
        total = [int(x) if w else float(x) for x, w in zip(graph.sums(np.array(path)), whole, strict=True)]
        return (r, ids[0], ids[-1], ids, "-".join(map(str, ids)), len(ids) - 1, *total, n)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int32(), *[pa.from_numpy_dtype({"bigint": "i8", "int": "i4", "float": "f4"}.get(kinds[c], "f8")) for c in sums], pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, asked, items = shared.value
        mine = [items[i] for b in batches for i in b.column("id").to_pylist()]
        rows = []
        for x in run(graph, asked, mine):
            rows.append(row(*x))
            if len(rows) == 10_000:
                yield _batch(rows, types, names)
                rows = []
        if rows:
            yield _batch(rows, types, names)

    return spark.range(0, len(items), 1, tasks).mapInArrow(task, schema)


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def least_costs(edges: DataFrame, start: int, cost: str, most_rounds: int = 1000) -> DataFrame:
    """(node, cost, before): least costs from one node by relaxation rounds over the distributed edges."""
    spark = edges.sparkSession
    e = edges.select("u", "v", F.col(cost).cast("double").alias("w"))
    if 0 < e.count() <= IN_TASK:
        return e.coalesce(1).mapInArrow(_search(start), "node long, cost double, before long")
    best = spark.createDataFrame([(start, 0.0, None)], "node long, cost double, before long")
    front = best
    for _ in range(most_rounds):
        offers = front.join(e, front["node"] == e["u"]).select(F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("u").alias("before"))
        both = best.withColumn("new", F.lit(0)).unionByName(offers.withColumn("new", F.lit(1)))
        kept = both.groupBy("node").agg(F.min(F.struct("cost", "new", "before")).alias("b")).select("node", "b.cost", "b.before", "b.new")
        path = new_table(spark, "relax")
        write(kept, path)
        now = spark.read.parquet(path)
        best, front = now.drop("new"), now.where("new = 1").drop("new")
        if front.isEmpty():
            break
    return best


def _search(start: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[tuple[int, float]]] = {}
        for b in batches:
            for u, v, w in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), b.column("w").to_pylist(), strict=True):
                out.setdefault(u, []).append((v, w))
        best: dict[int, tuple[float, int | None]] = {start: (0.0, None)}
        heap, done = [(0.0, start)], set()
        while heap:
            g, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for v, w in out.get(u, ()):
                if v not in best or g + w < best[v][0]:
                    best[v] = (g + w, u)
                    heapq.heappush(heap, (g + w, v))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([c for c, _ in best.values()], pa.float64()), pa.array([p for _, p in best.values()], pa.int64())], names=["node", "cost", "before"])

    return run


def path_edges(paths: DataFrame) -> DataFrame:
    """(path_id, seq, u, v) of paths given as arrays."""
    pair = F.transform(F.slice("path", 1, F.size("path") - 1), lambda x, i: F.struct(x.alias("u"), F.get("path", i + 1).alias("v")))
    return paths.where(F.size("path") > 1).select("path_id", F.posexplode(pair).alias("seq", "e")).select("path_id", (F.col("seq") + 1).alias("seq"), "e.u", "e.v")


def path_totals(paths: DataFrame, weights: DataFrame) -> DataFrame:
    """Distance, time, speed, mean risk, safety and frequency of each path."""
    t = path_edges(paths).join(weights, ["u", "v"])
    return totals(t.groupBy("path_id").agg(F.count(F.lit(1)).alias("n_edges"), *(F.sum(c).alias(c) for c in ("distance", "time", "risk", "frequency"))))


def totals(sums: DataFrame) -> DataFrame:
    """The same of paths whose edges have been counted (n_edges) and added up already."""
    s = sums.withColumn("risk", F.col("risk") / F.col("n_edges"))
    return s.withColumns({"avg_speed": F.when(F.col("time") > 0, F.col("distance") / F.col("time") * 1.944).otherwise(0.0), "safety": 100 - F.col("risk")})


def pareto(points: DataFrame, key: str, costs: list[str], group: str | None = None) -> DataFrame:
    """Rows that no other row of the group beats: as good in all costs and better in one. A row without one of them is never beaten.

    ``key`` names a row in its group; a row never beats itself. Each task passes on what nothing in it beats; of those each group is looked through at once.
    """
    local = points.mapInArrow(_fronts(costs, group), points.schema)
    return (local.repartition(group) if group else local.repartition(1)).mapInArrow(_fronts(costs, group), points.schema)


def _fronts(costs: list[str], group: str | None):
    def values(t: pa.Table) -> np.ndarray:
        return np.nan_to_num(np.column_stack([t.column(c).cast(pa.float64()).to_numpy() for c in costs]), nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[object, pa.Table] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            whole = np.logical_and.reduce([t.column(c).is_valid().to_numpy() for c in [*costs, *([group] if group else [])]])
            yield from t.filter(pa.array(~whole)).to_batches()
            t = t.filter(pa.array(whole))
            for g in t.column(group).unique() if group else [None]:
                part = t.filter(pc.equal(t.column(group), g)) if group else t
                pool = pa.concat_tables([kept[g], part]) if g in kept else part
                kept[g] = pool.take(pa.array(unbeaten(values(pool))))
        for t in kept.values():
            yield from t.combine_chunks().to_batches()

    return run


def unbeaten(costs: np.ndarray) -> np.ndarray:
    """Rows of a matrix that no other row beats: no greater in any column and less in one."""
    order = np.lexsort(costs.T[::-1])  # a row is only beaten by one before it
    c = costs[order]
    if not len(c):
        return order
    if c.shape[1] == 2:
        start = np.searchsorted(c[:, 0], c[:, 0])  # first row of the same first cost
        before = np.concatenate([[np.inf], np.minimum.accumulate(c[:, 1])])[start]
        return order[(c[:, 1] == c[start, 1]) & ((c[:, 1] < before) | (start == 0))]
    found, rest = [], np.arange(len(c))
    while len(rest):
        p = c[rest[0]]
        same = (c[rest] == p).all(axis=1)
        found.append(rest[same])
        rest = rest[~same & (c[rest] < p).any(axis=1)]
    return order[np.concatenate(found)]


def recommend(options: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Adds score and is_recommended: safety, time and distance against the request's worst, a bonus for frequent ways.

    Options have request_id, option, path_type, distance, time, safety; option is unique in its request. Options are read
    three times instead of being put in order, as one request may have very many: for the worst values, the best score, its first option.
    Where ``among`` has some of them, the worst and all of the best score with them, only those are read for that.
    """
    among = options if among is None else among
    rated = _scored(options, among)
    best = written(_best(_scored(among)), "best").select("request_id", F.col("option").alias("__option"))
    return rated.join(F.broadcast(best), "request_id", "left").withColumn("is_recommended", F.col("option").eqNullSafe(F.col("__option"))).drop("__option")  # one row a request


def _scored(options: DataFrame, among: DataFrame | None = None) -> DataFrame:
    worst = written((options if among is None else among).groupBy("request_id").agg(F.max("time").alias("__time"), F.max("distance").alias("__distance")), "worst")
    t = options.join(F.broadcast(worst), "request_id")  # one row a request
    part = lambda c: F.coalesce(F.when(F.col(f"__{c}") > 0, 1 - F.col(c) / F.col(f"__{c}")), F.lit(0.0))
    score = 0.35 * F.col("safety") / 100 + 0.25 * part("time") + 0.20 * part("distance") + F.when(F.col("path_type") == "FREQUENT", 0.1).otherwise(0.0)
    return t.withColumn("score", score).drop("__time", "__distance")


def score_aim(sums: tuple[str, ...], time: float, distance: float) -> Aim:
    """Looks for the best scores of ``recommend`` where these are the worst values: sums of distance, time, risk and frequency (even: a frequent way)."""
    d, t, r, n = (sums.index(c) for c in ("distance", "time", "risk", "frequency"))
    per_d, per_t = (x / y if y > 0 else 0.0 for x, y in ((0.20, distance), (0.25, time)))

    def value(s: np.ndarray, edges: int, kinds: tuple[int, int]) -> np.ndarray:
        return 0.35 * (1 - s[:, r] / edges / 100) - per_t * s[:, t] - per_d * s[:, d] + (0.1 if sum(kinds) % 2 == 0 else 0.0)

    return Aim(value, 1e-8 + 2e-6 * (per_d + per_t + 0.0035), lambda s: s[:, n].astype(int) % 2)  # scores are compared to nine places, of values with six


def _best(rated: DataFrame) -> DataFrame:
    """The recommended row of each request: best score to nine places, then first option."""
    top = written(rated.groupBy("request_id").agg(F.max("score").alias("__top")), "top")
    near = rated.join(F.broadcast(top), "request_id").where(F.col("__top").isNull() | (F.col("score") > F.col("__top") - 1e-8))  # one row a request; rounded scores keep their order
    ties = near.where(F.round("score", 9).eqNullSafe(F.round("__top", 9))).drop("__top")
    return ties.groupBy("request_id").agg(F.min_by(F.struct(*[c for c in ties.columns if c != "request_id"]), "option").alias("b")).select("request_id", "b.*")


def comparison(options: DataFrame, counted: str | None = None) -> DataFrame:
    """One row for each request: number of options and range of their values. If ``counted`` is a column, it adds up to the number."""
    return options.groupBy("request_id").agg((F.sum(counted) if counted else F.count(F.lit(1))).alias("n_options"), *(f(c).alias(f"{n}_{c}") for c in ("distance", "time", "safety") for n, f in (("min", F.min), ("max", F.max))))


def web_edges(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(u, v, km, minutes, risk) of edges as the page counts them: risk from 30 with 15 for narrow and 10 for scarce edges, half a unit where nothing is known."""
    t = edges.select("u", "v").join(features.select("u", "v", (F.col("avg_distance") / 1000).alias("km"), (F.col("avg_travel_time") / 60).alias("minutes"), "segment_count", "waterway_type"), ["u", "v"], "left")
    risk = 30 + F.when(F.col("waterway_type") == "narrow", 15).otherwise(0) + F.when(F.coalesce("segment_count", F.lit(0)) < 3, 10).otherwise(0)
    return t.select("u", "v", F.coalesce("km", F.lit(0.5)).alias("km"), F.coalesce("minutes", F.lit(0.5)).alias("minutes"), risk.cast("long").alias("risk"))


def web_stats(sums: DataFrame) -> DataFrame:
    """Route figures as the page shows them: km, minutes, knots, risk, safety; of paths with hops and the sums of their ``web_edges``."""
    speed = F.when(F.col("minutes") > 0, F.col("km") / (F.col("minutes") / 60) / 1.852).otherwise(8.0)
    s = sums.withColumn("risk", F.col("risk") / F.col("hops"))
    return s.select("path_id", F.bround("km", 2).alias("total_distance_km"), F.bround("minutes", 2).alias("total_time_min"), F.bround(speed, 2).alias("avg_speed_knots"), F.bround("risk", 1).alias("risk_score"), F.bround(F.greatest(100 - F.col("risk"), F.lit(0.0)), 1).alias("safety_score"), F.col("hops").alias("waypoint_count"))


def route_points(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, seq, lon, lat): the places of each path, seq from 0. No rows are brought together, as paths may be very many."""
    return paths.select("path_id", F.posexplode("path").alias("seq", "node_id")).join(_few(nodes.select("node_id", "lat", "lon")), "node_id").select("path_id", "seq", "lon", "lat")


def route_lines(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, coordinates): [lon, lat] pairs in order."""
    return route_points(paths, nodes).groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"))


def _shown() -> Column:
    return F.struct("option", "path_type", F.bround("distance", 2).alias("distance"), F.bround("time", 2).alias("time"), F.bround("safety", 1).alias("safety"), F.bround("score", 4).alias("score"))


def decided(options: DataFrame, among: DataFrame | None = None, counted: str | None = None) -> DataFrame:
    """(request_id, recommended, comparison_summary) as structs: the document without its list of alternatives, which ``recommend`` gives as rows.

    ``among`` and ``counted`` as in ``recommend`` and ``comparison``.
    """
    return _best(_scored(options if among is None else among)).select("request_id", _shown().alias("recommended")).join(comparison(options, counted), "request_id").select("request_id", "recommended", F.struct("n_options", "min_distance", "max_distance", "min_time", "max_time", "min_safety", "max_safety").alias("comparison_summary"))


def decisions(options: DataFrame) -> DataFrame:
    """(request_id, document): recommended way, alternatives and summary as JSON. The alternatives of one request must fit into a string (2 GB)."""
    rest = recommend(options).groupBy("request_id").agg(F.array_sort(F.collect_list(F.when(~F.col("is_recommended"), _shown()))).alias("alternatives"))
    return decided(options).join(rest, "request_id").select("request_id", F.to_json(F.struct("recommended", "alternatives", "comparison_summary")).alias("document"))


def network(weights: DataFrame, both_ways: DataFrame | None = None, nodes: DataFrame | None = None, hourly: DataFrame | None = None) -> Network:
    """The graph in memory for batch planning. The number of edges is checked first; ``hourly`` (u, v, hour, predicted_time) has 24 rows an edge.

    Times of an undirected edge hold both ways where only one way is listed.
    """
    n = weights.count()
    if n > GRAPH_LIMIT:
        raise ValueError(f"{n} edges are more than {GRAPH_LIMIT}; use least_costs or simple_paths")
    edges = {}
    for r in weights.collect():
        d = r.asDict()
        u, v = d.pop("u"), d.pop("v")
        d["count"] = d.pop("frequency", 0)
        edges[(u, v)] = d
    if both_ways is not None:
        for r in both_ways.where("is_bidirectional").select("u", "v").collect():
            if (r[0], r[1]) in edges:
                edges.setdefault((r[1], r[0]), edges[(r[0], r[1])])
    if hourly is not None:
        listed = hourly.join(weights.select("u", "v"), ["u", "v"], "left_semi").groupBy("u", "v").agg(F.map_from_entries(F.collect_list(F.struct("hour", "predicted_time"))).alias("times"))
        for u, v, times in listed.collect():  # at most one row an edge
            edges[(u, v)]["hourly"] = times
        for (u, v), x in edges.items():
            if "hourly" not in x and "hourly" in edges.get((v, u), {}):
                x["hourly"] = edges[(v, u)]["hourly"]
    places = {r[0]: (r[1], r[2]) for r in nodes.select("node_id", "lat", "lon").collect()} if nodes is not None else {}
    return Network(edges, places)


def plan(requests: DataFrame, net: Network, objectives: tuple[str, ...] = ("safest", "fastest", "shortest", "frequent", "balanced"), blocked: dict[str, frozenset] | None = None) -> DataFrame:
    """(request_id, option, path_type, cost, path) for requests (request_id, start, goal, hour, ship_type), spread over tasks."""
    spark = requests.sparkSession
    shared = spark.sparkContext.broadcast((net, blocked or {}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, shut = shared.value
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                closed = shut.get(r.ship_type, frozenset())
                hour = None if pd.isna(r.hour) else int(r.hour)
                seen: list[list[int]] = []
                for o in objectives:
                    got = g.best(int(r.start), int(r.goal), g.cost(o, hour), closed)
                    if got and got[1] not in seen:
                        seen.append(got[1])
                        rows.append((r.request_id, len(seen), o.upper(), got[0], got[1]))
                if seen and len(seen) < 3:
                    c = g.cost("safest", hour)
                    more = [p for p in g.without_each(int(r.start), int(r.goal), c, seen[0], closed) if p not in seen]
                    for p in diverse(more, 3 - len(seen)):
                        seen.append(p)
                        rows.append((r.request_id, len(seen), "ALTERNATIVE", g.total(p, c), p))
            yield pd.DataFrame(rows, columns=["request_id", "option", "path_type", "cost", "path"]).astype({"path_type": object})

    return requests.mapInPandas(run, "request_id long, option int, path_type string, cost double, path array<long>")


def each_request(requests: DataFrame, net: Network, search: Callable[[Network, object], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``search`` gives for each request, spread over tasks."""
    shared = requests.sparkSession.sparkContext.broadcast(net)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for r in b.itertuples(index=False) for x in search(shared.value, r)], columns=names)

    return requests.mapInPandas(run, schema)


def endpoints(edges: DataFrame, nodes: DataFrame, kinds: list[str], least_m: float = 5000.0, sample: int = 600) -> DataFrame:
    """(ship_type, start, goal, dist): far pairs of the largest component, one for each type, chosen by a checksum of its name."""
    from fairway.operators.graph import components

    parts = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    top = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    some = parts.join(F.broadcast(top), "component").select(F.col("node").alias("node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id").orderBy(F.xxhash64("node_id"), "node_id").limit(sample)
    pairs = some.toDF("start", "lat1", "lon1").crossJoin(F.broadcast(some.toDF("goal", "lat2", "lon2"))).where("start < goal")  # at most sample rows a side
    far = pairs.withColumn("dist", F.round(geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 4)).where(F.col("dist") >= least_m)
    ranked = far.orderBy(F.desc("dist"), "start", "goal").limit(200).select("start", "goal", "dist")
    rows = [tuple(r) for r in ranked.collect()]
    import zlib

    chosen = [(k, *rows[zlib.crc32(k.encode()) % len(rows)]) for k in kinds] if rows else []
    return edges.sparkSession.createDataFrame(chosen, "ship_type string, start long, goal long, dist double")
