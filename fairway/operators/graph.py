"""Graph operators on edge tables: components, degrees, triangles, betweenness, reachability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.session import delete, new_table, write, written

MAX_ROUNDS = 60
IN_TASK = 200_000  # edges up to which a walk runs in one task instead of in rounds


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the least node reachable.

    Up to IN_TASK edges are joined in one task. Beyond, large star: every larger neighbour of a node
    moves to the node's least neighbour; small star: a node and its smaller neighbours move to the
    least of them. Both keep components, and rounds grow with the logarithm of the longest path.
    Only edges are kept between rounds, in the shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = new_table(spark, "edges")
    write(pairs, path)
    if spark.read.parquet(path).count() <= IN_TASK:
        joined = spark.read.parquet(path).coalesce(1).mapInArrow(_joined, "node long, component long")
        return written(joined, "components")
    before = None
    for _ in range(MAX_ROUNDS):
        now = spark.read.parquet(path)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if state == before:
            break
        before = state
        after = new_table(spark, "edges")
        write(_small_star(_large_star(now)), after)
        delete(spark, path)
        path = after
    else:
        raise RuntimeError("components did not settle")
    done = spark.read.parquet(path)  # by now every edge leads to the least node
    return done.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(done.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def ends(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, other): every edge from both its ends."""
    return edges.select(F.col(u).alias("node"), F.col(v).alias("other")).unionByName(edges.select(F.col(v).alias("node"), F.col(u).alias("other")))


def degrees(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    return ends(edges, u, v).groupBy("node").agg(F.count_distinct("other").alias("degree"))


def clustering(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, degree, triangles, coefficient) of an undirected graph, each edge once.

    Edges point from the end of lower degree to the other, so the pairs of out-edges at a node that
    are looked up stay near the square root of the edges.
    """
    d = degrees(edges, u, v)
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b"))
    e = e.join(d.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    out = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"))
    wedge = out.alias("x").join(out.alias("y"), F.col("x.s") == F.col("y.s")).where("x.t < y.t").select(F.col("x.s").alias("s"), F.col("x.t").alias("p"), F.col("y.t").alias("q"))
    closed = wedge.join(e.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")), ["p", "q"])
    corner = closed.select(F.explode(F.array("s", "p", "q")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    t = d.join(corner, "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))
    return t.withColumn("coefficient", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def adjacency(edges: DataFrame, u: str = "u", v: str = "v", limit: int = 2_000_000) -> dict[int, list[int]]:
    """Neighbours of every node, for kernels that walk a whole graph. The number of edges is checked first."""
    n = edges.count()
    if n > limit:
        raise ValueError(f"{n} edges are more than {limit}; use the distributed operators")
    out: dict[int, list[int]] = {}
    for r in edges.select(u, v).distinct().orderBy(u, v).collect():
        out.setdefault(r[0], []).append(r[1])
        out.setdefault(r[1], []).append(r[0])
    return out


def dependencies(graph: dict[int, list[int]], source: int) -> dict[tuple[int, int], float]:
    """Shares of shortest paths from one source over each edge (u < v)."""
    order, before, paths, depth = [], {source: []}, {source: 1.0}, {source: 0}
    level = [source]
    while level:
        after: list[int] = []
        for x in level:
            order.append(x)
            for y in graph.get(x, ()):
                if y not in depth:
                    depth[y], paths[y], before[y] = depth[x] + 1, 0.0, []
                    after.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
                    before[y].append(x)
        level = after
    flow = dict.fromkeys(order, 0.0)
    out: dict[tuple[int, int], float] = {}
    for y in reversed(order):
        for x in before[y]:
            share = paths[x] / paths[y] * (1 + flow[y])
            key = (x, y) if x < y else (y, x)
            out[key] = out.get(key, 0.0) + share
            flow[x] += share
    return out


def edge_betweenness(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(u, v, betweenness) of the undirected graph, exact over all sources and normalised to 0..1; sources are spread over tasks."""
    spark = edges.sparkSession
    graph = adjacency(edges, u, v)
    shared = spark.sparkContext.broadcast(graph)
    n = len(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], float] = {}
        for b in batches:
            for s in b["node"]:
                for k, x in dependencies(shared.value, int(s)).items():
                    total[k] = total.get(k, 0.0) + x
        yield pd.DataFrame({"u": [k[0] for k in total], "v": [k[1] for k in total], "x": list(total.values())}).astype({"u": "int64", "v": "int64", "x": "float64"})

    sources = ends(edges, u, v).select("node").distinct()
    summed = sources.mapInPandas(run, "u long, v long, x double").groupBy("u", "v").agg(F.sum("x").alias("x"))
    return summed.select("u", "v", (F.col("x") / np.float64(max(1, n * (n - 1))).item()).alias("betweenness"))


def reachable(edges: DataFrame, start: int, u: str = "u", v: str = "v", most_steps: int = 10_000) -> DataFrame:
    """(node, steps) of every node reachable along the edges' direction."""
    spark = edges.sparkSession
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).distinct()
    if 0 < e.count() <= IN_TASK:
        return e.coalesce(1).mapInArrow(_walk_from(start), "node long, steps int")
    found = spark.createDataFrame([(start, 0)], "node long, steps int")
    front = found
    for step in range(1, most_steps):
        new = front.join(e, front["node"] == e["u"]).select(F.col("v").alias("node")).distinct().join(found, "node", "left_anti").withColumn("steps", F.lit(step))
        path = new_table(spark, "front")
        write(new, path)
        front = spark.read.parquet(path)
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def _walk_from(start: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[int]] = {}
        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                out.setdefault(u, []).append(v)
        steps, level = {start: 0}, [start]
        while level:
            after = []
            for u in level:
                for v in out.get(u, ()):
                    if v not in steps:
                        steps[v] = steps[u] + 1
                        after.append(v)
            level = after
        yield pa.RecordBatch.from_arrays([pa.array(list(steps), pa.int64()), pa.array(list(steps.values()), pa.int32())], names=["node", "steps"])

    return run
