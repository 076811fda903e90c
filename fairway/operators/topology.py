"""The waterway graph: candidates, map matching, edges, filters, merging, hourly times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.config import DEFAULT, Settings
from fairway.functions import geo
from fairway.operators import graph, grid, kernels
from fairway.operators.clean import by_ship


def candidates(points: DataFrame, nodes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds candidates: nodes of the nine cells within the radius with emission exp(-d^2 / (2 sigma^2)), else the nearest with 0.1. Rows without any go."""
    cells = grid.cell_nodes(nodes, s.match_cell)
    t = points.withColumns({"__gl": geo.cell(F.col("lat"), s.match_cell), "__gn": geo.cell(F.col("lon"), s.match_cell)})
    j = t.join(cells, (t["__gl"] == cells["gl"]) & (t["__gn"] == cells["gn"]))
    all_ = F.transform("near", lambda n: F.struct(geo.haversine(F.col("lat"), F.col("lon"), n["lat"], n["lon"]).alias("d"), n["node_id"].alias("node_id"), n["lat"].alias("lat"), n["lon"].alias("lon")))
    j = j.withColumn("__all", F.array_sort(all_)).withColumn("__in", F.filter("__all", lambda c: c["d"] < s.match_radius))
    shaped = lambda a, e: F.transform(a, lambda c: F.struct(c["node_id"].alias("node_id"), c["lat"].alias("lat"), c["lon"].alias("lon"), c["d"].alias("d"), e(c).alias("emission")))
    near = shaped(F.col("__in"), lambda c: F.exp(-c["d"] * c["d"] / (2 * s.match_sigma * s.match_sigma)))
    only = shaped(F.slice("__all", 1, 1), lambda c: F.lit(0.1))
    return j.select(*points.columns, F.when(F.size("__in") > 0, near).otherwise(only).alias("candidates"))


def match(points: DataFrame, nodes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Visited nodes of each ship's segment by Viterbi decoding."""
    columns = ["ship_name", "trajectory_segment", "us", "row_idx", "lat", "lon", "speed", "course"]
    return kernels.match_ships(candidates(points.select(*columns), nodes, s))


def visits(points: DataFrame, nodes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Visited nodes by nearest node: the native counterpart of ``match``."""
    t = grid.nearest(points, nodes, s.match_cell, s.segment_node_radius).where("node_id is not null")
    w = by_ship()
    t = t.withColumn("__before", F.lag("node_id").over(w)).where("__before is null or __before <> node_id")
    return t.select("ship_name", "us", "row_idx", "node_id", "lat", "lon", "speed", "course")


def passages(visited: DataFrame, order: list[str]) -> DataFrame:
    """Steps between consecutive visits: from_node, to_node, distance, seconds, speed, course, hour."""
    group = [c for c in ("ship_name", "trajectory_segment") if c in visited.columns]
    w = Window.partitionBy(*group).orderBy(*order)
    nxt = {c: F.lead(c).over(w) for c in ("node_id", "us", "lat", "lon")}
    t = visited.select("ship_name", F.col("node_id").alias("from_node"), nxt["node_id"].alias("to_node"), geo.haversine(F.col("lat"), F.col("lon"), nxt["lat"], nxt["lon"]).alias("distance"), ((nxt["us"] - F.col("us")) / F.lit(1e6)).alias("seconds"), "speed", "course", geo.hour_of(F.col("us")).alias("hour"), "lat", "lon")
    return t.where("to_node is not null and from_node <> to_node")


def edges(steps: DataFrame) -> DataFrame:
    """Undirected edges u < v with weight, ships, means, direction counts."""
    keyed = steps.withColumns({"u": F.least("from_node", "to_node"), "v": F.greatest("from_node", "to_node")})
    return keyed.groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("weight"), F.count_distinct("ship_name").alias("ship_count"), F.avg("distance").alias("avg_distance"), F.avg("seconds").alias("avg_time"), F.avg("speed").alias("avg_speed"),
        F.avg("course").alias("avg_course"), F.sum((F.col("from_node") == F.col("u")).cast("long")).alias("forward"), F.sum((F.col("from_node") != F.col("u")).cast("long")).alias("backward"),
    ).withColumn("is_bidirectional", (F.least("forward", "backward") > 0))


def hourly_times(steps: DataFrame, found: DataFrame) -> DataFrame:
    """(u, v, hour, n, predicted_time) for all hours: the mean, up to a fifth less in hours of more than even traffic."""
    keyed = steps.groupBy(F.least("from_node", "to_node").alias("u"), F.greatest("from_node", "to_node").alias("v"), "hour").agg(F.count(F.lit(1)).alias("n"))
    every = found.select("u", "v", "weight", "avg_time", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    t = every.join(keyed, ["u", "v", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.least(F.lit(1.0), F.col("n") / F.greatest(F.col("weight") / 24.0, F.lit(1.0)))
    return t.select("u", "v", "hour", "n", (F.col("avg_time") * (1 - 0.2 * share)).alias("predicted_time"))


def strong_edges(found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return found.where(F.col("weight") >= s.min_edge_weight)


def used_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(graph.ends(found).select(F.col("node").alias("node_id")).distinct(), "node_id", "left_semi")


def isolated_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(graph.ends(found).select(F.col("node").alias("node_id")).distinct(), "node_id", "left_anti")


def merge_nodes(nodes: DataFrame, found: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Nodes under 50 m apart become the most frequent of them; edges are re-pointed, weights summed, other values the first survivor's."""
    pairs = grid.within(nodes.select("node_id", "lat", "lon"), nodes.select("node_id", "lat", "lon"), s.match_cell, s.node_merge_distance).where("node_id < r_node_id").select(F.col("node_id").alias("a"), F.col("r_node_id").alias("b"))
    leader = kernels.greedy_leaders(nodes, pairs, [])
    best = leader.join(nodes, "node_id").groupBy("leader").agg(F.max_by("node_id", F.struct("frequency", -F.col("node_id"))).alias("survivor"))
    target = leader.join(best, "leader").select("node_id", "survivor")
    kept = nodes.join(target.where("node_id = survivor").select("node_id"), "node_id", "left_semi")
    moved = found.join(target.select(F.col("node_id").alias("u"), F.col("survivor").alias("su")), "u").join(target.select(F.col("node_id").alias("v"), F.col("survivor").alias("sv")), "v").where("su <> sv")
    moved = moved.withColumns({"a": F.least("su", "sv"), "b": F.greatest("su", "sv"), "own": (F.struct("u", "v") == F.struct(F.least("su", "sv"), F.greatest("su", "sv"))).cast("int")})
    first = F.struct("own", F.col("weight"), -F.col("u"), -F.col("v"))
    means = {c: F.max_by(c, first).alias(c) for c in ("avg_distance", "avg_time", "avg_speed", "avg_course")}
    merged = moved.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max("ship_count").alias("ship_count"), *means.values(), F.sum("forward").alias("forward"), F.sum("backward").alias("backward"))
    return kept, merged.withColumnsRenamed({"a": "u", "b": "v"}).withColumn("is_bidirectional", F.least("forward", "backward") > 0)


def statistics(found: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree, mean clustering, components, largest component."""
    c = graph.clustering(found)
    parts = graph.components(found.select(F.col("u").alias("a"), F.col("v").alias("b"))).groupBy("component").count()
    a = c.agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.avg("coefficient").alias("mean_clustering"))
    return a.crossJoin(found.agg(F.count(F.lit(1)).alias("n_edges"))).crossJoin(parts.agg(F.count(F.lit(1)).alias("n_components"), F.max("count").alias("largest_component")))  # one row each


