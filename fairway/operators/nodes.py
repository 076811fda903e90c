"""Key nodes of trajectories: turn points, stops, grid nodes, merging and direction types."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.config import DEFAULT, METRES_PER_DEGREE, Settings
from fairway.functions import geo
from fairway.operators import grid, kernels
from fairway.operators.clean import by_ship

STOP_CELL = 50 / METRES_PER_DEGREE


def heading(sin: Column, cos: Column) -> Column:
    """Circular mean of a node by the C library's atan2, which gives the nearest double in all but rare cases.

    Java's may be two units off in the last place, which moves headings on the edge of an octant to the other side.
    """

    def atan2(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([math.atan2(a, b) for a, b in zip(y, x, strict=True)], dtype=float)

    return F.pmod(F.degrees(F.pandas_udf(atan2, "double")(sin, cos)) + 360.0, F.lit(360.0))


def with_bends(df: DataFrame) -> DataFrame:
    """i (from 0), n, bearing_in, bearing_out and curvature of every row of a ship."""
    w = by_ship()
    p = {k: (F.lag(k).over(w), F.col(k), F.lead(k).over(w)) for k in ("lat", "lon")}
    return df.withColumns({
        "i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("ship_name")),
        "bearing_in": geo.bearing(p["lat"][0], p["lon"][0], p["lat"][1], p["lon"][1]), "bearing_out": geo.bearing(p["lat"][1], p["lon"][1], p["lat"][2], p["lon"][2]),
        "curvature": geo.curvature(list(p["lat"]), list(p["lon"])),
    })


def turn_points(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Rows 2 to n - 3 of each ship as turn_point or waypoint."""
    t = with_bends(df).where("i >= 2 and i < n - 2")
    turns = (F.col("curvature") > 0.001) | (geo.angle_difference(F.col("bearing_in"), F.col("bearing_out")) > s.direction_threshold)
    return t.select("ship_name", "us", "row_idx", "lat", "lon", "speed", "course", F.when(turns, "turn_point").otherwise("waypoint").alias("type"))


def stop_islands(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Longest runs of rows under the stop speed that last over the least duration."""
    w = by_ship()
    slow = (F.col("speed") < s.stop_speed).cast("int")
    t = df.withColumn("slow", slow).withColumn("edge", F.coalesce((F.col("slow") != F.lag("slow").over(w)).cast("int"), F.lit(1)))
    t = t.withColumn("island", F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.where("slow = 1").groupBy("ship_name", "island").agg(
        F.min("us").alias("us"), F.min_by("course", F.struct("us", "row_idx")).alias("course"), F.min_by("speed", F.struct("us", "row_idx")).alias("speed"), F.min("row_idx").alias("row_idx"),
        geo.mean_degrees("lat").alias("lat"), geo.mean_degrees("lon").alias("lon"), F.count(F.lit(1)).alias("n_points"), ((F.max("us") - F.min("us")) / F.lit(1e6)).alias("duration"),
    )
    return runs.where(F.col("duration") > s.stop_min_duration).drop("island")


def merge_stops(stops: DataFrame) -> DataFrame:
    """Stops of one cell of about 50 m as one: mean place, summed duration, the first stop's ship, time and course."""
    t = stops.withColumns({"gl": geo.cell(F.col("lat"), STOP_CELL), "gn": geo.cell(F.col("lon"), STOP_CELL)})
    first = F.struct("ship_name", "us")
    return t.groupBy("gl", "gn").agg(
        geo.mean_degrees("lat").alias("lat"), geo.mean_degrees("lon").alias("lon"), F.sum("duration").alias("duration"), F.count(F.lit(1)).alias("merged_count"),
        F.min_by("ship_name", first).alias("ship_name"), F.min_by("us", first).alias("us"), F.min_by("course", first).alias("course"), F.min_by("speed", first).alias("speed"),
    )


def feature_points(df: DataFrame, s: Settings = DEFAULT, simplify: bool = False) -> DataFrame:
    """Turn points, waypoints and merged stops. ``simplify`` keeps only the rows that line simplification keeps."""
    kept = turn_points(df, s)
    if simplify:
        kept = kept.join(kernels.simplify(df, s.dp_tolerance, s.dp_window), ["ship_name", "us", "row_idx"], "left_semi")
    stops = merge_stops(stop_islands(df, s)).withColumn("type", F.lit("stop_point"))
    names = ["ship_name", "us", "lat", "lon", "speed", "course", "type"]
    return kept.select(*names).unionByName(stops.select(*names))


def grid_nodes(points: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One node for each occupied cell: mean place, commonest type (ties by name), counts and circular heading; ids by frequency."""
    t = points.withColumns({"gl": geo.cell(F.col("lat"), s.node_cell), "gn": geo.cell(F.col("lon"), s.node_cell)})
    sin, cos = F.sin(F.radians("course")), F.cos(F.radians("course"))
    typed = t.groupBy("gl", "gn", "type").agg(F.count(F.lit(1)).alias("n"))
    kinds = typed.groupBy("gl", "gn").agg(F.max_by("type", F.struct(F.col("n"), F.expr("-ascii(type)"))).alias("type"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("type_distribution"))
    sums = t.groupBy("gl", "gn").agg(
        geo.mean_degrees("lat").alias("lat"), geo.mean_degrees("lon").alias("lon"), F.count(F.lit(1)).alias("frequency"), F.count_distinct("ship_name").alias("ship_count"),
        F.avg(sin).alias("sin"), F.avg(cos).alias("cos"),
    )
    joined = sums.join(kinds, ["gl", "gn"]).select("gl", "gn", "lat", "lon", "type", "frequency", "ship_count", "type_distribution", heading(F.col("sin"), F.col("cos")).alias("heading"), geo.concentration(F.col("sin"), F.col("cos")).alias("heading_concentration"))
    return grid.numbered(joined, ["frequency", "gl"], ("frequency",), ["gn"])


def adjacent_pairs(nodes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Pairs of nodes in neighbouring cells nearer than the merge distance."""
    pairs = grid.within(nodes.select("node_id", "lat", "lon", F.col("gl").alias("g1"), F.col("gn").alias("g2")), nodes.select("node_id", "lat", "lon", F.col("gl").alias("g1"), F.col("gn").alias("g2")), s.node_cell, s.adjacent_merge_m)
    return pairs.where("(g1, g2) <> (r_g1, r_g2) and node_id < r_node_id").select(F.col("node_id").alias("a"), F.col("r_node_id").alias("b"), "dist")


def merge_adjacent(nodes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Greedy merge in cell order of neighbours under 30 m; frequency-weighted place and heading, summed counts.

    Chains of pairs never leave a connected component, so the greedy pass runs inside each.
    """
    leader = kernels.greedy_leaders(nodes, adjacent_pairs(nodes, s), ["gl", "gn"])
    t = nodes.join(leader, "node_id")
    f = F.col("frequency")
    sin, cos = F.col("heading_concentration") * F.sin(F.radians("heading")), F.col("heading_concentration") * F.cos(F.radians("heading"))
    merged = t.groupBy("leader").agg(
        (F.sum(f * F.col("lat")) / F.sum(f)).alias("lat"), (F.sum(f * F.col("lon")) / F.sum(f)).alias("lon"), F.sum(f).alias("frequency"), F.sum("ship_count").alias("ship_count"),
        F.max_by("type", F.struct(f, -F.col("node_id"))).alias("type"), (F.sum(f * sin) / F.sum(f)).alias("sin"), (F.sum(f * cos) / F.sum(f)).alias("cos"), F.count(F.lit(1)).alias("merged_nodes"),
    )
    return merged.select(F.col("leader").alias("node_id"), "lat", "lon", "type", "frequency", "ship_count", "merged_nodes", heading(F.col("sin"), F.col("cos")).alias("heading"), geo.concentration(F.col("sin"), F.col("cos")).alias("heading_concentration"))


def direction_types(nodes: DataFrame, segments: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """detailed_type from the bearings of segments whose midpoint lies within about 100 m (in degrees) of a node."""
    r = s.direction_radius_deg
    mids = segments.select(((F.col("start_lat") + F.col("end_lat")) / 2).alias("mlat"), ((F.col("start_lon") + F.col("end_lon")) / 2).alias("mlon"), "bearing")
    near = grid.spread(nodes.select("node_id", "lat", "lon"), r)
    t = mids.withColumns({"gl": geo.cell(F.col("mlat"), r), "gn": geo.cell(F.col("mlon"), r)}).join(near, ["gl", "gn"])
    t = t.where(F.hypot(F.col("mlat") - F.col("lat"), F.col("mlon") - F.col("lon")) <= r).select("node_id", "bearing")
    typed = kernels.direction_type(t)
    return nodes.join(typed, "node_id", "left").withColumn("detailed_type", F.coalesce("direction_type", "type")).drop("direction_type")


def extract_nodes(df: DataFrame, segments: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Feature points, grid nodes, direction types."""
    return direction_types(grid_nodes(feature_points(df, s, simplify=True), s), segments, s)
