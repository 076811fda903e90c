"""Clusters of nodes: grid or density clusters, centres, final types, refinement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.config import DEFAULT, METRES_PER_DEGREE, Settings
from fairway.functions import geo
from fairway.operators import graph, grid, kernels

SPECIAL = ("bifurcation_point", "merge_point", "turn_point", "port_area")


def heading_features(nodes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Metres about the mean position, and the heading as a vector of heading_weight times its concentration."""
    mean = nodes.agg(F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    t = nodes.crossJoin(F.broadcast(mean))  # one row
    r = F.radians("heading")
    return t.withColumns({
        "x": (F.col("lon") - F.col("mean_lon")) * METRES_PER_DEGREE * F.cos(F.radians("mean_lat")), "y": (F.col("lat") - F.col("mean_lat")) * METRES_PER_DEGREE,
        "hx": s.heading_weight * F.sin(r) * F.col("heading_concentration"), "hy": s.heading_weight * F.cos(r) * F.col("heading_concentration"),
    }).drop("mean_lat", "mean_lon")


def grid_clusters(nodes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds cluster (cell and heading octant, -1 for scattered headings) and is_noise: cells with fewer than min_samples nodes."""
    size = s.cluster_eps / METRES_PER_DEGREE
    width = size / F.cos(F.radians(F.col("mean_lat")))
    mean = nodes.agg(F.avg("lat").alias("mean_lat"))
    t = nodes.crossJoin(F.broadcast(mean))  # one row
    t = t.withColumns({"cl": geo.cell(F.col("lat"), size), "cn": (F.col("lon") / width).cast("int"), "co": F.when(F.col("heading_concentration") > 0.3, geo.octant(F.col("heading"))).otherwise(-1)})
    w = Window.partitionBy("cl", "cn", "co")
    return t.withColumn("is_noise", F.count(F.lit(1)).over(w) < s.cluster_min_samples).drop("mean_lat")


def density_clusters(nodes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Density clusters on heading features: neighbours by grid join, cores joined into components, borders to the least cluster."""
    f = heading_features(nodes, s).select("node_id", "x", "y", "hx", "hy")
    e = s.cluster_eps
    key = lambda c: F.floor(F.col(c) / e).cast("long")
    left = f.withColumns({"kx": key("x"), "ky": key("y")})
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    right = left.withColumn("d", F.explode(steps)).select(*(F.col(c).alias(f"r_{c}") for c in ("node_id", "x", "y", "hx", "hy")), (F.col("kx") + F.col("d.a")).alias("kx"), (F.col("ky") + F.col("d.b")).alias("ky"))
    square = sum((F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}")) for c in ("x", "y", "hx", "hy"))
    near = left.join(right, ["kx", "ky"]).where(square <= e * e).select("node_id", F.col("r_node_id").alias("other"))
    core = near.groupBy("node_id").count().where(F.col("count") >= s.cluster_min_samples).select("node_id")
    joined = near.join(core, "node_id").join(core.withColumnRenamed("node_id", "other"), "other")
    parts = graph.components(joined.select(F.col("node_id").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("node_id"), F.col("component").alias("cluster"))
    cores = core.join(parts, "node_id", "left").select("node_id", F.coalesce("cluster", "node_id").alias("cluster"))
    border = near.join(core, "node_id", "left_anti").join(cores.withColumnRenamed("node_id", "other"), "other").groupBy("node_id").agg(F.min("cluster").alias("cluster"))
    return nodes.join(cores.unionByName(border), "node_id", "left").withColumn("is_noise", F.col("cluster").isNull()).withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def aggregate(nodes: DataFrame, key: list[str], centre: str = "mean") -> DataFrame:
    """One row for each cluster: summed frequency, commonest type by frequency, place, weighted heading, node_count; noise rows stay.

    ``centre``: "mean" (frequency-weighted) or "kde" (member of greatest density).
    """
    f = F.col("frequency")
    r = F.radians("heading")
    sin, cos = F.sum(f * F.sin(r)) / F.sum(f), F.sum(f * F.cos(r)) / F.sum(f)
    kind = "detailed_type" if "detailed_type" in nodes.columns else "type"
    members = nodes.where("not is_noise")
    by_type = members.groupBy(*key, F.col(kind).alias("kind")).agg(F.sum("frequency").alias("f"))
    top = by_type.groupBy(*key).agg(F.max_by("kind", F.struct(F.col("f"), F.expr("-ascii(kind)"))).alias("type"), F.sum(F.when(F.col("kind") == "stop_point", F.col("f")).otherwise(0)).alias("stop_frequency"))
    sums = members.groupBy(*key).agg(
        F.sum(f).alias("frequency"), F.count(F.lit(1)).alias("node_count"), F.sum("ship_count").alias("ship_count"), F.min("node_id").alias("node_id"),
        (F.sum(f * F.col("lat")) / F.sum(f)).alias("lat"), (F.sum(f * F.col("lon")) / F.sum(f)).alias("lon"), geo.circular_mean(sin, cos).alias("heading"), geo.concentration(sin, cos).alias("heading_concentration"),
    )
    out = sums.join(top, key)
    if centre == "kde":
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            p = pdf.sort_values("node_id")
            lat, lon = kernels.kde_centre(p["lat"].to_numpy(), p["lon"].to_numpy(), p["frequency"].to_numpy(dtype=float))
            return p.iloc[:1][key].assign(lat=lat, lon=lon)

        kinds = ", ".join(f"{c} {dict(members.dtypes)[c]}" for c in key)
        places = members.groupBy(*key).applyInPandas(run, f"{kinds}, lat double, lon double")
        out = out.drop("lat", "lon").join(places, key)
    names = ["node_id", "lat", "lon", "type", "frequency", "ship_count", "node_count", "stop_frequency", "heading", "heading_concentration", "is_noise"]
    noise = nodes.where("is_noise").select("node_id", "lat", "lon", F.col(kind).alias("type"), "frequency", "ship_count", F.lit(1).cast("long").alias("node_count"), F.when(F.col(kind) == "stop_point", F.col("frequency")).otherwise(0).alias("stop_frequency"), "heading", "heading_concentration", "is_noise")
    return out.withColumn("is_noise", F.lit(False)).select(*names).unionByName(noise.select(*names))


def final_types(clusters: DataFrame) -> DataFrame:
    """Adds final_type."""
    kind, f = F.col("type"), F.col("frequency")
    noise = F.when((f >= 5) | kind.isin(*SPECIAL[:3]), kind)
    port = F.when(kind.isin("bifurcation_point", "merge_point") & (F.col("stop_frequency") > 0.5 * f), "port_area").otherwise(kind)
    return clusters.withColumn("final_type", F.coalesce(F.when(F.col("is_noise"), noise).otherwise(F.when(f >= 10, port)), F.lit("low_frequency_point")))


def merge_targets(clusters: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(small, large, dist): for each small cluster the best large one within reach: same type first, then nearer."""
    cols = ["node_id", "lat", "lon", "type"]
    large = clusters.where(F.col("node_count") >= s.refine_min_size).select(*cols)
    small = clusters.where(F.col("node_count") < s.refine_min_size).select(*cols)
    size = s.refine_distance / 70_000  # degrees; above the distance on both axes below 50 degrees of latitude
    pairs = grid.within(small, large, size, s.refine_distance)
    w = Window.partitionBy("node_id").orderBy((F.col("type") != F.col("r_type")).cast("int"), F.round("dist", 6), "r_node_id")
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(F.col("node_id").alias("small"), F.col("r_node_id").alias("large"), "dist")


def unmerged(clusters: DataFrame, targets: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Small clusters without a target that are worth keeping."""
    small = clusters.where(F.col("node_count") < s.refine_min_size)
    alone = small.join(targets, small["node_id"] == targets["small"], "left_anti")
    return alone.where(F.col("type").isin(*SPECIAL) & (F.col("frequency") >= 3))


def refine(clusters: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Small clusters join a large one; important ones stay; the rest go. Without any large cluster all stay. Ids by frequency."""
    targets = merge_targets(clusters, s)
    large = clusters.where(F.col("node_count") >= s.refine_min_size)
    gained = targets.join(clusters.select(F.col("node_id").alias("small"), F.col("frequency").alias("f"), F.col("ship_count").alias("n")), "small").groupBy("large").agg(F.sum("f").alias("gained"), F.sum("n").alias("ships"))
    grown = large.join(gained, large["node_id"] == gained["large"], "left").withColumns({"frequency": F.col("frequency") + F.coalesce("gained", F.lit(0)), "ship_count": F.col("ship_count") + F.coalesce("ships", F.lit(0))}).drop("large", "gained", "ships")
    kept = grown.unionByName(unmerged(clusters, targets, s))
    if large.isEmpty():
        kept = clusters
    return grid.numbered(kept.withColumnRenamed("node_id", "old_id"), ["frequency"], ("frequency",), ["old_id"])
