"""Movement between consecutive reports, and the density of traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairway.config import DEFAULT, MS_TO_KNOTS, Settings
from fairway.functions import geo
from fairway.operators import grid
from fairway.operators.clean import by_ship


def movement_segments(df: DataFrame) -> DataFrame:
    """Steps of a ship that take under a day, cover 10 m or more and go half a knot or faster."""
    w = by_ship()
    nxt = {c: F.lead(c).over(w) for c in ("us", "lat", "lon", "speed", "course")}
    t = df.select(
        "ship_name", "us", "row_idx", F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"), nxt["lat"].alias("end_lat"), nxt["lon"].alias("end_lon"),
        ((nxt["us"] - F.col("us")) / F.lit(1e6)).alias("time_diff"), ((F.col("speed") + nxt["speed"]) / 2).alias("reported_speed"), geo.angle_difference(F.col("course"), nxt["course"]).alias("course_change"),
    )
    t = t.withColumn("distance", geo.haversine(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon")))
    t = t.where("time_diff > 0 and time_diff < 86400 and distance >= 10").withColumn("actual_speed", F.col("distance") / F.col("time_diff") * MS_TO_KNOTS).where("actual_speed >= 0.5")
    hour = geo.hour_of(F.col("us"))
    return t.withColumns({
        "speed_diff": F.abs(F.col("actual_speed") - F.col("reported_speed")), "bearing": geo.bearing(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon")),
        "hour": hour, "is_peak_hour": geo.is_peak(hour), "is_weekend": geo.is_weekend(F.col("us")), "time_period": geo.time_period(hour),
    })


def density_grid(segments: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(gl, gn, n): midpoints in each cell."""
    mid = [geo.cell((F.col(f"start_{c}") + F.col(f"end_{c}")) / 2, s.density_cell) for c in ("lat", "lon")]
    return segments.groupBy(mid[0].alias("gl"), mid[1].alias("gn")).agg(F.count(F.lit(1)).alias("n"))


def density_at(df: DataFrame, density: DataFrame, key: list[str], s: Settings = DEFAULT, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds the mean count over the occupied cells among the nine around a place, 0 if none is. ``key`` is unique."""
    around = grid.spread(df.select(*key, lat, lon), s.density_cell, lat, lon).join(density, ["gl", "gn"]).groupBy(*key).agg(F.avg("n").alias("density"))
    return df.join(around, key, "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def waterway_types(edges: DataFrame, nodes: DataFrame, density: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds density at the edge's midpoint and waterway_type: narrow from the 75th percentile of node densities on."""
    rated = density_at(nodes.select("node_id", "lat", "lon"), density, ["node_id"], s)
    limit = rated.agg(F.percentile("density", 0.75).alias("limit"))
    place = nodes.select("node_id", "lat", "lon")
    e = edges.join(place.toDF("u", "lat_u", "lon_u"), "u").join(place.toDF("v", "lat_v", "lon_v"), "v")
    e = e.withColumns({"mid_lat": (F.col("lat_u") + F.col("lat_v")) / 2, "mid_lon": (F.col("lon_u") + F.col("lon_v")) / 2})
    e = density_at(e, density, ["u", "v"], s, "mid_lat", "mid_lon")
    e = e.crossJoin(F.broadcast(limit))  # one row
    return e.withColumn("waterway_type", F.when(F.col("density") >= F.col("limit"), "narrow").otherwise("open")).drop("limit", "mid_lat", "mid_lon", "lat_u", "lon_u", "lat_v", "lon_v")
