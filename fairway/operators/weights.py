"""Travel times by edge and hour: segments mapped to edges, statistics, features, filling, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.config import DEFAULT, KNOTS_TO_MS, PERIODS, Settings
from fairway.functions import geo
from fairway.operators import graph, grid

HOURS = range(24)
KEY_HOURS = {"morning": 8, "midday": 12, "evening": 18, "night": 2}


def map_segments(segments: DataFrame, nodes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Segments with u, v: the nearest nodes of both ends within reach, where they differ."""
    t = grid.nearest(segments, nodes, s.match_cell, s.segment_node_radius, "start_lat", "start_lon", "u").drop("u_dist")
    t = grid.nearest(t.where("u is not null"), nodes, s.match_cell, s.segment_node_radius, "end_lat", "end_lon", "v").drop("v_dist")
    return t.where("v is not null and u <> v")


def edge_stats(mapped: DataFrame) -> DataFrame:
    """Times, speeds and reliability of each directed edge."""
    return mapped.groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("segment_count"), F.avg("distance").alias("avg_distance"), F.avg("time_diff").alias("avg_travel_time"), F.stddev_pop("time_diff").alias("std_travel_time"),
        F.min("time_diff").alias("min_travel_time"), F.max("time_diff").alias("max_travel_time"), F.median("time_diff").alias("median_travel_time"), F.avg("actual_speed").alias("avg_actual_speed"),
        F.stddev_pop("actual_speed").alias("std_actual_speed"), F.avg("reported_speed").alias("avg_reported_speed"), F.avg("speed_diff").alias("__diff"),
    ).withColumn("speed_reliability", F.greatest(F.lit(0.0), 1 - F.col("__diff") / F.greatest("avg_reported_speed", "avg_actual_speed", F.lit(1e-6)))).drop("__diff")


def direction_stats(mapped: DataFrame) -> DataFrame:
    """avg_bearing (plain and circular), std_bearing, avg_course_change of each edge."""
    sin, cos = F.avg(F.sin(F.radians("bearing"))), F.avg(F.cos(F.radians("bearing")))
    return mapped.groupBy("u", "v").agg(F.avg("bearing").alias("avg_bearing"), F.stddev_pop("bearing").alias("std_bearing"), F.avg("course_change").alias("avg_course_change"), geo.circular_mean(sin, cos).alias("circular_bearing"))


def octants(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("u", "v", geo.octant(F.col("bearing")).alias("octant")).agg(F.count(F.lit(1)).alias("n"))


def bidirectional(counts: DataFrame) -> DataFrame:
    """(u, v, is_bidirectional): some octant and its opposite hold numbers within a ratio over 0.3."""
    other = counts.select("u", "v", F.pmod(F.col("octant") + 4, F.lit(8)).alias("octant"), F.col("n").alias("m"))
    t = counts.join(other, ["u", "v", "octant"], "left")
    return t.groupBy("u", "v").agg(F.max(F.coalesce(F.least("n", "m") / F.greatest("n", "m"), F.lit(0.0))).alias("ratio")).select("u", "v", (F.col("ratio") > 0.3).alias("is_bidirectional"))


def period_weights(mapped: DataFrame) -> DataFrame:
    """Mean, deviation, count and ratio to the edge's mean of each time of day."""
    whole = mapped.groupBy("u", "v").agg(F.avg("time_diff").alias("whole"))
    part = mapped.groupBy("u", "v", "time_period").agg(F.avg("time_diff").alias("avg_time"), F.stddev_pop("time_diff").alias("std_time"), F.count(F.lit(1)).alias("sample_count"))
    return part.join(whole, ["u", "v"]).withColumn("weight_ratio", F.col("avg_time") / F.col("whole")).drop("whole")


def edge_period_features(mapped: DataFrame, narrow: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """The 22 features of every edge with two segments or more and time of day, and its targets.

    ``narrow`` is (u, v, waterway_type), ``betweenness`` (u < v, betweenness).
    """
    whole = mapped.groupBy("u", "v").agg(F.count(F.lit(1)).alias("all_count"), F.avg("distance").alias("avg_distance"), F.avg("bearing").alias("avg_bearing"), F.avg("course_change").alias("avg_course_change"), F.avg("reported_speed").alias("all_speed")).where("all_count >= 2")
    part = mapped.groupBy("u", "v", "time_period").agg(
        F.avg("reported_speed").alias("avg_reported_speed"), F.stddev_pop("reported_speed").alias("std_reported_speed"), F.least(F.avg("time_diff"), F.lit(3600.0)).alias("travel_time"),
        F.stddev_pop("course_change").alias("std_course_change"), F.floor(F.median("hour")).cast("int").alias("rep_hour"), F.avg("is_weekend").alias("weekend_share"), F.count(F.lit(1)).alias("sample_count"),
    )
    d = graph.degrees(mapped.select("u", "v").distinct())
    t = part.join(whole, ["u", "v"]).join(d.toDF("u", "degree_from"), "u").join(d.toDF("v", "degree_to"), "v").join(narrow.select("u", "v", (F.col("waterway_type") == "narrow").cast("int").alias("narrow")), ["u", "v"], "left")
    if betweenness is None:
        t = t.withColumn("betweenness", F.lit(0.0))
    else:
        t = t.join(betweenness.select(F.col("u").alias("bu"), F.col("v").alias("bv"), "betweenness"), (F.least("u", "v") == F.col("bu")) & (F.greatest("u", "v") == F.col("bv")), "left").drop("bu", "bv")
    peak, narrow_, turn = geo.is_peak(F.col("rep_hour")), F.coalesce("narrow", F.lit(0)), F.col("avg_course_change")
    bearing, hour = F.radians("avg_bearing"), F.radians(F.col("rep_hour") * 15.0)
    theory = F.col("avg_distance") / (F.greatest("all_speed", F.lit(0.5)) * KNOTS_TO_MS)
    return t.select(
        "u", "v", "time_period", "avg_reported_speed", "std_reported_speed", (F.col("std_reported_speed") / F.greatest("avg_reported_speed", F.lit(0.1))).alias("speed_cv"), "avg_bearing",
        F.sin(bearing).alias("bearing_sin"), F.cos(bearing).alias("bearing_cos"), "avg_course_change", "std_course_change", (turn * narrow_).alias("course_change_x_narrow"), peak.alias("is_peak"),
        (F.col("weekend_share") > 0.5).cast("int").alias("is_weekend"), narrow_.alias("narrow"), "rep_hour", F.sin(hour).alias("hour_sin"), F.cos(hour).alias("hour_cos"), "degree_from", "degree_to",
        F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), "sample_count", F.log1p("sample_count").alias("log_count"), (narrow_ * peak).alias("narrow_x_peak"), (turn * peak).alias("course_change_x_peak"),
        "travel_time", theory.alias("theoretical_time"), F.least(F.greatest(F.col("travel_time") / F.greatest(theory, F.lit(1.0)), F.lit(0.1)), F.lit(20.0)).alias("time_ratio"),
    )


def fill_hours(mapped: DataFrame, modelled: DataFrame | None = None) -> DataFrame:
    """(u, v, hour, n, predicted_time, source) for 24 hours of every edge.

    Two segments or more in the hour: their mean. One: 0.7 of it and 0.3 of the model. None: the time
    of day's mean if it has two or more, else the model. The model defaults to the edge's mean.
    """
    hourly = mapped.groupBy("u", "v", "hour").agg(F.count(F.lit(1)).alias("n"), F.avg("time_diff").alias("hour_mean"))
    period = mapped.groupBy("u", "v", "time_period").agg(F.count(F.lit(1)).alias("pn"), F.avg("time_diff").alias("period_mean"))
    whole = mapped.groupBy("u", "v").agg(F.avg("time_diff").alias("edge_mean"))
    every = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")).withColumn("time_period", geo.time_period(F.col("hour")))
    t = every.join(hourly, ["u", "v", "hour"], "left").join(period, ["u", "v", "time_period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if modelled is not None:
        t = t.join(modelled.select("u", "v", "hour", "model_time"), ["u", "v", "hour"], "left").withColumn("model_time", F.coalesce("model_time", "edge_mean"))
    else:
        t = t.withColumn("model_time", F.col("edge_mean"))
    by_hour, by_period = F.col("n") >= 2, F.coalesce(F.col("pn") >= 2, F.lit(False))
    value = F.when(by_hour, F.col("hour_mean")).when(F.col("n") == 1, 0.7 * F.col("hour_mean") + 0.3 * F.col("model_time")).when(by_period, F.col("period_mean")).otherwise(F.col("model_time"))
    source = F.when(by_hour, "hour").when(F.col("n") == 1, "blend").when(by_period, "period").otherwise("model")
    return t.select("u", "v", "hour", "n", value.alias("predicted_time"), source.alias("source"))


def time_matrix(filled: DataFrame) -> DataFrame:
    """edge_id, u, v, h00..h23."""
    wide = filled.groupBy("u", "v").agg(*(F.max(F.when(F.col("hour") == h, F.col("predicted_time"))).alias(f"h{h:02d}") for h in HOURS))
    return wide.select(F.concat_ws("_", F.col("u"), F.col("v")).alias("edge_id"), "*")


def flat_features(stats: DataFrame, directions: DataFrame, periods: DataFrame, filled: DataFrame, waterway: DataFrame, both: DataFrame, degree: DataFrame, betweenness: DataFrame | None = None, model: str = "empirical") -> DataFrame:
    """The wide table of edge features, one row for each edge."""
    wide = time_matrix(filled).select("u", "v", *(F.col(f"h{h:02d}").alias(f"predicted_time_h{h:02d}") for h in HOURS))
    parts = []
    for name, *_ in PERIODS:
        of = lambda c, name=name: F.max(F.when(F.col("time_period") == name, F.col(c)))
        parts += [of("avg_time").alias(f"{name}_avg_time"), of("weight_ratio").alias(f"{name}_weight_ratio"), F.coalesce(of("sample_count"), F.lit(0)).alias(f"{name}_sample_count")]
    by_period = periods.groupBy("u", "v").agg(*parts)
    t = stats.join(wide, ["u", "v"]).join(by_period, ["u", "v"], "left").join(directions, ["u", "v"], "left").join(waterway.select("u", "v", "waterway_type"), ["u", "v"], "left").join(both, ["u", "v"], "left")
    t = t.join(degree.toDF("u", "node_degree_from"), "u", "left").join(degree.toDF("v", "node_degree_to"), "v", "left")
    if betweenness is not None:
        t = t.join(betweenness.select(F.col("u").alias("bu"), F.col("v").alias("bv"), F.col("betweenness").alias("edge_betweenness")), (F.least("u", "v") == F.col("bu")) & (F.greatest("u", "v") == F.col("bv")), "left").drop("bu", "bv")
    else:
        t = t.withColumn("edge_betweenness", F.lit(0.0))
    t = t.withColumns({f"predicted_time_{k}": F.col(f"predicted_time_h{h:02d}") for k, h in KEY_HOURS.items()})
    return t.withColumns({"model_used": F.lit(model), "waterway_type_code": (F.col("waterway_type") == "narrow").cast("int")}).withColumnsRenamed({"u": "from_node", "v": "to_node"})


def dynamic_weight(filled: DataFrame, periods: DataFrame, stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """(u, v, hour) asked for with the hour's time, else the time of day's, else the edge's mean."""
    t = wanted.withColumn("time_period", geo.time_period(F.col("hour")))
    t = t.join(filled.select("u", "v", "hour", "predicted_time"), ["u", "v", "hour"], "left").join(periods.select("u", "v", "time_period", "avg_time"), ["u", "v", "time_period"], "left").join(stats.select("u", "v", "avg_travel_time"), ["u", "v"], "left")
    return t.select("u", "v", "hour", F.coalesce("predicted_time", "avg_time", "avg_travel_time").alias("weight"))


def peak_ratio(filled: DataFrame) -> DataFrame:
    """(u, v, ratio): mean of hours 7 to 9 over mean of hours 0 to 4."""
    mean = lambda lo, hi: F.avg(F.when(F.col("hour").between(lo, hi), F.col("predicted_time")))
    return filled.groupBy("u", "v").agg((mean(7, 9) / mean(0, 4)).alias("ratio"))


def hourly_volume(mapped: DataFrame) -> DataFrame:
    """Flow of each edge and hour with its share of the edge's busiest hour as congestion level."""
    t = mapped.groupBy("u", "v", "hour").agg(F.count(F.lit(1)).alias("flow"))
    share = F.col("flow") / F.max("flow").over(Window.partitionBy("u", "v"))
    level: Column = F.when(share < 0.25, "free").when(share < 0.5, "light").when(share < 0.7, "moderate").when(share < 0.85, "heavy").otherwise("severe")
    return t.select("u", "v", "hour", "flow", level.alias("congestion"))
