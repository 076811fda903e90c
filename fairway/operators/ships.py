"""Ships: types, profiles, channel constraints, passability and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.config import DEFAULT_TYPE, NAME_KEYWORDS, SHIP_TEMPLATES, SPEED_TYPES
from fairway.functions import geo
from fairway.operators import graph


def templates(spark: SparkSession) -> DataFrame:
    """The table of ship types, with risk level and maneuverability."""
    rows = [(k, *map(float, v)) for k, v in SHIP_TEMPLATES.items()]
    t = spark.createDataFrame(rows, "ship_type string, length double, width double, draft double, height double, tonnage double, max_speed double")
    return with_levels(t)


def with_levels(ships: DataFrame) -> DataFrame:
    level = F.when((F.col("draft") > 10) | (F.col("tonnage") > 50000), "high").when((F.col("draft") > 5) | (F.col("tonnage") > 10000), "medium").otherwise("low")
    return ships.withColumns({"risk_level": level, "maneuverability": F.least(F.greatest(1 - F.col("length") / 400.0, F.lit(0.1)), F.lit(1.0))})


def type_from_name(name: Column) -> Column:
    """Type of the first key word in the name, null if there is none."""
    out = F.lit(None).cast("string")
    for word, kind in reversed(NAME_KEYWORDS):
        out = F.when(F.contains(F.upper(name), F.lit(word.upper())), kind).otherwise(out)
    return out


def type_from_speed(speed: Column) -> Column:
    """Type of the first speed range that holds the speed."""
    out = F.lit(DEFAULT_TYPE)
    for low, high, kind in reversed(SPEED_TYPES):
        out = F.when((speed >= low) & (speed < high), kind).otherwise(out)
    return out


def profiles(points: DataFrame) -> DataFrame:
    """Per ship: largest and mean speed, rows, type from the name, else from the largest speed, with the type's measures."""
    t = points.groupBy("ship_name").agg(F.max("speed").alias("top_speed"), F.avg("speed").alias("avg_speed"), F.count(F.lit(1)).alias("record_count"))
    t = t.withColumn("ship_type", F.coalesce(type_from_name(F.col("ship_name")), type_from_speed(F.col("top_speed"))))
    return t.join(F.broadcast(templates(points.sparkSession)), "ship_type")  # ten rows


def resolve(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Measures of each request: its own, else the named ship's, else the type's, else the default type's.

    Requests have request_id, ship_name, ship_type and optional measures (null where not given).
    """
    spark = requests.sparkSession
    measures = ["length", "width", "draft", "height", "tonnage", "max_speed"]
    t = templates(spark).select("ship_type", *measures)
    own = [c if c in requests.columns else F.lit(None).cast("double").alias(c) for c in measures]
    r = requests.select("request_id", "ship_name", "ship_type", *own)
    db = known.select("ship_name", F.col("ship_type").alias("db_type"), *(F.col(c).alias(f"db_{c}") for c in measures))
    by_type = t.select("ship_type", *(F.col(c).alias(f"t_{c}") for c in measures))
    base = t.where(F.col("ship_type") == DEFAULT_TYPE).select(*(F.col(c).alias(f"d_{c}") for c in measures))
    j = r.join(db, "ship_name", "left").join(F.broadcast(by_type), "ship_type", "left").crossJoin(F.broadcast(base))  # ten rows and one row
    return with_levels(j.select("request_id", "ship_name", F.coalesce("db_type", "ship_type", F.lit(DEFAULT_TYPE)).alias("ship_type"), *(F.coalesce(c, f"db_{c}", f"t_{c}", f"d_{c}").alias(c) for c in measures)))


def constraints(features: DataFrame) -> DataFrame:
    """(u, v, depth, channel_width, clearance) of edges with features."""
    narrow = F.col("waterway_type") == "narrow"
    short = narrow & (F.col("avg_distance") < 200)
    pick = lambda a, b, c: F.when(short, float(a)).when(narrow, float(b)).otherwise(float(c))
    return features.select("u", "v", pick(6, 8, 15).alias("depth"), pick(40, 60, 120).alias("channel_width"), pick(20, 30, 60).alias("clearance"))


def inherited(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Constraints of edges without features: medians over the known edges that share a node, floored; defaults without any."""
    missing = edges.select("u", "v").join(known, ["u", "v"], "left_anti")
    at = known.select(F.explode(F.array("u", "v")).alias("node"), F.col("u").alias("ku"), F.col("v").alias("kv"), "depth", "channel_width", "clearance")
    near = missing.withColumn("node", F.explode(F.array("u", "v"))).join(at, "node").dropDuplicates(["u", "v", "ku", "kv"])
    m = near.groupBy("u", "v").agg(*(F.median(c).alias(c) for c in ("depth", "channel_width", "clearance")))
    t = missing.join(m, ["u", "v"], "left")
    floor = lambda c, low, default: F.coalesce(F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(float(low)))), F.lit(float(default))).alias(c)
    return t.select("u", "v", floor("depth", 8, 15), floor("channel_width", 60, 120), floor("clearance", 30, 60))


def passability(limits: DataFrame, ships: DataFrame) -> DataFrame:
    """Every edge and ship type with passable and the first reason against. The ship side is a small table."""
    t = limits.crossJoin(F.broadcast(ships))
    reason = F.when(F.col("draft") > F.col("depth") * 1.2, "draft").when(F.col("height") > F.col("clearance") * 1.2, "height").when(F.col("width") > F.col("channel_width") * 1.2, "width")
    return t.withColumn("reason", reason).withColumn("passable", F.col("reason").isNull())


def blocked(limits: DataFrame, ships: DataFrame) -> DataFrame:
    return passability(limits, ships).where("not passable").select("u", "v", "ship_type", "reason")


def rule_risk(limits: DataFrame, features: DataFrame, ships: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Risk from 0 to 100 of every edge for every ship type."""
    f = features.select("u", "v", "waterway_type", "segment_count", "avg_actual_speed", F.lit(True).alias("has"))
    t = limits.join(f, ["u", "v"], "left")
    if nodes is not None:
        place = nodes.select("node_id", "lat", "lon")
        d = graph.degrees(limits)
        t = t.join(place.toDF("u", "lat_u", "lon_u"), "u", "left").join(place.toDF("v", "lat_v", "lon_v"), "v", "left").join(d.toDF("u", "du"), "u", "left").join(d.toDF("v", "dv"), "v", "left")
        dist, mean = geo.haversine(F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v")), (F.col("du") + F.col("dv")) / 2
        bare = 5 + F.when(dist > 20000, 5).when(dist > 10000, 3).otherwise(0) + F.when(mean < 3, 5).when(mean < 5, 3).otherwise(0)
    else:
        bare = F.lit(5)
    t = t.crossJoin(F.broadcast(ships))
    depth, high, wide = F.col("depth") - F.col("draft"), F.col("clearance") - F.col("height"), F.col("channel_width") - F.col("width")
    risk = F.when(depth < 2, 40 - depth * 10).when(depth < 5, 20 + (5 - depth) * 2).otherwise(10.0)
    risk += F.when(high < 10, 20).when(high < 20, 10).otherwise(0)
    risk += F.when(wide < 20, 15).when(wide < 40, 5).otherwise(0)
    seen = F.when(F.col("waterway_type") == "narrow", 20).otherwise(0) + F.when(F.col("segment_count") < 10, 10).when(F.col("segment_count") < 50, 5).otherwise(0) + F.when(F.col("avg_actual_speed") < 3, 10).when(F.col("avg_actual_speed") < 5, 5).otherwise(0)
    risk += F.when(F.col("has"), seen).otherwise(bare)
    risk += F.when(F.col("risk_level") == "high", 15).when(F.col("risk_level") == "medium", 5).otherwise(0)
    return t.select("u", "v", "ship_type", F.least(F.greatest(risk, F.lit(0.0)), F.lit(100.0)).alias("risk"))
