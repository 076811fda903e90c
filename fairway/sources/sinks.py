"""Writers and readers of the engine's own tables and documents."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "from_node long, to_node long, ship_type string, passable int, risk_score double"
NODES = "node_id long, lat double, lon double, type string, frequency long, ship_count long"
EDGES = "from_node long, to_node long, weight long, ship_count long, avg_speed double, avg_distance double, avg_time double, is_bidirectional boolean"


def topology_document(nodes: DataFrame, edges: DataFrame, hourly: DataFrame | None = None) -> DataFrame:
    """One row, ``document``: nodes, edges with predicted times, metadata. For graphs that fit one document."""
    n = nodes.select(F.struct(F.col("node_id").alias("id"), "lat", "lon", "type", "frequency", "ship_count").alias("n")).agg(F.sort_array(F.collect_list("n")).alias("nodes"))
    e = edges
    if hourly is not None:
        times = hourly.groupBy("u", "v").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("hour").cast("string"), "predicted_time")))).alias("predicted_times"))
        e = e.join(times, ["u", "v"], "left")
    keep = [c for c in ("weight", "ship_count", "avg_distance", "avg_time", "avg_speed", "avg_course", "is_bidirectional", "predicted_times") if c in e.columns]
    e = e.select(F.to_json(F.struct(F.col("u").alias("from"), F.col("v").alias("to"), *keep)).alias("e"), "u", "v").agg(F.array_sort(F.collect_list(F.struct("u", "v", "e"))).alias("edges"))
    meta = nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count")))  # one row each
    t = n.crossJoin(e).crossJoin(meta)  # one row each
    body = F.concat(F.lit('{"nodes":'), F.to_json("nodes"), F.lit(',"edges":['), F.concat_ws(",", F.col("edges.e")), F.lit('],"metadata":'), F.to_json(F.struct("node_count", "edge_count")), F.lit("}"))
    return t.select(body.alias("document"))


def write_document(df: DataFrame, path: str) -> None:
    df.select("document").coalesce(1).write.mode("overwrite").text(path)


def read_topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a document."""
    d = spark.read.json(path, multiLine=True)
    return d.select(F.explode("nodes").alias("n")).select("n.*"), d.select(F.explode("edges").alias("e")).select("e.*")


def write_topology(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Node and edge tables as CSV with a header, also when empty."""
    nodes.select("node_id", "lat", "lon", "type", "frequency", "ship_count").write.mode("overwrite").csv(f"{folder}/topology_nodes", header=True)
    edges.select(F.col("u").alias("from_node"), F.col("v").alias("to_node"), "weight", "ship_count", "avg_speed", "avg_distance", "avg_time", "is_bidirectional").write.mode("overwrite").csv(f"{folder}/topology_edges", header=True)


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODES).csv(f"{folder}/topology_nodes", header=True), spark.read.schema(EDGES).csv(f"{folder}/topology_edges", header=True)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Implicit labels: passable is 1, 0 or -1 (unknown)."""
    return spark.read.schema(LABELS).csv(path, header=True)


def write_ships(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").csv(path, header=True)


def read_ships(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def web_edges(features: DataFrame) -> DataFrame:
    """Edge figures in km and minutes; the first of repeated edges stays."""
    one = features.groupBy("u", "v").agg(F.min(F.struct("avg_distance", "avg_travel_time", "avg_actual_speed", "segment_count", "waterway_type")).alias("f")).select("u", "v", "f.*")
    return one.select("u", "v", (F.col("avg_distance") / 1000).alias("distance_km"), (F.col("avg_travel_time") / 60).alias("minutes"), "avg_actual_speed", "segment_count", "waterway_type")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def report_lines(summary: DataFrame) -> DataFrame:
    """(line): the figures of a report as fixed-width text."""
    return summary.select(F.format_string("%-24s %14.2f", "metric", "value").alias("line")).orderBy("line")
