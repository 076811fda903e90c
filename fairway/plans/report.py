"""Figures over the stages' tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(points: DataFrame, nodes: DataFrame, edges: DataFrame, segments: DataFrame) -> DataFrame:
    """(metric, value): sizes of the tables and means of the edges."""
    parts = [
        points.agg(F.count(F.lit(1)).alias("clean_rows"), F.count_distinct("ship_name").alias("ships")), nodes.agg(F.count(F.lit(1)).alias("nodes")),
        edges.agg(F.count(F.lit(1)).alias("edges"), F.avg("avg_distance").alias("mean_edge_distance"), F.avg("avg_time").alias("mean_edge_time")), segments.agg(F.count(F.lit(1)).alias("segments")),
    ]
    long = [p.select(*(F.col(c).cast("double").alias(c) for c in p.columns)).unpivot([], p.columns, "metric", "value") for p in parts]
    return reduce(DataFrame.unionByName, long)
