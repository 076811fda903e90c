"""Position reports: the view over the events table, readers and writers.

Position tables have ship_name, us (microseconds), row_idx (order of arrival), lat, lon, speed (knots)
and course (degrees); other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Column names of the published workbooks.
HEADERS = {"船舶名称": "ship_name", "时间": "time", "纬度": "lat", "经度": "lon", "航速": "speed", "航向": "course"}
CSV_SCHEMA = "`船舶名称` string, `时间` timestamp, `纬度` double, `经度` double, `航速` double, `航向` double"


def ais_from_events(events: DataFrame) -> DataFrame:
    """Deterministic position reports of made-up ships from an event stream."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 30")
    step = F.pmod(F.row_number().over(w) - 1, F.lit(40))
    a = events.select("event_id", "user_id", "value", us.alias("us"), step.alias("step"))
    walk = F.when(F.col("step") < 20, F.col("step")).otherwise(40 - F.col("step")).cast("double")
    lat = F.lit(22.5) + (F.col("user_id") % 5) * F.lit(1e-2) + walk * F.lit(2e-3) + (F.col("event_id") % 13) * F.lit(1e-5) + F.when(F.col("event_id") % 97 == 0, 2e-2).otherwise(0.0)
    lon = F.lit(113.3) + walk * F.lit(1e-3) * (1 + F.col("user_id") % 3) + (F.col("event_id") % 11) * F.lit(1e-5)
    return a.select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("ship_name"), "us", F.col("event_id").alias("row_idx"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"),
        (F.col("value") / 10.0).alias("speed"), F.pmod(F.col("event_id") * 37, F.lit(360)).cast("double").alias("course"),
    )


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ais_from_events(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value"))


def normalise(df: DataFrame) -> DataFrame:
    """Published headers to column names, us from time, row_idx in order of file and row."""
    for old, new in HEADERS.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    df = df.withColumn("us", F.unix_micros("time"))
    return df if "row_idx" in df.columns else df.withColumn("row_idx", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of CSV files with the published headers; the schema is given, so nothing is scanned twice."""
    return normalise(spark.read.schema(CSV_SCHEMA).csv(list(paths), header=True, encoding="UTF-8", enforceSchema=False))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Union by column name of Parquet files."""
    out = None
    for p in paths:
        one = normalise(spark.read.parquet(p))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_workbooks(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of xlsx workbooks, where openpyxl is installed; one task reads each workbook."""
    import importlib.util

    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("reading xlsx takes openpyxl; convert the workbooks to CSV or Parquet")

    def rows(batches):
        import pandas as pd

        for b in batches:
            for path in b["path"]:
                yield pd.read_excel(path)[list(HEADERS)].astype({"船舶名称": str})

    return normalise(spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInPandas(rows, CSV_SCHEMA))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, also for an empty table."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
