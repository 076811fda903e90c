"""Grid joins: range and nearest-neighbour search by cells, and a distributed row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.functions import geo
from fairway.session import written


def neighbours(lat: Column, lon: Column, size: float) -> Column:
    """The nine cells around a position, as structs (gl, gn)."""
    gl, gn = geo.cell(lat, size), geo.cell(lon, size)
    return F.array(*(F.struct((gl + a).alias("gl"), (gn + b).alias("gn")) for a in (-1, 0, 1) for b in (-1, 0, 1)))


def spread(df: DataFrame, size: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each row once for each of its nine cells, with gl and gn."""
    return df.withColumn("__c", F.explode(neighbours(F.col(lat), F.col(lon), size))).withColumns({"gl": F.col("__c.gl"), "gn": F.col("__c.gn")}).drop("__c")


def cell_nodes(nodes: DataFrame, size: float) -> DataFrame:
    """For each cell the nodes of the nine cells around it. Grid nodes are sparse by construction, so lists are short."""
    return spread(nodes.select("node_id", "lat", "lon"), size).groupBy("gl", "gn").agg(F.collect_list(F.struct("node_id", "lat", "lon")).alias("near"))


def nearest(df: DataFrame, nodes: DataFrame, size: float, radius: float, lat: str = "lat", lon: str = "lon", out: str = "node_id") -> DataFrame:
    """Adds the nearest node within the radius among the nine cells (null if there is none), ties to the least id.

    The node side is spread over cells, not the rows, and the choice is made inside each row: one
    join on the cell and no aggregation of the rows.
    """
    cells = cell_nodes(nodes, size)
    t = df.withColumns({"__gl": geo.cell(F.col(lat), size), "__gn": geo.cell(F.col(lon), size)})
    j = t.join(cells, (t["__gl"] == cells["gl"]) & (t["__gn"] == cells["gn"]), "left")
    best = F.array_min(F.transform("near", lambda n: F.struct(geo.haversine(F.col(lat), F.col(lon), n["lat"], n["lon"]).alias("d"), n["node_id"].alias("id"))))
    j = j.withColumn("__b", best)
    return j.select(*df.columns, F.when(F.col("__b.d") < radius, F.col("__b.id")).alias(out), F.when(F.col("__b.d") < radius, F.col("__b.d")).alias(f"{out}_dist"))


def within(df: DataFrame, other: DataFrame, size: float, radius: float) -> DataFrame:
    """Pairs (left columns, r_ columns, dist) of rows nearer than the radius; size must not be below it."""
    o = spread(other.select(*(F.col(c).alias(f"r_{c}") for c in other.columns)), size, "r_lat", "r_lon")
    t = df.withColumns({"gl": geo.cell(F.col("lat"), size), "gn": geo.cell(F.col("lon"), size)})
    j = t.join(o, ["gl", "gn"]).withColumn("dist", geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return j.where(F.col("dist") < radius).drop("gl", "gn")


def numbered(df: DataFrame, major: list[str], descending: tuple[str, ...], minor: list[str], out: str = "node_id") -> DataFrame:
    """Position from 0 in the order of major, then minor columns, without a sort in one place.

    Counts of the major keys are dealt to ranges of their order; each range adds the sum of the ranges
    before it, of which there are as many as partitions. Rows are ordered inside their key.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(c) if c in descending else F.asc(c) for c in major]
    counts = df.groupBy(*major).agg(F.count(F.lit(1)).alias("__n")).repartitionByRange(parts, *order)
    ranged = written(counts.withColumn("__p", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__p").agg(F.sum("__n").alias("__s"))
    offset = sums.withColumn("__o", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__o")  # as many rows as partitions
    inner = F.coalesce(F.sum("__n").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranged.withColumn("__inner", inner).join(F.broadcast(offset), "__p").select(*major, (F.col("__o") + F.col("__inner")).alias("__before"))
    inside = df.withColumn("__i", F.row_number().over(Window.partitionBy(*major).orderBy(*minor)))
    return inside.join(before, major).withColumn(out, (F.col("__before") + F.col("__i") - 1).cast("long")).drop("__before", "__i")
