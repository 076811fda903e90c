"""Cleaning, segmentation and smoothing of position reports.

Every step partitions by ship and shares one order (us, row_idx), so Spark sorts once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from fairway.config import DEFAULT, MS_TO_KNOTS, Settings
from fairway.functions import geo


def by_ship() -> WindowSpec:
    return Window.partitionBy("ship_name").orderBy("us", "row_idx")


def dedup(df: DataFrame) -> DataFrame:
    """First row of each ship and time, in order of arrival. Rows without a ship go."""
    w = Window.partitionBy("ship_name", "us").orderBy("row_idx")
    return df.where("ship_name is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def speed_filter(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return df.where((F.col("speed") >= 0) & (F.col("speed") <= s.max_speed))


def with_steps(df: DataFrame) -> DataFrame:
    """dt (s) and dist (m) from the ship's row before; null in its first row."""
    w = by_ship()
    before = {c: F.lag(c).over(w) for c in ("us", "lat", "lon")}
    return df.withColumns({"dt": (F.col("us") - before["us"]) / F.lit(1e6), "dist": geo.haversine(before["lat"], before["lon"], F.col("lat"), F.col("lon"))})


def is_drift(s: Settings = DEFAULT) -> F.Column:
    fast = (F.col("dist") > s.max_distance_jump) | (F.col("dist") / F.col("dt") * MS_TO_KNOTS > s.max_speed)
    return F.coalesce((F.col("dt") > 0) & (F.col("dt") <= s.max_time_gap) & fast, F.lit(False))


def drift_filter(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return with_steps(df).where(~is_drift(s)).drop("dt", "dist")


def anomaly_features(df: DataFrame) -> DataFrame:
    """Five features of every inner row: speed, computed speed, distance ratio, course change, distance.

    Rows count whose own and preceding step both take time; ships have at least 5 rows.
    """
    w = by_ship()
    size = F.count(F.lit(1)).over(Window.partitionBy("ship_name"))
    t = with_steps(df).withColumns({"__i": F.row_number().over(w), "__n": size})
    t = t.withColumns({"dt_before": F.lag("dt").over(w), "dist_next": F.lead("dist").over(w), "course_next": F.lead("course").over(w)})
    t = t.where("__n >= 5 and __i > 2 and __i < __n and dt > 0 and dt_before > 0")
    return t.select(
        "ship_name", "us", "row_idx", F.col("speed").alias("f_speed"), (F.col("dist") / F.col("dt") * MS_TO_KNOTS).alias("f_computed"), (F.col("dist_next") / F.greatest(F.col("dist"), F.lit(1e-6))).alias("f_ratio"),
        geo.angle_difference(F.col("course_next"), F.col("course")).alias("f_course"), F.col("dist").alias("f_dist"),
    )


def short_ship_filter(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("ship_name"))).where(F.col("__n") >= s.min_trajectory_points).drop("__n")


def integrity_filter(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Rows without nulls and inside the fence, borders included."""
    return df.na.drop().where(F.col("lat").between(*s.lat_range) & F.col("lon").between(*s.lon_range))


def clean(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """All filters, in this order."""
    return integrity_filter(short_ship_filter(drift_filter(speed_filter(dedup(df), s), s), s), s)


def gap_segments(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """trajectory_segment: grows by one after each gap over max_time_gap. Short segments go, unless a ship has one row in all."""
    w = by_ship()
    gap = F.coalesce(((F.col("us") - F.lag("us").over(w)) / F.lit(1e6) > s.max_time_gap).cast("int"), F.lit(0))
    t = df.withColumn("__gap", gap).withColumn("trajectory_segment", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__gap")
    t = t.withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy("ship_name", "trajectory_segment")), "__all": F.count(F.lit(1)).over(Window.partitionBy("ship_name"))})
    return t.where((F.col("__n") >= s.min_segment_points) | (F.col("__all") == 1)).drop("__n", "__all")


def moving_average(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    half = s.smoothing_window // 2
    w = by_ship().rowsBetween(-half, half)
    return df.withColumns({"lat": F.avg("lat").over(w), "lon": F.avg("lon").over(w)})


class Kalman:
    """One-dimensional filter. The gain depends on the position only, so it is the same for all columns."""

    def __init__(self, q: float, r: float, n: int):
        self.q, self.r, self.n = q, r, n
        self.start()

    def start(self) -> None:
        self.p, self.x = 1.0, None

    def step(self, z: tuple[float, ...]) -> tuple[float, ...]:
        if self.x is None:
            self.x = z
            return z
        self.p += self.q
        k = self.p / (self.p + self.r)
        self.x = tuple(x + k * (v - x) for x, v in zip(self.x, z, strict=True))
        self.p *= 1 - k
        return self.x


def kalman_smooth(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """lat and lon smoothed along each ship, across segments.

    Rows stream through in order of ship and time; the filter's state is all that is kept, so a ship
    of any length takes bounded memory.
    """
    columns = df.columns
    ordered = df.repartition("ship_name").sortWithinPartitions("ship_name", "us", "row_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, ship = Kalman(s.kalman_q, s.kalman_r, 2), None
        for b in batches:
            out = np.empty((len(b), 2))
            for i, (name, lat, lon) in enumerate(zip(b["ship_name"], b["lat"], b["lon"], strict=True)):
                if name != ship:
                    ship = name
                    f.start()
                out[i] = f.step((lat, lon))
            yield b.assign(lat=out[:, 0], lon=out[:, 1])[columns]

    return ordered.mapInPandas(run, df.schema)


def trajectory_statistics(df: DataFrame) -> DataFrame:
    """Per ship with two rows or more: total distance, mean and largest speed and course change."""
    w = by_ship()
    change = geo.angle_difference(F.col("course"), F.lag("course").over(w))
    t = with_steps(df).withColumn("change", change)
    return t.groupBy("ship_name").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("dist").alias("total_distance"), F.avg("speed").alias("avg_speed"), F.max("speed").alias("max_speed"), F.avg("change").alias("avg_course_change"), F.max("change").alias("max_course_change")
    ).where("n_points >= 2")


def process(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Clean, segment, smooth."""
    return kalman_smooth(gap_segments(clean(df, s), s), s)

