"""The batch steps that make sense on streams: gap segments, smoothing, hourly counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairway.config import DEFAULT, Settings
from fairway.operators.clean import Kalman


def segment_sessions(points: DataFrame, s: Settings = DEFAULT, late: str = "10 minutes") -> DataFrame:
    """One row for each ship and stretch without a gap of max_time_gap or more; ``points`` streams with a timestamp ``time``."""
    t = points.where(F.col("speed").between(0, s.max_speed)).withWatermark("time", late)
    w = F.session_window("time", f"{s.max_time_gap} seconds")
    return t.groupBy("ship_name", w.alias("w")).agg(F.count(F.lit(1)).alias("n_points"), F.avg("speed").alias("avg_speed"), F.max("speed").alias("max_speed")).select("ship_name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_points", "avg_speed", "max_speed")


def hourly_traffic(points: DataFrame, cell: float = DEFAULT.density_cell, late: str = "10 minutes") -> DataFrame:
    """Reports of each cell and hour."""
    t = points.withWatermark("time", late)
    return t.groupBy(F.window("time", "1 hour").alias("w"), (F.col("lat") / cell).cast("int").alias("gl"), (F.col("lon") / cell).cast("int").alias("gn")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "gl", "gn", "n")


def kalman_stream(points: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Smoothed positions as they arrive; each ship keeps four numbers. Rows of a batch are taken in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = Kalman(s.kalman_q, s.kalman_r, 2)
        if state.exists:
            lat, lon, f.p = state.get
            f.x = (lat, lon)
        for b in batches:
            b = b.sort_values("time")
            out = [f.step((a, o)) for a, o in zip(b["lat"], b["lon"], strict=True)]
            yield pd.DataFrame({"ship_name": [key[0]] * len(b), "time": b["time"], "lat": [x[0] for x in out], "lon": [x[1] for x in out]}).astype({"ship_name": object})
        if f.x is not None:
            state.update((f.x[0], f.x[1], f.p))

    t = points.select("ship_name", "time", "lat", "lon")
    return t.groupBy("ship_name").applyInPandasWithState(step, "ship_name string, time timestamp, lat double, lon double", "lat double, lon double, p double", "append", GroupStateTimeout.NoTimeout)
