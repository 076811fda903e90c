"""Settings of the trajectory engine. Fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_RADIUS_M = 6_371_000
METRES_PER_DEGREE = 111_000
MS_TO_KNOTS = 1.944
KNOTS_TO_MS = 0.5144


@dataclass(frozen=True)
class Settings:
    max_speed: float = 30.0
    max_time_gap: int = 3600
    max_distance_jump: float = 500.0
    min_trajectory_points: int = 10
    min_segment_points: int = 3
    lat_range: tuple[float, float] = (18.0, 42.0)
    lon_range: tuple[float, float] = (105.0, 125.0)
    kalman_q: float = 0.01
    kalman_r: float = 0.1
    smoothing_window: int = 5
    direction_threshold: float = 30.0
    stop_speed: float = 3.0
    stop_min_duration: float = 300.0
    dp_tolerance: float = 50.0
    dp_window: int = 200
    node_cell: float = 0.0005
    adjacent_merge_m: float = 30.0
    direction_radius_deg: float = 100 / 111_000
    cluster_eps: float = 100.0
    cluster_min_samples: int = 5
    heading_weight: float = 30.0
    refine_distance: float = 150.0
    refine_min_size: int = 3
    match_cell: float = 0.001
    match_sigma: float = 100.0
    match_radius: float = 200.0
    min_edge_weight: int = 3
    node_merge_distance: float = 50.0
    density_cell: float = 0.005
    segment_node_radius: float = 500.0


DEFAULT = Settings()

# Ship templates (length, width, draft, height, tonnage, max_speed).
SHIP_TEMPLATES = {
    "小型货船": (80, 12, 4.5, 15, 3000, 12),
    "中型货船": (150, 22, 7.5, 25, 15000, 14),
    "大型货船": (250, 32, 11.0, 30, 50000, 15),
    "集装箱船": (200, 30, 10.0, 40, 35000, 18),
    "大型集装箱船": (350, 45, 14.0, 50, 100000, 22),
    "油轮": (180, 28, 9.0, 20, 25000, 14),
    "大型油轮": (300, 50, 15.0, 25, 120000, 15),
    "客船": (100, 18, 5.0, 30, 8000, 20),
    "渔船": (30, 6, 2.5, 8, 200, 10),
    "拖船": (25, 8, 3.0, 10, 300, 12),
}

# Key words of ship names, first match wins.
NAME_KEYWORDS = [
    ("集装箱", "集装箱船"), ("集装", "集装箱船"), ("container", "集装箱船"),
    ("油轮", "油轮"), ("油船", "油轮"), ("tanker", "油轮"), ("VLCC", "大型油轮"),
    ("散货", "大型货船"), ("bulk", "大型货船"),
    ("客船", "客船"), ("客滚", "客船"), ("passenger", "客船"),
    ("渔", "渔船"), ("fishing", "渔船"), ("拖", "拖船"), ("tug", "拖船"),
    ("货", "中型货船"), ("cargo", "中型货船"),
]

# Speed ranges of ship types (from, below, type), first match wins.
SPEED_TYPES = [(20, 25, "大型集装箱船"), (16, 20, "集装箱船"), (16, 20, "客船"), (12, 16, "中型货船"), (12, 16, "油轮"), (8, 12, "小型货船"), (6, 10, "渔船"), (0, 8, "拖船")]
DEFAULT_TYPE = "中型货船"

# Times of day (name, from hour, below hour), and peak hours.
PERIODS = [("night", 0, 6), ("morning", 6, 10), ("midday", 10, 14), ("afternoon", 14, 18), ("evening", 18, 22), ("late_night", 22, 24)]
PEAK_HOURS = (6, 7, 8, 9, 17, 18, 19)
