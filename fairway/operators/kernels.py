"""Sequential algorithms as pure numpy functions, and the grouped or streamed passes that run them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairway.config import EARTH_RADIUS_M, METRES_PER_DEGREE


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


# line simplification --------------------------------------------------------


def simplified(lat: np.ndarray, lon: np.ndarray, tolerance: float) -> np.ndarray:
    """Kept places of the line: both ends, and while a point is farther than the tolerance from its chord, the farthest."""
    n = len(lat)
    keep = np.zeros(n, dtype=bool)
    if n == 0:
        return np.flatnonzero(keep)
    keep[[0, -1]] = True
    x, y = lon * METRES_PER_DEGREE * np.cos(np.radians(lat)), lat * METRES_PER_DEGREE
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        square = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / square, 0, 1) if square else np.zeros(b - a - 1)
        d = np.hypot(px - t * dx, py - t * dy)
        i = int(d.argmax())
        if d[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep)


def simplify(df: DataFrame, tolerance: float, window: int) -> DataFrame:
    """Keys (ship_name, us, row_idx) of the kept rows.

    Ships of up to ``window`` rows are taken whole; longer ones in windows of that size at half steps,
    each a group of its own, so no group grows with the ship.
    """
    w = Window.partitionBy("ship_name").orderBy("us", "row_idx")
    half = window // 2
    t = df.select("ship_name", "us", "row_idx", "lat", "lon", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("ship_name")).alias("n"))
    last = F.greatest(F.ceil((F.col("n") - window) / half), F.lit(0)).cast("int")  # the first window that reaches the end
    own = F.floor(F.col("i") / half).cast("int")
    t = t.withColumn("w", F.explode(F.array_distinct(F.filter(F.array(F.least(own, last), own - 1), lambda k: (k >= 0) & (k <= last)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("i")
        return p.iloc[simplified(p["lat"].to_numpy(), p["lon"].to_numpy(), tolerance)][["ship_name", "us", "row_idx"]]

    return t.groupBy("ship_name", "w").applyInPandas(run, "ship_name string, us long, row_idx long").distinct()


# greedy merging -------------------------------------------------------------


def greedy(order: list[int], pairs: dict[int, list[int]]) -> dict[int, int]:
    """Leader of each node: in order, every free node leads itself and takes its free partners."""
    leader: dict[int, int] = {}
    for x in order:
        if x not in leader:
            leader[x] = x
            for y in pairs.get(x, ()):
                leader.setdefault(y, x)
    return leader


def greedy_leaders(nodes: DataFrame, pairs: DataFrame, order: list[str]) -> DataFrame:
    """(node_id, leader): the greedy pass inside each component of the pairs."""
    from fairway.operators.graph import components

    found = components(pairs.select("a", "b"))
    rank = nodes.select(F.col("node_id"), F.struct(*order).alias("o"))
    edges = pairs.select(F.col("a").alias("node_id"), "b").unionByName(pairs.select(F.col("b").alias("node_id"), F.col("a").alias("b")))
    linked = edges.groupBy("node_id").agg(F.collect_list("b").alias("near"))
    t = found.withColumnRenamed("node", "node_id").join(linked, "node_id").join(rank, "node_id").select("component", "node_id", "near", *(F.col(f"o.{c}").alias(c) for c in order))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values([*order, "node_id"])
        place = {n: i for i, n in enumerate(p["node_id"])}
        near = {n: sorted(x, key=place.__getitem__) for n, x in zip(p["node_id"], p["near"], strict=True)}
        got = greedy(list(p["node_id"]), near)
        return pd.DataFrame({"node_id": list(got), "leader": list(got.values())})

    some = t.groupBy("component").applyInPandas(run, "node_id long, leader long")
    alone = nodes.select("node_id").join(some, "node_id", "left_anti").select("node_id", F.col("node_id").alias("leader"))
    return some.unionByName(alone)


# directions -----------------------------------------------------------------


def circular_clusters(degrees: np.ndarray, counts: np.ndarray, eps: float = 0.5, least: int = 3) -> np.ndarray:
    """Density clusters of sorted distinct directions with counts; near is a chord of the unit circle up to eps. -1 is noise.

    On a circle, clusters are runs of cores without a gap over the angle of that chord, so one pass
    over the sorted directions is enough. A border goes to the first cluster that reaches it.
    """
    n = len(degrees)
    turn = math.degrees(2 * math.asin(eps / 2))
    three = np.concatenate([degrees - 360, degrees, degrees + 360])
    total = np.concatenate([[0], np.cumsum(np.tile(counts, 3))])
    reach = lambda x: total[np.searchsorted(three, x + turn, "right")] - total[np.searchsorted(three, x - turn, "left")]
    core = np.flatnonzero(reach(degrees) >= least)
    label = np.full(n, -1)
    if not len(core):
        return label
    at = degrees[core]
    group = np.concatenate([[0], np.cumsum(np.diff(at) > turn)])
    if at[0] + 360 - at[-1] <= turn:
        group[group == group[-1]] = 0
    label[core] = group
    for i in np.flatnonzero(label < 0):
        k = int(np.searchsorted(at, degrees[i]))
        sides = [(group[k - 1], (degrees[i] - at[k - 1]) % 360), (group[k % len(at)], (at[k % len(at)] - degrees[i]) % 360)]
        near = [g for g, d in sides if d <= turn]
        if near:
            label[i] = min(near)
    return label


def dbscan(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clusters; a point counts itself. Borders go to the first cluster that reaches them."""
    n = len(points)
    near = [np.flatnonzero(((points - points[i]) ** 2).sum(axis=1) <= eps * eps) for i in range(n)]
    core = np.array([len(x) >= least for x in near], dtype=bool)
    label, found = np.full(n, -1), 0
    for i in range(n):
        if label[i] < 0 and core[i]:
            label[i], todo = found, [i]
            while todo:
                for j in near[todo.pop()]:
                    if label[j] < 0:
                        label[j] = found
                        if core[j]:
                            todo.append(j)
            found += 1
    return label


def direction_of(degrees: np.ndarray, counts: np.ndarray, cosines: np.ndarray, sines: np.ndarray) -> str:
    """Type of a node from the bearings around it: sorted distinct values, how many, and their summed cosines and sines."""
    total = counts.sum()
    if total < 3:
        return "waypoint"
    label = circular_clusters(degrees, counts)
    kinds = sorted(set(label[label >= 0].tolist()))
    if len(kinds) >= 3:
        centres = [math.degrees(math.atan2(sines[label == k].sum(), cosines[label == k].sum())) % 360 for k in kinds]
        opposite = any(min(d := abs(a - b), 360 - d) > 150 for i, a in enumerate(centres) for b in centres[i + 1 :])
        return "merge_point" if opposite else "bifurcation_point"
    r = min(1.0, math.hypot(cosines.sum(), sines.sum()) / total)
    spread = math.degrees(math.sqrt(-2 * math.log(max(r, 1e-10))))
    return "turn_point" if spread > 45 else "waypoint"


def direction_type(bearings: DataFrame) -> DataFrame:
    """(node_id, direction_type) of nodes with at least three bearings.

    Bearings are gathered by thousandths of a degree with their number and their summed cosines and
    sines first, so a node of any traffic is a group of at most 360,000 rows, and centres and spread
    are those of all bearings.
    """
    r = F.radians("bearing")
    t = bearings.withColumn("b", F.pmod(F.round("bearing", 3), F.lit(360.0))).groupBy("node_id", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.cos(r)).alias("c"), F.sum(F.sin(r)).alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["n"].sum()) < 3:
            return pd.DataFrame({"node_id": np.zeros(0, np.int64), "direction_type": np.zeros(0, object)})
        p = pdf.sort_values("b")
        kind = direction_of(*(p[c].to_numpy() for c in ("b", "n", "c", "s")))
        return pd.DataFrame({"node_id": [int(p["node_id"].iloc[0])], "direction_type": np.array([kind], dtype=object)})

    return t.groupBy("node_id").applyInPandas(run, "node_id long, direction_type string")


# map matching ---------------------------------------------------------------


def viterbi(lat: np.ndarray, lon: np.ndarray, candidates: list[list[tuple[int, float, float, float]]], keep: float = 0.9) -> list[tuple[int, int]]:
    """(place, node) of the best path in log probabilities, with runs of one node as their first place.

    Candidates of a place are (node, lat, lon, emission). Staying has probability ``keep``, moving
    exp(-|node distance - point distance| / max(point distance, 100)).
    """
    if not candidates:
        return []
    score = np.log(np.maximum([c[3] for c in candidates[0]], 1e-300))
    back: list[np.ndarray] = []
    for i in range(1, len(candidates)):
        before, now = candidates[i - 1], candidates[i]
        moved = float(haversine(lat[i - 1], lon[i - 1], lat[i], lon[i]))
        d = haversine(np.array([c[1] for c in before])[:, None], np.array([c[2] for c in before])[:, None], np.array([c[1] for c in now])[None, :], np.array([c[2] for c in now])[None, :])
        step = -np.abs(d - moved) / max(moved, 100.0)
        step[np.array([c[0] for c in before])[:, None] == np.array([c[0] for c in now])[None, :]] = math.log(keep)
        total = score[:, None] + step
        back.append(total.argmax(axis=0))
        score = total.max(axis=0) + np.log(np.maximum([c[3] for c in now], 1e-300))
    at = int(score.argmax())
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    path.reverse()
    nodes = [candidates[i][k][0] for i, k in enumerate(path)]
    return [(i, n) for i, n in enumerate(nodes) if i == 0 or n != nodes[i - 1]]


def match_ships(points: DataFrame) -> DataFrame:
    """Visits (ship_name, seq, node_id, us, lat, lon, speed, course) from rows with candidate lists.

    Ships are cut where a gap over an hour parts their trajectory_segment, so a group is one segment.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["us", "row_idx"]).reset_index(drop=True)
        got = viterbi(p["lat"].to_numpy(), p["lon"].to_numpy(), [[(c["node_id"], c["lat"], c["lon"], c["emission"]) for c in x] for x in p["candidates"]])
        out = p.iloc[[i for i, _ in got]][["ship_name", "trajectory_segment", "us", "lat", "lon", "speed", "course"]].copy()
        out.insert(2, "seq", range(len(got)))
        out.insert(3, "node_id", [n for _, n in got])
        return out

    return points.groupBy("ship_name", "trajectory_segment").applyInPandas(run, "ship_name string, trajectory_segment int, seq int, node_id long, us long, lat double, lon double, speed double, course double")


# isolation forest -----------------------------------------------------------


class IsolationForest:
    """Random trees on samples; the score is 2 ** (-mean depth / expected depth)."""

    def __init__(self, trees: int = 50, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.rng = trees, sample, np.random.default_rng(seed)
        self.forest: list = []
        self.norm = 1.0

    def fit(self, x: np.ndarray) -> IsolationForest:
        size = min(self.sample, len(x))
        deepest = max(1, math.ceil(math.log2(max(size, 2))))
        self.norm = _expected(size)
        self.forest = [self._grow(x[self.rng.choice(len(x), size, replace=False)], 0, deepest) for _ in range(self.trees)] if len(x) else []
        return self

    def _grow(self, x: np.ndarray, depth: int, deepest: int):
        low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (None, None)
        if depth >= deepest or len(x) <= 1 or not (high > low).any():
            return depth + _expected(len(x))
        f = int(self.rng.choice(np.flatnonzero(high > low)))
        cut = self.rng.uniform(low[f], high[f])
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], depth + 1, deepest), self._grow(x[~left], depth + 1, deepest)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.forest:
            todo = [(tree, np.arange(len(x)))]
            while todo:
                t, rows = todo.pop()
                if isinstance(t, tuple):
                    left = x[rows, t[0]] < t[1]
                    todo += [(t[2], rows[left]), (t[3], rows[~left])]
                else:
                    total[rows] += t
        return 2.0 ** (-total / max(1, len(self.forest)) / self.norm)


def _expected(n: int) -> float:
    return 0.0 if n <= 1 else (1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)


def isolation_filter(df: DataFrame, features: DataFrame, contamination: float = 0.01, sample_rows: int = 20_000) -> DataFrame:
    """Rows without the share of greatest isolation. The forest grows from at most ``sample_rows`` rows."""
    names = [c for c in features.columns if c.startswith("f_")]
    keys = ["ship_name", "us", "row_idx"]
    stats = features.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    mean = np.array([stats[f"m_{c}"] or 0.0 for c in names])
    scale = np.array([stats[f"s_{c}"] or 1.0 for c in names])
    taken = features.orderBy(F.xxhash64(*keys), *keys).limit(sample_rows).select(*names).toPandas().to_numpy(dtype=float)
    forest = IsolationForest().fit((taken - mean) / scale)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(isolation=forest.score((b[names].to_numpy(dtype=float) - mean) / scale))

    scored = features.mapInPandas(run, "ship_name string, us long, row_idx long, isolation double")
    cut = scored.agg(F.percentile_approx("isolation", 1 - contamination, 10_000)).first()[0]
    if cut is None:
        return df
    return df.join(scored.where(F.col("isolation") > cut), keys, "left_anti")


# density estimation ---------------------------------------------------------


def kde_centre(lat: np.ndarray, lon: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The member of greatest weighted Gaussian density (Scott's factor); the weighted mean for few or degenerate members."""
    w = weight / weight.sum()
    mean = float((w * lat).sum()), float((w * lon).sum())
    if len(lat) < 5:
        return mean
    x = np.stack([lat, lon])
    centred = x - np.array(mean)[:, None]
    effective = 1 / (w * w).sum()
    cov = (w * centred) @ centred.T / (1 - (w * w).sum()) * effective ** (-1 / 3)
    if not np.isfinite(cov).all() or abs(np.linalg.det(cov)) < 1e-24:
        return mean
    inverse = np.linalg.inv(cov)
    d = x[:, :, None] - x[:, None, :]
    density = (w[None, :] * np.exp(-0.5 * np.einsum("aij,ab,bij->ij", d, inverse, d))).sum(axis=1)
    best = int(density.argmax())
    return float(lat[best]), float(lon[best])
