"""The chain of tables that the catalogue's queries read, each built on the ones before it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.config import Settings
from fairway.operators import clean, cluster, graph, motion, nodes, routing, ships, topology, weights
from fairway.session import written
from fairway.sources.ais import ais


#: The test data are sparse; with these bounds some nodes form clusters.
COARSE = Settings(cluster_eps=400.0, cluster_min_samples=2, refine_min_size=2, refine_distance=400.0)
#: Requests (id, start, goal) of the path queries, and the most edges of a path.
PATH_REQUESTS, PATH_CUTOFF = [(1, 0, 4), (2, 1, 25), (3, 2, 56), (4, 3, 14)], 12
PATH_SUMS = ("distance", "time", "risk", "frequency")
_bases: dict[tuple[str, str], Base] = {}


def base(spark: SparkSession, sf_dir: str) -> Base:
    """The tables of a directory, shared by all queries of an application: a stage is computed once and handed on as a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bases:
        _bases[key] = Base(spark, sf_dir)
    return _bases[key]


class Base:
    """Lazy tables over one directory. Stages are tables in the shared folder, as the engine hands them on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return ais(self.spark, self.sf_dir)

    @cached_property
    def fast(self) -> DataFrame:
        return clean.speed_filter(clean.dedup(self.raw))

    @cached_property
    def points(self) -> DataFrame:
        return written(clean.gap_segments(clean.clean(self.raw)), "points")

    @cached_property
    def segments(self) -> DataFrame:
        return written(motion.movement_segments(self.points), "segments")

    @cached_property
    def features(self) -> DataFrame:
        return nodes.feature_points(self.points)

    @cached_property
    def nodes(self) -> DataFrame:
        return written(nodes.grid_nodes(self.features), "nodes")

    @cached_property
    def clustered(self) -> DataFrame:
        return cluster.grid_clusters(self.nodes, COARSE)

    @cached_property
    def clusters(self) -> DataFrame:
        return written(cluster.aggregate(self.clustered, ["cl", "cn", "co"]), "clusters")

    @cached_property
    def visits(self) -> DataFrame:
        return topology.visits(self.points, self.nodes)

    @cached_property
    def steps(self) -> DataFrame:
        return written(topology.passages(self.visits, ["us", "row_idx"]), "steps")

    @cached_property
    def edges(self) -> DataFrame:
        return written(topology.edges(self.steps), "edges")

    @cached_property
    def density(self) -> DataFrame:
        return motion.density_grid(self.segments)

    @cached_property
    def mapped(self) -> DataFrame:
        return written(weights.map_segments(self.segments, self.nodes), "mapped")

    @cached_property
    def directed(self) -> DataFrame:
        return self.mapped.select("u", "v").distinct()

    @cached_property
    def waterway(self) -> DataFrame:
        return written(motion.waterway_types(self.directed, self.nodes, self.density), "waterway")

    @cached_property
    def stats(self) -> DataFrame:
        return weights.edge_stats(self.mapped)

    @cached_property
    def edge_features(self) -> DataFrame:
        return self.stats.join(self.waterway.select("u", "v", "waterway_type"), ["u", "v"])

    @cached_property
    def filled(self) -> DataFrame:
        return written(weights.fill_hours(self.mapped), "filled")

    @cached_property
    def templates(self) -> DataFrame:
        return ships.templates(self.spark)

    @cached_property
    def limits(self) -> DataFrame:
        return ships.constraints(self.edge_features)

    @cached_property
    def risk(self) -> DataFrame:
        return written(ships.rule_risk(self.limits, self.edge_features, self.templates), "risk")

    @cached_property
    def strong(self) -> DataFrame:
        """Undirected edges of weight 3 or more."""
        return topology.strong_edges(self.edges)

    @cached_property
    def both(self) -> DataFrame:
        """The strong edges in both directions."""
        return self.strong.select("u", "v", "weight", "avg_distance", "avg_time").unionByName(self.strong.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight", "avg_distance", "avg_time"))

    @cached_property
    def path_weights(self) -> DataFrame:
        """(u, v, distance, time, risk, frequency) of the strong edges in both directions."""
        return self.both.select("u", "v", F.col("avg_distance").alias("distance"), F.col("avg_time").alias("time"), (30 + F.col("weight") % 7).cast("double").alias("risk"), F.col("weight").alias("frequency"))

    @property
    def asked(self) -> DataFrame:
        return self.spark.createDataFrame(PATH_REQUESTS, "request_id long, start long, goal long")

    def asked_paths(self, edges: DataFrame, sums: tuple[str, ...]) -> DataFrame:
        """Simple paths of the requests, up to 12 edges, with sums over their edges."""
        return routing.request_paths(edges, self.asked, PATH_CUTOFF, sums)

    @cached_property
    def path_edges(self) -> DataFrame:
        return written(self.path_weights, "path_weights")

    @cached_property
    def paths(self) -> DataFrame:
        return self.asked_paths(self.path_edges, PATH_SUMS)

    @cached_property
    def skyline(self) -> DataFrame:
        """Those of the paths that may be the skyline of distance and time to six decimals."""
        return routing.skyline_paths(self.path_edges, self.asked, PATH_CUTOFF, PATH_SUMS, ("distance", "time"), 1e-5)

    @cached_property
    def extremes(self) -> DataFrame:
        """Those of the paths with the least and greatest distance, time and mean risk, and rows with their number (n)."""
        aims = [routing.Aim(lambda s, edges, kinds, c=c, sign=sign: sign * s[:, PATH_SUMS.index(c)] / (edges if c == "risk" else 1)) for c in ("distance", "time", "risk") for sign in (1, -1)]
        return written(routing.searched_paths(self.path_edges, self.asked, PATH_CUTOFF, PATH_SUMS, lambda request: aims, counted=True), "extremes")

    def best_scored(self, worst: dict[int, tuple[float, float]]) -> DataFrame:
        """Those of the paths that may have the best score, given the worst time and distance of each request."""
        return written(routing.searched_paths(self.path_edges, self.asked, PATH_CUTOFF, PATH_SUMS, lambda request: [routing.score_aim(PATH_SUMS, *worst[request])] if request in worst else []), "best_scored")

    @cached_property
    def web_paths(self) -> DataFrame:
        return self.asked_paths(written(routing.web_edges(self.both, self.edge_features), "web_edges"), ("km", "minutes", "risk"))

    @cached_property
    def degrees(self) -> DataFrame:
        return graph.degrees(self.strong)
