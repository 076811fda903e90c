"""The batch of stages, each a table in one folder that is reused unless forced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairway.config import DEFAULT, Settings
from fairway.operators import clean, cluster, graph, motion, nodes, routing, ships, topology, weights
from fairway.plans.report import summary
from fairway.sources import sinks


class Tasks:
    """clean, nodes, clusters, topology, weights, report, routes: run in this order, or one by name."""

    ORDER = ("clean", "nodes", "clusters", "topology", "weights", "report", "routes")

    def __init__(self, spark: SparkSession, reports: DataFrame, folder: str, s: Settings = DEFAULT):
        self.spark, self.reports, self.folder, self.s = spark, reports, folder.rstrip("/"), s
        self.force = False

    def exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if self.force or not self.exists(name):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def run(self, only: str | None = None, force: bool = False) -> dict[str, DataFrame]:
        """The tables of all tasks up to the end, or of one; ``force`` computes anew what is asked for."""
        out = {}
        for name in (only,) if only else self.ORDER:
            self.force = force
            out[name] = getattr(self, name)()
            self.force = False
        return out

    def _kept(self, name: str) -> DataFrame:
        force, self.force = self.force, False
        try:
            return getattr(self, name)()
        finally:
            self.force = force

    def clean(self) -> DataFrame:
        return self.stage("cleaned", lambda: clean.process(self.reports, self.s))

    def nodes(self) -> DataFrame:
        points = self._kept("clean")
        return self.stage("nodes", lambda: nodes.extract_nodes(points, motion.movement_segments(points), self.s))

    def clusters(self) -> DataFrame:
        found = self._kept("nodes")

        def build() -> DataFrame:
            few = found.count() <= 10_000
            grouped = cluster.density_clusters(found, self.s) if few else cluster.grid_clusters(found, self.s)
            return cluster.refine(cluster.final_types(cluster.aggregate(grouped, ["cluster"] if few else ["cl", "cn", "co"], centre="kde")), self.s)

        return self.stage("clusters", build)

    def topology(self) -> DataFrame:
        points, found = self._kept("clean"), self._kept("clusters")

        def build() -> DataFrame:
            steps = topology.passages(topology.match(points, found, self.s), ["seq"])
            kept, merged = topology.merge_nodes(found, topology.strong_edges(topology.edges(steps), self.s), self.s)
            sinks.write_topology(kept, merged, self.folder)
            return merged

        return self.stage("topology", build)

    def weights(self) -> DataFrame:
        points, found = self._kept("clean"), self._kept("clusters")

        def build() -> DataFrame:
            segments = motion.movement_segments(points)
            mapped = self.stage("mapped", lambda: weights.map_segments(segments, found, self.s))
            directed = mapped.select("u", "v").distinct()
            waterway = motion.waterway_types(directed, found, motion.density_grid(segments, self.s), self.s)
            filled = weights.fill_hours(mapped)
            return weights.flat_features(weights.edge_stats(mapped), weights.direction_stats(mapped), weights.period_weights(mapped), filled, waterway, weights.bidirectional(weights.octants(mapped)), graph.degrees(directed))

        return self.stage("edge_features", build)

    def report(self) -> DataFrame:
        points = self._kept("clean")
        return self.stage("report", lambda: summary(points, self._kept("clusters"), self._kept("topology"), motion.movement_segments(points)))

    def routes(self) -> DataFrame:
        """One route for each ship type between far ends of the largest component."""
        edges, found = self._kept("topology"), self._kept("clusters")
        features = self._kept("weights").withColumnsRenamed({"from_node": "u", "to_node": "v"})

        def build() -> DataFrame:
            types = ships.templates(self.spark)
            limits = ships.constraints(features)
            limits = limits.unionByName(ships.inherited(edges, limits))
            risk = ships.rule_risk(limits, features, types, found).groupBy("u", "v").agg({"risk": "avg"}).withColumnRenamed("avg(risk)", "risk")
            net = routing.network(routing.weight_maps(edges, features, found, risk), edges, found)
            shut: dict[str, set] = {}
            for r in ships.blocked(limits.join(edges.select("u", "v"), ["u", "v"], "left_semi"), types).collect():  # edges of the graph that network() has checked, times ten types
                shut.setdefault(r["ship_type"], set()).update({(r["u"], r["v"]), (r["v"], r["u"])})
            ends = routing.endpoints(edges, found, [r[0] for r in types.select("ship_type").collect()], 0.0)
            wanted = ends.selectExpr("row_number() over (order by ship_type) as request_id", "start", "goal", "cast(8 as int) as hour", "ship_type").selectExpr("cast(request_id as long) as request_id", "start", "goal", "hour", "ship_type")
            return routing.plan(wanted, net, blocked={k: frozenset(v) for k, v in shut.items()})

        return self.stage("routes", build)
