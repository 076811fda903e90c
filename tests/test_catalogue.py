"""Catalogue queries against their SQL, the sinks, the streams, and the rules of the package."""

import json
import pathlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fairway.plans import catalogue
from fairway.plans.base import base
from fairway.sources import sinks
from fairway.streaming import sessions

DATA = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in pathlib.Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def plain(rows):
    return sorted(tuple("null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    q = catalogue.CATALOGUE[name]
    df = q.run(spark, DATA)
    got = plain(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    t = duck.sql(q.oracle())
    at = [t.columns.index(c) for c in sorted(t.columns)]
    assert sorted(df.columns) == sorted(t.columns)
    assert got == plain(tuple(r[i] for i in at) for r in t.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.CATALOGUE) - set(catalogue.oracle_sql()) - {"model_compare", "risk_model", "endpoints"}))
def test_query_runs(spark, name):
    q = catalogue.CATALOGUE[name]
    df = q.run(spark, DATA)
    found = df.collect()
    planned = {"planned_routes", "yen_k_paths", "population_paths"}  # the requests' ends are not linked in the smallest tables
    assert (found or name in planned) and df.columns == [c.lstrip("#~@%") for c in q.columns.split()] and len(set(found)) == len(found)
    assert all(v is not None for r in found for v in r)


def test_sinks(spark, tmp_path):
    b = base(spark, DATA)
    edges = b.strong.withColumn("is_bidirectional", F.lit(True))
    doc = sinks.topology_document(b.nodes, edges)
    d = json.loads(doc.first()["document"])
    assert d["metadata"] == {"node_count": b.nodes.count(), "edge_count": edges.count()} and len(d["edges"]) == edges.count()
    sinks.write_document(doc, str(tmp_path / "doc"))
    n, e = sinks.read_topology(spark, str(tmp_path / "doc"))
    assert n.count() == b.nodes.count() and e.count() == edges.count()
    sinks.write_topology(b.nodes, edges, str(tmp_path / "csv"))
    n, e = sinks.read_graph(spark, str(tmp_path / "csv"))
    assert n.count() == b.nodes.count() and e.agg(F.sum("weight")).first()[0] == edges.agg(F.sum("weight")).first()[0]


def test_streams(spark, tmp_path):
    points = base(spark, DATA).points.withColumn("time", F.timestamp_micros("us"))
    points.select("ship_name", "time", "lat", "lon", "speed").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ship_name string, time timestamp, lat double, lon double, speed double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("gaps", sessions.segment_sessions(stream), "append"), ("hours", sessions.hourly_traffic(stream), "update"), ("smooth", sessions.kalman_stream(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("smooth").count() == points.count()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == points.count()


def test_nothing_else_imports_the_corpus_package():
    for p in (ROOT / "fairway").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"fairway\.llm|from \.+llm|import llm", p.read_text()), p


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.CATALOGUE) <= set(entry.queries())


def test_dynamic_weight_covers_all_hours(spark):
    b = base(spark, DATA)
    got = catalogue.CATALOGUE["dynamic_weight_lookup"].run(spark, DATA)
    both = got.join(b.filled, ["u", "v", "hour"])
    assert got.count() == 24 * b.directed.count() == both.count()
    assert both.where(F.abs(F.col("weight") - F.col("predicted_time")) > 1e-4).count() == 0
