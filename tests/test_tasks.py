"""The batch of stages and the planning answers on a made-up fleet."""

from fairway.config import Settings
from fairway.operators.router import Network
from fairway.plans import api
from fairway.plans.tasks import Tasks
from fairway.sources.ais import ais


def test_all_tasks(spark, tmp_path):
    t = Tasks(spark, ais(spark, "/root/testdata/sf0.001"), str(tmp_path), Settings(min_edge_weight=1, cluster_eps=400.0, cluster_min_samples=2, refine_min_size=2))
    out = t.run()
    assert set(out) == set(Tasks.ORDER) and all(df.count() >= 0 for df in out.values())
    assert out["topology"].count() > 0 and {r["metric"] for r in out["report"].collect()} >= {"clean_rows", "nodes", "edges"}
    again = t.run("nodes")["nodes"]
    assert again.count() == out["nodes"].count()


def test_planning_answers():
    e = {(1, 2): 1000.0, (2, 3): 1000.0, (1, 3): 5000.0, (3, 4): 1000.0}
    net = Network({k: {"distance": d, "time": d / 5, "risk": 30.0, "count": 5, "waterway_type": "open"} for k, d in e.items()}, {i: (22.0 + i / 100, 113.0) for i in range(1, 5)})
    ask = {"start_lat": 22.01, "start_lon": 113, "end_lat": "22.04", "end_lon": 113.0}
    status, body = api.plan(ask, net)
    assert status == 200 and body["data"]["start"]["node_id"] == 1 and body["data"]["routes"][0]["total_distance_km"] == 3.0
    assert body["data"]["routes"][0]["risk_score"] == 30.0
    assert [r["type"] for r in api.plan(ask, net, compat_labels=True)[1]["data"]["routes"]] == ["SAFEST", "FASTEST"]
    assert api.plan({}, net)[0] == api.plan(ask | {"start_lat": "x"}, net)[0] == api.plan(ask | {"end_lat": 22.01}, net)[0] == 400
    assert api.plan(ask | {"start_lat": 22.04, "end_lat": 22.01}, net)[0] == 400
    assert len(api.ship_types()) == 10 and len(api.topology_nodes(net)) == 4
