import os
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scopeflow import storage
from scopeflow.operators import impact as im
from scopeflow.operators import planner as pl
from scopeflow.operators import rollup as ru
from scopeflow.operators import structure as st
from scopeflow.plans.estate import Estate
from scopeflow.sources import roles
from scopeflow.streaming import signals

EDGES = """Parent App ID,From Application (Consumes),Consuming App Environment,Child App ID,Providing App Environment,Type
AB1,x,Production,CD2,,Depends on
AB1,x,,CD2,PRODUCTION,Depends on
EF3,"a ""q""
b",,AB1,,Depends on
"""
INVENTORY = """Application_Mnemonic_Distributed_ID,Application_Name,PCI,PCI_PrimaryAccountNumber_ProcessTransmit,PCI_PrimaryAccountNumber_Store,Line_of_Business
CD2,Old,NO,NO,NO,Cards
CD2,Card core,YES,Yes,no,Cards
EF3,Shop,NO,,,Retail
"""
SURVEY = """COMBO_DISTR_MAIN_ID,Upstream - Dependency (where your app is receiving PAN from),Downstream - Dependency (x)
ZZ9,CD2 - core,EF3
AB1,User Entry,ZZ9
AB1,Nobody knows,
"""
LOGS = """AppID,Findings in Sept - December logs,Stated Upstream Source
EF3,True PAN found 4111111111111111,CD2
"""


@pytest.fixture(scope="module")
def estate(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    files = {"DS1_flows.csv": EDGES, "DS4_inventory.csv": INVENTORY, "DS5_survey.csv": SURVEY, "DS6_logs.csv": LOGS}
    for name, text in files.items():
        (d / name).write_text(text)
    return Estate.of_csv(spark, {name: str(d / name) for name in files})


def test_estate_of_csv(estate):
    edges = sorted((r.src, r.dst, r.provenance, r.environment, r.signal) for r in estate.edges.collect())
    assert edges == [
        ("AB1", "EF3", "metadata", "", ""),
        ("CD2", "AB1", "metadata", "PRODUCTION", ""),
        ("CD2", "AB1", "metadata", "Production", ""),
        ("CD2", "EF3", "inferred", "", "DS6_splunk_stated_source"),
        ("CD2", "ZZ9", "inferred", "", "DS5_survey_upstream"),
        ("ZZ9", "EF3", "inferred", "", "DS5_survey_downstream"),
    ]
    assert sorted((r.token, r.reason) for r in estate.unresolved.collect()) == [("Nobody knows", "unresolved to known system"), ("User Entry", "non-system origin category"), ("ZZ9", "unresolved downstream")]
    nodes = {r.id: r for r in estate.nodes.collect()}
    assert set(nodes) == {"AB1", "CD2", "EF3", "ZZ9"}
    assert (nodes["CD2"].app_name, nodes["CD2"].carries_pan, nodes["CD2"].tier) == ("Card core", True, 4)
    assert (nodes["EF3"].observed, nodes["EF3"].tier) == (True, 2)
    assert "4111111111111111" not in nodes["EF3"].finding
    assert {r.role: r.masked_cells for r in estate.quality.collect()} == {"DS1": 0, "DS4": 0, "DS5": 0, "DS6": 1}


def test_edge_direction_is_a_setting(spark, tmp_path):
    """Recorded flows turn round; inferred ones don't."""
    files = {"DS1_flows.csv": EDGES, "DS4_inventory.csv": INVENTORY, "DS6_logs.csv": LOGS}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.scopeflow.data_flow_edges", "false")
    try:
        e = Estate.of_csv(spark, {name: str(tmp_path / name) for name in files})
        got = sorted((r.src, r.dst) for r in e.edges.collect())
    finally:
        spark.conf.unset("spark.scopeflow.data_flow_edges")
    assert got == [("AB1", "CD2"), ("AB1", "CD2"), ("CD2", "EF3"), ("EF3", "AB1")] and not e.settings.data_flow_edges


def test_shared_folder(spark):
    """Tables of a scope go with it, results stay; without a shared folder, only a local master may run."""
    with storage.scratch(spark):
        one, path = storage._write(spark.range(3), "one", storage._scopes()[-1])
        two = storage.kept(spark.range(4), "two")
        assert one.count() == 3 and Path(path.removeprefix("file://")).exists()
    assert two.count() == 4 and not Path(path.removeprefix("file://")).exists()
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    with pytest.raises(ValueError):
        storage.shared_dir(session("spark://cluster:7077"), "x")
    assert storage.shared_dir(session("local[2]"), "x").rpartition("/")[0] == storage.shared_dir(session("local[2]"), "y").rpartition("/")[0]


def test_roles():
    assert roles.role_by_header([" Parent App ID", "CHILD APP ID "]) == "DS1"
    assert roles.role_by_header(["AppID", "Findings in Sept - December logs"]) == "DS6"
    assert roles.role_by_header(["combo_distr_main_id", "Upstream - dependency, other"]) == "DS5"
    assert roles.role_by_header(["x"]) == "UNKNOWN"
    assert roles.role_of("x_upstream_survey.csv", []) == "DS3"


SAMPLE = Path(os.environ.get("SCOPEFLOW_SAMPLES", "/nowhere"))  # a folder with the six published tables


@pytest.mark.skipif(not SAMPLE.is_dir(), reason="SCOPEFLOW_SAMPLES names no folder")
def test_published_numbers(spark):
    e = Estate.of_csv(spark, {p.name: str(p) for p in sorted(SAMPLE.glob("*.csv"))})
    t = ru.totals(e).first()
    assert (t.systems, t.in_scope, t.confirmed, t.inferred_only, t.hidden, t.origins) == (239, 95, 44, 51, 48, 63)
    assert {r.provenance: r["count"] for r in e.edges.groupBy("provenance").count().collect()} == {"metadata": 338, "inferred": 57}
    assert (st.dag_nodes(e).count(), st.dag_edges(e).count()) == (233, 229)
    assert e.unresolved.count() == 170
    assert [(r.system, r.downstream_reach, r.solo_descope, r.risk) for r in im.heavy_hitters(e, 3).collect()] == [("6CWC", 29, 2, 56.36), ("8CCF", 28, 1, 75.45), ("8MEC", 27, 0, 74.55)]
    inst = pl.instance(e)
    assert [f for _, _, f in pl.greedy(inst, 7)] == [2, 3, 27, 28, 29, 30, 30]
    assert [pl.best_sets(inst, k)[0] for k in range(11)] == [0, 2, 3, 27, 28, 29, 30, 30, 31, 32, 32]
    hit = im.impact(e, im.labelled(e, {"t": [s for s, _, _ in pl.greedy(inst, 3)]})).first()
    assert (hit.nodes_descoped, hit.surface_reduction_pct, hit.risk_reduction_pct) == (27, 28.4, 17.9)
    econ = ru.economics(e, im.saturation(e)).first()
    assert (econ.days_now, econ.days_floor, econ.cost_now, econ.cost_floor) == (63.8, 47.8, 159625.0, 119625.0)
    assert st.islands(e).count() == 53 and st.choke_points(e).count() == 11


def test_leak_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = signals.leak_windows(signals.read_signals(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("leaks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.window_start, r.system): r.signals for r in spark.table("leaks").collect()}
    want = {(r.window_start, r.system): r.signals for r in signals.leak_windows(events).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_drift(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "id string") for ids in ("ab", "bc"))
    assert sorted(tuple(r) for r in signals.scope_drift(a, b).collect()) == [("a", "left"), ("c", "entered")]
    assert signals.scope_drift(a, a).agg(F.count("*")).first()[0] == 0
