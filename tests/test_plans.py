"""Shape of the physical plans."""

import pytest

from packetloom.plans.catalog import reports

REPORTS = reports()
# Reports whose operator is Python by nature: a user model, a state processor.
PYTHON_ALLOWED = {"batch_model_scores"}
CHECKED = [
    "flow_segments", "window_state", "window_rates", "flow_directional", "state_sum_mean", "packet_edges", "packet_nodes", "edge_static",
    "edge_dynamic", "churn_edges", "threshold_sweep", "reliability_bins", "label_map", "infiltration_score", "capture_decode",
    "retransmissions", "port_scan_score", "feature_quality", "trajectory_record", "keyword_severity",
]


def plan_of(spark, sf_dir, name):
    return REPORTS[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_stays_in_the_jvm_without_cross_joins(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flows_need_one_scan(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "window_state")
    assert plan.count("FileScan parquet") == 1
    assert "MergingSessions" in plan


def test_scan_reads_needed_columns_only(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "keyword_severity")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "smallest_in_band")
    assert "TakeOrderedAndProject" in plan
    peers = plan_of(spark, sf_dir, "attacker_connectivity")
    assert "ReadSchema: struct<user_id:bigint,props:string>" in peers


def test_nodes_of_written_edges_meet_in_one_shuffle(spark, sf_dir, tmp_path):
    from packetloom.operators import graph as gr
    from packetloom.plans import graph_reports

    rows = spark.createDataFrame([(y, a, b, 80, "TCP", v) for y in (1, 2, None) for a, b in [("p", "q"), ("q", "p"), (None, "q"), ("p", "p")]
                                  for v in (1.5, 2.0, None, float("nan"))], "y int, src_ip string, dst_ip string, dst_port int, protocol string, v double")
    edges = gr.edge_statistics(rows, ["v"], ["y"])
    assert {(r["v__sum"], r["v__mean"], r["v__finite_count"]) for r in edges.collect()} == {(3.5, 1.75, 2)}
    edges.write.json(str(tmp_path / "edges"))
    written = spark.read.schema(edges.schema).json(str(tmp_path / "edges"))
    both = [gr.node_statistics(e, ["y"], "v__sum", "v__sum", once=once).collect() for e, once in ((written, True), (edges, False))]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1])) and len(both[0]) == 9
    plan = graph_reports.item_nodes(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # edges, then nodes
