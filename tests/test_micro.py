"""Hand-computed inputs and outputs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from packetloom.functions import labels as lb
from packetloom.functions import numeric as nm
from packetloom.functions import risk as rk
from packetloom.operators import alerts as al
from packetloom.operators import dataset as ds
from packetloom.operators import flows as fl
from packetloom.operators import graph as gr
from packetloom.operators import packets as pk
from packetloom.operators import scores as sc
from packetloom.operators import windows as wn

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def packets(spark, rows):
    """(seconds, src, dst, length, flags, dst_port)"""
    data = [(i, at(s), a, b, 1000, port, "TCP", n, n, n - 40, flags, None, 64, 512, False, 0, "test", 1)
            for i, (s, a, b, n, flags, port) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, timestamp timestamp_ntz, src_ip string, dst_ip string, src_port long, "
                                 "dst_port long, protocol string, byte_count long, packet_length long, payload_length long, "
                                 "flag_bits long, tcp_flags string, ttl long, tcp_window_size long, more_fragments boolean, "
                                 "fragment_offset long, source_type string, packet_count long")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_packet_window_index(spark):
    rows = packets(spark, [(s, "a", "b", 100, 2, 80) for s in (0, 9.999, 10.0, 25.0)])
    placed = pk.with_capture_offsets(rows, 10).orderBy("event_id").collect()
    assert [r["window_index"] for r in placed] == [0, 0, 1, 2]


def test_edge_features(spark):
    rows = packets(spark, [(0, "A", "B", 100, 2, 443), (1, "A", "B", 200, 16, 8080), (3, "A", "B", 300, 1, 443)])
    e = one(pk.edge_window_features(pk.with_capture_offsets(rows, 10), ["event_id"], 1))
    assert (e["packet_count"], e["total_bytes"], e["mean_packet_length"], e["min_packet_length"], e["max_packet_length"]) == (3, 600, 200, 100, 300)
    assert (e["edge_duration"], e["destination_port_diversity"], e["mean_inter_arrival_time"]) == (3, 2, 1.5)
    assert [e[f"tcp_{f}_count"] for f in ("syn", "ack", "fin", "rst")] == [1, 1, 1, 0]
    assert e["inter_arrival_time_std"] == pytest.approx(0.5)


def test_single_packet_edge_has_no_rates(spark):
    e = one(pk.edge_window_features(pk.with_capture_offsets(packets(spark, [(0, "A", "B", 100, 2, 80)]), 10)))
    assert [e[c] for c in ("mean_inter_arrival_time", "inter_arrival_time_std", "packets_per_second", "bytes_per_second")] == [None] * 4


def test_node_features(spark):
    rows = packets(spark, [(0, ".1", ".2", 100, 2, 80), (1, ".1", ".3", 150, 2, 81), (2, ".4", ".1", 50, 2, 82)])
    n = one(pk.node_window_features(pk.with_capture_offsets(rows, 10)).filter("node = '.1'"))
    assert (n["packet_count"], n["bytes_sent"], n["bytes_received"]) == (3, 250, 50)
    assert (n["unique_destinations"], n["unique_sources"], n["first_seen_offset"], n["last_seen_offset"]) == (2, 1, 0, 2)


def test_self_loop_counts_twice(spark):
    n = one(pk.node_window_features(pk.with_capture_offsets(packets(spark, [(0, "A", "A", 100, 2, 80)]), 10)))
    assert (n["packet_count"], n["bytes_sent"], n["bytes_received"]) == (2, 200, 200)


def test_capture_stats(spark):
    rows = packets(spark, [(0, "A", "B", 60, 2, 80), (10, "A", "B", 60, 2, 80), (20, "A", "B", 60, 2, 80), (21, "B", "A", 60, 2, 80)])
    placed = pk.with_capture_offsets(rows, 10)
    s = one(pk.capture_graph_stats(placed, pk.edge_window_features(placed)))
    assert (s["unique_directed_pairs"], s["window_edge_instances"], s["accounting_matches"]) == (2, 4, True)


def test_churn_and_longest_run(spark):
    members = spark.createDataFrame([(0, "A", "B"), (1, "A", "B"), (1, "A", "C"), (3, "A", "B")], "window_index long, src_ip string, dst_ip string")
    total = spark.createDataFrame([(4,)], "total_windows long")
    got = {r["window_index"]: r for r in gr.window_churn(members, ["src_ip", "dst_ip"], total).collect()}
    assert [(got[w]["new"], got[w]["gone"], got[w]["churn"]) for w in (1, 2, 3)] == [(1, 0, 1), (0, 2, 2), (1, 0, 1)]
    assert [got[w]["jaccard"] for w in (1, 2, 3)] == [0.5, 0.0, 0.0]
    assert one(gr.longest_run(members))["longest_run"] == 2


def test_score_grids_of_empty_tables(spark):
    empty = spark.createDataFrame([], "score double, label int, future_attack_step int")
    pick = one(sc.f1_threshold(empty))
    assert (pick["threshold"], pick["f1"]) == (0.5, 0.0)
    assert [r["samples"] for r in sc.detection_by_first_step(empty, 0.5).collect()] == [0] * 7
    assert sc.class_metrics(spark.createDataFrame([], "true int, predicted int, n long")).count() == 6


def test_jaccard_undefined_when_both_windows_are_empty(spark):
    members = spark.createDataFrame([(0, "A"), (4, "A")], "window_index long, node string")
    total = spark.createDataFrame([(5,)], "total_windows long")
    got = {r["window_index"]: r["jaccard"] for r in gr.window_churn(members, ["node"], total).collect()}
    assert got == {1: 0.0, 2: None, 3: None, 4: 0.0}


STAGE_CASES = {
    "Benign": (0, None), "Bot": (11, None), "DDoS attack-HOIC": (13, "T1498"), "DDoS attacks-LOIC-HTTP": (13, "T1498"),
    "DDoS attack-LOIC-UDP": (13, "T1498"), "DoS attacks-Hulk": (13, "T1499"), "DoS attacks-SlowHTTPTest": (13, "T1499"),
    "DoS attacks-GoldenEye": (13, "T1499"), "DoS attacks-Slowloris": (13, "T1499"), "FTP-BruteForce": (7, "T1110"),
    "SSH-Bruteforce": (7, "T1110"), "Brute Force -Web": (7, "T1110"), "Infiltration": (9, None), "Brute Force -XSS": (2, "T1190"),
    "SQL Injection": (2, "T1190"), "nothing like it": (0, None), "": (0, None),
}


def test_label_to_stage(spark):
    rows = spark.createDataFrame([(k,) for k in STAGE_CASES], "label string")
    got = {r["label"]: r for r in lb.attach_stage(rows).collect()}
    assert {k: (r["stage"], r["technique"]) for k, r in got.items()} == STAGE_CASES
    assert got[""]["confidence"] == 1.0 and got["nothing like it"]["confidence"] == 0.0


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_stages_join_alike_broadcast_or_not(spark, most):
    rows = spark.createDataFrame([(k, label) for k, label in enumerate([*STAGE_CASES, None, None, *STAGE_CASES])], "k long, label string")
    joined = lb.attach_stage(rows, broadcast_bytes=most)
    assert joined.columns[:2] == ["label", "k"]
    got = {r["k"]: r for r in joined.collect()}
    assert len(got) == 2 * len(STAGE_CASES) + 2
    assert all(r["stage"] == (STAGE_CASES[r["label"]][0] if r["label"] is not None else None) for r in got.values())
    assert lb.attach_stage(rows.limit(0), broadcast_bytes=most).collect() == []


@pytest.mark.parametrize("labels,stage,text", [
    ("SSH-Bruteforce;DDoS attack-HOIC", 13, "High Orbit"), ("DoS attacks-Hulk;DoS attacks-GoldenEye", 13, "GoldenEye"),
    ("DoS attacks-GoldenEye;DoS attacks-Hulk", 13, "GoldenEye"), ("", 0, "No attack labels"), (" ; ", 0, "No attack labels")])
def test_label_sets(spark, labels, stage, text):
    row = one(spark.createDataFrame([(labels,)], "t string").select(lb.map_label_set(lb.split_labels(F.col("t"))).alias("h")))
    assert row["h"]["stage"] == stage and text in row["h"]["description"]


def test_flow_gap_is_counted_in_whole_seconds(spark):
    rows = packets(spark, [(s, "a", "b", 100, 2, 80) for s in (0, 60, 120.5, 181.5)])
    numbered = fl.segment_flows(fl.prepare_events(rows), tie_break=["event_id"], timeout_seconds=60, bucket_seconds=10)
    assert [r["flow_segment"] for r in numbered.orderBy("event_id").collect()] == [0, 0, 0, 1]
    assert fl.session_flows(fl.prepare_events(rows), timeout_seconds=60).count() == 2


def test_null_keys_form_flows(spark):
    rows = packets(spark, [(0, None, "b", 100, 2, 80), (1, None, "b", 300, 2, 80)])
    flow = one(fl.build_flows(rows, tie_break=["event_id"]))
    assert (flow["packet_count"], flow["packet_size_median"], flow["src_flow_count"]) == (2, 200, None)


def test_split_positions(spark):
    rows = spark.range(20).select("id", ds.split_for(F.col("id"), F.lit(20)).alias("s"))
    counts = {r["s"]: r["count"] for r in rows.groupBy("s").count().collect()}
    assert counts == {"train": 14, "validation": 3, "test": 3}


def test_pct_change_of_zero_base(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0), (1.0, None)], "v double, p double")
    got = [r[0] for r in rows.select(nm.pct_change(F.col("v"), F.col("p"))).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == -math.inf and got[3:] == [0.5, 0.0]


def test_clamp_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (2.0,), (-1.0,)], "v double").select(nm.clamp(F.col("v")).alias("c")).collect()
    assert [r["c"] for r in rows] == [None, 1.0, 0.0]


def test_rolling_of_single_window(spark):
    states = spark.createDataFrame([(T0, 4)], "window_start timestamp_ntz, flow_count long")
    row = one(wn.add_trend_features(states, columns=["flow_count"]))
    assert (row["flow_count_rolling_mean_3"], row["flow_count_rolling_std_3"], row["flow_count_change"]) == (4, 0, 0)


def test_window_rejects_missing_columns(spark):
    with pytest.raises(ValueError, match="dst_ip.*protocol"):
        wn.window_states(spark.range(1).select(F.lit(T0).alias("flow_start")))
    with pytest.raises(ValueError):
        fl.segment_flows(spark.range(1), ["id"], timeout_seconds=0)
    with pytest.raises(ValueError):
        wn.create_sequences(spark.range(1), ["id"], 0, 1)


def test_distinct_counts_null(spark):
    rows = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "x string")
    assert one(rows.agg(nm.distinct_with_null(F.col("x")).alias("n")))["n"] == 3


def test_coarse_states(spark):
    rows = spark.createDataFrame([(T0, "s", "FTP-BruteForce", 1.0), (T0, "s", "DoS attacks-Hulk", 3.0), (T0, "s", "Bot", 99.0)],
                                 "timestamp timestamp_ntz, source_file string, label string, v double")
    row = one(ds.mean_std_max_min_states(rows, ["v"]))
    assert (row["v__mean"], row["v__std"], row["count"], row["attack"], row["stage"]) == (2, 1, 2, 1, 2)


def test_header_repair():
    assert ds.canonical_column("  FlowIAT   Mean ") == "Flow IAT Mean"
    assert ds.feature_name("Flow Byts/s") == "flow_byts_per_s"
    assert ds.numeric_columns(["Src IP", "Tot Fwd Pkts", "Label"]) == ["Tot Fwd Pkts"]


def test_chain_next_stage(spark):
    row = one(spark.range(1).select(rk.next_stage(F.lit(0)).alias("a"), rk.next_stage(F.lit(13)).alias("b")))
    assert (row["a"], row["b"]) == (1, 13)


def test_guarded_sql(spark):
    with pytest.raises(PermissionError):
        al.guarded_sql(spark, "delete  from logs_logentry where 1=1")
    with pytest.raises(ValueError):
        al.guarded_sql(spark, "  ")
    assert al.guarded_sql(spark, "SELECT 1 AS one").first()["one"] == 1


def test_stage_narrative(spark):
    row = one(spark.range(1).select(lb.stage_narrative(F.array(F.lit(0), F.lit(4))).alias("t"),
                                    lb.stage_narrative(F.array(F.lit(0), F.lit(0))).alias("q")))
    assert row["t"].startswith("- **T+2**: Lateral Movement (TA0008)") and row["q"].startswith("All forecast windows")


def test_components_of_a_long_chain(spark):
    """Longer than any fixed number of rounds would bring one hop each."""
    from packetloom.operators.paths import weak_components

    chain = spark.range(300).selectExpr("(id * 7) % 301 AS src", "((id + 1) * 7) % 301 AS dst")
    assert weak_components(chain).select("component").distinct().collect() == [(0,)]
