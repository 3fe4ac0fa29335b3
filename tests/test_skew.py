"""Hot keys and bucket borders against brute force."""

import collections
import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows as fl
from packetloom.operators import graph as gr
from packetloom.operators import ordered as od
from packetloom.operators import packets as pk
from packetloom.operators import paths as pt
from packetloom.operators import scores as sc
from packetloom.sources.sinks import latest_per_stream

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows on one key; values with ties; times over many buckets."""
    rng = random.Random(7)
    data = []
    for i in range(4000):
        key = "hot" if i % 2 else rng.choice(["a", "b", "c", None])
        data.append((i, key, T0 + dt.timedelta(microseconds=rng.randrange(40_000_000_000)), rng.randrange(300) / 4))
    return data


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, v double").repartition(6).cache()


def by_key(rows):
    groups = collections.defaultdict(list)
    for i, key, ts, v in rows:
        groups[key].append((ts, i, v))
    return {k: sorted(g) for k, g in groups.items()}


def test_running_totals(rows, table):
    got = {r["id"]: r["n"] for r in od.running_totals(table, ["key"], ["ts", "id"], od.time_bucket("ts", 600), {"n": F.col("v")}).collect()}
    for group in by_key(rows).values():
        total = 0.0
        for _, i, v in group:
            total += v
            assert got[i] == pytest.approx(total)


def test_row_index_and_previous(rows, table):
    index = {r["id"]: r["row_index"] for r in od.row_index(table, ["key"], ["ts", "id"], od.time_bucket("ts", 600)).collect()}
    previous = {r["id"]: r["previous"] for r in od.previous_value(table, ["key"], "ts", ["id"], 600, "v").collect()}
    for group in by_key(rows).values():
        for place, (_, i, _) in enumerate(group):
            assert index[i] == place
            assert previous[i] == (group[place - 1][2] if place else None)


def test_halo_frames(spark):
    data = [(k, i, float((i * 7) % 11)) for k in ("x", "y") for i in range(57)]
    df = spark.createDataFrame(data, "key string, i long, v double")
    spread, order = od.with_halo(df, ["key"], "i", 5, 3, block=8)
    got = {(r["key"], r["i"]): (r["b"], r["a"]) for r in od.owned_rows(spread.withColumns({
        "b": F.sum("v").over(order.rowsBetween(-5, 0)), "a": F.sum("v").over(order.rowsBetween(1, 3))})).collect()}
    values = {k: [v for kk, _, v in data if kk == k] for k in ("x", "y")}
    assert len(got) == len(data)
    for k, i, _ in data:
        assert got[k, i] == (sum(values[k][max(0, i - 5):i + 1]), sum(values[k][i + 1:i + 4]) if i < 56 else None)


def test_segments_match_sessions(rows, table):
    packets = table.select("id", F.col("key").alias("src_ip"), F.col("ts").alias("timestamp"), F.lit(1).cast("long").alias("packet_count"),
                           F.col("v").alias("byte_count"), F.lit(1).alias("ttl"), F.lit(1).alias("tcp_window_size"),
                           F.lit("S").alias("tcp_flags"), F.lit("t").alias("source_type"))
    numbered = {r["id"]: r["flow_segment"] for r in fl.segment_flows(packets, ["src_ip"], "timestamp", ["id"], 20, 300).collect()}
    sessions = 0
    for group in by_key(rows).values():
        segment = 0
        for place, (ts, i, _) in enumerate(group):
            if place and int((ts - group[place - 1][0]).total_seconds()) > 20:
                segment += 1
            assert numbered[i] == segment
        sessions += segment + 1
    assert fl.session_flows(packets, ["src_ip"], "timestamp", 20).count() == sessions


def test_grouped_percentiles(rows, table):
    got = {r["key"]: r for r in od.grouped_percentiles(table, ["key"], "v", {"p10": .1, "p50": .5, "p99": .99}).collect()}
    for key, group in by_key(rows).items():
        values = [v for _, _, v in group]
        for name, p in (("p10", 10), ("p50", 50), ("p99", 99)):
            assert got[key][name] == pytest.approx(np.percentile(values, p))


def test_latest_per_stream(rows, table):
    got = latest_per_stream(table.withColumnRenamed("id", "event_id"), 50, "key", "ts").collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["position"]):
        found[r["key"]].append(r["event_id"])
    assert {k: v for k, v in found.items()} == {k: [i for _, i, _ in g[-50:]] for k, g in by_key(rows).items()}


def random_edges(seed, nodes, count):
    rng = random.Random(seed)
    pairs = {(0, j) for j in range(1, nodes, 3)}  # node 0 is a hub
    while len(pairs) < count:
        pairs.add((rng.randrange(nodes), rng.randrange(nodes)))
    return sorted(pairs)


def distances(pairs, nodes):
    out = collections.defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    table = {}
    for s in nodes:
        dist, sigma, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for v in out[u]:
                if v not in dist:
                    dist[v], sigma[v] = dist[u] + 1, 0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    sigma[v] += sigma[u]
        table[s] = (dist, sigma)
    return table


def test_centralities(spark):
    pairs = random_edges(3, 24, 60)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = sorted({n for p in pairs for n in p})
    table, n = distances(pairs, nodes), len(nodes)
    between = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            for v in nodes:
                if len({s, t, v}) == 3 and t in table[s][0] and v in table[s][0] and t in table[v][0]:
                    if table[s][0][v] + table[v][0][t] == table[s][0][t]:
                        between[v] += table[s][1][v] * table[v][1][t] / table[s][1][t]
    for batches in (1, 3):
        for r in pt.path_centralities(edges, batches).collect():
            assert r["betweenness"] == pytest.approx(between[r["node"]] / ((n - 1) * (n - 2)))
            inward = [table[s][0][r["node"]] for s in nodes if s != r["node"] and r["node"] in table[s][0]]
            want = len(inward) / sum(inward) * len(inward) / (n - 1) if inward else 0.0
            assert r["closeness"] == pytest.approx(want)


def test_pagerank(spark):
    pairs = random_edges(5, 30, 50)
    nodes = sorted({n for p in pairs for n in p})
    place = {v: i for i, v in enumerate(nodes)}
    links = np.zeros((len(nodes), len(nodes)))
    for a, b in pairs:
        links[place[a], place[b]] = 1
    rank = np.full(len(nodes), 1 / len(nodes))
    sink = links.sum(1) == 0
    walk = np.divide(links, links.sum(1, keepdims=True), where=~sink[:, None], out=np.zeros_like(links))
    for _ in range(200):
        rank = 0.15 / len(nodes) + 0.85 * (rank @ walk + rank[sink].sum() / len(nodes))
    for r in pt.pagerank(spark.createDataFrame(pairs, "src long, dst long"), tolerance=1e-9).collect():
        assert r["pagerank"] == pytest.approx(rank[place[r["node"]]], abs=1e-7)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (10, 11), (12, 11), (20, 20)] + [(100, 100 + i) for i in range(1, 40)] + [(300 + i, 301 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in pt.weak_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert {got[n] for n in (1, 2, 3)} == {1} and {got[n] for n in (10, 11, 12)} == {10} and got[20] == 20
    assert all(got[100 + i] == 100 for i in range(40)) and all(got[300 + i] == 300 for i in range(31))


def test_shortest_path_ties(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "z"), ("c", "z"), ("q", "a")], "src string, dst string")
    got = {r["attacker"]: r["path"] for r in pt.shortest_paths(edges, ["a", "q", "z", "nobody"], "z").collect()}
    assert got == {"a": ["a", "b", "z"], "q": ["q", "a", "b", "z"], "z": ["z"]}


def test_churn_against_sets(spark):
    rng = random.Random(11)
    present = {w: {rng.randrange(12) for _ in range(rng.choice([0, 0, 3, 6]))} for w in range(40)}
    data = [(w, e) for w, s in present.items() for e in s] or [(0, 0)]
    got = {r["window_index"]: r for r in gr.window_churn(
        spark.createDataFrame(data, "window_index long, e long"), ["e"], spark.createDataFrame([(40,)], "total_windows long")).collect()}
    for w in range(1, 40):
        a, b = present[w - 1], present[w]
        assert (got[w]["new"], got[w]["gone"]) == (len(b - a), len(a - b))
        assert got[w]["jaccard"] == (pytest.approx(len(a & b) / len(a | b)) if a | b else None)


def test_ladder_with_hot_score(spark):
    rng = random.Random(2)
    data = [(0.5 if rng.random() < .5 else round(rng.random(), 2), rng.randrange(2)) for _ in range(3000)]
    df = spark.createDataFrame(data, "score double, label int")
    pos = [s for s, y in data if y]
    neg = [s for s, y in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = sc.ranking_metrics(df).first()
    assert got["roc_auc"] == pytest.approx(auc)
    best = max((2 * sum(p >= t for p in pos) / (sum(p >= t for p in pos) + len(pos) + sum(n >= t for n in neg)), -t)
               for t in {0.5, *[s for s, _ in data]})
    pick = sc.f1_threshold(df).first()
    assert (pick["f1"], pick["threshold"]) == (pytest.approx(best[0]), -best[1])


def test_single_class_ranking_is_undefined(spark):
    row = sc.ranking_metrics(spark.createDataFrame([(0.2, 0), (0.4, 0)], "score double, label int")).first()
    assert row["roc_auc"] is None and row["average_precision"] is None


def test_recall_at_fpr_without_candidate(spark):
    row = sc.recall_at_fpr(spark.createDataFrame([(0.9, 0), (0.4, 1)], "score double, label int"), 0.05).first()
    assert row["threshold"] == float("inf") and row["recall"] == 0.0


def test_bootstrap_is_repeatable(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label"),
                                 ((F.col("id") * 37 % 100) / 100 * 0.6 + (F.col("id") % 2) * 0.3).alias("score"))
    runs = [sorted(sc.bootstrap_interval(df.repartition(n), "id", 0.5, 60).collect()) for n in (2, 5)]
    for a, b in zip(*runs):
        assert a["metric"] == b["metric"] and a["mean"] == pytest.approx(b["mean"]) and a["low"] <= a["mean"] <= a["high"]
    whole = sc.ranking_metrics(df).first()["roc_auc"]
    low, high = next((r["low"], r["high"]) for r in runs[0] if r["metric"] == "roc_auc")
    assert low <= whole <= high


def test_poisson_steps_leave_nothing_a_draw_can_tell():
    steps = sc.poisson_steps()
    assert steps == sorted(set(steps)) and steps[0] == pytest.approx(np.exp(-1)) and 1 - steps[-1] < 1e-13
    assert sum(1 - s for s in steps) == pytest.approx(1)  # the mean of a Poisson(1) weight


def test_bootstrap_draws_compare_digests_as_numbers(spark):
    steps = sc.poisson_steps()
    digests = [hashlib.md5(str(k).encode()).hexdigest() for k in range(3000)] + ["0" * 32, "f" * 32]
    digests += [f"{math.ceil(p * 2.0 ** 52) + d:013x}" + "0" * 19 for p in steps for d in (-1, 0) if math.ceil(p * 2.0 ** 52) + d < 2 ** 52]
    rows = spark.createDataFrame([(d,) for d in digests], "d string")
    got = rows.select("d", sc._steps_reached(F.col("d"), sc._draw_steps()).alias("w")).collect()
    assert all(r["w"] == sum(p <= int(r["d"][:13], 16) / 2.0 ** 52 for p in steps) for r in got)
    plan = sc.bootstrap_interval(spark.createDataFrame([(1, 0.5, 1)], "id long, score double, label int"), "id", 0.5, 60)._jdf
    assert "lambda" not in plan.queryExecution().optimizedPlan().toString()


def _copies_rows(df):
    return "Expand" in df._jdf.queryExecution().optimizedPlan().toString()


def test_edge_and_node_statistics_copy_no_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, None]), rng.choice(["a", "b", None]), rng.choice(["b", "c", None]), rng.choice([80, 443, None]), rng.choice(["T", "U", None]),
             float(rng.randrange(9))) for _ in range(300)]
    flows = spark.createDataFrame(rows, "k long, src_ip string, dst_ip string, dst_port int, protocol string, size double")
    edges = gr.edge_statistics(flows, ["size"], ["k"])
    assert not _copies_rows(edges)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[:3]].append(r)
    got = {(r["k"], r["src_ip"], r["dst_ip"]): r for r in edges.collect()}
    assert got.keys() == groups.keys()
    for key, members in groups.items():
        assert got[key]["unique_destination_ports"] == len({m[3] for m in members} - {None})
        assert got[key]["unique_protocols"] == len({m[4] for m in members} - {None})
        assert (got[key]["flow_count"], got[key]["size__sum"]) == (len(members), sum(m[5] for m in members))
    edges = edges.unionByName(edges)  # an edge may come twice
    nodes = gr.node_statistics(edges, ["k"], "size__sum", "size__max")
    assert not _copies_rows(nodes)
    found = {(r["k"], r["node"]): r for r in nodes.collect()}
    for (k, node), r in found.items():
        out, into = [v for key, v in got.items() if key[:2] == (k, node)], [v for key, v in got.items() if key[::2] == (k, node)]
        assert r["outgoing_flow_count"] == 2 * sum(v["flow_count"] for v in out) and r["incoming_flow_count"] == 2 * sum(v["flow_count"] for v in into)
        assert r["outgoing_packets"] == 2 * sum(v["size__sum"] for v in out) and r["incoming_bytes"] == 2 * sum(v["size__max"] for v in into)
        assert r["unique_destinations"] == len({v["dst_ip"] for v in out} - {None}) and r["unique_sources"] == len({v["src_ip"] for v in into} - {None})
    assert found.keys() == {(k, n) for k, s, d in got for n in (s, d)}


def test_packet_edges_copy_no_rows(spark):
    rows = [(0, "a", "b", p, 80, "TCP", 2, 10, float(p), dt.datetime(2024, 1, 1, 0, 0, p)) for p in (1, 2, 2, 3)]
    packets = spark.createDataFrame(rows, "window_index long, src_ip string, dst_ip string, src_port long, dst_port long, protocol string, "
                                          "flag_bits long, packet_length long, offset double, timestamp timestamp")
    edges = pk.edge_window_features(packets)
    assert not _copies_rows(edges)
    row = edges.first()
    assert (row["source_port_diversity"], row["destination_port_diversity"], row["packet_count"]) == (3, 1, 4)
