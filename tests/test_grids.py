"""Long grids, hot keys of a narrow range of values, bursts, and checks on models and trajectories."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions import risk as rk
from packetloom.operators import dataset as ds
from packetloom.operators import flows as fl
from packetloom.operators import graph as gr
from packetloom.operators import ordered as od
from packetloom.operators import scores as sc


def test_explode_range(spark):
    rows = spark.createDataFrame([("a", 3, 12), ("b", 5, 5), ("c", 2, 1), ("d", None, 4)], "k string, lo int, hi int")
    got = sorted((r["k"], r["i"]) for r in od.explode_range(rows, F.col("lo"), F.col("hi"), "i", span=4).collect())
    assert got == [("a", i) for i in range(3, 13)] + [("b", 5)]


def test_long_range_is_dealt_over_tasks(spark):
    one = spark.createDataFrame([(0, 30_000_000)], "lo long, hi long")
    spread = od.explode_range(one, F.col("lo"), F.col("hi"), "i").groupBy(F.spark_partition_id().alias("task")).agg(
        F.count("*").alias("n"), F.sum("i").alias("s")).collect()
    assert sum(r["n"] for r in spread) == 30_000_001
    assert sum(r["s"] for r in spread) == 30_000_000 * 30_000_001 // 2
    assert len(spread) > 8 and max(r["n"] for r in spread) < 5_000_000


def test_two_events_fifty_years_apart(spark):
    first, last = dt.datetime(1974, 1, 1), dt.datetime(2024, 1, 1)
    states = spark.createDataFrame([("f", first, 2), ("f", last, 3), ("g", last, 1)], "source_file string, window_start timestamp_ntz, flow_count int")
    timeline = ds.complete_timeline(states, 600)
    count = int((last - first).total_seconds()) // 600 + 1
    got = {r["source_file"]: r for r in timeline.groupBy("source_file").agg(
        F.count("*").alias("n"), F.sum("flow_count").alias("flows"), F.max("window_index").alias("last"),
        F.max("window_start").alias("until"), F.max("window_count").alias("count")).collect()}
    assert (got["f"]["n"], got["f"]["flows"], got["f"]["last"], got["f"]["until"], got["f"]["count"]) == (count, 5, count - 1, last, count)
    assert (got["g"]["n"], got["g"]["flows"]) == (1, 1)


def test_window_distributions_with_a_stray_window(spark):
    metrics = spark.createDataFrame([(0, 4, 1.0), (999_999, 8, None)], "window_index long, node_count long, density double")
    got = {r["metric"]: r for r in gr.window_distributions(metrics, ["node_count", "density"]).collect()}
    assert (got["node_count"]["defined"], got["node_count"]["max"], got["node_count"]["median"]) == (1_000_000, 8, 0)
    assert (got["density"]["defined"], got["density"]["p95"]) == (1, 1.0)


def test_hot_key_of_a_narrow_range_is_split(spark):
    """Nine tenths of the rows lie between two cut points that all keys would share."""
    rng = random.Random(3)
    data = [("hot", 500 + rng.random() / 1e6) for _ in range(9000)] + [(k, rng.random() * 1000) for k in "abc" for _ in range(330)]
    data += [("hot", float("nan")), (None, 7.0)]
    table = spark.createDataFrame(data, "key string, v double").repartition(6)
    counts = od.cut_lineage(table.groupBy("key", "v").agg(F.count("*").alias("n")))
    sizes = [r["count"] for r in od.add_key_value_bucket(counts, ["key"], "v", rows_per_bucket=500).groupBy("key", "__vb").count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == counts.count()
    got = {r["key"]: r for r in od.grouped_percentiles(
        table.filter("NOT isnan(v)"), ["key"], "v", {"p10": .1, "p50": .5, "p99": .99}, rows_per_bucket=500).collect()}
    for key in ("hot", "a", "b", "c", None):
        values = [v for k, v in data if k == key and v == v]
        assert [got[key][p] for p in ("p10", "p50", "p99")] == pytest.approx(np.percentile(values, [10, 50, 99]), rel=1e-12)


def test_burst_within_a_slice_is_cut(spark):
    """A third of all packets belong to one key within one second."""
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    data = [("hot", start + dt.timedelta(microseconds=rng.randrange(1_000_000)), i) for i in range(2000)]
    data += [(rng.choice(["hot", "a", None]), start + dt.timedelta(seconds=rng.randrange(40_000)), 2000 + i) for i in range(4000)]
    table = spark.createDataFrame(data, "src_ip string, timestamp timestamp_ntz, id long").repartition(5)
    sizes = [r["count"] for r in od.add_time_bucket(table, ["src_ip"], "timestamp", 3600, 100).groupBy("src_ip", od.BUCKET).count().collect()]
    assert max(sizes) <= 250 and sum(sizes) == 6000
    groups = {}
    for key, ts, i in data:
        groups.setdefault(key, []).append((ts, i))
    before, segment = {}, {}
    for group in groups.values():
        group.sort()
        number = 0
        for place, (ts, i) in enumerate(group):
            before[i] = group[place - 1][0] if place else None
            number += place > 0 and int((ts - before[i]).total_seconds()) > 5
            segment[i] = number
    previous = od.previous_value(table, ["src_ip"], "timestamp", ["id"], 3600, rows_per_bucket=100)
    assert {r["id"]: r["previous"] for r in previous.collect()} == before
    numbered = fl.segment_flows(table, ["src_ip"], tie_break=["id"], timeout_seconds=5, rows_per_bucket=100)
    assert {r["id"]: r["flow_segment"] for r in numbered.collect()} == segment


def test_comparison_checks(spark):
    rows = [(m, s, k, int(k % 3 == 0)) for m in "xy" for s in ("validation", "test") for k in range(30)]
    even = {r["split"]: r for r in sc.comparison_checks(spark.createDataFrame(rows, "model string, split string, k int, label int"), ["k"]).collect()}
    assert {r["status"] for r in even.values()} == {"PASS"}
    # a swap of two labels keeps the prevalence and is still found; a missing split fails too
    odd = [(m, s, k, 1 - y if (m, s) == ("y", "test") and k in (0, 1) else y) for m, s, k, y in rows] + [("x", "extra", 1, None)]
    got = {r["split"]: r for r in sc.comparison_checks(spark.createDataFrame(odd, "model string, split string, k int, label int"), ["k"]).collect()}
    assert (got["test"]["prevalence_equal"], got["test"]["label_mismatches"], got["test"]["status"]) == (True, 2, "FAIL")
    assert (got["validation"]["status"], got["extra"]["status"], got["extra"]["missing_samples"]) == ("PASS", "FAIL", 1)


def test_account_without_features_and_with_a_warning(spark):
    steps = "array(struct(1 as step, 0 as stage, 0.9D as confidence, 0.1D as non_benign), struct(2 as step, 3 as stage, 0.95D as confidence, 0.9D as non_benign))"
    row = spark.range(1).select(
        rk.trajectory_account(F.lit(0.2), F.expr(steps)).alias("plain"),
        rk.trajectory_account(F.lit(0.9), F.expr(steps), F.array(F.lit("a"), F.lit("b"))).alias("driven")).first()
    assert "Warning" in row["plain"] and "driven" not in row["plain"] and "increasing (first step 0.1000, last step 0.9000)" in row["plain"]
    assert "Warning" not in row["driven"] and row["driven"].endswith("is driven most by b.")
