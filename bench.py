"""Wall time of the headline reports; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from packetloom.plans.catalog import reports
from packetloom.session import build_session

HEADLINE = [
    "flow_segments", "flow_features", "flow_directional", "window_state", "window_rolling", "timeline_gapfill", "state_sum_mean",
    "future_label", "sequence_xy", "edge_static", "packet_edges", "packet_nodes", "window_graph_metrics", "churn_edges",
    "microbatch_events", "packet_window_stats", "edge_statistics", "weak_components", "pagerank", "victim_ranking", "label_map",
    "attack_chain", "f1_threshold", "roc_auc", "threshold_sweep", "score_percentiles", "feature_quality", "train_scaler",
    "stream_window_states",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("packetloom-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known = reports()
    known["keyword_severity"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_reports_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
