"""Communication graphs: edges, nodes, degrees, per-window metrics and dynamics.

Covers A15-A17, A20, A21, J3, J11, G1, G2, G6, G8, G9, G16-G20, S10, T2 and W20-W22.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.numeric import distinct_of_few, distinct_with_null, finite_double
from packetloom.operators.ordered import beside, explode_range, grouped_percentiles, row_index
from packetloom.operators.windows import window_start
from packetloom.session import cut_lineage


def _edge_stats() -> list[Column]:
    return [
        F.count("*").alias("flow_count"), F.sum("packet_count").alias("packet_count"),
        F.sum("byte_count").alias("byte_count"),
        distinct_with_null(F.col("src_port")).alias("unique_source_ports"),
        distinct_with_null(F.col("dst_port")).alias("unique_destination_ports"),
        distinct_with_null(F.col("protocol")).alias("unique_protocols"),
        F.coalesce(F.avg("flow_duration_seconds"), F.lit(0.0)).alias("mean_duration"),
    ]


def static_edges(flows: DataFrame) -> DataFrame:
    """A15. One edge per (source, destination); flows with a NULL endpoint make none."""
    return flows.dropna(subset=["src_ip", "dst_ip"]).groupBy("src_ip", "dst_ip").agg(*_edge_stats())


def dynamic_edges(flows: DataFrame, window_seconds: int = 10) -> DataFrame:
    """A16. Static edges per time window, in one aggregation."""
    return flows.dropna(subset=["src_ip", "dst_ip"]).groupBy(
        window_start("flow_start", window_seconds).alias("window_start"), "src_ip", "dst_ip").agg(*_edge_stats())


def node_features(flows: DataFrame) -> DataFrame:
    """A17 + J3. Outgoing and incoming flows, bytes and peers per host; absent sides are zero.

    Each flow yields a sender row and a receiver row, so one grouping gives what a full outer join
    of two aggregates would, from a single scan.
    """
    def role(node, peer, out):
        return F.struct(F.col(node).alias("node"), F.col(peer).alias("peer"), F.lit(out).alias("out"), F.col("byte_count"))

    rows = flows.select(F.explode(F.array(role("src_ip", "dst_ip", True), role("dst_ip", "src_ip", False))).alias("r")).select(
        "r.*").filter(F.col("node").isNotNull())
    sides = []
    for prefix, mine in (("out", F.col("out")), ("in", ~F.col("out"))):
        sides += [
            F.count_if(mine).alias(f"{prefix}_flow_count"),
            F.coalesce(F.sum(F.when(mine, F.col("byte_count"))), F.lit(0.0)).alias(f"{prefix}_bytes"),
            (F.count_distinct(F.when(mine, F.col("peer")))
             + F.max((mine & F.col("peer").isNull()).cast("int"))).alias(f"{prefix}_unique_peers"),
        ]
    return rows.groupBy("node").agg(*sides)


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst", keys: Sequence[str] = ()) -> DataFrame:
    """G1. Distinct directed neighbours; a self-loop counts once in and once out."""
    pairs = edges.select(*keys, src, dst).distinct()
    ends = pairs.select(*keys, F.explode(F.array(
        F.struct(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("end")).select(*keys, "end.*")
    return ends.groupBy(*keys, "node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total_degree"))


def degree_centrality(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """G2. Total degree over n - 1; 1 in a graph of one node."""
    degree = cut_lineage(degrees(edges, src, dst))
    counted = beside(degree, degree.agg(F.count("*").alias("__n")))
    return counted.select("node", F.when(F.col("__n") <= 1, 1.0).otherwise(
        F.col("total_degree") / F.when(F.col("__n") > 1, F.col("__n") - 1)).alias("degree_centrality"))


def suspicious_nodes(edges: DataFrame, top_k: int = 10, src: str = "src", dst: str = "dst") -> DataFrame:
    """T2. Hosts by total degree, ties by name."""
    return degrees(edges, src, dst).orderBy(F.desc("total_degree"), "node").limit(top_k)


def window_graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G6. Size, density and degree statistics of each non-empty window graph.

    ``nodes`` holds (window_index, node), ``edges`` holds (window_index, src_ip, dst_ip, packet_count,
    total_bytes); both distinct.
    """
    linked = degrees(edges, "src_ip", "dst_ip", ["window_index"])
    joined = nodes.select("window_index", "node").join(linked, ["window_index", "node"], "left").na.fill(
        0, ["in_degree", "out_degree", "total_degree"])
    by_node = joined.groupBy("window_index").agg(
        F.count("*").alias("node_count"), F.avg("in_degree").alias("mean_in_degree"),
        F.avg("out_degree").alias("mean_out_degree"), F.max("in_degree").alias("max_in_degree"),
        F.max("out_degree").alias("max_out_degree"), F.max("total_degree").alias("max_degree"),
        F.count_if(F.col("total_degree") == 0).alias("isolated_node_count"))
    by_edge = edges.groupBy("window_index").agg(
        F.count("*").alias("edge_count"), F.sum("packet_count").alias("packet_count"),
        F.sum("total_bytes").alias("byte_count"))
    n = F.col("node_count")
    return by_node.join(by_edge, "window_index", "left").na.fill(0, ["edge_count", "packet_count", "byte_count"]).withColumns({
        "density": F.when(n >= 2, F.col("edge_count") / F.when(n >= 2, n * (n - 1))),
        "average_degree": 2 * F.col("edge_count") / n,
    })


def window_distributions(metrics: DataFrame, columns: Sequence[str], total_windows: int | None = None,
                         zero_when_empty: Sequence[str] = ("node_count", "edge_count", "packet_count", "byte_count"),
                         ) -> DataFrame:
    """G8. min/median/mean/p95/max and defined count per metric over all window indices.

    Windows without traffic count as zero in the size metrics and as undefined elsewhere.
    """
    last = F.lit(total_windows - 1) if total_windows is not None else F.col("last")
    grid = explode_range(metrics.agg(F.max("window_index").alias("last")), F.lit(0), last, "window_index").drop("last")
    filled = grid.join(metrics, "window_index", "left").na.fill(0, [c for c in columns if c in zero_when_empty])
    return _distributions(filled.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "metric", "value"))


def _distributions(long: DataFrame) -> DataFrame:
    """min/median/mean/p95/max and defined count of (metric, value) rows, percentiles by ranks in buckets."""
    plain = long.groupBy("metric").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.count("value").alias("defined"))
    ranked = grouped_percentiles(long, ["metric"], "value", {"median": 0.5, "p95": 0.95})
    return plain.join(ranked, "metric", "left").select("metric", "min", "median", "mean", "p95", "max", "defined")


def window_churn(members: DataFrame, element: Sequence[str], total_windows: DataFrame) -> DataFrame:
    """W20 + W21 + U4. Appearing, vanishing and kept elements against the previous window index.

    ``members`` lists (window_index, element...); ``total_windows`` is a one-row table with
    ``total_windows``. Each membership counts for its own window and, as a prior one, for the next;
    both meet per (window, element), so an element of every window is never one task. Windows
    1 .. n-1 are all reported; Jaccard is NULL if both sides are empty.
    """
    here, yes, no = F.col("window_index"), F.lit(1), F.lit(0)
    marks = F.array(F.struct(here.alias("window_index"), yes.alias("__here"), no.alias("__prior")),
                    F.struct((here + 1).alias("window_index"), no.alias("__here"), yes.alias("__prior")))
    met = members.select(*element, F.explode(marks).alias("__m")).select(*element, "__m.*").groupBy("window_index", *element).agg(
        F.max("__here").alias("__here"), F.max("__prior").alias("__prior"))
    now, before = F.col("__here"), F.col("__prior")
    counts = met.groupBy("window_index").agg(
        F.sum(now).alias("size"), F.sum(before).alias("prior"), F.sum(now * before).alias("kept"),
        F.sum(now * (1 - before)).alias("new"), F.sum(before * (1 - now)).alias("gone"))
    grid = explode_range(total_windows, F.lit(1), F.col("total_windows") - 1, "window_index").select("window_index")
    full = grid.join(counts, "window_index", "left").na.fill(0, ["size", "new", "kept", "gone", "prior"])
    union = F.col("size") + F.col("prior") - F.col("kept")
    return full.select("window_index", "new", "gone", (F.col("new") + F.col("gone")).alias("churn"), "kept",
                       F.when(union > 0, F.col("kept") / F.when(union > 0, union)).alias("jaccard"))


def longest_run(window_indices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """W22. Longest run of consecutive non-empty window indices (gaps and islands over windows)."""
    distinct = window_indices.select(*keys, "window_index").distinct()
    placed = row_index(distinct, keys, ["window_index"], F.floor(F.col("window_index") / 4096), "__position")
    runs = placed.groupBy(*keys, (F.col("window_index") - F.col("__position")).alias("__island")).agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest_run"), F.sum("n").alias("non_empty_windows"))


def dynamics_summary(node_churn: DataFrame, edge_churn: DataFrame) -> DataFrame:
    """G9. Distribution of churn and Jaccard over consecutive windows, nodes and edges."""
    def long(churn, kind):
        return churn.select(*[F.col(c).cast("double").alias(f"{kind}_{c}") for c in ("new", "gone", "churn", "jaccard")]
                            ).unpivot([], [f"{kind}_{c}" for c in ("new", "gone", "churn", "jaccard")], "metric", "value")

    return _distributions(long(node_churn, "node").unionAll(long(edge_churn, "edge")))


def edge_statistics(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], src: str = "src_ip",
                    dst: str = "dst_ip") -> DataFrame:
    """A20. sum/mean/min/max/finite count per numeric column, plus port and protocol diversity.

    One aggregation: the ports and protocols of an edge are bounded sets, see :func:`distinct_of_few`.
    """
    aggregates = []
    for c in columns:
        value = finite_double(F.col(c))
        mean = F.sum(value) / F.when(F.count(value) > 0, F.count(value))  # as avg, without a second sum and count in the shuffle
        aggregates += [F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{c}__sum"),
                       F.coalesce(mean, F.lit(0.0)).alias(f"{c}__mean"),
                       F.coalesce(F.min(value), F.lit(0.0)).alias(f"{c}__min"),
                       F.coalesce(F.max(value), F.lit(0.0)).alias(f"{c}__max"),
                       F.count(value).alias(f"{c}__finite_count")]
    return rows.groupBy(*keys, src, dst).agg(
        F.count("*").alias("flow_count"), *aggregates,
        distinct_of_few(F.col("dst_port")).alias("unique_destination_ports"),
        distinct_of_few(F.col("protocol")).alias("unique_protocols"))


def node_statistics(edges: DataFrame, keys: Sequence[str], packets: str, bytes_: str, src: str = "src_ip",
                    dst: str = "dst_ip", once: bool = False) -> DataFrame:
    """A21. Flows, packets, bytes and distinct peers of each node from its edges, by role.

    The rows of a node meet per role and peer first, then per node, so two distinct counts take no copies.
    ``once`` tells that each edge has one row, as after :func:`edge_statistics`; then every row is a peer and
    nodes meet at once.
    """
    zero = F.lit(0).cast("long")
    ends = F.explode(F.array(
        F.struct(F.lit(True).alias("__out"), F.col(src).alias("node"), F.col(dst).alias("__peer")),
        F.struct(F.lit(False).alias("__out"), F.col(dst).alias("node"), F.col(src).alias("__peer")))).alias("__end")
    amounts = {"flow_count": F.col("flow_count"), "packets": F.col(packets), "bytes": F.col(bytes_)}
    met = edges.select(*keys, *[c.alias(f"__{n}") for n, c in amounts.items()], ends).select("*", "__end.*")
    if not once:
        met = met.groupBy(*keys, "node", "__out", "__peer").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in amounts])
    roles = {"outgoing": F.col("__out"), "incoming": ~F.col("__out")}
    nothing = {"flow_count": zero, "packets": F.lit(0.0), "bytes": F.lit(0.0)}
    return met.groupBy(*keys, "node").agg(
        *[F.sum(F.when(mine, F.col(f"__{n}")).otherwise(nothing[n])).alias(f"{role}_{n}") for n in amounts for role, mine in roles.items()],
        *[F.count_if(mine & F.col("__peer").isNotNull()).alias(name) for name, mine in (
            ("unique_destinations", roles["outgoing"]), ("unique_sources", roles["incoming"]))],
    ).withColumn("total_flow_count", F.col("outgoing_flow_count") + F.col("incoming_flow_count"))


def entity_ids(rows: DataFrame, keys: Sequence[str], order: str, src: str = "src_ip", dst: str = "dst_ip",
               block: int = 1 << 20) -> DataFrame:
    """G18. Dense ids per source in order of first appearance, the source end before the destination.

    ``order`` is the integer row number; ids are running counts over blocks of it.
    """
    from packetloom.operators.ordered import row_index

    ends = rows.select(*keys, F.col(src).alias("entity"), (F.col(order) * 2).alias("__at")).unionAll(
        rows.select(*keys, F.col(dst), F.col(order) * 2 + 1)).filter("entity IS NOT NULL")
    first = ends.groupBy(*keys, "entity").agg(F.min("__at").alias("__at"))
    return row_index(first, keys, ["__at"], F.floor(F.col("__at") / (2 * block)), "entity_id").drop("__at")


def sample_index(labelled: DataFrame, source: str = "source_file", history: int = 6) -> DataFrame:
    """G19. Sample id and history window indices of each eligible window."""
    index = F.col("window_index")
    return labelled.filter("forecast_sample_eligible").select(
        F.concat_ws(":", F.col(source), index.cast("string")).alias("sample_id"), source, "split",
        index.alias("current_window_index"), F.sequence(index - (history - 1), index).alias("history_window_indices"))


def dangling_endpoints(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], src: str = "src_ip",
                       dst: str = "dst_ip", node: str = "node") -> DataFrame:
    """J11. Edges with an endpoint missing from the node table of their window; must be empty."""
    known = nodes.select(*keys, node)

    def lacking(end):
        return edges.join(known.withColumnRenamed(node, end), [*keys, end], "left_anti").select(*keys, src, dst)

    return lacking(src).unionAll(lacking(dst)).distinct()


def validate_graph(edges: DataFrame, nodes: DataFrame, states: DataFrame, samples: DataFrame, keys: Sequence[str],
                   value_columns: Sequence[str], history: int = 6) -> DataFrame:
    """G20. One row per assertion with its violation count."""
    flows = edges.groupBy(*keys).agg(F.sum("flow_count").alias("__edge_flows"))
    mismatch = states.select(*keys, "flow_count").join(flows, list(keys), "left").filter(
        F.col("flow_count") != F.coalesce("__edge_flows", F.lit(0)))
    unknown = edges.select(*keys).distinct().join(states, list(keys), "left_anti")
    bad = edges.filter(F.greatest(*[finite_double(F.col(c)).isNull().cast("int") for c in value_columns]) == 1)
    wrong = samples.filter((F.size("history_window_indices") != history) | (
        F.element_at("history_window_indices", -1) != F.col("current_window_index")))
    checks: Mapping[str, DataFrame] = {
        "flow_reconciliation": mismatch, "snapshot_in_index": unknown,
        "endpoints_present": dangling_endpoints(edges, nodes, keys), "finite_values": bad, "history_mapping": wrong,
    }
    result = None
    for name, rows in checks.items():
        row = rows.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
        result = row if result is None else result.unionAll(row)
    return result


def snapshot_artifact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """S10. Window-by-window graph as JSON lines, one row for each edge and node, whatever the size."""
    return edges.select("window_index", F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("payload")).unionAll(
        nodes.select("window_index", F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("payload")))


def snapshot_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """S10. One JSON line of counts for each window with nodes."""
    per_window = nodes.groupBy("window_index").agg(F.count("*").alias("node_count")).join(
        edges.groupBy("window_index").agg(F.count("*").alias("edge_count"), F.sum("packet_count").alias("packet_count"),
                                          F.sum("total_bytes").alias("byte_count")), "window_index", "left")
    return per_window.select("window_index", F.lit("summary").alias("kind"), F.to_json(F.struct(*per_window.columns)).alias("payload"))


# The compared metrics that tell how rich a capture is.
RICHNESS_METRICS = [
    "packet_count", "unique_hosts", "unique_directed_pairs", "p95_nodes_per_window", "max_nodes_per_window",
    "p95_edges_per_window", "max_edges_per_window", "non_empty_window_fraction", "longest_non_empty_run",
    "mean_edge_jaccard_consecutive", "mean_node_jaccard_consecutive",
]
COMPARED_METRICS = [
    "packet_count", "duration_seconds", "unique_hosts", "unique_directed_pairs", "median_nodes_per_window",
    "p95_nodes_per_window", "max_nodes_per_window", "median_edges_per_window", "p95_edges_per_window",
    "max_edges_per_window", "non_empty_window_fraction", "longest_non_empty_run", "mean_edge_jaccard_consecutive",
    "mean_node_jaccard_consecutive", "sparsity_fraction",
]


def compare_captures(summaries: DataFrame, first: str, second: str, capture: str = "capture",
                     metrics: Sequence[str] = tuple(COMPARED_METRICS)) -> DataFrame:
    """G16. Metric by metric, both captures and second over first (NULL for a zero base)."""
    long = summaries.select(capture, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [capture], list(metrics), "metric", "value")
    both = long.groupBy("metric").agg(
        F.max(F.when(F.col(capture) == first, F.col("value"))).alias("first_value"),
        F.max(F.when(F.col(capture) == second, F.col("value"))).alias("second_value"))
    return both.withColumn("ratio", F.when(
        F.col("first_value") != 0, F.col("second_value") / F.when(F.col("first_value") != 0, F.col("first_value"))))


def richness_class(comparison: DataFrame) -> DataFrame:
    """G17. A: small and sparse throughout; C: richer in every metric; else B."""
    ratio = F.when(F.col("metric").isin(RICHNESS_METRICS), F.col("ratio"))

    def both(metric, test):
        rows = F.col("metric") == metric
        return F.coalesce(F.max(F.when(rows, test(F.col("first_value")) & test(F.col("second_value")))), F.lit(False))

    measured = comparison.agg(
        F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"),
        both("sparsity_fraction", lambda v: v > 0.99).alias("both_sparse"),
        both("max_nodes_per_window", lambda v: v <= 10).alias("both_small"))
    return measured.withColumn("classification", F.when(
        (F.col("max_ratio") < 2.5) & F.col("both_sparse") & F.col("both_small"), "A"
    ).when(F.col("min_ratio") >= 3.0, "C").otherwise("B"))
