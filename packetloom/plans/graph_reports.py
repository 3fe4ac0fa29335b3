"""Graph reports: static, dynamic and windowed communication graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom import adapters
from packetloom.operators import graph as gr
from packetloom.operators import packets as pk
from packetloom.plans import dataset_reports as dr
from packetloom.plans import flow_reports as fr
from packetloom.plans import packet_reports as pr
from packetloom.plans.registry import Reports, with_tables

REPORTS = Reports()
EDGE_SELECT = """count(*) AS flow_count, CAST(sum(packet_count) AS BIGINT) AS packet_count,
  sum(byte_count) AS byte_count, count(DISTINCT src_port) AS unique_source_ports,
  count(DISTINCT dst_port) AS unique_destination_ports, count(DISTINCT protocol) AS unique_protocols,
  avg(flow_duration_seconds) * count(*) AS total_duration FROM flows GROUP BY ALL"""


def total_duration(edges):
    """The mean times the count: whole microseconds, so both engines round alike."""
    return edges.withColumn("total_duration", F.col("mean_duration") * F.col("flow_count")).drop("mean_duration")


REPORTS.add(
    "edge_static", lambda s, d: total_duration(gr.static_edges(fr.source_flows(s, d))),
    with_tables(*fr.BASE, select=f"SELECT src_ip, dst_ip, {EDGE_SELECT}"), doubles=["total_duration"], digits=6,
)
REPORTS.add(
    "edge_dynamic", lambda s, d: total_duration(gr.dynamic_edges(fr.source_flows(s, d), 86400)),
    with_tables(*fr.BASE, select=f"""SELECT time_bucket(INTERVAL 1 DAY, flow_start) AS window_start, src_ip, dst_ip,
  {EDGE_SELECT}"""), doubles=["total_duration"], digits=6,
)
REPORTS.add(
    "node_features", lambda s, d: gr.node_features(fr.source_flows(s, d)),
    with_tables(*fr.BASE, select="""SELECT coalesce(o.node, i.node) AS node,
  coalesce(out_flow_count, 0) AS out_flow_count, coalesce(out_bytes, 0) AS out_bytes,
  coalesce(out_unique_peers, 0) AS out_unique_peers, coalesce(in_flow_count, 0) AS in_flow_count,
  coalesce(in_bytes, 0) AS in_bytes, coalesce(in_unique_peers, 0) AS in_unique_peers FROM
  (SELECT src_ip AS node, count(*) AS out_flow_count, sum(byte_count) AS out_bytes, count(DISTINCT dst_ip) AS out_unique_peers
   FROM flows GROUP BY 1) o FULL JOIN
  (SELECT dst_ip AS node, count(*) AS in_flow_count, sum(byte_count) AS in_bytes, count(DISTINCT src_ip) AS in_unique_peers
   FROM flows GROUP BY 1) i ON o.node = i.node"""),
)
DEGREE_SQL = """
ends AS (SELECT src AS node, 1 AS o, 0 AS i FROM peer_edges UNION ALL SELECT dst, 0, 1 FROM peer_edges),
degree AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree,
  count(*) AS total_degree FROM ends GROUP BY 1)"""
REPORTS.add("node_degree", lambda s, d: gr.degrees(adapters.peer_edges(s, d)),
            with_tables(adapters.PEER_EDGES_SQL, DEGREE_SQL, select="SELECT * FROM degree"))
REPORTS.add("suspicious_nodes", lambda s, d: gr.suspicious_nodes(adapters.peer_edges(s, d), 10),
            with_tables(adapters.PEER_EDGES_SQL, DEGREE_SQL,
                        select="SELECT * FROM degree ORDER BY total_degree DESC, node LIMIT 10"))
REPORTS.add(
    "degree_centrality", lambda s, d: gr.degree_centrality(adapters.peer_edges(s, d)),
    with_tables(adapters.PEER_EDGES_SQL, DEGREE_SQL, select="""SELECT node,
  total_degree / ((SELECT count(*) FROM degree) - 1) AS degree_centrality FROM degree"""),
    doubles=["degree_centrality"],
)


def flow_edges(spark, sf_dir):
    """Supplier -> part edges of lineitem, per ship year."""
    items = adapters.table(spark, sf_dir, "lineitem")
    return items.select(
        F.year("l_shipdate").alias("ship_year"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_ip"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst_ip"), F.col("l_linenumber").alias("dst_port"),
        F.col("l_returnflag").alias("protocol"), F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).alias("cents"))


ITEM_EDGES_SQL = """
items AS (SELECT year(l_shipdate) AS ship_year, 's' || l_suppkey AS src_ip, 'p' || l_partkey AS dst_ip,
  l_linenumber AS dst_port, l_returnflag AS protocol, l_quantity AS quantity, round(l_extendedprice * 100) AS cents
  FROM lineitem),
item_edges AS (SELECT ship_year, src_ip, dst_ip, count(*) AS flow_count, """ + ", ".join(
    f"sum({c}) AS {c}__sum, avg({c}) AS {c}__mean, min({c}) AS {c}__min, max({c}) AS {c}__max, "
    f"count({c}) AS {c}__finite_count" for c in ("quantity", "cents")) + """,
  count(DISTINCT dst_port) AS unique_destination_ports, count(DISTINCT protocol) AS unique_protocols
  FROM items GROUP BY 1, 2, 3)"""


def item_edges(spark, sf_dir):
    return gr.edge_statistics(flow_edges(spark, sf_dir), ["quantity", "cents"], ["ship_year"])


def item_nodes(spark, sf_dir, edges=None):
    """Nodes of the item graph, from its ``edges`` where these lie written already."""
    edges = item_edges(spark, sf_dir) if edges is None else edges
    return gr.node_statistics(edges, ["ship_year"], "quantity__sum", "cents__sum", once=True)


REPORTS.add("edge_statistics", item_edges, with_tables(ITEM_EDGES_SQL, select="SELECT * FROM item_edges"),
            doubles=["quantity__mean", "cents__mean"])
REPORTS.add(
    "node_statistics", item_nodes,
    with_tables(ITEM_EDGES_SQL, """
sides AS (SELECT ship_year, src_ip AS node, flow_count AS o, 0 AS i, quantity__sum AS op, 0 AS ip, cents__sum AS ob, 0 AS ib,
    dst_ip AS t, NULL AS f FROM item_edges
  UNION ALL SELECT ship_year, dst_ip, 0, flow_count, 0, quantity__sum, 0, cents__sum, NULL, src_ip FROM item_edges)""",
                select="""SELECT ship_year, node, CAST(sum(o) AS BIGINT) AS outgoing_flow_count,
  CAST(sum(i) AS BIGINT) AS incoming_flow_count, sum(op) AS outgoing_packets, sum(ip) AS incoming_packets,
  sum(ob) AS outgoing_bytes, sum(ib) AS incoming_bytes, count(DISTINCT t) AS unique_destinations,
  count(DISTINCT f) AS unique_sources, CAST(sum(o) + sum(i) AS BIGINT) AS total_flow_count FROM sides GROUP BY 1, 2"""),
)
METRICS_SQL = """
window_degree AS (SELECT window_index, node, sum(o) AS o, sum(i) AS i FROM (
    SELECT window_index, src_ip AS node, 1 AS o, 0 AS i FROM edges UNION ALL
    SELECT window_index, dst_ip, 0, 1 FROM edges) GROUP BY 1, 2),
node_side AS (SELECT window_index, count(*) AS node_count, avg(i) AS mean_in_degree, avg(o) AS mean_out_degree,
  CAST(max(i) AS BIGINT) AS max_in_degree, CAST(max(o) AS BIGINT) AS max_out_degree, CAST(max(i + o) AS BIGINT) AS max_degree,
  CAST(0 AS BIGINT) AS isolated_node_count FROM window_degree GROUP BY 1),
edge_side AS (SELECT window_index, count(*) AS edge_count, CAST(sum(packet_count) AS BIGINT) AS packet_count,
  CAST(sum(total_bytes) AS BIGINT) AS byte_count FROM edges GROUP BY 1),
metrics AS (SELECT *, CASE WHEN node_count > 1 THEN edge_count / (node_count * (node_count - 1)) END AS density,
  2 * edge_count / node_count AS average_degree FROM node_side JOIN edge_side USING (window_index))"""
METRIC_DOUBLES = ["mean_in_degree", "mean_out_degree", "density", "average_degree"]


def metrics(spark, sf_dir):
    return gr.window_graph_metrics(pr.nodes(spark, sf_dir), pr.edges(spark, sf_dir))


REPORTS.add("window_graph_metrics", metrics,
            with_tables(*pr.BASE, pr.EDGES_SQL, METRICS_SQL, select="SELECT * FROM metrics"), doubles=METRIC_DOUBLES)
DISTRIBUTED = ["node_count", "edge_count", "packet_count", "density", "average_degree", "max_degree"]
SUMMARY = """min(value) AS "min", quantile_cont(value, 0.5) AS median, avg(value) AS mean,
  quantile_cont(value, 0.95) AS p95, max(value) AS "max", count(value) AS defined"""
def short_metrics(spark, sf_dir):
    rows = pr.short_capture(spark, sf_dir)
    return gr.window_graph_metrics(pk.node_window_features(rows), pk.edge_window_features(rows, pr.TIE, 600))


REPORTS.add(
    "graph_distributions", lambda s, d: gr.window_distributions(short_metrics(s, d), DISTRIBUTED),
    with_tables(*pr.BASE, pr.SHORT_SQL, pr.EDGES_SQL.replace("FROM capture)", "FROM short_capture)"), METRICS_SQL, """
grid AS (SELECT unnest(generate_series(0, (SELECT max(window_index) FROM metrics))) AS window_index),
filled AS (SELECT grid.window_index, CAST(coalesce(node_count, 0) AS DOUBLE) AS node_count,
  CAST(coalesce(edge_count, 0) AS DOUBLE) AS edge_count, CAST(coalesce(packet_count, 0) AS DOUBLE) AS packet_count, density,
  average_degree, CAST(max_degree AS DOUBLE) AS max_degree FROM grid LEFT JOIN metrics m ON m.window_index = grid.window_index),
long AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS value FROM filled" for c in DISTRIBUTED) + ")",
                select=f"SELECT metric, {SUMMARY} FROM long GROUP BY 1"),
    doubles=["min", "median", "mean", "p95", "max"],
)


def total_windows(spark, sf_dir):
    return pr.short_capture(spark, sf_dir).agg((F.max("window_index") + 1).alias("total_windows"))


def node_churn(spark, sf_dir):
    ends = pr.short_capture(spark, sf_dir).select("window_index", F.explode(F.array("src_ip", "dst_ip")).alias("node"))
    return gr.window_churn(ends, ["node"], total_windows(spark, sf_dir))


def edge_churn(spark, sf_dir):
    return gr.window_churn(pr.short_capture(spark, sf_dir), ["src_ip", "dst_ip"], total_windows(spark, sf_dir))


def _churn_sql(name: str, members: str) -> str:
    return f"""
{name}_m AS ({members}),
{name}_w AS (SELECT unnest(generate_series(1, (SELECT max(window_index) FROM short_capture))) AS window_index),
{name}_c AS (SELECT b.window_index, e, 1 AS side FROM {name}_m b UNION ALL
  SELECT window_index + 1, e, 2 FROM {name}_m),
{name}_p AS (SELECT window_index, e, sum(side) AS s FROM {name}_c GROUP BY 1, 2),
{name} AS (SELECT w.window_index, count(*) FILTER (s = 1) AS "new", count(*) FILTER (s = 2) AS gone,
  count(*) FILTER (s IN (1, 2)) AS churn, count(*) FILTER (s = 3) AS kept,
  CASE WHEN count(s) > 0 THEN count(*) FILTER (s = 3) / count(s) END AS jaccard
  FROM {name}_w w LEFT JOIN {name}_p p USING (window_index) GROUP BY 1)"""


SPARSE = "short_capture"
NODE_CHURN_SQL = _churn_sql("node_churn", f"""SELECT window_index, src_ip AS e FROM {SPARSE}
  UNION SELECT window_index, dst_ip FROM {SPARSE}""")
EDGE_CHURN_SQL = _churn_sql("edge_churn", f"SELECT DISTINCT window_index, src_ip || '>' || dst_ip AS e FROM {SPARSE}")
REPORTS.add("churn_nodes", lambda s, d: node_churn(s, d).drop("kept", "jaccard"),
            with_tables(*pr.BASE, pr.SHORT_SQL, NODE_CHURN_SQL, select='SELECT window_index, "new", gone, churn FROM node_churn'))
REPORTS.add("churn_edges", lambda s, d: edge_churn(s, d).drop("kept", "jaccard"),
            with_tables(*pr.BASE, pr.SHORT_SQL, EDGE_CHURN_SQL, select='SELECT window_index, "new", gone, churn FROM edge_churn'))
REPORTS.add(
    "jaccard_windows",
    lambda s, d: node_churn(s, d).select("window_index", F.col("jaccard").alias("node_jaccard")).join(
        edge_churn(s, d).select("window_index", F.col("jaccard").alias("edge_jaccard")), "window_index"),
    with_tables(*pr.BASE, pr.SHORT_SQL, NODE_CHURN_SQL, EDGE_CHURN_SQL, select="""SELECT n.window_index, n.jaccard AS node_jaccard,
  e.jaccard AS edge_jaccard FROM node_churn n JOIN edge_churn e USING (window_index)"""),
    doubles=["node_jaccard", "edge_jaccard"],
)
RUN_SQL = f"""
runs AS (SELECT window_index - row_number() OVER (ORDER BY window_index) AS g FROM (SELECT DISTINCT window_index FROM {SPARSE})),
islands AS (SELECT g, count(*) AS n FROM runs GROUP BY 1)"""
REPORTS.add("longest_run", lambda s, d: gr.longest_run(pr.short_capture(s, d)),
            with_tables(*pr.BASE, pr.SHORT_SQL, RUN_SQL, select="""SELECT max(n) AS longest_run, CAST(sum(n) AS BIGINT) AS non_empty_windows
  FROM islands"""))
REPORTS.add(
    "dynamics_summary", lambda s, d: gr.dynamics_summary(node_churn(s, d), edge_churn(s, d)),
    with_tables(*pr.BASE, pr.SHORT_SQL, NODE_CHURN_SQL, EDGE_CHURN_SQL, "long AS (" + " UNION ALL ".join(
        f'SELECT \'{k}_{c}\' AS metric, CAST("{c}" AS DOUBLE) AS value FROM {k}_churn'
        for k in ("node", "edge") for c in ("new", "gone", "churn", "jaccard")) + ")",
                select=f"SELECT metric, {SUMMARY} FROM long GROUP BY 1"),
    doubles=["min", "median", "mean", "p95", "max"],
)
REPORTS.add(
    "entity_ids",
    lambda s, d: gr.entity_ids(adapters.packets(s, d), ["source_file"], "event_id", block=1000),
    with_tables(pr.PACKETS_SQL, """
firsts AS (SELECT source_file, entity, min(pos) AS pos FROM (SELECT source_file, src_ip AS entity, event_id * 2 AS pos
  FROM packets UNION ALL SELECT source_file, dst_ip, event_id * 2 + 1 FROM packets) GROUP BY 1, 2)""",
                select="""SELECT source_file, entity, row_number() OVER (PARTITION BY source_file ORDER BY pos) - 1
  AS entity_id FROM firsts"""),
)
REPORTS.add(
    "sample_index",
    lambda s, d: gr.sample_index(dr.labelled(s, d)).withColumn("history_window_indices", F.array_join(
        F.transform("history_window_indices", lambda v: v.cast("string")), ",")),
    with_tables(*dr.LABELLED, select="""SELECT source_file || ':' || window_index AS sample_id, source_file, split,
  window_index AS current_window_index, array_to_string(generate_series(window_index - 5, window_index), ',')
  AS history_window_indices FROM labelled WHERE eligible"""),
)
def known_hosts(s, d):
    """The capture with hosts renamed outside TCP, so that some endpoints have no node."""
    mark = F.when(F.col("protocol") == "TCP", "").otherwise("/udp")
    return pr.capture(s, d).withColumns({c: F.concat(c, mark) for c in ("src_ip", "dst_ip")})


REPORTS.add(
    "dangling_endpoints",
    lambda s, d: gr.dangling_endpoints(
        pr.edges(s, d), pk.node_window_features(known_hosts(s, d)), ["window_index"]),
    with_tables(*pr.BASE, """
named AS (SELECT window_index, src_ip, dst_ip, CASE WHEN protocol = 'TCP' THEN '' ELSE '/udp' END AS mark FROM capture),
known AS (SELECT window_index AS w, src_ip || mark AS n FROM named UNION SELECT window_index, dst_ip || mark FROM named)""", select="""SELECT DISTINCT window_index, src_ip, dst_ip FROM capture
  WHERE NOT EXISTS (SELECT 1 FROM known WHERE w = window_index AND n = src_ip)
    OR NOT EXISTS (SELECT 1 FROM known WHERE w = window_index AND n = dst_ip)"""),
)
def faulty_graph(s, d):
    """The item graph with planted faults, some for each check."""
    edges = item_edges(s, d).withColumn("cents__sum", F.when(F.col("quantity__sum") <= 40, F.col("cents__sum")).otherwise(
        F.lit(float("nan"))))
    states = flow_edges(s, d).groupBy("ship_year").agg((F.count("*") + F.col("ship_year") % 2).alias("flow_count"))
    index = F.col("current_window_index")
    return (edges, item_nodes(s, d).filter(~F.col("node").endswith("7")), states.filter("ship_year % 3 > 0"),
            gr.sample_index(dr.labelled(s, d)).withColumn("current_window_index", F.when(index % 4 > 0, index).otherwise(index + 1)))


REPORTS.add(
    "graph_validation",
    lambda s, d: gr.validate_graph(*faulty_graph(s, d), ["ship_year"], ["quantity__sum", "cents__sum"]),
    with_tables(ITEM_EDGES_SQL, *dr.LABELLED, "years AS (SELECT DISTINCT ship_year FROM items)", select="""
SELECT 'flow_reconciliation' AS "check", count(*) AS violations FROM years WHERE ship_year % 2 = 1 AND ship_year % 3 > 0
UNION ALL SELECT 'snapshot_in_index', count(*) FROM years WHERE ship_year % 3 = 0
UNION ALL SELECT 'endpoints_present', count(*) FROM item_edges WHERE src_ip LIKE '%7' OR dst_ip LIKE '%7'
UNION ALL SELECT 'finite_values', count(*) FROM item_edges WHERE quantity__sum > 40
UNION ALL SELECT 'history_mapping', count(*) FROM labelled WHERE eligible AND window_index % 4 = 0"""),
)
REPORTS.add(
    "snapshot_artifact",
    lambda s, d: gr.snapshot_artifact(pr.nodes(s, d), pr.edges(s, d)).groupBy("window_index", "kind").agg(
        F.count("*").alias("n"), F.sum(F.get_json_object("payload", "$.packet_count").cast("long")).alias("packets"),
        F.count(F.coalesce(F.get_json_object("payload", "$.src_ip"), F.get_json_object("payload", "$.node"))).alias("named")),
    with_tables(*pr.BASE, pr.EDGES_SQL, pr.NODES_SQL, select="""SELECT window_index, 'edge' AS kind, count(*) AS n,
  CAST(sum(packet_count) AS BIGINT) AS packets, count(src_ip) AS named FROM edges GROUP BY window_index
  UNION ALL SELECT window_index, 'node', count(*), CAST(sum(packet_count) AS BIGINT), count(node) FROM nodes GROUP BY window_index"""),
)
REPORTS.add(
    "snapshot_summary",
    lambda s, d: gr.snapshot_summary(pr.nodes(s, d), pr.edges(s, d)).groupBy("kind").agg(
        F.count("*").alias("windows"),
        F.sum(F.get_json_object("payload", "$.edge_count").cast("long")).alias("edge_rows")),
    with_tables(*pr.BASE, pr.EDGES_SQL, select="""SELECT 'summary' AS kind, count(DISTINCT window_index) AS windows,
  count(*) AS edge_rows FROM edges"""),
)


def capture_measures(spark, sf_dir):
    """The compared metrics of two captures: even and odd source sites."""
    result = None
    for name, sites in (("first", (0, 2)), ("second", (1, 3))):
        rows = adapters.packets(spark, sf_dir).filter(F.col("source_file").isin([f"site-{i}" for i in sites]))
        placed = pk.with_capture_offsets(rows, pr.WINDOW)
        summary = pk.capture_summary(rows).select("packet_count", "duration_seconds", "unique_directed_pairs")
        measured = pk.beside(summary, pk.host_counts(rows))
        per_window = placed.groupBy("window_index").agg(
            F.count_distinct("src_ip", "dst_ip").alias("edge_count"))
        ends = placed.select("window_index", F.col("src_ip").alias("node")).union(placed.select("window_index", "dst_ip"))
        node_count = ends.groupBy("window_index").agg(F.count_distinct("node").alias("node_count"))
        spread = per_window.join(node_count, "window_index").agg(
            *[fn(f"{c}_count").alias(f"{k}_{c}s_per_window") for c in ("node", "edge") for k, fn in (
                ("median", lambda v: F.percentile(v, 0.5)), ("p95", lambda v: F.percentile(v, 0.95)), ("max", F.max))],
            (F.count("*") / (F.max("window_index") + 1)).alias("non_empty_window_fraction"))
        total = placed.agg((F.max("window_index") + 1).alias("total_windows"))
        node_j = gr.window_churn(ends, ["node"], total).agg(F.avg("jaccard").alias("mean_node_jaccard_consecutive"))
        edge_j = gr.window_churn(placed, ["src_ip", "dst_ip"], total).agg(
            F.avg("jaccard").alias("mean_edge_jaccard_consecutive"))
        run = gr.longest_run(placed).select(F.col("longest_run").alias("longest_non_empty_run"))
        for other in (spread, node_j, edge_j, run):
            measured = pk.beside(measured, other)
        n = F.col("unique_hosts")
        row = measured.withColumn("sparsity_fraction", 1 - F.col("unique_directed_pairs") / (n * (n - 1))).withColumn(
            "capture", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result


def _measure_sql(name: str, sites: str) -> str:
    cap = f"""(SELECT *, date_diff('microsecond', min("timestamp") OVER (), "timestamp") // 21600000000 AS w
      FROM packets WHERE source_file IN ({sites}))"""
    return f"""
{name}_cap AS (SELECT * FROM {cap}),
{name}_ends AS (SELECT DISTINCT w AS window_index, src_ip AS e FROM {name}_cap UNION SELECT w, dst_ip FROM {name}_cap),
{name}_pairs AS (SELECT DISTINCT w AS window_index, src_ip || '>' || dst_ip AS e FROM {name}_cap),
{name}_nj AS (SELECT window_index, count(*) FILTER (s = 3) / count(*) AS j FROM (SELECT window_index, e, sum(side) AS s FROM (
  SELECT window_index, e, 1 AS side FROM {name}_ends UNION ALL SELECT window_index + 1, e, 2 FROM {name}_ends) GROUP BY 1, 2)
  WHERE window_index BETWEEN 1 AND (SELECT max(w) FROM {name}_cap) GROUP BY 1),
{name}_ej AS (SELECT window_index, count(*) FILTER (s = 3) / count(*) AS j FROM (SELECT window_index, e, sum(side) AS s FROM (
  SELECT window_index, e, 1 AS side FROM {name}_pairs UNION ALL SELECT window_index + 1, e, 2 FROM {name}_pairs) GROUP BY 1, 2)
  WHERE window_index BETWEEN 1 AND (SELECT max(w) FROM {name}_cap) GROUP BY 1),
{name}_runs AS (SELECT max(n) AS r FROM (SELECT g, count(*) AS n FROM (SELECT window_index - row_number() OVER (ORDER BY window_index) AS g
  FROM (SELECT DISTINCT window_index FROM {name}_ends)) GROUP BY 1)),
{name} AS (SELECT '{name}' AS capture, count(*) AS packet_count,
  date_diff('microsecond', min("timestamp"), max("timestamp")) / 1000000 AS duration_seconds,
  (SELECT count(DISTINCT e) FROM {name}_ends) AS unique_hosts, count(DISTINCT (src_ip, dst_ip)) AS unique_directed_pairs,
  (SELECT quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM {name}_ends GROUP BY window_index)) AS median_nodes_per_window,
  (SELECT quantile_cont(n, 0.95) FROM (SELECT count(*) AS n FROM {name}_ends GROUP BY window_index)) AS p95_nodes_per_window,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {name}_ends GROUP BY window_index)) AS max_nodes_per_window,
  (SELECT quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM {name}_pairs GROUP BY window_index)) AS median_edges_per_window,
  (SELECT quantile_cont(n, 0.95) FROM (SELECT count(*) AS n FROM {name}_pairs GROUP BY window_index)) AS p95_edges_per_window,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {name}_pairs GROUP BY window_index)) AS max_edges_per_window,
  count(DISTINCT w) / (max(w) + 1) AS non_empty_window_fraction, (SELECT r FROM {name}_runs) AS longest_non_empty_run,
  (SELECT avg(j) FROM {name}_ej) AS mean_edge_jaccard_consecutive, (SELECT avg(j) FROM {name}_nj) AS mean_node_jaccard_consecutive
  FROM {name}_cap)"""


COMPARE_SQL = _measure_sql("first", "'site-0', 'site-2'") + "," + _measure_sql("second", "'site-1', 'site-3'") + """,
measures AS (SELECT *, 1 - unique_directed_pairs / (unique_hosts * (unique_hosts - 1)) AS sparsity_fraction
  FROM (SELECT * FROM "first" UNION ALL SELECT * FROM "second")),
compared AS (""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, max({m}) FILTER (capture = 'first') AS first_value, "
    f"max({m}) FILTER (capture = 'second') AS second_value FROM measures" for m in gr.COMPARED_METRICS) + """)"""
COMPARE_SQL = COMPARE_SQL.replace("first AS (SELECT 'first'", '"first" AS (SELECT \'first\'').replace(
    "second AS (SELECT 'second'", '"second" AS (SELECT \'second\'')
REPORTS.add(
    "capture_compare", lambda s, d: gr.compare_captures(capture_measures(s, d), "first", "second"),
    with_tables(pr.PACKETS_SQL, COMPARE_SQL, select="""SELECT metric, CAST(first_value AS DOUBLE) AS first_value,
  CAST(second_value AS DOUBLE) AS second_value, second_value / first_value AS ratio FROM compared"""),
    doubles=["first_value", "second_value", "ratio"],
)
RICH = ", ".join(f"'{m}'" for m in gr.RICHNESS_METRICS)
REPORTS.add(
    "richness_class",
    lambda s, d: gr.richness_class(gr.compare_captures(capture_measures(s, d), "first", "second")),
    with_tables(pr.PACKETS_SQL, COMPARE_SQL, f"""
r AS (SELECT min(second_value / first_value) FILTER (metric IN ({RICH})) AS min_ratio,
  max(second_value / first_value) FILTER (metric IN ({RICH})) AS max_ratio,
  bool_or(metric = 'sparsity_fraction' AND first_value > 0.99 AND second_value > 0.99) AS both_sparse,
  bool_or(metric = 'max_nodes_per_window' AND first_value <= 10 AND second_value <= 10) AS both_small FROM compared)""",
                select="""SELECT *, CASE WHEN max_ratio < 2.5 AND both_sparse AND both_small THEN 'A'
  WHEN min_ratio >= 3 THEN 'C' ELSE 'B' END AS classification FROM r"""),
    doubles=["min_ratio", "max_ratio"],
)
