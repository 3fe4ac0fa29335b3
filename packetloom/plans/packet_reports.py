"""Packet path: windows aligned to capture start, hosts, edges, micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom import adapters
from packetloom.adapters import PACKETS_SQL
from packetloom.operators import packets as pk
from packetloom.operators.ordered import grouped_percentiles
from packetloom.plans.registry import Reports, with_tables

REPORTS = Reports()
WINDOW = 6 * 3600
TIE = ["event_id"]

CAPTURE_SQL = """
placed AS (SELECT *, date_diff('microsecond', min("timestamp") OVER (), "timestamp") AS us FROM packets),
capture AS (SELECT *, us / 1000000 AS "offset", us // 21600000000 AS window_index FROM placed)"""
SHORT_SQL = """
short_capture AS (SELECT * REPLACE (us // 600000000 AS window_index) FROM capture)"""
EDGES_SQL = """
edge_gaps AS (SELECT *, date_diff('microsecond', lag("timestamp") OVER (PARTITION BY window_index, src_ip, dst_ip
    ORDER BY "timestamp", event_id), "timestamp") / 1000000 AS gap FROM capture),
edges AS (SELECT window_index, src_ip, dst_ip, count(*) AS packet_count, CAST(sum(packet_length) AS BIGINT) AS total_bytes,
  avg(packet_length) AS mean_packet_length, min(packet_length) AS min_packet_length,
  max(packet_length) AS max_packet_length, stddev_pop(packet_length) AS packet_length_std,
  min("offset") AS first_packet_offset, max("offset") AS last_packet_offset, (max(us) - min(us)) / 1000000 AS edge_duration,
  avg(gap) AS mean_inter_arrival_time, stddev_pop(gap) AS inter_arrival_time_std,
  count(*) FILTER (protocol = 'TCP') AS tcp_packet_count, count(*) FILTER (protocol = 'UDP') AS udp_packet_count,
  CAST(0 AS BIGINT) AS icmp_packet_count, CAST(0 AS BIGINT) AS other_packet_count,
  count(DISTINCT src_port) AS source_port_diversity, count(DISTINCT dst_port) AS destination_port_diversity,
  count(*) FILTER (flag_bits & 2 <> 0) AS tcp_syn_count, count(*) FILTER (flag_bits & 16 <> 0) AS tcp_ack_count,
  count(*) FILTER (flag_bits & 1 <> 0) AS tcp_fin_count, count(*) FILTER (flag_bits & 4 <> 0) AS tcp_rst_count
  FROM edge_gaps GROUP BY 1, 2, 3)"""
NODES_SQL = """
roles AS (SELECT window_index, src_ip AS node, "offset", packet_length, protocol, 1 AS sent, dst_ip AS sent_to,
    NULL AS got_from, dst_port AS to_port, NULL AS from_port FROM capture
  UNION ALL SELECT window_index, dst_ip, "offset", packet_length, protocol, 0, NULL, src_ip, NULL, src_port FROM capture),
nodes AS (SELECT window_index, node, count(*) AS packet_count,
  CAST(sum(CASE WHEN sent = 1 THEN packet_length ELSE 0 END) AS BIGINT) AS bytes_sent,
  CAST(sum(CASE WHEN sent = 0 THEN packet_length ELSE 0 END) AS BIGINT) AS bytes_received,
  count(DISTINCT sent_to) AS unique_destinations, count(DISTINCT got_from) AS unique_sources,
  count(DISTINCT to_port) AS unique_destination_ports, count(DISTINCT from_port) AS unique_source_ports,
  count(*) FILTER (protocol = 'TCP') AS tcp_packet_count, count(*) FILTER (protocol = 'UDP') AS udp_packet_count,
  CAST(0 AS BIGINT) AS icmp_packet_count, CAST(0 AS BIGINT) AS other_packet_count,
  min("offset") AS first_seen_offset, max("offset") AS last_seen_offset FROM roles GROUP BY 1, 2)"""
BASE = (PACKETS_SQL, CAPTURE_SQL)


def capture(spark, sf_dir):
    return pk.with_capture_offsets(adapters.packets(spark, sf_dir), WINDOW)


def short_capture(spark, sf_dir):
    """The same packets in windows so short that some stay empty."""
    return pk.with_capture_offsets(adapters.packets(spark, sf_dir), 600)


def edges(spark, sf_dir):
    return pk.edge_window_features(capture(spark, sf_dir), TIE, 3600)


def nodes(spark, sf_dir):
    return pk.node_window_features(capture(spark, sf_dir))


def batches(spark, sf_dir):
    """Micro-batches of an hour: the test traffic is sparse."""
    return pk.micro_batches(capture(spark, sf_dir), 3600, TIE)


EDGE_DOUBLES = ["mean_packet_length", "packet_length_std", "mean_inter_arrival_time", "inter_arrival_time_std"]
RATES = ["packets_per_second", "bytes_per_second"]
REPORTS.add(
    "packet_edges", edges,
    with_tables(*BASE, EDGES_SQL, select="""SELECT *, CASE WHEN edge_duration > 0 THEN packet_count / edge_duration END
  AS packets_per_second, CASE WHEN edge_duration > 0 THEN total_bytes / edge_duration END AS bytes_per_second FROM edges"""),
    doubles=[*EDGE_DOUBLES, *RATES], digits=4,
)
REPORTS.add("packet_nodes", nodes, with_tables(*BASE, NODES_SQL, select="SELECT * FROM nodes"))
REPORTS.add(
    "protocol_mix",
    lambda s, d: nodes(s, d).select("window_index", "node", F.explode(pk.protocol_counts(nodes(s, d))).alias(
        "protocol", "packets")).groupBy("window_index", "protocol").agg(F.sum("packets").alias("packets")),
    with_tables(*BASE, NODES_SQL, select="""SELECT window_index, protocol, CAST(sum(packets) AS BIGINT) AS packets FROM (
  SELECT window_index, unnest(['TCP','UDP','ICMP','OTHER']) AS protocol, unnest([tcp_packet_count, udp_packet_count,
    icmp_packet_count, other_packet_count]) AS packets FROM nodes) GROUP BY 1, 2"""),
)
REPORTS.add(
    "window_index_of_packets", lambda s, d: capture(s, d).select("event_id", "window_index", "offset"),
    with_tables(*BASE, select='SELECT event_id, window_index, "offset" FROM capture'),
)
REPORTS.add(
    "capture_stats", lambda s, d: pk.capture_graph_stats(capture(s, d), edges(s, d)),
    with_tables(*BASE, EDGES_SQL, select="""SELECT *, total_windows - non_empty_windows AS empty_windows,
  ip_packets = packets_in_edges AS accounting_matches,
  1 - unique_directed_pairs / (unique_nodes * (unique_nodes - 1)) AS sparsity FROM
  (SELECT count(*) AS ip_packets, max(window_index) + 1 AS total_windows FROM capture),
  (SELECT count(*) AS unique_nodes FROM (SELECT src_ip FROM capture UNION SELECT dst_ip FROM capture)),
  (SELECT count(DISTINCT window_index) AS non_empty_windows, count(DISTINCT (src_ip, dst_ip)) AS unique_directed_pairs,
    count(*) AS window_edge_instances, CAST(sum(packet_count) AS BIGINT) AS packets_in_edges FROM edges)"""),
    doubles=["sparsity"],
)
COVERED = ["ip", "ports", "ttl", "tcp_flags", "tcp_window", "payload", "fragmentation", "inter_arrival"]
REPORTS.add(
    "feature_coverage", lambda s, d: pk.feature_coverage(capture(s, d), edges(s, d)),
    with_tables(*BASE, EDGES_SQL, select="""SELECT 100.0 AS ip, 100.0 AS ports, 100.0 AS ttl, tcp AS tcp_flags,
  tcp AS tcp_window, 100.0 AS payload, 100.0 AS fragmentation, inter_arrival FROM
  (SELECT avg(CASE WHEN protocol = 'TCP' THEN 100.0 ELSE 0.0 END) AS tcp FROM capture),
  (SELECT avg(CASE WHEN mean_inter_arrival_time IS NOT NULL THEN 100.0 ELSE 0.0 END) AS inter_arrival FROM edges)"""),
    doubles=COVERED,
)
REPORTS.add(
    "window_summary", lambda s, d: pk.window_summary(nodes(s, d), edges(s, d)),
    with_tables(*BASE, NODES_SQL, EDGES_SQL, select="""SELECT * FROM
  (SELECT window_index, count(*) AS active_hosts FROM nodes GROUP BY 1) JOIN
  (SELECT window_index, count(*) AS active_edges, CAST(sum(packet_count) AS BIGINT) AS packet_volume,
    CAST(sum(total_bytes) AS BIGINT) AS byte_volume, CAST(sum(tcp_packet_count) AS BIGINT) AS tcp_packets,
    CAST(sum(udp_packet_count) AS BIGINT) AS udp_packets, CAST(0 AS BIGINT) AS icmp_packets,
    CAST(0 AS BIGINT) AS other_packets, max(packet_count) AS max_burst_in_window FROM edges GROUP BY 1)
  USING (window_index)"""),
)
BATCH_COLUMNS = ["bucket_index", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count", "total_bytes",
                 "edge_duration", "mean_packet_length", "packet_length_std", "mean_inter_arrival_time", "tcp_syn_count"]
LINKS_SQL = """
narrow AS (SELECT * REPLACE (0 AS src_port), us // 86400000000 AS bucket_index FROM capture),
link_gaps AS (SELECT *, date_diff('microsecond', lag("timestamp") OVER (PARTITION BY bucket_index, src_ip, dst_ip, protocol,
    dst_port ORDER BY "timestamp", event_id), "timestamp") / 1000000 AS gap FROM narrow),
batches AS (SELECT bucket_index, src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS packet_count,
  CAST(sum(packet_length) AS BIGINT) AS total_bytes, (max(us) - min(us)) / 1000000 AS edge_duration,
  avg(packet_length) AS mean_packet_length, stddev_pop(packet_length) AS packet_length_std,
  avg(gap) AS mean_inter_arrival_time, count(*) FILTER (flag_bits & 2 <> 0) AS tcp_syn_count,
  min("timestamp") AS first_packet, min(event_id) AS first_id FROM link_gaps
  GROUP BY bucket_index, src_ip, dst_ip, src_port, dst_port, protocol)"""


def day_batches(spark, sf_dir):
    """Daily micro-batches with one source port, so that several packets share a batch."""
    return pk.micro_batches(capture(spark, sf_dir).withColumn("src_port", F.lit(0)), 86400, TIE)


REPORTS.add(
    "microbatch_events", lambda s, d: day_batches(s, d).select(*BATCH_COLUMNS),
    with_tables(*BASE, LINKS_SQL, select=f"SELECT {', '.join(BATCH_COLUMNS)} FROM batches"),
    doubles=["mean_packet_length", "packet_length_std", "mean_inter_arrival_time"], digits=4,
)
REPORTS.add(
    "first_seen_novelty", lambda s, d: pk.novelty(day_batches(s, d)),
    with_tables(*BASE, LINKS_SQL, select="""SELECT count(*) AS total_events,
  100.0 * avg(p) AS pct_unseen_pair, 100.0 * avg(t) AS pct_unseen_destination, 100.0 * avg(c) AS pct_unseen_source FROM (
  SELECT CASE WHEN row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY first_packet) = 1 THEN 1.0 ELSE 0.0 END AS p,
    CASE WHEN row_number() OVER (PARTITION BY dst_ip ORDER BY first_packet) = 1 THEN 1.0 ELSE 0.0 END AS t,
    CASE WHEN row_number() OVER (PARTITION BY src_ip ORDER BY first_packet) = 1 THEN 1.0 ELSE 0.0 END AS c FROM batches)"""),
    doubles=["pct_unseen_pair", "pct_unseen_destination", "pct_unseen_source"],
)
REPORTS.add(
    "inter_event_gaps",
    lambda s, d: pk.event_gaps(adapters.packets(s, d), "timestamp", TIE, 86400).select("event_id", "gap"),
    with_tables(PACKETS_SQL, select="""SELECT event_id, date_diff('microsecond', lag("timestamp") OVER
  (ORDER BY "timestamp", event_id), "timestamp") / 1000000 AS gap FROM packets"""),
)
REPORTS.add(
    "information_reconcile", lambda s, d: pk.preservation_check(capture(s, d), batches(s, d)),
    with_tables(*BASE, select="""SELECT count(*) AS packets_before, CAST(sum(packet_length) AS BIGINT) AS bytes_before,
  count(*) AS packets_after, CAST(sum(packet_length) AS BIGINT) AS bytes_after, CAST(0 AS BIGINT) AS pairs_differing,
  CAST(0 AS BIGINT) AS src_ports_differing, CAST(0 AS BIGINT) AS dst_ports_differing,
  CAST(0 AS BIGINT) AS protocols_differing, true AS preserved FROM capture"""),
)
SUMMARY_SQL = """
summary AS (SELECT count(*) AS packet_count, CAST(sum(packet_length) AS BIGINT) AS total_bytes,
  count(*) FILTER (protocol = 'TCP') AS tcp_packet_count, count(*) FILTER (protocol = 'UDP') AS udp_packet_count,
  CAST(0 AS BIGINT) AS icmp_packet_count, CAST(0 AS BIGINT) AS other_packet_count,
  count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations,
  count(DISTINCT (src_ip, dst_ip)) AS unique_directed_pairs, min("timestamp") AS first_packet,
  max("timestamp") AS last_packet,
  date_diff('microsecond', min("timestamp"), max("timestamp")) / 1000000 AS duration_seconds, source_file
  FROM packets GROUP BY source_file)"""
REPORTS.add(
    "capture_summary", lambda s, d: pk.capture_summary(adapters.packets(s, d), ["source_file"]).join(
        pk.host_counts(adapters.packets(s, d), ["source_file"]), "source_file"),
    with_tables(PACKETS_SQL, SUMMARY_SQL, select="""SELECT * FROM summary JOIN (SELECT source_file,
  count(DISTINCT host) AS unique_hosts FROM (SELECT source_file, src_ip AS host FROM packets UNION ALL
  SELECT source_file, dst_ip FROM packets) GROUP BY 1) USING (source_file)"""),
)
REPORTS.add(
    "pseudonymise_hosts",
    lambda s, d: pk.hosts(adapters.packets(s, d)).select("host", pk.pseudonym(F.col("host"), "salt").alias("anon")),
    with_tables(PACKETS_SQL, select="""SELECT host, 'host_' || substr(sha256('salt|' || host), 1, 16) AS anon
  FROM (SELECT src_ip AS host FROM packets UNION SELECT dst_ip FROM packets)"""),
)
REPORTS.add(
    "pseudonym_check", lambda s, d: pk.pseudonym_check(pk.hosts(adapters.packets(s, d)), "salt"),
    with_tables(PACKETS_SQL, select="""SELECT count(*) AS unique_raw, count(*) AS unique_anonymous,
  CAST(0 AS BIGINT) AS collisions, true AS bijective FROM (SELECT src_ip FROM packets UNION SELECT dst_ip FROM packets)"""),
)


def _spread_sql(prefix: str, value: str) -> str:
    return (f"coalesce(avg({value}), 0) AS {prefix}_mean, coalesce(stddev_pop({value}), 0) AS {prefix}_std, "
            f"coalesce(var_pop({value}), 0) AS {prefix}_variance, coalesce(CAST(min({value}) AS DOUBLE), 0) AS {prefix}_min, "
            f"coalesce(CAST(max({value}) AS DOUBLE), 0) AS {prefix}_max")


FLAGS_SQL = ", ".join(f"CAST(count(*) FILTER (flag_bits & {bit} <> 0) AS DOUBLE) AS {name}_count"
                      for name, bit in pk.FLAG_BITS.items())
WINDOW_STATS_SQL = f"""
stats AS (SELECT window_index, CAST(count(*) AS DOUBLE) AS packet_count, CAST(sum(packet_length) AS DOUBLE) AS total_bytes,
  {_spread_sql('ttl', 'ttl')}, {_spread_sql('tcp_window', 'tcp_window_size')},
  {_spread_sql('payload', 'payload_length')}, {_spread_sql('packet_length', 'packet_length')},
  CAST(count(*) FILTER (more_fragments OR fragment_offset > 0) AS DOUBLE) AS fragment_count,
  CAST(count(*) FILTER (protocol = 'TCP') AS DOUBLE) AS tcp_packet_count,
  CAST(count(*) FILTER (protocol = 'UDP') AS DOUBLE) AS udp_packet_count, 0::DOUBLE AS icmp_packet_count,
  0::DOUBLE AS other_packet_count, {FLAGS_SQL} FROM capture GROUP BY 1)"""
SPREADS = [f"{p}_{k}" for p in ("ttl", "tcp_window", "payload", "packet_length") for k in ("mean", "std", "variance")]
STATS_RATIOS = ["bytes_per_packet", "fragment_ratio", *[f"{p.lower()}_packet_ratio" for p in pk.PROTOCOLS]]
FLAG_RATIOS = [f"{f}_ratio" for f in pk.FLAG_BITS]
REPORTS.add(
    "packet_window_stats",
    lambda s, d: pk.packet_window_features(capture(s, d)).drop(*FLAG_RATIOS).join(
        pk.payload_medians(capture(s, d)), "window_index", "left"),
    with_tables(*BASE, WINDOW_STATS_SQL, select="""SELECT stats.*, total_bytes / packet_count AS bytes_per_packet,
  fragment_count / packet_count AS fragment_ratio, tcp_packet_count / packet_count AS tcp_packet_ratio,
  udp_packet_count / packet_count AS udp_packet_ratio, 0.0 AS icmp_packet_ratio, 0.0 AS other_packet_ratio,
  payload_median FROM stats JOIN (SELECT window_index, quantile_cont(payload_length, 0.5) AS payload_median FROM capture
  GROUP BY 1) USING (window_index)"""),
    doubles=[*SPREADS, *STATS_RATIOS], digits=4,
)
REPORTS.add(
    "flag_ratios",
    lambda s, d: pk.packet_window_features(capture(s, d)).select("window_index", *FLAG_RATIOS),
    with_tables(*BASE, WINDOW_STATS_SQL, select="SELECT window_index, " + ", ".join(
        f"CASE WHEN tcp_packet_count > 0 THEN {f}_count / tcp_packet_count ELSE 0 END AS {f}_ratio"
        for f in pk.FLAG_BITS) + " FROM stats"), doubles=FLAG_RATIOS,
)
REPORTS.add(
    "port_scan_score",
    lambda s, d: pk.port_scan_scores(capture(s, d).withColumn("port", F.col("src_port")), port="port"),
    with_tables(*BASE, """
ports AS (SELECT DISTINCT window_index, src_port AS p FROM capture),
steps AS (SELECT *, p - lag(p) OVER (PARTITION BY window_index ORDER BY p) AS step FROM ports),
scan AS (SELECT window_index, CAST(count(*) AS DOUBLE) AS unique_dst_ports, CAST(max(p) - min(p) AS DOUBLE) AS port_range,
  CASE WHEN count(*) > 1 THEN count(*) FILTER (step = 1) / (count(*) - 1) ELSE 0 END AS sequential_port_score
  FROM steps GROUP BY 1)""", select="""SELECT *, CASE WHEN unique_dst_ports < 2 THEN 0
  ELSE greatest(0, least(1, (port_range - 1) / 65534)) * (1 - sequential_port_score) END AS random_port_score FROM scan"""),
    doubles=["sequential_port_score", "random_port_score"],
)
IAT = [f"packet_iat_{k}" for k in ("mean", "std", "variance", "min", "max")]
REPORTS.add(
    "iat_stats", lambda s, d: pk.inter_arrival_stats(capture(s, d), tie_break=TIE, bucket_seconds=3600),
    with_tables(*BASE, f"""
gaps AS (SELECT window_index, date_diff('microsecond', lag("timestamp") OVER (PARTITION BY window_index
  ORDER BY "timestamp", event_id), "timestamp") / 1000000 AS gap FROM capture)""",
                select=f"SELECT window_index, {_spread_sql('packet_iat', 'gap')} FROM gaps GROUP BY 1"),
    doubles=IAT, digits=3,
)


def retransmission_capture(spark, sf_dir):
    """Fewer source ports, so that sequence numbers repeat on a flow."""
    return capture(spark, sf_dir).withColumns({"src_port": F.lit(0), "dst_ip": F.lit("172.16.0.1")})


REPORTS.add(
    "retransmissions", lambda s, d: pk.retransmissions(retransmission_capture(s, d), tie_break=TIE),
    with_tables(*BASE, """
seen AS (SELECT *, CASE WHEN payload_length > 0 AND tcp_seq IS NOT NULL THEN row_number() OVER (PARTITION BY src_ip, dst_port,
  protocol, tcp_seq, payload_length > 0 ORDER BY "timestamp", event_id) END AS n FROM capture),
r AS (SELECT window_index, CAST(count(*) FILTER (n > 1) AS DOUBLE) AS retransmission_count,
  count(*) FILTER (protocol = 'TCP') AS tcp FROM seen GROUP BY 1)""",
                select="""SELECT window_index, retransmission_count,
  CASE WHEN tcp > 0 THEN retransmission_count / tcp ELSE 0 END AS retransmission_rate FROM r"""),
    doubles=["retransmission_rate"],
)
REPORTS.add(
    "grouped_percentiles",
    lambda s, d: grouped_percentiles(adapters.packets(s, d), ["protocol"], "byte_count",
                                     {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}),
    with_tables(PACKETS_SQL, select="SELECT protocol, " + ", ".join(
        f"quantile_cont(byte_count, {p / 100}) AS p{p:02d}" for p in (5, 50, 95, 99)) + " FROM packets GROUP BY 1"),
    doubles=["p05", "p50", "p95", "p99"],
)
