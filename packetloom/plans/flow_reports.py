"""Event path: packets -> flows -> window states, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import adapters
from packetloom.adapters import PACKETS_SQL
from packetloom.operators import flows as fl
from packetloom.operators import windows as wn
from packetloom.plans.registry import Reports, with_tables

REPORTS = Reports()
KEYS = ["src_ip"]
TIMEOUT = 6 * 3600
HOUR = 3600

SEGMENTS_SQL = """
gaps AS (SELECT *, date_sub('second', lag("timestamp") OVER w, "timestamp") AS gap
  FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY "timestamp", event_id)),
segments AS (SELECT *, CAST(sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER
    (PARTITION BY src_ip ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow_segment
  FROM gaps)"""

# The endpoint columns a flow needs beyond its key are taken from its first packet.
FLOWS_SQL = """
base_flows AS (
  SELECT src_ip, flow_segment, min("timestamp") AS flow_start, max("timestamp") AS flow_end,
    CAST(sum(packet_count) AS BIGINT) AS packet_count, sum(byte_count) AS byte_count,
    avg(byte_count) AS packet_size_mean, quantile_cont(byte_count, 0.5) AS packet_size_median,
    coalesce(stddev_samp(byte_count), 0) AS packet_size_std, min(byte_count) AS packet_size_min,
    max(byte_count) AS packet_size_max, avg(ttl) AS ttl_mean, coalesce(stddev_samp(ttl), 0) AS ttl_std,
    avg(tcp_window_size) AS tcp_window_mean, coalesce(stddev_samp(tcp_window_size), 0) AS tcp_window_std,
    count(DISTINCT tcp_flags) AS unique_tcp_flags, arg_min(source_type, "timestamp") AS source_type,
    arg_min(dst_ip, "timestamp") AS dst_ip, arg_min(src_port, "timestamp") AS src_port,
    arg_min(dst_port, "timestamp") AS dst_port, arg_min(protocol, "timestamp") AS protocol
  FROM segments GROUP BY src_ip, flow_segment),
flows AS (
  SELECT *, date_diff('microsecond', flow_start, flow_end) / 1000000 AS flow_duration_seconds,
    CASE WHEN flow_end > flow_start THEN packet_count / (date_diff('microsecond', flow_start, flow_end) / 1000000)
      ELSE packet_count END AS packets_per_second,
    CASE WHEN flow_end > flow_start THEN byte_count / (date_diff('microsecond', flow_start, flow_end) / 1000000)
      ELSE byte_count END AS bytes_per_second
  FROM base_flows)"""

DIRECTIONAL_SQL = """
directional AS (SELECT f.*, s.* EXCLUDE (src_ip), d.* EXCLUDE (dst_ip) FROM flows f
  LEFT JOIN (SELECT src_ip, count(DISTINCT dst_ip) AS src_unique_destinations,
      count(DISTINCT dst_port) AS src_unique_destination_ports, count(DISTINCT src_port) AS src_unique_source_ports,
      count(*) AS src_flow_count, sum(byte_count) AS src_total_bytes FROM flows GROUP BY src_ip) s USING (src_ip)
  LEFT JOIN (SELECT dst_ip, count(DISTINCT src_ip) AS dst_unique_sources, count(DISTINCT dst_port) AS dst_unique_ports,
      count(*) AS dst_flow_count, sum(byte_count) AS dst_total_bytes FROM flows GROUP BY dst_ip) d USING (dst_ip))"""

STATES_SQL = """
states AS (
  SELECT time_bucket(INTERVAL 1 HOUR, flow_start) AS window_start, count(*) AS flow_count,
    count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations,
    count(DISTINCT src_port) AS unique_source_ports, count(DISTINCT dst_port) AS unique_destination_ports,
    count(DISTINCT protocol) AS unique_protocols, CAST(sum(packet_count) AS BIGINT) AS total_packets,
    sum(byte_count) AS total_bytes, coalesce(avg(flow_duration_seconds), 0) AS mean_flow_duration,
    coalesce(stddev_samp(flow_duration_seconds), 0) AS std_flow_duration,
    coalesce(avg(packet_size_mean), 0) AS mean_packet_size, coalesce(avg(packets_per_second), 0) AS mean_packet_rate,
    coalesce(avg(bytes_per_second), 0) AS mean_byte_rate
  FROM flows GROUP BY 1)"""

BASE = (PACKETS_SQL, SEGMENTS_SQL, FLOWS_SQL)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = fl.prepare_events(adapters.packets(spark, sf_dir))
    return fl.segment_flows(packets, KEYS, "timestamp", ["event_id"], TIMEOUT, bucket_seconds=86400)


def source_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows keyed by source; the other endpoint columns come from the first packet."""
    packets = fl.prepare_events(adapters.packets(spark, sf_dir))
    return fl.session_flows(packets, KEYS, "timestamp", TIMEOUT,
                            ("source_type", "dst_ip", "src_port", "dst_port", "protocol"))


def full_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered flows with the exact median packet size."""
    segmented = fl.numbered_packets(segments(spark, sf_dir), KEYS)
    return fl.aggregate_flows(segmented, KEYS).join(fl.flow_medians(segmented, KEYS), [*KEYS, "flow_segment"])


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.window_states(source_flows(spark, sf_dir), HOUR)


FLOW_DOUBLES = ["packet_size_mean", "packet_size_median", "packet_size_std", "ttl_mean", "ttl_std",
                "tcp_window_mean", "tcp_window_std", "packets_per_second", "bytes_per_second"]
STATE_DOUBLES = ["mean_flow_duration", "std_flow_duration", "mean_packet_size", "mean_packet_rate", "mean_byte_rate"]

REPORTS.add(
    "flow_segments",
    lambda s, d: segments(s, d).select("event_id", "src_ip", F.col("flow_segment").cast("long").alias("flow_segment")),
    with_tables(PACKETS_SQL, SEGMENTS_SQL, select="SELECT event_id, src_ip, flow_segment FROM segments"),
)
REPORTS.add(
    "flow_features",
    full_flows,
    with_tables(*BASE, select="SELECT * EXCLUDE (dst_ip, src_port, dst_port, protocol) FROM flows"),
    doubles=FLOW_DOUBLES, digits=4,
)
DIRECTIONAL = ["src_ip", "flow_start", "dst_ip", "src_unique_destinations", "src_unique_destination_ports",
               "src_unique_source_ports", "src_flow_count", "src_total_bytes", "dst_unique_sources",
               "dst_unique_ports", "dst_flow_count", "dst_total_bytes"]
REPORTS.add(
    "flow_directional",
    lambda s, d: fl.add_directional_features(source_flows(s, d)).select(*DIRECTIONAL),
    with_tables(*BASE, DIRECTIONAL_SQL, select=f"SELECT {', '.join(DIRECTIONAL)} FROM directional"),
)
REPORTS.add(
    "flow_source_features", lambda s, d: fl.source_features(source_flows(s, d)),
    with_tables(*BASE, DIRECTIONAL_SQL, select="""SELECT DISTINCT src_ip, src_unique_destinations,
  src_unique_destination_ports, src_unique_source_ports, src_flow_count, src_total_bytes FROM directional"""),
)
REPORTS.add(
    "flow_destination_features", lambda s, d: fl.destination_features(source_flows(s, d)),
    with_tables(*BASE, DIRECTIONAL_SQL, select="""SELECT DISTINCT dst_ip, dst_unique_sources, dst_unique_ports,
  dst_flow_count, dst_total_bytes FROM directional"""),
)
REPORTS.add(
    "flow_ratios",
    lambda s, d: fl.add_ratio_features(fl.add_directional_features(source_flows(s, d))).select(
        "src_ip", "flow_start", "bytes_per_packet", "src_average_bytes_per_flow", "dst_average_bytes_per_flow"),
    with_tables(*BASE, DIRECTIONAL_SQL, select="""SELECT src_ip, flow_start,
  byte_count / packet_count AS bytes_per_packet, src_total_bytes / src_flow_count AS src_average_bytes_per_flow,
  dst_total_bytes / dst_flow_count AS dst_average_bytes_per_flow FROM directional"""),
    doubles=["bytes_per_packet", "src_average_bytes_per_flow", "dst_average_bytes_per_flow"],
)
REPORTS.add(
    "flow_five_tuple",
    lambda s, d: fl.build_flows(adapters.packets(s, d).withColumn("src_port", F.lit(40000)), timeout_seconds=TIMEOUT,
                                tie_break=["event_id"], bucket_seconds=86400).select(
        "src_ip", "dst_ip", "dst_port", "flow_start", "flow_end", "packet_count", "byte_count",
        "src_flow_count", "dst_flow_count", "bytes_per_packet"),
    with_tables(PACKETS_SQL, """
gaps AS (SELECT *, date_sub('second', lag("timestamp") OVER w, "timestamp") AS gap FROM packets
  WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port ORDER BY "timestamp", event_id)),
segments AS (SELECT *, sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, dst_ip, dst_port
  ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS seg FROM gaps),
f AS (SELECT src_ip, dst_ip, dst_port, min("timestamp") AS flow_start, max("timestamp") AS flow_end,
  CAST(sum(packet_count) AS BIGINT) AS packet_count, sum(byte_count) AS byte_count
  FROM segments GROUP BY src_ip, dst_ip, dst_port, protocol, seg)""",
                select="""SELECT *, count(*) OVER (PARTITION BY src_ip) AS src_flow_count,
  count(*) OVER (PARTITION BY dst_ip) AS dst_flow_count, byte_count / packet_count AS bytes_per_packet FROM f"""),
    doubles=["bytes_per_packet"],
)
REPORTS.add(
    "complete_events",
    lambda s, d: fl.complete_events(
        fl.require_columns(adapters.packets(s, d), ["event_id", "src_ip"]).withColumns({
            "src_ip": F.when(F.col("event_id") % 3 > 0, F.col("src_ip")),
            "dst_ip": F.when(F.col("event_id") % 5 > 0, F.col("dst_ip")),
            "src_port": F.when(F.col("event_id") % 7 > 0, F.col("src_port")),
            "ttl": F.when(F.col("event_id") % 4 > 0, F.col("ttl"))}), "event_id",
    ).select("event_id", "src_ip", "dst_ip", "src_port", "packet_count", "byte_count", "tcp_flags", "ttl",
             "tcp_window_size"),
    with_tables(PACKETS_SQL, select="""SELECT event_id,
  CASE WHEN event_id % 3 > 0 THEN src_ip ELSE '192.168.1.' || (event_id % 20 + 10) END AS src_ip,
  CASE WHEN event_id % 5 > 0 THEN dst_ip ELSE '192.168.1.24' END AS dst_ip,
  CASE WHEN event_id % 7 > 0 THEN src_port ELSE 40000 + event_id % 1000 END AS src_port, packet_count, byte_count,
  coalesce(tcp_flags, '') AS tcp_flags, CASE WHEN event_id % 4 > 0 THEN ttl ELSE 64 END AS ttl,
  coalesce(tcp_window_size, 0) AS tcp_window_size FROM packets"""),
)
REPORTS.add(
    "prepare_events",
    lambda s, d: fl.prepare_events(adapters.packets(s, d).select(
        "event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("packet_count").cast("string")).alias("packet_count"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("byte_count").cast("string")).alias("byte_count"),
    )).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")),
    with_tables(PACKETS_SQL, select="""SELECT event_id, date_trunc('second', "timestamp") AS "timestamp",
  CAST(1 AS BIGINT) AS packet_count, CASE WHEN event_id % 4 = 0 THEN 0 ELSE byte_count END AS byte_count
  FROM packets"""),
)
STATE_BASE = ["window_start", "flow_count", "unique_sources", "unique_destinations", "unique_source_ports",
              "unique_destination_ports", "unique_protocols", "total_packets", "total_bytes", *STATE_DOUBLES]
REPORTS.add(
    "window_state", lambda s, d: states(s, d).select(*STATE_BASE),
    with_tables(*BASE, STATES_SQL, select="SELECT * FROM states"), doubles=STATE_DOUBLES, digits=4,
)
RATES = ["packets_per_window_second", "bytes_per_window_second", "average_packets_per_flow", "average_bytes_per_flow"]
REPORTS.add(
    "window_rates", lambda s, d: states(s, d).select("window_start", *RATES),
    with_tables(*BASE, STATES_SQL, select="""SELECT window_start, total_packets / 3600 AS packets_per_window_second,
  total_bytes / 3600 AS bytes_per_window_second, total_packets / flow_count AS average_packets_per_flow,
  total_bytes / flow_count AS average_bytes_per_flow FROM states"""), doubles=RATES,
)
REPORTS.add(
    "window_diversity",
    lambda s, d: states(s, d).select("window_start", "destination_diversity", "port_diversity", "source_diversity"),
    with_tables(*BASE, STATES_SQL, select="""SELECT window_start, unique_destinations AS destination_diversity,
  unique_destination_ports AS port_diversity, unique_sources AS source_diversity FROM states"""),
)


def _rolling_sql() -> tuple[str, list[str]]:
    picks, names = [], []
    for c in wn.TREND_COLUMNS:
        for n in wn.ROLLING_LENGTHS:
            frame = f"OVER (ORDER BY window_start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            picks += [f"avg({c}) {frame} AS {c}_rolling_mean_{n}",
                      f"coalesce(stddev_samp({c}) {frame}, 0) AS {c}_rolling_std_{n}"]
            names += [f"{c}_rolling_mean_{n}", f"{c}_rolling_std_{n}"]
    return with_tables(*BASE, STATES_SQL, select=f"SELECT window_start, {', '.join(picks)} FROM states"), names


ROLLING_SQL, ROLLING_NAMES = _rolling_sql()
REPORTS.add(
    "window_rolling",
    lambda s, d: wn.add_trend_features(states(s, d), change=False).select("window_start", *ROLLING_NAMES),
    ROLLING_SQL, doubles=ROLLING_NAMES, digits=4,
)
CHANGES = [f"{c}_{kind}" for c in wn.TREND_COLUMNS for kind in ("change", "pct_change")]
REPORTS.add(
    "window_change",
    lambda s, d: wn.add_trend_features(states(s, d), rolling=False).select("window_start", *CHANGES),
    with_tables(*BASE, STATES_SQL, select="SELECT window_start, " + ", ".join(
        f"coalesce({c} - lag({c}) OVER w, 0) AS {c}_change, "
        f"coalesce(({c} - lag({c}) OVER w) / lag({c}) OVER w, 0) AS {c}_pct_change" for c in wn.TREND_COLUMNS)
        + " FROM states WINDOW w AS (ORDER BY window_start)"),
    doubles=[f"{c}_pct_change" for c in wn.TREND_COLUMNS],
)
REPORTS.add(
    "generic_sequences",
    lambda s, d: wn.create_sequences(states(s, d), ["flow_count", "total_bytes"], 4, 2).select(
        "window_start", "target_window_start",
        F.transform("history", lambda v: v[0])[0].alias("oldest_flow_count"),
        F.aggregate("history", F.lit(0.0), lambda a, v: a + v[1]).alias("history_bytes"),
        F.col("target")[0].alias("target_flow_count"), F.col("target")[1].alias("target_bytes")),
    with_tables(*BASE, STATES_SQL, select="""SELECT * FROM (SELECT window_start,
  lead(window_start, 2) OVER w AS target_window_start, CAST(lag(flow_count, 3) OVER w AS DOUBLE) AS oldest_flow_count,
  sum(total_bytes) OVER (ORDER BY window_start ROWS 3 PRECEDING) AS history_bytes,
  CAST(lead(flow_count, 2) OVER w AS DOUBLE) AS target_flow_count, lead(total_bytes, 2) OVER w AS target_bytes
  FROM states WINDOW w AS (ORDER BY window_start))
  WHERE oldest_flow_count IS NOT NULL AND target_window_start IS NOT NULL"""),
)
