"""Bindings of the bundled test tables to the telemetry roles the operators expect.

``events`` becomes packets (with attack labels), ``lineitem`` becomes supplier -> part flows,
``orders``/``customer``/``supplier`` become a nation graph, ``documents`` become log messages and
``embeddings`` become state vectors. Byte counts are hundredths of ``value`` so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.ordered import beside

# Event type -> destination port, TCP flag bits, flag text.
EVENT_PORTS = {"click": 443, "view": 80, "purchase": 8443, "signup": 21, "error": 22}
EVENT_FLAG_BITS = {"click": 2, "purchase": 18, "error": 20}
EVENT_FLAG_TEXT = {"click": "S", "purchase": "SA", "error": "RA"}
# Attack label by user_id modulo 4.
ATTACK_LABELS = ["FTP-BruteForce", "Bot", "Infiltration", "DoS attacks-Hulk"]
ATTACK_VALUE = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(column: Column, values: dict) -> Column:
    chain = None
    for key, value in values.items():
        chain = F.when(column == key, value) if chain is None else chain.when(column == key, value)
    return chain


def event_number() -> Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("long")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical packet table with packet-level extras and the attack label."""
    events = table(spark, sf_dir, "events")
    k = event_number()
    tcp = F.col("event_type").isin("click", "purchase", "error")
    attack = (F.col("event_type") == "error") & (F.col("value") > ATTACK_VALUE)
    label = _lookup(F.col("user_id") % 4, dict(enumerate(ATTACK_LABELS)))
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."),
                 (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        F.concat(F.lit("172.16.0."), (k % 16).cast("string")).alias("dst_ip"),
        (F.lit(40000) + F.col("event_id") % 1000).alias("src_port"),
        _lookup(F.col("event_type"), EVENT_PORTS).cast("long").alias("dst_port"),
        F.when(tcp, "TCP").otherwise("UDP").alias("protocol"),
        F.lit(1).cast("long").alias("packet_count"),
        F.round(F.col("value") * 100).alias("byte_count"),
        F.lit(0.0).alias("duration"),
        _lookup(F.col("event_type"), EVENT_FLAG_TEXT).alias("tcp_flags"),
        _lookup(F.col("event_type"), EVENT_FLAG_BITS).cast("long").alias("flag_bits"),
        (F.lit(48) + k % 17).alias("ttl"),
        F.when(tcp, F.lit(1024) + k * 8).alias("tcp_window_size"),
        F.lit("events").alias("source_type"),
        (F.lit(40) + F.floor(F.col("value"))).cast("long").alias("packet_length"),
        F.floor("value").cast("long").alias("payload_length"),
        F.when(tcp, k).alias("tcp_seq"),
        (k % 13 == 0).alias("more_fragments"),
        F.when(k % 17 == 0, 8).otherwise(0).cast("long").alias("fragment_offset"),
        F.concat(F.lit("site-"), (F.col("user_id") % 4).cast("string")).alias("source_file"),
        F.when(attack, label).otherwise("Benign").alias("label"),
    )


PACKETS_SQL = """
packets AS (
  SELECT event_id, ts AS "timestamp",
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
    '172.16.0.' || (k % 16) AS dst_ip,
    40000 + event_id % 1000 AS src_port,
    CAST(CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'purchase' THEN 8443
         WHEN 'signup' THEN 21 ELSE 22 END AS BIGINT) AS dst_port,
    CASE WHEN event_type IN ('click','purchase','error') THEN 'TCP' ELSE 'UDP' END AS protocol,
    CAST(1 AS BIGINT) AS packet_count, round(value * 100) AS byte_count, 0.0 AS duration,
    CASE event_type WHEN 'click' THEN 'S' WHEN 'purchase' THEN 'SA' WHEN 'error' THEN 'RA' END AS tcp_flags,
    CAST(CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 18 WHEN 'error' THEN 20 END AS BIGINT) AS flag_bits,
    48 + k % 17 AS ttl,
    CASE WHEN event_type IN ('click','purchase','error') THEN 1024 + k * 8 END AS tcp_window_size,
    'events' AS source_type,
    CAST(40 + floor(value) AS BIGINT) AS packet_length, CAST(floor(value) AS BIGINT) AS payload_length,
    CASE WHEN event_type IN ('click','purchase','error') THEN k END AS tcp_seq,
    k % 13 = 0 AS more_fragments, CAST(CASE WHEN k % 17 = 0 THEN 8 ELSE 0 END AS BIGINT) AS fragment_offset,
    'site-' || (user_id % 4) AS source_file,
    CASE WHEN event_type = 'error' AND value > 150 THEN
      CASE user_id % 4 WHEN 0 THEN 'FTP-BruteForce' WHEN 1 THEN 'Bot' WHEN 2 THEN 'Infiltration'
           ELSE 'DoS attacks-Hulk' END ELSE 'Benign' END AS label
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events))"""


def peer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User -> user edges of every event; users are the nodes, so the graph grows with the table."""
    events = table(spark, sf_dir, "events")
    counted = beside(events.select("user_id", event_number().alias("k")), events.agg((F.max("user_id") + 1).alias("users")))
    return (
        counted.select(F.col("user_id").alias("src"), ((F.col("user_id") * 7 + F.col("k")) % F.col("users")).alias("dst"))
        .groupBy("src", "dst").agg(F.count("*").alias("weight"))
    )


PEER_EDGES_SQL = """
peer_edges AS (
  SELECT user_id AS src, (user_id * 7 + CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT))
      % (SELECT max(user_id) + 1 FROM events) AS dst, count(*) AS weight
  FROM events GROUP BY 1, 2)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows: one score and label per event, split by time."""
    events = table(spark, sf_dir, "events")
    k = event_number()
    return events.select(
        "event_id",
        F.concat(F.lit("site-"), (F.col("user_id") % 4).cast("string")).alias("source_file"),
        F.col("ts").alias("window_start"),
        F.when(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz"), "train")
         .when(F.col("ts") < F.lit("2024-01-26").cast("timestamp_ntz"), "validation").otherwise("test").alias("split"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("label"),
        ((F.round(F.col("value") * 100).cast("long") * 13 + F.when(k % 5 == 0, F.col("event_id") % 2 * 333).otherwise(0) + k)
         % F.when(k % 5 == 0, 1000).otherwise(800) / 1000).alias("score"),
    )


SCORES_SQL = """
scores AS (
  SELECT event_id, 'site-' || (user_id % 4) AS source_file, ts AS window_start,
    CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'train' WHEN ts < TIMESTAMP '2024-01-26' THEN 'validation' ELSE 'test' END AS split,
    CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS label,
    (CAST(round(value * 100) AS BIGINT) * 13 + CASE WHEN k % 5 = 0 THEN event_id % 2 * 333 ELSE 0 END + k)
      % CASE WHEN k % 5 = 0 THEN 1000 ELSE 800 END / 1000 AS score
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events))"""
