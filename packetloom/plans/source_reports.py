"""Source, sink and streaming reports. Files they exchange live in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import adapters
from packetloom.adapters import PACKETS_SQL
from packetloom.functions.timefmt import DAY_FIRST
from packetloom.operators import alerts as al
from packetloom.plans import dataset_reports as dr
from packetloom.plans import label_reports as lr
from packetloom.plans.registry import Reports, with_tables
from packetloom.session import checkpoint_dir, cut_lineage
from packetloom.sources import capture as cp
from packetloom.sources import capture_ranges as cr
from packetloom.sources import flow_csv as fc
from packetloom.sources import sinks as sk
from packetloom.sources import zeek as zk
from packetloom.streaming import jobs as st

REPORTS = Reports()


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/reports-{uuid.uuid4().hex}"


def csv_rows(s, d) -> DataFrame:
    """Packets under the headers of a flow exporter, two defects included."""
    return adapters.packets(s, d).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"), F.col("src_ip").alias("Source IP"),
        F.col("dst_ip").alias("Destination_IP"), F.col("src_port").alias("Source Port"), F.col("dst_port").alias("Dst Port"),
        F.col("protocol").alias("Protocol"), F.when(F.col("event_id") % 9 == 0, "n/a").otherwise("1").alias("Tot Fwd Pkts"),
        F.lit("2").alias("Tot Bwd Pkts"), F.col("byte_count").cast("string").alias("TotLen Fwd Pkts"),
        F.lit("0").alias("TotLen Bwd Pkts"), F.col("ttl").alias("TTL"), F.col("event_id").alias("Row"), F.col("label").alias("Label"))


def events_csv(s, d):
    path = scratch(s)
    csv_rows(s, d).write.csv(path, header=True)
    return fc.read_events_csv(s, path, {"dst_port": "Dst Port"}).select(
        F.col("Row").cast("long").alias("row"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "src_ip", "dst_ip",
        "src_port", "dst_port", "protocol", "packet_count", "byte_count", "ttl", "tcp_flags", "source_type", "label")


REPORTS.add("events_csv", events_csv, with_tables(PACKETS_SQL, select="""SELECT event_id AS "row", "timestamp", src_ip, dst_ip, src_port,
  dst_port, protocol, CASE WHEN event_id % 9 = 0 THEN 2::DOUBLE ELSE 3::DOUBLE END AS packet_count, byte_count, ttl,
  CAST(NULL AS VARCHAR) AS tcp_flags, 'csv' AS source_type, label FROM packets"""))
ZEEK = ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes"]


def zeek_cells(s, d):
    i = F.col("event_id")
    return adapters.packets(s, d).select(
        (F.unix_micros(F.col("timestamp").cast("timestamp")) / 1_000_000).cast("decimal(20,6)").cast("string").alias("ts"),
        F.col("src_ip").alias("id.orig_h"), F.col("src_port").cast("string").alias("id.orig_p"), F.col("dst_ip").alias("id.resp_h"),
        F.col("dst_port").cast("string").alias("id.resp_p"), F.lower("protocol").alias("proto"), F.lit("0.5").alias("duration"),
        F.lit("1").alias("orig_pkts"), F.when(i % 6 == 0, "-").otherwise("2").alias("resp_pkts"),
        F.col("packet_length").cast("string").alias("orig_bytes"), F.lit("10").alias("resp_bytes"))


def zeek_tsv(s, d):
    path = scratch(s)
    line = F.concat_ws("\t", *[F.col(f"`{c}`") for c in ZEEK])
    head = F.array(F.lit("#separator \\x09"), F.lit("#fields\t" + "\t".join(ZEEK)), F.col("value"))
    opens_file = F.monotonically_increasing_id() % 2**33 == 0  # the first row of a partition
    rows = zeek_cells(s, d).select(line.alias("value"), opens_file.alias("opens"))
    rows.select(F.explode(F.when(F.col("opens"), head).otherwise(F.array("value"))).alias("value")).write.text(path)
    return zeek_columns(zk.read_zeek(s, path, "tsv"))


def zeek_json(s, d):
    path = scratch(s)
    numbers = ["ts", "id.orig_p", "id.resp_p", "duration", "orig_pkts", "orig_bytes", "resp_bytes", "resp_pkts"]
    zeek_cells(s, d).select(F.to_json(F.struct(*[
        (F.col(f"`{c}`").try_cast("double") if c in numbers else F.col(f"`{c}`")).alias(c) for c in ZEEK])).alias("value")).write.text(path)
    return zeek_columns(zk.read_zeek(s, path))


def zeek_columns(events):
    return events.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "src_ip", "dst_ip", "protocol",
                         "packet_count", "byte_count", "duration", "source_type")


ZEEK_SQL = with_tables(PACKETS_SQL, select="""SELECT "timestamp", src_ip, dst_ip, lower(protocol) AS protocol,
  CASE WHEN event_id % 6 > 0 THEN 3 END AS packet_count, packet_length + 10 AS byte_count, 0.5::DOUBLE AS duration, 'zeek' AS source_type FROM packets""")
REPORTS.add("zeek_tsv", zeek_tsv, ZEEK_SQL)
REPORTS.add("zeek_json", zeek_json, ZEEK_SQL)
RAW_HEADER = ["Dst Port", "Protocol", "Timestamp", "Tot Fwd Pkts", "Label"]


def raw_flows(s, d):
    """Raw flow files, each part with a header; those of one site have a quoted first column more."""
    path, i, header = scratch(s), F.col("event_id"), ",".join(RAW_HEADER)
    cells = F.concat_ws(",", F.col("dst_port").cast("string"), F.col("protocol"), F.when(i % 83 == 0, "bad").otherwise(
        F.date_format("timestamp", DAY_FIRST)), i.cast("string"), F.col("label"))
    packets = adapters.packets(s, d)
    for name, chosen, head, start in (("narrow", F.col("source_file") != "site-3", header, F.lit("")),
                                      ("wide", F.col("source_file") == "site-3", f"Hosts,{header}",
                                       F.concat(F.lit('"'), F.concat_ws(",", "src_ip", "dst_ip"), F.lit('",')))):
        rows = packets.filter(chosen).select(F.when(i % 97 == 0, F.concat(start, cells, F.lit(",extra"))).when(
            i % 89 == 0, head).otherwise(F.concat(start, cells)).alias(head))
        rows.write.csv(f"{path}/{name}", header=True, sep="\t", quote="\0")
    return fc.parse_raw_flows(fc.read_raw_flow_lines(s, [f"{path}/narrow", f"{path}/wide"]), RAW_HEADER)


REPORTS.add(
    "raw_flow_scan",
    lambda s, d: raw_flows(s, d).groupBy("reason").agg(F.count("*").alias("rows"), F.sum(F.when(
        F.col("reason").isNull(), F.col("Tot Fwd Pkts").try_cast("long"))).alias("total")),
    with_tables(PACKETS_SQL, select="""SELECT CASE WHEN event_id % 97 = 0 THEN 'malformed_width' WHEN event_id % 89 = 0 THEN 'repeated_header'
  WHEN event_id % 83 = 0 THEN 'invalid_timestamp' END AS reason, count(*) AS "rows", CAST(sum(event_id) FILTER (event_id % 97 > 0 AND
  event_id % 89 > 0 AND event_id % 83 > 0) AS BIGINT) AS total FROM packets GROUP BY 1"""),
)


def frames(s, d):
    """Ethernet frames of the packets, built as bytes; some are IPv6, ARP or cut short."""
    def number(value, size):
        return F.lpad(F.hex(value.cast("long")), size * 2, "0")

    packets = adapters.packets(s, d).withColumn("payload_length", F.least(F.col("payload_length"), F.lit(40)))
    packets = packets.withColumns({f"__{c}": F.split(c, r"\.") for c in ("src_ip", "dst_ip")})  # once a row, as the whole frame below
    tcp, i = F.col("protocol") == "TCP", F.col("event_id")
    address = {c: F.concat(*[number(F.col(f"__{c}")[k], 1) for k in range(4)]) for c in ("src_ip", "dst_ip")}
    l4_size = F.when(tcp, 20).otherwise(8)
    l4 = F.when(tcp, F.concat(
        number(F.col("src_port"), 2), number(F.col("dst_port"), 2), number(F.col("tcp_seq"), 4), F.lit("0" * 8), F.lit("50"),
        number(F.col("flag_bits"), 1), number(F.col("tcp_window_size"), 2), F.lit("0" * 8))).otherwise(F.concat(
            number(F.col("src_port"), 2), number(F.col("dst_port"), 2), number(F.col("payload_length") + 8, 2), F.lit("0000")))
    fragment = F.when(F.col("more_fragments"), 0x2000).otherwise(0) + F.col("fragment_offset")
    kind = F.when(i % 31 == 0, "86DD").when(i % 37 == 0, "0806").otherwise("0800")
    whole = F.concat(
        F.lit("0" * 24), kind, F.lit("4500"), number(F.lit(20) + l4_size + F.col("payload_length"), 2), F.lit("0000"),
        number(fragment, 2), number(F.col("ttl"), 1), F.when(tcp, "06").otherwise("11"), F.lit("0000"), address["src_ip"],
        address["dst_ip"], l4, F.repeat(F.lit("AB"), F.col("payload_length").cast("int")))
    return packets.withColumn("__whole", whole).select(
        i.alias("frame_no"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("epoch_micros"),
        F.col("packet_length").alias("wire_length"),
        F.unhex(F.when(i % 41 == 0, F.substring("__whole", 1, 40)).otherwise(F.col("__whole"))).alias("frame"))


STATUS = """CASE WHEN event_id % 31 = 0 THEN 'ipv6_not_implemented' WHEN event_id % 37 = 0 THEN 'non_ip'
  WHEN event_id % 41 = 0 THEN 'parse_error' ELSE 'ok' END"""
REPORTS.add(
    "capture_decode",
    lambda s, d: cp.decode_frames(frames(s, d)).select(
        "frame_no", "parse_status", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ttl", "flag_bits", "tcp_seq",
        "tcp_window_size", "payload_length", "more_fragments", "fragment_offset", "packet_length"),
    with_tables(PACKETS_SQL, f"p AS (SELECT *, {STATUS} AS parse_status FROM packets)", select="SELECT event_id AS frame_no, parse_status, packet_length, "
                + ", ".join(f"CASE WHEN parse_status = 'ok' THEN {e} END AS {c}" for c, e in {
                    **{c: c for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ttl", "flag_bits", "tcp_seq",
                                      "tcp_window_size", "more_fragments", "fragment_offset")},
                    "payload_length": "least(payload_length, 40)"}.items()) + " FROM p"),
)

def captured(s, d):
    """Frames written as four capture files and read back, each file by several tasks."""
    folder = f"{checkpoint_dir(s)}/captures-{uuid.uuid4().hex}"
    cr.write_captures(frames(s, d), folder, 4)
    return cp.decode_frames(cr.read_capture_ranges(s, folder, 32 << 10))


REPORTS.add(
    "capture_files",
    lambda s, d: captured(s, d).groupBy("parse_status", "protocol", "src_ip", "dst_port").agg(
        F.count("*").alias("frames"), F.sum("packet_length").alias("bytes"), F.sum("tcp_seq").alias("tcp_seq"), F.max("timestamp").alias("last")),
    with_tables(PACKETS_SQL, f"p AS (SELECT *, {STATUS} AS parse_status FROM packets)", """
d AS (SELECT *, parse_status = 'ok' AS ok, 14 + 20 + CASE WHEN protocol = 'TCP' THEN 20 ELSE 8 END + least(payload_length, 40) AS size FROM p)""",
                select="""SELECT parse_status, CASE WHEN ok THEN protocol END AS protocol, CASE WHEN ok THEN src_ip END AS src_ip,
  CASE WHEN ok THEN dst_port END AS dst_port, count(*) AS frames,
  CAST(sum(greatest(packet_length, CASE WHEN event_id % 41 = 0 THEN 20 ELSE size END)) AS BIGINT) AS bytes,
  CAST(sum(CASE WHEN ok AND protocol = 'TCP' THEN tcp_seq END) AS BIGINT) AS tcp_seq, max(timestamp) AS "last" FROM d GROUP BY ALL"""),
)


def signed(s, d):
    """Frames behind the signatures of capture formats; some have a signature cut short, none of the known ones, or no bytes at all."""
    i = F.col("frame_no")
    signatures = [*cp.CLASSIC_MAGICS, cp.PCAPNG_MAGIC, cp.PCAPNG_MAGIC[:6], "504B0304"]
    content = F.concat(F.unhex(F.element_at(F.array(*map(F.lit, signatures)), (i % len(signatures) + 1).cast("int"))), F.col("frame"))
    cut = i % len(signatures) == len(signatures) - 2
    return frames(s, d).select(i, F.when(cut, F.substring(content, 1, 3)).when(i % 11 > 0, content).alias("content"))


REPORTS.add(
    "capture_formats",
    lambda s, d: signed(s, d).groupBy(cp.sniff_format(F.col("content")).alias("format")).agg(
        F.count("*").alias("files"), F.sum("frame_no").alias("numbers")),
    with_tables(PACKETS_SQL, """
f AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE CASE event_id % 7 WHEN 0 THEN 'pcap-big-micro'
  WHEN 1 THEN 'pcap-little-micro' WHEN 2 THEN 'pcap-big-nano' WHEN 3 THEN 'pcap-little-nano' WHEN 4 THEN 'pcapng' ELSE 'unknown' END
  END AS format FROM packets)""", select="""SELECT format, count(*) AS files, CAST(sum(event_id) AS BIGINT) AS numbers FROM f GROUP BY 1"""),
)
REPORTS.add("capture_status", lambda s, d: cp.status_counts(cp.decode_frames(frames(s, d))),
            with_tables(PACKETS_SQL, select=f"SELECT {STATUS} AS parse_status, count(*) AS frames FROM packets GROUP BY 1"))
REPORTS.add(
    "canonical_union",
    lambda s, d: fc.union_events([
        cp.capture_events(cp.decode_frames(frames(s, d))), zk.normalize_zeek(zeek_cells(s, d)),
        fc.normalize_events(csv_rows(s, d), {"dst_port": "Dst Port"})]).groupBy("source_type").agg(
        F.count("*").alias("events"), F.sum("byte_count").alias("bytes"), F.count("tcp_flags").alias("flagged")),
    with_tables(PACKETS_SQL, select=f"""SELECT 'pcap' AS source_type, count(*) AS events, CAST(sum(packet_length) AS DOUBLE) AS bytes,
    count(*) FILTER (protocol = 'TCP') AS flagged FROM packets WHERE {STATUS} = 'ok'
  UNION ALL SELECT 'zeek', count(*), sum(packet_length + 10), 0 FROM packets UNION ALL SELECT 'csv', count(*), sum(byte_count), 0 FROM packets"""),
)


def state_store(s, d):
    path = scratch(s)
    fc.write_states(dr.labelled(s, d), path)
    return fc.read_states(s, path, features=9, sources=4).groupBy("source_file", "split").agg(
        F.count("*").alias("windows"), F.sum("flow_count").alias("flows"))


REPORTS.add("state_store", state_store, with_tables(*dr.LABELLED, select="""SELECT source_file, split, count(*) AS windows,
  CAST(sum(flow_count) AS BIGINT) AS flows FROM labelled GROUP BY ALL"""))


def reject_log(s, d):
    path = scratch(s)
    _, rejects = sk.split_rejects(dr.classified(s, d))
    rejects.write.parquet(path)
    return s.read.parquet(path).select("source_file", "row_number", "reason")


REPORTS.add("reject_log", reject_log, with_tables(PACKETS_SQL, dr.RAW_SQL, select="SELECT * FROM classified WHERE reason IS NOT NULL"))


def graph_dataset(s, d):
    from packetloom.plans import graph_reports as gr

    path = scratch(s)
    edges = gr.item_edges(s, d)
    sk.write_graph_dataset({"edges": edges}, path, "json")
    written = s.read.schema(edges.schema).json(f"{path}/edges")
    sk.write_graph_dataset({"nodes": gr.item_nodes(s, d, written)}, path, "csv")
    return written.groupBy("ship_year").agg(
        F.count("*").alias("edges"), F.sum("flow_count").alias("flows"))


REPORTS.add("graph_dataset", graph_dataset, """SELECT year(l_shipdate) AS ship_year, count(DISTINCT (l_suppkey, l_partkey)) AS edges,
  count(*) AS flows FROM lineitem GROUP BY 1""")


def prediction_sink(s, d):
    path = scratch(s)
    rows = adapters.scores(s, d)
    sk.write_predictions(rows, path, ["source_file", "event_id", "label", "score"], ["source_file", "event_id"])
    return s.read.schema("source_file string, event_id long, label int, score double").csv(path, header=True)


REPORTS.add("prediction_sink", prediction_sink, with_tables(adapters.SCORES_SQL, select="SELECT source_file, event_id, label, score FROM scores"))


def log_files(s, d):
    path = scratch(s)
    lr.log_lines(s, d).select("value").write.text(path)
    return al.log_entries(sk.read_log_lines(s, path)).groupBy("severity").agg(F.count("*").alias("n"))


REPORTS.add("log_files", log_files, with_tables(lr.LOGS_SQL, select="SELECT severity, count(*) AS n FROM logs GROUP BY 1"))
REPORTS.add(
    "latest_per_stream",
    lambda s, d: sk.latest_per_stream(adapters.packets(s, d), 200, "source_file", "timestamp").select("source_file", "event_id", "position"),
    with_tables(PACKETS_SQL, select="""SELECT source_file, event_id, row_number() OVER (PARTITION BY source_file ORDER BY "timestamp", event_id)
  AS position FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY "timestamp" DESC, event_id DESC) AS r FROM packets) WHERE r <= 200"""),
)


# ---- streaming: the events file is the stream, run until it is used up ----

def event_stream(s, d):
    return st.read_event_stream(s, d, adapters.table(s, d, "events").schema, name_pattern="events.parquet")


def stream_packets(s, d):
    events = event_stream(s, d).select(
        F.col("ts").alias("timestamp"), "event_id", (F.col("user_id") % 40).cast("string").alias("src_ip"), "event_type",
        F.col("event_type").alias("protocol"), F.regexp_extract("props", r"(\d+)", 1).alias("dst_ip"),
        F.lit(1).alias("src_port"), (F.col("event_id") % 5).alias("dst_port"), F.lit(1).cast("long").alias("packet_count"),
        F.round(F.col("value") * 100).alias("byte_count"), F.lit(64).alias("ttl"), F.lit(1).alias("tcp_window_size"),
        F.lit("S").alias("tcp_flags"), F.lit("stream").alias("source_type"))
    return st.with_event_time(events)


@contextmanager
def one_store_per_core(s):
    """A stream keeps one state store per shuffle partition for life; the short test streams need no more than cores.
    Keyed state needs the RocksDB store. Both settings are set back."""
    wanted = {
        "spark.sql.shuffle.partitions": str(min(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism)),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    before = {name: s.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        s.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            s.conf.unset(name) if value is None else s.conf.set(name, value)


def finished(s, rows):
    out = scratch(s)
    with one_store_per_core(s):
        st.run_to_files(rows, f"{out}/rows", f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/rows")


def naive(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


STREAM_SQL = """
stream AS (SELECT ts, event_id, CAST(user_id % 40 AS VARCHAR) AS src_ip, event_type, regexp_extract(props, '(\\d+)', 1) AS dst_ip,
  event_id % 5 AS dst_port, round(value * 100) AS b FROM events),
mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 60 SECOND AS w FROM stream)"""
REPORTS.add(
    "stream_window_states",
    lambda s, d: naive(finished(s, st.streaming_window_states(stream_packets(s, d), "1 hour")), "window_start", "window_end"),
    with_tables(STREAM_SQL, select="""SELECT t AS window_start, t + INTERVAL 1 HOUR AS window_end, count(*) AS event_count,
  CAST(count(*) AS DOUBLE) AS total_packets, sum(b) AS total_bytes, count(DISTINCT src_ip) AS unique_sources,
  count(DISTINCT dst_ip) AS unique_destinations, CAST(1 AS BIGINT) AS unique_source_ports, count(DISTINCT dst_port) AS unique_destination_ports,
  count(DISTINCT event_type) AS unique_protocols FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS t FROM stream), mark
  WHERE t + INTERVAL 1 HOUR <= w GROUP BY t"""),
)
REPORTS.add(
    "stream_session_flows",
    lambda s, d: naive(finished(s, st.streaming_flows(stream_packets(s, d), ["src_ip"], 3600)), "flow_start", "flow_end").select(
        "src_ip", "flow_start", "flow_end", "packet_count", "byte_count"),
    with_tables(STREAM_SQL, """
g AS (SELECT *, date_sub('second', lag(ts) OVER (PARTITION BY src_ip ORDER BY ts, event_id), ts) > 3600 AS cut FROM stream),
n AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS k FROM g)""",
                select="""SELECT src_ip, min(ts) AS flow_start, max(ts) AS flow_end, count(*) AS packet_count, sum(b) AS byte_count
  FROM n, mark GROUP BY src_ip, k, w HAVING max(ts) + INTERVAL 3600999999 MICROSECOND <= w"""),
)
REPORTS.add(
    "stream_sliding_scan",
    lambda s, d: naive(finished(s, st.sliding_scan(stream_packets(s, d), "4 hours", "1 hour")), "window_start", "window_end"),
    with_tables(STREAM_SQL, select="""SELECT t AS window_start, t + INTERVAL 4 HOUR AS window_end, count(*) AS event_count, sum(b) AS total_bytes,
  max(b) AS peak_bytes FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR,
    time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 3 HOUR]) AS t FROM stream), mark
  WHERE t + INTERVAL 4 HOUR <= w GROUP BY t"""),
)


def stream_alerts(s, d):
    logs = stream_packets(s, d).select(
        F.col("event_id").alias("log_id"), "timestamp", F.concat(F.lit("IDS "), "event_type").alias("event_type"),
        F.when(F.col("event_type") == "error", "HIGH").otherwise("LOW").alias("severity"))
    return finished(s, al.alerts(logs)).select("log_id", "rule_triggered", "status", "severity")


REPORTS.add("stream_alerts", stream_alerts, """SELECT event_id AS log_id, 'High severity IDS event: IDS error' AS rule_triggered,
  'Active' AS status, 'HIGH' AS severity FROM events WHERE event_type = 'error'""")


def stream_forecasts(s, d):
    out = scratch(s)
    rows = stream_packets(s, d).withColumn("stream_key", F.col("src_ip"))
    handler = st.store_and_forecast(f"{out}/store", f"{out}/result", 60, 3600)
    with one_store_per_core(s):
        st.run_micro_batches(rows, handler, f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/result").select("stream_key", F.col("forecasted_risk").between(0, 1).alias("valid"))


REPORTS.add("stream_forecasts", stream_forecasts, """SELECT DISTINCT CAST(user_id % 40 AS VARCHAR) AS stream_key, true AS valid FROM events""")


def keyed_packets(s, d):
    return stream_packets(s, d).withColumn("stream_key", F.col("src_ip"))


def stream_recent_events(s, d):
    """The state of a finished stream, read back as a table."""
    out = scratch(s)
    events = keyed_packets(s, d).select("stream_key", F.unix_micros("timestamp").alias("created_at"), "event_id",
                                        F.col("event_type").alias("payload"))
    with one_store_per_core(s):
        st.recent_events(events, 50).writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.format("noop").mode("append").save()).option(
            "checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        return cut_lineage(st.read_buffers(s, f"{out}/state"))


REPORTS.add("stream_recent_events", stream_recent_events, """SELECT CAST(user_id % 40 AS VARCHAR) AS stream_key,
  epoch_us(ts) AS created_at, event_id, event_type AS payload FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, event_id DESC) <= 50""")


def stream_keyed_forecasts(s, d):
    out = scratch(s)
    with one_store_per_core(s):
        st.buffered_events(keyed_packets(s, d), 50).writeStream.outputMode("update").foreachBatch(
            st.forecast_buffers(f"{out}/result", 60, 3600)).option(
            "checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{out}/result").select(
        "stream_key", "events", "oldest_id", "newest_id", "graph_nodes", "graph_edges", (
            F.col("forecasted_risk").between(0, 1) & ((F.col("attack_type") == "Brute Force") == (F.col("forecasted_risk") >= 0.7))
            & (F.col("flows") >= F.col("network_states"))).alias("valid"))


REPORTS.add("stream_keyed_forecasts", stream_keyed_forecasts, """SELECT stream_key, count(*) AS events,
  arg_min(event_id, (ts, event_id)) AS oldest_id, arg_max(event_id, (ts, event_id)) AS newest_id, true AS valid,
  1 + count(DISTINCT dst_ip) FILTER (dst_ip <> stream_key) AS graph_nodes, count(DISTINCT dst_ip) AS graph_edges
  FROM (SELECT *, CAST(user_id % 40 AS VARCHAR) AS stream_key, regexp_extract(props, '(\\d+)', 1) AS dst_ip FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, event_id DESC) <= 50) GROUP BY 1""")
