"""Packet-level window, node, edge and micro-batch features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.numeric import clamp, distinct_of_few, normalize_score, safe_ratio
from packetloom.operators.ordered import beside, epoch_micros, grouped_percentiles, previous_value

# TCP flag bits and the protocol vocabulary.
FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}
PROTOCOLS = ("TCP", "UDP", "ICMP", "OTHER")
DEFAULT_SALT = "packet-graph"
FLOW_TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def protocol_name(protocol: Column) -> Column:
    """P20. TCP, UDP, ICMP, else OTHER."""
    upper = F.upper(protocol)
    return F.when(upper.isin(*PROTOCOLS[:3]), upper).otherwise("OTHER")


def flag(bits: Column, name: str) -> Column:
    """P19. Whether a TCP flag is set; false without flags."""
    return F.coalesce(bits.bitwiseAND(F.lit(FLAG_BITS[name]).cast("long")) != 0, F.lit(False))


def is_fragment(more_fragments: Column, offset: Column) -> Column:
    """P21."""
    return F.coalesce(more_fragments, F.lit(False)) | (F.coalesce(offset, F.lit(0)) > 0)


def pseudonym(ip: Column, salt: str = DEFAULT_SALT) -> Column:
    """P17. host_ plus 16 hex digits of the salted SHA-256."""
    return F.concat(F.lit("host_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), ip), 256), 1, 16))


def hosts(packets: DataFrame, source: str = "src_ip", target: str = "dst_ip") -> DataFrame:
    """U3. Distinct hosts, source or destination."""
    return packets.select(F.explode(F.array(source, target)).alias("host")).distinct()


def pseudonym_check(raw_hosts: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """P18. Distinct raw and pseudonymous hosts, collisions, and whether the mapping is one-to-one."""
    return raw_hosts.select("host", pseudonym(F.col("host"), salt).alias("anon")).agg(
        F.count_distinct("host").alias("unique_raw"), F.count_distinct("anon").alias("unique_anonymous"),
    ).withColumns({
        "collisions": F.col("unique_raw") - F.col("unique_anonymous"),
        "bijective": F.col("unique_raw") == F.col("unique_anonymous"),
    })


def with_capture_offsets(packets: DataFrame, window_seconds: int = 10, ts: str = "timestamp",
                         keys: Sequence[str] = ()) -> DataFrame:
    """Seconds since capture start and the capture-aligned window index.

    The start is one row per capture: a scalar subquery for one capture, a small join for several.
    """
    if keys:
        starts = packets.groupBy(*keys).agg(F.min(ts).alias("__start"))
        placed = packets.join(starts, list(keys))
    else:
        placed = packets.withColumn("__start", packets.agg(F.min(ts)).scalar())
    micros = epoch_micros(ts) - epoch_micros("__start")
    return placed.withColumns({
        "offset": micros / 1_000_000, "window_index": F.floor(micros / (window_seconds * 1_000_000)),
    }).drop("__start")


def _spread(prefix: str, value: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.coalesce(F.avg(value), zero).alias(f"{prefix}_mean"),
        F.coalesce(F.stddev_pop(value), zero).alias(f"{prefix}_std"),
        F.coalesce(F.var_pop(value), zero).alias(f"{prefix}_variance"),
        F.coalesce(F.min(value).cast("double"), zero).alias(f"{prefix}_min"),
        F.coalesce(F.max(value).cast("double"), zero).alias(f"{prefix}_max"),
    ]


def packet_window_features(packets: DataFrame, keys: Sequence[str] = ("window_index",)) -> DataFrame:
    """A11. Size, TTL, window, payload, fragment, protocol and TCP-flag statistics of a window.

    The payload median comes from :func:`payload_medians` and retransmissions from
    :func:`retransmissions`; join them where needed.
    """
    protocol, bits = protocol_name(F.col("protocol")), F.col("flag_bits")
    tcp = protocol == "TCP"
    fragment = is_fragment(F.col("more_fragments"), F.col("fragment_offset"))
    base = packets.groupBy(*keys).agg(
        F.count("*").cast("double").alias("packet_count"),
        F.sum("packet_length").cast("double").alias("total_bytes"),
        *_spread("ttl", F.col("ttl")),
        *_spread("tcp_window", F.when(tcp, F.col("tcp_window_size"))),
        *_spread("payload", F.col("payload_length")),
        *_spread("packet_length", F.col("packet_length")),
        F.count_if(fragment).cast("double").alias("fragment_count"),
        *[F.count_if(protocol == p).cast("double").alias(f"{p.lower()}_packet_count") for p in PROTOCOLS],
        *[F.count_if(tcp & flag(bits, f)).cast("double").alias(f"{f}_count") for f in FLAG_BITS],
    )
    total = F.col("packet_count")
    return base.withColumns({
        "bytes_per_packet": safe_ratio(F.col("total_bytes"), total),
        "fragment_ratio": safe_ratio(F.col("fragment_count"), total),
        **{f"{p.lower()}_packet_ratio": safe_ratio(F.col(f"{p.lower()}_packet_count"), total) for p in PROTOCOLS},
        **{f"{f}_ratio": safe_ratio(F.col(f"{f}_count"), F.col("tcp_packet_count")) for f in FLAG_BITS},
    })


def payload_medians(packets: DataFrame, keys: Sequence[str] = ("window_index",)) -> DataFrame:
    """A11. Exact median payload per window."""
    return grouped_percentiles(packets, list(keys), "payload_length", {"payload_median": 0.5})


def port_scan_scores(packets: DataFrame, keys: Sequence[str] = ("window_index",), port: str = "dst_port") -> DataFrame:
    """A12. Sequential and random scan scores from the distinct destination ports.

    A port opens a consecutive pair when its predecessor is present too; both sides are the
    distinct ports, of which a window has at most 65,536.
    """
    ports = packets.filter(F.col(port).isNotNull()).select(*keys, F.col(port).alias("port")).distinct()
    shifted = ports.union(ports.select(*keys, (F.col("port") + 1).alias("port")))
    pairs = shifted.groupBy(*keys, "port").agg(F.count("*").alias("__n")).filter("__n = 2").groupBy(*keys).agg(
        F.count("*").alias("__pairs"))
    spans = ports.groupBy(*keys).agg(
        F.count("*").cast("double").alias("unique_dst_ports"),
        (F.max("port") - F.min("port")).cast("double").alias("port_range"),
    )
    sequential = clamp(safe_ratio(F.coalesce("__pairs", F.lit(0)), F.col("unique_dst_ports") - 1))
    scored = spans.join(pairs, list(keys), "left").withColumn("sequential_port_score", sequential).drop("__pairs")
    spread = normalize_score(F.col("port_range"), 1.0, 65535.0)
    return scored.withColumn("random_port_score", F.when(
        F.col("unique_dst_ports") < 2, 0.0).otherwise(clamp(spread * (1 - F.col("sequential_port_score")))))


def inter_arrival_stats(packets: DataFrame, keys: Sequence[str] = ("window_index",), ts: str = "timestamp",
                        tie_break: Sequence[str] = (), bucket_seconds: float = 60.0) -> DataFrame:
    """A13. Population statistics of the gaps between consecutive packets; zeros for fewer than two."""
    lagged = previous_value(packets, keys, ts, tie_break, bucket_seconds)
    gap = (epoch_micros(ts) - epoch_micros("previous")) / 1_000_000
    return lagged.groupBy(*keys).agg(*_spread("packet_iat", gap))


def retransmissions(packets: DataFrame, window: str = "window_index", ts: str = "timestamp",
                    tie_break: Sequence[str] = ()) -> DataFrame:
    """A14. Payload packets per window whose sequence number was seen earlier on the same flow.

    All but the first packet of a (flow, sequence) are retransmissions, so a window's count is its
    payload packets less the first sightings in it: two aggregations and no self-join.
    """
    data = packets.filter((F.col("payload_length") > 0) & F.col("tcp_seq").isNotNull())
    first = data.groupBy(*FLOW_TUPLE, "tcp_seq").agg(
        F.min_by(window, F.struct(ts, *tie_break)).alias(window)
    ).groupBy(window).agg(F.count("*").alias("__first"))
    counted = packets.groupBy(window).agg(
        F.count_if((F.col("payload_length") > 0) & F.col("tcp_seq").isNotNull()).alias("__data"),
        F.count_if(protocol_name(F.col("protocol")) == "TCP").alias("__tcp"),
    )
    repeated = F.col("__data") - F.coalesce("__first", F.lit(0))
    return counted.join(first, window, "left").select(
        window, repeated.cast("double").alias("retransmission_count"),
        safe_ratio(repeated, F.col("__tcp")).alias("retransmission_rate"),
    )


def _role_rows(packets: DataFrame) -> DataFrame:
    """Each packet once as sender row and once as receiver row; a self-loop packet weighs double in both."""
    nothing = F.lit(None)
    loop = F.when(F.col("src_ip") == F.col("dst_ip"), 2).otherwise(1)
    sender = F.struct(
        F.col("src_ip").alias("node"), F.lit(1).alias("sent"), F.col("dst_ip").alias("sent_to"),
        nothing.cast("string").alias("got_from"), F.col("dst_port").cast("long").alias("to_port"),
        nothing.cast("long").alias("from_port"))
    receiver = F.struct(
        F.col("dst_ip").alias("node"), F.lit(0).alias("sent"), nothing.cast("string").alias("sent_to"),
        F.col("src_ip").alias("got_from"), nothing.cast("long").alias("to_port"), F.col("src_port").cast("long").alias("from_port"))
    return packets.select(
        "window_index", "offset", "packet_length", protocol_name(F.col("protocol")).alias("protocol"),
        loop.alias("copies"), F.explode(F.array(sender, receiver)).alias("role")).select("*", "role.*").drop("role")


def node_window_features(packets: DataFrame) -> DataFrame:
    """A18. Per window and host: traffic in and out, peers, ports, protocols, first and last offset.

    A self-loop packet counts twice in packets and in the bytes of both directions.
    """
    amount = F.col("packet_length") * F.col("copies")
    return _role_rows(packets).groupBy("window_index", "node").agg(
        F.count("*").alias("packet_count"),
        F.sum(F.when(F.col("sent") == 1, amount).otherwise(0)).alias("bytes_sent"),
        F.sum(F.when(F.col("sent") == 0, amount).otherwise(0)).alias("bytes_received"),
        F.count_distinct("sent_to").alias("unique_destinations"),
        F.count_distinct("got_from").alias("unique_sources"),
        F.count_distinct("to_port").alias("unique_destination_ports"),
        F.count_distinct("from_port").alias("unique_source_ports"),
        *[F.count_if(F.col("protocol") == p).alias(f"{p.lower()}_packet_count") for p in PROTOCOLS],
        F.min("offset").alias("first_seen_offset"),
        F.max("offset").alias("last_seen_offset"),
    )


def protocol_counts(nodes: DataFrame) -> Column:
    """The per-protocol counts of A18 as one map."""
    return F.create_map(*[part for p in PROTOCOLS for part in (F.lit(p), F.col(f"{p.lower()}_packet_count"))])


def _link_features(packets: DataFrame, keys: Sequence[str], tie_break: Sequence[str], bucket_seconds: float) -> DataFrame:
    """Shared aggregate of A19 and A22 over packets of one link key."""
    lagged = previous_value(packets, keys, "timestamp", tie_break, bucket_seconds)
    gap = (epoch_micros("timestamp") - epoch_micros("previous")) / 1_000_000
    protocol, bits = protocol_name(F.col("protocol")), F.col("flag_bits")
    return lagged.groupBy(*keys).agg(
        F.count("*").alias("packet_count"), F.sum("packet_length").alias("total_bytes"),
        F.avg("packet_length").alias("mean_packet_length"), F.min("packet_length").alias("min_packet_length"),
        F.max("packet_length").alias("max_packet_length"), F.stddev_pop("packet_length").alias("packet_length_std"),
        F.min("offset").alias("first_packet_offset"), F.max("offset").alias("last_packet_offset"),
        ((epoch_micros(F.max("timestamp")) - epoch_micros(F.min("timestamp"))) / 1_000_000).alias("edge_duration"),
        F.avg(gap).alias("mean_inter_arrival_time"), F.stddev_pop(gap).alias("inter_arrival_time_std"),
        *[F.count_if(protocol == p).alias(f"{p.lower()}_packet_count") for p in PROTOCOLS],
        distinct_of_few(F.col("src_port")).alias("source_port_diversity"),
        distinct_of_few(F.col("dst_port")).alias("destination_port_diversity"),
        *[F.count_if(flag(bits, f)).alias(f"tcp_{f}_count") for f in ("syn", "ack", "fin", "rst")],
    )


def edge_window_features(packets: DataFrame, tie_break: Sequence[str] = (), bucket_seconds: float = 60.0) -> DataFrame:
    """A19. Per window and directed pair; rates are NULL for zero duration, gaps NULL for one packet."""
    edges = _link_features(packets, ["window_index", "src_ip", "dst_ip"], tie_break, bucket_seconds)
    duration = F.col("edge_duration")
    return edges.withColumns({
        "packets_per_second": F.when(duration > 0, F.col("packet_count") / duration),
        "bytes_per_second": F.when(duration > 0, F.col("total_bytes") / duration),
    })


def micro_batches(packets: DataFrame, seconds: float = 1.0, tie_break: Sequence[str] = ()) -> DataFrame:
    """A22. One event per time bucket and 5-tuple."""
    placed = packets.withColumn("bucket_index", F.floor(F.col("offset") / seconds))
    return _link_features(placed, ["bucket_index", *FLOW_TUPLE], tie_break, max(seconds, 1.0))


def novelty(events: DataFrame, source: str = "src_ip", target: str = "dst_ip") -> DataFrame:
    """W18. Percent of events whose pair, destination or source was not seen in an earlier event.

    The first event of each value is the unseen one, so the unseen count is the distinct count.
    """
    def share(*columns):
        return F.count_distinct(*columns) * 100.0 / F.count("*")

    return events.agg(
        F.count("*").alias("total_events"),
        share(source, target).alias("pct_unseen_pair"),
        share(target).alias("pct_unseen_destination"),
        share(source).alias("pct_unseen_source"),
    )


def event_gaps(events: DataFrame, ts: str, tie_break: Sequence[str], bucket_seconds: float = 3600.0,
               keys: Sequence[str] = ()) -> DataFrame:
    """W19. Seconds since the previous event in time order."""
    lagged = previous_value(events, keys, ts, tie_break, bucket_seconds)
    return lagged.withColumn("gap", (epoch_micros(ts) - epoch_micros("previous")) / 1_000_000).drop("previous")


def capture_summary(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A23. Totals, protocol mix, host counts and time span of a capture."""
    protocol = protocol_name(F.col("protocol"))
    summary = packets.groupBy(*keys).agg(
        F.count("*").alias("packet_count"), F.sum("packet_length").alias("total_bytes"),
        *[F.count_if(protocol == p).alias(f"{p.lower()}_packet_count") for p in PROTOCOLS],
        F.count_distinct("src_ip").alias("unique_sources"), F.count_distinct("dst_ip").alias("unique_destinations"),
        F.count_distinct("src_ip", "dst_ip").alias("unique_directed_pairs"),
        F.min("timestamp").alias("first_packet"), F.max("timestamp").alias("last_packet"),
    )
    return summary.withColumn(
        "duration_seconds", (epoch_micros("last_packet") - epoch_micros("first_packet")) / 1_000_000)


def host_counts(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A23. Distinct hosts in either role."""
    both = packets.select(*keys, F.explode(F.array("src_ip", "dst_ip")).alias("host"))
    return both.groupBy(*keys).agg(F.count_distinct("host").alias("unique_hosts"))


def capture_graph_stats(packets: DataFrame, edges: DataFrame) -> DataFrame:
    """A24 + A26. Window, node and pair totals, the packet accounting check and sparsity."""
    totals = packets.agg(F.count("*").alias("ip_packets"), (F.max("window_index") + 1).alias("total_windows"))
    nodes = hosts(packets).agg(F.count("*").alias("unique_nodes"))
    linked = edges.agg(
        F.count_distinct("window_index").alias("non_empty_windows"),
        F.count_distinct("src_ip", "dst_ip").alias("unique_directed_pairs"),
        F.count("*").alias("window_edge_instances"), F.sum("packet_count").alias("packets_in_edges"),
    )
    one = beside(beside(totals, nodes), linked)
    n = F.col("unique_nodes")
    return one.withColumns({
        "empty_windows": F.col("total_windows") - F.col("non_empty_windows"),
        "accounting_matches": F.col("ip_packets") == F.col("packets_in_edges"),
        "sparsity": F.when(n > 1, 1 - F.col("unique_directed_pairs") / (n * (n - 1))),
    })


def feature_coverage(packets: DataFrame, edges: DataFrame) -> DataFrame:
    """A25. Percent of packets carrying each field class, and of edges with a defined gap."""
    protocol = protocol_name(F.col("protocol"))
    known = packets.agg(
        *[(F.avg(condition.cast("double")) * 100).alias(name) for name, condition in {
            "ip": F.col("src_ip").isNotNull(), "ports": protocol.isin("TCP", "UDP"),
            "ttl": F.col("ttl").isNotNull(), "tcp_flags": protocol == "TCP", "tcp_window": protocol == "TCP",
            "payload": protocol != "OTHER", "fragmentation": F.col("src_ip").isNotNull()}.items()])
    gaps = edges.agg((F.avg(F.col("mean_inter_arrival_time").isNotNull().cast("double")) * 100).alias("inter_arrival"))
    return beside(known, gaps)


def window_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A27. Active hosts and edges, traffic, protocol mix and largest edge burst per non-empty window."""
    active = nodes.groupBy("window_index").agg(F.count("*").alias("active_hosts"))
    traffic = edges.groupBy("window_index").agg(
        F.count("*").alias("active_edges"), F.sum("packet_count").alias("packet_volume"),
        F.sum("total_bytes").alias("byte_volume"),
        *[F.sum(f"{p.lower()}_packet_count").alias(f"{p.lower()}_packets") for p in PROTOCOLS],
        F.max("packet_count").alias("max_burst_in_window"),
    )
    return active.join(traffic, "window_index", "full")


def preservation_check(packets: DataFrame, events: DataFrame) -> DataFrame:
    """A28. Whether micro-batching kept totals, pairs, protocol counts and ports.

    Both tables are read once: each row states its facts, the facts are counted per side and then
    compared side by side.
    """
    def facts(rows, count, size, side):
        pair = F.concat_ws(">", "src_ip", "dst_ip")
        stated = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in (
            ("total", F.lit("")), ("pairs", pair), ("src_ports", F.col("src_port")), ("dst_ports", F.col("dst_port")),
            ("protocols", protocol_name(F.col("protocol"))))])).alias("fact")
        counted = rows.select(stated, count.alias("n"), size.alias("bytes")).groupBy("fact.kind", "fact.value").agg(
            F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        return counted.withColumn("side", F.lit(side))

    both = facts(packets, F.lit(1), F.col("packet_length"), "before").unionByName(
        facts(events, F.col("packet_count"), F.col("total_bytes"), "after")).groupBy("kind", "value").agg(*[
            F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0)).alias(f"{c}_{side}")
            for c in ("n", "bytes") for side in ("before", "after")])
    kind = F.col("kind")
    present = (F.col("n_before") > 0) == (F.col("n_after") > 0)
    same = F.when(kind == "protocols", F.col("n_before") == F.col("n_after")).otherwise(present)
    checked = both.agg(
        *[F.coalesce(F.sum(F.when(kind == "total", F.col(f"{c}_{side}"))), F.lit(0)).alias(f"{name}_{side}")
          for c, name in (("n", "packets"), ("bytes", "bytes")) for side in ("before", "after")],
        *[F.count_if((kind == k) & ~same).alias(f"{k}_differing") for k in ("pairs", "src_ports", "dst_ports", "protocols")])
    kept = (F.col("packets_before") == F.col("packets_after")) & (F.col("bytes_before") == F.col("bytes_after"))
    for k in ("pairs", "src_ports", "dst_ports", "protocols"):
        kept = kept & (F.col(f"{k}_differing") == 0)
    return checked.withColumn("preserved", kept)
