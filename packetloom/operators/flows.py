"""Flow sessionisation and flow features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.numeric import distinct_with_null, safe_ratio
from packetloom.operators.ordered import BUCKET, KEY, add_time_bucket, epoch_micros, group_key, grouped_percentiles
from packetloom.session import cut_lineage

FLOW_KEYS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def require_columns(df: DataFrame, required: Sequence[str], what: str = "Input") -> DataFrame:
    """P3. Fail with the sorted list of absent columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def complete_events(events: DataFrame, row_id: str) -> DataFrame:
    """P1. Fill the gaps a flow needs, deriving hosts and ports from the row number."""
    row = F.col(row_id)
    return events.withColumns({
        "src_ip": F.coalesce("src_ip", F.concat(F.lit("192.168.1."), (row % 20 + 10).cast("string"))),
        "dst_ip": F.coalesce("dst_ip", F.lit("192.168.1.24")),
        "src_port": F.coalesce("src_port", (row % 1000 + 40000).cast("long")),
        "packet_count": F.coalesce("packet_count", F.lit(1)),
        "byte_count": F.coalesce("byte_count", F.lit(0.0)),
        "tcp_flags": F.coalesce("tcp_flags", F.lit("")),
        "ttl": F.coalesce("ttl", F.lit(64).cast("long")),
        "tcp_window_size": F.coalesce("tcp_window_size", F.lit(0).cast("long")),
    })


def prepare_events(events: DataFrame) -> DataFrame:
    """P2. Typed timestamp, packet count (default 1) and byte count (default 0)."""
    dtype = dict(events.dtypes)["timestamp"]
    ts = F.col("timestamp")
    if not dtype.startswith("timestamp"):
        ts = F.try_to_timestamp(ts.cast("string"))
    return events.withColumns({
        "timestamp": ts,
        "packet_count": F.coalesce(F.col("packet_count").try_cast("long"), F.lit(1).cast("long")),
        "byte_count": F.coalesce(F.col("byte_count").try_cast("double"), F.lit(0.0)),
    })


def segment_flows(
    packets: DataFrame,
    keys: Sequence[str] = FLOW_KEYS,
    ts: str = "timestamp",
    tie_break: Sequence[str] = (),
    timeout_seconds: int = 60,
    bucket_seconds: int = 3600,
    rows_per_bucket: int = 2_000_000,
) -> DataFrame:
    """W1. Number the sessions of each key: a gap of more than ``timeout_seconds`` whole seconds
    starts a new one.

    Rows are handled per (key, time bucket). One summary row per bucket (first and last time, inner
    boundaries) tells whether the bucket opens a session and how many sessions came before it. A burst
    of more than ``rows_per_bucket`` packets of one key within a bucket is cut further.
    """
    if timeout_seconds <= 0:
        raise ValueError("timeout_seconds must be greater than zero")
    keyed = add_time_bucket(packets, keys, ts, bucket_seconds, rows_per_bucket).withColumn(KEY, group_key(keys))
    inside = Window.partitionBy(KEY, BUCKET).orderBy(ts, *tie_break)

    def splits(now, before):
        return F.coalesce(
            F.floor((epoch_micros(now) - epoch_micros(before)) / 1_000_000) > timeout_seconds, F.lit(False)
        ).cast("int")

    marked = keyed.withColumn("__split", splits(F.col(ts), F.lag(ts).over(inside)))
    buckets = marked.groupBy(KEY, BUCKET).agg(
        F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.sum("__split").alias("__inner")
    )
    along = Window.partitionBy(KEY).orderBy(BUCKET)
    opened = buckets.withColumn("__open", splits(F.col("__first"), F.lag("__last").over(along)))
    offsets = opened.select(
        KEY, BUCKET,
        (F.col("__open") + F.coalesce(
            F.sum(F.col("__open") + F.col("__inner")).over(along.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0))).alias("__offset"),
    )
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.join(offsets, [KEY, BUCKET])
        .withColumn("flow_segment", F.col("__offset") + F.sum("__split").over(so_far))
        .drop(KEY, BUCKET, "__split", "__offset")
    )


def _flow_statistics(ts: str, first_columns: Sequence[str], tie_break: Sequence[str] = ()) -> list:
    spread = {"ttl": "ttl", "tcp_window": "tcp_window_size"}
    return [
        F.min(ts).alias("flow_start"),
        F.max(ts).alias("flow_end"),
        F.sum("packet_count").alias("packet_count"),
        F.sum("byte_count").alias("byte_count"),
        F.avg("byte_count").alias("packet_size_mean"),
        F.coalesce(F.stddev_samp("byte_count"), F.lit(0.0)).alias("packet_size_std"),
        F.min("byte_count").alias("packet_size_min"),
        F.max("byte_count").alias("packet_size_max"),
        *[F.avg(c).alias(f"{n}_mean") for n, c in spread.items()],
        *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{n}_std") for n, c in spread.items()],
        # Flag combinations come from eight bits, so the set stays small.
        F.size(F.collect_set("tcp_flags")).cast("long").alias("unique_tcp_flags"),
        # One least packet gives all of them, so equal times never mix two packets.
        *[F.min(F.struct(ts, *tie_break, *first_columns)).getField(c).alias(c) for c in first_columns],
    ]


def with_rates(flows: DataFrame) -> DataFrame:
    """A2. Duration in seconds, and packets and bytes per second (the count itself at zero duration)."""
    seconds = (epoch_micros("flow_end") - epoch_micros("flow_start")) / 1_000_000
    flows = flows.withColumn("flow_duration_seconds", seconds)
    return flows.withColumns({
        f"{unit}_per_second": F.when(
            F.col("flow_duration_seconds") > 0, F.col(column) / F.col("flow_duration_seconds")
        ).otherwise(F.col(column).cast("double"))
        for unit, column in (("packets", "packet_count"), ("bytes", "byte_count"))
    })


def session_flows(
    packets: DataFrame,
    keys: Sequence[str] = FLOW_KEYS,
    ts: str = "timestamp",
    timeout_seconds: int = 60,
    first_columns: Sequence[str] = ("source_type",),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """W1 + A1 + A2 in one scan and one shuffle: one row per key and session (without the median).

    A gap splits when its whole seconds exceed the timeout, hence the session gap of one second less
    one microsecond more. With ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` sessions
    merge before the shuffle, so a hot key sends sessions instead of packets. ``first_columns`` come
    from one packet, the first by time, then ``tie_break``, then their own values.
    """
    if timeout_seconds <= 0:
        raise ValueError("timeout_seconds must be greater than zero")
    gap = F.session_window(F.col(ts), f"{timeout_seconds}.999999 seconds")
    flows = packets.filter(F.col(ts).isNotNull()).groupBy(*keys, gap.alias("__session")).agg(
        *_flow_statistics(ts, first_columns, tie_break))
    return with_rates(flows.drop("__session"))


def numbered_packets(segmented: DataFrame, keys: Sequence[str] = FLOW_KEYS, ts: str = "timestamp",
                     extra: Sequence[str] = ("source_type",)) -> DataFrame:
    """What :func:`aggregate_flows` and :func:`flow_medians` read of the numbered packets, written once for both."""
    columns = [*keys, ts, *extra, "flow_segment", "packet_count", "byte_count", "ttl", "tcp_window_size", "tcp_flags"]
    return cut_lineage(segmented.select(*dict.fromkeys(columns)))


def aggregate_flows(segmented: DataFrame, keys: Sequence[str] = FLOW_KEYS, ts: str = "timestamp",
                    first_columns: Sequence[str] = ("source_type",), tie_break: Sequence[str] = ()) -> DataFrame:
    """A1 + A2 over packets numbered by :func:`segment_flows`."""
    return with_rates(segmented.groupBy(*keys, "flow_segment").agg(*_flow_statistics(ts, first_columns, tie_break)))


def flow_medians(segmented: DataFrame, keys: Sequence[str] = FLOW_KEYS, ts: str = "timestamp") -> DataFrame:
    """A1. Exact median packet size per flow, next to (keys, flow_segment)."""
    slim = segmented.select(*keys, "flow_segment", "byte_count")
    return grouped_percentiles(slim, [*keys, "flow_segment"], "byte_count", {"packet_size_median": 0.5})


def source_features(flows: DataFrame) -> DataFrame:
    """A3."""
    return flows.groupBy("src_ip").agg(
        distinct_with_null(F.col("dst_ip")).alias("src_unique_destinations"),
        distinct_with_null(F.col("dst_port")).alias("src_unique_destination_ports"),
        distinct_with_null(F.col("src_port")).alias("src_unique_source_ports"),
        F.count("*").alias("src_flow_count"),
        F.sum("byte_count").alias("src_total_bytes"),
    )


def destination_features(flows: DataFrame) -> DataFrame:
    """A4."""
    return flows.groupBy("dst_ip").agg(
        distinct_with_null(F.col("src_ip")).alias("dst_unique_sources"),
        distinct_with_null(F.col("dst_port")).alias("dst_unique_ports"),
        F.count("*").alias("dst_flow_count"),
        F.sum("byte_count").alias("dst_total_bytes"),
    )


def add_directional_features(flows: DataFrame) -> DataFrame:
    """J1. Attach A3 and A4; a NULL address matches nothing. AQE splits a hot address."""
    require_columns(flows, ["src_ip", "dst_ip", "src_port", "dst_port"], "Flow table")
    return flows.join(source_features(flows), "src_ip", "left").join(
        destination_features(flows), "dst_ip", "left"
    )


def add_ratio_features(flows: DataFrame) -> DataFrame:
    """A5."""
    return flows.withColumns({
        "bytes_per_packet": safe_ratio(F.col("byte_count"), F.col("packet_count")),
        "src_average_bytes_per_flow": safe_ratio(F.col("src_total_bytes"), F.col("src_flow_count")),
        "dst_average_bytes_per_flow": safe_ratio(F.col("dst_total_bytes"), F.col("dst_flow_count")),
    })


def build_flows(packets: DataFrame, keys: Sequence[str] = FLOW_KEYS, timeout_seconds: int = 60,
                tie_break: Sequence[str] = (), bucket_seconds: int = 3600, with_median: bool = True) -> DataFrame:
    """Packets to flows with size, rate, directional and ratio features.

    The exact median needs the session of every packet, a second pass; leave it out where it is not read.
    """
    require_columns(packets, [*keys, "timestamp", "packet_count", "byte_count"], "Event table")
    prepared = prepare_events(packets)
    if with_median:
        segmented = segment_flows(prepared, keys, "timestamp", tie_break, timeout_seconds, bucket_seconds)
        segmented = numbered_packets(segmented, keys, extra=("source_type", *tie_break))
        medians = flow_medians(segmented, keys)
        flows = aggregate_flows(segmented, keys, tie_break=tie_break)
        same = [flows[c].eqNullSafe(medians[c]) for c in (*keys, "flow_segment")]
        flows = flows.join(medians, same, "left").select(*[flows[c] for c in flows.columns], "packet_size_median").drop(
            "flow_segment")
    else:
        flows = session_flows(prepared, keys, "timestamp", timeout_seconds, tie_break=tie_break)
    return add_ratio_features(add_directional_features(flows))
