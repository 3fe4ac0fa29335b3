"""Fixed-window network states of the event path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.numeric import distinct_with_null, pct_change, safe_ratio
from packetloom.operators.flows import require_columns
from packetloom.operators.ordered import owned_rows, row_index, time_bucket, with_halo
from packetloom.session import cut_lineage

TREND_COLUMNS = ("flow_count", "total_packets", "total_bytes", "unique_destinations", "unique_destination_ports")
ROLLING_LENGTHS = (3, 6, 12)
DISTINCT_COLUMNS = {
    "unique_sources": "src_ip",
    "unique_destinations": "dst_ip",
    "unique_source_ports": "src_port",
    "unique_destination_ports": "dst_port",
    "unique_protocols": "protocol",
}


def window_start(ts: str | Column, seconds: int) -> Column:
    """F8. Start of the epoch-aligned window holding ``ts``."""
    return F.window(F.col(ts) if isinstance(ts, str) else ts, f"{seconds} seconds").start


def window_states(flows: DataFrame, window_seconds: int = 10, stream: Sequence[str] = ()) -> DataFrame:
    """A6 + A7 + A8 (and the J2 join folded in): one aggregation per non-empty window.

    The diversity columns equal three of the distinct counts, so one scan serves both.
    """
    require_columns(flows, ["flow_start", *DISTINCT_COLUMNS.values(), "packet_count", "byte_count"], "Flow table")

    def mean_or_zero(column: str) -> Column:
        return F.coalesce(F.avg(column), F.lit(0.0))

    states = flows.groupBy(*stream, window_start("flow_start", window_seconds).alias("window_start")).agg(
        F.count("*").alias("flow_count"),
        *[distinct_with_null(F.col(c)).alias(n) for n, c in DISTINCT_COLUMNS.items()],
        F.sum("packet_count").alias("total_packets"),
        F.sum("byte_count").alias("total_bytes"),
        mean_or_zero("flow_duration_seconds").alias("mean_flow_duration"),
        F.coalesce(F.stddev_samp("flow_duration_seconds"), F.lit(0.0)).alias("std_flow_duration"),
        mean_or_zero("packet_size_mean").alias("mean_packet_size"),
        mean_or_zero("packets_per_second").alias("mean_packet_rate"),
        mean_or_zero("bytes_per_second").alias("mean_byte_rate"),
    )
    seconds = F.lit(float(window_seconds))
    return states.withColumns({
        "packets_per_window_second": F.col("total_packets") / seconds,
        "bytes_per_window_second": F.col("total_bytes") / seconds,
        "average_packets_per_flow": safe_ratio(F.col("total_packets"), F.col("flow_count")),
        "average_bytes_per_flow": safe_ratio(F.col("total_bytes"), F.col("flow_count")),
        "destination_diversity": F.col("unique_destinations"),
        "port_diversity": F.col("unique_destination_ports"),
        "source_diversity": F.col("unique_sources"),
    })


def indexed_states(states: DataFrame, stream: Sequence[str] = (), bucket_seconds: int = 86400) -> DataFrame:
    """Number the windows of each stream in time order.

    States number at most one per window and stream, so they are written once here rather than
    aggregated from the flows again for every branch that follows.
    """
    return row_index(cut_lineage(states), list(stream), ["window_start"], time_bucket("window_start", bucket_seconds))


def add_trend_features(
    states: DataFrame,
    stream: Sequence[str] = (),
    columns: Sequence[str] = TREND_COLUMNS,
    lengths: Sequence[int] = ROLLING_LENGTHS,
    rolling: bool = True,
    change: bool = True,
) -> DataFrame:
    """W2-W5. Rolling mean/std over the last rows and change to the previous row."""
    columns = [c for c in columns if c in states.columns]
    spread, order = with_halo(indexed_states(states, stream), stream, "row_index", max([*lengths, 2]) - 1, 0)
    added: dict[str, Column] = {}
    for column in columns:
        value = F.col(column)
        if rolling:
            for length in lengths:
                frame = order.rowsBetween(-(length - 1), 0)
                added[f"{column}_rolling_mean_{length}"] = F.avg(value).over(frame)
                added[f"{column}_rolling_std_{length}"] = F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0))
        if change:
            before = F.lag(value).over(order)
            added[f"{column}_change"] = F.coalesce(value - before, F.lit(0).cast(dict(states.dtypes)[column]))
            added[f"{column}_pct_change"] = pct_change(value, before)
    return owned_rows(spread.withColumns(added)).drop("row_index")


def create_sequences(
    states: DataFrame,
    feature_columns: Sequence[str],
    sequence_length: int = 6,
    prediction_horizon: int = 1,
    stream: Sequence[str] = (),
) -> DataFrame:
    """W12. Histories of L states with the single state H rows ahead as target."""
    if sequence_length <= 0 or prediction_horizon <= 0:
        raise ValueError("sequence_length and prediction_horizon must be greater than zero")
    require_columns(states, feature_columns, "State table")
    state = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_columns])
    indexed = indexed_states(states, stream).select(*stream, "window_start", "row_index", state.alias("state"))
    spread, order = with_halo(indexed, stream, "row_index", sequence_length - 1, prediction_horizon)
    built = spread.withColumns({
        "history": F.collect_list("state").over(order.rowsBetween(-(sequence_length - 1), 0)),
        "target": F.lead("state", prediction_horizon).over(order),
        "target_window_start": F.lead("window_start", prediction_horizon).over(order),
    })
    return (
        owned_rows(built)
        .filter((F.size("history") == sequence_length) & F.col("target").isNotNull())
        .select(*stream, "window_start", "target_window_start", "history", "target")
    )
