"""Structured Streaming forms of the event path (M1-M8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from packetloom.operators.flows import FLOW_KEYS, session_flows
from packetloom.session import cut_lineage

DEFAULT_DELAY = "60 seconds"
BUFFER_SIZE = 200
WINDOW_DIMENSIONS = {
    "unique_sources": "src_ip", "unique_destinations": "dst_ip", "unique_source_ports": "src_port",
    "unique_destination_ports": "dst_port", "unique_protocols": "protocol",
}


def read_event_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int | None = None,
                      name_pattern: str | None = None) -> DataFrame:
    """M1. Events from the files of a folder as they arrive."""
    reader = spark.readStream.format(fmt).schema(schema)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def with_event_time(events: DataFrame, ts: str = "timestamp", delay: str = DEFAULT_DELAY) -> DataFrame:
    """M6. A zoned event time with a watermark; rows later than the delay are dropped by stateful operators."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_micro_batches(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                      trigger: dict | None = None) -> StreamingQuery:
    """M1. Hand every micro-batch to a callback."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def run_to_files(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append finished rows to Parquet files."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def streaming_flows(events: DataFrame, keys: Sequence[str] = FLOW_KEYS, timeout_seconds: int = 60, ts: str = "timestamp",
                    first_columns: Sequence[str] = ("source_type",)) -> DataFrame:
    """M5. Sessions of a watermarked stream, each emitted once it can no longer grow."""
    return session_flows(events, keys, ts, timeout_seconds, first_columns)


def streaming_window_states(events: DataFrame, window: str = "10 seconds", ts: str = "timestamp") -> DataFrame:
    """M4. Tumbling states of a watermarked stream, with exact distinct counts.

    Distinct values are first grouped per (window, dimension, value), whose state is one row per
    value; a second aggregation on the same window counts them. No set is held for a window.
    """
    def fact(dimension, value, packets, bytes_):
        return F.struct(F.lit(dimension).alias("dimension"), value.alias("value"), F.coalesce(packets, F.lit(0.0)).alias("packets"),
                        F.coalesce(bytes_, F.lit(0.0)).alias("bytes"))

    none = F.lit(0.0)
    facts = F.array(
        fact("all", F.lit(""), F.col("packet_count").cast("double"), F.col("byte_count").cast("double")),
        *[fact(name, F.coalesce(F.col(column).cast("string"), F.lit("\u0000")), none, none)
          for name, column in WINDOW_DIMENSIONS.items()])
    values = events.select(ts, F.explode(facts).alias("f")).groupBy(
        F.window(ts, window).alias("window"), F.col("f.dimension").alias("dimension"), F.col("f.value").alias("value")).agg(
        F.count("*").alias("n"), F.sum("f.packets").alias("packets"), F.sum("f.bytes").alias("bytes"))
    whole = F.col("dimension") == "all"
    return values.groupBy(F.window(F.window_time("window"), window).alias("window")).agg(
        F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("event_count"),
        F.sum("packets").alias("total_packets"), F.sum("bytes").alias("total_bytes"),
        *[F.count_if(F.col("dimension") == name).alias(name) for name in WINDOW_DIMENSIONS],
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_count",
             "total_packets", "total_bytes", *WINDOW_DIMENSIONS)


def sliding_scan(events: DataFrame, history: str = "200 seconds", stride: str = "50 seconds", ts: str = "timestamp",
                 keys: Sequence[str] = ()) -> DataFrame:
    """M8. Overlapping history windows, one every stride."""
    return events.groupBy(*keys, F.window(ts, history, stride).alias("window")).agg(
        F.count("*").alias("event_count"), F.sum("byte_count").alias("total_bytes"), F.max("byte_count").alias("peak_bytes")
    ).select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_count",
             "total_bytes", "peak_bytes")


class RecentEvents(StatefulProcessor):
    """M3. Keeps the newest n events of a stream key, whatever order batches bring them in.

    With ``idle_seconds``, a key whose newest event lies that far behind the watermark is forgotten.
    ``whole`` gives the buffered events of each key of a batch, else one row about its buffer.
    """

    def __init__(self, n: int = BUFFER_SIZE, idle_seconds: float | None = None, whole: bool = False) -> None:
        self.n, self.idle, self.whole = n, idle_seconds, whole

    def init(self, handle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("recent", "created_at long, event_id long, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        kept = list(self.buffer.get()) if self.buffer.exists() else []
        for frame in rows:
            kept += list(frame[["created_at", "event_id", "payload"]].itertuples(index=False, name=None))
            kept = sorted(kept, key=lambda r: (r[0], r[1]))[-self.n:]
        self.buffer.put(kept)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            forget = int(kept[-1][0]) // 1000 + int(self.idle * 1000)
            # An event later than the whole idle time still counts, until the watermark moves on.
            self.handle.registerTimer(max(forget, timer_values.getCurrentWatermarkInMs() + 1))
        if self.whole:
            frame = pd.DataFrame([tuple(r) for r in kept], columns=["created_at", "event_id", "payload"])
            yield frame.assign(stream_key=key[0])[["stream_key", "created_at", "event_id", "payload"]]
        else:
            yield pd.DataFrame({
                "stream_key": [key[0]], "events": [len(kept)], "oldest_id": [int(kept[0][1])], "newest_id": [int(kept[-1][1])]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.buffer.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def recent_events(events: DataFrame, n: int = BUFFER_SIZE, idle_seconds: float | None = None) -> DataFrame:
    """M3. Buffer report per stream key after each batch; state is at most n rows per key.

    Needs columns stream_key, created_at (microseconds), event_id, payload and the RocksDB state
    store; with ``idle_seconds`` also a watermarked event time.
    """
    return events.groupBy("stream_key").transformWithStateInPandas(
        statefulProcessor=RecentEvents(n, idle_seconds),
        outputStructType="stream_key string, events long, oldest_id long, newest_id long",
        outputMode="Update", timeMode="None" if idle_seconds is None else "EventTime")


def buffered_events(events: DataFrame, n: int = BUFFER_SIZE, idle_seconds: float | None = None, ts: str = "timestamp") -> DataFrame:
    """M3. The newest n events of every stream key that a batch brings events of, with all columns.

    ``events`` has stream_key, event_id and a zoned event time; the other columns travel through the
    state as one JSON text, so that NULLs and any column types keep. Events without key, id or time
    are left out.
    """
    stamp = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    packed = events.filter(F.col("stream_key").isNotNull() & F.col("event_id").isNotNull() & F.col(ts).isNotNull()).select(
        "stream_key", ts, F.unix_micros(ts).alias("created_at"), F.col("event_id").cast("long").alias("event_id"),
        F.to_json(F.struct(*events.columns), stamp).alias("payload"))
    kept = packed.groupBy("stream_key").transformWithStateInPandas(
        statefulProcessor=RecentEvents(n, idle_seconds, whole=True),
        outputStructType="stream_key string, created_at long, event_id long, payload string",
        outputMode="Update", timeMode="None" if idle_seconds is None else "EventTime")
    return kept.select(F.from_json("payload", events.schema, stamp).alias("event")).select("event.*")


def read_buffers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """M3. The buffers that a query of :func:`recent_events` or :func:`buffered_events` holds, as a table."""
    state = spark.read.format("statestore").option("stateVarName", "recent").load(checkpoint)
    return state.select("key.stream_key", "list_element.*")


def forecast_buffers(result: str, timeout_seconds: int = 60, window_seconds: int = 10) -> Callable[[DataFrame, int], None]:
    """M2. A handler for batches of :func:`buffered_events`: rerun flows, states, forecast and verdict on the
    buffers of the keys of the batch. Its cost follows the batch and n, not the number of keys ever seen.
    """
    def handle(buffers: DataFrame, batch_id: int) -> None:
        _forecasts(cut_lineage(buffers), timeout_seconds, window_seconds).withColumn("batch_id", F.lit(batch_id)).write.mode(
            "overwrite").parquet(f"{result}/run={batch_id}")

    return handle


def _forecasts(newest: DataFrame, timeout_seconds: int, window_seconds: int) -> DataFrame:
    """One row per stream key: risk, verdict and the sizes of what it rests on.

    A key has at most n events, so its set of hosts is a small cell. Events without an endpoint are no edges.
    """
    from packetloom.functions.risk import verdict
    from packetloom.operators.models import heuristic_forecast
    from packetloom.operators.windows import window_states

    flows = cut_lineage(session_flows(newest, ["stream_key", *FLOW_KEYS], "timestamp", timeout_seconds))
    states = cut_lineage(window_states(flows, window_seconds, ["stream_key"]))
    features = [c for c, t in states.dtypes if t in ("bigint", "double")]
    vectors = states.select("stream_key", "window_start", F.array(*[F.col(c).cast("double") for c in features]).alias("state"))
    time = F.struct("timestamp", "event_id")
    used = newest.groupBy("stream_key").agg(
        F.count("*").alias("events"), F.min_by("event_id", time).alias("oldest_id"), F.max_by("event_id", time).alias("newest_id"),
        F.size(F.array_union(F.collect_set("src_ip"), F.collect_set("dst_ip"))).cast("long").alias("graph_nodes"),
        F.count_distinct("src_ip", "dst_ip").alias("graph_edges"))
    forecast = heuristic_forecast(vectors, "state", "window_start", ["stream_key"])
    for sizes in (used, flows.groupBy("stream_key").agg(F.count("*").alias("flows")),
                  states.groupBy("stream_key").agg(F.count("*").alias("network_states"))):
        forecast = forecast.join(sizes, "stream_key")
    return forecast.withColumns(dict(verdict(F.col("forecasted_risk"))))


def store_and_forecast(store: str, result: str, timeout_seconds: int = 60, window_seconds: int = 10, n: int = BUFFER_SIZE):
    """M2. A micro-batch handler: append the events, then rerun the event path on the newest n of each
    stream key seen in the batch, and append one forecast per key. Keys share one job.

    The newest events live in a small table of their own, rewritten by each batch from the one of the
    batch before, so a batch never reads the whole store. A batch repeated after a failure rewrites
    its own folders and nothing else.
    """
    from packetloom.sources.sinks import latest_per_stream

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/events/batch={batch_id}")
        arrived = spark.read.schema(batch.schema).parquet(f"{store}/events/batch={batch_id}")
        known = arrived
        if batch_id > 0:
            known = spark.read.schema(batch.schema).parquet(f"{store}/recent/batch={batch_id - 1}").unionByName(arrived)
        latest_per_stream(known, n, "stream_key", "timestamp").drop("position").write.mode("overwrite").parquet(
            f"{store}/recent/batch={batch_id}")
        newest = spark.read.schema(batch.schema).parquet(f"{store}/recent/batch={batch_id}").join(
            arrived.select("stream_key").distinct(), "stream_key", "left_semi")
        _forecasts(newest, timeout_seconds, window_seconds).withColumn("batch_id", F.lit(batch_id)).write.mode(
            "overwrite").parquet(f"{result}/run={batch_id}")

    return handle
