"""Streams fed file by file."""

import datetime as dt

from pyspark.sql import functions as F

from packetloom.streaming import jobs as st

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("timestamp timestamp, event_id long, src_ip string, dst_ip string, src_port long, dst_port long, protocol string, "
          "packet_count long, byte_count double, ttl long, tcp_window_size long, tcp_flags string, source_type string")


def put(spark, folder, name, seconds, src="a"):
    rows = [(T0 + dt.timedelta(seconds=s), i, src, "b", 1, 80 + i % 2, "TCP", 1, 10.0, 64, 1, "S", "t") for i, s in enumerate(seconds)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(rows, tmp_path, name):
    out = tmp_path / name
    st.run_to_files(rows, str(out / "rows"), str(out / "state")).awaitTermination()
    return rows.sparkSession.read.parquet(str(out / "rows"))


def test_late_rows_are_dropped(spark, tmp_path):
    put(spark, tmp_path / "in", "1", [0, 1, 5])
    put(spark, tmp_path / "in", "2", [200])
    put(spark, tmp_path / "in", "3", [205])  # the watermark of one batch rejects rows of the batch after next
    put(spark, tmp_path / "in", "4", [3])
    put(spark, tmp_path / "in", "5", [400])
    states = st.streaming_window_states(st.with_event_time(stream(spark, tmp_path / "in")), "10 seconds")
    got = {r["window_start"]: r for r in run(states, tmp_path, "states").collect()}
    assert got[T0]["event_count"] == 3 and got[T0]["unique_destination_ports"] == 2 and got[T0]["total_bytes"] == 30


def test_sessions_across_batches(spark, tmp_path):
    put(spark, tmp_path / "in", "1", [0, 30])
    put(spark, tmp_path / "in", "2", [60.5, 90.5])  # gap of 30.5 s: same session at a timeout of 30
    put(spark, tmp_path / "in", "3", [121.5, 1000])  # gap of 31 s: a new one
    put(spark, tmp_path / "in", "4", [2000])
    flows = st.streaming_flows(st.with_event_time(stream(spark, tmp_path / "in")), ["src_ip"], 30)
    got = sorted((r["flow_start"], r["packet_count"]) for r in run(flows, tmp_path, "flows").collect())
    assert [n for _, n in got][:2] == [4, 1]


def test_recent_buffer(spark, tmp_path):
    put(spark, tmp_path / "in", "1", range(150), "a")
    put(spark, tmp_path / "in", "2", range(150, 300), "a")
    put(spark, tmp_path / "in", "3", range(20), "c")
    events = stream(spark, tmp_path / "in").select(
        F.col("src_ip").alias("stream_key"), F.unix_micros("timestamp").alias("created_at"), F.unix_micros("timestamp").alias("event_id"),
        F.lit("{}").alias("payload"))
    seen = {}

    def collect(batch, _):
        for r in batch.collect():
            seen[r["stream_key"]] = r

    query = st.recent_events(events).writeStream.outputMode("update").foreachBatch(collect).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    micros = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert (seen["a"]["events"], seen["c"]["events"]) == (200, 20)
    assert (seen["a"]["oldest_id"], seen["a"]["newest_id"]) == (micros + 100_000_000, micros + 299_000_000)


def test_store_and_forecast(spark, tmp_path):
    put(spark, tmp_path / "in", "1", range(5), "a")
    put(spark, tmp_path / "in", "2", range(5), "c")
    rows = stream(spark, tmp_path / "in").withColumn("stream_key", F.col("src_ip"))
    handler = st.store_and_forecast(str(tmp_path / "store"), str(tmp_path / "result"))
    st.run_micro_batches(rows, handler, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store/events")).count() == 10
    assert spark.read.parquet(str(tmp_path / "store/recent/batch=1")).count() == 10
    got = spark.read.parquet(str(tmp_path / "result")).collect()
    assert {r["stream_key"] for r in got} == {"a", "c"} and all(0 <= r["forecasted_risk"] <= 1 for r in got)


def start(rows, handle, folder):
    rows.writeStream.outputMode("update").foreachBatch(handle).option(
        "checkpointLocation", str(folder)).trigger(availableNow=True).start().awaitTermination()


def test_buffers_keep_whole_events_and_can_be_read(spark, tmp_path):
    put(spark, tmp_path / "in", "1", range(8), "a")
    put(spark, tmp_path / "in", "2", [20.000001, 2.5], "a")
    put(spark, tmp_path / "in", "3", [1], "c")
    rows = stream(spark, tmp_path / "in").withColumn("stream_key", F.col("src_ip")).withColumn(
        "tcp_flags", F.when(F.col("event_id") == 0, F.lit(None).cast("string")).otherwise(F.col("tcp_flags")))
    seen = []

    def collect(batch, batch_id):
        seen.append(sorted((r["stream_key"], r["timestamp"]) for r in batch.collect()))
        for r in batch.collect():
            assert r["tcp_flags"] == (None if r["event_id"] == 0 else "S") and r["byte_count"] == 10.0

    start(st.buffered_events(rows, 3), collect, tmp_path / "state")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    # only the keys of a batch are given; the late 2.5 is older than the newest three
    assert seen == [[("a", at(s)) for s in (5, 6, 7)], [("a", at(s)) for s in (6, 7, 20.000001)], [("c", at(1))]]
    held = st.read_buffers(spark, str(tmp_path / "state")).collect()
    micros = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert sorted((r["stream_key"], r["created_at"] - micros) for r in held) == [
        ("a", 6_000_000), ("a", 7_000_000), ("a", 20_000_001), ("c", 1_000_000)]


def test_idle_keys_are_forgotten(spark, tmp_path):
    put(spark, tmp_path / "in", "1", [0, 1], "a")
    put(spark, tmp_path / "in", "2", [0, 500], "c")
    put(spark, tmp_path / "in", "3", [1000], "c")
    put(spark, tmp_path / "in", "4", [1001], "c")
    rows = st.with_event_time(stream(spark, tmp_path / "in")).withColumn("stream_key", F.col("src_ip"))
    start(st.buffered_events(rows, 10, idle_seconds=300), lambda batch, _: batch.count(), tmp_path / "state")
    held = st.read_buffers(spark, str(tmp_path / "state")).groupBy("stream_key").count().collect()
    assert {r["stream_key"]: r["count"] for r in held} == {"c": 4}


def test_forecast_of_buffers(spark, tmp_path):
    put(spark, tmp_path / "in", "1", range(5), "a")
    put(spark, tmp_path / "in", "2", range(5, 9), "c")
    put(spark, tmp_path / "in", "3", [100, 200], "a")
    rows = stream(spark, tmp_path / "in").withColumn("stream_key", F.col("src_ip"))
    start(st.buffered_events(rows, 6), st.forecast_buffers(str(tmp_path / "result")), tmp_path / "state")
    got = {(r["batch_id"], r["stream_key"]): r for r in spark.read.parquet(str(tmp_path / "result")).collect()}
    assert {k: r["events"] for k, r in got.items()} == {(0, "a"): 5, (1, "c"): 4, (2, "a"): 6}
    assert all(0 <= r["forecasted_risk"] <= 1 for r in got.values())
