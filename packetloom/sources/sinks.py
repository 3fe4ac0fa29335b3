"""Log source and result sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REJECT_FIELDS = ["source_file", "row_number", "reason", "raw_timestamp", "raw_label"]


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """S13. Text lines of uploaded logs."""
    return spark.read.text(path)


def write_graph_dataset(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """S9. Nodes, edges, snapshots, mapping and samples below one folder; existing output is refused.

    ``fmt`` is parquet, or json / csv for gzip text.
    """
    for name, table in tables.items():
        writer = table.write.mode("errorifexists")
        if fmt == "parquet":
            writer.parquet(f"{path}/{name}")
        elif fmt == "json":
            writer.option("compression", "gzip").json(f"{path}/{name}")
        else:
            flat = {c: F.to_json(c) for c, t in table.dtypes if t.startswith(("array", "struct", "map"))}
            table.withColumns(flat).write.mode("errorifexists").option("compression", "gzip").csv(f"{path}/{name}", header=True)


def write_snapshot(artifact: DataFrame, path: str) -> None:
    """S10. The graph snapshot rows, clustered by window."""
    artifact.repartitionByRange("window_index").sortWithinPartitions("window_index").write.mode("errorifexists").option(
        "compression", "gzip").json(path)


def split_rejects(classified: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """S11. Good rows, and the reject log."""
    return classified.filter(F.col(reason).isNull()).drop(reason), classified.filter(F.col(reason).isNotNull()).select(
        *[c for c in REJECT_FIELDS if c in classified.columns])


def write_predictions(rows: DataFrame, path: str, fields: Sequence[str], keys: Sequence[str] = ("source_file", "window_start")) -> None:
    """S12. Predictions as CSV with a fixed field order, sorted by key."""
    rows.select(*fields).orderBy(*keys).write.mode("errorifexists").csv(path, header=True)


def latest_per_stream(events: DataFrame, n: int = 200, stream: str = "stream_key", created: str = "created_at",
                      tie_break: str = "event_id") -> DataFrame:
    """S14. The newest n events of each stream, oldest first by ``position``.

    A hot stream is cut down by rank inside hashed parts before its survivors meet, so no task sees
    more than n rows per part of it.
    """
    newest = [F.desc(created), F.desc(tie_break)]
    part = F.pmod(F.xxhash64(tie_break), F.lit(256))
    local = events.withColumn("__part", part).withColumn(
        "__rank", F.row_number().over(Window.partitionBy(stream, "__part").orderBy(*newest))).filter(F.col("__rank") <= n)
    ranked = local.withColumn("__rank", F.row_number().over(Window.partitionBy(stream).orderBy(*newest))).filter(
        F.col("__rank") <= n)
    kept = F.count("*").over(Window.partitionBy(stream))
    return ranked.withColumn("position", kept - F.col("__rank") + 1).drop("__rank", "__part")


def sort_by_time(rows: DataFrame, ts: str = "timestamp", *tie_break: str) -> DataFrame:
    """T1. Time order for a sink."""
    return rows.orderBy(ts, *tie_break)
