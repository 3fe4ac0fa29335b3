"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import Rounds, checkpoint_dir, cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(parts))


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand at most ``rows`` rows to Python at once; row queue, Arrow vectors and worker hold a batch each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder as compressed Parquet and read it back.

    The table outlives any executor; the folder named by ``spark.checkpoint.dir`` is scratch space
    that its owner empties between jobs.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node reachable over the undirected edges (src, dst).

    Alternating large-star and small-star rounds until one changes nothing: logarithmically many in
    the longest path. The least neighbours are cut off as tables of their own, so that both sides
    of each join are shuffled and a hub with any number of neighbours is split by AQE.
    """

    def least_neighbour(links: DataFrame) -> DataFrame:
        return cut_lineage(links.groupBy("u").agg(F.min("v").alias("m")))

    rounds, mark = Rounds(edges.sparkSession), None
    links = rounds.keep(edges.filter(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(both.filter(F.col("v") > F.col("u")).join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = least_neighbour(large)
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        links = rounds.keep(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def as_bytes(texts: pa.Array) -> Iterator[bytes | None]:
    """The values one at a time, so that a batch is not held twice."""
    return (value.as_py() for value in texts.cast(pa.binary()))


def batches_of_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups, one at a time, from batches sorted by ``keys``; only one group is held over."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[begin] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the least row number reachable over it."""
    root = np.arange(len(linked))
    while True:
        seen = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        best = np.minimum(root, seen)
        best = best[best]
        if np.array_equal(best, root):
            return root
        root = best
