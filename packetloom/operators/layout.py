"""Layouts of tables that many rounds of a loop join: hashed once, hubs dealt over salts, visited rows appended.

A checkpoint forgets how its rows were dealt, so a loop that joins it shuffles it in every round.
The tables here are bucketed files in the shared folder: joins and groupings on their keys read
them in place. Rows of a key that has more than a piece of them are dealt over salts, and the other
side of the join is copied to those salts only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import checkpoint_dir, cut_lineage

SALT = "__salt"
HUBS = 1_000_000
PIECE = 100_000


class Bucketed:
    """A table bucketed by ``keys`` that rows are appended to, under a round number each; read it with ``rows``.

    The files lie in the shared checkpoint folder; ``drop`` takes the table out of the catalog and deletes
    them, and is to be called once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str]):
        self.spark, self.keys = spark, list(keys)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"packetloom_{uuid.uuid4().hex}"
        self.name, self.path = name, f"{checkpoint_dir(spark)}/{name}"

    def append(self, rows: DataFrame, number: int = 0, dealt: bool = False) -> None:
        """Append a round; ``dealt`` rows lie by key already, as what is grouped beside this table does, and are not shuffled again."""
        placed = (rows if dealt else rows.repartition(self.buckets, *self.keys)).withColumn("__round", F.lit(number))
        placed.write.format("parquet").mode("append").option("path", self.path).partitionBy("__round").bucketBy(
            self.buckets, *self.keys).saveAsTable(self.name)

    def rows(self, number: int | None = None) -> DataFrame:
        """All rows, or those of one round, without the round's number."""
        whole = self.spark.table(self.name)
        return (whole if number is None else whole.filter(F.col("__round") == number)).drop("__round")

    def numbered(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def piece_size(rows: int, least: int = PIECE) -> int:
    """Rows of one key that stay together: so many that at most HUBS keys have more."""
    return max(least, -(-rows // HUBS))


class Hubs:
    """The keys of ``counted`` (key, n) with more than ``piece`` rows, and over how many salts each is dealt.

    There are at most HUBS of them by the size of a piece, so they may be broadcast.
    """

    def __init__(self, counted: DataFrame, key: str, piece: int):
        self.key = key
        self.table = cut_lineage(counted.filter(F.col("n") > piece).select(
            F.col(key).alias("__hub"), F.ceil(F.col("n") / piece).cast("int").alias("__salts")))

    def _with_salts(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.join(F.broadcast(self.table), F.col(key) == F.col("__hub"), "left").drop("__hub")

    def deal(self, rows: DataFrame, spread: Column) -> DataFrame:
        """Rows with a salt: 0, or one of the hub's by the hash of ``spread``."""
        salted = F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")), F.lit(0)).cast("int")
        return self._with_salts(rows, self.key).withColumn(SALT, salted).drop("__salts")

    def copy(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows under every salt of their key: one row each, hubs as many as they have salts."""
        every = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias(SALT)
        return self._with_salts(rows, key).select("*", every).drop("__salts")


def dealt_links(links: DataFrame, key: str, other: str, piece: int) -> tuple[Bucketed, Hubs]:
    """Links bucketed by (key, salt), and the hubs of ``key``."""
    hubs = Hubs(links.groupBy(key).agg(F.count("*").alias("n")), key, piece)
    table = Bucketed(links.sparkSession, [key, SALT])
    table.append(hubs.deal(links, F.col(other)))
    return table, hubs
