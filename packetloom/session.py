"""Spark session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "packetloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only a local master without ``spark.checkpoint.dir`` gets a folder of its own; on a
    cluster a machine-local folder would lose its blocks together with an executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="packetloom-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that iterative plans neither grow nor depend on one executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The state that a loop carries from round to round, as Parquet in the shared folder; a round's files go when the next lies there.

    A checkpoint keeps the size that its plan was estimated at, and a join multiplies those of its sides. In a
    loop that joins its own results the estimate would gain digits exponentially, until they fill the driver;
    files are as large as they are. The last round's files are left to the owner of the folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.number = spark, 0
        self.path = f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"

    def keep(self, rows: DataFrame) -> DataFrame:
        """Write the next round, which may read the last, and read it back; what else is still to be run may not read the last."""
        self.number += 1
        rows.write.parquet(f"{self.path}/{self.number}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.number - 1}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{self.number}")
