"""Access to the Parquet tables and to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (local
    tests), a temporary folder that is then set for the session's context."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='polysema-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Bytes up to which a kept table is broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, extra: int = 0) -> bool:
    """Whether a kept table is within BROADCAST_BYTES; extra: bytes of a row beside its fixed-width columns."""
    return df.count() * (16 + 8 * len(df.columns) + extra) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """A table of fixed-width columns, marked for broadcast if it fits."""
    return F.broadcast(df) if fits(df) else df


#: Spark removes an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder and read again: this cuts lineage, so
    a lost executor costs a re-read and never a recomputation of the whole plan.
    The shuffle files behind a kept table go as soon as it is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._polysema_path = path
        return out

    def named(self, df: DataFrame, kept: DataFrame) -> DataFrame:
        """A view of a kept table that can be dropped like it."""
        df._polysema_path = kept._polysema_path
        return df

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no pending plan reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._polysema_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
