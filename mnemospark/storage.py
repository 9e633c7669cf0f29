"""Tables written to the shared folder: how iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: spark.checkpoint.dir, or the context's checkpoint folder.

    A local session (tests) that names neither gets a folder of its own; on a
    cluster that is an error, as no folder of one machine will do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/mnemospark/{name}-{uuid.uuid4().hex}"


#: Spark's own setting that drops a query's shuffle files when it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that one partition gets of what is shuffled, about; and the setting that deals them out.
PART_ROWS = 500_000
_PARTITIONS = "spark.sql.shuffle.partitions"


def partitions(spark: SparkSession, rows: int) -> int:
    """How many partitions keep a task's memory bounded however many rows are shuffled: the session's number at least."""
    return max(int(spark.conf.get(_PARTITIONS)), -(-rows // PART_ROWS))


def cut(df: DataFrame, name: str, compression: str = "snappy", rows: int = 0) -> DataFrame:
    """df as a stored table: later reads neither recompute it nor depend on one executor.

    rows: about how many its computation shuffles, for the number of partitions.

    What its computation shuffled is of no use once it is stored, so those
    files go at once and not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before, parts = spark.conf.get(_DROP_SHUFFLES, None), spark.conf.get(_PARTITIONS)
    spark.conf.set(_DROP_SHUFFLES, "true")
    spark.conf.set(_PARTITIONS, str(partitions(spark, rows)))
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_PARTITIONS, parts)
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
