"""Reading tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that a join may send to every task.
FEW = 100_000
#: Partitions that a shuffle is dealt to at first, and the shuffled size up to which neighbours are read as one.
PARTITIONS, TOGETHER = 200, "8m"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session (tests) that names none gets a local folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-orograph-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table survives lost executors, and later plans start from it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, rows: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``rows``, a row per group of it: written, counted, and broadcast if they are few.

    Estimates can't choose here: an aggregate counts as nearly as large as its input, and an
    exploded vector as smaller than it is, so either side might be sent through the driver, or a whole group to one task.
    """
    rows = materialize(rows, "beside")
    return df.join(F.broadcast(rows) if rows.count() <= FEW else rows, on, how)


def joins_by_measure(spark: SparkSession) -> None:
    """Let joins broadcast only what a shuffle has measured, as estimates of exploded and of compressed tables are too low."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "4m")


def shuffles_by_size(spark: SparkSession) -> None:
    """Let the size of what is shuffled, not a fixed number, say how many tasks read it, so that a task's memory does not grow with the input."""
    most = max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(most))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TOGETHER)
