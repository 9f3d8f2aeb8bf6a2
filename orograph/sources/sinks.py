"""What runs leave behind: grids on the estimate's pixels, indexes, and logs that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def on_grid(reference: DataFrame, like: DataFrame) -> DataFrame:
    """The reference on the estimate's pixels, null where it has none."""
    return like.select("scene", "r", "c").join(reference.select("scene", "r", "c", "z"), ["scene", "r", "c"], "left")


def write_grid(px: DataFrame, path: str) -> None:
    """Pixels by scene and band of 256 rows, so that a window reads few files."""
    t = px.withColumn("band", F.floor(F.col("r") / 256).cast("int"))
    t.repartition("scene", "band").sortWithinPartitions("r", "c").write.mode("overwrite").partitionBy("scene").parquet(path)


def write_index(tiles: DataFrame, path: str, **extra: object) -> None:
    """The index of a tile set with what holds for all of it; readers see the old one or the new one, by the commit of the write."""
    tiles.withColumns({k: F.lit(v) for k, v in extra.items()}).write.mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows of a run's log as JSON lines beside those written before."""
    rows.write.mode("append").json(path)
