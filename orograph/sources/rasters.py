"""Raster files and tile tables: readers to the pixel table, writers from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.sources.adapters import clean


def read_ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """ESRI ASCII grids (a header of ``name value`` lines, then rows of numbers) as (scene, r, c, z).

    Files are split over tasks; a file is parsed with built-in functions. The header's
    nodata value and the usual sentinels become null.
    """
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("scene"), "value")
    t = t.select("scene", F.filter(F.split("value", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines"))
    head = F.filter("lines", lambda x: x.rlike(r"^\s*[A-Za-z]"))
    nodata = F.element_at(F.transform(F.filter(head, lambda x: x.rlike(r"(?i)^\s*nodata_value")), lambda x: F.regexp_extract(x, r"([-+0-9.eE]+)\s*$", 1).try_cast("double")), 1)
    t = t.select("scene", F.when(F.size(F.filter(head, lambda x: x.rlike(r"(?i)^\s*nodata_value"))) > 0, nodata).alias("nodata"), F.filter("lines", lambda x: ~x.rlike(r"^\s*[A-Za-z]")).alias("rows"))
    t = t.select("scene", "nodata", F.posexplode("rows").alias("r", "row"))
    t = t.select("scene", "nodata", "r", F.posexplode(F.split(F.trim("row"), r"\s+")).alias("c", "v"))
    z = F.col("v").try_cast("double")
    return t.select("scene", "r", "c", clean(F.when(~z.eqNullSafe(F.col("nodata")), z)).alias("z"))


def write_ascii_rows(px: DataFrame, path: str, nodata: float = -9999.0) -> None:
    """Rows of each scene as text, one line a row, in a folder per scene; a row is one group, so scenes of any height spread."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", F.coalesce("z", F.lit(nodata)).alias("z")))), lambda x: x["z"].cast("string")), " ")
    rows = px.groupBy("scene", "r").agg(line.alias("value"))
    rows.repartitionByRange("scene", "r").sortWithinPartitions("scene", "r").select("scene", "value").write.partitionBy("scene").mode("overwrite").text(path)


def to_tiles(px: DataFrame, tile: int) -> DataFrame:
    """(scene, tr, tc, cells): a row per tile, its cells as an array of (r, c, z) in row order; the compact form for storage."""
    t = px.withColumn("tr", F.floor(F.col("r") / tile).cast("int")).withColumn("tc", F.floor(F.col("c") / tile).cast("int"))
    return t.groupBy("scene", "tr", "tc").agg(F.array_sort(F.collect_list(F.struct("r", "c", "z"))).alias("cells"))


def from_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.select("scene", F.explode("cells").alias("k")).select("scene", "k.r", "k.c", "k.z")


def write_products(products: DataFrame, path: str) -> None:
    """(scene, product, r, c, z) as Parquet, a folder per product and scene: later reads of one product prune the others."""
    products.write.partitionBy("product", "scene").mode("overwrite").parquet(path)


def product_meta(products: DataFrame) -> DataFrame:
    """A JSON record of each scene: size, and range and share of valid pixels of each product."""
    one = products.groupBy("scene", "product").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), F.min("z").alias("min"), F.max("z").alias("max"), F.avg(F.col("z").isNotNull().cast("double")).alias("valid"))
    rec = F.struct("product", "height", "width", "min", "max", "valid")
    return one.groupBy("scene").agg(F.to_json(F.array_sort(F.collect_list(rec))).alias("meta"))
