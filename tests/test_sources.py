"""Raster files, tile tables and products."""

from pyspark.sql import functions as F

from orograph.sources import rasters


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "hill.asc").write_text("ncols 3\nnrows 2\ncellsize 1\nNODATA_value -1\n1 2.5 -1\n-9999 1e3 nan\n")
    (tmp_path / "flat.asc").write_text("ncols 2\nnrows 1\n7 8\n")
    got = {(r.scene, r.r, r.c): r.z for r in rasters.read_ascii_grids(spark, str(tmp_path)).collect()}
    assert got == {("hill", 0, 0): 1.0, ("hill", 0, 1): 2.5, ("hill", 0, 2): None, ("hill", 1, 0): None, ("hill", 1, 1): 1000.0, ("hill", 1, 2): None, ("flat", 0, 0): 7.0, ("flat", 0, 1): 8.0}


def test_tiles_round_trip(spark):
    px = spark.range(300).select(F.lit("s").alias("scene"), (F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("z"))
    tiles = rasters.to_tiles(px, 8)
    assert tiles.count() == 6
    assert sorted(map(str, rasters.from_tiles(tiles).collect())) == sorted(map(str, px.collect()))


def test_products_are_pruned_and_described(spark, tmp_path):
    px = spark.range(40).select(F.lit("s").alias("scene"), F.when(F.col("id") < 20, "dsm").otherwise("dtm").alias("product"), (F.col("id") % 20 / 5).cast("int").alias("r"), (F.col("id") % 5).cast("int").alias("c"), F.col("id").cast("double").alias("z"))
    rasters.write_products(px, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).filter("product = 'dsm'")
    assert back.count() == 20
    assert "PartitionFilters: [isnotnull(product" in back._jdf.queryExecution().toString()
    meta = rasters.product_meta(px).first()["meta"]
    assert '"product":"dsm"' in meta and '"height":4' in meta and '"valid":1.0' in meta


def test_ascii_rows(spark, tmp_path):
    px = spark.createDataFrame([("a", 0, 1, None), ("a", 0, 0, 1.0), ("a", 1, 0, 2.0), ("a", 1, 1, 3.5)], "scene string, r int, c int, z double")
    rasters.write_ascii_rows(px, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1.0 -9999.0", "2.0 3.5"]


def test_grids_indexes_and_logs_are_written(spark, tmp_path):
    from pyspark.sql import functions as F

    from orograph.sources import sinks

    px = spark.range(600).select(F.lit("s").alias("scene"), F.floor(F.col("id") / 2).cast("int").alias("r"), (F.col("id") % 2).cast("int").alias("c"), F.col("id").cast("double").alias("z"))
    on = sinks.on_grid(px.filter("r < 10"), px)
    sinks.write_grid(on, str(tmp_path / "grid"))
    back = spark.read.parquet(str(tmp_path / "grid"))
    assert back.count() == 600 and back.filter("z is not null").count() == 20 and back.filter("band = 0").agg(F.max("r")).first()[0] == 255
    for version in (1, 2):
        sinks.write_index(px.select("scene").distinct(), str(tmp_path / "index"), version=version)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "index")).collect()] == [("s", 2)]
    for step in range(3):
        sinks.append_log(spark.createDataFrame([(step, 0.5)], "step int, loss double"), str(tmp_path / "log"))
    assert sorted(r.step for r in spark.read.json(str(tmp_path / "log")).collect()) == [0, 1, 2]
