"""Rasters, point sets and scene tables read from plain relational tables.

The pixel table is the contract of every operator: (scene, r, c, z...), a null
where there is no data. Its adapters here read ordinary Parquet tables, so that the
same operators run on any catalogue that can be projected to these columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions.tables import load

NODATA = [-9999.0, -32767.0, -32768.0, -3.4028234663852886e38]


def clean(z: Column) -> Column:
    """Null where a value says "no data": not finite, or a sentinel within 0.001."""
    bad = z.isNull() | F.isnan(z) | (F.abs(z) == float("inf"))
    for s in NODATA:
        bad = bad | (F.abs(z - F.lit(s)) <= 1e-3)
    return F.when(~bad, z)


#: Vectors that a task writes out as pixels.
VECTORS = 2048


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors dealt over tasks by number: a file of one row group is read by one task, which would write all pixels out."""
    e = load(spark, sf_dir, "embeddings")
    n = -(-e.count() // VECTORS)
    return e.repartition(n, "vec_id") if n > 1 else e


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dense scene: row = vec_id, column = place in the vector."""
    e = vectors(spark, sf_dir)
    t = e.select(F.col("vec_id").cast("int").alias("r"), "label", F.posexplode("embedding").alias("c", "z"))
    return t.select(F.lit("g").alias("scene"), "r", "c", clean(F.col("z").cast("double")).alias("z"), "label")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scenes of unequal size (four, two and one sevenths of the vectors, 64, 48 and 32 wide)."""
    e = vectors(spark, sf_dir)
    n, k = F.floor(F.col("vec_id") / 7), F.col("vec_id") % 7
    scene = F.when(k < 4, "a").when(k < 6, "b").otherwise("c")
    r = F.when(k < 4, n * 4 + k).when(k < 6, n * 2 + k - 4).otherwise(n).cast("int")
    t = e.select(scene.alias("scene"), r.alias("r"), F.posexplode("embedding").alias("c", "z"))
    width = F.when(F.col("scene") == "a", 64).when(F.col("scene") == "b", 48).otherwise(32)
    return t.filter(F.col("c") < width).select("scene", "r", "c", clean(F.col("z").cast("double")).alias("z"))


def city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scenes`` with ``ground``, ``height`` over it and ``block``: a building in most blocks of 16 pixels, as high as the values at the block's corner say.

    It has a higher part, or lacks a corner, by the second value.
    """
    t = scenes(spark, sf_dir).withColumn("br", F.floor(F.col("r") / 16).cast("int")).withColumn("bc", F.floor(F.col("c") / 16).cast("int"))
    at = lambda j: F.max(F.when(F.col("c") % 16 == j, F.col("z")))
    blocks = t.filter((F.col("r") % 16 == 0) & (F.col("c") % 16 < 2)).groupBy("scene", "br", "bc").agg(at(0).alias("e0"), at(1).alias("e1"))
    t = t.join(blocks, ["scene", "br", "bc"])
    y, x = F.col("r") % 16, F.col("c") % 16
    built = (F.col("e0") > -0.1) & y.between(3, 12) & x.between(2, 11) & ~((F.col("e1") < 0) & (y > 5) & (x > 5))
    more = F.when((F.col("e1") > 0) & (y < 8) & (x < 7), 9.0).otherwise(0.0)
    height = F.when(built, F.lit(6.0) + F.floor(F.abs("e0") * 1000) % 13 + more).otherwise(0.0)
    ground = F.lit(100.0) + F.lit(0.05) * F.col("c") + F.lit(0.02) * F.col("r")
    return t.select("scene", "r", "c", "z", ground.alias("ground"), height.alias("height"), (F.col("br") * 8 + F.col("bc")).alias("block"))


def holed(px: DataFrame) -> DataFrame:
    """The grid with every 97th cell missing."""
    return px.withColumn("z", F.when((F.col("r") * 64 + F.col("c")) % 97 != 0, F.col("z")))


def rgb(px: DataFrame) -> DataFrame:
    """Red, green and blue of 0..255 from a grid: a cell and its two right neighbours, wrapping."""
    level = F.least(F.greatest(F.floor(F.lit(127.5) + F.lit(240.0) * F.col("z")), F.lit(0)), F.lit(255)).cast("int")
    rows = px.groupBy("scene", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", level.alias("v")))), lambda x: x["v"]).alias("v"))
    t = rows.select("scene", "r", F.size("v").alias("n"), "v", F.posexplode("v").alias("c", "red"))
    at = lambda k: F.element_at("v", ((F.col("c") + k) % F.col("n") + 1).cast("int"))
    return t.select("scene", "r", "c", "red", at(1).alias("green"), at(2).alias("blue"))


def pred_ref(px: DataFrame) -> DataFrame:
    """A prediction of the grid: flattened, shifted, with a little regular noise."""
    noise = F.lit(0.02) * (((F.col("r") * 31 + F.col("c") * 17) % 7) - 3).cast("double") / F.lit(3.0)
    return px.select("scene", "r", "c", "label", (F.lit(0.7) * F.col("z") + F.lit(0.1) + noise).alias("pred"), F.col("z").alias("ref"))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction and reference rows with strata: lineitem prices against part prices, by flag and supplier region."""
    li, part, s, n, r = (load(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    t = li.join(part, li["l_partkey"] == part["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    t = t.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return t.select((F.col("l_extendedprice") / F.lit(1000.0)).alias("pred"), (F.col("l_quantity") * F.col("p_retailprice") / F.lit(500.0)).alias("ref"), F.col("l_returnflag").alias("cls"), F.col("r_name").alias("region"), F.col("n_name").alias("scene"))
