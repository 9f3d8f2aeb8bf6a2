"""Resampling, tiling and sampling of pixel tables: index arithmetic, one grouped aggregate or one equi-join each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import beside


def block_reduce(px: DataFrame, f: int, agg: Column, *, whole: bool = True, out: str = "z") -> DataFrame:
    """One pixel of every f x f block; with ``whole`` the rest at the far edges is dropped."""
    t = px
    if whole:
        dims = px.groupBy("scene").agg((F.floor((F.max("r") + 1) / f) * f).alias("_h"), (F.floor((F.max("c") + 1) / f) * f).alias("_w"))
        t = beside(px, dims, "scene").filter((F.col("r") < F.col("_h")) & (F.col("c") < F.col("_w")))
    return t.groupBy("scene", F.floor(F.col("r") / f).cast("int").alias("r"), F.floor(F.col("c") / f).cast("int").alias("c")).agg(agg.alias(out))


def valid_average(px: DataFrame, f: int, least: float = 0.5) -> DataFrame:
    """Block averages of valid pixels, null where under ``least`` of a block is valid."""
    t = px.groupBy("scene", F.floor(F.col("r") / f).cast("int").alias("r"), F.floor(F.col("c") / f).cast("int").alias("c"))
    return t.agg(F.avg("z").alias("z"), F.avg(F.col("z").isNotNull().cast("double")).alias("coverage")).withColumn("z", F.when(F.col("coverage") >= least, F.col("z")))


def tile_origins(n: Column, tile: int, overlap: int) -> Column:
    """Sorted origins of overlapping tiles along an axis of n pixels, the last clamped to its end."""
    last = F.greatest(n - tile, F.lit(0))
    steps = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(tile - overlap))
    return F.array_sort(F.array_distinct(F.concat(F.transform(steps, lambda x: F.least(x, last)), F.array(last))))


def tile_grid(dims: DataFrame, tile: int, overlap: int) -> DataFrame:
    """(scene, r0, c0) of the tiles that cover each scene (scene, h, w)."""
    t = dims.select("scene", F.explode(tile_origins(F.col("h"), tile, overlap)).alias("r0"), "w")
    return t.select("scene", "r0", F.explode(tile_origins(F.col("w"), tile, overlap)).alias("c0"))


def feather(i: Column, n: Column, overlap: int) -> Column:
    """Cosine weight of place i among n: rising over ``overlap`` places from either end."""
    k = F.greatest(F.lit(1), F.least(F.lit(overlap), F.floor(n / 2)))
    d = F.least(i, n - 1 - i)
    ramp = (F.lit(1.0) - F.cos(F.lit(3.141592653589793) * (d + 1) / (2 * k + 1))) / 2
    return F.when(d < k, ramp).otherwise(F.lit(1.0))


def blend(tiled: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Weighted mean of overlapping tile predictions (scene, r0, c0, r, c, z) by their feathers."""
    w = feather(F.col("r") - F.col("r0"), F.lit(tile), overlap) * feather(F.col("c") - F.col("c0"), F.lit(tile), overlap)
    return tiled.withColumn("_w", w).groupBy("scene", "r", "c").agg((F.sum(F.col("z") * F.col("_w")) / F.sum("_w")).alias("z"))


def first_wins(layers: DataFrame) -> DataFrame:
    """Mosaic of (scene, r, c, priority, z): the first layer with data at each pixel."""
    return layers.groupBy("scene", "r", "c").agg(F.min_by("z", F.when(F.col("z").isNotNull(), F.col("priority"))).alias("z"))


def bilinear(px: DataFrame, points: DataFrame, dims: DataFrame) -> DataFrame:
    """``points`` (with scene, y, x) with z between the four pixels around, edges clamped; null if over half the weight is missing.

    The four corners are an equi-join on (scene, r, c), so it is one shuffle for any number of points.
    """
    t = beside(points, dims, "scene")
    y, x = F.least(F.greatest("y", F.lit(0.0)), (F.col("h") - 1).cast("double")), F.least(F.greatest("x", F.lit(0.0)), (F.col("w") - 1).cast("double"))
    t = t.withColumn("_y", y).withColumn("_x", x).withColumn("_r", F.floor("_y").cast("int")).withColumn("_c", F.floor("_x").cast("int"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = t.withColumn("_k", corner)
    fy, fx = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    weight = F.when(F.col("_k.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("_k.j") == 1, fx).otherwise(1 - fx)
    t = t.withColumn("_w", weight).withColumn("r", F.least(F.col("_r") + F.col("_k.i"), F.col("h") - 1)).withColumn("c", F.least(F.col("_c") + F.col("_k.j"), F.col("w") - 1))
    t = t.join(px.select("scene", "r", "c", "z"), ["scene", "r", "c"], "left")
    have = F.sum(F.when(F.col("z").isNotNull(), F.col("_w")).otherwise(F.lit(0.0)))
    z = F.sum(F.coalesce("z", F.lit(0.0)) * F.col("_w")) / F.greatest(have, F.lit(1e-12))
    return t.groupBy(*points.columns).agg(F.when(have >= 0.5, z).alias("z"))


def dims_of(px: DataFrame) -> DataFrame:
    return px.groupBy("scene").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def line(lines: DataFrame, n: int) -> DataFrame:
    """``n`` sample points (line, i, y, x) of each line (line, scene, r0, c0, r1, c1), ends included."""
    t = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.col("i") / F.lit(float(n - 1))
    return t.select("line", "scene", "i", (F.col("r0") + (F.col("r1") - F.col("r0")) * at).alias("y"), (F.col("c0") + (F.col("c1") - F.col("c0")) * at).alias("x"))
