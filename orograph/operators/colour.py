"""Colour spaces, content keys and working ground sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import beside
from orograph.operators import resample

#: Linear sRGB to CIE XYZ under D65, its white, and the limits of the curves.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
#: Metres a pixel between which images are worked on.
LEAST_SIZE, MOST_SIZE = 0.30, 1.20


def saturation_value(red: Column, green: Column, blue: Column) -> tuple[Column, Column]:
    """Saturation and value (0..1) of 8-bit colours."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    return F.when(top > 0, (top - low) / top).otherwise(F.lit(0.0)), top / F.lit(255.0)


def linear(level: Column) -> Column:
    x = level / F.lit(255.0)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def lab(df: DataFrame, red: str = "red", green: str = "green", blue: str = "blue") -> DataFrame:
    """``df`` with ``lightness`` (0..100), ``green_red`` and ``blue_yellow`` of 8-bit colours."""
    t = df.withColumns({"_r": linear(F.col(red)), "_g": linear(F.col(green)), "_b": linear(F.col(blue))})
    parts = {k: (F.lit(m[0]) * F.col("_r") + F.lit(m[1]) * F.col("_g") + F.lit(m[2]) * F.col("_b")) / F.lit(w) for k, m, w in zip(("_x", "_y", "_z"), XYZ, WHITE, strict=True)}
    t = t.withColumns(parts)
    curve = lambda c: F.when(F.col(c) > 0.008856, F.pow(F.col(c), F.lit(1 / 3))).otherwise(F.lit(7.787) * F.col(c) + F.lit(16 / 116))
    t = t.withColumns({"_fx": curve("_x"), "_fy": curve("_y"), "_fz": curve("_z")})
    out = {"lightness": F.lit(116.0) * F.col("_fy") - 16, "green_red": F.lit(500.0) * (F.col("_fx") - F.col("_fy")), "blue_yellow": F.lit(200.0) * (F.col("_fy") - F.col("_fz"))}
    return t.withColumns(out).drop("_r", "_g", "_b", "_x", "_y", "_z", "_fx", "_fy", "_fz")


def content_keys(px: DataFrame, tile: int, *parts: Column) -> DataFrame:
    """(scene, tr, tc, key): SHA-1 of each tile's values in order (to nine decimals, missing ones empty) and of ``parts``, what else a cached result depends on."""
    value = F.when(F.col("z").isNotNull(), F.format_string("%.9f", F.col("z") + F.lit(0.0))).otherwise("")
    t = px.groupBy("scene", F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc")).agg(F.array_sort(F.collect_list(F.struct("r", "c", value.alias("v")))).alias("_v"))
    text = F.concat_ws("|", *parts, F.array_join(F.transform("_v", lambda x: x["v"]), ","))
    return t.select("scene", "tr", "tc", F.sha1(text).alias("key"))


def working_size(size: Column) -> Column:
    """Metres a pixel to work at."""
    return F.least(F.greatest(size, F.lit(LEAST_SIZE)), F.lit(MOST_SIZE))


def at_working_size(px: DataFrame, sizes: DataFrame, *, slack: float = 0.02) -> DataFrame:
    """(scene, r, c, z) at the working size of each scene (``sizes``: scene, size); scenes within ``slack`` of it stay as they are.

    Smaller images are averages over what a new pixel covers of the old ones, larger ones
    are bilinear; nulls take no part, and a pixel with none is null.
    """
    dims = resample.dims_of(px)
    d = dims.join(sizes, "scene").withColumn("s", F.col("size") / working_size(F.col("size")))
    d = d.withColumn("s", F.when(F.abs(F.col("s") - 1) > slack, F.col("s")).otherwise(F.lit(1.0)))
    new = lambda n: F.greatest(F.lit(8), F.rint(F.col(n) * F.col("s")).cast("int"))
    d = d.withColumn("nh", F.when(F.col("s") == 1, F.col("h")).otherwise(new("h"))).withColumn("nw", F.when(F.col("s") == 1, F.col("w")).otherwise(new("w")))
    same = beside(px, d.filter("s = 1").select("scene"), "scene", "left_semi").select("scene", "r", "c", "z")
    return same.unionByName(shrunk(px, d.filter("s < 1"))).unionByName(enlarged(px, d.filter("s > 1")))


def shrunk(px: DataFrame, d: DataFrame) -> DataFrame:
    """Averages by area: each old pixel gives its share to the new rows and columns that it meets."""
    t = beside(px.select("scene", "r", "c", "z"), d.select("scene", "h", "w", "nh", "nw"), "scene")

    def shares(i: str, n: str, new: str) -> Column:
        # products of rows pass the range of an int
        a, b = F.col(i).cast("long") * F.col(new) / F.col(n), (F.col(i).cast("long") + 1) * F.col(new) / F.col(n)
        last = F.least(F.ceil(b - 1e-9).cast("int") - 1, F.col(new) - 1)
        return F.explode(F.transform(F.sequence(F.floor(a + 1e-9).cast("int"), last), lambda k: F.struct(k.alias("k"), (F.least(b, k + 1.0) - F.greatest(a, k + 0.0)).alias("w"))))

    t = t.withColumn("_y", shares("r", "h", "nh")).withColumn("_x", shares("c", "w", "nw")).withColumn("_w", F.when(F.col("z").isNotNull(), F.col("_y.w") * F.col("_x.w")))
    return t.groupBy("scene", F.col("_y.k").alias("r"), F.col("_x.k").alias("c")).agg((F.sum(F.col("z") * F.col("_w")) / F.sum("_w")).alias("z"))


def enlarged(px: DataFrame, d: DataFrame) -> DataFrame:
    t = d.select("scene", "h", "w", "nh", "nw", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("row"))
    t = t.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)))
    at = lambda i, n, new: ((F.col(i) + 0.5) * F.col(n) / F.col(new) - 0.5)
    points = t.select("scene", "row", "col", at("row", "h", "nh").alias("y"), at("col", "w", "nw").alias("x"))
    found = resample.bilinear(px, points, d.select("scene", "h", "w"))
    return found.select("scene", F.col("row").alias("r"), F.col("col").alias("c"), "z")


def tagged_union(**sources: DataFrame) -> DataFrame:
    """All rows of several sources with ``source``, their names; columns that one lacks are null there."""
    out = None
    for name, df in sources.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
